from __future__ import annotations

import datetime as dt

import pytest

from sparkloom.database import Database


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.execute("CREATE COLLECTION t (id STRING PRIMARY KEY, v BIGINT)")
    d.execute("INSERT INTO t VALUES ('a', 1), ('b', 2)")
    d.execute("CREATE COLLECTION log (id STRING, was BIGINT, now BIGINT)")
    return d


def rows(db, text):
    return sorted(map(tuple, db.execute(text).collect()), key=repr)


def test_transactions_and_savepoints(db):
    db.execute("BEGIN")
    db.execute("INSERT INTO t VALUES ('c', 3)")
    db.execute("SAVEPOINT one")
    db.execute("DELETE FROM t WHERE id = 'a'")
    assert rows(db, "SELECT id FROM t") == [("b",), ("c",)]
    db.execute("ROLLBACK TO SAVEPOINT one")
    assert rows(db, "SELECT id FROM t") == [("a",), ("b",), ("c",)]
    db.execute("UPDATE t SET v = 9 WHERE id = 'b'")
    db.execute("COMMIT")
    assert rows(db, "SELECT * FROM t") == [("a", 1), ("b", 9), ("c", 3)]
    db.execute("BEGIN TRANSACTION")
    db.execute("TRUNCATE t")
    db.execute("ROLLBACK")
    assert len(rows(db, "SELECT * FROM t")) == 3
    for text in ("COMMIT", "ROLLBACK", "SAVEPOINT x"):
        with pytest.raises(ValueError):
            db.execute(text)


def test_after_triggers_see_old_and_new(db):
    db.execute("CREATE TRIGGER seen AFTER INSERT OR UPDATE ON t FOR EACH ROW WHEN (new.v > 1) AS INSERT INTO log VALUES (NEW.id, OLD.v, NEW.v)")
    db.execute("INSERT INTO t VALUES ('c', 3), ('d', 0)")
    db.execute("UPDATE t SET v = v + 10 WHERE id = 'a'")
    db.execute("DELETE FROM t WHERE id = 'b'")
    assert rows(db, "SELECT * FROM log") == [("a", 1, 11), ("c", None, 3)]
    db.execute("DROP TRIGGER seen")
    db.execute("UPDATE t SET v = 50")
    assert len(rows(db, "SELECT * FROM log")) == 2


def test_before_triggers_change_rows_or_refuse_them(db):
    db.execute("CREATE TRIGGER cap BEFORE INSERT OR UPDATE ON t WHEN (new.v > 100) AS SET NEW.v = 100")
    db.execute("CREATE TRIGGER guard BEFORE DELETE ON t WHEN (old.v >= 100) AS RAISE 'kept'")
    db.execute("UPDATE t SET v = 500 WHERE id = 'a'")
    assert rows(db, "SELECT * FROM t") == [("a", 100), ("b", 2)]
    with pytest.raises(ValueError, match="kept"):
        db.execute("DELETE FROM t")
    assert len(rows(db, "SELECT * FROM t")) == 2


def test_statement_instead_async_and_deferred_triggers(db):
    db.execute("CREATE TRIGGER one AFTER UPDATE ON t FOR EACH STATEMENT AS INSERT INTO log SELECT 'n', count(*), sum(new.v) FROM changes")
    db.execute("UPDATE t SET v = v * 2")
    assert rows(db, "SELECT * FROM log") == [("n", 2, 6)]
    db.execute("CREATE TRIGGER soft INSTEAD OF DELETE ON t AS INSERT INTO log VALUES (OLD.id, OLD.v, NULL)")
    db.execute("DELETE FROM t WHERE id = 'a'")
    assert rows(db, "SELECT * FROM t") == [("a", 2), ("b", 4)]
    assert ("a", 2, None) in rows(db, "SELECT * FROM log")
    db.execute("CREATE TRIGGER later AFTER INSERT ON t ASYNC AS INSERT INTO log VALUES (NEW.id, 0, 0)")
    db.execute("INSERT INTO t VALUES ('x', 1)")
    assert ("x", 0, 0) not in rows(db, "SELECT * FROM log")
    db.execute("RUN TRIGGERS")
    assert ("x", 0, 0) in rows(db, "SELECT * FROM log")
    db.execute("CREATE TRIGGER last AFTER INSERT ON t DEFERRED AS INSERT INTO log VALUES (NEW.id, 7, 7)")
    db.execute("BEGIN")
    db.execute("INSERT INTO t VALUES ('y', 1)")
    assert ("y", 7, 7) not in rows(db, "SELECT * FROM log")
    db.execute("COMMIT")
    assert ("y", 7, 7) in rows(db, "SELECT * FROM log")


def test_copies_conversions_and_indexes(db, spark):
    db.execute("CREATE COLLECTION c CLONE OF t")
    db.execute("CREATE MIRROR m OF t")
    db.execute("UPDATE t SET v = 0 WHERE id = 'a'")
    assert rows(db, "SELECT * FROM c") == [("a", 1), ("b", 2)] and rows(db, "SELECT * FROM m") == [("a", 0), ("b", 2)]
    db.execute("CONVERT COLLECTION c TO DOCUMENT")
    assert rows(db, "SELECT * FROM c") == [("a", '{"v":1}'), ("b", '{"v":2}')]
    db.execute("CONVERT COLLECTION c TO COLUMNAR (v BIGINT)")
    assert rows(db, "SELECT * FROM c") == [("a", 1), ("b", 2)]
    db.execute("CONVERT COLLECTION c TO KV")
    assert rows(db, "SELECT * FROM c") == [("a", '{"v":1}'), ("b", '{"v":2}')]
    db.put("h", spark.createDataFrame([("k", 1, 10), ("k", 5, 50), ("j", 3, 30)], "id string, _ts_system long, v long"), ["id", "_ts_system"])
    db.execute("CREATE COLLECTION old CLONE OF h AS OF SYSTEM TIME 4")
    assert rows(db, "SELECT id, v FROM old") == [("j", 30), ("k", 10)]
    db.execute("CREATE UNIQUE INDEX u ON t (v)")
    with pytest.raises(Exception, match="twice"):
        db.execute("INSERT INTO t VALUES ('z', 2)")
    db.execute("CREATE INDEX i ON t (v)")
    assert len(rows(db, "SELECT * FROM t")) == 2
    assert "rows: 2" in [r["plan"] for r in db.execute("EXPLAIN ANALYZE SELECT * FROM t").collect()]
    for form in ("FORMATTED", "COST", "EXTENDED", "SIMPLE"):
        assert db.execute(f"EXPLAIN {form} SELECT * FROM t").count() > 0


def test_schedules_run_when_due(db):
    db.execute("CREATE SCHEDULE hourly CRON '15 * * * *' AS UPDATE t SET v = v + 1 WHERE id = 'a'")
    db.execute("CREATE SCHEDULE noon CRON '0 12 * * mon-fri' AS UPDATE t SET v = v * 10 WHERE id = 'a'")
    names = db.run_due(dt.datetime(2024, 1, 5, 10, 30), dt.datetime(2024, 1, 5, 12, 30))  # a Friday
    assert names == ["hourly", "noon", "hourly"]
    assert rows(db, "SELECT v FROM t WHERE id = 'a'") == [(21,)]


def test_arrays_are_compacted(db, spark):
    db.execute("CREATE ARRAY g DIMS (x INT64 [0..9]) ATTRS (q FLOAT64)")
    a = db.arrays["g"]
    db.arrays["g"] = a._with(spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 5), (1, 3.0, 9), (2, 4.0, 2)], "x long, q double, _ts_system long"))
    assert db.execute("SELECT ARRAY_FLUSH('g')").first()[0] == 4
    assert db.execute("SELECT ARRAY_COMPACT('g', 6)").first()[0] == 3
    assert sorted((r["x"], r["q"]) for r in db.arrays["g"].as_of("_ts_system", 6).cells.collect()) == [(1, 2.0), (2, 4.0)]
