"""Statements of the database, on small collections."""

from __future__ import annotations

import pytest

from sparkloom.database import Database, literal, split_top


@pytest.fixture
def db(spark):
    return Database(spark)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_parts_and_literals():
    assert split_top("a, f(b, 'c,d'), [1,2]") == ["a", "f(b, 'c,d')", "[1,2]"]
    assert [literal(x) for x in ("'it''s'", "3", "2.5", "ARRAY[1, -2.0]", "NULL", "true")] == ["it's", 3, 2.5, [1, -2.0], None, True]


def test_changes_to_a_collection(db):
    db.execute("CREATE COLLECTION t (id STRING PRIMARY KEY, name TEXT, score BIGINT)")
    db.execute("INSERT INTO t (id, name, score) VALUES ('a', 'alpha', 10), ('b', 'beta', 20)")
    with pytest.raises(Exception, match="duplicate key"):
        db.execute("INSERT INTO t VALUES ('a', 'again', 1)")
    db.execute("INSERT INTO t VALUES ('a', 'again', 1), ('c', 'gamma', 30) ON CONFLICT (id) DO NOTHING")
    got = db.execute("INSERT INTO t VALUES ('a', 'x', 5) ON CONFLICT (id) DO UPDATE SET score = t.score + EXCLUDED.score RETURNING id, score")
    assert rows(got) == [("a", 15)]
    db.execute("UPSERT INTO t { id: 'd', name: 'delta', score: 40 }")
    assert rows(db.execute("UPDATE t SET score = score + 1, name = upper(name) WHERE score > 25 RETURNING *")) == [("c", "GAMMA", 31), ("d", "DELTA", 41)]
    assert rows(db.execute("DELETE FROM t WHERE score = 41 RETURNING id")) == [("d",)]
    assert rows(db.execute("SELECT * FROM t WHERE score >= $1", 20)) == [("b", "beta", 20), ("c", "GAMMA", 31)]
    db.execute("INSERT INTO t SELECT concat(id, '2'), name, score FROM t WHERE id = 'b'")
    assert rows(db.execute("SELECT id FROM t")) == [("a",), ("b",), ("b2",), ("c",)]
    db.execute("TRUNCATE t")
    assert rows(db.execute("SELECT count(*) FROM t")) == [(0,)]


def test_merge_and_update_from(db):
    db.execute("CREATE TABLE target (id STRING PRIMARY KEY, name STRING, score BIGINT)")
    db.execute("CREATE TABLE source (id STRING PRIMARY KEY, name STRING, score BIGINT)")
    db.execute("INSERT INTO target VALUES ('a', 'alpha', 10), ('b', 'beta', 20)")
    db.execute("INSERT INTO source VALUES ('a', 'ALPHA_UPD', 99), ('c', 'gamma', 30)")
    db.execute("MERGE INTO target t USING source s ON t.id = s.id WHEN MATCHED AND s.score > 50 THEN UPDATE SET name = s.name, score = s.score WHEN NOT MATCHED THEN INSERT (id, name, score) VALUES (s.id, s.name, s.score) WHEN NOT MATCHED BY SOURCE THEN DELETE")
    assert rows(db.execute("SELECT * FROM target")) == [("a", "ALPHA_UPD", 99), ("c", "gamma", 30)]
    db.execute("UPDATE target SET score = source.score + target.score FROM source WHERE target.id = source.id AND source.score < 50")
    assert rows(db.execute("SELECT id, score FROM target")) == [("a", 99), ("c", 60)]


def test_graph_statements(db):
    for a, b in (("alice", "bob"), ("bob", "carol"), ("carol", "dave")):
        db.execute(f"GRAPH INSERT EDGE FROM '{a}' TO '{b}' TYPE 'knows'")
    assert rows(db.execute("MATCH (a)-[:knows]->(b) WHERE a.id = 'alice' RETURN b.id AS b")) == [("bob",)]
    assert rows(db.execute("GRAPH TRAVERSE FROM 'alice' DEPTH 2")) == [("alice", 0), ("bob", 1), ("carol", 2)]
    assert db.execute("GRAPH PATH FROM 'alice' TO 'dave' MAX_DEPTH 5").first()["path"] == ["alice", "bob", "carol", "dave"]
    assert rows(db.execute("GRAPH NEIGHBORS OF 'bob' DIRECTION both")) == [("alice",), ("carol",)]
    assert {r["node"] for r in db.execute("GRAPH ALGO PAGERANK ON edges ITERATIONS 5").collect()} == {"alice", "bob", "carol", "dave"}
    assert rows(db.execute("GRAPH ALGO WCC ON edges")) == [(n, "alice") for n in ("alice", "bob", "carol", "dave")]
    db.execute("GRAPH DELETE EDGE FROM 'bob' TO 'carol' TYPE 'knows'")
    assert rows(db.execute("GRAPH TRAVERSE FROM 'alice' DEPTH 3")) == [("alice", 0), ("bob", 1)]


def test_arrays(db, spark):
    from sparkloom.operators.ndarray import Array

    db.execute("CREATE ARRAY g DIMS (x INT64 [0..9], y INT64 [0..9]) ATTRS (v FLOAT64)")
    cells = spark.createDataFrame([(x, y, float(x * 3 + y), 1) for x in range(3) for y in range(3)] + [(0, 0, 99.0, 5)], "x long, y long, v double, _ts_system long")
    db.arrays["g"] = Array(cells, db.arrays["g"].dims, ["v"])
    assert rows(db.execute("SELECT x, y, v FROM ARRAY_SLICE('g', {x: [0, 1], y: [0, 2)}, ['v'], 100) AS OF SYSTEM TIME 3")) == [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 3.0), (1, 1, 4.0)]
    assert rows(db.execute("SELECT * FROM ARRAY_AGG('g', 'v', 'sum', 'x') AS OF SYSTEM TIME 9")) == [(0, 102.0), (1, 12.0), (2, 21.0)]


def test_indexes_views_files_and_search(db, spark, tmp_path):
    db.put("players", spark.createDataFrame([("p1", 10, "red fox", [1.0, 0.0]), ("p2", 30, "lazy dog", [0.0, 1.0]), ("p3", 20, "fox and dog", [1.0, 1.0])], "id string, score long, body string, emb array<double>"), ["id"])
    db.execute("CREATE SORTED INDEX lb ON players (score DESC) KEY id")
    assert rows(db.execute("SELECT * FROM TOPK(lb, 2)")) == [(1, "p2", 30), (2, "p3", 20)]
    assert rows(db.execute("SELECT id FROM RANGE(lb, 10, 20)")) == [("p1",), ("p3",)]
    assert rows(db.execute("SELECT RANK(lb, 'p3')")) == [(2,)] and rows(db.execute("SELECT SORTED_COUNT(lb)")) == [(3,)]
    assert [r["id"] for r in db.execute("SEARCH players USING VECTOR(emb, ARRAY[1.0, 0.1], 2)").collect()] == ["p1", "p3"]
    assert {r["id"] for r in db.execute("SEARCH players USING FUSION(emb, ARRAY[1.0, 0.0], body, 'fox', 2)").collect()} == {"p1", "p3"}
    db.execute("CREATE MATERIALIZED VIEW m AS SELECT count(*) AS n FROM players")
    db.execute("DELETE FROM players WHERE id = 'p1'")
    assert rows(db.execute("SELECT * FROM m")) == [(3,)]
    db.execute("REFRESH MATERIALIZED VIEW m")
    assert rows(db.execute("SELECT * FROM m")) == [(2,)]
    db.execute(f"COPY (SELECT id, score FROM players) TO 'file://{tmp_path}/out.csv'")
    db.execute("CREATE TABLE copied (id STRING, score BIGINT)")
    db.execute(f"COPY copied FROM 'file://{tmp_path}/out.csv'")
    assert rows(db.execute("SELECT * FROM copied")) == [("p2", 30), ("p3", 20)]


def test_extensions_in_select(db, folder):
    db.folder = folder
    assert db.execute("SELECT time_bucket('1 day', ts) AS d, count(*) AS n FROM events GROUP BY 1").count() == 30
    assert rows(db.execute("SELECT field, sum(n) FROM FACET_COUNTS(orders, 'o_totalprice > 0', ['o_orderstatus', 'o_orderpriority'], 10) GROUP BY field")) == [("o_orderpriority", 1500), ("o_orderstatus", 1500)]


def test_key_value_statements(db):
    assert rows(db.execute("SELECT KV_INCR('scores', 'p', 10)")) == [(10,)]
    assert rows(db.execute("SELECT KV_DECR('scores', 'p', 3)")) == [(7,)]
    assert rows(db.execute("SELECT KV_INCR_FLOAT('damage', 'p', 95.5)")) == [(95.5,)]
    assert rows(db.execute("SELECT KV_GETSET('state', 'p', 'idle')")) == []
    assert rows(db.execute("SELECT KV_CAS('state', 'p', 'idle', 'busy')")) == [(True,)]
    assert rows(db.execute("SELECT KV_CAS('state', 'p', 'idle', 'gone')")) == [(False,)]
    assert rows(db.execute("SELECT KV_GETSET('state', 'p', 'x')")) == [("busy",)]


def test_trees_and_lookups(db, spark):
    db.put("accounts", spark.createDataFrame([("root", None, 1.0), ("a", "root", 2.0), ("b", "root", 4.0), ("c", "a", 8.0), ("z", None, 99.0)], "id string, parent_id string, balance double"), ["id"])
    db.execute("CREATE GRAPH INDEX tree ON accounts (parent_id -> id)")
    assert rows(db.execute("SELECT TREE_CHILDREN(tree, 'root')")) == [("a",), ("b",), ("c",)]
    assert rows(db.execute("SELECT TREE_SUM(balance, tree, 'a') FROM accounts LIMIT 1")) == [(10.0,)]
    db.put("rates", spark.createDataFrame([("EUR/USD", "2024-01-01 00:00:00", 1.1), ("EUR/USD", "2024-02-01 00:00:00", 1.2)], "pair string, ts string, rate double").selectExpr("pair", "cast(ts AS timestamp_ntz) AS ts", "rate"), ["pair"])
    assert rows(db.execute("SELECT CONVERT_CURRENCY_LOOKUP(100, 'EUR', 'USD', 'rates', '2024-01-15', 'pair', 'rate', 'ts', 2)")) == [(110.0,)]
    assert db.execute("SELECT * FROM TEMPORAL_LOOKUP('rates', 'EUR/USD', '2024-03-01', 'pair', 'ts')").first()["rate"] == 1.2
    assert db.execute("SELECT LAST_VALUE('rates', 'EUR/USD')").first()["rate"] == 1.2 and db.execute("SELECT LAST_VALUES('rates')").count() == 1
    assert rows(db.execute("SELECT ESTIMATE_COUNT('accounts', 'id')")) == [(5,)]
    stats = {r["column"]: r for r in db.execute("ANALYZE accounts").collect()}
    assert stats["parent_id"]["nulls"] == 2 and stats["balance"]["greatest"] == "99.0" and stats["id"]["rows"] == 5
    assert db.execute("EXPLAIN SELECT id FROM accounts").filter("plan LIKE '%Physical Plan%'").count() == 1
