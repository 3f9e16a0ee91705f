"""Operators and functions on small tables with known results."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.catalog import Tables
from sparkloom.functions import scalar as S
from sparkloom.functions import spatial as P
from sparkloom.functions import user
from sparkloom.functions.stem import stem, stem_de
from sparkloom.operators import access, dml, keyvalue, search, vector
from sparkloom.operators import relational as R
from sparkloom.operators import timeseries as TS
from sparkloom.operators.ndarray import Array
from sparkloom.plans.sql import rewrite
from sparkloom.promql import query, query_range, shown
from sparkloom.promql.parse import Aggregate, Binary, parse
from sparkloom.shared import shared_dir
from sparkloom.sources import files, protocols
from sparkloom.streaming import views


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


# Windows and relational operators


def test_groups_frame_and_even_ntile(spark):
    tied = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 2, 20), ("d", 3, 30), ("e", 3, 30)], "id string, grp long, n long")
    got = R.groups_frame(tied, [], [F.col("grp")], -1, 1, {"s": F.sum("n")})
    assert rows(got.select("id", "s")) == [("a", 40), ("b", 40), ("c", 100), ("d", 80), ("e", 80)]
    seven = spark.range(7).withColumn("g", F.lit(1))
    assert [r[0] for r in seven.select(R.ntile_even(5, ["g"], [F.col("id")]).alias("t")).orderBy("t").collect()] == [1, 1, 2, 3, 3, 4, 5]


def test_lateral_top_rows(spark):
    users = spark.createDataFrame([("u1", 100), ("u2", 200), ("u3", 1)], "uid string, at long")
    events = spark.createDataFrame([("u1", 10), ("u1", 30), ("u1", 20), ("u2", 50)], "user string, score long")
    top = R.lateral_topk(users, events, "uid", "user", [F.desc("score")], 2)
    assert rows(top.select("uid", "score")) == [("u1", 20), ("u1", 30), ("u2", 50)]
    assert R.lateral_topk(users, events, "uid", "user", [F.desc("score")], 1, "left").count() == 3


def test_range_join_equals_the_cross_product(spark):
    points = spark.range(200).select((F.col("id") * 0.37).alias("x"))
    ranges = spark.createDataFrame([(0.0, 3.0), (2.5, 40.0), (10.0, 10.0), (73.0, 99.0)], "lo double, hi double")
    want = points.join(ranges, (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    assert rows(R.range_join(points, ranges, "x", "lo", "hi", 4.0)) == rows(want)


def test_recursion_reaches_through_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a long, b long")
    assert rows(R.reachable(spark.createDataFrame([(1,)], "b long"), e, "b", "a", "b")) == [(1,), (2,), (3,)]


# Time series


@pytest.fixture(scope="module")
def series(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [("k", t0 + dt.timedelta(seconds=s), v) for s, v in ((0, 10.0), (10, 20.0), (20, 5.0), (40, 9.0))]
    return spark.createDataFrame(data, "k string, ts timestamp_ntz, v double")


def test_series_functions(series):
    w = Window.partitionBy("k").orderBy("ts")
    cols = {"rate": TS.ts_rate("v", "ts", w), "deriv": TS.ts_derivative("v", "ts", w), "delta": TS.ts_delta("v", w), "avg": TS.ts_moving_avg("v", 2, w), "ema": TS.ts_ema("v", 0.5, w)}
    got = series.select("ts", *(c.alias(n) for n, c in cols.items())).orderBy("ts").collect()
    assert [r["rate"] for r in got] == [None, 1.0, 0.5, 0.2]
    assert [r["deriv"] for r in got] == [None, 1.0, -1.5, 0.2]
    assert [r["delta"] for r in got] == [None, 10.0, -15.0, 4.0]
    assert [r["avg"] for r in got] == [None, 15.0, 12.5, 7.0]
    assert [r["ema"] for r in got] == [10.0, 15.0, 10.0, 9.5]


def test_as_of_join_takes_the_latest_within_tolerance(spark, series):
    left = spark.createDataFrame([("k", dt.datetime(2024, 1, 1, 0, 0, 15)), ("k", dt.datetime(2024, 1, 1, 0, 0, 39)), ("k", dt.datetime(2023, 1, 1)), ("z", dt.datetime(2024, 1, 2))], "k string, at timestamp_ntz")
    got = TS.asof_join(left, series.withColumnRenamed("ts", "rts"), ["k"], "at", "rts", ["v"], 10).orderBy("at")
    assert [r["v"] for r in got.collect()] == [None, 20.0, None, None]


@pytest.mark.parametrize("method,want", [("null", [10.0, 20.0, 5.0, None, 9.0]), ("prev", [10.0, 20.0, 5.0, 5.0, 9.0]), ("next", [10.0, 20.0, 5.0, 9.0, 9.0]), ("linear", [10.0, 20.0, 5.0, 7.0, 9.0]), ("literal", [10.0, 20.0, 5.0, -1.0, 9.0])])
def test_gap_filling(series, method, want):
    got = TS.gap_fill(series, "ts", 10, ["k"], "v", method, -1.0).orderBy("ts")
    assert [r["v"] for r in got.collect()] == want


# Changes


def test_changes_and_constraints(spark):
    t = spark.createDataFrame([("a", "alpha", 10), ("b", "beta", 20)], "id string, name string, score long")
    s = spark.createDataFrame([("a", "ALPHA", 99), ("c", "gamma", 30)], "id string, name string, score long")
    assert rows(dml.upsert(t, s, ["id"])) == [("a", "ALPHA", 99), ("b", "beta", 20), ("c", "gamma", 30)]
    feed = dml.field_diffs(dml.changes(t, dml.upsert(t, s, ["id"]), ["id"]), ["name", "score"])
    assert rows(feed.select("op", "id", "changed")) == [("insert", "c", None), ("update", "a", ["name", "score"])]
    with pytest.raises(Exception, match="duplicate key"):
        dml.insert_strict(t, s, ["id"]).collect()
    with pytest.raises(Exception, match="check positive fails"):
        dml.checked(t, {"positive": F.col("score") > 15}).collect()
    with pytest.raises(Exception, match="source has a key twice"):
        dml.update_from(t, s.unionByName(s), ["id"], {"score": F.col("s.score")}).collect()
    with pytest.raises(ValueError):
        dml.generated(t, {"x": "y + 1", "y": "x + 1"})
    assert rows(dml.bad_transitions(t.select("id", F.lit("open").alias("st")), t.select("id", F.when(F.col("id") == "a", "done").otherwise("gone").alias("st")), ["id"], "st", [("open", "done")])) == [("b", "open", "gone")]


def test_versions(spark):
    v = spark.createDataFrame([(1, 10, "x", False), (1, 20, "y", False), (2, 5, "z", False), (2, 15, None, True)], "id long, sys long, v string, gone boolean")
    assert rows(dml.as_of(v, ["id"], "sys", 12, "gone").select("id", "v")) == [(1, "x"), (2, "z")]
    assert rows(dml.as_of(v, ["id"], "sys", 30, "gone").select("id", "v")) == [(1, "y")]
    spans = dml.intervals(v, ["id"], "sys")
    assert rows(dml.valid_at(spans, "sys", "until", 20).select("id", "sys")) == [(1, 20), (2, 15)]
    assert rows(dml.valid_between(spans, "sys", "until", 6, 15).select("id", "sys")) == [(1, 10), (2, 5)]


def test_a_forged_chain_is_found(spark):
    t = spark.createDataFrame([("p", i, f"row {i}") for i in range(50)], "part string, n long, body string")
    chained = dml.hash_chain(t, "part", ["n"], ["n", "body"])
    assert dml.broken_chain(chained, "part", ["n"], ["n", "body"]).count() == 0
    forged = chained.withColumn("body", F.when(F.col("n") == 30, "other").otherwise(F.col("body")))
    assert rows(dml.broken_chain(forged, "part", ["n"], ["n", "body"]).select("n")) == [(30,)]


# Key-value tables and arrays


def test_key_value_steps(spark):
    t = spark.createDataFrame([("a", 5), ("b", 7)], "key string, value long")
    inc = spark.createDataFrame([("a", 2), ("a", 3), ("c", 1)], "key string, delta long")
    assert rows(keyvalue.incremented(t, inc, "key", "value", "delta")) == [("a", 10), ("b", 7), ("c", 1)]
    moves = spark.createDataFrame([("a", "b", 4)], "source string, target string, amount long")
    assert rows(keyvalue.transferred(t, moves, "key", "value")) == [("a", 1), ("b", 11)]
    wants = spark.createDataFrame([("a", 5, 50), ("b", 0, 70)], "key string, expected long, new long")
    assert rows(keyvalue.compare_and_set(t, "key", "value", wants)) == [("a", 50), ("b", 7)]
    with pytest.raises(Exception, match="(?i)overflow"):
        keyvalue.incremented(t, spark.createDataFrame([("a", 2**63 - 1)], "key string, delta long"), "key", "value", "delta").collect()


def test_ranks_need_no_single_sort(spark):
    t = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 7).alias("score"))
    got = keyvalue.ranked(t, "score", "key").orderBy("rank").collect()
    assert [(r["rank"], -r["score"], r["key"]) for r in got] == [(i, s, k) for i, (s, k) in enumerate(sorted((-(k % 7), k) for k in range(500)), 1)]


def test_hilbert_curve_visits_neighbours(spark):
    cells = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    a = Array(cells, {"x": (0, 7), "y": (0, 7)}, [])
    path = [(r["x"], r["y"]) for r in cells.withColumn("h", a.hilbert(3)).orderBy("h").collect()]
    assert len(set(path)) == 64 and all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(path, path[1:], strict=False))
    with pytest.raises(Exception, match="out of its domain"):
        Array(cells, {"x": (0, 3), "y": (0, 7)}, []).check().cells.collect()


# Search


def test_text_search(spark):
    d = spark.createDataFrame([("d1", "The quick brown fox"), ("d2", "A lazy dog sleeps"), ("d3", "Fox hunting is banned"), ("d4", None)], "id string, body string")
    hit = lambda c: [r["id"] for r in d.filter(c).orderBy("id").collect()]
    assert hit(search.matches("body", "fox")) == ["d1", "d3"]
    assert hit(search.matches("body", "fox & !quick | laz:*")) == ["d2", "d3"]
    assert hit(search.matches("body", '"brown fox"')) == ["d1"] and hit(search.matches("body", search.web_query('fox -"brown fox"'))) == ["d3"]
    assert hit(search.fuzzy_match("body", "huntign")) == ["d3"]
    assert [r["id"] for r in search.bm25(d, "id", "body", ["fox", "quick"], 5).collect()] == ["d1", "d3"]
    assert d.filter("id = 'd1'").select(search.highlight("body", ["fox"])).first()[0] == "The quick brown <b>fox</b>"
    with pytest.raises(ValueError):
        search.parse("(a & b")


def test_stems():
    words = {"running": "run", "hopping": "hop", "hoping": "hope", "ties": "tie", "flies": "fli", "consolations": "consol", "relational": "relat", "happily": "happili", "knightly": "knight"}
    assert {w: stem(w) for w in words} == words


def test_german_stems():
    words = {"häuser": "haus", "aufeinander": "aufeinand", "verschlossen": "verschloss", "katers": "kat", "freundlichkeit": "freundlich", "kategorie": "kategori"}
    assert {w: stem_de(w) for w in words} == words


def test_product_codes_find_near_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    books = vector.product_codebooks(df, "v", parts=4, codes=32, key="id")
    coded = df.withColumn("c", vector.product_codes("v", books))
    q = x[7] + 0.01
    got = [r["id"] for r in vector.product_topk(coded, "v", "c", books, q.tolist(), 5, "id", 20).collect()]
    assert got == np.argsort(((x - q) ** 2).sum(1))[:5].tolist()


def test_vector_metrics(spark):
    a, b = vector.literal([1.0, 2.0, 0.0]), vector.literal([1.0, 0.0, 2.0])
    got = one(spark, *(vector.distance(a, b, m).alias(m) for m in ("l2", "ip", "manhattan", "chebyshev", "hamming", "cosine")))
    assert got == (pytest.approx(8**0.5), -1.0, 4.0, 2.0, 2.0, pytest.approx(0.8))


# Scalars


def test_scalars(spark):
    assert one(spark, S.divide(F.lit(1), F.lit(0)), S.mod(F.lit(5), F.lit(0)), S.concat(F.lit("a"), F.lit(None), F.lit("b"))) == (None, None, "ab")
    halves = [one(spark, S.round_mode(F.lit(-2.5), 0, m))[0] for m in ("HALF_EVEN", "HALF_UP", "HALF_DOWN", "TRUNCATE", "CEILING", "FLOOR")]
    assert halves == [-2.0, -3.0, -2.0, -2.0, -2.0, -3.0]
    assert one(spark, S.duration_seconds(F.lit("1h30m")), S.duration_seconds(F.lit("250ms")), S.duration_seconds(F.lit("soon"))) == (5400.0, 0.25, None)
    assert one(spark, S.json_contains(F.lit('{"a": [1, {"b": 2}]}'), F.lit('{"a": [{"b": 2}]}')), S.json_contains(F.lit("[1]"), F.lit("[true]"))) == (True, False)
    chunks = one(spark, S.chunk_text(F.lit("abcdefghij"), 4, 1))[0]
    assert [(c["start"], c["text"]) for c in chunks] == [(0, "abcd"), (3, "defg"), (6, "ghij")]


def test_filters_policies_and_cursors(spark):
    t = spark.range(10).withColumn("tags", F.array(F.col("id"), F.col("id") + 1))
    got = t.filter(access.metadata_filter({"or": [{"id": {"lt": 2}}, {"tags": {"array_contains_all": [8, 9]}}], "not": {"id": 0}}))
    assert [r["id"] for r in got.collect()] == [1, 8]
    p = access.Policies()
    p.add("t", "reader", F.col("id") > 7)
    assert p.apply("t", t, "reader").count() == 2 and p.apply("t", t, "other").count() == 0 and p.apply("u", t, "x").count() == 10
    c = access.Cursor(spark.range(5))
    assert [r["id"] for r in c.fetch(3)] == [0, 1, 2] and len(c.fetch(9)) == 2
    c.close()
    with pytest.raises(ValueError):
        c.fetch()


def test_user_functions(spark):
    user.sql_function(spark, "plus_one", {"x": "int"}, "int", "x + 1")
    assert spark.sql("SELECT plus_one(41) AS x").first()["x"] == 42
    p = user.Procedure("double_it", ["n"], "BEGIN DECLARE x INT DEFAULT 0; SET x = :n * 2; IF x > 10 THEN SELECT 'big' AS size; ELSE SELECT 'small' AS size; END IF; END")
    assert [p.call(spark, n).first()["size"] for n in (2, 9)] == ["small", "big"]


# Spatial


def test_geometries(spark):
    square, hole = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 5 1, 5 5, 1 5, 1 1))"
    ok = lambda f, a, b: f(P.parse(a), P.parse(b))
    assert ok(P.contains, square, "POINT(1 1)") and not ok(P.contains, square, "POINT(0 1)") and ok(P.intersects, square, "POINT(0 1)")
    assert not ok(P.contains, hole, "POINT(2 2)") and not ok(P.contains, hole, "LINESTRING(0.5 0.5, 6 6)") and ok(P.contains, hole, "LINESTRING(0.5 0.5, 0.5 8)")
    assert ok(P.intersects, "LINESTRING(0 0, 4 4)", "LINESTRING(0 4, 4 0)") and not ok(P.intersects, square, "LINESTRING(5 0, 5 5)")
    assert P.area(P.parse(hole)) == 65 and P.wkt(P.intersection(P.parse(square), P.parse("POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))"))).startswith("POLYGON")
    assert P.area(P.intersection(P.parse(square), P.parse("POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))"))) == pytest.approx(4)
    assert P.parse(P.wkt(P.parse("MULTIPOINT((1 2), (3 4))"))) == P.parse("MULTIPOINT(1 2, 3 4)")
    assert not P.is_valid(P.parse("POLYGON((0 0, 4 4, 4 0, 0 4, 0 0))"))
    assert P.distance(P.parse("POINT(0 0)"), P.parse("POINT(0 1)")) == pytest.approx(111_195, rel=1e-4)
    assert one(spark, P.geohash(F.lit(-122.4), F.lit(37.8), 6))[0][0] == "9"
    code = one(spark, P.geohash(F.lit(13.4), F.lit(52.5), 7))[0]
    w, s, e, n = P.geohash_bounds(code)
    assert w <= 13.4 <= e and s <= 52.5 <= n and len(set(one(spark, P.geohash_neighbors(F.lit(code)))[0]) - {code}) == 8


# PromQL


def test_promql_grammar():
    e = parse('sum by (a) (rate(m{x="1",y!~"b.*"}[5m] offset 1h)) / on (a) group_left (z) 2 ^ 3 ^ 2 > bool 1')
    assert isinstance(e, Binary) and e.op == ">" and e.as_bool and e.left.on and e.left.include == ["z"]
    assert isinstance(e.left.left, Aggregate) and e.left.left.expr.args[0].offset_ms == 3_600_000
    assert e.left.right.op == "^" and e.left.right.right.op == "^"
    for bad in ("sum(", "m[5m", "m{a=1}", "1 +", "rate(m[5m]) )"):
        with pytest.raises(ValueError):
            parse(bad)


def test_promql_values(spark):
    data = [("m", {"s": "a"}, t * 1000, float(v)) for t, v in ((0, 1), (10, 4), (20, 2), (30, 6))] + [("m", {"s": "b"}, 30_000, 9.0)]
    s = spark.createDataFrame(data, "metric string, labels map<string,string>, ts long, value double")
    at = lambda q, t=30_000: {r[0]: r[1] for r in query(s, q, t).select(shown("labels"), "value").collect()}
    assert at("m") == {'__name__="m",s="a"': 6.0, '__name__="m",s="b"': 9.0}
    assert at("increase(m[1m])") == {'s="a"': 9.0} and at("resets(m[1m])") == {'s="a"': 1.0, 's="b"': 0.0}
    assert at("holt_winters(m[1m], 0.5, 0.5)") == {'s="a"': 6.125, 's="b"': 9.0}
    assert at("irate(m[1m])") == {'s="a"': 0.4} and at("sum(m)") == {"": 15.0} and at("m / 0 > 100") == {'s="a"': float("inf"), 's="b"': float("inf")}
    assert at('scalar(m{s="b"}) + 1') == {"": 10.0} and at('absent(m{s="c"})') == {'s="c"': 1.0}
    assert at('m{s="a"} or m') == at("m") and at('m unless m{s="a"}') == {'__name__="m",s="b"': 9.0}
    steps = query_range(s, 'max_over_time(m{s="a"}[15s])', 0, 60_000, 15_000).orderBy("step").collect()
    assert [(r["step"], r["value"]) for r in steps] == [(0, 1.0), (15_000, 4.0), (30_000, 6.0)]


# Sources and streams


def test_protocols_and_files(spark, tmp_path):
    lines = spark.createDataFrame([('cpu\\ load,host=a\\,b v=1.5,ok=true,note="x, \\"y\\" z" 1700000000000000000',), ("# comment",), ("",), ("m v=3i",)], "value string")
    got = {(r["measurement"], r["field"]): r for r in protocols.line_protocol(lines).collect()}
    assert got["cpu load", "note"]["text"] == 'x, "y" z' and got["cpu load", "v"]["tags"] == {"host": "a,b"} and got["cpu load", "ok"]["flag"] is True
    assert got["m", "v"]["number"] == 3.0 and got["m", "v"]["ts"] is None
    with pytest.raises(Exception, match="no line protocol"):
        protocols.line_protocol(spark.createDataFrame([("nonsense",)], "value string")).collect()
    t = spark.createDataFrame([(1, 'quo"te, x'), (2, None)], "id int, name string")
    for ending in ("csv", "ndjson", "parquet"):
        files.copy_to(t, f"{tmp_path}/t.{ending}")
        assert rows(files.copy_from(spark, f"{tmp_path}/t.{ending}", "id int, name string")) == rows(t)
    with pytest.raises(ValueError):
        files.from_objects(spark, "{a: 1, b: 2}", "a int")


def test_streams_go_on_where_they_were(spark):
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long").write.parquet(f"{base}/in")
    sink = views.upsert_sink(f"{base}/out", ["k"], "v")

    def run():
        s = spark.readStream.schema("k string, v long").parquet(f"{base}/in")
        s.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/cp").foreachBatch(sink).start().awaitTermination()

    run()
    spark.createDataFrame([("a", 5), ("c", 1)], "k string, v long").write.mode("append").parquet(f"{base}/in")
    run()
    assert rows(views.read_version(spark, f"{base}/out")) == [("a", 5), ("b", 2), ("c", 1)]
    assert rows(views.read_version(spark, f"{base}/out", 0)) == [("a", 1), ("b", 2)]


def test_webhooks_are_signed():
    body, signature = views.signed({"b": 1, "a": "x"}, b"key")
    assert body == b'{"a":"x","b":1}' and len(signature) == 64 and views.signed({"a": "x", "b": 1}, b"key")[1] == signature


# SQL front end and catalog


def test_extensions_are_rewritten():
    assert "timestamp_micros" in rewrite("SELECT time_bucket('5 minutes', ts) FROM e") and "zip_with" in rewrite("SELECT a <-> [1, 2]")
    assert "get_json_object(props, '$.k')" in rewrite("SELECT props->>'k'") and "_ts_system <= 5" in rewrite("SELECT * FROM t FOR SYSTEM_TIME AS OF 5")


def test_point_gets_reach_the_scan(spark, folder):
    plan = Tables(spark, folder).get("orders", o_orderkey=7).select("o_orderkey", "o_totalprice")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "o_custkey" not in plan.split("ReadSchema")[-1]
