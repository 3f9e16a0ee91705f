"""Steps whose cost must grow no faster than their input, and figures that must not overflow."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkloom.catalog import Tables
from sparkloom.functions import spatial
from sparkloom.operators import graph as G
from sparkloom.operators import search
from sparkloom.operators import vector as V
from sparkloom.operators.ndarray import Array
from sparkloom.plans import all_queries, spatials, wires


def test_phrases_take_one_pass(spark):
    """A text's words were split again for every place in it: minutes for this one."""
    began = time.time()
    d = spark.createDataFrame([("a", "of the " * 20_000), ("b", "of. THE of"), ("c", "x of_the x"), ("d", None), ("e", "of of of")], "id string, body string")
    count = lambda *words: {r["id"]: r["n"] for r in d.select("id", search.phrase_count("body", list(words)).alias("n")).collect()}
    assert count("of", "the") == {"a": 20_000, "b": 1, "c": 1, "d": 0, "e": 0}
    assert count("of", "of") == {"a": 0, "b": 0, "c": 0, "d": 0, "e": 2}
    assert count("of_the") == dict.fromkeys("abcde", 0)
    assert d.filter(search.matches("body", '!"of the"')).count() == 2
    assert time.time() - began < 60


def test_query_forms_take_one_pass(spark):
    """plain, phrase and web forms of one long text: the phrase took minutes."""
    began = time.time()
    d = spark.createDataFrame([("a", "word " * 20_000 + "of the"), ("b", "by the of"), ("d", None)], "id string, body string")
    forms = (search.plain_query("the of"), search.phrase_query("of the"), search.web_query("the -by"))
    got = {r[0]: tuple(r)[1:] for r in d.select("id", *(search.matches("body", f).alias(f"f{i}") for i, f in enumerate(forms))).collect()}
    assert got["a"] == (True, True, True) and got["b"] == (True, False, False) and not got["d"][1]
    assert time.time() - began < 60


def test_many_edges_have_a_fingerprint(spark):
    """A sum of 40 bits of each edge's hash left a long's range at some 17 million edges."""
    e = spark.range(20_000_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert G.fingerprint(e)[0] == 20_000_000
    assert G.fingerprint(e) != G.fingerprint(e.filter("src > 0"))


def ring(spark, n: int):
    return spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))


def quick(f):
    """What f gives in under a minute; by rounds over all levels these took many."""
    began = time.time()
    out = f()
    assert time.time() - began < 60
    return out


def test_betweenness_of_a_long_ring(spark):
    n = 601
    rows = quick(lambda: G.betweenness(ring(spark, n)).collect())
    assert len(rows) == n and all(abs(r["betweenness"] - 300 * 299 / 2) < 1e-6 for r in rows)


def test_betweenness_beyond_a_task(spark, monkeypatch):
    """Components of over LOCAL edges go by rounds, with the same sums; so do samples of sources."""
    rng = random.Random(3)
    e = spark.createDataFrame([*((rng.randrange(20), rng.randrange(20)) for _ in range(30)), (50, 51), (51, 52), (60, 60)], "src long, dst long")
    some = spark.createDataFrame([(0,), (50,), (99,)], "node long")
    ends = lambda: [{r[0]: [round(x, 9) for x in r[1:]] for r in df.collect()} for df in (G.betweenness(e), G.betweenness(e, some), G.closeness(e), G.closeness(e, some, "out"), G.diameter(e, exact=True))]
    in_tasks = ends()
    monkeypatch.setattr(G.allpairs, "LOCAL", 3)
    monkeypatch.setattr(G, "MERGED", 2)
    assert ends() == in_tasks
    monkeypatch.setattr(G.allpairs, "LOCAL", 4_000_000)
    monkeypatch.setattr(G.allpairs, "WORK", 20)
    monkeypatch.setattr(G.allpairs, "BLOCK", 40)
    assert ends() == in_tasks


def test_diameter_of_a_long_ring(spark):
    assert tuple(quick(lambda: G.diameter(ring(spark, 601), exact=True).first())) == (300, 300)


def test_closeness_of_a_long_ring(spark):
    rows = quick(lambda: G.closeness(ring(spark, 601)).collect())
    assert len(rows) == 601 and all(abs(r["closeness"] - 600 / (300 * 301)) < 1e-12 for r in rows)


def test_lateral_aggregate_joins_by_key(spark, tmp_path):
    """The subquery's comparison was a nested loop over all pairs of customers and orders."""
    c = spark.createDataFrame([(1, 10.0), (1, 10.0), (2, None), (3, float("nan")), (None, 1.0), (4, -5.0)], "c_custkey long, c_acctbal double")
    o = spark.createDataFrame([(1, 101.0), (1, 99.0), (1, 300.0), (2, 5.0), (3, 5.0), (4, -49.0), (None, 7.0)], "o_custkey long, o_totalprice double")
    c.write.parquet(f"{tmp_path}/customer.parquet")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    df = all_queries()["lateral_aggregate"](spark, str(tmp_path))
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, 2, 300.0), (1, 2, 300.0), (2, 0, None), (3, 0, None), (None, 0, None), (4, 1, -49.0)], key=str)


def test_otlp_requests_are_bounded(spark, folder, monkeypatch):
    """All events of a type were one row of JSON, which grew with the input."""
    monkeypatch.setattr(wires, "REQUEST", 50)
    t = Tables(spark, folder)
    kinds = {}
    for batch in ("resourceSpans", "resourceMetrics"):
        path = wires._otlp(t, batch, "scopes", "items", F.struct("event_id"))
        found = spark.read.text(path).select(F.regexp_count("value", F.lit('"event_id"')).alias("n")).agg(F.max("n"), F.sum("n")).first()
        kinds[batch] = (found[0] <= 50, found[1])
    assert set(kinds.values()) == {(True, t.events.count())}


def test_daily_sketches_are_exact(spark, tmp_path):
    """HyperLogLog estimates missed the count of many users."""
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") % 7) * 86400)
    e = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, (F.col("id") * 7919) % 40_000).alias("user_id"), ts.alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_type"]: (r["users"], r["days"]) for r in all_queries()["continuous_aggregate_sketches"](spark, str(tmp_path)).collect()}
    want = {r[0]: (r[1], r[2]) for r in e.groupBy("event_type").agg(F.count_distinct("user_id"), F.count_distinct(F.to_date("ts"))).collect()}
    assert got == want


def test_borders_are_covered(spark):
    """Points on a border were left out, and those within rounding of it, where SQL's BETWEEN has them exactly."""
    at = [(-30.0, 0.0, True), (60.0, 35.0, True), (5.0, 10.0, True), (5.0, 5.0, False), (60.0, 35.00000000000001, False), (-30.000000000000004, 1.0, False), (1.0, 34.99999999999999, True)]
    d = spark.createDataFrame(at, "lng double, lat double, held boolean")
    rows = d.select("held", spatial.st_covers(F.lit(spatials.BOX), "lng", "lat").alias("got"), spatial.st_holds(F.lit(spatials.BOX), "lng", "lat").alias("strict")).collect()
    assert [r["got"] for r in rows] == [r["held"] for r in rows]
    assert [r["strict"] for r in rows] == [False] * len(rows)


def test_region_join_has_borders(spark):
    p = spark.createDataFrame([(0.0, 0.0), (30.0, 20.0), (30.000000000000004, 20.0), (10.0, 5.0)], "lng double, lat double")
    r = spark.createDataFrame([("POLYGON((0 0, 30 0, 30 20, 0 20, 0 0))",)], "shape string")
    assert sorted((x["lng"], x["lat"]) for x in spatial.region_join(p, r, "shape", 10.0).collect()) == [(0.0, 0.0), (10.0, 5.0), (30.0, 20.0)]


def cloud(spark, n: int):
    """Vectors of nearly random directions, of which short codes know little, and the true five next to a query."""
    x, q = np.random.default_rng(11).normal(size=(n, 64)), np.random.default_rng(12).normal(size=64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    return df, q.tolist(), np.argsort(((x - q) ** 2).sum(1), kind="stable")[:5].tolist()


def test_balanced_product_search_is_whole(spark):
    """With one candidate a result, codes alone miss neighbours."""
    df, q, best = cloud(spark, 600)
    r = V.balanced_rotation(df, "v", 8, "id")
    turned = df.withColumn("t", V.rotated("v", r))
    books = V.product_codebooks(turned, "t", codes=4, key="id")
    coded = turned.withColumn("c", V.product_codes("t", books)).withColumn("e", V.product_errors("t", books))
    found = lambda **more: [x["id"] for x in V.product_topk(coded, "t", "c", books, (np.asarray(q) @ r).tolist(), 5, "id", 1, **more).collect()]
    assert found() != best and found(error="e") == best


def test_product_search_of_few_rows_is_whole(spark):
    df, q, best = cloud(spark, 600)
    books = V.product_codebooks(df, "v", codes=4, key="id")
    coded = df.withColumn("c", V.product_codes("v", books)).withColumn("e", V.product_errors("v", books))
    assert [x["id"] for x in V.product_topk(coded, "v", "c", books, q, 5, "id", 1, "e").collect()] == best
    assert V.product_topk(coded.filter("id < 3"), "v", "c", books, q, 5, "id", 1, "e").count() == 3


def test_sign_search_is_whole(spark):
    df, q, best = cloud(spark, 600)
    for r in (None, V.rotation(64)):
        rows = V.sign_codes(df, "v", np.zeros(64), r)
        assert [x["id"] for x in V.sign_topk(rows, "v", q, np.zeros(64), 5, "id", 1, r).collect()] == best


def uses(spark, tmp_path, monkeypatch, f) -> int:
    """How many of the tables that f(edges) writes, and its result, are made from the edges' own files."""
    path, seen = f"{tmp_path}/e", []
    spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 0.5)], "src long, dst long, weight double").write.parquet(path)
    real = G.written
    monkeypatch.setattr(G, "written", lambda df, name: (seen.append(df), real(df, name))[1])
    seen.append(f(spark.read.parquet(path)))
    return sum(any(x.startswith(f"file:{path}") or x.startswith(f"file://{path}") for x in df.inputFiles()) for df in seen)


def test_shortest_paths_make_edges_once(spark, tmp_path, monkeypatch):
    assert uses(spark, tmp_path, monkeypatch, lambda e: G.sssp(e, 0)) == 1


def test_sweeps_make_edges_once(spark, tmp_path, monkeypatch):
    assert uses(spark, tmp_path, monkeypatch, G.diameter) == 1
    t = spark.createDataFrame([(0,)], "node long")
    assert uses(spark, tmp_path / "two", monkeypatch, lambda e: G.bfs(e, t)) == 1


def test_estimates_are_apart_from_exact_counts(spark, folder):
    """One aggregation of both kept the estimate's registers for each key."""
    plan = all_queries()["estimate_count"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "approx_count_distinct" in x and "keys=[o_custkey" in x]


def test_hilbert_places_are_generated_code(spark):
    """A fold over the bits ran outside of generated code, a row's bits at a time."""
    rng = random.Random(5)
    rows = [(rng.randrange(1 << 16), rng.randrange(1 << 16)) for _ in range(200)]
    a = Array(spark.createDataFrame(rows, "x long, y long"), {"x": (0, (1 << 16) - 1), "y": (0, (1 << 16) - 1)}, [])

    def place(x, y, d=0):
        for k in range(15, -1, -1):
            size = 1 << k
            rx, ry = x >> k & 1, y >> k & 1
            d, x, y = d + size * size * ((3 * rx) ^ ry), x % size, y % size
            if ry == 0:
                x, y = (size - 1 - y, size - 1 - x) if rx else (y, x)
        return d

    df = a.cells.withColumn("h", a.hilbert(16))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert all(r["h"] == place(r["x"], r["y"]) for r in df.collect())


def test_clustering_makes_edges_once(spark, tmp_path, monkeypatch):
    assert uses(spark, tmp_path, monkeypatch, G.local_clustering) == 1


def test_triangles_are_found_without_rows_of_pairs(spark):
    """All pairs of an edge's higher neighbours were rows of a shuffle: here over 7,000 of them for one triangle."""
    e = spark.createDataFrame([*((i, 1000 + j) for i in range(30) for j in range(30)), (0, 1)], "src long, dst long")
    found = G._triangle_list(e)
    assert sorted({x for r in found.collect() for x in r}) == [0, 1, *range(1000, 1030)] and found.count() == 30
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_geohashes_are_read_by_batches(spark):
    """Each code's eight neighbours were made bit by bit; now a batch's at once, with the same results."""
    rng = random.Random(9)
    codes = ["".join(rng.choice(spatial._BASE32) for _ in range(n)) for n in (1, 2, 5, 5, 6, 9, 12, 13) for _ in range(20)] + ["00000", "bpbpb", "zzzzz", "pbpbp", None]
    d = spark.createDataFrame([(c,) for c in codes], "h string")
    rows = d.select("h", spatial.geohash_neighbors("h").alias("n"), spatial.geohash_decode("h").alias("p")).collect()
    for r in rows:
        if r["h"] is None:
            assert r["n"] is None
            continue
        w, s, e, n = spatial.geohash_bounds(r["h"])
        assert r["n"] == spatial._neighbors(r["h"]) and abs(r["p"]["lng"] - (w + e) / 2) < 1e-9 and abs(r["p"]["lat"] - (s + n) / 2) < 1e-9
    monkey = pd.Series(["u4pru"] * 50_000)
    began = time.time()
    assert len(spatial._by_size(monkey, spatial._around)) == 50_000
    assert time.time() - began < 2


def test_generated_ids_are_dealt_out(spark, folder):
    """Five distinct counts at once kept five of each row's identifiers in the task that made them."""
    df = all_queries()["generated_ids"](spark, folder)
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
    row = df.first().asDict()
    assert set(row.values()) == {row["n"]} and row["n"] == Tables(spark, folder).customer.count()


def test_near_pairs_are_dealt_out(spark, monkeypatch):
    """All pairs of a crowded cell were compared in one task."""
    monkeypatch.setattr(spatial, "PAIRS", 500)
    p = spark.range(300).select("id", (F.col("id") % 17 / 1000).alias("lng"), (F.col("id") % 13 / 1000).alias("lat"))
    o = spark.range(40).select(F.col("id").alias("other"), (F.col("id") % 7 / 1000).alias("lng2"), (F.col("id") % 5 / 1000).alias("lat2"))
    near = spatial.near_join(p, o, 800.0)
    want = p.crossJoin(o).filter(spatial.haversine("lng", "lat", "lng2", "lat2") <= 800.0).select("id", "other")
    got = near.withColumn("at", F.spark_partition_id()).select("id", "other", "at").collect()
    assert sorted((r["id"], r["other"]) for r in got) == sorted(map(tuple, want.collect())) and got
    sizes = Counter(r["at"] for r in got)
    assert max(sizes.values()) < len(got) / 4
