"""Results are whole however far a walk goes and however long a list is."""

from __future__ import annotations

import math
import random

import pytest

from sparkloom.functions import spatial
from sparkloom.operators import graph as G
from sparkloom.operators import search, vector
from sparkloom.operators.match import match, parse_patterns


def chain(spark, n):
    return spark.createDataFrame([(i, i + 1, "next", 1.0) for i in range(n)], "src long, dst long, label string, weight double")


def test_walks_go_to_their_end(spark, monkeypatch):
    monkeypatch.setattr(G, "MERGED", 4)
    e = chain(spark, 24)
    assert {r["node"]: r["distance"] for r in G.sssp(e, 0).collect()} == {i: float(i) for i in range(25)}
    seed = spark.createDataFrame([(0,)], "node long")
    assert sorted((r["node"], r["depth"]) for r in G.bfs(e, seed).collect()) == [(i, i) for i in range(25)]
    assert G.shortest_path(e, 0, 24).first()["length"] == 24
    assert G.diameter(e).first()["diameter"] == 24


def test_hops_of_a_pattern(spark):
    e = chain(spark, 14)
    reached = lambda hops, where: sorted(r["b"] for r in match(e, f"MATCH (a)-[:next{hops}]->(b) WHERE {where} RETURN DISTINCT a, b").collect())
    assert reached("*", "a.id = 0") == [1]
    assert reached("*2", "a.id = 0") == [2]
    assert reached("*3..", "a.id = 0") == list(range(3, 11))  # ten hops at most, as documented
    assert reached("*..3", "a.id = 0") == [1, 2, 3]
    assert reached("*0..1", "a.id = 4") == [4, 5]
    assert sorted(r["a"] for r in match(e, "MATCH (a)-[:next*2..4]->(b) WHERE b.id = 9 RETURN a").collect()) == [5, 6, 7]
    assert sorted(r["b"] for r in match(e, "MATCH (z)-[:next]->(a)-[:next*1..2]->(b) WHERE z.id = 3 OR z.id = 9 RETURN b").collect()) == [5, 6, 11, 12]
    with pytest.raises(ValueError):
        parse_patterns("(a)-[:next*3..2]->(b)")


def test_fusion_of_long_lists(spark):
    rng = random.Random(3)
    lists = [[(i, float(rng.randint(0, 50))) for i in rng.sample(range(3000), 2500)] for _ in range(2)]
    got = [(r["id"], r["rrf"]) for r in search.rrf([spark.createDataFrame(x, "id long, s double") for x in lists], "id", "s", 2600).collect()]
    want: dict[int, float] = {}
    for x in lists:
        for place, (i, _) in enumerate(sorted(x, key=lambda r: (-r[1], r[0])), 1):
            want[i] = want.get(i, 0.0) + 1 / (60 + place)
    best = sorted(want.items(), key=lambda r: (-r[1], r[0]))[:2600]
    assert [i for i, _ in got] == [i for i, _ in best] and all(a[1] == pytest.approx(b[1]) for a, b in zip(got, best, strict=True))


def test_graph_fusion_takes_all_that_is_reached(spark):
    star = spark.createDataFrame([(0, i, "l") for i in range(1, 3001)], "src long, dst long, label string")
    hits = spark.createDataFrame([(0, 1.0)], "id long, s double")
    assert G.graph_rag(hits, star, 1, 5000).count() == 3001


def test_every_query_vector_counts(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 4)
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(11)], "q int, qv array<double>")
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (1, [0.5, 0.0]), (2, [0.25, 1.0])], "doc int, v array<double>")
    assert [tuple(r) for r in vector.maxsim(queries, docs, "doc", "v", 10).collect()] == [(1, 11.0), (2, 2.75)]


@pytest.mark.parametrize("metres", [50_000.0, 2_000_000.0])
def test_near_join_reaches_the_poles(spark, metres):
    rng = random.Random(8)
    spots = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(60)]
    spots += [(rng.uniform(-180, 180), s * rng.uniform(84, 90)) for s in (-1, 1) for _ in range(60)] + [(0.0, 90.0), (120.0, 90.0), (180.0, 10.0), (-180.0, 10.0), (179.9, 10.1)]
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "i long, lng double, lat double")
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "j long, lng2 double, lat2 double")
    got = sorted((r["i"], r["j"]) for r in spatial.near_join(a, b, metres).collect())

    def apart(p, q):
        x, y, u, v = map(math.radians, (*p, *q))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * spatial.RADIUS * math.asin(min(1.0, math.sqrt(h)))

    assert got == [(i, j) for i, p in enumerate(spots) for j, q in enumerate(spots) if apart(p, q) <= metres]


def test_points_and_kinds_are_read_from_either_text(spark):
    texts = ["POINT(1.5 -2e-3)", '{"type":"Point","coordinates":[1.5,-0.002]}', " point ( 1.5  -0.002 )", "POLYGON((0 0, 4 0, 4 4, 0 0))", '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,1],[2.5,3e1]]}}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, g string")
    got = [tuple(r) for r in df.select(spatial.x_of("g"), spatial.y_of("g"), spatial.geometry_type("g"), spatial.num_points("g")).collect()]
    assert got == [(1.5, -0.002, "Point", 1)] * 3 + [(None, None, "Polygon", 4), (None, None, "LineString", 2), (None, None, None, None)]


def test_points_against_shapes_at_once(spark):
    shapes = ["POLYGON((0 0, 6 0, 6 6, 0 6, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))", "MULTIPOLYGON(((0 0, 2 0, 1 3, 0 0)), ((4 4, 6 4, 5 6, 4 4)))", "POINT(3 3)"]
    spots = [(x / 2, y / 2) for x in range(-1, 14) for y in range(-1, 14)]
    df = spark.createDataFrame([(s, *p) for s in shapes for p in spots] + [(None, 1.0, 1.0)], "s string, lng double, lat double")
    rows = df.select("s", "lng", "lat", spatial.st_holds("s", "lng", "lat").alias("a"), spatial.st_contains("s", spatial.point("lng", "lat")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(bool(r["a"]) for r in rows) > 50
