"""Graph algorithms against brute force on random graphs."""

from __future__ import annotations

import itertools
import random
from collections import Counter, deque

import pytest

from sparkloom.operators import graph as G
from sparkloom.operators.match import match, parse_patterns


def random_edges(seed=1, n=24, m=40):
    rng = random.Random(seed)
    out = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return sorted((a, b) for a, b in out) + [(100, 101), (101, 102), (100, 102), (7, 7)]


EDGES = random_edges()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, "x") for a, b in EDGES], "src long, dst long, label string").repartition(3)


def undirected():
    adj = {}
    for a, b in EDGES:
        adj.setdefault(a, set())
        adj.setdefault(b, set())
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def distances(adj, s):
    d, paths, todo = {s: 0}, {s: 1}, deque([s])
    while todo:
        u = todo.popleft()
        for v in adj[u]:
            if v not in d:
                d[v], paths[v] = d[u] + 1, 0
                todo.append(v)
            if d[v] == d[u] + 1:
                paths[v] += paths[u]
    return d, paths


def table(df, *cols):
    return {r[0]: (r[1] if len(cols) < 3 else tuple(r[1:])) for r in df.select(*cols).collect()}


def test_traversals(spark, edges):
    out = {}
    for a, b in EDGES:
        out.setdefault(a, set()).add(b)
    s = EDGES[0][0]
    d, frontier = {s: 0}, {s}
    for k in (1, 2):
        frontier = {b for a in frontier for b in out.get(a, ())} - set(d)
        d |= dict.fromkeys(frontier, k)
    seed = spark.createDataFrame([(s,)], "node long")
    assert table(G.bfs(edges, seed, 2), "node", "depth") == d
    inside = set(d)
    assert Counter((r["src"], r["dst"]) for r in G.subgraph(edges, seed, 2).collect()) == Counter((a, b) for a, b in EDGES if a in inside and b in inside)
    assert G.shortest_path(edges, s, s).first()["length"] == 0
    assert G.shortest_path(edges, 100, s).collect() == []


def test_shortest_paths_are_shortest(edges):
    adj = undirected()
    both = G.directed(edges.select("src", "dst"), "both")
    d, _ = distances(adj, EDGES[0][0])
    for goal in sorted(d)[:4]:
        r = G.shortest_path(both, EDGES[0][0], goal).first()
        assert r["length"] == d[goal] and all(b in adj[a] for a, b in itertools.pairwise(r["path"]))


def test_components(edges):
    adj = undirected()
    want = {s: min(distances(adj, s)[0]) for s in adj}
    assert table(G.components(edges), "node", "component") == want


def test_pagerank_sums_to_one_and_equals_power_iteration(edges):
    links = set(EDGES)
    nodes = sorted(undirected())
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    out = Counter(a for a, _ in links)
    for _ in range(20):
        lost = sum(r for v, r in rank.items() if not out[v])
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * lost / len(nodes))
        for a, b in links:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    got = table(G.pagerank(edges, tolerance=0.0), "node", "rank")
    assert sum(got.values()) == pytest.approx(1)
    assert all(got[v] == pytest.approx(rank[v]) for v in nodes)


def test_triangles_clustering_and_cores(edges):
    adj = undirected()
    tri = {v: sum(1 for a, b in itertools.combinations(adj[v], 2) if b in adj[a]) for v in adj}
    assert table(G.triangles(edges), "node", "triangles") == tri
    lcc = table(G.local_clustering(edges), "node", "lcc")
    assert all(lcc[v] == pytest.approx(2 * tri[v] / (len(adj[v]) * (len(adj[v]) - 1)) if len(adj[v]) > 1 else 0) for v in adj)
    core, left, k = {}, {v: set(n) for v, n in adj.items()}, 0
    while left:
        low = [v for v in left if len(left[v]) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            core[v] = k
            for u in left.pop(v):
                if u in left:
                    left[u].discard(v)
    assert table(G.k_core(edges), "node", "core") == core


def test_centralities(edges):
    adj = undirected()
    between = dict.fromkeys(adj, 0.0)
    d = {s: distances(adj, s) for s in adj}
    for s, t in itertools.combinations(sorted(adj), 2):
        if t in d[s][0]:
            for v in adj:
                if v not in (s, t) and v in d[s][0] and d[s][0][v] + d[v][0].get(t, 10**6) == d[s][0][t]:
                    between[v] += d[s][1][v] * d[v][1][t] / d[s][1][t]
    got = table(G.betweenness(edges), "node", "betweenness")
    assert all(got[v] == pytest.approx(between[v]) for v in adj)
    close = table(G.closeness(edges), "node", "closeness", "harmonic")
    for s in adj:
        ds = d[s][0]
        assert close[s] == (pytest.approx((len(ds) - 1) / sum(ds.values()) if len(ds) > 1 else 0), pytest.approx(sum(1 / x for x in ds.values() if x)))
    assert G.diameter(edges, exact=True).first()["diameter"] == max(max(x.values()) for x, _ in d.values())
    assert G.diameter(edges).first()["diameter"] <= max(max(x.values()) for x, _ in d.values())


def test_weighted_paths(spark):
    rng = random.Random(4)
    rows = [(a, b, round(rng.random() * 9, 2)) for a in range(12) for b in range(12) if a != b and rng.random() < 0.25]
    best = {0: 0.0}
    for _ in range(20):
        for a, b, w in rows:
            if a in best:
                best[b] = min(best.get(b, 1e9), best[a] + w)
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    got = table(G.sssp(e, 0), "node", "distance")
    assert got.keys() == best.keys() and all(got[v] == pytest.approx(best[v]) for v in best)
    with pytest.raises(ValueError):
        G.sssp(spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, weight double"), 0)


def test_communities_of_two_cliques(spark):
    rows = [(a, b) for g in (range(5), range(10, 15)) for a, b in itertools.combinations(g, 2)] + [(4, 10)]
    e = spark.createDataFrame(rows, "src long, dst long")
    for f in (G.louvain, G.label_propagation):
        got = table(f(e), "node", "community")
        assert len({got[v] for v in range(5)}) == 1 and len({got[v] for v in range(10, 15)}) == 1
    split = G.louvain(e)
    assert G.modularity(e, split).first()["modularity"] == pytest.approx(0.4524, abs=0.01)
    assert table(split, "node", "community")[0] != table(split, "node", "community")[14]


def test_communities_of_named_nodes(spark):
    rows = [(f"n{a:02}", f"n{b:02}") for g in (range(5), range(10, 15)) for a, b in itertools.combinations(g, 2)] + [("n04", "n10")]
    e = spark.createDataFrame(rows, "src string, dst string")
    for f in (G.louvain, G.label_propagation):
        got = table(f(e), "node", "community")
        assert len({got[f"n{v:02}"] for v in range(5)}) == 1 and got["n00"] != got["n14"]


def test_patterns(spark):
    e = spark.createDataFrame([("a", "b", "knows"), ("b", "c", "knows"), ("c", "d", "likes"), ("d", "a", "knows"), ("a", "c", "likes")], "src string, dst string, label string")
    n = spark.createDataFrame([(x, "P" if x != "d" else "Q", i) for i, x in enumerate("abcd")], "id string, label string, age int")
    run = lambda q: sorted(map(tuple, match(e, q, n).collect()), key=repr)
    assert run("MATCH (x)-[:knows]->(y) RETURN x, y") == [("a", "b"), ("b", "c"), ("d", "a")]
    assert run("MATCH (x)-[r]->(y:Q) RETURN x.id AS x, r AS kind") == [("c", "likes")]
    assert run("MATCH (x)-[:knows*2..3]->(y) WHERE x.id = 'd' RETURN y") == [("b",), ("c",)]
    assert run("MATCH (x)-[:knows]->(y)-[:likes]->(z), (z)-[:knows]->(w) RETURN x, y, z, w") == [("b", "c", "d", "a")]
    assert run("MATCH (x)-[:knows]->(y) OPTIONAL MATCH (y)-[f:likes]->(z) RETURN x, z") == [("a", None), ("b", "d"), ("d", "c")]
    assert run("MATCH (x)-[:likes]->(y) WHERE y.age >= 3 RETURN x.age AS age") == [(2,)]
    assert run("MATCH (x)-[:knows]->(y) WHERE NOT EXISTS { MATCH (x)-[:likes]->(z) } RETURN x") == [("b",), ("d",)]
    assert run("MATCH (x)-[r]-(y) WHERE x.id = 'a' RETURN y, count(*) AS n ORDER BY n DESC, y LIMIT 2") == [("b", 1), ("c", 1)]
    with pytest.raises(ValueError):
        parse_patterns("(a)-[x]->")
