"""Graph queries over the parts, which grow with the input, against brute force."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import pytest

from sparkloom.plans import all_queries, graphs

QUERIES = all_queries()


class Tables:
    def __init__(self, spark, folder):
        self.lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")


@pytest.fixture(scope="module")
def edges(spark, folder):
    return [(r["src"], r["dst"], float(r["weight"])) for r in graphs.parts(Tables(spark, folder)).collect()]


@pytest.fixture(scope="module")
def both(edges):
    out = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def test_components_and_shortest_paths(spark, folder, edges, both):
    root: dict = {}
    for n in sorted({x for a, b, _ in edges for x in (a, b)}):
        todo = [] if n in root else [n]
        while todo:
            m = todo.pop()
            if m not in root:
                root[m] = n
                todo += both[m]
    assert dict(map(tuple, QUERIES["graph_components_parts"](spark, folder).collect())) == root
    out, far, heap = defaultdict(list), {}, [(0.0, 7)]
    for a, b, w in edges:
        out[a].append((b, w))
    while heap:
        d, n = heapq.heappop(heap)
        if n not in far:
            far[n] = d
            for m, w in out[n]:
                heapq.heappush(heap, (d + w, m))
    got = dict(map(tuple, QUERIES["graph_sssp_parts"](spark, folder).collect()))
    assert got.keys() == far.keys() and all(abs(got[n] - d) < 1e-5 for n, d in far.items())


def test_communities(spark, folder, both):
    label = {n: n for n in both}
    for _ in range(10):
        label = {n: min((-c, x) for x, c in Counter(label[m] for m in both[n]).items())[1] for n in both}
    assert dict(map(tuple, QUERIES["graph_label_propagation_parts"](spark, folder).collect())) == label
    found = dict(map(tuple, QUERIES["graph_louvain_parts"](spark, folder).collect()))
    assert found.keys() == both.keys()
    assert len(set(found.values())) < len(both)
