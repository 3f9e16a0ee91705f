from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, h string, list int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "h", 1) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k):
    """The k greatest inner products, in double precision on the stored floats."""
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(v)]
    dims = {}
    for _, v in fine:
        dims[len(v)] = dims.get(len(v), 0) + 1
    d = max(dims, key=lambda n: (dims[n], -n))
    fine = [(i, v) for i, v in fine if len(v) == d]
    out = {}
    for q, v in fine:
        if q % 20 == 0:
            s = sorted(((-float(v @ x), i) for i, x in fine if i != q))[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


def found(spark, df, k, **more):
    out = {}
    for r in sorted(vectors.search(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), k, **more).collect()):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 32))
    rows = [(i, (centers[rng.integers(30)] + 0.4 * rng.normal(size=32)).tolist()) for i in range(3000)]
    got, want = found(spark, table(spark, rows), 20), brute(rows, 20)
    assert set(got) == set(want)
    hits = 0
    for q, w in want.items():
        assert len(got[q]) == 20
        scores = [s for _, s in got[q]]
        assert scores == sorted(scores, reverse=True)
        hits += len({i for i, _ in w} & {i for i, _ in got[q]})
    assert hits / (20 * len(want)) >= 0.9
    exact = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(s == pytest.approx(exact[q, i], rel=1e-12) for q, g in got.items() for i, s in g if (q, i) in exact)


def test_recall_on_the_real_table(spark):
    import duckdb

    path = "/root/testdata/sf0.1"
    got = {}
    for r in vectors.op4_nearest(spark, path).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}/embeddings.parquet' ORDER BY vec_id").fetchnumpy()
    ids, x = rows["vec_id"], np.stack([np.asarray(v, float) for v in rows["embedding"]])
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        s = x @ x[at]
        s[at] = -np.inf
        top = set(ids[np.argsort(-s)[:20]].tolist())
        hits, total = hits + len(top & got[ids[at]]), total + 20
    assert len(got) * 20 == total and hits / total >= 0.9


def test_packs_hold_whole_lists():
    assert vectors.packs(np.array([3, 3, 4, 0, 11, 2, 8, 1]), 10).tolist() == [0, 0, 0, 0, 1, 2, 2, 3]


def test_odd_vectors_ties_copies_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, []), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows += [(7, [1.0, 5.0]), (5, [1.0, 5.0]), (9, [-1.0, 0.0]), (160, [1.0, 0.0]), (3, [1.0, 0.0])]
    got = found(spark, table(spark, rows), 20)
    assert {q: [i for i, _ in g] for q, g in got.items()} == {0: [3, 5, 7, 160, 9], 160: [0, 3, 5, 7, 9]}
    assert got == {q: [(i, s) for i, s in w] for q, w in brute(rows, 20).items()}


def test_large_groups_of_copies(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(300)] + [(1000 + i, [float(i), 1.0, 0.0]) for i in range(50)]
    got, want = found(spark, table(spark, rows), 5), brute(rows, 5)
    assert got == want


def test_an_empty_table(spark):
    assert vectors.search(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []


def test_scan_abandons_few_true_neighbours():
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(40, 64)), rng.normal(size=(3000, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    s = q @ x.T
    got = {}
    for i, j, v in zip(*vectors.scan(q, x, rotation, 10), strict=True):
        assert v == pytest.approx(s[i, j])
        got.setdefault(i, set()).add(j)
    hits = sum(len(set(np.argsort(-s[i])[:10].tolist()) & got[i]) for i in range(40))
    assert hits >= 0.97 * 400
