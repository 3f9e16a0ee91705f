"""Shortest paths from all nodes of components that fit one task, by NumPy over packed neighbour lists.

A component's sources are cut into slices, each of which meets the component's edges in one task, so
that a task holds one component's edges and a block of distances whatever the graph's size.  The work
is sources times edges of each component, as all pairs are: it is dealt out, not made smaller."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directed edges of a component that one task holds.
LOCAL = 4_000_000
#: Steps along an edge of a slice of sources.
WORK = 200_000_000
#: Sources times nodes whose distances are held at once.
BLOCK = 2_000_000
#: Most tasks that slices are dealt to.
TASKS = 4096


def dealt(edges: DataFrame, sources: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """edges(src, dst, c, slice, bucket), sources(source, c, slice, bucket) and the number of buckets; of: node,
    component.  Sources outside the graph are components of their own."""
    e = edges.join(of.select(F.col("node").alias("src"), F.col("component").alias("c")), "src")
    s = sources.select(F.col("node").alias("source")).distinct().join(of.withColumnsRenamed({"node": "source", "component": "c"}), "source", "left").withColumn("c", F.coalesce("c", "source"))
    size = e.groupBy("c").agg(F.count("*").alias("m")).join(s.groupBy("c").agg(F.count("*").alias("k")), "c", "right")
    m, k = F.coalesce("m", F.lit(0)), F.col("k")
    size = size.select("c", m.alias("m"), F.least(k, F.ceil(k * (m + 1) / WORK)).cast("int").alias("slices"))
    n, rows = size.agg(F.sum("slices"), F.sum(F.col("slices") * F.col("m"))).first()
    least = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(TASKS, max(least, int(n or 0) if (n or 0) < TASKS and (rows or 0) > (n or 0) * 1000 else 0, int(rows or 0) // 1_000_000))
    bucket = F.pmod(F.xxhash64("c", "slice"), F.lit(parts)).alias("bucket")
    size = size.select("c", "slices")
    e = e.join(size, "c").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("src", "dst", "c", "slice", bucket)
    s = s.join(size, "c").withColumn("slice", F.pmod(F.xxhash64("source"), F.col("slices")).cast("int")).select("source", "c", "slice", bucket)
    return e, s, parts


def swept(edges: DataFrame, sources: DataFrame, of: DataFrame, schema: str, shares: bool) -> DataFrame:
    """Without shares: source, reached, total, harmonic, far; with them node, got (dependencies of the slice's sources)."""
    e, s, parts = dealt(edges, sources, of)

    def run(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        own = {k: x for k, x in e.groupby(["c", "slice"], sort=False)}
        out = [(_shares if shares else _distances)(own.get(k), x["source"].to_numpy()) for k, x in s.groupby(["c", "slice"], sort=False)]
        names = ["node", "got"] if shares else ["source", "reached", "total", "harmonic", "far"]
        return pd.DataFrame({n: np.concatenate([o[i] for o in out]) if out else [] for i, n in enumerate(names)})

    return e.repartition(parts, "bucket").groupBy("bucket").cogroup(s.repartition(parts, "bucket").groupBy("bucket")).applyInPandas(run, schema)


def _packed(e: pd.DataFrame | None, sources: np.ndarray):
    """Names of the nodes, where each one's neighbours begin, the neighbours, and the sources' places."""
    if e is None:
        names = pd.unique(sources)
        return names, np.zeros(len(names) + 1, np.int64), np.zeros(0, np.int64), np.arange(len(names))
    codes, names = pd.factorize(np.concatenate([e["src"].to_numpy(), e["dst"].to_numpy(), sources]))
    a, b, s = codes[: len(e)], codes[len(e) : 2 * len(e)], codes[2 * len(e) :]
    order = np.argsort(a, kind="stable")
    return names, np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(names)))]), b[order], s


def _steps(start: np.ndarray, ends: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places (block row times n plus node): which of them each step leaves, and where it leads."""
    v = at % n
    d = start[v + 1] - start[v]
    which = np.repeat(np.arange(len(at)), d)
    place = np.arange(len(which)) - np.repeat(np.cumsum(d) - d, d) + np.repeat(start[v], d)
    return which, (at - v)[which] + ends[place]


def _levels(start, ends, s, n, paths: bool):
    """Places level by level from the sources s, and how many shortest paths lead to each."""
    at = np.arange(len(s)) * n + s
    seen = np.zeros(len(s) * n, bool)
    mark = np.zeros(len(s) * n, np.int64)
    count = np.zeros(len(s) * n) if paths else None
    seen[at] = True
    if paths:
        count[at] = 1.0
    out = [at]
    while len(at):
        which, to = _steps(start, ends, at, n)
        new = ~seen[to]
        which, to = which[new], to[new]
        if paths:
            np.add.at(count, to, count[at[which]])
        mark[to] = np.arange(len(to))
        at = to[mark[to] == np.arange(len(to))]  # each place once
        seen[at] = True
        if len(at):
            out.append(at)
    return out, count


def _blocks(s: np.ndarray, n: int):
    size = max(1, BLOCK // max(1, n))
    for i in range(0, len(s), size):
        yield i, s[i : i + size]


def _distances(e, sources):
    names, start, ends, s = _packed(e, sources)
    n, k = len(names), len(s)
    reached, total, far, harmonic = np.ones(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int32), np.zeros(k)
    for i, block in _blocks(s, n):
        own = slice(i, i + len(block))
        for depth, at in enumerate(_levels(start, ends, block, n, False)[0][1:], 1):
            c = np.bincount(at // n, minlength=len(block))
            reached[own] += c
            total[own] += c * depth
            harmonic[own] += c / depth
            far[own][c > 0] = depth
    return names[s], reached, total, harmonic, far


def _shares(e, sources):
    names, start, ends, s = _packed(e, sources)
    n = len(names)
    got = np.zeros(n)
    for _, block in _blocks(s, n):
        levels, count = _levels(start, ends, block, n, True)
        depth = np.full(len(block) * n, -1, np.int32)
        for d, at in enumerate(levels):
            depth[at] = d
        share = np.zeros(len(block) * n)
        for d in range(len(levels) - 2, 0, -1):  # from a level's places to those one deeper
            which, to = _steps(start, ends, levels[d], n)
            down = depth[to] == d + 1
            which, to = which[down], to[down]
            at = levels[d]
            share[at] = np.bincount(which, count[at[which]] / count[to] * (1 + share[to]), minlength=len(at))
        got += share.reshape(len(block), n).sum(0)
    return names, got
