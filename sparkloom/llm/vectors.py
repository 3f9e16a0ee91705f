"""Approximate nearest neighbours by inner product: adaptive dimension scans in lists.

Fit (on a bounded sample): a random rotation, k-means centroids, and how many lists a
query must probe for the recall asked for, measured on the sample.  Every vector is
indexed.  In a probed list, rotated vectors are read in column blocks: after each
block, what the remaining dimensions can add to an inner product is, for random
directions, near normal with deviation |q rest| |x rest| / sqrt(rest); a candidate
whose partial product plus Z deviations (or the Cauchy-Schwarz bound, if less) stays
below the query's worst result so far is abandoned.  Survivors' scores are computed in
double precision on the original vectors.

Equal vectors are one candidate with its least ids, and equal queries one query, so
groups of copies cost nothing extra.  Lists are packed, and a large list cut, into cells of
about CELL candidates and QUERIES queries: a query goes once to a cell, however many of its
lists it probes, and no task holds a large list.

What a search costs follows the vectors: where they cluster, a query probes few lists.
Where directions are nearly random, as in the test data, neighbours lie in very many
lists, and the share of the candidates that a recall takes hardly falls with their number
(figures in the README); scanning then grows with queries times candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CELL = 4096
QUERIES = 1024
#: Candidates in the lists that a query probes first, for a score that others must reach; at least
#: so many are met.
FIRST = 640
BLOCK = 16
#: Deviations of the hypothesis test.
Z = 3.0


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    #: Mean length of each list's vectors.
    length: np.ndarray
    probes: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def order(self, q: np.ndarray) -> np.ndarray:
        return _order(q, self.centroids * self.length[:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(x: np.ndarray, centroids: np.ndarray, rows: int = 1024) -> np.ndarray:
    """The nearest centroid of each row, a block of rows at a time."""
    unit = _unit(x)
    return np.concatenate([np.argmax(unit[i : i + rows] @ centroids.T, axis=1) for i in range(0, len(x), rows)]).astype(np.int32)


def _order(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argsort(-(_unit(x) @ centroids.T), axis=1, kind="stable").astype(np.int32)


def fit(sample: np.ndarray, lists: int, k: int, recall: float, seed: int = 3) -> Index:
    """From sample (its rows are at most some ten thousand): spherical k-means, and the fewest probes
    whose measured recall of the k nearest, within the sample, is ``recall``."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    unit = _unit(sample)
    lists = max(1, min(lists, len(sample)))
    c = unit[rng.choice(len(unit), lists, replace=False)]
    for _ in range(6):
        at = _nearest(unit, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    at = _nearest(unit, c)
    # a list of long vectors is worth more to an inner product
    counts = np.maximum(np.bincount(at, minlength=lists), 1)
    length = np.bincount(at, np.linalg.norm(sample, axis=1), minlength=lists) / counts
    length = np.where(length > 0, length, length[length > 0].mean())
    q = rng.choice(len(sample), min(200, len(sample)), replace=False)
    s = sample[q] @ sample.T
    s[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-s, axis=1)[:, : min(k, len(sample) - 1)]
    order = np.argsort(_order(sample[q], c * length[:, None]), axis=1)  # the place of each list in a query's order
    need = np.sort(np.take_along_axis(order, at[top], axis=1).ravel())
    probes = lists if not need.size else int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1
    return Index(rotation, c, length, min(lists, probes))


def scan(q: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray | None = None, chunk: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, candidate rows and scores of about the k best candidates of each query; floor:
    scores that count at least, one a query."""
    d = q.shape[1]
    qr, xr = q @ rotation, x @ rotation
    cuts = list(range(0, d, BLOCK)) + [d]
    rest = lambda m: np.sqrt(np.maximum(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1], 0.0))
    q_rest, x_rest = rest(qr), rest(xr)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    best = np.full((len(q), k), -np.inf)
    kept_at: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(x), chunk):
        part = xr[at : at + chunk]
        worst = np.maximum(best.min(axis=1), floor)
        partial = qr[:, : cuts[1]] @ part[:, : cuts[1]].T
        qi, xi = np.nonzero(np.ones_like(partial, bool)) if len(cuts) == 2 else np.nonzero(partial + _bound(q_rest[:, None, cuts[1]], x_rest[None, at : at + chunk, cuts[1]], d - cuts[1]) >= worst[:, None])
        p = partial[qi, xi]
        for a, b in zip(cuts[1:-1], cuts[2:], strict=True):
            p = p + np.einsum("ij,ij->i", qr[qi, a:b], part[xi, a:b])
            if b < d:
                go = p + _bound(q_rest[qi, b], x_rest[at + xi, b], d - b) >= worst[qi]
                qi, xi, p = qi[go], xi[go], p[go]
        score = np.einsum("ij,ij->i", q[qi], x[at + xi])
        go = score >= worst[qi]
        qi, xi, score = qi[go], xi[go], score[go]
        for old, new in zip(kept_at, (qi, at + xi, score), strict=True):
            old.append(new)
        # the k best scores of each query so far
        order = np.lexsort((-score, qi))
        row, first = np.unique(qi[order], return_index=True)
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        few = place < k
        more = np.full((len(q), k), -np.inf)
        more[qi[order][few], place[few]] = score[order][few]
        best = -np.partition(-np.concatenate([best, more], axis=1), k - 1, axis=1)[:, :k]
    qi, xi, score = (np.concatenate(a) if a else np.empty(0, np.int64) for a in kept_at)
    go = score >= np.maximum(best.min(axis=1), floor)[qi] if len(qi) else np.zeros(0, bool)
    return qi[go], xi[go], score[go]


def packs(sizes: np.ndarray, most: int) -> np.ndarray:
    """The pack of each list: lists in turn while they hold ``most`` vectors together at most; a
    larger list is a pack of its own."""
    out, at, held = [], 0, 0
    for n in sizes.tolist():
        if held and held + n > most:
            at, held = at + 1, 0
        out.append(at)
        held += n
    return np.array(out)


def scan_lists(q: np.ndarray, at: np.ndarray, asked: np.ndarray, x: np.ndarray, own: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, candidate rows and scores of about the k best candidates of each query q in the
    lists that it probes: asked[i] by query at[i]; own: each candidate's list."""
    by_q, by_x = np.argsort(asked, kind="stable"), np.argsort(own, kind="stable")
    asked, own = asked[by_q], own[by_x]
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    floor = floor.copy()
    for name in np.unique(own).tolist():
        qi = at[by_q[np.searchsorted(asked, name) : np.searchsorted(asked, name, "right")]]
        xi = by_x[np.searchsorted(own, name) : np.searchsorted(own, name, "right")]
        if len(qi):
            rows, cols, scores = scan(q[qi], x[xi], rotation, k, floor[qi])
            for o, v in zip(out, (qi[rows], xi[cols], scores), strict=True):
                o.append(v)
    return tuple(np.concatenate(o) for o in out)


def _bound(q_rest: np.ndarray, x_rest: np.ndarray, left: int) -> np.ndarray:
    return q_rest * x_rest * min(1.0, Z / np.sqrt(left))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col]) if len(col) else np.empty((0, 1))


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = 0.95, sample: int = 20_000, max_lists: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query.

    vectors(vec_id, embedding); a vector that is null, zero, empty, of another length than
    most, or that holds null or non-finite components takes no part, nor does a null
    vec_id.  Rows that repeat a vec_id are candidates of their own, but not of that id's
    query.  Ties in score go to the smaller vec_id.  Other columns aren't read, whatever their
    names.  The sample is the ``sample`` vectors of the least hash; the number of lists is about
    four times the square root of the number of distinct vectors, 64 at least, max_lists and a
    fifth of the sample at most.  A query meets FIRST candidates at least, if there
    are so many.  An empty table gives an empty table."""
    spark = vectors.sparkSession
    common.bounded_batches(spark)
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select("vec_id", v.alias("v"), F.size(v).alias("d"), is_query.alias("q")).filter(F.col("vec_id").isNotNull() & fine)
    dims = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    # hash of a vector: equal vectors (0.0 and -0.0 are made equal) have equal keys; the key is the vector itself
    rows = rows.filter(F.col("d") == dims["d"]).select("vec_id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v"), "q")
    rows = rows.withColumn("h", F.sha2(F.concat_ws(",", F.transform("v", lambda c: c.cast("string"))), 256))
    rows = common.written(rows, "vectors")
    # of each distinct vector the k + 1 least ids: enough for any query, itself left out
    by_id = Window.partitionBy("h").orderBy("vec_id")
    ids = rows.select("h", "vec_id").withColumn("_at", F.row_number().over(by_id)).filter(F.col("_at") <= k + 1)
    ids = ids.groupBy("h").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    flags = rows.groupBy("h").agg(F.max("q").alias("q"), F.count("*").alias("n"), F.first("v").alias("v"))
    nodes = common.written(flags.join(ids, "h"), "distinct")
    n = nodes.count()
    picked = nodes.orderBy("h").limit(sample).select("v").toPandas()["v"]  # the documented sample
    lists = int(min(max_lists, max(64, round(4 * n**0.5))))
    # a list needs some vectors in the sample
    index = fit(_matrix(picked), min(lists, max(1, len(picked) // 5)), k, recall)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if len(x):
                yield pd.DataFrame({"h": x["h"], "list": index.assign(_matrix(x["v"]))})

    listed = common.written(nodes.select("h", "v").mapInPandas(place, "h string, list int"), "lists")
    counts = dict(listed.groupBy("list").count().collect())  # a row for each list: at most max_lists
    sizes = np.array([counts.get(i, 0) for i in range(len(index.centroids))])
    pack = packs(sizes, CELL)
    held_by = np.bincount(pack, sizes, minlength=pack.max() + 1)
    cells = np.maximum(1, -(-held_by // CELL)).astype(int)
    first = min(max(FIRST, k + 1), n)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if not len(x):
                continue
            order = index.order(_matrix(x["v"]))
            met = np.cumsum(sizes[order], axis=1)
            near = (met < first).sum(axis=1) + 1
            probed = np.maximum(near, index.probes)
            out = []
            for h, o, e, s in zip(x["h"], order, probed, near, strict=True):
                for begins, some in ((True, o[:s]), (False, o[s:e])):
                    some = some[sizes[some] > 0]
                    out += [(h, int(p), begins, some[pack[some] == p]) for p in np.unique(pack[some])]
            yield pd.DataFrame(out, columns=["h", "pack", "begins", "lists"])

    probes = common.written(nodes.filter("q").select("h", "v").mapInPandas(probe, "h string, pack int, begins boolean, lists array<int>"), "probes")
    loads = {(r["pack"], r["begins"]): r["count"] for r in probes.groupBy("pack", "begins").count().collect()}
    full = nodes.select("h", "v")
    of_list = spark.createDataFrame([(i, int(p)) for i, p in enumerate(pack)], "list int, pack int")
    columns = ["pack", "cell", "share", "h", "v", "floor", "own", "lists"]
    held = listed.join(F.broadcast(of_list), "list").join(full, "h").withColumns({"floor": F.lit(None).cast("double"), "own": F.col("list"), "lists": F.lit(None).cast("array<int>")})

    def meet(x: pd.DataFrame) -> pd.DataFrame:
        is_q = x["own"].isna().to_numpy()
        if not is_q.any() or is_q.all():
            return pd.DataFrame({"qh": np.empty(0, object), "h": np.empty(0, object), "score": np.empty(0)})
        q, c = x[is_q], x[~is_q]
        asked = q["lists"].to_numpy()
        at = np.repeat(np.arange(len(q)), [len(a) for a in asked])
        found = scan_lists(_matrix(q["v"]), at, np.concatenate(asked), _matrix(c["v"]), c["own"].to_numpy(np.int64), index.rotation, k + 1, q["floor"].to_numpy(np.float64))
        rows_, cols, scores = found
        return pd.DataFrame({"qh": q["h"].to_numpy()[rows_], "h": c["h"].to_numpy()[cols], "score": scores})

    def searched(begins: bool, floors: DataFrame | None, name: str) -> DataFrame:
        """The best of what the queries meet in the lists that they probe first, or in the rest."""
        shares = [max(1, -(-loads.get((p, begins), 0) // QUERIES)) for p in range(len(cells))]
        table = F.broadcast(spark.createDataFrame([(p, int(c), s) for p, (c, s) in enumerate(zip(cells, shares, strict=True))], "pack int, cells int, shares int"))
        spread = lambda n: F.pmod(F.xxhash64("h", F.lit(5)), F.col(n)).cast("int")
        copied = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = probes.filter(F.col("begins") == begins).drop("begins")
        own = own.join(floors, "h", "left") if floors is not None else own.withColumn("floor", F.lit(None).cast("double"))
        own = own.join(table, "pack").join(full, "h").withColumns({"floor": F.coalesce("floor", F.lit(float("-inf"))), "own": F.lit(None).cast("int"), "share": spread("shares"), "cell": copied("cells")})
        there = held.join(table, "pack").withColumn("cell", spread("cells")).withColumn("share", copied("shares"))
        met = there.select(*columns).unionByName(own.select(*columns)).groupBy("pack", "cell", "share").applyInPandas(meet, "qh string, h string, score double")
        best = F.rank().over(Window.partitionBy("qh").orderBy(F.desc("score")))
        return common.written(met.withColumn("_at", best).filter(F.col("_at") <= k + 1).drop("_at"), name)

    # the nearest lists first: the score that a query has k + 1 candidates from is what others must reach
    near = searched(True, None, "near")
    floors = near.groupBy(F.col("qh").alias("h")).agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("floor"))
    rest = searched(False, floors, "rest")
    heads = nodes.select("h", "ids", F.col("ids")[0].alias("first"))
    at = F.rank().over(Window.partitionBy("qh").orderBy(F.desc("score"), "first"))
    top = near.unionByName(rest).join(heads, "h").withColumn("_at", at).filter(F.col("_at") <= k + 1)
    top = top.groupBy("qh").agg(F.collect_list(F.struct("ids", "score")).alias("hits"))  # k + 1, or more where scores and ids tie
    # queries that share a vector share its results, but for themselves; a vector may have very many
    queries = rows.filter("q").select(F.col("vec_id").alias("query_id"), F.col("h").alias("qh"))
    counts = queries.groupBy("qh").agg(F.count("*").alias("n"))
    top = common.written(top.join(counts, "qh"), "met")
    asked = top.agg(F.sum("n")).first()[0] or 0
    out = common.salted_join(queries, top, "qh", "n", asked, F.col("query_id")).select("query_id", F.explode("hits").alias("hit"))
    out = out.select("query_id", F.explode("hit.ids").alias("vec_id"), F.col("hit.score").alias("score")).filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
