"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Best fit decreasing takes groups by falling size and puts each into the bin with
the least room that still holds it.  Groups of one size go to one bin for as long
as it holds them, because it stays the tightest; so the packing depends only on how
many groups each size has.  The driver packs that histogram (sizes from 4096 bytes
up are rounded up by under 1/2048, so it has at most some tens of thousands of
classes, whatever the input), and executors look their groups up by rank within
the size class.  No table of groups comes to the driver.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


class RoomTree:
    """Balanced search tree (treap) of (room, bin); finds the tightest bin that fits."""

    def __init__(self) -> None:
        self.root = None
        self.rng = random.Random(7)

    def add(self, room: int, bin_: int) -> None:
        left, right = self._split(self.root, (room, bin_))
        self.root = self._merge(self._merge(left, [(room, bin_), self.rng.random(), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least (room, bin) with room >= size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        path, node = [], right
        while node[2] is not None:
            path.append(node)
            node = node[2]
        if path:
            path[-1][2] = node[3]
        else:
            right = node[3]
        self.root = self._merge(left, right)
        return node[0]

    def _split(self, node, key):
        """Trees of the keys below key and of the rest."""
        lo: list = [None, None, None, None]
        hi: list = [None, None, None, None]
        at_lo, at_hi = lo, hi
        while node is not None:
            if node[0] < key:
                at_lo[3] = node
                at_lo, node = node, node[3]
            else:
                at_hi[2] = node
                at_hi, node = node, node[2]
        at_lo[3] = None
        at_hi[2] = None
        return lo[3], hi[2]

    def _merge(self, a, b):
        top: list = [None, None, None, None]
        at, side = top, 3
        while a is not None and b is not None:
            if a[1] < b[1]:
                at[side] = a
                at, a, side = a, a[3], 3
            else:
                at[side] = b
                at, b, side = b, b[2], 2
        at[side] = a if a is not None else b
        return top[3]


def best_fit_decreasing(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Packs (size, count) classes into bins of ``capacity``.

    Returns runs (size, first, end, bin): of the groups of that size, those ranked
    first..end-1 go to bin.  None if a group exceeds capacity or over ``most`` bins
    would be needed."""
    tree, bins, runs = RoomTree(), 0, []
    for size, count in sorted(classes, reverse=True):
        if size > capacity:
            return None
        at = 0
        while at < count:
            found = tree.take(size)
            if found is None:
                if bins == most:
                    return None
                found = (capacity, bins)
                bins += 1
            room, bin_ = found
            n = min(count - at, room // size)
            runs.append((size, at, at + n, bin_))
            tree.add(room - n * size, bin_)
            at += n
    return runs


def least_capacity(classes: list[tuple[int, int]], shards: int, within: float = 1e-4) -> tuple[int, list]:
    """The least capacity (to a share ``within`` of the mean) at which best fit
    decreasing needs at most ``shards`` bins, and the packing."""
    total = sum(s * n for s, n in classes)
    low = max([-(-total // shards), 1, *(s for s, n in classes)])
    if (runs := best_fit_decreasing(classes, low, shards)) is not None:
        return low, runs
    step = max(1, int(low * within))
    gap = step
    while (runs := best_fit_decreasing(classes, low + gap, shards)) is None:
        gap *= 2
    high, low = low + gap, low + gap // 2
    while high - low > step:
        mid = (low + high) // 2
        if (tried := best_fit_decreasing(classes, mid, shards)) is None:
            low = mid
        else:
            high, runs = mid, tried
    return high, runs


def size_class(size):
    """The size, from 4096 up rounded up to 12 significant bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)))) - 11, F.lit(0))).cast("long")
    return (F.floor((size + step - 1) / step) * step).cast("long")


def shard(rows: DataFrame, group: str, size: str, key: str, shards: int) -> DataFrame:
    """Adds ``shard`` (0..shards-1) to rows(key, group, size, ..): rows of one group
    stay together and shards have near equal sums of ``size``.

    A group larger than a shard's fair share can't be indivisible without making
    shards unequal; it is cut into pieces of at most a fair share.  Rows of a group
    have equal sizes of at least 1.  Null groups are one group.  An empty table
    gives an empty table.  Repeated rows are rows of their own."""
    spark = rows.sparkSession
    groups = common.written(rows.groupBy(group).agg(F.count("*").alias("_n"), F.max(size).alias("_size")), "groups")
    n_groups, n_rows, total = groups.agg(F.count("*"), F.sum("_n"), F.sum(F.col("_n") * F.col("_size"))).first()
    n_rows, total = n_rows or 0, total or 0
    fair = max(1, -(-total // shards))
    heavy_if = (F.col("_n") * F.col("_size") > fair) | (F.col("_n") * shards > n_rows)
    heavy = [tuple(r) for r in groups.filter(heavy_if).select(group, "_n", "_size").collect()]  # at most 2 * shards rows
    light = groups.filter(~heavy_if).select(group, "_n", size_class(F.col("_n") * F.col("_size")).alias("_class"))
    classes = [(r[0], r[1]) for r in light.groupBy("_class").count().collect()]  # bounded, see above
    pieces = []  # (group, piece, rows a piece, size)
    for g, n, s in heavy:
        k = min(n, max(1, fair // s))
        pieces += [(g, i, k, s * min(k, n - i * k)) for i in range(-(-n // k))]
    have: dict[int, int] = dict(classes)
    of_piece = []
    for g, i, k, s in pieces:  # pieces are ranked after the light groups of their size
        of_piece.append((g, i, k, s, have.get(s, 0)))
        have[s] = have.get(s, 0) + 1
    _, runs = least_capacity(sorted(have.items()), shards) if have else (1, [])
    by_class: dict[int, list] = {}
    for run in runs:
        by_class.setdefault(run[0], []).append(run)
    where = lambda s, rank: next(b for _, a, z, b in by_class[s] if a <= rank < z)
    kind = rows.schema[group].dataType
    placed = spark.createDataFrame([(g, i, k, where(s, r)) for g, i, k, s, r in of_piece], T.StructType([T.StructField(group, kind), T.StructField("_piece", T.LongType()), T.StructField("_k", T.LongType()), T.StructField("shard", T.IntegerType())]))
    run_rows = spark.createDataFrame(runs, "_run long, _lo long, _hi long, shard int")

    ranked = common.two_level_rank(light, ["_class"], F.col(group), [F.xxhash64(group), F.col(group)], n_groups, "_rank")
    inside = (F.col("_class") == F.col("_run")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    light = ranked.join(F.broadcast(run_rows), inside).select(F.col(group).alias("_g"), "shard")  # a row for each class and bin it meets: bounded

    hot = F.broadcast(placed.groupBy(F.col(group).alias("_g")).agg(F.first("_k").alias("_k")))
    rows = rows.join(hot, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    cold = rows.filter(F.col("_k").isNull()).drop("_k")
    cold = cold.join(light, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    warm = rows.filter(F.col("_k").isNotNull())
    warm = common.two_level_rank(warm, [group], F.col(key), [F.xxhash64(key), F.col(key)], n_rows, "_rank")
    warm = warm.withColumn("_at", F.floor(F.col("_rank") / F.col("_k")).cast("long")).drop("_rank", "_k")
    places = F.broadcast(placed.select(F.col(group).alias("_g"), "_piece", "shard"))
    warm = warm.join(places, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_at") == F.col("_piece"))).drop("_g", "_at", "_piece")
    return cold.unionByName(warm)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    A null text counts as empty (16 bytes, crc 0) and groups with empty texts.  Null
    and repeated doc_ids are rows like others; slots follow hashes of doc_id and text.  A very
    long text is a group like others.  An empty table gives an empty one.  Other columns are not
    read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    placed = common.written(shard(rows, "digest", "size", "doc_id", shards).select("doc_id", "size", "text_crc32", "shard"), "placed")
    n = placed.count()
    out = common.two_level_rank(placed, ["shard"], F.struct("doc_id", "text_crc32"), [F.xxhash64("doc_id", "text_crc32"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], n, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.read(spark, sf_dir, "documents"))
