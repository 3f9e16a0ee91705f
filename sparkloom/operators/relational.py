"""Relational operators that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.shared import written


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """points with each range [low, high) that holds ``value``: an equi-join on bins of
    ``width``, so that no pair outside a bin is compared.  A range goes to every bin that it
    meets; choose a width near the usual range's."""
    bin_ = lambda c: F.floor(F.col(c) / F.lit(width))
    bins = ranges.filter(F.col(high) > F.col(low)).withColumn("_bin", F.explode(F.sequence(bin_(low), bin_(high))))
    joined = points.withColumn("_bin", bin_(value)).join(bins, "_bin").drop("_bin")
    return joined.filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high)))


def lateral_topk(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, order: list[Column], k: int, how: str = "inner") -> DataFrame:
    """Each outer row with its first k inner rows; Spark trims each key to k rows before the
    shuffle (WindowGroupLimit)."""
    best = inner.withColumn("_at", F.row_number().over(Window.partitionBy(inner_key).orderBy(*order))).filter(F.col("_at") <= k).drop("_at")
    return outer.join(best, F.col(outer_key) == F.col(inner_key), how)


def sub_groups(df: DataFrame, keys: list[str], more: list[str], count: str, total: str) -> DataFrame:
    """Counts by keys + more, and the counts of the keys alone beside them."""
    inner = df.groupBy(*keys, *more).agg(F.count("*").alias(count))
    return inner.withColumn(total, F.sum(count).over(Window.partitionBy(*keys)))


def balance_as_of(df: DataFrame, keys: list[str], amount: str, later: Column) -> DataFrame:
    """Current balance less what came later."""
    return df.groupBy(*keys).agg((F.sum(amount) - F.sum(F.when(later, F.col(amount)).otherwise(0.0))).alias("balance"))


def groups_frame(df: DataFrame, parts: list[str], order: list[Column], first: int, last: int, what: dict[str, Column]) -> DataFrame:
    """Aggregates over a GROUPS frame: peer groups numbered by dense_rank, then a RANGE frame
    over the numbers.  first, last: groups before (negative) and after."""
    df = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*parts).orderBy(*order)))
    frame = Window.partitionBy(*parts).orderBy("_group").rangeBetween(first, last)
    return df.withColumns({k: c.over(frame) for k, c in what.items()}).drop("_group")


def ntile_even(n: int, parts: list[str], order: list[Column]) -> Column:
    """floor(place * n / rows) + 1: tiles of even width, whereas SQL's ntile puts the
    remainder into the first tiles."""
    place = F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1
    return F.floor(place * n / F.count("*").over(Window.partitionBy(*parts))) + 1


def reachable(seed: DataFrame, edges: DataFrame, node: str, src: str, dst: str, most: int = 1000) -> DataFrame:
    """Distinct nodes reached from seed(node) over edges (UNION of a recursive query): each
    round joins the newest nodes alone, and is a table in the shared folder."""
    link = edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"))
    seen = frontier = written(seed.select(node).distinct(), "seed")
    for i in range(most):
        found = frontier.join(link, F.col(node) == F.col("_src")).select(F.col("_dst").alias(node)).distinct()
        frontier = written(found.join(seen, node, "left_anti"), f"hop{i}")
        if frontier.isEmpty():
            return seen
        seen = written(seen.unionByName(frontier), f"seen{i}")
    raise RuntimeError(f"no fixpoint within {most} rounds")


def facet_counts(df: DataFrame, fields: list[str], limit: int) -> DataFrame:
    """field, value, n: the most frequent values of each field, from one scan."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))
    best = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= limit).drop("_at")


def _uniform(df: DataFrame, keys: list[str], seed: int, n: int = 0) -> Column:
    """A number from (0, 1] that a row's key and the seed decide, wherever the row lies."""
    text = F.concat_ws("|", F.lit(f"{seed}.{n}"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys or df.columns))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1) * F.lit(2.0**-52)


def weighted_pick(df: DataFrame, weight: str, n: int, seed: int, replacement: bool = False, keys: list[str] | None = None) -> DataFrame:
    """n rows, likelier by weight; which, the hashes of their keys (all columns, if none are given)
    decide.  Without replacement: the n least of exponential variates over weights; rows of equal
    keys are picked together.  With: draws fall into ranges of cumulative weights within hash
    buckets, buckets drawn by their sums."""
    some = df.filter(F.col(weight) > 0)
    if not replacement:
        return some.withColumn("_draw", -F.log(_uniform(df, keys, seed)) / F.col(weight)).orderBy("_draw").limit(n).drop("_draw")
    spark = df.sparkSession
    upto = Window.partitionBy("_b").orderBy("_r")
    rows = written(some.withColumn("_r", _uniform(df, keys, seed)).withColumn("_b", F.floor(F.col("_r") * 256 * 4096) % 256), "weights")
    rows = rows.withColumn("_hi", F.sum(weight).over(upto)).withColumn("_lo", F.col("_hi") - F.col(weight))
    sums = rows.groupBy("_b").agg(F.max("_hi").alias("_sum"))
    ends = sums.withColumn("_end", F.sum("_sum").over(Window.orderBy("_b"))).withColumn("_start", F.col("_end") - F.col("_sum"))  # 256 rows
    total = ends.agg(F.max("_end")).first()[0]
    drawn = spark.range(n)
    draws = drawn.select((_uniform(drawn, ["id"], seed, 1) * F.lit(float(total or 0))).alias("_x"))
    placed = draws.join(F.broadcast(ends), (F.col("_x") > F.col("_start")) & (F.col("_x") <= F.col("_end"))).select("_b", (F.col("_x") - F.col("_start")).alias("_x"))
    hits = placed.withColumnRenamed("_b", "_c").join(rows, (F.col("_c") == F.col("_b")) & (F.col("_x") > F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
    return hits.select(*df.columns)


def _hashes(value: Column, width: int, depth: int) -> Column:
    """A counter in each of a count-min sketch's rows."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.struct(i.alias("row"), F.pmod(F.xxhash64(value, i), F.lit(width)).cast("int").alias("bucket"))))


def count_min(df: DataFrame, column: str, width: int = 2048, depth: int = 5, keys: list[str] | None = None) -> DataFrame:
    """A count-min sketch (row, bucket, n) of a column's values, or one for each of ``keys``.  No
    sketch has more than width * depth rows, and counts meet before the shuffle."""
    at = df.select(*(keys or []), _hashes(F.col(column).cast("string"), width, depth).alias("h"))
    return at.groupBy(*(keys or []), "h.row", "h.bucket").agg(F.count("*").alias("n"))


def count_min_merged(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("row", "bucket").agg(F.sum("n").alias("n"))


def count_min_estimates(sketch: DataFrame, values: DataFrame, width: int = 2048, depth: int = 5) -> DataFrame:
    """value, n of values(value): never under the true count, and over it by more than a width-th of
    all rows for a value in 2^depth, about."""
    at = values.select("value", _hashes(F.col("value").cast("string"), width, depth).alias("h")).select("value", "h.row", "h.bucket")
    return at.join(F.broadcast(sketch), ["row", "bucket"], "left").groupBy("value").agg(F.min(F.coalesce("n", F.lit(0).cast("long"))).alias("n"))  # width * depth rows
