"""Key-value tables as DataFrames (key, value.., expire_at) and the logs that change them.

A put is a row of a log, a state is the latest row of each key; increments and transfers are
sums of signed rows, which combine before they shuffle.  Jobs see a consistent snapshot; there
is no atomicity across jobs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.dml import newest


def state(log: DataFrame, key: str, order: list[str], deleted: Column | None = None) -> DataFrame:
    """The latest put of each key; a latest row that is a deletion takes the key away."""
    out = newest(log, [key], [F.desc(c) for c in order])
    return out if deleted is None else out.filter(~deleted)


def live(table: DataFrame, now: Column, expire_at: str = "expire_at") -> DataFrame:
    return table.filter(F.col(expire_at).isNull() | (F.col(expire_at) > now))


def ttl(table: DataFrame, now: Column, expire_at: str = "expire_at") -> Column:
    """Seconds that a row still lives; -1 without expiry, null once expired."""
    left = (F.unix_micros(F.col(expire_at).cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6
    return F.when(F.col(expire_at).isNull(), F.lit(-1.0)).when(left > 0, left)


def expire(table: DataFrame, where: Column, at: Column | None, expire_at: str = "expire_at") -> DataFrame:
    """EXPIRE, or PERSIST with at None."""
    new = F.lit(None).cast("timestamp_ntz") if at is None else at.cast("timestamp_ntz")
    return table.withColumn(expire_at, F.when(where, new).otherwise(F.col(expire_at)))


def get(table: DataFrame, key: str, *keys) -> DataFrame:
    return table.filter(F.col(key).isin(*keys))


def scan(table: DataFrame, key: str, pattern: str, after=None, count: int | None = None) -> DataFrame:
    """Keys that match a glob (* and ?), in order, after a cursor key."""
    rx = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
    out = table.filter(F.col(key).cast("string").rlike(rx))
    out = out if after is None else out.filter(F.col(key) > F.lit(after))
    return out if count is None else out.orderBy(key).limit(count)


def incremented(table: DataFrame, deltas: DataFrame, key: str, value: str, delta: str) -> DataFrame:
    """INCR: values plus the sum of each key's deltas; absent keys start from 0.  An overflow of
    a long is an error (ANSI mode)."""
    sums = deltas.groupBy(F.col(key).alias("_k")).agg(F.sum(delta).alias("_d"))
    j = table.join(sums, F.col(key).eqNullSafe(F.col("_k")), "full")
    new = (F.coalesce(F.col(value), F.lit(0)) + F.coalesce("_d", F.lit(0))).alias(value)
    return j.select(*(new if c == value else F.coalesce(key, "_k").alias(key) if c == key else F.col(c) for c in table.columns))


def compare_and_set(table: DataFrame, key: str, value: str, wants: DataFrame) -> DataFrame:
    """CAS: wants(key, expected, new) takes effect where the value is as expected."""
    w = wants.select(F.col(key).alias("_k"), "expected", "new")
    j = table.join(w, F.col(key).eqNullSafe(F.col("_k")), "left")
    hit = F.col("_k").isNotNull() & F.col(value).eqNullSafe(F.col("expected"))
    return j.select(*(F.when(hit, F.col("new")).otherwise(F.col(value)).alias(value) if c == value else F.col(c) for c in table.columns))


def transferred(table: DataFrame, moves: DataFrame, key: str, value: str) -> DataFrame:
    """moves(source, target, amount) as signed rows of a ledger: the sum of values stays."""
    rows = moves.select(F.explode(F.array(F.struct(F.col("source").alias(key), (-F.col("amount")).alias("_amount")), F.struct(F.col("target").alias(key), F.col("amount").alias("_amount")))).alias("r")).select("r.*")
    return incremented(table, rows, key, value, "_amount")


# Sorted indexes


def ranked(table: DataFrame, score: str, key: str, within: list[str] | None = None, descending: bool = True) -> DataFrame:
    """rank from 1 by score, ties by key.  Without ``within`` the whole index is one order: it is
    range-partitioned and places are offsets of partitions, so no task holds all of it."""
    order = [F.desc(score) if descending else F.asc(score), F.asc(key)]
    if within:
        return table.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))
    from sparkloom.shared import written

    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(table.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = sizes.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_part").withColumn("rank", (F.col("_before") + place).cast("long")).drop("_part", "_before")


def rank_of(table: DataFrame, score: str, key: str, who) -> DataFrame:
    """RANK: one key's place, by counting who stands before it; nothing is sorted."""
    own = table.filter(F.col(key) == F.lit(who)).select(F.col(score).alias("_s"), F.col(key).alias("_k"))
    j = table.join(F.broadcast(own.limit(1)))
    before = (F.col(score) > F.col("_s")) | ((F.col(score) == F.col("_s")) & (F.col(key) < F.col("_k")))
    return j.agg((F.count(F.when(before, 1)) + 1).alias("rank"))


def top(table: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return table.orderBy(F.desc(score), key).limit(k)


def score_range(table: DataFrame, score: str, low, high) -> DataFrame:
    return table.filter(F.col(score).between(low, high))


def leaderboard(events: DataFrame, ts: str, period: str, key: str, points: str, k: int) -> DataFrame:
    """The k best of each day, week or month."""
    sums = events.groupBy(F.date_trunc(period, ts).alias("period"), key).agg(F.sum(points).alias("score"))
    best = Window.partitionBy("period").orderBy(F.desc("score"), key)
    return sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rate_gate(events: DataFrame, ts: str, key: str, seconds: int, limit: int, order: str, reset: Column | None = None) -> DataFrame:
    """Fixed windows: each event with how many of its key's window remain after it, and whether
    it was allowed.  reset: rows that are resets; they count nothing, and counting begins anew after
    them."""
    from sparkloom.operators.timeseries import time_bucket

    w = Window.partitionBy(key, "window").orderBy(ts, order)
    out = events.withColumn("window", time_bucket(ts, seconds))
    if reset is None:
        out = out.withColumn("_n", F.row_number().over(w))
    else:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        counted = F.when(reset, 0).otherwise(1)
        out = out.withColumn("_era", F.sum(F.when(reset, 1).otherwise(0)).over(upto))
        out = out.withColumn("_n", F.sum(counted).over(Window.partitionBy(key, "window", "_era").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)).cast("int")).filter(~reset).drop("_era")
    return out.withColumn("allowed", F.col("_n") <= limit).withColumn("remaining", F.greatest(F.lit(0), limit - F.col("_n"))).drop("_n")


def fields_set(table: DataFrame, key: str, value: str, sets: DataFrame) -> DataFrame:
    """FIELD SET on JSON values: sets(key, fields: a map of name to JSON text or plain text) are merged into
    each key's value; absent keys get a value of those fields alone."""
    s = sets.select(F.col(key).alias("_k"), F.col("fields").alias("_f"))
    j = table.join(s, F.col(key).eqNullSafe(F.col("_k")), "full")
    old = F.coalesce(F.from_json(value, "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key("_f", k), F.lit(False))), F.col("_f")))
    return j.select(*(F.when(F.col("_f").isNotNull(), new).otherwise(F.col(value)).alias(value) if c == value else F.coalesce(key, "_k").alias(key) if c == key else F.col(c) for c in table.columns))
