"""Time series: buckets, gap filling, as-of joins, per-series functions, rollups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone (UTC), or of a long (ms)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def time_bucket(ts: Column | str, seconds: int) -> Column:
    """Start of the bucket of ``seconds`` that ts falls into, as a timestamp without zone."""
    step = seconds * 1_000_000
    start = micros(ts) - F.pmod(micros(ts), F.lit(step))
    return F.timestamp_micros(start).cast("timestamp_ntz")


def time_bucket_millis(ms: Column | str, seconds: int) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return ms - F.pmod(ms, F.lit(seconds * 1000))


def gap_fill(df: DataFrame, bucket: str, seconds: int, keys: list[str], value: str, method: str = "null", literal: float = 0.0) -> DataFrame:
    """df(keys.., bucket, value) with every bucket between each key's first and last.

    method: null, prev (last value carried forward), next, linear or literal.  The spine
    is made within each key; no key's rows meet another's."""
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    spine = df.groupBy(*keys).agg(F.explode(F.sequence(F.min(bucket), F.max(bucket), step)).alias(bucket)) if keys else df.agg(F.min(bucket).alias("a"), F.max(bucket).alias("b")).select(F.explode(F.sequence("a", "b", step)).alias(bucket))
    full = spine.join(df, [*keys, bucket], "left")
    back = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(0, Window.unboundedFollowing)
    if method == "prev":
        filled = F.last(value, ignorenulls=True).over(back)
    elif method == "next":
        filled = F.first(value, ignorenulls=True).over(on)
    elif method == "literal":
        filled = F.coalesce(F.col(value), F.lit(literal))
    elif method == "linear":
        known = F.when(F.col(value).isNotNull(), micros(bucket))
        t0, t1 = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(on)
        v0, v1 = F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(on)
        filled = F.when(t0 == t1, v0).otherwise(v0 + (v1 - v0) * (micros(bucket) - t0) / (t1 - t0))
    elif method == "null":
        filled = F.col(value)
    else:
        raise ValueError(f"no such gap filling: {method}")
    return full.withColumn(value, filled)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_ts: str, columns: list[str], tolerance_seconds: float | None = None) -> DataFrame:
    """Each left row with ``columns`` of the latest right row of its keys at or before its ts,
    and that row's time as right_ts; nulls where there is none (or none within tolerance).

    Both sides are united and sorted once by key and time; no pairs are made.  right's
    rows of equal times: the one greatest in ``columns``."""
    payload = F.struct(F.col(right_ts).alias("_t"), *(F.col(c) for c in columns))
    place = [f"_l_{c}" for c in left.columns]
    lrow = left.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*(F.col(c).alias(p) for c, p in zip(left.columns, place, strict=True))).alias("_left"))
    rrow = right.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), payload.alias("_right"))
    both = lrow.unionByName(rrow, allowMissingColumns=True)
    w = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_ts", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    hit = F.col("_hit")
    if tolerance_seconds is not None:
        hit = F.when(micros(F.col("_ts")) - micros(F.col("_hit._t")) <= int(tolerance_seconds * 1e6), hit)
    found = found.withColumn("_hit", hit)
    return found.select(*(F.col(f"_left.{p}").alias(c) for c, p in zip(left.columns, place, strict=True)), *(F.col(f"_hit.{c}").alias(c) for c in columns), F.col("_hit._t").alias(right_ts))


def latest_as_of(df: DataFrame, keys: list[str], ts: str, at: Column) -> DataFrame:
    """The latest row of each key at or before ``at``."""
    rest = [c for c in df.columns if c not in keys]
    return df.filter(F.col(ts) <= at).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, *(c for c in rest if c != ts))).alias("_r")).select(*keys, "_r.*")


def convert_currency(df: DataFrame, rates: DataFrame, key: str, ts: str, rate_ts: str, amount: str, rate: str) -> DataFrame:
    """amount times the rate in force, as ``converted``; null before the first rate."""
    return asof_join(df, rates, [key], ts, rate_ts, [rate]).withColumn("converted", F.col(amount) * F.col(rate))


# Functions of a series: v over the window of its key in time order


def _dt(ts: str, w: WindowSpec) -> Column:
    return (micros(ts) - F.lag(micros(ts)).over(w)) / 1e6


def ts_rate(v: str, ts: str, w: WindowSpec) -> Column:
    """Increase per second; after a fall (a counter's reset) the value is the increase."""
    before, dt = F.lag(v).over(w), _dt(ts, w)
    return F.when(dt > 0, F.when(F.col(v) >= before, F.col(v) - before).otherwise(F.col(v)) / dt)


def ts_derivative(v: str, ts: str, w: WindowSpec) -> Column:
    dt = _dt(ts, w)
    return F.when(dt > 0, (F.col(v) - F.lag(v).over(w)) / dt)


def ts_delta(v: str, w: WindowSpec) -> Column:
    return F.col(v) - F.lag(v).over(w)


def _rolling(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def ts_moving_avg(v: str, n: int, w: WindowSpec) -> Column:
    return F.when(F.row_number().over(w) >= n, F.avg(v).over(_rolling(w, n)))


def ts_ema(v: str, alpha: float, w: WindowSpec) -> Column:
    """Exponential moving average from the first value on.

    Values so far back that they weigh under 1e-18 are left out, below a double's precision,
    so that a frame has a bounded number of rows however long the series is."""
    tail = 1 if alpha >= 1 else 1 + math.ceil(math.log(1e-18) / math.log(1 - alpha))
    values = F.collect_list(v).over(w.rowsBetween(-(tail - 1), 0))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], lambda s, x: F.lit(1 - alpha) * s + F.lit(alpha) * x)


def ts_zscore(v: str, n: int, w: WindowSpec) -> Column:
    """(v - mean) / population deviation of the last n; 0 where the deviation is 0."""
    r = _rolling(w, n)
    sigma = F.stddev_pop(v).over(r)
    return F.when(F.row_number().over(w) >= n, F.when(sigma == 0, F.lit(0.0)).otherwise((F.col(v) - F.avg(v).over(r)) / sigma))


def ts_bollinger(v: str, n: int, k: float, w: WindowSpec) -> dict[str, Column]:
    """Bands lower, mid, upper and their relative width."""
    r = _rolling(w, n)
    mid, sigma = F.avg(v).over(r), F.stddev_pop(v).over(r)
    full = F.row_number().over(w) >= n
    return {"lower": F.when(full, mid - k * sigma), "mid": F.when(full, mid), "upper": F.when(full, mid + k * sigma), "width": F.when(full & (mid != 0), 2 * k * sigma / mid)}


def ts_moving_percentile(v: str, n: int, q: float, w: WindowSpec) -> Column:
    return F.when(F.row_number().over(w) >= n, F.percentile(v, F.lit(q)).over(_rolling(w, n)))


def ts_interpolate(v: str, ts: str, w: WindowSpec, method: str = "linear") -> Column:
    """Nulls filled from their neighbours; linear is flat beyond the first and last value."""
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    before, after = F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(on)
    if method == "prev":
        return before
    if method == "next":
        return after
    if method == "zero":
        return F.coalesce(F.col(v), F.lit(0.0))
    known = F.when(F.col(v).isNotNull(), micros(ts))
    t0, t1 = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(on)
    line = F.when(t1 > t0, before + (after - before) * (micros(ts) - t0) / (t1 - t0)).otherwise(before)
    return F.when(F.col(v).isNotNull(), F.col(v)).otherwise(F.coalesce(line, before, after))


def ts_stddev(v: str) -> Column:
    """Population deviation without NaN; null for under two values."""
    x = F.when(~F.isnan(v), F.col(v))
    return F.when(F.count(x) >= 2, F.stddev_pop(x))


def ts_percentile(v: str, q: float) -> Column:
    return F.percentile(F.when(~F.isnan(v), F.col(v)), F.lit(q))


# Continuous aggregates


def partial_aggregate(df: DataFrame, ts: str, seconds: int, keys: list[str], value: str) -> DataFrame:
    """States by bucket and keys that merge: count, sum, min, max, first and last."""
    at = F.struct(F.col(ts), F.col(value))
    return df.groupBy(time_bucket(ts, seconds).alias("bucket"), *keys).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def merge_aggregate(states: DataFrame, keys: list[str], seconds: int | None = None) -> DataFrame:
    """States united and merged; seconds: into wider buckets (a chained aggregate)."""
    bucket = time_bucket("bucket", seconds) if seconds else F.col("bucket")
    return states.groupBy(bucket.alias("bucket"), *keys).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def finish_aggregate(states: DataFrame, value: str) -> DataFrame:
    return states.withColumn("avg", F.col("sum") / F.col("count")).withColumn("first", F.col(f"first_at.{value}")).withColumn("last", F.col(f"last_at.{value}")).drop("first_at", "last_at")


def auto_tier(raw: DataFrame, rollup: DataFrame, split: Column, seconds: int, ts: str, keys: list[str], value: str) -> DataFrame:
    """Rollup states before ``split``, states of raw rows from it on: a query over both tiers."""
    recent = partial_aggregate(raw.filter(F.col(ts) >= split), ts, seconds, keys, value)
    return merge_aggregate(rollup.filter(F.col("bucket") < split).unionByName(recent), keys)
