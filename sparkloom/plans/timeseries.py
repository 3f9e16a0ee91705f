"""Time-series queries over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import timeseries as TS
from sparkloom.plans.registry import query

FMT, DFMT = "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"


def text(c):
    return F.date_format(c, FMT)


@query("ts_time_bucket_1h", f"SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '{DFMT}') AS bucket, event_type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 9) AS mean FROM events GROUP BY time_bucket(INTERVAL '1 hour', ts), event_type")
def _(t):
    g = t.events.groupBy(TS.time_bucket("ts", 3600).alias("b"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 9).alias("mean"))
    return g.select(text("b").alias("bucket"), "event_type", "n", "total", "mean")


@query("ts_time_bucket_5m_type", f"SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '{DFMT}') AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy(TS.time_bucket("ts", 300).alias("b"), "event_type").count().select(text("b").alias("bucket"), "event_type", F.col("count").alias("n"))


@query("ts_time_range_scan", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def _(t):
    return t.events.filter("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-06'").select("event_id", "value")


_FILL = """WITH b AS (SELECT user_id, time_bucket(INTERVAL '6 hours', ts) AS bucket, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
s AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL '6 hours')) AS bucket FROM b GROUP BY 1),
j AS (SELECT s.user_id, s.bucket, b.n FROM s LEFT JOIN b USING (user_id, bucket)) """


def _counts(t):
    d = t.events.groupBy("user_id", TS.time_bucket("ts", 21600).alias("bucket"))
    return d.agg(F.count("*").cast("double").alias("n"))


def _fill(t, method):
    return TS.gap_fill(_counts(t), "bucket", 21600, ["user_id"], "n", method, 0.0).select("user_id", text("bucket").alias("bucket"), F.round("n", 6).alias("n"))


query("ts_gap_fill_null", _FILL + f"SELECT user_id, strftime(bucket, '{DFMT}') AS bucket, n FROM j")(lambda t: _fill(t, "null"))
query("ts_gap_fill_prev", _FILL + f"SELECT user_id, strftime(bucket, '{DFMT}') AS bucket, last_value(n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY bucket) AS n FROM j")(lambda t: _fill(t, "prev"))
query("ts_gap_fill_literal", _FILL + f"SELECT user_id, strftime(bucket, '{DFMT}') AS bucket, coalesce(n, 0) AS n FROM j")(lambda t: _fill(t, "literal"))
query("ts_gap_fill_linear", _FILL + f""", w AS (SELECT *, epoch(bucket) AS e, last_value(n IGNORE NULLS) OVER b AS v0, first_value(n IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN n IS NOT NULL THEN epoch(bucket) END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN n IS NOT NULL THEN epoch(bucket) END IGNORE NULLS) OVER a AS t1 FROM j
WINDOW b AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, strftime(bucket, '{DFMT}') AS bucket, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (e - t0) / (t1 - t0) END, 6) AS n FROM w""")(lambda t: _fill(t, "linear"))


@query("join_asof", "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts")
def _(t):
    p = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return TS.asof_join(p, v, ["user_id"], "ts", "view_ts", ["view_id"]).select("event_id", "view_id")


@query("join_asof_tolerance", "SELECT p.event_id, CASE WHEN p.ts - v.ts <= INTERVAL '6 hours' THEN v.event_id END AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts")
def _(t):
    p = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return TS.asof_join(p, v, ["user_id"], "ts", "view_ts", ["view_id"], 6 * 3600).select("event_id", "view_id")


@query("temporal_lookup", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE r = 1")
def _(t):
    return TS.latest_as_of(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", F.expr("TIMESTAMP_NTZ '2024-01-15'")).select("user_id", "event_id", "value")


@query("convert_currency_lookup", "WITH r AS (SELECT o_orderpriority AS k, o_orderdate AS at, max(o_orderkey) % 10 + 1.0::DOUBLE AS rate FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) SELECT o.o_orderkey, round(o.o_totalprice * r.rate, 2) AS converted FROM orders o ASOF LEFT JOIN r ON o.o_orderpriority = r.k AND o.o_orderdate >= r.at")
def _(t):
    r = t.orders.filter("o_orderstatus = 'F'").groupBy("o_orderpriority", F.col("o_orderdate").alias("at")).agg((F.max("o_orderkey") % 10 + F.lit(1.0)).alias("rate"))
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    return TS.convert_currency(o, r, "o_orderpriority", "o_orderdate", "at", "o_totalprice", "rate").select("o_orderkey", F.round("converted", 2).alias("converted"))


def _series(name, column, oracle, places=5):
    def plan(t):
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return t.events.select("event_id", (F.round(column(w), places) + 0.0).alias("x"))

    query(name, f"SELECT event_id, round({oracle}, {places}) + 0.0 AS x FROM (SELECT *, lag(value) OVER w AS pv, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS pus, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WINDOW r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")(plan)


_series("ts_rate", lambda w: TS.ts_rate("value", "ts", w), "CASE WHEN us > pus THEN (CASE WHEN value >= pv THEN value - pv ELSE value END) / ((us - pus) / 1e6) END")
_series("ts_derivative", lambda w: TS.ts_derivative("value", "ts", w), "CASE WHEN us > pus THEN (value - pv) / ((us - pus) / 1e6) END")
_series("ts_delta", lambda w: TS.ts_delta("value", w), "value - pv")
_series("ts_moving_avg", lambda w: TS.ts_moving_avg("value", 5, w), "CASE WHEN rn >= 5 THEN avg(value) OVER r END"
, 7)
_series("ts_zscore", lambda w: TS.ts_zscore("value", 5, w), "CASE WHEN rn >= 5 THEN CASE WHEN stddev_pop(value) OVER r = 0 THEN 0.0 ELSE (value - avg(value) OVER r) / stddev_pop(value) OVER r END END", 6)
_series("ts_moving_percentile", lambda w: TS.ts_moving_percentile("value", 5, 0.5, w), "CASE WHEN rn >= 5 THEN quantile_cont(value, 0.5) OVER r END", 8)
for _band, _sql in {"lower": "avg(value) OVER r - 2 * stddev_pop(value) OVER r", "mid": "avg(value) OVER r", "upper": "avg(value) OVER r + 2 * stddev_pop(value) OVER r", "width": "4 * stddev_pop(value) OVER r / (avg(value) OVER r)"}.items():
    _series(f"ts_bollinger_{_band}", lambda w, b=_band: TS.ts_bollinger("value", 5, 2.0, w)[b], f"CASE WHEN rn >= 5 THEN {_sql} END", 6)


@query("ts_ema", """WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
e AS (SELECT event_id, user_id, rn, value AS x FROM s WHERE rn = 1 UNION ALL SELECT s.event_id, s.user_id, s.rn, 0.7 * e.x + 0.3 * s.value FROM e JOIN s ON s.user_id = e.user_id AND s.rn = e.rn + 1) SELECT event_id, round(x, 4) AS x FROM e""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.round(TS.ts_ema("value", 0.3, w), 4).alias("x"))


@query("ts_interpolate", """WITH n AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v, epoch_us(ts) AS us FROM events),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER a AS t1 FROM n
WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v ELSE coalesce(CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (us - t0) / (t1 - t0) ELSE v0 END, v0, v1) END, 4) AS x FROM w""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return e.select("event_id", F.round(TS.ts_interpolate("v", "ts", w), 4).alias("x"))


@query("ts_stddev_percentile", "SELECT user_id, round(CASE WHEN count(value) >= 2 THEN stddev_pop(value) END, 5) AS sd, round(quantile_cont(value, 0.95), 5) AS p95 FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.round(TS.ts_stddev("value"), 5).alias("sd"), F.round(TS.ts_percentile("value", 0.95), 5).alias("p95"))


@query("ts_correlate", "SELECT event_type, round(corr(value, user_id), 7) AS r FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.corr("value", "user_id"), 7).alias("r"))


@query("ts_last_values", "SELECT event_type, user_id, last(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("event_type", "user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))


_AGG = f"SELECT event_type, strftime(time_bucket(INTERVAL '1 day', ts), '{DFMT}') AS bucket, count(*) AS n, round(sum(value), 3) AS total, min(value) AS lo, max(value) AS hi, round(avg(value), 9) AS mean FROM events GROUP BY 1, 2"


def _shown(states):
    f = TS.finish_aggregate(states, "value")
    return f.select("event_type", text("bucket").alias("bucket"), F.col("count").alias("n"), F.round("sum", 3).alias("total"), F.col("min").alias("lo"), F.col("max").alias("hi"), F.round("avg", 9).alias("mean"))


@query("continuous_aggregate_incremental", _AGG)
def _(t):
    """Hourly states of old rows and of late ones, merged, then chained to days."""
    old = TS.partial_aggregate(t.events.filter("event_id % 3 <> 0"), "ts", 3600, ["event_type"], "value")
    late = TS.partial_aggregate(t.events.filter("event_id % 3 = 0"), "ts", 3600, ["event_type"], "value")
    return _shown(TS.merge_aggregate(old.unionByName(late), ["event_type"], 86400))


@query("retention_auto_tier", _AGG)
def _(t):
    split = F.expr("TIMESTAMP_NTZ '2024-01-16'")
    rollup = TS.partial_aggregate(t.events.filter(F.col("ts") < split), "ts", 86400, ["event_type"], "value")
    return _shown(TS.auto_tier(t.events, rollup, split, 86400, "ts", ["event_type"], "value"))
