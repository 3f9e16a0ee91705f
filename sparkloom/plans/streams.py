"""Streaming queries over the events file, run to its end, against their batch twins."""

from __future__ import annotations


from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.shared import fresh_path
from sparkloom.streaming import views as V

D = "%Y-%m-%d %H:%M:%S"


def stream(t):
    e = V.table_stream(t.spark, t.folder, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def at(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("streaming_tumbling", f"SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '{D}') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2")
def _(t):
    out = V.run_available(V.tumbling(stream(t), "ts", "1 hour", ["event_type"], "value", late=None), "complete")
    return out.select(at("start").alias("start"), "event_type", "n", F.round("total", 3).alias("total"), "lo", "hi")


@query("streaming_tumbling_final", f"SELECT * FROM (SELECT strftime(time_bucket(INTERVAL '1 day', ts), '{D}') AS start, count(*) AS n FROM events GROUP BY time_bucket(INTERVAL '1 day', ts) HAVING time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))")
def _(t):
    """Append mode: only windows that the watermark has closed."""
    out = V.run_available(V.tumbling(stream(t), "ts", "1 day", [], "value", late="1 hour"), "append")
    return out.select(at("start").alias("start"), "n")


@query("streaming_sliding", f"SELECT strftime(s, '{D}') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - i * INTERVAL '1 hour' AS s FROM events, range(2) x(i)) GROUP BY 1")
def _(t):
    out = V.run_available(V.tumbling(stream(t), "ts", "2 hours", [], "value", late=None, slide="1 hour"), "complete")
    return out.select(at("start").alias("start"), "n")


@query("streaming_keyed_view", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, min(value) AS lo, max(value) AS hi, round(avg(value), 9) AS mean FROM events GROUP BY 1")
def _(t):
    out = V.run_available(V.keyed_view(stream(t), ["event_type"], "value"), "complete")
    return out.select("event_type", "n", F.round("total", 3).alias("total"), "lo", "hi", F.round("mean", 9).alias("mean"))


@query("streaming_upsert_sink", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    path = fresh_path(t.spark, "latest")
    V.run_available(stream(t).select("user_id", "event_id"), "append", batch=V.upsert_sink(path, ["user_id"], "event_id"))
    return V.read_version(t.spark, path)


@query("streaming_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _(t):
    e = stream(t).withColumn("ts", F.expr("TIMESTAMP '2024-01-01'"))
    return V.run_available(V.deduplicated(e.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts"), "append").agg(F.count("*").alias("n"))


_SESSIONS = f"WITH a AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, strftime(min(ts), '{D}') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '{D}') AS \"end\", count(*) AS n FROM b GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("streaming_sessions", _SESSIONS)
def _(t):
    out = V.run_available(V.sessions(stream(t), "ts", "30 minutes", ["user_id"]), "append")
    return out.select("user_id", at("start").alias("start"), at("end").alias("end"), "n")


_TURNS = """WITH RECURSIVE e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS rn FROM events),
a(user_id, rn, lit, turn, ts) AS (SELECT user_id, 0, false, NULL::VARCHAR, NULL::TIMESTAMP FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.rn, CASE WHEN NOT lit AND value >= 60 THEN true WHEN lit AND value <= 10 THEN false ELSE lit END, CASE WHEN NOT lit AND value >= 60 THEN 'firing' WHEN lit AND value <= 10 THEN 'resolved' END, e.ts FROM a JOIN e ON e.user_id = a.user_id AND e.rn = a.rn + 1)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, turn AS state FROM a WHERE turn IS NOT NULL"""


@query("streaming_alerts", _TURNS)
def _(t):
    e = V.table_stream(t.spark, t.folder, "events").select("user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    out = V.run_available(V.alerts(e, "user_id", "ts", "value", 60.0, 10.0), "append")
    return out.select("user_id", at("at").alias("at"), "state")
