"""Protocols, replicated values, schedules and inverted lists: each is made from the tables and read again."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import crdt
from sparkloom.operators import search as X
from sparkloom.operators import vector as V
from sparkloom.plans.registry import query
from sparkloom.plans.searching import _METRICS, QL, QL2, TOK, Q, Q2
from sparkloom.shared import fresh_path
from sparkloom.sources import protocols as L
from sparkloom.sources import wire as W
from sparkloom.streaming import schedule
from sparkloom.streaming.topics import server_sent


def samples(t):
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return t.events.select(F.concat(F.lit("m_"), F.col("event_type")).alias("metric"), labels.alias("labels"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "value")


_SAMPLES = "SELECT 'm_' || event_type AS metric, event_type AS type, CAST(user_id AS VARCHAR) AS user, epoch_us(ts) // 1000 AS ts, value FROM events"


def shown(df):
    return df.select("metric", F.col("labels")["type"].alias("type"), F.col("labels")["user"].alias("user"), "ts", "value")


@query("prometheus_remote_write", _SAMPLES)
def _(t):
    return shown(W.remote_write(W.remote_write_requests(samples(t), 100)))


@query("prometheus_remote_read", f"SELECT * FROM ({_SAMPLES}) WHERE type <> 'view' AND regexp_full_match(metric, 'm_[cv].*') AND ts BETWEEN 1704585600000 AND 1705190400000")
def _(t):
    request = W.read_request(1704585600000, 1705190400000, [("__name__", "=~", "m_[cv].*"), ("type", "!=", "view")])
    return shown(W.remote_read(request, samples(t)))


@query("resp_commands", "SELECT n_nationkey, CAST(i AS INT) AS \"at\", command, args FROM (SELECT n_nationkey, 0 AS i, 'SET' AS command, 'nation:' || n_nationkey || '|' || n_name AS args FROM nation UNION ALL SELECT n_nationkey, 1, 'GET', 'nation:' || n_nationkey FROM nation)")
def _(t):
    bulk = lambda c: F.concat(F.lit("$"), F.octet_length(c).cast("string"), F.lit("\r\n"), c, F.lit("\r\n"))
    key = F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))
    body = F.concat(F.lit("*3\r\n"), bulk(F.lit("set")), bulk(key), bulk(F.col("n_name")), F.lit("*2\r\n"), bulk(F.lit("GET")), bulk(key))
    out = W.resp_commands(t.nation.select("n_nationkey", F.encode(body, "utf-8").alias("body")))
    return out.select("n_nationkey", "at", "command", F.array_join("args", "|").alias("args"))


@query("resp_replies", "SELECT n_nationkey, '$' || strlen(n_name) || chr(13) || chr(10) || n_name || chr(13) || chr(10) AS name, ':' || n_regionkey || chr(13) || chr(10) AS region FROM nation")
def _(t):
    return t.nation.select("n_nationkey", W.resp_reply("n_name").alias("name"), W.resp_reply("n_regionkey").alias("region"))


def _attribute(key, value):
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))


#: Events of a row that a partition gives to a request.
REQUEST = 1000


def _otlp(t, outer, scopes, inner, items):
    """JSON files of OTLP: requests of a resource (service) for an event type, each with up to REQUEST items from
    events, as exporters send them: no request grows with the input."""
    resource = F.struct(F.array(_attribute("service.name", F.col("event_type"))).alias("attributes"))
    some = t.events.withColumn("_batch", F.floor(F.monotonically_increasing_id() / REQUEST))
    own = some.groupBy("event_type", "_batch").agg(F.collect_list(items).alias("items"))
    body = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.col("items").alias(inner))).alias(scopes))).alias(outer))
    path = fresh_path(t.spark, outer)
    own.select(F.to_json(body).alias("value")).write.text(path)
    return path


_NANOS = "epoch_us(ts) * 1000"


def nanos():
    return (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")


@query("otlp_logs", f"SELECT event_type AS service, {_NANOS} AS time, CASE WHEN value > 50 THEN 'WARN' ELSE 'INFO' END AS severity, 'user ' || user_id AS body FROM events")
def _(t):
    item = F.struct(nanos().alias("timeUnixNano"), F.when(F.col("value") > 50, "WARN").otherwise("INFO").alias("severityText"), F.struct(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("stringValue")).alias("body"))
    return L.otlp_logs(t.spark, _otlp(t, "resourceLogs", "scopeLogs", "logRecords", item))


@query("otlp_metrics", f"SELECT event_type AS service, metric, kind, user, le, {_NANOS} AS time, value FROM (SELECT *, 'load' AS metric, 'gauge' AS kind, CAST(user_id AS VARCHAR) AS user, NULL AS le FROM events UNION ALL SELECT * REPLACE (CAST(floor(value) AS DOUBLE) AS value), 'total', 'sum', CAST(user_id AS VARCHAR), NULL FROM events UNION ALL SELECT * REPLACE (1.0::DOUBLE AS value), 'lag_count', 'histogram', NULL, NULL FROM events UNION ALL SELECT *, 'lag_sum', 'histogram', NULL, NULL FROM events UNION ALL SELECT * REPLACE (CASE WHEN value <= 50 THEN 1.0::DOUBLE ELSE 0 END AS value), 'lag_bucket', 'histogram', NULL, '50.0' FROM events UNION ALL SELECT * REPLACE (1.0::DOUBLE AS value), 'lag_bucket', 'histogram', NULL, '+Inf' FROM events)")
def _(t):
    user = F.array(_attribute("user", F.col("user_id")))
    gauge = F.struct(F.lit("load").alias("name"), F.struct(F.array(F.struct(nanos().alias("timeUnixNano"), F.col("value").alias("asDouble"), user.alias("attributes"))).alias("dataPoints")).alias("gauge"))
    total = F.struct(F.lit("total").alias("name"), F.struct(F.array(F.struct(nanos().alias("timeUnixNano"), F.floor("value").cast("string").alias("asInt"), user.alias("attributes"))).alias("dataPoints")).alias("sum"))
    low = (F.col("value") <= 50).cast("int").cast("string")
    lag = F.struct(F.lit("lag").alias("name"), F.struct(F.array(F.struct(nanos().alias("timeUnixNano"), F.lit("1").alias("count"), F.col("value").alias("sum"), F.array(low, (1 - (F.col("value") <= 50).cast("int")).cast("string")).alias("bucketCounts"), F.array(F.lit(50.0)).alias("explicitBounds"))).alias("dataPoints")).alias("histogram"))
    out = None
    for item in (gauge, total, lag):
        m = L.otlp_metrics(t.spark, _otlp(t, "resourceMetrics", "scopeMetrics", "metrics", item))
        out = m if out is None else out.unionByName(m)
    return out.select("service", "metric", "kind", F.col("labels")["user"].alias("user"), F.col("labels")["le"].alias("le"), "time", "value")


@query("otlp_traces", f"SELECT event_type AS service, 'u' || user_id AS trace, 's' || event_id AS span, CASE WHEN event_id % 3 > 0 THEN 'p' || event_id // 3 END AS parent, 'op' AS name, {_NANOS} AS start, {_NANOS} + 5 AS \"end\", CASE WHEN value > 90 THEN 2 ELSE 0 END AS status, CAST(user_id AS VARCHAR) AS user FROM events")
def _(t):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    parent = F.when(F.col("event_id") % 3 > 0, text("p", F.floor(F.col("event_id") / 3))).otherwise(F.lit(""))
    end = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 5).cast("string")
    status = F.struct(F.when(F.col("value") > 90, F.lit(2)).alias("code"))
    item = F.struct(text("u", F.col("user_id")).alias("traceId"), text("s", F.col("event_id")).alias("spanId"), parent.alias("parentSpanId"), F.lit("op").alias("name"), nanos().alias("startTimeUnixNano"), end.alias("endTimeUnixNano"), status.alias("status"), F.array(_attribute("user", F.col("user_id"))).alias("attributes"))
    s = L.otlp_traces(t.spark, _otlp(t, "resourceSpans", "scopeSpans", "spans", item))
    return s.select("service", "trace", "span", "parent", "name", "start", "end", "status", F.col("labels")["user"].alias("user"))


@query("server_sent_events", "SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: {\"user_id\":' || user_id || '}' || chr(10) || chr(10) AS value FROM events WHERE event_id > 100")
def _(t):
    return server_sent(t.events.select("event_id", "event_type", "user_id"), "event_id", "event_type", after=100)


@query("ndjson_rows", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def _(t):
    return t.nation.select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))


@query("schedule_cron", "SELECT strftime(m, '%Y-%m-%d %H:%M') AS \"at\" FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-29 23:59', INTERVAL 1 MINUTE) x(m) WHERE minute(m) IN (0, 20, 40) AND hour(m) BETWEEN 9 AND 11 AND (day(m) = 1 OR dayofweek(m) IN (1, 3))")
def _(t):
    runs = schedule.runs(t.spark, "*/20 9-11 1 * mon,wed", dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 1))
    return runs.select(F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"))


# Replicated values: an event is a write of its user by a node


def writes(t):
    return t.events.select("user_id", F.col("event_type").alias("field"), "value", "event_id", (F.col("event_id") % 3).alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("clock"))


@query("crdt_register", "SELECT user_id, arg_max(value, (ts, event_id % 3)) AS value, max(epoch_us(ts)) AS clock FROM events GROUP BY user_id")
def _(t):
    return crdt.register(writes(t), ["user_id"], "value", "clock", "node")


@query("crdt_counter", "SELECT user_id, sum(a) - sum(b) AS value FROM (SELECT user_id, event_id % 3 AS node, max(event_id) AS a, max(event_id // 7) AS b FROM events GROUP BY 1, 2) GROUP BY user_id")
def _(t):
    w = writes(t).select("user_id", "node", F.col("event_id").alias("a"), F.floor(F.col("event_id") / 7).alias("b"))
    return crdt.counter(w, ["user_id"], "node", "a", "b")


@query("crdt_observed_set", "SELECT DISTINCT user_id, event_type AS field FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = e.event_type AND r.event_id % 2 = 1 AND r.event_id // 20 = e.event_id // 20)")
def _(t):
    w = writes(t).withColumn("tag", F.floor(F.col("event_id") / 20)).withColumn("op", F.when(F.col("event_id") % 2 == 0, "add").otherwise("remove"))
    return crdt.observed_set(w, ["user_id"], "field", "tag", "op")


@query("crdt_map", "SELECT user_id, string_agg(event_type || '=' || event_id, ',' ORDER BY event_type) AS doc FROM (SELECT user_id, event_type, arg_max(event_id, (ts, event_id % 3)) AS event_id FROM events GROUP BY 1, 2) WHERE event_id % 5 > 0 GROUP BY user_id")
def _(t):
    w = writes(t).withColumn("id", F.col("event_id"))
    doc = crdt.register(w, ["user_id", "field"], "id", "clock", "node").withColumn("id", F.when(F.col("id") % 5 > 0, F.col("id")))
    out = crdt.merged_map(doc.withColumn("node", F.lit(0)), ["user_id"], "field", "id", "clock", "node")
    return out.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("doc")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("doc"))


@query("crdt_list", "SELECT user_id, event_type AS field, row_number() OVER (PARTITION BY user_id ORDER BY value, event_type) - 1 AS place FROM (SELECT user_id, event_type, arg_max(value, (ts, event_id % 3)) AS value, arg_max(event_id, (ts, event_id % 3)) AS event_id FROM events GROUP BY 1, 2) WHERE event_id % 4 > 0")
def _(t):
    w = writes(t).withColumn("deleted", F.col("event_id") % 4 == 0)
    return crdt.ordered_list(w, ["user_id"], "value", "field", "clock", "node", "deleted").select("user_id", "field", "place")


@query("crdt_versions", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS changed FROM events")
def _(t):
    return crdt.versions(writes(t), ["user_id"], "event_id", "field").select("event_id", "before", "changed")


# Inverted lists and light stems


@query("vector_inverted_lists", f"SELECT vec_id, round({_METRICS['l2']}, 6) AS d FROM embeddings ORDER BY {_METRICS['l2']}, vec_id LIMIT 5")
def _(t):
    """All lists are probed: the search is exact."""
    books = V.inverted_lists(t.embeddings, "embedding", "vec_id", 16)
    rows = V.listed(t.embeddings, "embedding", books)
    return V.listed_topk(rows, "embedding", books, Q, 5, "vec_id", 16).select("vec_id", F.round("distance", 6).alias("d"))


_EXACT5 = f"SELECT vec_id, round({_METRICS['l2']}, 6) AS d FROM embeddings ORDER BY {_METRICS['l2']}, vec_id LIMIT 5"


@query("vector_centred_binary", _EXACT5)
def _(t):
    """Signs of centred vectors; the nearest five are among the 150 that they find."""
    center = np.zeros(64)
    rows = V.sign_codes(t.embeddings, "embedding", center)
    return V.sign_topk(rows, "embedding", Q, center, 5, "vec_id", 30).select("vec_id", F.round("distance", 6).alias("d"))


@query("vector_rotated_binary", _EXACT5)
def _(t):
    """The same of randomly rotated vectors."""
    center, r = np.zeros(64), V.rotation(64)
    rows = V.sign_codes(t.embeddings, "embedding", center, r)
    return V.sign_topk(rows, "embedding", Q, center, 5, "vec_id", 30, r).select("vec_id", F.round("distance", 6).alias("d"))


@query("vector_optimized_product", _EXACT5)
def _(t):
    """Product codes of vectors rotated to balanced principal directions, with their errors: exact."""
    r = V.balanced_rotation(t.embeddings, "embedding", 8, "vec_id")
    turned = t.embeddings.withColumn("turned", V.rotated("embedding", r))
    books = V.product_codebooks(turned, "turned", key="vec_id")
    coded = turned.withColumn("codes", V.product_codes("turned", books)).withColumn("error", V.product_errors("turned", books))
    q = (np.asarray(Q) @ r).tolist()
    return V.product_topk(coded, "turned", "codes", books, q, 5, "vec_id", oversample=40, error="error").select("vec_id", F.round("distance", 6).alias("d"))


@query("multi_vector_pruned", f"WITH q AS (SELECT * FROM (VALUES (0, {QL}), (1, {QL2})) v(q, qv)), s AS (SELECT e.vec_id % 20 AS doc, q.q, max(list_inner_product(CAST(e.embedding AS DOUBLE[]), q.qv)) AS s FROM embeddings e, q GROUP BY 1, 2) SELECT doc, round(sum(s), 6) AS score FROM s GROUP BY doc ORDER BY sum(s) DESC, doc LIMIT 5")
def _(t):
    """Documents with a vector near to a query vector's lists; the best five are among them."""
    docs = t.embeddings.select((F.col("vec_id") % 20).alias("doc"), "vec_id", "embedding")
    books = V.inverted_lists(docs, "embedding", "vec_id", 16, "cosine")
    return V.pruned_maxsim([Q, Q2], V.listed(docs, "embedding", books, "cosine"), "doc", "embedding", books, 5, 6).select("doc", F.round("score", 6).alias("score"))


for _lang in ("fr", "es"):
    query(f"fts_light_stems_{_lang}", f"SELECT regexp_replace(w, '{X.light_pattern(_lang)}', '\\1') AS term, count(*) AS n FROM (SELECT unnest({TOK}) AS w FROM documents WHERE lang = '{_lang}') GROUP BY 1")(
        lambda t, lang=_lang: t.documents.filter(F.col("lang") == lang).select(F.explode(X.tokens("text")).alias("w")).groupBy(X.light_stem(F.col("w"), lang).alias("term")).agg(F.count("*").alias("n"))
    )
