"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalar as S
from sparkloom.plans.registry import query, sql_query

sql_query("string_functions", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim(concat('  ', p_name, ' ')) AS t, ltrim('  a') AS lt, rtrim('a  ') AS rt, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 3) AS s, replace(p_name, 'e', '_') AS r, reverse(p_name) AS rev FROM part")
sql_query("math_functions", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(power(p_size, 2), 3) AS p, round(sqrt(p_size), 9) AS q, CAST(sign(p_size - 25) AS INT) AS s, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS l10, round(log2(p_size), 9) AS l2, round(exp(p_size / 50.0), 9) AS e, p_size % 7 AS m FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(power(p_size, 2), 3) AS p, round(sqrt(p_size), 9) AS q, CAST(sign(p_size - 25) AS INT) AS s, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS l10, round(log2(p_size), 9) AS l2, round(exp(CAST(p_size AS DOUBLE) / 50), 9) AS e, p_size % 7 AS m FROM part")
sql_query("greatest_least", "SELECT p_partkey, greatest(p_size, 20) AS g, least(p_size, 20) AS l FROM part")
sql_query("date_functions", "SELECT event_id, CAST(extract(YEAR FROM ts) AS INT) AS y, CAST(extract(MONTH FROM ts) AS INT) AS m, CAST(extract(DAY FROM ts) AS INT) AS d, CAST(extract(HOUR FROM ts) AS INT) AS h, CAST(dayofweek(ts) - 1 AS INT) AS dow, date_format(date_trunc('DAY', ts), 'yyyy-MM-dd HH:mm') AS day, date_format(ts + INTERVAL 90 MINUTES, 'yyyy-MM-dd HH:mm:ss') AS later FROM events", "SELECT event_id, CAST(extract(YEAR FROM ts) AS INT) AS y, CAST(extract(MONTH FROM ts) AS INT) AS m, CAST(extract(DAY FROM ts) AS INT) AS d, CAST(extract(HOUR FROM ts) AS INT) AS h, CAST(dayofweek(ts) AS INT) AS dow, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS day, strftime(ts + INTERVAL 90 MINUTES, '%Y-%m-%d %H:%M:%S') AS later FROM events")


@query("epoch_functions", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, epoch_us(ts) // 1000 AS ms, round(epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6, 6) AS since FROM events")
def _(t):
    return t.events.select("event_id", S.epoch_seconds("ts").alias("s"), S.epoch_millis("ts").alias("ms"), F.round(S.seconds_between("ts", F.expr("TIMESTAMP_NTZ '2024-01-01'")), 6).alias("since"))


@query("null_safe_arithmetic", "SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_linenumber - 2, 0), 9) AS q, l_orderkey % nullif(l_linenumber - 3, 0) AS m, concat('a', nullif(l_returnflag, 'N'), 'z') AS c FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(S.divide("l_quantity", F.col("l_linenumber") - 2), 9).alias("q"), S.mod("l_orderkey", F.col("l_linenumber") - 3).alias("m"), S.concat(F.lit("a"), F.nullif("l_returnflag", F.lit("N")), F.lit("z")).alias("c"))


@query("round_modes", "SELECT p_partkey, CAST(trunc(p_retailprice) AS DOUBLE) AS t, CAST(ceil(p_retailprice) AS DOUBLE) AS c, CAST(floor(p_retailprice) AS DOUBLE) AS f, round_even(p_size / 2.0::DOUBLE, 0) AS e FROM part")
def _(t):
    x = "p_retailprice"
    half = F.col("p_size") / F.lit(2.0)
    return t.part.select("p_partkey", S.round_mode(x, 0, "TRUNCATE").alias("t"), S.round_mode(x, 0, "CEILING").alias("c"), S.round_mode(x, 0, "FLOOR").alias("f"), S.round_mode(half, 0).alias("e"))


@query("chunk_text", "SELECT doc_id, i AS index, i * 80 AS start, substr(text, i * 80 + 1, 100) AS chunk FROM (SELECT doc_id, text, CAST(unnest(range(greatest(1, CAST(ceil((length(text) - 20) / 80.0) AS INT)))) AS INT) AS i FROM documents WHERE length(text) > 0)")
def _(t):
    c = t.documents.select("doc_id", F.explode(S.chunk_text("text", 100, 20)).alias("c"))
    return c.select("doc_id", "c.index", "c.start", F.col("c.text").alias("chunk"))


@query("array_functions", "SELECT doc_id, CAST(len(w) AS INT) AS n, CAST(len(list_distinct(w)) AS INT) AS d, list_contains(w, 'the') AS has, nullif(CAST(coalesce(list_position(w, 'the'), 0) AS BIGINT), 0) AS at, array_to_string(list_reverse(w[1:3]), ' ') AS r, array_to_string(list_concat(['x'], list_append(w[1:2], 'y')), ' ') AS c FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def _(t):
    w = F.col("w")
    d = t.documents.select("doc_id", F.split("text", " ", -1).alias("w"))
    return d.select("doc_id", F.array_size(w).alias("n"), F.array_size(F.array_distinct(w)).alias("d"), F.array_contains(w, "the").alias("has"), F.nullif(F.array_position(w, "the"), F.lit(0).cast("long")).alias("at"), F.array_join(F.reverse(F.slice(w, 1, 3)), " ").alias("r"), F.array_join(F.array_prepend(F.array_append(F.slice(w, 1, 2), "y"), "x"), " ").alias("c"))


@query("json_functions", "SELECT event_id, props->>'k' AS k, json_keys(props)[1] AS first_key, json_exists(props, '$.k') AS has FROM events")
def _(t):
    return t.events.select("event_id", S.json_get("props", "k").alias("k"), S.json_keys("props")[0].alias("first_key"), S.json_has_key("props", "k").alias("has"))


@query("json_edits", "SELECT event_id, '{\"k\":\"' || (props->>'k') || '\",\"t\":\"' || event_type || '\"}' AS s, '{}' AS r FROM events")
def _(t):
    return t.events.select("event_id", S.json_set("props", "t", F.col("event_type")).alias("s"), S.json_remove("props", "k").alias("r"))


@query("variant_path", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("id_functions", "SELECT c_custkey, true AS u, CAST(3 AS INT) AS v, 'uuid' AS kind FROM customer")
def _(t):
    h = F.md5(F.col("c_custkey").cast("string"))
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return t.customer.select("c_custkey", u.alias("id")).select("c_custkey", S.is_uuid("id").alias("u"), S.uuid_version("id").alias("v"), S.id_type("id").alias("kind"))


@query("durations", "SELECT p_partkey, CAST(p_size * 3600 + 90 AS DOUBLE) AS s FROM part")
def _(t):
    return t.part.select("p_partkey", S.duration_seconds(F.concat(F.col("p_size").cast("string"), F.lit("h1m30s"))).alias("s"))
