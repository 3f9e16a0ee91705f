"""Key-value and array queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import keyvalue as K
from sparkloom.operators.ndarray import Array
from sparkloom.plans.registry import query

STATE = "SELECT user_id, event_type AS v, value, CASE WHEN event_type = 'view' THEN ts + INTERVAL 5 DAYS END AS expire_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"
NOW = "TIMESTAMP '2024-01-30 12:00:00'"


def table(t):
    log = t.events.withColumn("expire_at", F.when(F.col("event_type") == "view", F.expr("ts + INTERVAL 5 DAYS")))
    return K.state(log, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", F.col("event_type").alias("v"), "value", "expire_at")


@query("kv_state", f"SELECT user_id, v, value FROM ({STATE})")
def _(t):
    return table(t).select("user_id", "v", "value")


@query("kv_live_ttl", f"SELECT user_id, round(CASE WHEN expire_at IS NULL THEN -1 ELSE epoch(expire_at - {NOW}) END, 3) AS ttl FROM ({STATE}) WHERE expire_at IS NULL OR expire_at > {NOW}")
def _(t):
    now = F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00'")
    return K.live(table(t), now).select("user_id", F.round(K.ttl(table(t), now), 3).alias("ttl"))


@query("kv_expire_persist", f"SELECT user_id, CASE WHEN v = 'click' THEN '2024-03-01' WHEN v = 'view' THEN NULL ELSE strftime(expire_at, '%Y-%m-%d') END AS until FROM ({STATE})")
def _(t):
    one = K.expire(table(t), F.col("v") == "click", F.expr("TIMESTAMP_NTZ '2024-03-01'"))
    two = K.expire(one, F.col("v") == "view", None)
    return two.select("user_id", F.date_format("expire_at", "yyyy-MM-dd").alias("until"))


@query("kv_multi_get", f"SELECT user_id, v FROM ({STATE}) WHERE user_id IN (1, 3, 5, 8)")
def _(t):
    return K.get(table(t), "user_id", 1, 3, 5, 8).select("user_id", "v")


@query("kv_scan_pattern", "SELECT c_name FROM customer WHERE c_name LIKE '%1_' AND c_name > 'CUST_5'")
def _(t):
    return K.scan(t.customer, "c_name", "*1?", after="CUST_5").select("c_name")


@query("kv_incr", f"SELECT user_id, round(coalesce(s.value, 0) + coalesce(d, 0), 2) AS value FROM ({STATE}) s FULL JOIN (SELECT user_id, sum(value) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (user_id)")
def _(t):
    out = K.incremented(table(t), t.events.filter("event_type = 'purchase'").select("user_id", F.col("value").alias("delta")), "user_id", "value", "delta")
    return out.select("user_id", F.round("value", 2).alias("value"))


@query("kv_cas", f"SELECT user_id, CASE WHEN v = 'click' THEN 'seen' ELSE v END AS v FROM ({STATE})")
def _(t):
    wants = t.events.select("user_id").distinct().select("user_id", F.lit("click").alias("expected"), F.lit("seen").alias("new"))
    return K.compare_and_set(table(t), "user_id", "v", wants).select("user_id", "v")


@query("kv_transfer", "WITH m AS (SELECT o_custkey AS s, o_custkey + 1 AS d, o_totalprice AS a FROM orders WHERE o_orderstatus = 'F'), x AS (SELECT s AS c_custkey, -a AS a FROM m UNION ALL SELECT d, a FROM m) SELECT c_custkey, round(coalesce(max(c_acctbal), 0) + coalesce(sum(a), 0), 2) AS balance FROM customer FULL JOIN x USING (c_custkey) GROUP BY 1")
def _(t):
    m = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("source"), (F.col("o_custkey") + 1).alias("target"), F.col("o_totalprice").alias("amount"))
    out = K.transferred(t.customer.select("c_custkey", "c_acctbal"), m, "c_custkey", "c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal", 2).alias("balance"))


@query("kv_leaderboard_rank", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rank FROM customer")
def _(t):
    return K.ranked(t.customer, "c_acctbal", "c_custkey").select("c_custkey", "rank")


@query("kv_rank_of", "SELECT count(*) + 1 AS rank FROM customer WHERE c_acctbal > (SELECT c_acctbal FROM customer WHERE c_custkey = 42) OR (c_acctbal = (SELECT c_acctbal FROM customer WHERE c_custkey = 42) AND c_custkey < 42)")
def _(t):
    return K.rank_of(t.customer, "c_acctbal", "c_custkey", 42)


@query("kv_sorted_topk_range_count", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 100 AND 4000 ORDER BY c_acctbal DESC, c_custkey LIMIT 15")
def _(t):
    return K.top(K.score_range(t.customer, "c_acctbal", 100, 4000), "c_acctbal", "c_custkey", 15).select("c_custkey", "c_acctbal")


@query("kv_windowed_leaderboard", "SELECT strftime(period, '%Y-%m-%d') AS period, user_id, CAST(rank AS INT) AS rank FROM (SELECT period, user_id, row_number() OVER (PARTITION BY period ORDER BY score DESC, user_id) AS rank FROM (SELECT date_trunc('week', ts) AS period, user_id, count(*) AS score FROM events GROUP BY 1, 2)) WHERE rank <= 3")
def _(t):
    out = K.leaderboard(t.events.withColumn("one", F.lit(1)), "ts", "week", "user_id", "one", 3)
    return out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "user_id", "rank")


@query("kv_rate_gate", "SELECT event_id, n <= 2 AS allowed, CAST(greatest(0, 2 - n) AS INT) AS remaining FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts, event_id) AS n FROM events)")
def _(t):
    return K.rate_gate(t.events, "ts", "user_id", 3600, 2, "event_id").select("event_id", "allowed", "remaining")


# Arrays: order by supplier, a cell the sum of quantities

CELLS = "SELECT l_partkey AS x, l_suppkey AS y, sum(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1, 2"


def cells(t):
    c = t.lineitem.groupBy(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")).agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    return Array(c, {"x": (0, 1 << 20), "y": (0, 1 << 20)}, ["q", "d"], {"x": 100, "y": 10})


@query("array_slice", f"SELECT x, y, q FROM ({CELLS}) WHERE x BETWEEN 20 AND 60 AND y >= 5")
def _(t):
    return cells(t).slice({"x": (20, 60), "y": (5, None)}, ["q"]).cells


@query("array_agg_dim", f"SELECT y, round(avg(q), 6) AS value FROM ({CELLS}) GROUP BY y")
def _(t):
    return cells(t).agg("q", "mean", "y").select("y", F.round("value", 6).alias("value"))


@query("array_agg_all", f"SELECT max(d) AS value FROM ({CELLS})")
def _(t):
    return cells(t).agg("d", "max")


@query("array_elementwise", f"WITH a AS (SELECT * FROM ({CELLS}) WHERE q > 20), b AS (SELECT * FROM ({CELLS}) WHERE q < 60) SELECT x, y, round(a.q / nullif(b.d, 0), 6) AS q FROM a FULL JOIN (SELECT x, y, d FROM b) b USING (x, y)")
def _(t):
    a = cells(t)
    left = a._with(a.cells.filter("q > 20"))
    right = Array(a.cells.filter("q < 60").select("x", "y", F.col("d").alias("q")), a.dims, ["q"])
    return left.elementwise(right, "div", "q").cells.select("x", "y", F.round("q", 6).alias("q"))


@query("array_put_delete", f"SELECT x, y, CASE WHEN q > 50 THEN 0 ELSE q END AS q FROM ({CELLS}) WHERE NOT d < 0.05")
def _(t):
    a = cells(t).project(["q", "d"])
    b = a.put(a.cells.filter("q > 50").withColumn("q", F.lit(0.0)))
    return b.delete(a.cells.filter("d < 0.05").select("x", "y")).cells.select("x", "y", "q")


@query("array_tiles", f"SELECT x // 100 AS tx, y // 10 AS ty, count(*) AS n FROM ({CELLS}) GROUP BY 1, 2")
def _(t):
    a = cells(t)
    return a.rechunk({"x": 100, "y": 10}).cells.groupBy(a.tile().alias("tile")).count().select(F.col("tile")[0].alias("tx"), F.col("tile")[1].alias("ty"), F.col("count").alias("n"))


@query("array_as_of", "SELECT l_partkey AS x, l_suppkey AS y, max(epoch_ms(l_shipdate)) AS sys FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def _(t):
    c = t.lineitem.select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("sys"))
    return Array(c, {"x": (0, 1 << 20), "y": (0, 1 << 20)}, []).as_of("sys", 883612800000).cells


@query("array_z_order", f"SELECT x, y, list_sum([(((x >> b) & 1) << (2 * b + 1)) | (((y >> b) & 1) << (2 * b)) FOR b IN range(16)])::BIGINT AS z FROM ({CELLS})")
def _(t):
    a = cells(t)
    return a.cells.select("x", "y", a.z_order().alias("z"))


@query("array_hilbert", f"""WITH RECURSIVE h(x0, y0, k, x, y, d) AS (SELECT x, y, 16, x::BIGINT, y::BIGINT, 0::BIGINT FROM ({CELLS}) UNION ALL
SELECT x0, y0, k, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN z - 1 - y ELSE y END ELSE x END, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN z - 1 - x ELSE x END ELSE y END, d + z * z * ((3 * rx) ^ ry)
FROM (SELECT x0, y0, k - 1 AS k, (1 << (k - 1))::BIGINT AS z, (x >> (k - 1)) & 1 AS rx, (y >> (k - 1)) & 1 AS ry, x % (1 << (k - 1)) AS x, y % (1 << (k - 1)) AS y, d FROM h WHERE k > 0))
SELECT x0 AS x, y0 AS y, d AS h FROM h WHERE k = 0""".replace("(3 * rx) ^ ry", "xor(3 * rx, ry)"))
def _(t):
    a = cells(t)
    return a.cells.select("x", "y", a.hilbert(16).alias("h"))
