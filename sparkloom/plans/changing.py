"""DML images, constraints, versions and change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import dml as D
from sparkloom.plans.registry import query

BASE = "SELECT c_custkey, c_name, c_acctbal FROM customer"
#: A source of changes: every supplier, renumbered onto customers and beyond them
SRC = "SELECT s_suppkey * 3 AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier UNION ALL SELECT s_suppkey + 10000000, s_name, s_acctbal FROM supplier"


def base(t):
    return t.customer.select("c_custkey", "c_name", "c_acctbal")


def source(t):
    s = t.supplier
    more = s.select((F.col("s_suppkey") + 10000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return s.select((F.col("s_suppkey") * 3).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")).unionByName(more)


K = ["c_custkey"]
JOIN = f"({BASE}) t FULL JOIN ({SRC}) s USING (c_custkey)"


@query("insert_on_conflict_nothing", f"{BASE} UNION ALL SELECT * FROM ({SRC}) s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    return D.insert_absent(base(t), source(t), K)


@query("upsert_image", f"SELECT c_custkey, coalesce(s.c_name, t.c_name) AS c_name, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal FROM {JOIN}")
def _(t):
    return D.upsert(base(t), source(t), K)


@query("upsert_merge_nulls", f"SELECT c_custkey, coalesce(s.c_name, t.c_name) AS c_name, t.c_acctbal FROM {JOIN}")
def _(t):
    return D.upsert(base(t), source(t).withColumn("c_acctbal", F.lit(None).cast("double")), K, merge=True)


@query("insert_on_conflict_update", f"SELECT c_custkey, coalesce(t.c_name, s.c_name) AS c_name, round(CASE WHEN t.c_name IS NULL THEN s.c_acctbal WHEN s.c_name IS NULL THEN t.c_acctbal ELSE t.c_acctbal + s.c_acctbal END, 2) AS c_acctbal FROM {JOIN}")
def _(t):
    out = D.upsert(base(t), source(t), K, update={"c_acctbal": F.col("t.c_acctbal") + F.col("excluded.c_acctbal")})
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("update_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_name) || '!' ELSE c_name END AS c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    return D.update(base(t), {"c_name": F.concat(F.upper("c_name"), F.lit("!")), "c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0)


@query("update_from", f"SELECT c_custkey, t.c_name, CASE WHEN s.c_name IS NOT NULL AND s.c_acctbal > t.c_acctbal THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal FROM ({BASE}) t LEFT JOIN ({SRC}) s USING (c_custkey)")
def _(t):
    return D.update_from(base(t), source(t), K, {"c_acctbal": F.col("s.c_acctbal")}, F.col("s.c_acctbal") > F.col("t.c_acctbal"))


@query("delete_where", f"SELECT * FROM ({BASE}) WHERE NOT (c_acctbal BETWEEN 1000 AND 5000)")
def _(t):
    return D.delete(base(t), F.col("c_acctbal").between(1000, 5000))


@query("merge_image", f"""SELECT c_custkey, CASE WHEN t.c_name IS NULL THEN s.c_name WHEN s.c_name IS NOT NULL AND t.c_acctbal <= 5000 THEN s.c_name ELSE t.c_name END AS c_name,
round(CASE WHEN t.c_name IS NULL THEN s.c_acctbal WHEN s.c_name IS NULL THEN t.c_acctbal - 1 WHEN t.c_acctbal <= 5000 THEN t.c_acctbal + s.c_acctbal ELSE t.c_acctbal END, 2) AS c_acctbal
FROM {JOIN} WHERE NOT (t.c_name IS NOT NULL AND s.c_name IS NOT NULL AND t.c_acctbal > 8000) AND NOT (t.c_name IS NULL AND s.c_acctbal < 0)""")
def _(t):
    out = D.merge(
        base(t),
        source(t),
        K,
        [
            ("matched", F.col("t.c_acctbal") > 8000, "delete", None),
            ("matched", F.col("t.c_acctbal") > 5000, "nothing", None),
            ("matched", None, "update", {"c_name": F.col("s.c_name"), "c_acctbal": F.col("t.c_acctbal") + F.col("s.c_acctbal")}),
            ("not_matched", F.col("s.c_acctbal") < 0, "nothing", None),
            ("not_matched", None, "insert", None),
            ("not_by_source", None, "update", {"c_acctbal": F.col("t.c_acctbal") - 1}),
        ],
    )
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("cdc_diff", f"""SELECT CASE WHEN t.c_name IS NULL THEN 'insert' WHEN s.c_name IS NULL THEN 'delete' ELSE 'update' END AS op, c_custkey, t.c_name AS old_name, s.c_name AS new_name
FROM {JOIN} WHERE t.c_name IS NULL OR s.c_name IS NULL OR t.c_name <> s.c_name OR t.c_acctbal <> s.c_acctbal""")
def _(t):
    return D.changes(base(t), source(t), K).select("op", "c_custkey", F.col("old.c_name").alias("old_name"), F.col("new.c_name").alias("new_name"))


@query("cdc_field_diffs", f"SELECT c_custkey, CASE WHEN t.c_name <> s.c_name THEN 'c_name' ELSE '' END || CASE WHEN t.c_name <> s.c_name AND t.c_acctbal <> s.c_acctbal THEN ',' ELSE '' END || CASE WHEN t.c_acctbal <> s.c_acctbal THEN 'c_acctbal' ELSE '' END AS changed FROM ({BASE}) t JOIN ({SRC}) s USING (c_custkey) WHERE t.c_name <> s.c_name OR t.c_acctbal <> s.c_acctbal")
def _(t):
    feed = D.field_diffs(D.changes(base(t), source(t), K), ["c_name", "c_acctbal"])
    return feed.filter("op = 'update'").select("c_custkey", F.array_join("changed", ",").alias("changed"))


@query("log_compaction", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    return D.compacted(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("generated_columns", "SELECT p_partkey, round(p_retailprice * 1.2, 2) AS gross, round(round(p_retailprice * 1.2, 2) * p_size, 2) AS stock FROM part")
def _(t):
    return D.generated(t.part, {"stock": "round(gross * p_size, 2)", "gross": "round(p_retailprice * 1.2D, 2)"}).select("p_partkey", "gross", "stock")


@query("check_violations", "SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'balance,segment' WHEN c_acctbal < 0 THEN 'balance' ELSE 'segment' END AS failed FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def _(t):
    return D.violations(t.customer, {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING"}).select("c_custkey", F.array_join("failed", ",").alias("failed"))


@query("balanced_groups", "SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS debit, round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END), 2) AS credit FROM orders GROUP BY 1 HAVING debit <> credit")
def _(t):
    done = F.col("o_orderstatus") == "F"
    return D.unbalanced(t.orders, "o_custkey", F.when(done, F.col("o_totalprice")).otherwise(0.0), F.when(~done, F.col("o_totalprice")).otherwise(0.0))


@query("verify_balance", "SELECT o_orderkey, round(o_totalprice, 2) AS kept, round(coalesce(s, 0), 2) AS summed FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE kept <> summed")
def _(t):
    return D.balance_errors(t.orders, "o_orderkey", "o_totalprice", t.lineitem, "l_orderkey", "l_extendedprice")


@query("state_transitions", "SELECT event_id, before AS old, event_type AS new FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type AND (before || '>' || event_type) NOT IN ('view>click', 'click>purchase', 'signup>view')")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    both = t.events.select("event_id", F.lag("event_type").over(w).alias("before"), "event_type")
    old, new = both.select("event_id", F.col("before").alias("state")), both.select("event_id", F.col("event_type").alias("state"))
    return D.bad_transitions(old, new, ["event_id"], "state", [("view", "click"), ("click", "purchase"), ("signup", "view")])


@query("hash_chain", """WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
c AS (SELECT event_id, user_id, rn, sha256(event_id || chr(31) || event_type) AS hash FROM s WHERE rn = 1 UNION ALL SELECT s.event_id, s.user_id, s.rn, sha256(c.hash || s.event_id || chr(31) || s.event_type) FROM c JOIN s ON s.user_id = c.user_id AND s.rn = c.rn + 1) SELECT event_id, hash FROM c""")
def _(t):
    return D.hash_chain(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], ["event_id", "event_type"]).select("event_id", "hash")


@query("verify_hash_chain", "SELECT event_id FROM events WHERE event_type = 'error'")
def _(t):
    rows = D.hash_chain(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])
    forged = rows.withColumn("event_type", F.when(F.col("event_type") == "error", "fine").otherwise(F.col("event_type")))
    return D.broken_chain(forged, "user_id", ["ts", "event_id"], ["event_id", "event_type"]).select("event_id")


# Versions: an order's status as it was recorded, by date

V = "SELECT o_custkey AS id, o_orderstatus AS v, epoch_ms(o_orderdate) + o_orderkey % 1000 AS sys FROM orders"


def versions(t):
    sys_ = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1000
    return t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("v"), sys_.alias("sys"))


AT = 883612800000


@query("asof_system_time", f"SELECT id, max(sys) AS sys FROM ({V}) WHERE sys <= {AT} GROUP BY id")
def _(t):
    return D.as_of(versions(t), ["id"], "sys", AT).select("id", "sys")


@query("valid_time_contains", f"WITH v AS (SELECT DISTINCT id, sys FROM ({V})) SELECT id, sys FROM (SELECT id, sys, lead(sys) OVER (PARTITION BY id ORDER BY sys) AS until FROM v) WHERE sys <= {AT} AND (until IS NULL OR until > {AT})")
def _(t):
    return D.valid_at(D.intervals(versions(t).select("id", "sys").distinct(), ["id"], "sys"), "sys", "until", AT).select("id", "sys")


@query("valid_time_overlap", f"WITH v AS (SELECT DISTINCT id, sys FROM ({V})) SELECT id, count(*) AS n FROM (SELECT id, sys, lead(sys) OVER (PARTITION BY id ORDER BY sys) AS until FROM v) WHERE sys < {AT + 10**10} AND (until IS NULL OR until > {AT}) GROUP BY id")
def _(t):
    own = D.valid_between(D.intervals(versions(t).select("id", "sys").distinct(), ["id"], "sys"), "sys", "until", AT, AT + 10**10)
    return own.groupBy("id").agg(F.count("*").alias("n"))
