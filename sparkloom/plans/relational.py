"""Relational queries: scans, filters, joins, subqueries, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import relational as R
from sparkloom.plans.registry import query, sql_query

# Scans, point and range access, filters and expressions
sql_query("constant_result", "SELECT 1 AS one, 'a' AS letter")
sql_query("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03")
sql_query("scan_sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 7")
sql_query("derived_table", "SELECT t.n_name FROM (SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 2) t")
sql_query("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
sql_query("filter_in_between_like", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_name LIKE '%e%'")
sql_query("filter_not_forms", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45 AND p_brand NOT IN ('Brand#11') AND p_name NOT LIKE 'a%' AND p_type IS NOT NULL")
sql_query("filter_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%'")
sql_query("filter_column_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey > l_partkey")
sql_query("filter_boolean_nested", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_orderpriority = '5-LOW')")
sql_query("case_coalesce_nullif", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS band, coalesce(nullif(o_orderstatus, 'P'), 'none') AS s FROM orders")
sql_query("arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, l_orderkey % 10 AS m, -l_linenumber AS neg FROM lineitem")
sql_query("cast_values", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS d, CAST(p_partkey AS VARCHAR(20)) AS s, CAST(p_retailprice AS BIGINT) - CAST(floor(p_retailprice) AS BIGINT) IN (0, 1) AS near FROM part", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS d, CAST(p_partkey AS VARCHAR) AS s, CAST(p_retailprice AS BIGINT) - CAST(floor(p_retailprice) AS BIGINT) IN (0, 1) AS near FROM part")
sql_query("try_cast", "SELECT event_id, try_cast(get_json_object(props, '$.k') AS BIGINT) AS k, try_cast(event_type AS BIGINT) AS none FROM events", "SELECT event_id, try_cast(props->>'k' AS BIGINT) AS k, try_cast(event_type AS BIGINT) AS none FROM events")
sql_query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")

# Joins and subqueries
sql_query("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 250000")
sql_query("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey")
sql_query("join_right", "SELECT n.n_name, s.s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
sql_query("join_full", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey AND c.c_nationkey <> s.s_nationkey")
sql_query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql_query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql_query("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE r.r_regionkey <> n.n_regionkey")
sql_query("join_using", "SELECT a.n_name, b.n_name AS other FROM nation a JOIN (SELECT n_regionkey, n_name FROM nation) b USING (n_regionkey)")
sql_query("join_multiway_star", "SELECT r.r_name, n.n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 0) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name")
sql_query("join_residual", "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate AND l.l_quantity > 40")
sql_query("subquery_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
sql_query("subquery_not_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql_query("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
sql_query("subquery_correlated_scalar", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT avg(l_quantity) + 15 FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
sql_query("join_post_aggregate", "SELECT n.n_name, CAST(sum(CASE WHEN c.c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rich FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING count(*) > 3")


@query("join_theta_range", "SELECT p.p_partkey, b.lo FROM part p JOIN (SELECT * FROM (VALUES (900.0, 1000.0), (950.0, 1200.0), (1500.0, 1501.0)) v(lo, hi)) b ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi")
def _(t):
    bands = t.spark.sql("SELECT double(lo) AS lo, double(hi) AS hi FROM VALUES (900.0D, 1000.0D), (950.0D, 1200.0D), (1500.0D, 1501.0D) AS v(lo, hi)")
    return R.range_join(t.part, bands, "p_retailprice", "lo", "hi", width=50.0).select("p_partkey", F.col("lo").cast("decimal(5,1)").alias("lo"))


@query("lateral_topk", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c, LATERAL (SELECT * FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o")
def _(t):
    return R.lateral_topk(t.customer, t.orders, "c_custkey", "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("c_custkey", "o_orderkey", "o_totalprice")


@query("lateral_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN LATERAL (SELECT * FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) o ON true")
def _(t):
    return R.lateral_topk(t.customer, t.orders, "c_custkey", "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")], 1, how="left").select("c_custkey", "o_orderkey")


@query("join_null_safe", "SELECT a.k, b.v FROM (SELECT nullif(n_regionkey, 0) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 0) AS k, r_name AS v FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
def _(t):
    a = t.nation.select(F.nullif("n_regionkey", F.lit(0)).alias("k"))
    b = t.region.select(F.nullif("r_regionkey", F.lit(0)).alias("j"), F.col("r_name").alias("v"))
    return a.join(b, F.col("k").eqNullSafe(F.col("j"))).select("k", "v")


# Aggregation
sql_query("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, min(l_shipdate) AS first_ship, max(l_discount) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_query("agg_global", "SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
sql_query("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey % 100) AS BIGINT) AS s FROM orders GROUP BY o_orderpriority")
sql_query("agg_filter_having", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql_query("agg_expression", "SELECT l_linenumber, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS s, round(coalesce(sum(l_tax), 0) / count(*), 6) AS tax FROM lineitem GROUP BY l_linenumber")
sql_query("agg_group_by_expression", "SELECT o_orderkey % 5 AS k, count(*) AS n FROM orders GROUP BY o_orderkey % 5")
sql_query("agg_group_by_ordinal", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
sql_query("agg_stddev_variance", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 5) AS vp, round(var_samp(l_quantity), 5) AS vs FROM lineitem GROUP BY l_returnflag")
sql_query("agg_percentile", "SELECT l_returnflag, percentile(l_quantity, 0.5) AS p50, round(percentile(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
sql_query("agg_corr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY l_returnflag")
sql_query("agg_string_array", "SELECT r_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names, CAST(array_size(array_sort(collect_list(n_name))) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(len(list(n_name)) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
sql_query("agg_first_last_by_time", "SELECT user_id, min_by(value, struct(ts, event_id)) AS first_value, max_by(value, struct(ts, event_id)) AS last_value FROM events GROUP BY user_id", "SELECT user_id, first(value ORDER BY ts, event_id) AS first_value, last(value ORDER BY ts, event_id) AS last_value FROM events GROUP BY user_id")
sql_query("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql_query("cube", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
sql_query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql_query("agg_approx_distinct_small", "SELECT o_orderpriority, approx_count_distinct(o_orderstatus) AS n FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_orderpriority")


@query("agg_sub_groups", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS of_status FROM orders GROUP BY o_orderstatus, o_orderpriority")
def _(t):
    return R.sub_groups(t.orders, ["o_orderstatus"], ["o_orderpriority"], "n", "of_status")


@query("agg_mergeable_sketches", "SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS days, true AS users_near, true AS median_near, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.45), 4) AS lo, round(quantile_cont(value, 0.55), 4) AS hi FROM events GROUP BY 1")
def _(t):
    """Partial sketches by day, merged by event type: distinct users and a median."""
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id").alias("users"), F.kll_sketch_agg_double("value").alias("values"))
    merged = daily.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("guess"), F.expr("kll_sketch_get_quantile_double(kll_merge_agg_double(values), 0.5D)").alias("median"), F.count("*").alias("days"))
    exact = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", F.lit(0.45)).alias("lo"), F.percentile("value", F.lit(0.55)).alias("hi"))
    both = merged.join(exact, "event_type")
    return both.select("event_type", "days", (F.abs(F.col("guess") - F.col("users")) <= 0.05 * F.col("users")).alias("users_near"), F.col("median").between(F.col("lo"), F.col("hi")).alias("median_near"), "users", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("agg_approx_topk", "SELECT event_type AS item, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(t):
    return t.events.groupBy().agg(F.expr("approx_top_k(event_type, 3)").alias("top")).select(F.explode("top").alias("x")).select("x.item", "x.count")


@query("balance_as_of", "SELECT o_custkey, round(sum(o_totalprice) - sum(CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN o_totalprice ELSE 0 END), 2) AS balance FROM orders GROUP BY o_custkey")
def _(t):
    return R.balance_as_of(t.orders, ["o_custkey"], "o_totalprice", F.col("o_orderdate") > F.expr("TIMESTAMP_NTZ '1998-01-01'")).select("o_custkey", F.round("balance", 2).alias("balance"))


# Windows and frames
sql_query("window_ranking", "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM (SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey < 4000) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)")
sql_query("window_ntile", "SELECT c_custkey, CAST(ntile(7) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INT) AS t FROM customer")
sql_query("window_lag_lead", "SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER w AS before, lead(o_totalprice, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "SELECT o_orderkey, lag(o_totalprice, 1, CAST(0.0 AS DOUBLE)) OVER w AS before, lead(o_totalprice, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql_query("window_first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
sql_query("window_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events")
sql_query("window_range_frame", "SELECT l_orderkey, l_linenumber, CAST(count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS n FROM lineitem")
sql_query("window_default_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS peers, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders")


@query("window_groups_frame", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n FROM orders")
def _(t):
    return R.groups_frame(t.orders, ["o_custkey"], [F.col("o_orderpriority")], -1, 1, {"n": F.count("*")}).select("o_orderkey", "n")


@query("window_ntile_even", "SELECT c_custkey, CAST(floor((row_number() OVER w - 1) * 5 / count(*) OVER (PARTITION BY c_nationkey)) AS BIGINT) + 1 AS t FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def _(t):
    return t.customer.select("c_custkey", R.ntile_even(5, ["c_nationkey"], [F.col("c_custkey")]).alias("t"))


# Order, sets, recursion
sql_query("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
sql_query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
sql_query("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql_query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
sql_query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql_query("recursive_sequence", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 40) SELECT n FROM s")


@query("recursive_tree", "WITH RECURSIVE c(child, depth) AS (SELECT 1, 0 UNION SELECT n_nationkey, depth + 1 FROM nation JOIN c ON n_regionkey = child AND n_nationkey > child WHERE depth < 20) SELECT DISTINCT child FROM c")
def _(t):
    edges = t.nation.filter("n_nationkey > n_regionkey").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child"))
    seed = t.spark.sql("SELECT 1 AS child")
    return R.reachable(seed, edges, "child", "parent", "child")


@query("tree_sum", "WITH RECURSIVE c(child) AS (SELECT 0 UNION SELECT n_nationkey FROM nation JOIN c ON n_regionkey = child AND n_nationkey > child) SELECT round(sum(s_acctbal), 2) AS total FROM supplier WHERE s_nationkey IN (SELECT child FROM c)")
def _(t):
    edges = t.nation.filter("n_nationkey > n_regionkey").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child"))
    below = R.reachable(t.spark.sql("SELECT 0 AS child"), edges, "child", "parent", "child")
    return t.supplier.join(below, F.col("s_nationkey") == F.col("child"), "left_semi").agg(F.round(F.sum("s_acctbal"), 2).alias("total"))


# Table functions
@query("facet_counts", "SELECT * FROM (SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_totalprice > 100000 GROUP BY 2)")
def _(t):
    return R.facet_counts(t.orders.filter("o_totalprice > 100000"), ["o_orderstatus", "o_orderpriority"], 10)


@query("weighted_pick", "SELECT p_partkey, p_size FROM part WHERE p_size > 0 ORDER BY -ln((('0x' || substr(md5('7.0|' || p_partkey), 1, 13))::BIGINT + 1) * pow(2.0::DOUBLE, -52)) / p_size LIMIT 10")
def _(t):
    return R.weighted_pick(t.part.select("p_partkey", "p_size"), "p_size", 10, seed=7, keys=["p_partkey"])


@query("point_get", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def _(t):
    return t.get("orders", o_orderkey=77).select("o_orderkey", "o_totalprice")


@query("estimate_count", "SELECT count(DISTINCT o_custkey) AS n, true AS near FROM orders")
def _(t):
    """The estimate is within a twentieth, which is over two of its standard errors."""
    # apart, as one aggregation of both keeps the estimate's registers for each different key
    exact = t.orders.select("o_custkey").distinct().agg(F.count("o_custkey").alias("n"))
    both = t.orders.agg(F.approx_count_distinct("o_custkey", 0.02).alias("estimate")).join(F.broadcast(exact))  # one row
    return both.select("n", (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("near"))


# Further forms
@query("lateral_aggregate", "SELECT c.c_custkey, x.n, x.most FROM customer c, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS most FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 10) x")
def _(t):
    """Orders meet their customer by key, and are combined before the customers' rows get them: Spark plans the
    subquery's comparison with the outer row as a nested loop."""
    own = t.customer.select("c_custkey", "c_acctbal")
    hits = t.orders.join(own.distinct(), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 10))
    hits = hits.groupBy("c_custkey", "c_acctbal").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    return own.join(hits, ["c_custkey", "c_acctbal"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "most")


sql_query("join_natural", "SELECT n_name, n FROM nation NATURAL JOIN (SELECT n_nationkey, count(*) AS n FROM nation GROUP BY n_nationkey) x")
sql_query("join_comma", "SELECT r_name, count(*) AS n FROM region, nation WHERE r_regionkey = n_regionkey GROUP BY r_name")
sql_query("subquery_not_exists", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
sql_query("agg_distinct_forms", "SELECT l_returnflag, round(avg(DISTINCT l_quantity), 6) AS a, CAST(array_size(collect_set(l_linenumber)) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(avg(DISTINCT l_quantity), 6) AS a, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_returnflag")
sql_query("typed_literals", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1997-03-01' AND o_orderdate < DATE '1997-04-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < DATE '1997-04-01'")
sql_query("type_of", "SELECT DISTINCT typeof(n_name) AS a, typeof(n_nationkey) AS b FROM nation", "SELECT DISTINCT 'string' AS a, 'int' AS b FROM nation")
