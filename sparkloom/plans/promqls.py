"""PromQL over events: a series for each user and type."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.promql import query_range, shown

START, END, STEP = 1_704_153_600_000, 1_706_486_400_000, 43_200_000  # from 2024-01-02, every 12 hours
RANGE = 86_400_000


def samples(t):
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    return t.events.select(F.lit("value").alias("metric"), labels.alias("labels"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "value")


#: Windows of a day before each step, a row for each sample
W = f"""e AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS ty, epoch_us(ts) // 1000 AS t, value AS v, event_id FROM events),
s AS (SELECT CAST({START} + i * {STEP} AS BIGINT) AS step FROM range({(END - START) // STEP + 1}) x(i)),
w AS (SELECT s.step, e.* FROM s JOIN e ON e.t > s.step - {RANGE} AND e.t <= s.step)"""
UT = "'type=\"' || ty || '\",user=\"' || u || '\"'"
TY = "'type=\"' || ty || '\"'"


def add(name, promql, sql, digits=6, lookback=300_000):
    def plan(t):
        out = query_range(samples(t), promql, START, END, STEP, lookback)
        return out.select(shown("labels").alias("labels"), "step", F.round("value", digits).alias("value"))

    query(name, sql)(plan)


def over_time(f, sql, digits=6):
    add(f"promql_{f}", f"{f}(value[1d])", f"WITH {W} SELECT {UT} AS labels, step, round({sql}, {digits}) AS value FROM w GROUP BY ty, u, step", digits)


over_time("sum_over_time", "sum(v)", 4)
over_time("avg_over_time", "avg(v)")
over_time("min_over_time", "min(v)")
over_time("max_over_time", "max(v)")
over_time("count_over_time", "count(*)::DOUBLE")
over_time("last_over_time", "max_by(v, t)")
add("promql_stddev_over_time", "stddev_over_time(value[1d])", f"WITH {W} SELECT {UT} AS labels, step, round(stddev_pop(v), 5) AS value FROM w GROUP BY ty, u, step HAVING count(*) >= 2", 5)
add("promql_quantile_over_time", "quantile_over_time(0.9, value[1d])", f"WITH {W} SELECT {UT} AS labels, step, round(quantile_cont(v, 0.9), 6) AS value FROM w GROUP BY ty, u, step")
add("promql_delta", "delta(value[1d])", f"WITH {W} SELECT {UT} AS labels, step, round(max_by(v, t) - min_by(v, t), 6) AS value FROM w GROUP BY ty, u, step HAVING count(*) >= 2")
add("promql_deriv", "deriv(value[1d])", f"WITH {W} SELECT {UT} AS labels, step, round(regr_slope(v, (t - step) / 1000.0::DOUBLE), 6) AS value FROM w GROUP BY ty, u, step HAVING count(DISTINCT t) >= 2")

_GROWN = f"{W}, d AS (SELECT *, lag(v) OVER p AS pv, count(*) OVER q AS n, max(t) OVER q - min(t) OVER q AS span FROM w WINDOW p AS (PARTITION BY ty, u, step ORDER BY t, v), q AS (PARTITION BY ty, u, step))"
add("promql_rate", "rate(value[1d])", f"WITH {_GROWN} SELECT {UT} AS labels, step, round(sum(CASE WHEN pv IS NULL THEN 0 WHEN v >= pv THEN v - pv ELSE v END) / (max(span) / 1000.0::DOUBLE), 8) AS value FROM d WHERE n >= 2 AND span > 0 GROUP BY ty, u, step", 8)
add("promql_rate_sum", "sum by (type) (rate(value[1d]))", f"WITH {_GROWN}, r AS (SELECT ty, u, step, sum(CASE WHEN pv IS NULL THEN 0 WHEN v >= pv THEN v - pv ELSE v END) / (max(span) / 1000.0::DOUBLE) AS value FROM d WHERE n >= 2 AND span > 0 GROUP BY ty, u, step) SELECT {TY} AS labels, step, round(sum(value), 8) AS value FROM r GROUP BY ty, step", 8)
add("promql_increase_without", "avg without (user) (increase(value{type=~\"click|view\"}[1d]))", f"WITH {_GROWN}, r AS (SELECT ty, u, step, sum(CASE WHEN pv IS NULL THEN 0 WHEN v >= pv THEN v - pv ELSE v END) AS value FROM d WHERE n >= 2 AND span > 0 AND ty IN ('click', 'view') GROUP BY ty, u, step) SELECT {TY} AS labels, step, round(avg(value), 6) AS value FROM r GROUP BY ty, step")
add("promql_resets_changes", "resets(value[1d]) + changes(value[1d])", f"WITH {_GROWN} SELECT {UT} AS labels, step, CAST(sum(CASE WHEN v < pv THEN 1 ELSE 0 END) + sum(CASE WHEN v <> pv THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM d GROUP BY ty, u, step")
add("promql_instant_lookback", "value", f"WITH e AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS ty, epoch_us(ts) // 1000 AS t, value AS v FROM events), s AS (SELECT CAST({START} + i * {STEP} AS BIGINT) AS step FROM range({(END - START) // STEP + 1}) x(i)) SELECT '__name__=\"value\",' || {UT} AS labels, step, max_by(v, t) AS value FROM s JOIN e ON e.t >= step - {RANGE} AND e.t <= step GROUP BY ty, u, step", lookback=RANGE)
add("promql_topk", "topk(2, max_over_time(value[1d]))", f"WITH {W}, m AS (SELECT {UT} AS labels, step, max(v) AS value FROM w GROUP BY ty, u, step) SELECT labels, step, value FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY value DESC, labels) AS r FROM m) WHERE r <= 2")
add("promql_binary_scalar_bool", "(sum(count_over_time(value[1d])) * 2 - 1) > bool 100", f"WITH {W} SELECT '' AS labels, step, CASE WHEN count(*) * 2 - 1 > 100 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM w GROUP BY step")
add("promql_matching_group_left", "sum by (type, user) (count_over_time(value[1d])) / on (type) group_left () sum by (type) (count_over_time(value[1d]))", f"WITH {W} SELECT {UT} AS labels, step, round(count(*) / sum(count(*)) OVER (PARTITION BY ty, step), 9) AS value FROM w GROUP BY ty, u, step", 9)
add("promql_set_operators", "count_over_time(value{type=\"view\"}[1d]) unless ignoring (type) count_over_time(value{type=\"error\"}[1d])", f"WITH {W} SELECT {UT} AS labels, step, count(*)::DOUBLE AS value FROM w WHERE ty = 'view' AND (u, step) NOT IN (SELECT u, step FROM w WHERE ty = 'error') GROUP BY ty, u, step")
add("promql_subquery_offset", "max_over_time(sum(count_over_time(value[1d] offset 12h))[2d:12h])", f"WITH {W}, c AS (SELECT step, count(*)::DOUBLE AS n FROM (SELECT s.i AS step FROM (SELECT CAST({START} + (i - 4) * {STEP} AS BIGINT) AS i FROM range({(END - START) // STEP + 5}) x(i)) s JOIN e ON e.t > s.i - {STEP} - {RANGE} AND e.t <= s.i - {STEP}) GROUP BY 1) SELECT '' AS labels, s.step, max(n) AS value FROM s JOIN c ON c.step > s.step - {2 * RANGE} AND c.step <= s.step GROUP BY s.step")
add("promql_label_functions", "label_replace(label_join(sum by (type) (count_over_time(value[1d])), \"j\", \"-\", \"type\", \"type\"), \"k\", \"<$1>\", \"j\", \"(.).*\")", f"WITH {W} SELECT 'j=\"' || ty || '-' || ty || '\",k=\"<' || ty[1] || '>\",' || {TY} AS labels, step, count(*)::DOUBLE AS value FROM w GROUP BY ty, step")
add("promql_absent", "absent(value{type=\"none\"})", f"SELECT 'type=\"none\"' AS labels, CAST({START} + i * {STEP} AS BIGINT) AS step, 1.0::DOUBLE AS value FROM range({(END - START) // STEP + 1}) x(i)")
add("promql_clamp_round_math", "round(clamp(sqrt(sum by (type) (sum_over_time(value[1d]))), 3, 40), 0.5)", f"WITH {W} SELECT {TY} AS labels, step, floor(greatest(3, least(40, sqrt(sum(v)))) / 0.5 + 0.5) * 0.5 AS value FROM w GROUP BY ty, step")
add("promql_count_values", "count_values(\"n\", sum by (user) (count_over_time(value[1d])))", f"WITH {W}, c AS (SELECT u, step, count(*) AS n FROM w GROUP BY 1, 2) SELECT 'n=\"' || n || '\"' AS labels, step, count(*)::DOUBLE AS value FROM c GROUP BY n, step")
add("promql_holt_winters", "holt_winters(value[1d], 0.5, 0.3)", f"WITH {W}, l AS (SELECT ty, u, step, list(v ORDER BY t, v) AS a FROM w GROUP BY ty, u, step), p AS (SELECT ty, u, step, list_transform(a, lambda x: struct_pack(v := x, l := x, b := coalesce(a[2] - a[1], 0.0::DOUBLE))) AS a FROM l) SELECT {UT} AS labels, step, round(list_reduce(a, lambda s, x: struct_pack(v := x.v, l := 0.5 * x.v + 0.5 * (s.l + s.b), b := 0.3 * (0.5 * x.v + 0.5 * (s.l + s.b) - s.l) + 0.7 * s.b)).l, 6) AS value FROM p")
add("promql_predict_linear_irate", "predict_linear(value[1d], 3600) + irate(value[1d])", f"WITH {W}, q AS (SELECT *, row_number() OVER (PARTITION BY ty, u, step ORDER BY t DESC, v DESC) AS r FROM w) SELECT {UT} AS labels, step, round(max_by(v, t) + 3600 * regr_slope(v, (t - step) / 1000.0::DOUBLE) + max(CASE WHEN r = 1 THEN v END - CASE WHEN r = 1 AND v >= v2 THEN v2 ELSE 0 END) / (max(CASE WHEN r = 1 THEN t - t2 END) / 1000.0::DOUBLE), 4) AS value FROM (SELECT *, lead(v) OVER o AS v2, lead(t) OVER o AS t2 FROM q WINDOW o AS (PARTITION BY ty, u, step ORDER BY r)) GROUP BY ty, u, step HAVING count(DISTINCT t) >= 2 AND max(CASE WHEN r = 1 THEN t - t2 END) > 0", 4)


@query("promql_histogram_quantile", """WITH b AS (SELECT l_returnflag AS f, le, count(*) FILTER (WHERE l_quantity <= le)::DOUBLE AS n FROM lineitem, (VALUES (10), (20), (30), (40), (50)) x(le) GROUP BY 1, 2),
r AS (SELECT f, le, n, coalesce(lag(n) OVER (PARTITION BY f ORDER BY le), 0) AS pn, coalesce(lag(le) OVER (PARTITION BY f ORDER BY le), 0) AS ple, 0.5 * max(n) OVER (PARTITION BY f) AS rank FROM b)
SELECT 'flag="' || f || '"' AS labels, round(ple + (le - ple) * (rank - pn) / (n - pn), 6) AS value FROM r WHERE n >= rank AND pn < rank""")
def _(t):
    from sparkloom.promql import query as instant

    les = F.explode(F.array(*(F.lit(x) for x in (10, 20, 30, 40, 50))))
    counts = t.lineitem.select("l_returnflag", "l_quantity", les.alias("le")).groupBy("l_returnflag", "le").agg(F.sum(F.when(F.col("l_quantity") <= F.col("le"), 1.0).otherwise(0.0)).alias("value"))
    labels = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("le"), F.col("le").cast("string"))
    s = counts.select(F.lit("q_bucket").alias("metric"), labels.alias("labels"), F.lit(1000).cast("long").alias("ts"), "value")
    return instant(s, "histogram_quantile(0.5, q_bucket)", 2000).select(shown("labels").alias("labels"), F.round("value", 6).alias("value"))
