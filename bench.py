"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], those of the published baseline over as many rows as
its figures are of: prints one JSON line, best of 3 each."""

from __future__ import annotations

import json
import os
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3

#: Registered queries that stand for the operators' families
NAMES = (
    "agg_basic", "agg_distinct", "join_multiway_star", "subquery_correlated_scalar", "lateral_topk", "rollup", "window_ranking", "window_range_frame", "topk", "except",
    "ts_time_bucket_1h", "ts_time_bucket_5m_type", "ts_gap_fill_linear", "ts_moving_avg", "join_asof", "continuous_aggregate_incremental",
    "bm25_topk", "vector_topk_l2", "hybrid_rrf", "graph_bfs", "graph_triangles", "match_two_hops", "geo_near_join", "kv_leaderboard_rank", "array_elementwise", "merge_image", "promql_rate_sum",
)


#: Rows of the telemetry table, as many as the published figures are of
ROWS = int(os.environ.get("BENCH_ROWS", "10000000"))


def telemetry(spark, path: str):
    """ROWS rows of ts, qtype (5), rcode (4, one rare), cached, client (10,000), qname (50,000) and value."""
    from pyspark.sql import functions as F

    events = spark.read.parquet(path).select("event_id", "event_type", "ts", "value")
    copies = -(-ROWS // max(1, events.count()))
    many = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(max(8, int(CPUS)), "copy")
    h = lambda n, seed: F.pmod(F.xxhash64("event_id", "copy", F.lit(seed)), F.lit(n))
    rcode = F.when(h(50, 3) == 0, "SERVFAIL").when(h(50, 3) < 6, "NXDOMAIN").when(h(50, 3) < 8, "REFUSED").otherwise("NOERROR")
    name = F.concat(F.lit("host-"), h(50_000, 4).cast("string"), F.lit(".example.net"))
    ts = F.expr("ts + make_dt_interval(0, 0, 0, copy)")
    return many.select(ts.alias("ts"), F.col("event_type").alias("qtype"), rcode.alias("rcode"), (h(2, 5) == 0).alias("cached"), F.concat(F.lit("10.0."), h(100, 6).cast("string"), F.lit("."), h(100, 7).cast("string")).alias("client"), name.alias("qname"), "value")


def main() -> None:
    from pyspark.sql import functions as F

    from sparkloom import plans
    from sparkloom.operators.timeseries import time_bucket
    from sparkloom.session import local_session
    from sparkloom.shared import fresh_path

    spark = local_session(CPUS, partitions=max(8, int(CPUS)))
    # the published baseline's workload: ROWS rows of telemetry, made from events, and its ten queries
    began = time.perf_counter()
    path = fresh_path(spark, "telemetry")
    telemetry(spark, f"{FOLDER}/events.parquet").write.parquet(path)
    ingest = time.perf_counter() - began
    rows = spark.read.parquet(path)
    timed = {
        "count_all": lambda: rows.agg(F.count("*")),
        "where_type_count": lambda: rows.filter("qtype = 'click'").agg(F.count("*")),
        "where_rare_count": lambda: rows.filter("rcode = 'SERVFAIL'").agg(F.count("*")),
        "group_by_type": lambda: rows.groupBy("qtype").count(),
        "group_by_rcode": lambda: rows.groupBy("rcode").count(),
        "group_by_cached_avg": lambda: rows.groupBy("cached").agg(F.count("*"), F.avg("value")),
        "group_by_client_10k": lambda: rows.groupBy("client").count(),
        "group_by_name_50k": lambda: rows.groupBy("qname").count(),
        "time_bucket_1h": lambda: rows.groupBy(time_bucket("ts", 3600)).count(),
        "time_bucket_5m_type": lambda: rows.groupBy(time_bucket("ts", 300), "qtype").count(),
    }
    queries = plans.all_queries()
    for name in NAMES:
        timed[name] = lambda q=queries[name]: q(spark, FOLDER)
    seconds = {}
    for name, query in timed.items():
        runs = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs), 4)
    print(json.dumps({"metric": "sum of the best of 3 runs of each headline query", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows": ROWS, "ingest_seconds": round(ingest, 2), "ingest_rows_a_second": round(ROWS / ingest), "sf": os.path.basename(FOLDER.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
