"""Files and protocols, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.shared import fresh_path
from sparkloom.sources import files as C
from sparkloom.sources import protocols as L


def place(t, ending: str) -> str:
    return fresh_path(t.spark, f"copy.{ending}")


ROWS = "SELECT c_custkey, c_name, c_acctbal FROM customer"
SCHEMA = "c_custkey long, c_name string, c_acctbal double"


def _copied(ending: str):
    def plan(t):
        path = place(t, ending)
        C.copy_to(t.customer.select("c_custkey", "c_name", "c_acctbal"), path)
        return C.copy_from(t.spark, path, SCHEMA)

    query(f"copy_{ending}", ROWS)(plan)


for _ending in ("ndjson", "csv", "parquet", "orc"):
    _copied(_ending)


@query("copy_json_array", "SELECT r_regionkey, r_name FROM region")
def _(t):
    path = place(t, "json")
    text = t.region.agg(F.to_json(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))).alias("value"))
    text.coalesce(1).write.text(path)
    return C.copy_from(t.spark, path, "r_regionkey int, r_name string", format="json")


@query("insert_object_literals", "SELECT * FROM (VALUES (1, 'it''s', 2.5::DOUBLE), (2, 'b: c', NULL)) v(id, name, score)")
def _(t):
    return C.from_objects(t.spark, "[{id: 1, name: 'it''s', score: 2.5}, {id: 2, name: 'b: c'}]", "id int, name string, score double")


@query("cold_tier_scan", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-08'")
def _(t):
    path = place(t, "parquet")
    C.cold_tier(t.events.select("event_id", "ts", "value"), path, "ts")
    return C.cold_scan(t.spark, path, "ts", F.expr("TIMESTAMP_NTZ '2024-01-05 06:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-08'")).select("event_id", "value")


@query("line_protocol", "SELECT CAST(user_id AS VARCHAR) AS user, event_type AS type, value, epoch_us(ts) AS us FROM events")
def _(t):
    lines = L.to_line_protocol(t.events.select("user_id", "event_type", "value", "ts", F.col("user_id").alias("u"), F.col("event_type").alias("type")), "events", ["u", "type"], ["value"], "ts")
    p = L.line_protocol(lines)
    return p.select(F.col("tags")["u"].alias("user"), F.col("tags")["type"].alias("type"), F.col("number").alias("value"), F.expr("ts div 1000").alias("us"))


@query("ingest_dedup", "SELECT event_id FROM events WHERE event_type <> 'view'")
def _(t):
    batch = t.events.unionByName(t.events).select("event_id")
    return L.append_unique(batch, t.events.filter("event_type = 'view'"), ["event_id"]).select("event_id")


@query("prometheus_text", "SELECT 'acct' AS metric, c_mktsegment AS segment, c_acctbal AS value, c_custkey AS ts FROM customer")
def _(t):
    line = F.format_string('acct{segment="%s",x="a,b"} %s %d', "c_mktsegment", F.col("c_acctbal").cast("string"), "c_custkey")
    p = L.prometheus_text(t.customer.select(line.alias("value")))
    return p.select("metric", F.col("labels")["segment"].alias("segment"), "value", "ts")
