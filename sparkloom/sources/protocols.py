"""Text protocols as tables, parsed by Column expressions: InfluxDB line protocol, Prometheus
text and JSON samples, OTLP logs, metrics and traces in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNESCAPED = r"(?<!\\)"


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([,= \\])", "$1")


def _pairs(text: Column) -> Column:
    """k=v,k2=v2 with backslash escapes to an array of struct(key, value)."""
    parts = F.filter(F.split(text, _UNESCAPED + ","), lambda p: p != "")
    split = F.transform(parts, lambda p: F.split(p, _UNESCAPED + "=", 2))
    return F.transform(split, lambda p: F.named_struct(F.lit("key"), _plain(p[0]), F.lit("value"), p[1]))


def line_protocol(lines: DataFrame, column: str = "value") -> DataFrame:
    """measurement, tags (map), field, number, text, flag, ts (nanoseconds, null if none): a row for
    each field of a line ``m,tag=v f=1.0,g=2i,s="x",b=t ts``; comments and empty lines are left
    out.  A space or comma inside a quoted value is part of it."""
    c = F.trim(F.col(column))
    lines = lines.filter((c != "") & ~c.startswith("#")).select(c.alias("_l"))
    head = r'^((?:\\.|[^ \\])+) +((?:"(?:\\.|[^"\\])*"|\\.|[^ "\\])+)(?: +(-?\d+))?$'
    part = lambda i: F.regexp_extract("_l", head, i)
    p = lines.select(part(1).alias("_h"), part(2).alias("_f"), F.nullif(part(3), F.lit("")).cast("long").alias("ts"), "_l")
    p = p.filter(F.when(F.col("_h") == "", F.raise_error(F.concat(F.lit("no line protocol: "), F.col("_l"))).cast("boolean")).otherwise(F.lit(True)))
    measurement = _plain(F.regexp_extract("_h", r"^((?:\\.|[^,\\])+)", 1))
    tags = F.map_from_entries(F.transform(_pairs(F.regexp_replace("_h", r"^(?:\\.|[^,\\])+,?", "")), lambda x: F.named_struct(F.lit("key"), x["key"], F.lit("value"), _plain(x["value"]))))
    fields = F.regexp_extract_all("_f", F.lit(r'((?:\\.|[^,=\\])+=(?:"(?:\\.|[^"\\])*"|[^,"]*))'), 1)
    rows = p.select(measurement.alias("measurement"), tags.alias("tags"), F.explode(fields).alias("_kv"), "ts")
    v = F.regexp_extract("_kv", r"(?s)^(?:\\.|[^=\\])+=(.*)$", 1)
    rows = rows.select("measurement", "tags", _plain(F.regexp_extract("_kv", r"^((?:\\.|[^=\\])+)=", 1)).alias("field"), v.alias("_v"), "ts")
    number = F.regexp_replace("_v", "[iu]$", "").try_cast("double")
    text = F.when(F.col("_v").startswith('"'), F.regexp_replace(F.expr("substring(_v, 2, length(_v) - 2)"), r'\\(["\\])', "$1"))
    flag = F.when(F.lower("_v").isin("t", "true"), F.lit(True)).when(F.lower("_v").isin("f", "false"), F.lit(False))
    return rows.select("measurement", "tags", "field", number.alias("number"), text.alias("text"), flag.alias("flag"), "ts")


def to_line_protocol(df: DataFrame, measurement: str, tags: list[str], fields: list[str], ts: str) -> DataFrame:
    esc = lambda c: F.regexp_replace(c.cast("string"), r"([,= ])", r"\\$1")
    head = F.concat_ws(",", F.lit(measurement), *(F.when(F.col(t).isNotNull(), F.concat(F.lit(t + "="), esc(F.col(t)))) for t in tags))
    body = F.concat_ws(",", *(F.when(F.col(f).isNotNull(), F.concat(F.lit(f + "="), F.col(f).cast("string"))) for f in fields))
    return df.select(F.concat_ws(" ", head, body, (F.unix_micros(F.col(ts).cast("timestamp")) * 1000).cast("string")).alias("value"))


def prometheus_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """metric, labels (map), value, ts (ms, null if none) of the exposition format."""
    c = F.trim(F.col(column))
    lines = lines.filter((c != "") & ~c.startswith("#")).select(c.alias("_l"))
    rx = r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})? +(\S+)(?: +(-?\d+))?$"
    part = lambda i: F.regexp_extract("_l", rx, i)
    pairs = F.regexp_extract_all(part(2), F.lit(r'(\w+="(?:\\.|[^"\\])*")'), 1)
    labels = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)=", 1), F.regexp_replace(F.regexp_extract(x, r'(?s)="(.*)"$', 1), r'\\(["\\])', "$1"))))
    value = F.when(part(3).isin("+Inf", "Inf"), F.lit(float("inf"))).when(part(3) == "-Inf", F.lit(float("-inf"))).otherwise(part(3).try_cast("double"))
    return lines.select(part(1).alias("metric"), labels.alias("labels"), value.alias("value"), F.nullif(part(4), F.lit("")).cast("long").alias("ts"))


def otlp_logs(spark: SparkSession, path: str) -> DataFrame:
    """time (ns), severity, body, service of log records in OTLP's JSON files."""
    record = "struct<timeUnixNano:string,severityText:string,body:struct<stringValue:string>>"
    attribute = "array<struct<key:string,value:struct<stringValue:string>>>"
    schema = f"resourceLogs array<struct<resource:struct<attributes:{attribute}>,scopeLogs:array<struct<logRecords:array<{record}>>>>>"
    r = spark.read.schema(schema).json(path).select(F.explode("resourceLogs").alias("r"))
    service = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")[0]["value"]["stringValue"]
    s = r.select(service.alias("service"), F.explode("r.scopeLogs").alias("s")).select("service", F.explode("s.logRecords").alias("l"))
    return s.select(F.col("l.timeUnixNano").cast("long").alias("time"), F.col("l.severityText").alias("severity"), F.col("l.body.stringValue").alias("body"), "service")


_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"


def _attributes(c: Column | str) -> Column:
    """Attributes as a map of texts."""
    own = F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast(_ATTRIBUTES))
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    return F.map_from_entries(F.transform(own, lambda a: F.struct(a["key"], text(a["value"]))))


def _resources(spark: SparkSession, path: str, outer: str, scopes: str, inner: str, item: str) -> DataFrame:
    """service and each item (i) of OTLP's JSON files."""
    schema = f"{outer} array<struct<resource:struct<attributes:{_ATTRIBUTES}>,{scopes}:array<struct<{inner}:array<{item}>>>>>"
    r = spark.read.schema(schema).json(path).select(F.explode(outer).alias("r"))
    s = r.select(_attributes("r.resource.attributes")["service.name"].alias("service"), F.explode(f"r.{scopes}").alias("s"))
    return s.select("service", F.explode(f"s.{inner}").alias("i"))


def otlp_metrics(spark: SparkSession, path: str) -> DataFrame:
    """service, metric, kind, labels, time (ns), value of the points in OTLP's JSON metric files: gauges and
    sums as they are, histograms as the samples _count, _sum and _bucket (cumulative, label le)."""
    point = f"struct<timeUnixNano:string,asDouble:double,asInt:string,attributes:{_ATTRIBUTES}>"
    histogram = f"struct<timeUnixNano:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,attributes:{_ATTRIBUTES}>"
    item = f"struct<name:string,gauge:struct<dataPoints:array<{point}>>,sum:struct<dataPoints:array<{point}>>,histogram:struct<dataPoints:array<{histogram}>>>"
    m = _resources(spark, path, "resourceMetrics", "scopeMetrics", "metrics", item)
    out = []
    for kind in ("gauge", "sum"):
        p = m.select("service", F.col("i.name").alias("metric"), F.explode(f"i.{kind}.dataPoints").alias("p"))
        value = F.coalesce(F.col("p.asDouble"), F.col("p.asInt").cast("double"))
        out.append(p.select("service", "metric", F.lit(kind).alias("kind"), _attributes("p.attributes").alias("labels"), F.col("p.timeUnixNano").cast("long").alias("time"), value.alias("value")))
    p = m.select("service", F.col("i.name").alias("metric"), F.explode("i.histogram.dataPoints").alias("p")).withColumn("labels", _attributes("p.attributes"))
    counts = F.transform("p.bucketCounts", lambda c: c.cast("double"))
    le = lambda i: F.coalesce(F.get(F.col("p.explicitBounds"), i).cast("string"), F.lit("+Inf"))
    upto = lambda i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x)
    buckets = F.transform(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: F.struct(F.lit("_bucket").alias("part"), F.map_from_arrays(F.array(F.lit("le")), F.array(le(i))).alias("more"), upto(i).alias("value")))
    none = F.create_map().cast("map<string,string>")
    ends = F.array(F.struct(F.lit("_count").alias("part"), none.alias("more"), F.col("p.count").cast("double").alias("value")), F.struct(F.lit("_sum").alias("part"), none.alias("more"), F.col("p.sum").alias("value")))
    h = p.select("service", "metric", "labels", F.col("p.timeUnixNano").cast("long").alias("time"), F.explode(F.concat(ends, buckets)).alias("x"))
    out.append(h.select("service", F.concat("metric", "x.part").alias("metric"), F.lit("histogram").alias("kind"), F.map_concat("labels", "x.more").alias("labels"), "time", "x.value"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def otlp_traces(spark: SparkSession, path: str) -> DataFrame:
    """service, trace, span, parent (null at a root), name, start and end (ns), status (0: unset, 1: ok, 2: error)
    and labels of the spans in OTLP's JSON trace files."""
    item = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>,attributes:{_ATTRIBUTES}>"
    s = _resources(spark, path, "resourceSpans", "scopeSpans", "spans", item)
    at = lambda c: F.col(c).cast("long")
    return s.select("service", F.col("i.traceId").alias("trace"), F.col("i.spanId").alias("span"), F.nullif(F.col("i.parentSpanId"), F.lit("")).alias("parent"), F.col("i.name").alias("name"), at("i.startTimeUnixNano").alias("start"), at("i.endTimeUnixNano").alias("end"), F.coalesce("i.status.code", F.lit(0)).alias("status"), _attributes("i.attributes").alias("labels"))


def append_unique(batch: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows of an ingest batch that the table doesn't have, by sequence number or key."""
    return batch.dropDuplicates(key).join(table.select(*key), key, "left_anti")
