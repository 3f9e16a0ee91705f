"""COPY: files as tables, tables as files; rows from literals."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"ndjson": "ndjson", "jsonl": "ndjson", "json": "json", "csv": "csv", "tsv": "csv", "parquet": "parquet", "orc": "orc", "avro": "avro", "txt": "text"}


def format_of(path: str) -> str:
    """The format that a path's ending tells; compression endings don't count."""
    name = re.sub(r"\.(gz|bz2|zst|lz4|snappy)$", "", path.rstrip("/").rsplit("/", 1)[-1].lower())
    ending = name.rpartition(".")[2]
    if ending not in FORMATS:
        raise ValueError(f"no format is known for {path!r}")
    return FORMATS[ending]


def copy_from(spark: SparkSession, path: str, schema: str | T.StructType | None = None, format: str | None = None, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """A file or folder as a table.  Without a schema, JSON and CSV are read twice to find one.
    Lines that don't fit the schema are an error."""
    kind = format or format_of(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "ndjson":
        return reader.option("mode", "FAILFAST").json(path)
    if kind == "json":  # an array of objects; such a file is read whole, by one task
        return reader.option("mode", "FAILFAST").option("multiLine", True).json(path)
    if kind == "csv":
        reader = reader.option("mode", "FAILFAST").option("header", header).option("sep", delimiter or ("\t" if path.endswith("tsv") else ","))
        return (reader if schema is not None else reader.option("inferSchema", True)).option("escape", '"').option("multiLine", False).csv(path)
    return reader.format(kind).load(path)


def copy_to(df: DataFrame, path: str, format: str | None = None, delimiter: str = ",", header: bool = True, partition_by: Iterable[str] = (), sort_by: Iterable[str] = (), mode: str = "error") -> None:
    """A table as files, a file for each task.  sort_by: the order within files, by which later
    reads skip row groups."""
    kind = format or format_of(path)
    parts, order = list(partition_by), list(sort_by)
    if order:
        df = (df.repartition(*parts) if parts else df).sortWithinPartitions(*parts, *order)
    w = df.write.mode(mode).partitionBy(*parts) if parts else df.write.mode(mode)
    if kind in ("ndjson", "json"):
        w.option("ignoreNullFields", False).json(path)
    elif kind == "csv":
        w.option("header", header).option("sep", delimiter).option("escape", '"').csv(path)
    else:
        w.format(kind).save(path)


def from_objects(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """Rows of an object literal {a: 1, b: 'x'} or a batch [{..}, {..}] with bare keys."""
    quoted = re.sub(r"'((?:[^'\\]|'')*)'", lambda m: json.dumps(m[1].replace("''", "'")), text)
    parts = re.split(r'("(?:[^"\\]|\\.)*")', quoted)
    parts[::2] = [re.sub(r"([A-Za-z_]\w*)\s*:", r'"\1":', p) for p in parts[::2]]
    rows = json.loads("".join(parts))
    rows = rows if isinstance(rows, list) else [rows]
    fields = spark.createDataFrame([], schema).schema
    if unknown := {k for r in rows for k in r} - set(fields.names):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


def cold_tier(df: DataFrame, path: str, ts: str, unit: str = "day", sort_by: Iterable[str] = ()) -> None:
    """Rows to a Parquet archive with a folder for each day, hour or month, in time order within
    files; s3a:// and other stores work alike."""
    dated = df.withColumn(f"_{unit}", F.date_format(F.date_trunc(unit, ts), {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH", "month": "yyyy-MM"}[unit]))
    copy_to(dated, path, "parquet", partition_by=[f"_{unit}"], sort_by=[ts, *sort_by], mode="append")


def cold_scan(spark: SparkSession, path: str, ts: str, start, end, unit: str = "day") -> DataFrame:
    """Rows of [start, end) from an archive; folders outside are never listed into the scan."""
    form = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH", "month": "yyyy-MM"}[unit]
    df = spark.read.option("recursiveFileLookup", False).parquet(path)
    folder = F.col(f"_{unit}").cast("string")
    return df.filter((folder >= F.date_format(start, form)) & (folder <= F.date_format(end, form)) & (F.col(ts) >= start) & (F.col(ts) < end)).drop(f"_{unit}")
