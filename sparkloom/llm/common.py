"""Helpers that the corpus operators share: where intermediate tables go, ranks
and joins that hold under skew, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.shared import fresh_path, shared_dir, written

__all__ = ["bounded_batches", "fresh_path", "map_texts", "read", "salted_join", "set_aside", "shared_dir", "two_level_rank", "written"]

#: Rows a single sort task of a two-level rank should get.
RANK_ROWS = 50_000


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """docs with its columns named _in0, _in1, .., which meet no name that an operator gives; the
    new names by the old; and the columns that give the old names back."""
    new = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new, [F.col(n).alias(c) for c, n in new.items()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Arrow batches to Python of at most so many rows and about so many bytes, so that very long
    texts don't add up in a worker.  Plans read the session's setting when they run, so it is only
    ever lowered: what one operator needs, a later one doesn't undo."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if size(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > mb << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def two_level_rank(df: DataFrame, parts: list[str], key: Column, order: list[Column], rows: int, out: str) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 within ``parts``, in which no task sorts
    a whole part.

    Rows are dealt to hash buckets of ``key`` (about RANK_ROWS rows each, were all
    rows one part); a bucket's offset is the count of the buckets before it, a row's
    rank its place in the bucket plus that offset.  Rows that tie in ``order`` share
    a bucket if ``order`` starts from ``key``; which of equal rows comes first is
    then of no consequence.  rows: the number of rows of df."""
    n = max(1, -(-rows // RANK_ROWS))
    by = [*parts, "_bucket"]
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)))
    before = Window.partitionBy(*parts).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*by).agg(F.count("*").alias("_n"))
    offsets = offsets.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = F.col(c).eqNullSafe(F.col(f"_k{i}")) & same
    joined = df.join(offsets, same, "inner").drop(*(f"_k{i}" for i in range(len(by))))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1
    return joined.withColumn(out, F.col("_before") + place).drop("_before", "_bucket")


def salted_join(big: DataFrame, small: DataFrame, key: str, count: str, rows: int, spread: Column, parts: int = 64) -> DataFrame:
    """big left join small on key, for a key that may hold a third of big's rows.

    small has one row per key with the key's rows in big as ``count``.  Keys with
    over rows/200 rows (at most 200 of them, so they may be broadcast) are spread
    over ``parts`` salts by the hash of ``spread``, and small's row is copied for
    each.  One pass over big, no row lost."""
    limit = max(1, rows // 200)
    hot = small.filter(F.col(count) > limit).select(F.col(key).alias("_hot"))
    big = big.join(F.broadcast(hot), big[key] == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    big = big.withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col(count) > limit, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    small = small.withColumn("_salt", F.explode(salts))
    return big.join(small, [key, "_salt"], "left").drop("_salt")


def map_texts(docs: DataFrame, change, schema: T.StructType | None = None) -> DataFrame:
    """docs with each Arrow batch passed to change(batch) -> batch; columns other than those it
    changes keep their types and values.  schema: the result's, if it isn't docs'."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield change(b)

    return docs.mapInArrow(run, schema or docs.schema)
