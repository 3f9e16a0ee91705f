"""Durable topics, change streams and consumer groups over folders of the shared store.

A topic is a folder of Parquet batches; a consumer group is a streaming query's checkpoint, which
holds what the group has read.  Groups read independently, each row once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import dml
from sparkloom.streaming.views import read_version


@dataclass
class Topic:
    spark: SparkSession
    path: str
    schema: str

    def publish(self, rows: DataFrame) -> None:
        """PUBLISH: appends rows as one atomic batch."""
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("append").parquet(f"{self.path}/log")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(f"{self.path}/log")

    def consume(self, group: str, take: Callable[[DataFrame, int], None]) -> None:
        """What the group hasn't read yet, to take(rows, batch number); committed when take returns."""
        q = self.stream().writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.path}/groups/{group}").foreachBatch(take).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/log")


def record_changes(topic: Topic, before: DataFrame, after: DataFrame, key: list[str], ops: tuple[str, ...] = ("insert", "update", "delete")) -> None:
    """A change stream's events between two images of a table: op, key and values as JSON."""
    feed = dml.changes(before, after, key).filter(F.col("op").isin(*ops))
    topic.publish(feed.select("op", F.to_json(F.struct(*key)).alias("key"), F.to_json("old").alias("old"), F.to_json("new").alias("new"), F.current_timestamp().alias("at")))


CHANGES = "op string, key string, old string, new string, at timestamp"


def server_sent(feed: DataFrame, number: str, event: str, after: int | None = None) -> DataFrame:
    """A feed as server-sent events, ``value`` a text each, in order of ``number``: its id, its event and the other
    columns as JSON data.  after: the last id that a client has seen."""
    rest = [c for c in feed.columns if c not in (number, event)]
    rows = feed if after is None else feed.filter(F.col(number) > after)
    text = F.concat(F.lit("id: "), F.col(number).cast("string"), F.lit("\nevent: "), F.col(event), F.lit("\ndata: "), F.to_json(F.struct(*rest)), F.lit("\n\n"))
    return rows.orderBy(number).select(number, text.alias("value"))


def recomputing_sink(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for a view in update mode under the RECOMPUTE policy: a group that late
    rows change is emitted again, as a ``correction`` of what was emitted before.  Batches go
    to path/out with their number; the newest results are versions under path."""

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = read_version(spark, path, n - 1) if n else None
        known = before.select(*key).distinct().withColumn("_known", F.lit(True)) if before is not None else None
        rows = batch if known is None else batch.join(known, key, "left")
        kind = F.lit("result") if known is None else F.when(F.col("_known"), "correction").otherwise("result")
        rows.withColumn("kind", kind).select("kind", *batch.columns).write.mode("overwrite").parquet(f"{path}/out/batch={n:08d}")
        merged = batch if before is None else dml.upsert(before, batch, key)
        merged.write.mode("overwrite").parquet(f"{path}/v{n:08d}")

    return sink
