"""Structured Streaming over folders of files: tumbling, sliding and session windows, late-data
policies, keyed streaming views, change feeds, alerts, sinks.

Everything keeps its state in the query's checkpoint, so a restarted query goes on where it
was; sinks of ``foreachBatch`` are idempotent by batch number."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.shared import fresh_path


def file_stream(spark: SparkSession, folder: str, schema, name: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a folder as a stream."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def run_available(df: DataFrame, mode: str, name: str = "view", batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all that is there now; its rows as a table of the shared folder.

    mode: append, complete or update.  update keeps each batch's changed rows with their batch
    number in ``_batch``; complete keeps the last batch."""
    spark = df.sparkSession
    base = fresh_path(spark, "run")
    out = f"{base}/{name}"
    schema = df.schema
    w = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode)
    if batch is not None:
        q = w.foreachBatch(batch).start()
    elif mode == "append":
        q = w.format("parquet").option("path", out).start()
    elif mode == "complete":
        q = w.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).start()
    else:
        q = w.foreachBatch(lambda b, n: b.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n:06d}")).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if batch is not None:
        return spark.createDataFrame([], schema)
    if mode == "update":
        return spark.read.option("recursiveFileLookup", True).schema(T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(out)
    return spark.read.schema(schema).parquet(out)


def tumbling(events: DataFrame, ts: str, window: str, keys: list[str], value: str, late: str | None = "1 hour", slide: str | None = None) -> DataFrame:
    """count, sum, min, max and avg by window and keys; rows later than ``late`` are dropped, or with
    None every row counts and state is kept for all windows (the ALLOW policy).  ts: a timestamp."""
    e = events if late is None else events.withWatermark(ts, late)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = e.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "lo", "hi", "mean")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def keyed_view(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """COUNT, SUM, MIN, MAX and AVG per key over a stream; run in update or complete mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))


def deduplicated(events: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def alerts(events: DataFrame, key: str, ts: str, value: str, fire: float, clear: float) -> DataFrame:
    """Alerts with hysteresis: a key fires when its value reaches ``fire`` and clears when it falls
    to ``clear``; (key, at, state) at each turn.  State is one flag a key.  A batch's rows of a
    key are read in time order."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values([ts, value])
        out = []
        for at, v in zip(rows[ts], rows[value], strict=True):
            if not on and v >= fire:
                on = True
                out.append((k[0], at, "firing"))
            elif on and v <= clear:
                on = False
                out.append((k[0], at, "resolved"))
        state.update((on,))
        yield pd.DataFrame(out, columns=[key, "at", "state"])

    kind = events.schema[key].dataType.simpleString()
    stamp = events.schema[ts].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at {stamp}, state string", "on boolean", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row of each key in versions of a table; a batch
    that runs again writes the same version again."""

    def sink(batch: DataFrame, n: int) -> None:
        from sparkloom.operators.dml import newest

        spark = batch.sparkSession
        rows = batch
        if n > 0 and (before := read_version(spark, path, n - 1)) is not None:
            rows = batch.unionByName(before)
        newest(rows, key, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/v{n:08d}")

    return sink


def read_version(spark: SparkSession, path: str, n: int | None = None) -> DataFrame | None:
    """A version written by upsert_sink: the n-th, or the last; older ones if it has none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    names = sorted(f.getPath().getName() for f in fs.listStatus(at))
    names = [x for x in names if x[0] == "v" and (n is None or int(x[1:]) <= n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def signed(payload: dict, secret: bytes) -> tuple[bytes, str]:
    """Body and HMAC-SHA256 signature of a webhook's event."""
    body = json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str).encode()
    return body, hmac.new(secret, body, hashlib.sha256).hexdigest()


def webhook_sink(send: Callable[[bytes, str, str], None], secret: bytes, retries: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: send(body, signature, delivery id) for each row, on the executors, again
    up to ``retries`` times.  The delivery id is the same when a batch runs again."""

    def sink(batch: DataFrame, n: int) -> None:
        def post(rows) -> None:
            for r in rows:
                body, signature = signed(r.asDict(recursive=True), secret)
                name = hashlib.sha256(f"{n}:".encode() + body).hexdigest()
                for attempt in range(retries + 1):
                    try:
                        send(body, signature, name)
                        break
                    except OSError:
                        if attempt == retries:
                            raise

        batch.foreachPartition(post)

    return sink


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: Column | None = None):
    """A change feed to Kafka (needs Spark's Kafka package): JSON values, starts the query."""
    rows = df.select(*([key.cast("string").alias("key")] if key is not None else []), F.to_json(F.struct(*df.columns)).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.enable.idempotence", "true").option("topic", topic).option("checkpointLocation", checkpoint).start()
