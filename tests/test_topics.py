"""Topics, consumer groups, change streams and corrections."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from sparkloom.shared import shared_dir
from sparkloom.streaming import topics, views


@pytest.fixture
def base(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def test_groups_read_each_row_once(spark, base):
    t = topics.Topic(spark, base, "id long, body string")
    seen = {"a": [], "b": []}
    take = lambda g: lambda rows, n: seen[g].extend(r["id"] for r in rows.collect())
    t.publish(spark.createDataFrame([(1, "x"), (2, "y")], t.schema))
    t.consume("a", take("a"))
    t.publish(spark.createDataFrame([(3, "z")], t.schema))
    t.consume("a", take("a"))
    t.consume("b", take("b"))
    assert sorted(seen["a"]) == sorted(seen["b"]) == [1, 2, 3] and t.read().count() == 3


def test_change_streams(spark, base):
    t = topics.Topic(spark, base, topics.CHANGES)
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(1, "a2"), (3, "c")], "id long, v string")
    topics.record_changes(t, old, new, ["id"], ("insert", "update"))
    got = sorted(tuple(r)[:4] for r in t.read().collect())
    assert got == [("insert", '{"id":3}', None, '{"v":"c"}'), ("update", '{"id":1}', '{"v":"a"}', '{"v":"a2"}')]


def test_late_rows_correct_what_was_emitted(spark, base):
    def run(rows):
        spark.createDataFrame(rows, "k string, v long").write.mode("append").parquet(f"{base}/in")
        s = views.keyed_view(spark.readStream.schema("k string, v long").parquet(f"{base}/in"), ["k"], "v").select("k", "n", "total")
        s.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/cp").foreachBatch(topics.recomputing_sink(f"{base}/view", ["k"])).start().awaitTermination()

    run([("a", 1), ("b", 2)])
    run([("a", 5), ("c", 3)])
    out = spark.read.option("recursiveFileLookup", True).parquet(f"{base}/view/out")
    assert sorted(map(tuple, out.select("kind", "k", "total").collect())) == [("correction", "a", 6), ("result", "a", 1), ("result", "b", 2), ("result", "c", 3)]
    assert sorted(map(tuple, views.read_version(spark, f"{base}/view").select("k", F.col("total")).collect())) == [("a", 6), ("b", 2), ("c", 3)]
