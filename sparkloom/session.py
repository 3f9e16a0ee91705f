"""SparkSession with the settings the library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A session in this process, for tests and benchmarks; on a cluster, pass SETTINGS
    to spark-submit and leave the shuffle partitions to the cluster's size."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sparkloom").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
