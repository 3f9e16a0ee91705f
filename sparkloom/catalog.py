"""Tables of a folder, read lazily, and what is known of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass
class Collection:
    """A table's engine, key columns and time key, and the row filter that its readers get."""

    name: str
    engine: str = "columnar"
    primary_key: tuple[str, ...] = ()
    time_key: str | None = None
    row_filter: Column | None = None


COLLECTIONS = {
    "events": Collection("events", "timeseries", ("event_id",), "ts"),
    "orders": Collection("orders", "columnar", ("o_orderkey",), "o_orderdate"),
    "lineitem": Collection("lineitem", "columnar", ("l_orderkey", "l_linenumber"), "l_shipdate"),
    "customer": Collection("customer", "columnar", ("c_custkey",)),
    "documents": Collection("documents", "document", ("doc_id",)),
    "embeddings": Collection("embeddings", "vector", ("vec_id",)),
}


@dataclass
class Tables:
    """t.orders is the DataFrame of orders.parquet in the folder."""

    spark: SparkSession
    folder: str
    collections: dict[str, Collection] = field(default_factory=lambda: dict(COLLECTIONS))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        c = self.collections.get(name)
        return df.filter(c.row_filter) if c is not None and c.row_filter is not None else df

    def get(self, name: str, **key: object) -> DataFrame:
        """Point get by primary key; the scan prunes row groups by their statistics."""
        c = self.collections[name]
        if set(key) != set(c.primary_key):
            raise ValueError(f"{name} is keyed by {c.primary_key}")
        df = self.table(name)
        for k, v in key.items():
            df = df.filter(F.col(k) == F.lit(v))
        return df

    def views(self, *names: str) -> None:
        for n in names or NAMES:
            self.table(n).createOrReplaceTempView(n)
