"""Replicated values from tables of their operations: what every replica that has the same operations
reads, in whatever order they came.  All of them are aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def register(ops: DataFrame, key: list[str], value: str, clock: str, node: str) -> DataFrame:
    """Last writer wins: the value of the latest clock, ties to the greater node."""
    return ops.groupBy(*key).agg(F.max_by(value, F.struct(clock, node)).alias(value), F.max(clock).alias(clock))


def counter(ops: DataFrame, key: list[str], node: str, added: str, taken: str) -> DataFrame:
    """A counter from replicas' states: each node's largest sums, added up."""
    of_node = ops.groupBy(*key, node).agg(F.max(added).alias("_a"), F.max(taken).alias("_t"))
    return of_node.groupBy(*key).agg((F.sum("_a") - F.sum("_t")).alias("value"))


def observed_set(ops: DataFrame, key: list[str], element: str, tag: str, op: str) -> DataFrame:
    """An observed-remove set of (key, element, tag, op = add or remove): an element is in while one
    of its additions hasn't been removed."""
    tags = ops.groupBy(*key, element, tag).agg(F.max(F.col(op) == "remove").alias("_gone"), F.max(F.col(op) == "add").alias("_in"))
    return tags.filter("_in AND NOT _gone").select(*key, element).distinct()


def merged_map(ops: DataFrame, key: list[str], field: str, value: str, clock: str, node: str) -> DataFrame:
    """A document from its fields' writes: each field's last writer wins; a null deletes a field."""
    last = register(ops, [*key, field], value, clock, node).filter(F.col(value).isNotNull())
    return last.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("doc"))


def ordered_list(ops: DataFrame, key: list[str], position: str, element: str, clock: str, node: str, deleted: str) -> DataFrame:
    """A list whose elements have fractional positions: the last write of each element (position or
    deletion) counts; place from 0 by position, then element."""
    last = ops.groupBy(*key, element).agg(F.max_by(F.struct(position, deleted), F.struct(clock, node)).alias("_w"))
    live = last.filter(~F.col(f"_w.{deleted}")).select(*key, element, F.col(f"_w.{position}").alias(position))
    return live.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(position, element)) - 1)


def versions(ops: DataFrame, key: list[str], clock: str, value: str) -> DataFrame:
    """Each key's versions with the one before: key, clock, value, before, changed."""
    w = Window.partitionBy(*key).orderBy(clock)
    return ops.select(*key, clock, value, F.lag(value).over(w).alias("before")).withColumn("changed", ~F.col(value).eqNullSafe(F.col("before")))
