"""Queries over the tables, by the operators they show."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import registry

MODULES = ("relational", "scalars", "timeseries", "searching", "graphs", "changing", "keyvalues", "spatials", "promqls", "streams", "files", "extras", "statements", "wires")


def _load() -> None:
    for name in MODULES:
        import_module(f"sparkloom.plans.{name}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return registry.callables()


def all_oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
