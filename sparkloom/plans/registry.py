"""Registered queries: a Spark plan each and, where SQL can say it, DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.catalog import Tables

Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a function of Tables as a query; sql: its oracle."""

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add


def sql_query(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Registers a query in SQL; oracle: DuckDB's text where it differs."""
    from sparkloom.plans import sql

    query(name, oracle or spark_sql)(lambda t: sql.run(t, spark_sql))


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Tables(spark, sf_dir))) for name, plan in PLANS.items()}
