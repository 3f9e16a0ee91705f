"""Runs a registered query and its SQL side by side, as the checks do: rows without order,
columns by name."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from functools import cache

import duckdb
import numpy as np

from sparkloom.catalog import NAMES


@cache
def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(x):
    """A value that compares alike from either engine."""
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, (float, np.floating, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (int, np.integer)):
        return float(x) + 0.0 if abs(x) < 1 << 53 else int(x)
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return str(x)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    cur = tables(folder).cursor()
    cur.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def difference(spark_rows, sql_rows) -> str:
    """Empty if both are the same."""
    (a_names, a), (b_names, b) = spark_rows, sql_rows
    if a_names != b_names:
        return f"columns {a_names} and {b_names}"
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(odd)} of {len(a)} rows differ, first {odd[0]}" if odd else ""
