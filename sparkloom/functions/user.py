"""Functions that users define: SQL expressions, Arrow-batched scalars and aggregates, table
functions, and procedures of SQL scripts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sql_function(spark: SparkSession, name: str, args: dict[str, str], returns: str, body: str, deterministic: bool = True) -> None:
    """CREATE FUNCTION name(args) RETURNS type AS body; the body is inlined into plans."""
    _word(name)
    params = ", ".join(f"{_word(a)} {t}" for a, t in args.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} {'' if deterministic else 'NOT DETERMINISTIC '}RETURN {body}")


def _word(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"no name: {name!r}")
    return name


def scalar(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str, deterministic: bool = True) -> Callable:
    """A function of Arrow batches (pandas Series in, one out), for SQL and DataFrames."""
    u = F.pandas_udf(_typed(f, pd.Series), returns)
    u = u if deterministic else u.asNondeterministic()
    spark.udf.register(name, u)
    return u


def aggregate(spark: SparkSession, name: str, f: Callable[..., object], returns: str) -> Callable:
    """An aggregate of whole groups (pandas Series in, a value out).  A group's values meet in one
    task; where groups may be large, use ``mergeable``."""
    from pyspark.sql.pandas.functions import PandasUDFType

    u = F.pandas_udf(f, returns, PandasUDFType.GROUPED_AGG) if not getattr(f, "__annotations__", None) else F.pandas_udf(f, returns)
    spark.udf.register(name, u)
    return u


def _typed(f: Callable, out: type) -> Callable:
    """f with the annotations by which Spark tells scalar functions."""
    if f.__annotations__:
        return f
    f.__annotations__ = {a: pd.Series for a in f.__code__.co_varnames[: f.__code__.co_argcount]} | {"return": out}
    return f


#: Keys whose states a task holds at a time.
MOST_KEYS = 100_000


def mergeable(df: DataFrame, keys: list[str], columns: list[str], state: str, start: Callable[[], tuple], step: Callable[[tuple, tuple], tuple], merge: Callable[[tuple, tuple], tuple], finish: Callable[[tuple], object], returns: str) -> DataFrame:
    """An aggregate from partial states: each task folds its rows into a state a key, states are
    merged by key.  state: their schema.  What is shuffled is a state for each task and key, or, of
    very many keys, for each stretch of them that a task holds."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [f.name for f in T._parse_datatype_string(state)]

    def partial(frames: Iterable[pd.DataFrame]):
        held: dict[tuple, tuple] = {}
        shown = lambda: pd.DataFrame([(*k, *s) for k, s in held.items()], columns=[*keys, *names])
        for x in frames:
            for row in x.itertuples(index=False, name=None):
                k = row[: len(keys)]
                held[k] = step(held[k] if k in held else start(), row[len(keys) :])
            if len(held) > MOST_KEYS:  # the same key may give another state later
                yield shown()
                held.clear()
        yield shown()

    states = df.select(*keys, *columns).mapInPandas(partial, f"{kinds}, {state}")

    def final(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        acc = None
        for s in x[names].itertuples(index=False, name=None):
            acc = s if acc is None else merge(acc, s)
        return pd.DataFrame([(*key, finish(acc))], columns=[*keys, "value"])

    return states.groupBy(*keys).applyInPandas(final, f"{kinds}, value {returns}")


def table_function(spark: SparkSession, name: str, rows: Callable[..., Iterable[tuple]], returns: str) -> None:
    """A table function: rows(*args) gives tuples; in SQL, FROM name(..) or LATERAL name(..)."""

    class Function:
        def eval(self, *args):
            yield from rows(*args)

    spark.udtf.register(name, F.udtf(Function, returnType=returns))


@dataclass
class Procedure:
    """CALL: a SQL script (BEGIN .. END with DECLARE, IF, WHILE, LOOP, handlers) with parameters
    named :a in its text."""

    name: str
    params: list[str]
    body: str

    def call(self, spark: SparkSession, *args) -> DataFrame:
        if len(args) != len(self.params):
            raise TypeError(f"{self.name} takes {len(self.params)} arguments")
        return spark.sql(self.body, args=dict(zip(self.params, args, strict=True)))
