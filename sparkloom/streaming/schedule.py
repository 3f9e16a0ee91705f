"""Schedules: cron expressions as filters over minutes."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RANGES = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
_NAMES = {n: i for names, first in (("sun mon tue wed thu fri sat", 0), ("jan feb mar apr may jun jul aug sep oct nov dec", 1)) for i, n in enumerate(names.split(), first)}
_SHORT = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *"}


def parsed(expression: str) -> list[tuple[set[int], bool]]:
    """Allowed values of minute, hour, day, month and weekday (0: Sunday), and whether the field is *."""
    parts = _SHORT.get(expression.strip().lower(), expression).split()
    if len(parts) != 5:
        raise ValueError(f"a cron expression has five fields: {expression!r}")
    out = []
    for text, (name, low, high) in zip(parts, _RANGES, strict=True):
        own: set[int] = set()
        for item in text.lower().split(","):
            m = re.fullmatch(r"(\*|\w+(?:-\w+)?)(?:/(\d+))?", item)
            if not m:
                raise ValueError(f"no {name}: {item!r}")
            ends = [low, high] if m[1] == "*" else [_NAMES[x] if x in _NAMES else int(x) for x in m[1].split("-")]
            if len(ends) == 1:
                ends = [ends[0], high if m[2] else ends[0]]
            if not low <= ends[0] <= ends[1] <= high or m[2] == "0":
                raise ValueError(f"no {name}: {item!r}")
            own |= set(range(ends[0], ends[1] + 1, int(m[2] or 1)))
        out.append(({x % 7 for x in own} if name == "weekday" else own, text == "*"))
    return out


def due(ts: Column | str, expression: str) -> Column:
    """Whether a minute is one of the schedule's.  Where both day and weekday are given, either will do."""
    c = F.col(ts) if isinstance(ts, str) else ts
    (minute, _), (hour, _), (day, any_day), (month, _), (weekday, any_weekday) = parsed(expression)
    on_day, on_weekday = F.dayofmonth(c).isin(*day), (F.dayofweek(c) - 1).isin(*weekday)
    days = on_day & on_weekday if any_day or any_weekday else on_day | on_weekday
    return F.minute(c).isin(*minute) & F.hour(c).isin(*hour) & F.month(c).isin(*month) & days


def runs(spark: SparkSession, expression: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """at: the schedule's minutes from start on, before end."""
    first = start.replace(second=0, microsecond=0)
    first += dt.timedelta(minutes=1) if first < start else dt.timedelta()
    n = max(0, -(-int((end - first).total_seconds()) // 60))
    minutes = spark.range(n).select((F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("at"))
    return minutes.filter(due("at", expression))
