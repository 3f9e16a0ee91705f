"""Scalar functions with the semantics that Spark's own don't have.

Null-safe forms (division by zero, casts, concatenation) give null or skip nulls where
ANSI mode would raise; rounding modes, text chunks, durations, identifiers."""

from __future__ import annotations

import json
import os
import secrets
import time
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Arithmetic and conversion


def divide(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(_col(a), _col(b))


def mod(a: Column | str, b: Column | str) -> Column:
    return F.try_mod(_col(a), _col(b))


def cast(c: Column | str, kind: str) -> Column:
    """Null where the value can't be cast."""
    return _col(c).try_cast(kind)


def concat(*cols: Column | str) -> Column:
    """Nulls count as empty."""
    return F.concat_ws("", *(_col(c) for c in cols))


def sqrt(c: Column | str) -> Column:
    return F.when(_col(c) >= 0, F.sqrt(_col(c)))


def ln(c: Column | str) -> Column:
    return F.when(_col(c) > 0, F.log(_col(c)))


def round_mode(c: Column | str, digits: int = 0, mode: str = "HALF_EVEN") -> Column:
    """mode: HALF_EVEN, HALF_UP, HALF_DOWN, TRUNCATE, CEILING or FLOOR."""
    x, scale = _col(c), F.lit(10.0**digits)
    if mode == "HALF_EVEN":
        return F.bround(x, digits)
    if mode == "HALF_UP":
        return F.round(x, digits)
    if mode == "HALF_DOWN":
        return F.signum(x) * F.ceil(F.abs(x) * scale - 0.5) / scale
    if mode == "TRUNCATE":
        return F.signum(x) * F.floor(F.abs(x) * scale) / scale
    if mode == "CEILING":
        return F.ceil(x * scale) / scale
    if mode == "FLOOR":
        return F.floor(x * scale) / scale
    raise ValueError(f"no such rounding mode: {mode}")


# Strings


def byte_length(c: Column | str) -> Column:
    return F.octet_length(_col(c))


def chunk_text(c: Column | str, size: int, overlap: int) -> Column:
    """Chunks of ``size`` characters that overlap: array of (index, start, end, text)."""
    if not 0 <= overlap < size:
        raise ValueError("overlap is at least 0 and under size")
    x, step = _col(c), size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(x) - overlap) / F.lit(step)).cast("int"))

    def chunk(i: Column) -> Column:
        start = i * step
        return F.struct(i.alias("index"), start.alias("start"), F.least(start + size, F.length(x)).alias("end"), F.substring(x, start + 1, F.lit(size)).alias("text"))

    return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(0), n - 1), chunk)).otherwise(F.array().cast("array<struct<index:int,start:int,end:int,text:string>>"))


def chunk_sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(c), r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def chunk_paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(c), r"\n\s*\n"), F.trim), lambda s: s != "")


# Times


def epoch_seconds(c: Column | str) -> Column:
    return F.unix_seconds(_col(c).cast("timestamp"))


def epoch_millis(c: Column | str) -> Column:
    return F.unix_millis(_col(c).cast("timestamp"))


def day_of_week(c: Column | str) -> Column:
    """Sunday is 0."""
    return F.dayofweek(_col(c)) - 1


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return (F.unix_micros(_col(a).cast("timestamp")) - F.unix_micros(_col(b).cast("timestamp"))) / 1e6


def duration_seconds(c: Column | str) -> Column:
    """Seconds of a text such as 1d2h30m, 90s, 250ms; null where it is none."""
    x = F.lower(F.regexp_replace(_col(c), r"\s+", ""))
    units = {"w": 604800.0, "d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "us": 1e-6}
    total = F.lit(0.0)
    for unit, seconds in units.items():
        total = total + F.coalesce(F.regexp_extract(x, rf"([0-9.]+){unit}(?![a-z])", 1).try_cast("double"), F.lit(0.0)) * seconds
    return F.when(x.rlike(r"^([0-9.]+(ms|us|w|d|h|m|s))+$"), total)


def duration_text(seconds: Column | str) -> Column:
    """90061 -> 1d 1h 1m 1s."""
    s = _col(seconds).cast("long")
    parts = {"d": F.floor(s / 86400), "h": F.floor(s % 86400 / 3600), "m": F.floor(s % 3600 / 60), "s": s % 60}
    shown = F.concat_ws(" ", *(F.when(n != 0, F.concat(n.cast("string"), F.lit(u))) for u, n in parts.items()))
    return F.when(s == 0, F.lit("0s")).otherwise(shown)


# JSON in text


def json_get(c: Column | str, path: str) -> Column:
    return F.get_json_object(_col(c), path if path.startswith("$") else f"$.{path}")


def json_map(c: Column | str) -> Column:
    return F.from_json(_col(c), "map<string,string>")


def json_keys(c: Column | str) -> Column:
    return F.json_object_keys(_col(c))


def json_values(c: Column | str) -> Column:
    return F.map_values(json_map(c))


def json_has_key(c: Column | str, key: str) -> Column:
    return F.coalesce(F.array_contains(json_keys(c), key), F.lit(False))


def json_has_any(c: Column | str, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(json_keys(c), F.array(*map(F.lit, keys))), F.lit(False))


def json_has_all(c: Column | str, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), json_keys(c))) == 0, F.lit(False))


def json_set(c: Column | str, key: str, value: Column) -> Column:
    """A top-level key set; values of the object are kept as texts."""
    rest = F.map_filter(json_map(c), lambda k, _: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))


def json_remove(c: Column | str, key: str) -> Column:
    return F.to_json(F.map_filter(json_map(c), lambda k, _: k != key))


def json_merge(a: Column | str, b: Column | str) -> Column:
    """Shallow: b's keys win."""
    mb = json_map(b)
    return F.to_json(F.map_concat(F.map_filter(json_map(a), lambda k, _: ~F.map_contains_key(mb, k)), mb))


def json_type(c: Column | str) -> Column:
    first = F.substring(F.trim(_col(c)), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")


def _holds(x, y) -> bool:
    if isinstance(y, dict):
        return isinstance(x, dict) and all(k in x and _holds(x[k], v) for k, v in y.items())
    if isinstance(y, list):
        return isinstance(x, list) and all(any(_holds(e, v) for e in x) for v in y)
    return x == y and isinstance(x, bool) == isinstance(y, bool)


def json_contains(a: Column | str, b: Column | str) -> Column:
    """Whether JSON a holds JSON b: objects by key, arrays by element, recursively."""

    @F.pandas_udf(T.BooleanType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _holds(json.loads(p), json.loads(q)) for p, q in zip(x, y, strict=True)], dtype="object")

    return run(_col(a), _col(b))


# Identifiers

_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_NANO = "_-0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _ulid() -> str:
    n = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10), "big")
    return "".join(_CROCKFORD[n >> 5 * i & 31] for i in range(25, -1, -1))


def _uuid7() -> str:
    n = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10), "big")
    n = n & ~(0xF << 76) | 7 << 76
    return str(uuid.UUID(int=n & ~(0x3 << 62) | 2 << 62))


def _generator(make):
    @F.pandas_udf(T.StringType())
    def gen(x: pd.Series) -> pd.Series:
        return pd.Series([make() for _ in range(len(x))])

    return gen.asNondeterministic()


def uuid_v4() -> Column:
    return F.uuid()


def uuid_v7() -> Column:
    return _generator(_uuid7)(F.monotonically_increasing_id())


def ulid() -> Column:
    return _generator(_ulid)(F.monotonically_increasing_id())


def nanoid(size: int = 21) -> Column:
    return _generator(lambda: "".join(secrets.choice(_NANO) for _ in range(size)))(F.monotonically_increasing_id())


def cuid2(size: int = 24) -> Column:
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
    return _generator(lambda: secrets.choice(alphabet[:26]) + "".join(secrets.choice(alphabet) for _ in range(size - 1)))(F.monotonically_increasing_id())


def is_uuid(c: Column | str) -> Column:
    return _col(c).rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def is_ulid(c: Column | str) -> Column:
    return F.upper(_col(c)).rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")


def is_cuid2(c: Column | str) -> Column:
    return _col(c).rlike("^[a-z][a-z0-9]{23}$")


def is_nanoid(c: Column | str) -> Column:
    return _col(c).rlike("^[A-Za-z0-9_-]{21}$")


def id_type(c: Column | str) -> Column:
    return F.when(is_uuid(c), "uuid").when(is_ulid(c), "ulid").when(is_cuid2(c), "cuid2").when(is_nanoid(c), "nanoid").otherwise("unknown")


def uuid_version(c: Column | str) -> Column:
    return F.when(is_uuid(c), F.conv(F.substring(_col(c), 15, 1), 16, 10).cast("int"))


def ulid_timestamp(c: Column | str) -> Column:
    """Milliseconds since 1970 that a ULID begins with."""
    x, out = F.upper(_col(c)), F.lit(0).cast("long")
    for i in range(1, 11):
        out = out * 32 + (F.instr(F.lit(_CROCKFORD), F.substring(x, i, 1)) - 1)
    return F.when(is_ulid(c), out)
