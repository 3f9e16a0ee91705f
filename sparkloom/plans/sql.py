"""SQL front end: Spark SQL with the extensions that multi-model queries use.

Rewritten before Spark parses the text: the vector operators <-> (squared L2), <=> (cosine
distance) and <#> (negative inner product) between column names or bracketed literals, and
their functions, time_bucket('1 hour', ts), FOR SYSTEM_TIME AS OF on a
versioned table, and JSON ->> paths of one key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from sparkloom.catalog import NAMES, Tables

_OPERAND = r"(?:[A-Za-z_][\w.]*|\[[^\]]*\]|ARRAY\([^)]*\))"
_VECTOR = re.compile(rf"({_OPERAND})\s*(<->|<=>|<#>)\s*(\[[^\]]*\]|{_OPERAND})")
_CALL = re.compile(rf"\b(vector_distance|vector_cosine_distance|vector_neg_inner_product)\(\s*({_OPERAND})\s*,\s*(\[[^\]]*\]|{_OPERAND})\s*\)", re.I)
_CALLS = {"vector_distance": "<->", "vector_cosine_distance": "<=>", "vector_neg_inner_product": "<#>"}
_BUCKET = re.compile(r"time_bucket\(\s*(?:INTERVAL\s*)?'(\d+)\s*(\w+?)s?'\s*,\s*([\w.]+)\s*\)", re.I)
_AS_OF = re.compile(r"(\w+)\s+FOR\s+SYSTEM_TIME\s+AS\s+OF\s+(\d+)", re.I)
_ARROW = re.compile(r"([\w.]+)\s*->>\s*'(\w+)'")
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _vector(m: re.Match) -> str:
    a, b = (f"array({x[1:-1]})" if x.startswith("[") else x for x in (m[1], m[3]))
    pairs = f"zip_with({a}, {b}, (x, y) -> double(x) * double(y))"
    total = lambda e: f"aggregate({e}, 0D, (s, x) -> s + x)"
    if m[2] == "<->":  # squared, as nearest-neighbour order needs no root
        return f"({total(f'zip_with({a}, {b}, (x, y) -> (double(x) - double(y)) * (double(x) - double(y)))')})"
    if m[2] == "<#>":
        return f"(-{total(pairs)})"
    norm = lambda v: total(f"transform({v}, x -> double(x) * double(x))")
    return f"(1 - coalesce(try_divide({total(pairs)}, sqrt({norm(a)}) * sqrt({norm(b)})), 0D))"  # 1 where a norm is 0


def _bucket(m: re.Match) -> str:
    step = int(m[1]) * _SECONDS[m[2].lower()] * 1000000
    return f"timestamp_micros(unix_micros(timestamp({m[3]})) - pmod(unix_micros(timestamp({m[3]})), {step}))"


def _as_of(m: re.Match) -> str:
    """Newest version at or before a time of a table with columns _key and _ts_system."""
    inner = f"SELECT *, row_number() OVER (PARTITION BY _key ORDER BY _ts_system DESC) AS _version FROM {m[1]} WHERE _ts_system <= {m[2]}"
    return f"(SELECT * EXCEPT (_version) FROM ({inner}) WHERE _version = 1) AS {m[1]}"


def rewrite(text: str) -> str:
    """The text in Spark SQL; quoted strings that hold no extension stay as they are."""
    text = _AS_OF.sub(_as_of, text)
    text = _BUCKET.sub(_bucket, text)
    text = _CALL.sub(lambda m: f"{m[2]} {_CALLS[m[1].lower()]} {m[3]}", text)
    text = _VECTOR.sub(_vector, text)
    return _ARROW.sub(r"get_json_object(\1, '$.\2')", text)


def run(t: Tables, text: str, **args: object) -> DataFrame:
    """Runs the text over the folder's tables; :name parameters come from args."""
    used = {w for w in re.findall(r"\w+", text.lower()) if w in NAMES}
    t.views(*sorted(used))
    text = rewrite(text)
    return t.spark.sql(text, args=args) if args else t.spark.sql(text)
