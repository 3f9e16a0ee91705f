"""Access to tables: filters from trees of dicts, row policies, cursors, array predicates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def metadata_filter(tree: dict) -> Column:
    """A filter from {"field": {"op": value}}, {"and": [..]}, {"or": [..]} and {"not": ..}.

    ops: eq ne gt ge lt le in nin between like ilike contains startswith is_null array_contains
    array_contains_all array_overlap; a bare value means eq."""
    parts = []
    for k, v in tree.items():
        if k in ("and", "or"):
            subs = [metadata_filter(x) for x in v]
            out = F.lit(k == "and")
            for s in subs:
                out = out & s if k == "and" else out | s
            parts.append(out)
        elif k == "not":
            parts.append(~metadata_filter(v))
        else:
            for op, x in (v if isinstance(v, dict) else {"eq": v}).items():
                parts.append(_one(F.col(k), op, x))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _one(c: Column, op: str, x) -> Column:
    ops = {
        "eq": lambda: c == x, "ne": lambda: c != x, "gt": lambda: c > x, "ge": lambda: c >= x, "lt": lambda: c < x, "le": lambda: c <= x,
        "in": lambda: c.isin(list(x)), "nin": lambda: ~c.isin(list(x)), "between": lambda: c.between(*x), "like": lambda: c.like(x), "ilike": lambda: c.ilike(x),
        "contains": lambda: c.contains(x), "startswith": lambda: c.startswith(x), "is_null": lambda: c.isNull() if x else c.isNotNull(),
        "array_contains": lambda: F.array_contains(c, x), "array_contains_all": lambda: contains_all(c, x), "array_overlap": lambda: F.arrays_overlap(c, F.array(*map(F.lit, x))),
    }
    if op not in ops:
        raise ValueError(f"no such filter: {op}")
    return ops[op]()


def contains_all(c: Column, values: list) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, values)), c)) == 0


@dataclass
class Policies:
    """Row-level security: readers of a table see what all its policies for their role let through;
    where a table has policies but none for the role, nothing."""

    rules: dict[str, list[tuple[str, Column]]] = field(default_factory=dict)

    def add(self, table: str, role: str, let: Column) -> None:
        self.rules.setdefault(table, []).append((role, let))

    def apply(self, table: str, df: DataFrame, role: str) -> DataFrame:
        if table not in self.rules:
            return df
        own = [c for r, c in self.rules[table] if r in (role, "*")]
        if not own:
            return df.filter(F.lit(False))
        for c in own:
            df = df.filter(c)
        return df


class Cursor:
    """DECLARE, FETCH and CLOSE: rows come to the driver a partition at a time."""

    def __init__(self, df: DataFrame) -> None:
        self.rows: Iterator[Row] | None = df.toLocalIterator()

    def fetch(self, n: int = 1) -> list[Row]:
        if self.rows is None:
            raise ValueError("the cursor is closed")
        return list(islice(self.rows, n))

    def close(self) -> None:
        self.rows = None
