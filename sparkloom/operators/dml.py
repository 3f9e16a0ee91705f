"""Changes to tables as images: each takes a table and gives the table after the change.

Nothing is updated in place: the image is a DataFrame to write with an atomic overwrite (or to
a new snapshot).  Changed rows, for RETURNING or a change feed, come from ``changes``."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.shared import written


def _on(a: str, b: str, key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) & out
    return out


def newest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_at", at).filter("_at = 1").drop("_at")


def insert_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows whose key the table has are left out."""
    new = rows.dropDuplicates(key).alias("n").join(table.select(*key).alias("t"), _on("n", "t", key), "left_anti")
    return table.unionByName(new)


def insert_strict(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """An error, when it runs, if a key is there already or comes twice."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    n = F.count("*").over(Window.partitionBy(*key))
    checked = both.withColumn("_ok", F.when((n > 1) & (F.col("_new") == 1), F.raise_error(F.lit("duplicate key"))).otherwise(F.lit(1)))
    return checked.filter("_ok = 1").drop("_ok", "_new")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], merge: bool = False, update: dict[str, Column] | None = None) -> DataFrame:
    """Rows replace those of their key, or, with merge, only where they aren't null; update: the
    expressions of DO UPDATE SET over t (the table's row) and excluded (the new one)."""
    cols = table.columns
    j = table.withColumn("_old", F.lit(True)).alias("t").join(rows.withColumn("_new", F.lit(True)).alias("excluded"), _on("t", "excluded", key), "full")
    has_old, has_new = F.col("t._old").isNotNull(), F.col("excluded._new").isNotNull()
    out = []
    for c in cols:
        old, new = F.col(f"t.{c}"), F.col(f"excluded.{c}")
        if update is not None:
            changed = update.get(c, old)
        elif merge:
            changed = F.coalesce(new, old)
        else:
            changed = new
        out.append(F.when(has_old & has_new, changed).when(has_new, new).otherwise(old).alias(c))
    return j.select(*out)


def update(table: DataFrame, set_: dict[str, Column], where: Column) -> DataFrame:
    return table.select(*(F.when(where, set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in table.columns))


def update_from(table: DataFrame, source: DataFrame, key: list[str], set_: dict[str, Column], where: Column | None = None) -> DataFrame:
    """set_ over t and s.  A key that source repeats is an error, when it runs."""
    n = F.count("*").over(Window.partitionBy(*key))
    once = source.withColumn("_hit", F.when(n > 1, F.raise_error(F.lit("source has a key twice")).cast("boolean")).otherwise(F.lit(True)))
    j = table.alias("t").join(once.alias("s"), _on("t", "s", key), "left")
    hit = F.coalesce(F.col("s._hit"), F.lit(False)) & (F.lit(True) if where is None else where)
    return j.select(*(F.when(hit, set_[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in set_ else F.col(f"t.{c}").alias(c) for c in table.columns))


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def merge(table: DataFrame, source: DataFrame, key: list[str], clauses: list[tuple]) -> DataFrame:
    """MERGE: clauses in order, the first that applies counts.

    (when, condition or None, action, values): when is matched, not_matched or not_by_source;
    action is update, delete, insert or nothing; values are columns over t and s."""
    j = table.withColumn("_old", F.lit(True)).alias("t").join(source.withColumn("_new", F.lit(True)).alias("s"), _on("t", "s", key), "full")
    old, new = F.col("t._old").isNotNull(), F.col("s._new").isNotNull()
    state = {"matched": old & new, "not_matched": ~old & new, "not_by_source": old & ~new}
    which = F.lit(None).cast("int")
    for i, (when, cond, _, _) in reversed(list(enumerate(clauses))):
        which = F.when(state[when] & (F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))), F.lit(i)).otherwise(which)
    j = j.withColumn("_which", which)
    gone = F.lit(False)
    for i, (_, _, action, _) in enumerate(clauses):
        if action == "delete":
            gone = gone | F.coalesce(F.col("_which") == i, F.lit(False))
    inserted = F.lit(False)
    for i, (_, _, action, _) in enumerate(clauses):
        if action == "insert":
            inserted = inserted | F.coalesce(F.col("_which") == i, F.lit(False))
    out = []
    for c in table.columns:
        value = F.col(f"t.{c}")
        for i, (_, _, action, values) in enumerate(clauses):
            if action in ("update", "insert"):
                new_value = (values or {}).get(c, F.col(f"s.{c}") if values is None and c in source.columns else F.col(f"t.{c}") if action == "update" else F.lit(None))
                value = F.when(F.col("_which") == i, new_value).otherwise(value)
        out.append(value.alias(c))
    return j.filter((old | inserted) & ~gone).select(*out)


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """A change feed between two snapshots: op (insert, update, delete), the key, and old and new
    values as structs; rows that stay the same are left out."""
    rest = [c for c in before.columns if c not in key]
    a = before.select(*key, F.struct(*rest).alias("old"), F.lit(True).alias("_a")).alias("a")
    b = after.select(*key, F.struct(*rest).alias("new"), F.lit(True).alias("_b")).alias("b")
    j = a.join(b, _on("a", "b", key), "full")
    op = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return j.select(op.alias("op"), *(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key), "old", "new").filter("op IS NOT NULL")


def field_diffs(feed: DataFrame, columns: list[str]) -> DataFrame:
    """The feed with ``changed``: names of the columns that an update changed."""
    names = F.array(*(F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in columns))
    return feed.withColumn("changed", F.when(F.col("op") == "update", F.array_compact(names)))


# Columns and constraints


def generated(rows: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Generated columns, each after those that it names; a cycle is an error."""
    left = dict(exprs)
    while left:
        ready = [c for c, e in left.items() if not any(o != c and re.search(rf"\b{re.escape(o)}\b", e) for o in left)]
        if not ready:
            raise ValueError(f"generated columns name each other: {sorted(left)}")
        rows = rows.withColumns({c: F.expr(left.pop(c)) for c in ready})
    return rows


def defaults(rows: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), e) if c in rows.columns else e for c, e in exprs.items()})


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that fail a check (null passes), with ``failed``: the checks' names."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items())))
    return rows.withColumn("failed", names).filter(F.size("failed") > 0)


def checked(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows; an error that names the check, when it runs, if a row fails one."""
    ok = F.lit(True)
    for n, c in checks.items():
        ok = F.when(~F.coalesce(c, F.lit(True)), F.raise_error(F.lit(f"check {n} fails")).cast("boolean")).otherwise(ok)
    return rows.filter(ok)


def unbalanced(entries: DataFrame, group: str, debit: Column, credit: Column, digits: int = 2) -> DataFrame:
    """Groups whose debits and credits differ."""
    g = entries.groupBy(group).agg(F.round(F.sum(debit), digits).alias("debit"), F.round(F.sum(credit), digits).alias("credit"))
    return g.filter("debit <> credit")


def balance_errors(table: DataFrame, key: str, total: str, entries: DataFrame, entry_key: str, amount: str, digits: int = 2) -> DataFrame:
    """Rows whose kept total isn't the sum of their entries."""
    sums = entries.groupBy(F.col(entry_key).alias("_k")).agg(F.sum(amount).alias("_sum"))
    j = table.join(sums, F.col(key) == F.col("_k"), "left")
    return j.select(key, F.round(total, digits).alias("kept"), F.round(F.coalesce("_sum", F.lit(0.0)), digits).alias("summed")).filter("kept <> summed")


def bad_transitions(before: DataFrame, after: DataFrame, key: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Rows whose state moved in a way that isn't allowed."""
    j = before.alias("o").join(after.alias("n"), _on("o", "n", key))
    pair = F.struct(F.col(f"o.{state}").alias("a"), F.col(f"n.{state}").alias("b"))
    ok = pair.isin(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in allowed)) if allowed else F.lit(False)
    moved = F.col(f"o.{state}") != F.col(f"n.{state}")
    return j.filter(moved & ~ok).select(*(F.col(f"n.{k}") for k in key), F.col(f"o.{state}").alias("old"), F.col(f"n.{state}").alias("new"))


def locked(before: DataFrame, after: DataFrame, key: list[str], ts: str, until) -> DataFrame:
    """Changes to rows of a closed period: those whose old or new ``ts`` lies before ``until``."""
    feed = changes(before, after, key)
    return feed.filter((F.col(f"old.{ts}") < until) | (F.col(f"new.{ts}") < until))


def retained(table: DataFrame, ts: str, oldest) -> DataFrame:
    """What a retention policy keeps."""
    return table.filter(F.col(ts) >= oldest)


def numbered(rows: DataFrame, column: str, start: int = 1, step: int = 1) -> DataFrame:
    """Sequence values without gaps: partitions are counted, a row's number is its place in its
    partition plus those before.  Which row gets which number is of no consequence."""
    dealt = written(rows.withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.lit(1))) - 1 + F.col("_before")
    return dealt.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(column, (place * step + start).cast("long")).drop("_part", "_before")


def hash_chain(rows: DataFrame, part: str, order: list[str], fields: list[str]) -> DataFrame:
    """rows with ``hash``: SHA-256 of the hash before it in its part and of the row's fields.

    A chain is one after the other by its nature, so a part's rows meet in one task and stream
    through it in order; choose parts (an account, a day) that stay small."""
    line = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in fields))
    keyed = rows.withColumn("_line", line).repartition(part).sortWithinPartitions(part, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("hash", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = object(), ""
        for x in frames:
            out = []
            for p, text in zip(x[part], x["_line"], strict=True):
                if p != own:
                    own, last = p, ""
                last = hashlib.sha256((last + text).encode()).hexdigest()
                out.append(last)
            yield x.drop(columns="_line").assign(hash=out)

    return keyed.mapInPandas(run, schema)


def broken_chain(rows: DataFrame, part: str, order: list[str], fields: list[str]) -> DataFrame:
    """Rows whose stored hash isn't what the row and the stored hash before it give: the places
    where a chain was tampered with.  No task needs a whole chain."""
    line = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in fields))
    before = F.lag("hash", 1, "").over(Window.partitionBy(part).orderBy(*order))
    return rows.withColumn("_want", F.sha2(F.concat(before, line), 256)).filter("_want <> hash").drop("_want")


# Versions


def as_of(versions: DataFrame, key: list[str], system: str, at, deleted: str | None = None) -> DataFrame:
    """FOR SYSTEM_TIME AS OF: the newest version of each key at or before ``at``; versions that
    are tombstones take their key away."""
    rest = [c for c in versions.columns if c not in key]
    best = versions.filter(F.col(system) <= at).groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(system)).alias("_r"))
    out = best.select(*key, "_r.*").select(*versions.columns)
    return out.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def valid_at(rows: DataFrame, low: str, high: str, at) -> DataFrame:
    """FOR VALID_TIME CONTAINS: low <= at < high; a null high is open."""
    return rows.filter((F.col(low) <= at) & (F.col(high).isNull() | (F.col(high) > at)))


def valid_between(rows: DataFrame, low: str, high: str, start, end) -> DataFrame:
    """FOR VALID_TIME FROM start TO end: half-open intervals that overlap."""
    return rows.filter((F.col(low) < end) & (F.col(high).isNull() | (F.col(high) > start)))


def intervals(versions: DataFrame, key: list[str], start: str) -> DataFrame:
    """Versions with ``until``: the start of the key's next version, null for the last."""
    return versions.withColumn("until", F.lead(start).over(Window.partitionBy(*key).orderBy(start)))


def compacted(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """A change log reduced to the latest event of each key."""
    return newest(log, key, [F.desc(c) for c in order])
