"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame
operations only.

Each document has an expected number of copies, target / source size; its whole
part is kept and the fractions are rounded together.  A fraction f of a document of
a words is a mass a*f of its a words.  Two documents meet, and mass moves from one to
the other until one has none or all of its words; the direction is drawn so that
each mass keeps its expectation.  The other document carries the residual on.  As
the sum of masses never changes, a source's words end within half a document of
its target.  Documents meet in blocks of about BLOCK (a hot source has many), the
blocks' residuals meet in blocks again, and so on up a reduction tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 64
#: Equal rows that are made again in one task.
REPEATS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes(source, n, source_size), a row per source, with ``target``.

    Sources in order of code points, null last, take ``weights`` in turn.  The order
    is found by a range-partitioned sort, the rate a weight that they share by another."""
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = sizes.withColumn("_null", F.col("source").isNull())
    dealt = common.written(kept.repartitionByRange(parts, "_null", "source").withColumn("_part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "source")) - 1 + F.col("_before")
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    table = common.written(dealt.join(F.broadcast(counts), "_part").withColumn("weight", turn).select("source", "n", "source_size", "weight"), "weighted")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    rate = _rate(table.select("weight", cap.alias("cap")), share * total, parts)
    return table.withColumn("target", F.least(F.col("weight") * F.lit(rate), cap)).drop("weight")


def _rate(sources: DataFrame, total: float, parts: int) -> float:
    """The r at which the sources' least(weight * r, cap) sum to total; infinite if all caps
    together are less.

    Sources are sorted by the rate that caps them, cap / weight.  Sums of the sorted ranges, a row
    for each, tell in which of them r lies; sums over that range alone tell where."""
    sorted_ = common.written(sources.withColumn("full", F.col("cap") / F.col("weight")).repartitionByRange(parts, "full").withColumn("part", F.spark_partition_id()), "rates")
    ranges = sorted_.groupBy("part").agg(F.max("full").alias("full"), F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).orderBy("full").collect()
    closed, open_w = 0.0, sum(r["weight"] for r in ranges)
    for r in ranges:
        if closed + r["cap"] + r["full"] * (open_w - r["weight"]) >= total:
            break
        closed, open_w = closed + r["cap"], open_w - r["weight"]
    else:
        return float("inf")
    # within the range: what is capped before a rate, and the weight that isn't
    by = Window.orderBy("full").rowsBetween(Window.unboundedPreceding, 0)
    within = sorted_.filter(F.col("part") == r["part"]).groupBy("full").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"))
    upto = within.select("full", F.sum("cap").over(by).alias("c"), F.sum("weight").over(by).alias("w"), "cap", "weight")
    rate = (F.lit(total) - F.lit(closed) - (F.col("c") - F.col("cap"))) / (F.lit(open_w) - (F.col("w") - F.col("weight")))
    found = upto.filter(rate <= F.col("full")).orderBy("full").select(rate).first()
    return found[0] if found else r["full"]


def _meet(rest: Column, x: Column, level: int, seed: int) -> Column:
    """Residual and next document meet: struct(rest, done)."""
    move_in = F.least(rest["a"] - rest["m"], x["m"])
    move_out = F.least(rest["m"], x["a"] - x["m"])
    u = F.shiftrightunsigned(F.xxhash64(rest["id"], rest["dup"], x["id"], x["dup"], rest["a"], x["a"], F.lit(seed), F.lit(level)), 11).cast("double") * F.lit(2.0**-53)
    gains = u * (move_in + move_out) < move_out
    # the rest gains all that it can hold or all that x has, or loses likewise; exact ends, no rounding
    rest_m = F.when(gains, F.when(rest["a"] - rest["m"] <= x["m"], rest["a"].cast("double")).otherwise(rest["m"] + x["m"])).otherwise(F.when(rest["m"] <= x["a"] - x["m"], F.lit(0.0)).otherwise(rest["m"] - (x["a"] - x["m"])))
    x_m = F.when(gains, F.when(rest["a"] - rest["m"] <= x["m"], x["m"] - (rest["a"] - rest["m"])).otherwise(F.lit(0.0))).otherwise(F.when(rest["m"] <= x["a"] - x["m"], x["m"] + rest["m"]).otherwise(x["a"].cast("double")))
    whole = (rest_m == 0.0) | (rest_m == rest["a"].cast("double"))
    as_row = lambda d, m: F.struct(d["id"].alias("id"), d["dup"].alias("dup"), d["a"].alias("a"), d["base"].alias("base"), m.alias("m"))
    r, s = as_row(rest, rest_m), as_row(x, x_m)
    return F.struct(F.when(whole, s).otherwise(r).alias("rest"), F.when(whole, r).otherwise(s).alias("done"))


def _fold(rows: Column, level: int, seed: int) -> Column:
    first = F.element_at(rows, 1)
    none = F.filter(rows, lambda _: F.lit(False))
    start = F.struct(first.alias("rest"), none.alias("done"))

    def step(acc: Column, x: Column) -> Column:
        met = _meet(acc["rest"], x, level, seed)
        return F.struct(met["rest"].alias("rest"), F.concat(acc["done"], F.array(met["done"])).alias("done"))

    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, step)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with dup, which numbers equal rows from 0.  Equal rows are counted and made again, a
    REPEATS of them in a task, so that no task meets all rows of one."""
    counted = common.written(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "counted")
    numbers = lambda start: F.explode(F.sequence(start, F.least(F.col("n"), start + REPEATS) - 1))
    few = counted.filter(F.col("n") <= REPEATS).select(*rows.columns, numbers(F.lit(0).cast("long")).alias("dup"))
    many = counted.filter(F.col("n") > REPEATS).select(*rows.columns, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long"))).alias("start"))
    return few.unionByName(many.repartition(*rows.columns, "start").select(*rows.columns, numbers(F.col("start")).alias("dup")))


def pivotal_copies(rows: DataFrame, most_in_source: int, seed: int = 42) -> DataFrame:
    """rows(doc_id, source, size, expected copies) -> doc_id, source, size, copies.

    copies is the expectation rounded down or up; per source, the sum of copies * size
    is within half a document of the sum of expectations * size.  Equal inputs give equal
    results.  Documents of size 0 or of whole expectations need no draw.  Rows that repeat are
    numbered, so that they meet in blocks like others."""
    base = F.floor("expected").cast("int")
    rows = _numbered(rows).select("doc_id", "dup", "source", F.col("size").alias("a"), base.alias("base"), ((F.col("expected") - F.floor("expected")) * F.col("size")).alias("m"))
    whole = (F.col("m") <= 0) | (F.col("m") >= F.col("a"))
    done = rows.filter(whole).select("doc_id", "dup", "source", "a", "base", "m")
    blocks = max(1, -(-most_in_source // BLOCK))
    spread = F.pmod(F.xxhash64("doc_id", "dup", "a", F.lit(seed)), F.lit(blocks))
    rest = rows.filter(~whole).withColumn("block", spread)
    level, out = 0, [done]
    while True:
        item = F.struct(F.xxhash64("doc_id", "dup", F.lit(seed + 1)).alias("h"), F.col("doc_id").alias("id"), "dup", "a", "base", "m")
        groups = rest.groupBy("source", "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
        items = F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["dup"].alias("dup"), x["a"].alias("a"), x["base"].alias("base"), x["m"].alias("m")))
        folded = groups.select("source", "block", _fold(items, level, seed).alias("f"))
        folded = folded.select("source", "block", F.explode(F.concat(F.transform("f.done", lambda d: F.struct(d.alias("d"), F.lit(False).alias("left"))), F.array(F.struct(F.col("f.rest").alias("d"), F.lit(True).alias("left"))))).alias("x"))
        folded = folded.select(F.col("x.d.id").alias("doc_id"), F.col("x.d.dup").alias("dup"), "source", F.col("x.d.a").alias("a"), F.col("x.d.base").alias("base"), F.col("x.d.m").alias("m"), "block", F.col("x.left").alias("left"))
        folded = common.written(folded, f"pivotal{level}")
        decided = ~F.col("left")
        if blocks == 1:
            # a source's last residual has no partner: the nearer end, at most half a document off
            open_ = (F.col("m") > 0) & (F.col("m") < F.col("a"))
            end = F.when(F.col("m") * 2 >= F.col("a"), F.col("a").cast("double")).otherwise(F.lit(0.0))
            out.append(folded.withColumn("m", F.when(open_, end).otherwise(F.col("m"))).select(*done.columns))
            break
        out.append(folded.filter(decided).select(*done.columns))
        rest = folded.filter(F.col("left")).select(*done.columns, F.floor(F.col("block") / BLOCK).cast("long").alias("block"))
        blocks, level = -(-blocks // BLOCK), level + 1
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    copies = F.col("base") + F.when((F.col("m") >= F.col("a")) & (F.col("a") > 0), F.lit(1)).otherwise(F.lit(0))
    return all_.select("doc_id", "source", F.col("a").alias("size"), copies.alias("copies"))


def mix(docs: DataFrame, weights: list[float], share: float, most: float, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document.

    size: words of the text (null: 0); a document of no words is taken 0 times.
    Sources' targets share ``share`` of all sizes by ``weights``, no target above ``most``
    times its source; where all stop there, the rest is not taken.  A null source is a
    source.  Repeated rows are documents of their own.  A very long text is counted whole; its
    source ends within half of it of the target.  An empty table gives an empty table."""
    rows = common.written(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    targets = common.written(source_targets(sizes, weights, share, most), "targets")
    most_rows = targets.agg(F.max("n")).first()[0] or 1
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    # the sources' table follows the input; sources with many documents are spread by Spark's skew join
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    expected = F.when(F.col("size") > 0, expected).otherwise(F.lit(0.0))
    copies = pivotal_copies(joined.select("doc_id", "source", "size", expected.alias("expected")), most_rows, seed)
    out = copies.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: list[float], share: float, most: float, seed: int = 42) -> DataFrame:
    """docs with every row as often as the mix takes it (0 times: gone), as it is.

    Rows that repeat a doc_id, source and size share their copies out among them, in the order in
    which they are stored.  Columns of any other name are kept."""
    picks = mix(docs, weights, share, most, seed)
    key = ["doc_id", "source", "size"]
    # equal rows have one expectation, so their copies are its floor or one more
    picks = picks.groupBy(*key).agg(F.count("*").alias("_rows"), F.min("copies").alias("_low"), F.sum("copies").alias("_sum"))
    picks = common.written(picks.filter("_sum > 0").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), "_rows", "_low", (F.col("_sum") - F.col("_rows") * F.col("_low")).alias("_more")), "picks")
    docs, name, back = common.set_aside(docs)
    text = F.col(name["text"])
    rows = docs.withColumn("_size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
    same = F.col(name["doc_id"]).eqNullSafe(F.col("_k0")) & F.col(name["source"]).eqNullSafe(F.col("_k1")) & (F.col("_size") == F.col("_k2"))
    # picks follow the documents, so they are never broadcast, however few they are here
    taken = rows.join(picks.filter("_rows = 1").hint("merge"), same).withColumn("_n", F.col("_low") + F.col("_more"))
    taken = taken.select(*name.values(), "_n")
    if not picks.filter("_rows > 1").isEmpty():
        # a place among equal rows: by the file part they are in, so that no task meets them all
        many = common.written(rows.withColumn("_part", F.spark_partition_id()).join(picks.filter("_rows > 1"), same), "repeats")
        keys = ["_k0", "_k1", "_k2"]
        parts = many.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(*(F.col(c).alias(f"_j{i}") for i, c in enumerate([*keys, "_part"])), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
        at_part = F.lit(True)
        for i, c in enumerate([*keys, "_part"]):
            at_part = at_part & F.col(c).eqNullSafe(F.col(f"_j{i}"))
        place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(text)) + F.col("_before")
        many = many.join(parts, at_part).withColumn("_n", F.col("_low") + F.when(place <= F.col("_more"), 1).otherwise(0))
        taken = taken.unionByName(many.select(*name.values(), "_n"))
    return taken.filter("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long")))).select(*back)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return mix(docs, [5, 2, 1], 1.5, 2.0).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
