"""Document fingerprints from prefix polynomial hashes.

With prefix arrays of a text's polynomial hash modulo 2^31 - 1, the hash of any span
takes two reads, so any two spans are compared at once and the longest common
extension of two places is found by binary search.  A fingerprint holds the text's
length, its hash in two bases (62 bits), and the 48 least mixed hashes of its 8-character
spans (all of them, if fewer), from which the likeness of two texts is estimated.
Places and lengths are in code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

P = (1 << 31) - 1
BASES = (911_382_323, 1_972_663_751)
SPAN = 8
KEEP = 48
#: Bytes of text that a task of the neighbour pass gets at most, about.
PART_BYTES = 256 << 20
#: Ranges whose ends are linked in one task.
LINKED = 1000

_powers: dict[int, np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    x = (x & np.uint64(P)) + (x >> np.uint64(31))
    return np.where(x >= P, x - np.uint64(P), x)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) at least, modulo P."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), P))
        have = np.concatenate([have, _mod(have * step)])
    _powers[base] = have
    return have


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """sums[i]: the sum of (c[j] + 1) * base^j over j < i, modulo P, for both bases."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        c = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base in BASES:
            s = np.zeros(self.n + 1, np.uint64)
            s[1:] = _mod(np.cumsum(_mod(c * powers(base, self.n)[: self.n])))
            self.sums.append(s)

    def span(self, start: int, size: int) -> tuple[int, int]:
        """A hash of the span that doesn't depend on where it is."""
        out = []
        for base, s in zip(BASES, self.sums, strict=True):
            diff = (int(s[start + size]) - int(s[start])) % P
            out.append(diff * int(powers(pow(base, -1, P), start + 1)[start]) % P)
        return out[0], out[1]

    def spans(self, size: int) -> np.ndarray:
        """The first-base hash of every span of that size."""
        s, back = self.sums[0], powers(pow(BASES[0], -1, P), self.n + 1)
        return _mod(_mod(s[size:] + np.uint64(P) - s[: self.n + 1 - size]) * back[: self.n + 1 - size])

    def total(self) -> tuple[int, int]:
        return int(self.sums[0][-1]), int(self.sums[1][-1])


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """The most characters that agree from place i of a and place j of b on."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, mid) == b.span(j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def sketch(h: PrefixHash) -> np.ndarray:
    """The KEEP least distinct mixed span hashes, rising; a shorter text is one span."""
    if h.n == 0:
        return np.empty(0, np.uint32)
    x = h.spans(min(SPAN, h.n))
    x = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(13)
    x = ((x ^ (x >> np.uint64(21))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    below = min(1 << 32, (1 << 32) * 4 * KEEP // len(x))
    while True:
        out = np.unique(x[x < below] if below < 1 << 32 else x)
        if len(out) >= KEEP or below >= 1 << 32:
            return out[:KEEP]
        below = min(1 << 32, below * 8)


def fingerprint(h: PrefixHash, least: np.ndarray) -> str:
    a, b = h.total()
    return f"{h.n:x}.{a:08x}{b:08x}." + least.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans of two texts, from their fingerprints; 1.0 if equal."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit(".", 1)[1]), ">u4") for f in (a, b))
    return _likeness(x, y)


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return 0.0
    both = np.union1d(x, y)[:KEEP]
    return float(np.isin(both, np.intersect1d(x, y, assume_unique=True)).sum() / len(both))


class _Doc:
    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.text, self.codes = doc_id, text, code_points(text)
        self.hash = PrefixHash(self.codes)
        self.least = sketch(self.hash)
        self.fp = fingerprint(self.hash, self.least)


def _row(d: _Doc, nxt: _Doc) -> tuple:
    half = len(d.codes) // 2
    keep = len(d.codes) - half
    edited = PrefixHash(np.concatenate([d.codes[:keep], nxt.codes[:half]]))
    least = sketch(edited)
    efp = fingerprint(edited, least)
    digest = hashlib.sha256((d.text[:keep] + nxt.text[:half]).encode("utf-8", "surrogatepass")).hexdigest()
    near = 1.0 if efp == d.fp else _likeness(d.least, least)
    near_next = 1.0 if nxt.fp == d.fp else _likeness(d.least, nxt.least)
    return d.doc_id, len(d.codes), digest, d.fp, efp, near, near_next, common_extension(d.hash, 0, nxt.hash, 0)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    common_next (characters that the text and the next begin with) of every row.

    The next document is the next row by doc_id, nulls first (rows of one doc_id by the XXH64 of
    their texts, then by text), and after the last the first; a table of one row is its own
    next.  Rows that repeat follow each other.  A null text counts as empty.  Very long texts
    are hashed whole, in arrays of some 100 bytes a character.  Other columns aren't read, whatever
    their names.  An empty table gives an empty table.

    Texts are shuffled once, into sorted ranges; a row meets the next one in its range.  What
    the last row of a range needs, the first row of the range after it, comes from the same
    shuffle: a row for each range, linked LINKED ranges at a time.  Equal rows, which may be very
    many, fall into several ranges by their place in the input."""
    spark = docs.sparkSession
    common.bounded_batches(spark, rows=500, mb=8)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_next long"
    names = [f.split()[0] for f in schema.split(", ")]
    order = ["doc_id", "hash", "text", "place"]
    dealt = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(parts, "doc_id", "hash", "place")

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for x in frames:
            out = []
            for i, text in zip(x["doc_id"], x["text"], strict=True):
                d = _Doc(i, text)
                if last is not None:
                    out.append(_row(last, d))
                last = d
            yield pd.DataFrame(out, columns=names)

    def across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame([_row(_Doc(i, a), _Doc(None, b)) for i, a, b in zip(x["doc_id"], x["text"], x["next"], strict=True)], columns=names)

    # the first and the last row of each range that has rows
    row = F.struct(*order)
    ends = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    ends = ends.withColumn("group", F.floor(F.col("part") / LINKED))
    by_part = Window.partitionBy("group").orderBy("part")
    ends = ends.withColumn("next", F.lead("first.text").over(by_part)).withColumn("head", F.first("first.text").over(by_part))
    ends = ends.select("group", "last.doc_id", "last.text", "next", "head")
    by_group = Window.orderBy("group")  # a row for each LINKED ranges
    last = ends.filter("next IS NULL").withColumn("next", F.coalesce(F.lead("head").over(by_group), F.first("head").over(by_group)))
    linked = ends.filter("next IS NOT NULL").unionByName(last).select("doc_id", "text", "next")
    return dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInPandas(within, schema).unionByName(linked.mapInPandas(across, schema))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(common.read(spark, sf_dir, "documents"))
