"""SimHash near duplicates with pivot distance tables.

Fingerprints: 64 bits, by majority over the XXH64 of a text's 3-word shingles.
Two link at a Hamming distance of 3 or less; a component's documents are near
duplicates.  All of it is exact:

* Equal fingerprints are one node.
* With the 64 bits cut into b blocks, fingerprints within 3 bits agree on some b-3
  whole blocks.  Each choice of b-3 blocks is a table keyed by those bits; b grows
  with the number of fingerprints so that a key has few.  A key with very many is
  split by tables of 52 bits, under which at most 4096 distinct fingerprints fit.
* A table holds each fingerprint's Hamming distances to PIVOTS reference fingerprints,
  computed once and carried through the shuffle in two longs.  Under a key, pairs whose
  distances to the first pivot differ by over 3 are never formed, as rows are sorted by
  it; by the triangle inequality, a pair whose distances to any other pivot differ by
  over 3 doesn't link either.  The survivors are verified by popcount.  Only links that
  span a key's components are written, never all pairs.
* Components by alternating stars over tables in the shared folder.

For likeness under 0.95 or so 64 bits are too few: ``wide`` has 2048, and random references tell
nothing apart at the radius that these need, so a PivotTable's are chosen of its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Reference fingerprints: XXH64 of their numbers.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot%d" % i, 7) for i in range(16)], np.uint64)
#: Keys with more fingerprints than this are split; 52-bit keys have at most that many.
MOST = 4096
SMALL = 32
#: Longs of a wide fingerprint, and the constants that make them of one hash.
WIDE = 32
_STEPS = np.array([xxhash.xxh64_intdigest(b"wide%d" % i, 7) for i in range(WIDE)], np.uint64)


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """The text's SimHash; 0 if it is null or has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() is A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()[words_in_shingle - 1 :] or [len(joined)]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[s:e], 42) for s, e in zip(starts, last, strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 3) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text, null as a text of its own) and fp (the 64 bits as a
    signed long) of every document."""
    common.bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            fps = np.array([fingerprint(t, words_in_shingle) for t in x["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": x["doc_id"], "text_hash": x["text_hash"], "fp": fps.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(run, f"doc_id {kind}, text_hash long, fp long")


def wide(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of 64 * WIDE bits of a set of hashes, as longs: a bit is 1 if set in over half of
    them, each mixed anew for each long.  Zeros for an empty set."""
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 255):  # so many fit a byte's count
        z = hashes[at : at + 255, None] + _STEPS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def distances(fps: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Hamming distances of wide fingerprints, one a row, to one."""
    return np.bitwise_count(fps ^ fp).sum(axis=1, dtype=np.int16)


class PivotTable:
    """Wide fingerprints, one a row, with their distances to pivots, sorted by the first.

    Each pivot is the row farthest from those before it, until every row lies within the radius
    of one or there are ``most``.  A row whose distance to any pivot differs by over the radius
    from that of what is looked for lies outside the radius, by the triangle inequality."""

    def __init__(self, fps: np.ndarray, radius: int, most: int = 8):
        pivots, at = [0], [distances(fps, fps[0])]
        least = at[0]
        while len(pivots) < most and least.max() > radius:
            pivots.append(int(least.argmax()))
            at.append(distances(fps, fps[pivots[-1]]))
            least = np.minimum(least, at[-1])
        self.radius, self.pivots = radius, fps[pivots]
        self.order = np.argsort(at[0], kind="stable")
        self.fps, self.at = fps[self.order], np.stack(at, axis=1)[self.order]

    def candidates(self, fp: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Places in the table of rows, of those that may, that no pivot tells apart from fp."""
        own = distances(self.pivots, fp)
        low, high = np.searchsorted(self.at[:, 0], (own[0] - self.radius, own[0] + self.radius + 1))
        places = low + np.flatnonzero(may[self.order[low:high]])
        return places[np.abs(self.at[places] - own).max(axis=1) <= self.radius]

    def near(self, fp: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Indices of the rows, of those that may, within the radius of fp."""
        places = self.candidates(fp, may)
        return self.order[places[distances(self.fps[places], fp) <= self.radius]]


def masks(blocks: int, radius: int = 3) -> list[int]:
    """Signed masks of every choice of blocks - radius of the blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _blocks(n: int) -> int:
    """The least number of blocks whose keys have about 4 fingerprints or fewer."""
    return next((b for b in range(4, 16) if n / 2 ** (64 * (b - 3) / b) <= 4), 16)


def _coordinates(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _distances() -> list[Column]:
    """The distance table of the column fp: distances to eight pivots in each long, a byte each."""
    to = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p) - (1 << 64) if p >> np.uint64(63) else int(p)))).cast("long") for p in PIVOTS]
    pack = lambda own: reduce(Column.bitwiseOR, (F.shiftleft(d, 8 * i) for i, d in enumerate(own)))
    return [pack(to[:8]).alias("d0"), pack(to[8:]).alias("d1")]


def spanning_links(fps: np.ndarray, radius: int = 3, at: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that span the components of fps under Hamming distance <= radius; at: their
    distances to the pivots."""
    at = _coordinates(fps) if at is None else at
    order = np.argsort(at[:, 0], kind="stable")
    fps, at, first = fps[order], at[order], at[order, 0].astype(int)
    low, high = np.searchsorted(first, first - radius), np.searchsorted(first, first + radius, "right")
    free, out = np.ones(len(fps), bool), []
    for start in range(len(fps)):
        if not free[start]:
            continue
        free[start], stack = False, [start]
        while stack:
            i = stack.pop()
            near = low[i] + np.flatnonzero(free[low[i] : high[i]])
            near = near[np.abs(at[near] - at[i]).max(axis=1) <= radius] if near.size else near
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
            free[near] = False
            out += [(int(order[i]), int(order[j])) for j in near]
            stack += near.tolist()
    return out


def _links_of_sorted(t: np.ndarray, key: np.ndarray, fps: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal (t, key), whose rows are sorted by the distance to the first
    pivot."""
    new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])]
    first = np.flatnonzero(new)
    sizes = np.diff(np.r_[first, len(t)])
    a, b = [], []
    for s, n in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        pairs = spanning_links(fps[s : s + n], radius, at[s : s + n])
        a += [s + i for i, _ in pairs]
        b += [s + j for _, j in pairs]
    run = np.repeat(np.arange(len(first)), sizes)
    idx = np.flatnonzero(np.repeat((sizes <= SMALL) & (sizes > 1), sizes))
    i = idx  # rows whose partner o places on may still be near the first pivot's distance
    for o in range(1, SMALL):
        i = i[i + o < len(t)]
        i = i[(run[i + o] == run[i]) & (at[i + o, 0] - at[i, 0] <= radius)]
        if not i.size:
            break
        near = i[np.abs(at[i + o] - at[i]).max(axis=1) <= radius]
        near = near[np.bitwise_count(fps[near + o] ^ fps[near]) <= radius]
        a += near.tolist()
        b += (near + o).tolist()
    return fps[np.array(a, np.int64)].view(np.int64), fps[np.array(b, np.int64)].view(np.int64)


def _find_links(keyed: DataFrame, radius: int) -> DataFrame:
    columns = ("t", "key", "fp", "d0", "d1")

    def links_of(c: list[np.ndarray]) -> pd.DataFrame:
        at = np.stack([np.ascontiguousarray(x) for x in c[3:]], axis=1).view(np.int8)
        a, b = _links_of_sorted(c[0], c[1], np.ascontiguousarray(c[2]).view(np.uint64), at, radius)
        return pd.DataFrame({"a": a, "b": b})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * len(columns)
        for x in frames:
            cols = [np.concatenate([k, x[c].to_numpy(np.int64)]) for k, c in zip(kept, columns, strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if last.size else 0
            kept = [c[cut:] for c in cols]  # the last key may go on; at most MOST rows
            if cut:
                yield links_of([c[:cut] for c in cols])
        if len(kept[0]):
            yield links_of(kept)

    by_first = F.col("d0").bitwiseAND(F.lit(255))
    return keyed.repartition("t", "key").sortWithinPartitions("t", "key", by_first).mapInPandas(run, "a long, b long")


def _keyed(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(blocks, radius))))
    return fps.select("fp", "d0", "d1", F.explode(keys).alias("k")).select("k.t", "k.key", "fp", "d0", "d1")


def links(fps: DataFrame, n: int, radius: int = 3, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints fps(fp) as all pairs within
    ``radius`` bits would.  n: the number of fingerprints."""
    fps = common.written(fps.select("fp", *_distances()), "distances")
    keyed = _keyed(fps, _blocks(n), radius)
    counts = keyed.groupBy("t", "key").count().filter(F.col("count") > most)
    hot = common.written(counts.select(F.col("t").alias("_t"), F.col("key").alias("_key")), "hot_keys")
    if hot.isEmpty():
        return _find_links(keyed, radius)
    same = (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key"))
    cold = keyed.join(hot, same, "left_anti")
    again = keyed.join(hot, same, "left_semi").select("fp", "d0", "d1").distinct()
    return _find_links(cold, radius).unionByName(_find_links(_keyed(again, 16, radius), radius))


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges(a, b); root is the component's least node.

    Alternates large and small stars until the edges stay the same; each round is a
    table in the shared folder.  A node with very many neighbours is salted."""
    edges = common.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    state = lambda e: e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    was, rounds = state(edges), 0
    while was[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = _star(both, was[0] * 2, large=True, name=f"large{rounds}")
        edges = _star(edges, was[0], large=False, name=f"small{rounds}")
        now, rounds = state(edges), rounds + 1
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _star(e: DataFrame, rows: int, large: bool, name: str) -> DataFrame:
    least = e.groupBy(F.col("a").alias("a")).agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("_n"))
    joined = common.salted_join(e, least, "a", "_n", rows, F.col("b"))
    out = joined.filter(F.col("b") > F.col("a")) if large else joined.filter(F.col("b") <= F.col("a"))
    out = out.select(F.col("b").alias("x"), F.col("m"))
    if not large:
        out = out.unionByName(least.select(F.col("a").alias("x"), "m"))
    return common.written(out.filter("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), name)


def _grouped(rows: DataFrame, find: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """rows(doc_id, fp, ..) with ``root`` (a fingerprint that stands for the component) and
    ``component_id``.  find: gives the links of n distinct fingerprints."""
    nodes = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    n, n_rows = nodes.agg(F.count("*"), F.sum("n")).first()
    parts = common.written(components(find(nodes.select("fp"), n)), "parts")
    linked = nodes.join(parts, F.col("fp") == F.col("node"))
    ids = linked.groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.select(F.col("fp").alias("_fp"), F.col("root").alias("_root"))
    ids = ids.withColumnRenamed("root", "_id")
    found = nodes.join(linked, F.col("fp") == F.col("_fp"), "left").join(ids, F.col("_root") == F.col("_id"), "left")
    found = found.select("fp", "n", F.coalesce("_root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id"))
    return common.salted_join(rows, found, "fp", "n", n_rows or 0, F.col("doc_id")).drop("n")


def near_duplicates(docs: DataFrame, radius: int = 3, words_in_shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id of the component) of every row.

    Texts that are null or have no word have fingerprint 0 and link like others.
    Repeated rows link as copies do.  A component whose doc_ids are all null has a null
    component_id.  Other columns than doc_id and text aren't read.  An empty table
    gives an empty table."""
    rows = common.written(fingerprints(docs, words_in_shingle), "fingerprints")
    return _grouped(rows.drop("text_hash"), lambda fps, n: links(fps, n, radius)).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 3, words_in_shingle: int = 3) -> DataFrame:
    """One row of docs for each component of near duplicates, as it is: that of the least
    doc_id (nulls after others), of repeated rows any one.  Columns of any other name are
    kept.  An empty table stays empty."""
    docs, name, back = common.set_aside(docs)
    doc_id, text = F.col(name["doc_id"]), F.col(name["text"])
    ids = common.written(fingerprints(docs.select(doc_id.alias("doc_id"), text.alias("text")), words_in_shingle), "fingerprints")
    return keep_least(docs, name, back, ids, lambda fps, n: links(fps, n, radius))


def keep_least(docs: DataFrame, name: dict[str, str], back: list[Column], ids: DataFrame, find: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The row of the least doc_id of each component of ids(doc_id, text_hash, fp), of docs as
    common.set_aside gives them; find as in _grouped."""
    doc_id, text = F.col(name["doc_id"]), F.col(name["text"])
    ids = ids.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), *(F.col(c).alias(c) for c in ("doc_id", "text_hash", "rows")))
    kept = _grouped(ids, find).groupBy("root").agg(F.min(order).alias("kept"))
    kept = common.written(kept.select(F.col("kept.doc_id").alias("_id"), F.col("kept.text_hash").alias("_hash"), F.col("kept.rows").alias("_rows")), "kept")
    # the texts are hashed again, not fingerprinted again
    rows = docs.join(kept, doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")))
    single = rows.filter("_rows = 1").select(*back)
    if kept.filter("_rows > 1").isEmpty():
        return single
    # one of each row's repeats, which may be very many: each task keeps one of its own
    first = F.first(F.struct(*name.values())).alias("_row")
    repeated = rows.filter("_rows > 1").groupBy("_id", "_hash").agg(first).select("_row.*")
    return single.unionByName(repeated.select(*back))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
