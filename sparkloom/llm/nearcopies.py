"""Near copies by the exact likeness of texts' five-word shingles: SimHash with pivot tables.

Two texts are near copies if their sets of shingles share LEAST or more of their union;
a group is what such pairs connect.  Texts of equal sets are one node.

* Candidates: a set has BANDS keys of ROWS MinHashes each, and nodes that share a key
  are compared.  A pair of likeness 0.8 shares none with probability (1 - 0.8^4)^30,
  1.4e-7, and a more alike one more rarely.
* Keys with the same nodes under them count once; the texts of nodes that share a key
  are looked up, no others.
* A node's SimHash of 2048 bits is made once and travels with its set.  Under a key, a table
  holds the distances to pivots chosen among the key's nodes; pairs whose greatest coordinate
  difference is over RADIUS are never compared, the rest by popcount.  The survivors are
  verified by their exact likeness, and only links that span the key's groups are written,
  never all pairs.
* A key with over MOST nodes is not gathered in a task.  Some of its nodes are asked
  against all, which mostly shows it to be one group.  Nodes that are then not of the
  key's largest group are asked against all in turn, so that no link is lost.
* Components by simhash.components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

LEAST = 0.8
SHINGLE = 5
BANDS, ROWS = 30, 4
_TIMES = np.array([xxhash.xxh64_intdigest(b"times%d" % i, 7) | 1 for i in range(BANDS * ROWS)], np.uint64)
_XOR = np.array([xxhash.xxh64_intdigest(b"xor%d" % i, 7) for i in range(BANDS * ROWS)], np.uint64)
#: Bits of 2048 beyond which a pair isn't verified.  A bit of two sets alike to LEAST differs with a
#: probability of 0.15 to 0.162, or 0.188 for four hashes of five: fewer than 2e-9 of those lie beyond.
RADIUS = 492
#: Nodes of a key that one task compares with each other.
MOST = 1024
#: Nodes of a larger key that are asked first, and nodes that a task asks at a time.
FIRST, BLOCK = 32, 256
#: Tasks over which a large key's nodes are spread where they meet what is known of the key.
SALTS = 64


def shingles(text: str | None) -> np.ndarray:
    """The distinct XXH64 of the text's shingles, rising; fewer words are one shingle, and a null
    text or one without a word has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()[SHINGLE - 1 :] or [len(joined)]
    one = xxhash.xxh64_intdigest
    return np.unique(np.array([one(joined[s:e], 42) for s, e in zip(starts, last, strict=False)], np.uint64))


def node(hashes: np.ndarray) -> int:
    """A signed long that stands for the set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 1) - (1 << 63)


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHashes of a set of one hash at least."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[None, at : at + 2048]
        least = np.minimum(least, ((part ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1))
    return least


def keys(least: np.ndarray) -> list[int]:
    """The signed key of each band."""
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), b) - (1 << 63) for b, r in enumerate(rows)]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node and the band keys (null without a word) of every document."""
    common.bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            sets = [shingles(t) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "text_hash": x["text_hash"], "node": [node(s) for s in sets], "keys": [keys(minhashes(s)) if len(s) else None for s in sets]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(run, f"doc_id {kind}, text_hash long, node long, keys array<long>")


def spanning_links(sets: list[np.ndarray], fps: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of likeness LEAST or more that span the groups which all such pairs make; fps:
    the sets' wide fingerprints, one a row."""
    table, sizes = simhash.PivotTable(fps, RADIUS), np.array([len(s) for s in sets])
    free, out = np.ones(len(sets), bool), []
    while free.any():
        stack = [int(free.argmax())]
        free[stack] = False
        while stack and free.any():
            i = stack.pop()
            found = _alike(sets[i], sets, sizes, table.near(fps[i], free))
            free[found] = False
            out += [(i, j) for j in found]
            stack += found
    return out


def _alike(own: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, near: np.ndarray) -> list[int]:
    """Those of the indices near whose sets are alike to own to LEAST or more."""
    near = near[5 * np.minimum(sizes[near], len(own)) >= 4 * np.maximum(sizes[near], len(own))]
    out = []
    for x in near.tolist():
        at = np.minimum(np.searchsorted(own, sets[x]), len(own) - 1)
        both = int((own[at] == sets[x]).sum())
        if 5 * both >= 4 * (len(sets[x]) + len(own) - both):  # LEAST, in whole numbers
            out.append(x)
    return out


def _of_key(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows(t, key, node, ..) with what known(t, key, ..) has of their key, a row for each key that is in it."""
    salt = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALTS)).cast("int")
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(copies, ["t", "key", "salt"]).drop("salt")


def _asked(queries: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect nodes as all near copies among queries and members of one key would, but for
    those of one root: queries and members(t, key, node, root, n), n being the key's nodes.

    A task holds BLOCK queries; members stream past them, a key's in cells of about MOST."""
    here = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("n") / MOST)).cast("int")
    blocks = queries.groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    columns = ["t", "key", "node", "root", "cell", "block", "asks"]
    q = _of_key(queries, blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(4)), F.col("blocks")).cast("int")).withColumn("cell", every(F.ceil(F.col("n") / MOST))).withColumn("asks", F.lit(1))
    m = _of_key(members, blocks).withColumn("cell", here).withColumn("block", every(F.col("blocks"))).withColumn("asks", F.lit(0))
    dealt = q.select(*columns).unionByName(m.select(*columns)).join(sets, F.col("node") == F.col("_node")).select(*columns, "hashes", "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, nodes, roots, own, fps, table, joined = None, [], [], [], [], None, []

        def find(i: int) -> int:
            while joined[i] != i:
                joined[i] = joined[joined[i]]
                i = joined[i]
            return i

        for x in frames:
            out = []
            for *at, node_, root, asks, h, f in zip(*(x[c] for c in ("t", "key", "cell", "block", "node", "root", "asks", "hashes", "fp")), strict=True):
                if at != group:
                    group, nodes, roots, own, fps, table, joined = at, [], [], [], [], None, []
                hashes, fp = np.frombuffer(h, np.uint64), np.frombuffer(f, np.uint64)
                if asks:
                    nodes.append(node_)
                    roots.append(root)
                    own.append(hashes)
                    fps.append(fp)
                    joined.append(len(joined))
                    continue
                if not nodes:
                    continue
                if table is None:
                    table, sizes, roots_, nodes_ = simhash.PivotTable(np.stack(fps), RADIUS), np.array([len(s) for s in own]), np.array(roots), np.array(nodes)
                first = None
                for i in _alike(hashes, own, sizes, table.near(fp, (roots_ != root) & (nodes_ != node_))):
                    if first is None or find(i) != find(first):
                        out.append((nodes[i], node_))
                        if first is not None:
                            joined[find(i)] = find(first)
                    first = i if first is None else first
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    sorted_ = dealt.repartition("t", "key", "cell", "block").sortWithinPartitions("t", "key", "cell", "block", F.desc("asks"))
    return sorted_.mapInPandas(run, "a long, b long")


def links(keyed: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that connect nodes as all near copies among them would, of keyed(t, key,
    node) and texts(node, text)."""
    kept = common.written(keyed, "keyed")
    buckets = kept.groupBy("t", "key").agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("node"), F.lit(1 << 40))).alias("x"), F.sum(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40))).alias("y"))
    buckets = buckets.filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("t", "key")).alias("b")).select(F.col("b.t").alias("_t"), F.col("b.key").alias("_key"), "n")
    same = (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key"))
    members = common.written(kept.join(buckets, same).select("t", "key", "node", "n"), "members")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            sets = [shingles(t) for t in x["text"]]
            yield pd.DataFrame({"_node": x["node"], "hashes": [s.tobytes() for s in sets], "fp": [simhash.wide(s).tobytes() for s in sets]})

    sets = common.written(texts(members.select("node").distinct()).mapInPandas(pack, "_node long, hashes binary, fp binary"), "shingles")
    dealt = members.filter(F.col("n") <= MOST).join(sets, F.col("node") == F.col("_node")).select("t", "key", "node", "hashes", "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, nodes, sets, fps = None, [], [], []

        def pairs() -> pd.DataFrame:
            found = spanning_links(sets, np.stack(fps))
            return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}, dtype=np.int64)

        for x in frames:
            for t, k, n, h, f in zip(x["t"], x["key"], x["node"], x["hashes"], x["fp"], strict=True):
                if (t, k) != key:
                    if len(sets) > 1:
                        yield pairs()
                    key, nodes, sets, fps = (t, k), [], [], []
                nodes.append(n)
                sets.append(np.frombuffer(h, np.uint64))
                fps.append(np.frombuffer(f, np.uint64))
        if len(sets) > 1:
            yield pairs()

    found = dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInPandas(run, "a long, b long")
    hot = members.filter(F.col("n") > MOST).withColumn("root", F.col("node"))
    if hot.isEmpty():
        return found
    # some nodes of each large key, those of the least hash, against all of it
    low = hot.filter(F.pmod(F.xxhash64("node", F.lit(2)), F.col("n")) < 2 * FIRST)
    place = F.row_number().over(Window.partitionBy("t", "key").orderBy(F.xxhash64("node", F.lit(2))))
    found = common.written(found.unionByName(_asked(low.withColumn("_at", place).filter(F.col("_at") <= FIRST).drop("_at"), hot, sets)), "links")
    # what is not of its key's largest group by now, against all of it
    roots = simhash.components(found).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    hot = common.written(hot.join(roots, F.col("node") == F.col("_node"), "left").select("t", "key", "node", F.coalesce("_root", "root").alias("root"), "n"), "large_keys")
    groups = hot.groupBy("t", "key", "root").agg(F.count("*").alias("_c"))
    largest = groups.groupBy("t", "key").agg(F.max_by("root", F.struct("_c", "root")).alias("_largest"))
    rest = common.written(_of_key(hot, largest).filter("root <> _largest").select("t", "key", "node", "root", "n"), "apart")
    return found if rest.isEmpty() else found.unionByName(_asked(rest, hot, sets))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies, as it is: that of the least doc_id (nulls
    after others), of repeated rows any one.  Texts that are null or have no word are one group.
    Columns of any name are kept.  An empty table stays empty."""
    docs, name, back = common.set_aside(docs)
    doc_id, text = F.col(name["doc_id"]), F.col(name["text"])
    ids = common.written(sketches(docs.select(doc_id.alias("doc_id"), text.alias("text"))), "sketches")

    def find(nodes: DataFrame, n: int) -> DataFrame:
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
        first = common.written(ids.filter("keys IS NOT NULL").groupBy("node").agg(F.min(order).alias("at"), F.first("keys").alias("keys")), "first_texts")
        keyed = first.select("node", F.posexplode("keys").alias("t", "key")).select(F.col("t").cast("long").alias("t"), "key", "node")

        def texts(wanted: DataFrame) -> DataFrame:
            at = first.join(wanted, "node", "left_semi").select("node", F.col("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash"))
            return docs.join(at, doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))).select("node", text.alias("text")).dropDuplicates(["node"])

        return links(keyed, texts)

    return simhash.keep_least(docs, name, back, ids.select("doc_id", "text_hash", F.col("node").alias("fp")), find)
