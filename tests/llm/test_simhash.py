from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import simhash
from tests.llm import made


def brute_fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps: list[int], radius: int = 3) -> list[int]:
    """The least index that each index reaches."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abAB É \x0b\t\n\x1c", max_size=60))
def test_fingerprints_are_those_of_the_contract(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def near(rng: random.Random, fp: int, bits: int) -> int:
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def fps_of(seed: int, n: int) -> list[int]:
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        out.append(near(rng, rng.choice(out), rng.randint(1, 5)))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("most", [4096, 3])
def test_links_connect_what_all_pairs_connect(spark, most):
    fps = fps_of(3, 150)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(df, len(fps), most=most).collect()
    at = {f: i for i, f in enumerate(signed)}
    assert all((fps[at[r["a"]]] ^ fps[at[r["b"]]]).bit_count() <= 3 for r in edges)
    parts = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, len(fps), most=most)).collect()}
    want, got = defaultdict(set), defaultdict(set)
    for i, r in enumerate(brute_components(fps)):
        want[r].add(signed[i])
    for f in signed:
        got[parts.get(f, f)].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_long_chain_is_one_component(spark):
    rng, chain = random.Random(1), [random.Random(2).getrandbits(62)]
    while len(chain) < 300:
        chain.append(near(rng, chain[-1] & ~(3 << 62), 2) & ~(3 << 62))
    edges = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:], strict=False)], "a long, b long")
    out = simhash.components(edges).collect()
    assert {r["root"] for r in out} == {min(chain)} and len(out) == len(set(chain))


def test_a_star_with_a_hot_centre(spark):
    edges = spark.range(1, 3000).selectExpr("5000 AS a", "id AS b")
    out = simhash.components(edges).collect()
    assert len(out) == 3000 and {r["root"] for r in out} == {1}


def test_documents_against_brute_force(spark):
    docs = made.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, f - (1 << 64) if f >> 63 else f, least.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    out = simhash.near_duplicates(docs)
    assert Counter(map(tuple, out.collect())) == want
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter(least.get(r) for r in set(roots))


def test_empty_tables(spark):
    assert simhash.near_duplicates(made.empty(spark)).collect() == []
    assert simhash.keep_one(made.empty(spark)).collect() == []


def test_wide_fingerprints_are_majorities():
    rng = random.Random(4)
    for n in (0, 1, 2, 5, 255, 256, 700):
        hashes = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        counts = [0] * 64 * simhash.WIDE
        for h in hashes.tolist():
            for at, step in enumerate(simhash._STEPS.tolist()):
                z = (h + step) % 2**64
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                z ^= z >> 31
                for b in range(64):
                    counts[64 * at + b] += z >> b & 1
        want = [sum((counts[64 * at + b] * 2 > n) << b for b in range(64)) for at in range(simhash.WIDE)]
        assert simhash.wide(hashes).tolist() == want


def test_pivots_lose_nothing_within_the_radius_and_tell_the_rest_apart():
    rng = np.random.default_rng(6)
    bits = 64 * simhash.WIDE
    rows = []
    for _ in range(5):  # five groups, each within 300 bits of its centre
        centre = rng.integers(0, 2, bits, dtype=np.uint8)
        for _ in range(30):
            row = centre.copy()
            row[rng.choice(bits, rng.integers(0, 300), replace=False)] ^= 1
            rows.append(np.packbits(row, bitorder="little").view(np.uint64))
    fps = np.stack(rows)
    table, every = simhash.PivotTable(fps, 492), np.ones(len(fps), bool)
    assert len(table.pivots) == 5
    left = 0
    for i, fp in enumerate(fps):
        within = np.flatnonzero(np.bitwise_count(fps ^ fp).sum(axis=1) <= 492)
        assert sorted(table.near(fp, every).tolist()) == within.tolist()
        assert sorted(table.near(fp, np.arange(len(fps)) % 2 == 0).tolist()) == [j for j in within.tolist() if j % 2 == 0]
        asked = set(table.order[table.candidates(fp, every)].tolist())
        assert set(within.tolist()) <= asked
        left += len(asked - set(range(i // 30 * 30, i // 30 * 30 + 30)))
    assert left <= 0.1 * len(fps) * 120  # of the pairs of two groups, few are compared
