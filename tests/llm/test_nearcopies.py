from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import nearcopies, simhash
from tests.llm import made
from tests.llm.test_simhash import brute_components, brute_fingerprint


def brute_set(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def brute_groups(texts: list[str | None]) -> list[int]:
    """The least index that each index reaches."""
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) * 5 >= len(x | sets[j]) * 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("most,first,block", [(1024, 32, 256), (6, 3, 2), (2, 1, 1)])
def test_the_stage_against_brute_force(spark, monkeypatch, most, first, block):
    for name, value in (("MOST", most), ("FIRST", first), ("BLOCK", block)):
        monkeypatch.setattr(nearcopies, name, value)
    rng, data = random.Random(8), made.rows()
    for i in range(25):  # 200 words with 1 to 6 changed: likeness 0.95 down to 0.73
        text = " ".join(f"{rng.choice(made.WORDS['en'])}{rng.randrange(40)}" for _ in range(200))
        data += [(5000 + 10 * i, text, "en", "web", 0, 0, 0, 0, "", ""), (5001 + 10 * i, edited(rng, text, 1 + i % 6), "en", "web", 0, 0, 0, 0, "", "")]
    chain = " ".join(f"c{i}" for i in range(150))
    for i in range(6):  # each like the last, the ends not alike
        data.append((6000 + i, chain, "en", "web", 0, 0, 0, 0, "", ""))
        chain = edited(rng, chain, 2)
    base = " ".join(f"g{i}" for i in range(100))
    for i in range(40):  # a large group of near copies, and texts that share its beginning alone
        data.append((7000 + i, edited(rng, base, 1), "en", "web", 0, 0, 0, 0, "", ""))
        data.append((7100 + i, base[:200] + " " + edited(rng, base, 60), "en", "web", 0, 0, 0, 0, "", ""))
    docs = made.documents(spark, data)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    least: dict = {}
    for (i, _), root in zip(rows, brute_groups([t for _, t in rows]), strict=True):
        least.setdefault(root, []).append((i is None, i or 0))
    kept = corpus_pipeline.deduplicate(spark, docs, "")
    assert kept.schema == docs.schema
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == Counter(map(min, least.values()))
    bits = brute_components([brute_fingerprint(t) for _, t in rows])
    assert len(least) < len(set(bits))  # three words and three bits leave near copies


def test_pivots_choose_the_pairs_that_are_verified(monkeypatch):
    rng, texts = random.Random(3), []
    for g in range(6):  # groups that have only their beginning in common, as nodes under a key may
        base = " ".join(f"s{i}" for i in range(30)) + " " + " ".join(f"g{g}x{i}" for i in range(170))
        texts += [edited(rng, base, i % 5) for i in range(12)]
    texts = sorted({brute_set(t): t for t in texts}.values())
    sets = [nearcopies.shingles(t) for t in texts]
    verified, alike = [], nearcopies._alike
    monkeypatch.setattr(nearcopies, "_alike", lambda own, sets, sizes, near: verified.append(len(near)) or alike(own, sets, sizes, near))
    root = list(range(len(texts)))
    for i, j in nearcopies.spanning_links(sets, np.stack([simhash.wide(s) for s in sets])):
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert root == brute_groups(texts)
    assert len(set(root)) == 6 and sum(verified) < 3 * len(texts)  # each node is asked about its own group's alone


def test_few_hashes_alike_are_within_the_radius():
    rng = random.Random(9)
    for n in (5, 6, 10, 15, 20, 50):  # n hashes and the least likeness: n - n // 5 of them
        for _ in range(300):
            own = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
            assert simhash.distances(simhash.wide(own)[None], simhash.wide(own[n // 5 :]))[0] <= nearcopies.RADIUS


def test_empty_tables(spark):
    assert nearcopies.keep_one(made.empty(spark)).collect() == []
