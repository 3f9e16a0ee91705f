from __future__ import annotations

import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import common, sharding
from tests.llm import made


def brute_force(sizes: list[int], capacity: int) -> int:
    """Bins that best fit decreasing opens, item by item."""
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
def test_packing_by_classes_equals_packing_item_by_item(sizes):
    classes = defaultdict(int)
    for s in sizes:
        classes[s] += 1
    runs = sharding.best_fit_decreasing(list(classes.items()), 60)
    load, ranks = defaultdict(int), defaultdict(list)
    for size, a, z, b in runs:
        load[b] += size * (z - a)
        ranks[size] += range(a, z)
    assert all(v <= 60 for v in load.values())
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in classes.items()}
    assert len(load) == brute_force(sizes, 60)


def test_too_large_a_group_or_too_few_bins():
    assert sharding.best_fit_decreasing([(61, 1)], 60) is None
    assert sharding.best_fit_decreasing([(40, 3)], 60, most=2) is None


def test_documents(spark):
    docs = made.documents(spark)
    out = sharding.shard_documents(docs, 8).collect()
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == texts
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    slots, load, of = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        of[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) <= set(range(8))
    fair = sum(load.values()) / 8
    groups = defaultdict(int)
    for r in out:
        groups[r["size"], r["text_crc32"]] += r["size"]
    assert all(len(s) == 1 for g, s in of.items() if groups[g] <= fair)  # groups stay whole


def test_shards_are_near_equal_with_a_hot_group(spark):
    data = [(i, f"text {i % 700} {'word ' * (i % 23)}" if i % 3 else "hot", "en", "a", 0, 0, 0, 0, "", "") for i in range(3000)]
    out = sharding.shard_documents(made.documents(spark, data), 10).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 10 and max(sizes) <= 1.02 * sum(sizes) / 10


def test_an_empty_table(spark):
    assert sharding.shard_documents(made.empty(spark), 4).collect() == []


def test_rank_within_parts_is_gapless(spark, monkeypatch):
    monkeypatch.setattr(common, "RANK_ROWS", 10)
    from pyspark.sql import functions as F

    df = spark.range(200).select((F.col("id") % 3).alias("p"), (F.col("id") % 50).alias("k"))
    got = common.two_level_rank(df, ["p"], F.col("k"), [F.col("k")], 200, "r").collect()
    for p in range(3):
        own = [r["r"] for r in got if r["p"] == p]
        assert sorted(own) == list(range(len(own)))


@pytest.mark.parametrize("size,want", [(1, 1), (4095, 4095), (4096, 4096), (4097, 4098), (1_000_001, 1_000_192)])
def test_size_classes_round_up_by_under_one_in_2048(spark, size, want):
    from pyspark.sql import functions as F

    got = spark.range(1).select(sharding.size_class(F.lit(size).cast("long")).alias("c")).first()["c"]
    assert got == want and size <= got <= size * (1 + 1 / 2048)
