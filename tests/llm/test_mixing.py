from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from sparkloom.llm import mixing
from tests.llm import made


def targets(sizes: dict, weights: list[float], share: float, most: float) -> dict:
    """Water filling, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, [] if s is None else [ord(c) for c in s]))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set = set()
    total = share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        rate = left / sum(w[s] for s in open_) if open_ else 0.0
        over = [s for s in open_ if w[s] * rate > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else w[s] * rate for s in order}
        capped.update(over)


def test_documents_against_brute_force(spark):
    docs = made.documents(spark)
    out = mixing.mix(docs, [5, 2, 1], 1.5, 2.0).collect()
    words = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()]
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter(words)
    sizes = defaultdict(int)
    for _, s, n in words:
        sizes[s] += n
    want = targets(sizes, [5, 2, 1], 1.5, 2.0)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        expected = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert not r["size"] or int(expected) <= r["copies"] <= int(expected) + 1
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6


def test_reruns_agree_whatever_the_partitions(spark):
    docs = made.documents(spark)
    a = sorted(map(tuple, mixing.mix(docs, [5, 2, 1], 1.5, 2.0).na.fill(-1).na.fill("").collect()))
    b = sorted(map(tuple, mixing.mix(docs.repartition(2), [5, 2, 1], 1.5, 2.0).na.fill(-1).na.fill("").collect()))
    assert a == b


@pytest.mark.parametrize("share,most", [(3.0, 2.0), (1.5, 2.0), (1.0, 1.0), (0.4, 2.0), (1.99, 2.0)])
def test_targets_where_some_or_all_sources_are_capped(spark, share, most):
    docs = made.documents(spark)
    sizes = {r["source"]: r["source_size"] for r in mixing.mix(docs, [5, 2, 1], share, most).collect()}
    want = {s: min(t, most * sizes[s]) for s, t in targets(sizes, [5, 2, 1], share, most).items()}
    out = mixing.mix(docs, [5, 2, 1], share, most).collect()
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in out)
    if share >= most:
        assert all(r["taken"] == most * r["size"] for r in out)


def test_a_row_that_repeats_very_often(spark):
    from pyspark.sql import functions as F

    row = made.documents(spark, [(1, "six words are in this text", "en", "a", 0, 0, 0, 0, "", "")])
    rest = made.documents(spark, [(i, "two words", "en", "b", 0, 0, 0, 0, "", "") for i in range(2, 2000)])
    docs = row.crossJoin(spark.range(100_000).select()).unionByName(rest)
    out = mixing.mix(docs, [5, 2], 1.1, 2.0)
    got = {r["source"]: r for r in out.groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    assert got["a"]["n"] == 100_000 and abs(got["a"]["taken"] - got["a"]["target"]) <= 3 and got["a"]["most"] - got["a"]["least"] == 1
    assert abs(got["b"]["taken"] - got["b"]["target"]) <= 1
    kept = mixing.mixed(docs, [5, 2], 1.1, 2.0)
    assert kept.filter("source = 'a'").count() * 6 == got["a"]["taken"]


def test_many_blocks_meet_in_a_tree_and_keep_their_expectation(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 17 + 1).alias("size"), F.lit(0.37).alias("expected"))
    out = mixing.pivotal_copies(rows, 20_000)
    got = out.agg(F.sum(F.col("copies") * F.col("size")), F.count("*"), F.avg("copies"), F.max("copies")).first()
    want = rows.agg(F.sum("size")).first()[0] * 0.37
    assert got[1] == 20_000 and got[3] == 1 and abs(got[0] - want) <= 9
    by_size = out.groupBy("size").agg(F.avg("copies")).collect()
    assert all(abs(r[1] - 0.37) < 0.06 for r in by_size)


def test_mixed_repeats_rows_as_they_are(spark):
    docs = made.documents(spark)
    copies = Counter()
    for r in mixing.mix(docs, [5, 2, 1], 1.5, 2.0).collect():
        copies[r["doc_id"], r["source"], r["size"]] += r["copies"]
    out = mixing.mixed(docs, [5, 2, 1], 1.5, 2.0)
    assert out.schema == docs.schema
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], n(r["text"])) for r in out.collect()) == +copies


def test_empty_tables_and_sources_without_words(spark):
    assert mixing.mix(made.empty(spark), [5, 2, 1], 1.5, 2.0).collect() == []
    assert mixing.mixed(made.empty(spark), [5, 2, 1], 1.5, 2.0).collect() == []
    one = made.documents(spark, [(1, None, "en", "a", 0, 0, 0, 0, "", ""), (2, " ", "en", None, 0, 0, 0, 0, "", "")])
    assert sorted((r["doc_id"], r["size"], r["taken"], r["target"]) for r in mixing.mix(one, [5, 2, 1], 1.5, 2.0).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
