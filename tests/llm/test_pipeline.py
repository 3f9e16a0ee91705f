from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
from sparkloom.llm import language, pii, sentencepiece
from tests.llm import made
from tests.llm.test_nearcopies import brute_groups


def test_stages_against_brute_force(spark, tmp_path):
    data = made.rows() + [(9000, "write to a@b.cc or 10.0.0.1 " + "the light in the morning " * 9, "en", "web", 0, 0, 0, 0, "", "")]
    made.documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = stages[name] = spark.read.parquet(f"{tmp_path}/{name}")
    before = docs.collect()
    net = language.learn(docs)
    sure = {(r["doc_id"], r["score"] >= language.least_score(net, corpus_pipeline.LEAST_SURENESS) - 1e-9 and r["lang_pred"] != "und") for r in language.identify(docs, net).collect()}
    kept = stages["language"].collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in before if (r["doc_id"], True) in sure)
    roots = brute_groups([r["text"] for r in kept])
    least = defaultdict(list)
    for r, root in zip(kept, roots, strict=True):
        least[root].append((r["doc_id"] is None, r["doc_id"] or 0))
    single = stages["near_duplicates"].collect()
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in single) == Counter(map(min, least.values()))
    clean = {r["doc_id"]: r["text"] for r in stages["personal_data"].collect()}
    for r in single:
        assert clean[r["doc_id"]] == pii.redacted(r["text"], pii.all_spans(r["text"])[1])
    assert "<EMAIL> or <IP>" in clean[9000]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    copies = Counter(r["doc_id"] for r in stages["mix"].collect())
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    total = sum(words(clean[i]) * n for i, n in copies.items())
    most = max(map(words, clean.values()))
    assert abs(total - 1.5 * sum(map(words, clean.values()))) <= 2 * most
    pieces = sentencepiece.Pieces.load()
    tokens = stages["tokens"].collect()
    assert Counter(r["doc_id"] for r in tokens) == copies
    assert all(list(r["ids"]) == pieces.encode(clean[r["doc_id"]]) and r["n_pieces"] == len(r["ids"]) for r in tokens)
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(repr, tokens))


def test_an_empty_table_passes_through(spark, tmp_path):
    made.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
