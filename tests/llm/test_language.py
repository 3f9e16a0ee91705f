from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language
from tests.llm import made


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(0)
    net = language.Network.fresh(["a", "b", "c"], 4, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(97, 105, size=(6, 5)), rng.integers(0, 3, 6)
    _, grad = net.step(x, y)
    for k, g in grad.items():
        flat = net.p[k].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(g.reshape(-1)) > 1e-9), 6):
            was = flat[i]
            flat[i] = was + 1e-6
            up, _ = net.step(x, y)
            flat[i] = was - 1e-6
            down, _ = net.step(x, y)
            flat[i] = was
            assert (up - down) / 2e-6 == pytest.approx(g.reshape(-1)[i], rel=1e-3, abs=1e-7), k


def corpus(spark, n=600):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        lang = rng.choice(list(made.WORDS))
        rows.append((i, made.sentence(rng, lang, rng.randint(4, 40)), lang, "s", 0, 0, 0, 0, "", ""))
    return made.documents(spark, rows)


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    net = language.learn(docs)
    out = language.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def test_noise_is_rejected_and_held_out_documents_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net, rng = language.learn(docs), random.Random(1)
    noise = made.documents(spark, [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600)), "en", "s", 0, 0, 0, 0, "", "") for i in range(200)])
    assert language.keep_identified(noise, net, 0.3).count() <= 40
    real = docs.filter(language.held_out() & F.col("text").rlike(r"\p{L}"))
    assert language.keep_identified(real, net, 0.3).count() >= 0.995 * real.count()
    right = language.identify(real, net).join(real.select("doc_id", "lang"), "doc_id").filter("lang = lang_pred").count()
    assert right >= 0.98 * real.filter("lang IS NOT NULL").count()


def test_learning_is_the_same_again_and_never_sees_held_out_rows(spark):
    docs = corpus(spark, 200)
    wrong = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit("zz")).otherwise(F.col("lang")))
    a, b = language.learn(docs), language.learn(wrong.repartition(2))
    assert a.langs == b.langs and all((a.p[k] == b.p[k]).all() for k in a.p)


@pytest.mark.parametrize("doc_id", [i for i in range(1, 15) if zlib.crc32(str(i).encode()) % 5][:9] + [None])
@pytest.mark.parametrize("same", [True, False])
def test_repeated_ids_neither_exceed_the_sample_nor_crowd_a_language_out(spark, doc_id, same):
    rng = random.Random(doc_id)
    text = made.sentence(rng, "en", 9)
    rows = [(doc_id, text if same else f"{text} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "en", "s", 0, 0, 0, 0, "", "") for i in range(10_000)]
    rows += [(20 * i + 1, made.sentence(rng, "de", 9), "de", "s", 0, 0, 0, 0, "", "") for i in range(40)]
    sample = language.training_sample(made.documents(spark, rows), 300, 150)
    by = Counter(lang for lang, _ in sample)
    assert by["en"] == (1 if same else 300) and 25 <= by["de"] <= 40


def test_the_labeller_equals_reading_each_word_alone():
    net = language.Network.fresh(["a", "b"], 4, 3)
    text = "Straße ünd the Mañana " * 3 + "x" * 120
    words = language.words_of(text)
    want = np.concatenate([net.positions(np.frombuffer(w + b" ", np.uint8)[None, :])[:, 0] for w in words]).mean(axis=0)
    got = next(language.Labeller(net).documents([text]))
    assert np.allclose(got, want, atol=1e-5)


def test_long_texts_are_labelled_in_parts(monkeypatch):
    net = language.Network.fresh(["a", "b"], 4, 3)
    rng = random.Random(2)
    texts = [made.sentence(rng, "en", n) for n in (3, 500, 0, 7, 90)]
    whole = list(language.Labeller(net).documents(texts))
    monkeypatch.setattr(language, "CACHE", 40)
    parts = list(language.Labeller(net).documents(texts))
    assert whole[2] is None and parts[2] is None
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole, parts, strict=True) if a is not None)


def test_documents_without_letters_and_nothing_to_learn_from(spark):
    docs = made.documents(spark)
    net = language.learn(docs)
    out = {r["doc_id"]: r for r in language.identify(docs, net).collect()}
    for i in (2000, 2001, 2002, 2003):
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
    assert out[2004]["lang_pred"] in net.langs
    kept = language.keep_identified(docs, net, 0.3)
    assert kept.schema == docs.schema
    assert {2000, 2001, 2002, 2003}.isdisjoint(r["doc_id"] for r in kept.collect())
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.learn(unlabelled) is None
    assert {r["lang_pred"] for r in language.identify(unlabelled, None).collect()} == {"und"}
    assert language.keep_identified(docs, None, 0.3).filter("doc_id = 2004").count() == 1
    assert language.keep_identified(made.empty(spark), net, 0.3).collect() == []
    assert language.learn(made.empty(spark)) is None and language.identify(made.empty(spark), None).collect() == []
