from __future__ import annotations

import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import sentencepiece as sp
from tests.llm import made


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces.load()


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abcdefgh thequick  ÄÖßéñ漢字🙂.,-1239"), max_size=80))
def test_ids_are_those_of_the_models_own_encoder(pieces, model, text):
    assert pieces.encode(text) == model.encode(text)
    assert pieces.decode(pieces.encode(text)) == text


@settings(max_examples=60, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text_comes_back(pieces, text):
    assert pieces.decode(pieces.encode(text)) == text


def test_long_words_and_many_texts(pieces, model):
    rng = random.Random(4)
    long = ["x" * 5000, "".join(rng.choice("etaoinshr") for _ in range(3000)), " " * 400, "ab" * 600 + " end", "antidisestablishmentarianism" * 9]
    assert [pieces.encode(t) for t in long] == [model.encode(t) for t in long]
    assert pieces.encode_many([*long, None, ""], chars=100) == [*(model.encode(t) for t in long), [], []]


def test_the_lattice_path_is_the_merges_result(pieces):
    rng = random.Random(6)
    for _ in range(300):
        w = sp.SPACE + "".join(rng.choice("etaoinsrhldcu") for _ in range(rng.randint(1, 40)))
        assert pieces.path(w) == pieces.merge(w)


def test_the_real_table_against_the_models_own_encoder(spark, pieces, model, folder):
    out = {r["doc_id"]: list(r["ids"]) for r in sp.encode(spark.read.parquet(f"{folder}/documents.parquet"), pieces).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(rows)
    assert all(out[r["doc_id"]] == model.encode(r["text"] or "") for r in rows if sp.SPACE not in (r["text"] or ""))


def test_documents(spark, pieces, model):
    docs = made.documents(spark)
    out = {r["doc_id"]: r["ids"] for r in sp.encode(docs, pieces).collect() if r["doc_id"] is not None}
    for r in docs.collect():
        if r["doc_id"] is not None and sp.SPACE not in (r["text"] or ""):
            assert out[r["doc_id"]] == model.encode(r["text"] or "")
    back = {r["doc_id"]: r["text"] for r in sp.decode(sp.encode(docs, pieces), pieces).collect() if r["doc_id"] is not None}
    assert back == {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    assert sp.digests(docs, pieces).filter("not round_trip").count() == 0
    assert sp.encode(made.empty(spark), pieces).collect() == []


def brute_viterbi(word: str, table: dict[str, float], unknown: float) -> float:
    best = None
    for n in range(len(word)):
        for cuts in combinations(range(1, len(word)), n):
            at = [0, *cuts, len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:], strict=False)]
            if all(p in table or len(p) == 1 for p in parts):
                s = sum(table.get(p, unknown) for p in parts)
                best = s if best is None or s > best else best
    return best


def test_viterbi_over_the_relational_lattice(spark):
    rng = random.Random(8)
    table = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 64)) / 4 for _ in range(40)}
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in [*words, *words[:5], None, ""]], "word string")
    out = sp.viterbi(df, spark.createDataFrame(list(table.items()), "piece string, score double"), 4, unknown=-100.0).collect()
    assert sorted(r["word"] for r in out) == words
    for r in out:
        assert "".join(r["pieces"]) == r["word"]
        assert r["score"] == pytest.approx(sum(table.get(p, -100.0) for p in r["pieces"]))
        assert r["score"] == pytest.approx(brute_viterbi(r["word"], table, -100.0))
