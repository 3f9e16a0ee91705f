from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import fingerprints as fp
from tests.llm import made

TEXT = st.text(alphabet="abc ", max_size=40)


@settings(max_examples=80, deadline=None)
@given(TEXT, TEXT)
def test_spans_and_extensions(a, b):
    x, y = fp.PrefixHash(fp.code_points(a)), fp.PrefixHash(fp.code_points(b))
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert fp.common_extension(x, i, y, j) == n
    if len(a) >= 3 and len(b) >= 3:
        assert (x.span(0, 3) == y.span(len(b) - 3, 3)) == (a[:3] == b[-3:])


def test_long_texts_hash_as_by_plain_arithmetic():
    text = "äb𝔘" * 5000
    h = fp.PrefixHash(fp.code_points(text))
    for base, got in zip(fp.BASES, h.total(), strict=True):
        want, power = 0, 1
        for c in text:
            want, power = (want + (ord(c) + 1) * power) % fp.P, power * base % fp.P
        assert got == want


def test_likeness_estimates_the_share_of_common_spans():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    a, b = " ".join(words), " ".join(words[:1500] + words[1500:2200])
    f = lambda t: fp.fingerprint(h := fp.PrefixHash(fp.code_points(t)), fp.sketch(h))
    spans = lambda t: {t[i : i + fp.SPAN] for i in range(len(t) - fp.SPAN + 1)}
    want = len(spans(a) & spans(b)) / len(spans(a) | spans(b))
    assert abs(fp.likeness(f(a), f(b)) - want) < 0.2
    assert fp.likeness(f(a), f(a)) == 1.0 and fp.likeness(f(a), f("zzzzzzzzzzzzz")) == 0.0


def check(docs, monkeypatch, part_bytes, linked=1000):
    monkeypatch.setattr(fp, "PART_BYTES", part_bytes)
    monkeypatch.setattr(fp, "LINKED", linked)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, signed(r["text"] or ""), r["text"] or "") for r in docs.collect()))
    rows = [(some, d, t) for some, d, _, t in rows]
    want = Counter()
    for i, (some, doc_id, text) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        want[doc_id if some else None, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    out = fp.with_next(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == want
    by_text = {}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    texts = {d: t for _, d, t in rows}
    for r in out:
        if r["doc_id"] is not None:
            assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)


def test_documents_in_one_part_and_in_many(spark, monkeypatch):
    docs = made.documents(spark)
    check(docs, monkeypatch, 16 << 20)
    check(docs, monkeypatch, 2000)
    check(docs, monkeypatch, 2000, linked=3)


def test_very_many_rows_of_one_doc_id(spark, monkeypatch):
    rows = [(None, f"text {i % 50}", "en", "a", 0, 0, 0, 0, "", "") for i in range(400)] + [(7, "seven " * 30, "en", "a", 0, 0, 0, 0, "", "")]
    docs = made.documents(spark, rows)
    monkeypatch.setattr(fp, "PART_BYTES", 100)
    out = fp.with_next(docs).collect()
    texts = sorted((r[1] for r in rows[:-1]), key=lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)) + [rows[-1][1]]
    edited = Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in zip(texts, texts[1:] + texts[:1], strict=True))
    assert Counter(r["edited_sha256"] for r in out) == edited


def test_texts_are_shuffled_once(spark):
    docs = made.documents(spark)
    out = fp.with_next(docs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"- Exchange rangepartitioning", final)) == 1 and final.count("Exchange rangepartitioning") > final.count("- Exchange rangepartitioning")


def test_empty_and_single(spark):
    assert fp.with_next(made.empty(spark)).collect() == []
    r = fp.with_next(made.documents(spark, [(5, "abcd", "en", "a", 0, 0, 0, 0, "", "")])).collect()
    assert [(x["doc_id"], x["edited_sha256"], x["near_next"]) for x in r] == [(5, hashlib.sha256(b"abab").hexdigest(), 1.0)]
