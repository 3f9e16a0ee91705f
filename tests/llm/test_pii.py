from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import pii
from tests.llm import made

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text: str) -> list[tuple[str, int, int]]:
    """The contract's patterns as they are."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            n = int(c) * (2 if i % 2 else 1)
            total += n // 10 + n % 10
        return total % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


PARTS = st.sampled_from(["a", "b.c", "@", ".", "x-y", "1", "255", "256", "4111 1111 1111 1111", "4012888888881881", "+1 (415) 555-0100", "+", " ", "-", "é", "%", "10.0.0.1", "at", "dot", "\n", "007", "(", ")"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_all_spans_hold_the_base_spans_in_order(text):
    base, spans = pii.all_spans(text)
    assert not Counter(base) - Counter(spans)
    assert spans == sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))
    assert all(0 <= a < b <= len(text) for _, a, b in spans)


@pytest.mark.parametrize("text,kind,shown", [
    ("write to jane.doe [at] example [dot] org now", "email", "jane.doe [at] example [dot] org"),
    ("write to jane (at) example.org now", "email", "jane (at) example.org"),
    ("jane at example dot org", "email", "jane at example dot org"),
    ("jane.doe at mail.example (dot) com.", "email", "jane.doe at mail.example (dot) com"),
    ("jane [at] example DOT co dot uk", "email", "jane [at] example DOT co dot uk"),
    ("jane @ example . org", "email", "jane @ example . org"),
    ("mail jаne@exаmple.org (Cyrillic)", "email", "jаne@exаmple.org"),
    ("mail ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ!", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ"),
    ("mail ja​ne@example.org", "email", "ja​ne@example.org"),
    ("call +４４ ２０ ７９４６ ０９５８ today", "phone", "+４４ ２０ ７９４６ ０９５８"),
    ("call plus four four two zero seven nine four six zero nine five eight ok", "phone", "plus four four two zero seven nine four six zero nine five eight"),
    ("card ４１１１-１１１１-１１１１-１１１１", "card", "４１１１-１１１１-１１１１-１１１１"),
    ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
    ("host 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
])
def test_disguises_map_back_to_the_source(text, kind, shown):
    _, spans = pii.all_spans(text)
    assert (kind, text.index(shown), text.index(shown) + len(shown)) in spans


@pytest.mark.parametrize("text", ["look at the dot on the map", "we met at noon. one two three", "at one point two or three of them came", "the server at work", "three four five", "meet me at home. Dot com is over", "un, dos, tres. cuatro y cinco", "acht oder neun, null bis drei", "un deux trois"])
def test_prose_is_left_alone(text):
    assert pii.all_spans(text) == ([], [])


def test_redaction_merges_overlaps():
    text = "a@b.cc and 10.0.0.1!"
    assert pii.redacted(text, pii.all_spans(text)[1]) == "<EMAIL> and <IP>!"
    assert pii.redacted("abcdef", [("email", 0, 4), ("ip", 2, 5)]) == "<EMAIL>f"


def test_documents(spark):
    extra = [(9000, "a@b.cc, 10.0.0.1 and +44 20 7946 0958; 4111 1111 1111 1111", "en", "a", 0, 0, 0, 0, "", "")]
    docs = made.documents(spark, made.rows() + extra)
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    want = Counter()
    for (i, t), n in texts.items():
        b = brute(t or "")
        want[i, *(sum(k == s[0] for s in b) for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, x, y in b).encode()).hexdigest()] += n
    out = pii.find(docs)
    assert Counter(tuple(r)[:6] for r in out.collect()) == want
    new = pii.redact(docs)
    assert new.schema == docs.schema
    by = {r["doc_id"]: r for r in new.collect()}
    assert by[9000]["text"] == "<EMAIL>, <IP> and <PHONE>; <CARD>" and by[9000]["n_chars"] == len(by[9000]["text"])
    assert by[2000]["text"] is None and by[2005]["text"] == "x" * 200_000
    assert pii.find(made.empty(spark)).collect() == [] and pii.redact(made.empty(spark)).collect() == []


def test_time_is_linear_in_hostile_texts():
    import time

    for text in ("a" * 300_000, "1" * 300_000, "+1" * 150_000, "a@" * 100_000, "1.1." * 80_000, "one " * 60_000, "a.b@c " * 50_000, "at dot " * 40_000, "a dot " * 40_000, "a" * 100_000 + "@"):
        began = time.time()
        pii.all_spans(text)
        assert time.time() - began < 8, text[:8]


@pytest.mark.parametrize(
    ("kind", "said"),
    [
        ("ip", "eight dot eight dot eight dot eight"),
        ("ip", "one.two.three.four"),
        ("ip", "eight . eight . eight . eight"),
        ("ip", "8.8.8.eight"),
        ("ip", "one point 2 point three point 4"),
        ("card", "4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one"),
        ("card", "four, 111, one, 111, one, 111, one, 111"),
        ("card", "4111 1111 1111 111 one"),
        ("phone", "+4 four 7 seven 0 zero 9 zero 0 one 2 three"),
        ("phone", "plus 44 seven 700900123"),
        ("phone", "plus vier neun drei null eins zwei drei vier fünf sechs sieben"),
        ("phone", "más tres cuatro nueve uno dos tres cuatro cinco seis siete ocho"),
        ("phone", "plus trois trois deux cinq zéro quatre six sept huit neuf neuf"),
        ("ip", "zehn 8 punkt acht punkt acht punkt 8"[5:]),
        ("ip", "ocho punto ocho punto ocho punto ocho"),
        ("ip", "huit point huit point huit point huit"),
        ("card", "Vier EINS eins eins eins eins eins eins eins eins eins eins eins eins eins eins"),
    ],
)
def test_spelled_digits_apart_are_found_whatever_else_is_said(kind, said):
    for before, after in (("see ", " now"), ("one, two. see ", " now"), ("", "")):
        text = before + said + after
        want = (kind, len(before), len(before) + len(said))
        assert want in pii.all_spans(text)[1]


def test_numbers_in_digits_take_no_word_of_prose():
    for text in ("from 10.0.0.1 one sees it", "choose one. 10.0.0.1 is it", "ring +1 555 123 4567 one day", "one 4111 1111 1111 1111 is it", "one, two or three. four of them", "nİne, ſix 7 ſeven"):
        base, spans = pii.all_spans(text)
        assert spans == base
