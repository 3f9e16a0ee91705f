from __future__ import annotations

import random
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import licenses
from tests.llm import made


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=11))
def test_longest_increasing_is_longest(values):
    got = licenses.longest_increasing(values)
    assert got == sorted(got) and all(values[a] < values[b] for a, b in zip(got, got[1:], strict=False))
    best = next(n for n in range(len(values), -1, -1) if any(all(a < b for a, b in zip(c, c[1:], strict=False)) for c in combinations(values, n)))
    assert len(got) == best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefghij"), max_size=20), st.lists(st.sampled_from("abcdefghij"), max_size=20))
def test_alignment_rises_in_both(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert licenses.align(a, a) == [(i, i) for i in range(len(a))]


def test_planted_notices_are_found_where_they_stand():
    rng, scanner = random.Random(3), licenses.Scanner()
    for name, template in licenses.TEMPLATES.items():
        before, after = made.sentence(rng, "de", 40), made.sentence(rng, "fr", 40)
        text = f"{before}. {template.upper()}. {after}"
        found = [f for f in scanner.scan(text) if f[0] == name]
        assert found and found[0][3] == 1.0
        assert text[found[0][1] : found[0][2]].lower() == template
        words = template.split()
        if len(words) > 20:  # a word in ten changed, one left out, one put in
            for i in range(5, len(words), 10):
                words[i] = "otherword"
            text = before + " " + " ".join([*words[:3], "added", *words[4:]]) + " " + after
            assert any(f[0] == name and f[3] >= 0.8 for f in scanner.scan(text))


def test_prose_has_no_licence_and_repeats_count():
    rng, scanner = random.Random(9), licenses.Scanner()
    assert all(scanner.scan(made.sentence(rng, lang, 400)) == [] for lang in made.WORDS for _ in range(20))
    assert scanner.scan("You may use this file and copy it under the terms that apply") == []
    text = ("released under the MIT license. " + made.sentence(rng, "de", 60) + " ") * 3
    assert [f[0] for f in scanner.scan(text)] == ["mit-notice"] * 3


def test_copies_back_to_back_are_all_found():
    rng, scanner = random.Random(4), licenses.Scanner()
    for name, template in licenses.TEMPLATES.items():
        for n in (2, 3, 5):
            for between in (".\n", " so we say "):
                text = made.sentence(rng, "de", 90) + ". " + between.join([template] * n) + ". " + made.sentence(rng, "fr", 90)
                found = [f for f in scanner.scan(text) if f[0] == name]
                assert len(found) == n and all(f[3] == 1.0 and text[f[1] : f[2]] == template for f in found), (name, n)
    words = licenses.TEMPLATES["bsd"].split()
    other = " ".join([*words[:4], "added", *words[4:9], "changed", *words[10:]])
    text = made.sentence(rng, "de", 90) + ". " + ". ".join([other] * 3) + ". " + made.sentence(rng, "fr", 90)
    assert [f[0] for f in scanner.scan(text)] == ["bsd"] * 3


def longest_common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute_coverage(text: str, template: str, stretch: float = 1.25) -> float:
    """The greatest share of the template that is a common subsequence of it and a stretch of the
    text of so many times its length."""
    words, own = [w for w, *_ in licenses.words_at(text)], [w for w, *_ in licenses.words_at(template)]
    size, best = round(len(own) * stretch), 0
    for i in range(len(words)):
        if words[i] in own:
            part = words[i : i + size]
            if sum(w in own for w in part) > best:
                best = max(best, longest_common(part, own))
    return best / len(own)


def test_the_query_against_brute_force_with_planted_licences(spark, tmp_path):
    """Over the real table, into whose texts licences and edited licences are put."""
    rng = random.Random(12)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    names, data, planted = list(licenses.TEMPLATES), [], {}
    for r in rows:
        text = r["text"] or ""
        if r["doc_id"] % 3 == 0:
            words = text.split(" ")
            name = rng.choice(names)
            own = licenses.TEMPLATES[name].split()
            for i in rng.sample(range(len(own)), len(own) * rng.choice([0, 0, 1, 4]) // 10):
                own[i] = "w" + rng.choice("klmn") * 3
            at = rng.randrange(len(words) + 1)
            text = " ".join([*words[:at], *own, *words[at:]])
            planted[r["doc_id"]] = name
        data.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.op7_licenses(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(d for d, *_ in data)
    exact = 0
    for doc_id, text, *_ in data:
        found = {f.split(":")[0]: float(f.split(":")[3]) for f in sorted(got[doc_id]["licenses"].split(","), key=lambda f: f.split(":")[3:]) if f}
        present = set(w for w, *_ in licenses.words_at(text))
        for name, template in licenses.TEMPLATES.items():
            own = [w for w, *_ in licenses.words_at(template)]
            if sum(w in present for w in own) < licenses.LEAST * len(own):
                assert name not in found  # too few of its words
                continue
            want = brute_coverage(text, template)
            if want == 1.0:
                assert found.get(name) == 1.0, (doc_id, name)
                exact += 1
            elif want >= licenses.LEAST + 0.05:
                assert found.get(name, 0.0) >= want - 0.05, (doc_id, name, want, found)
            if name in found:  # words of a template may stand apart, by half its length at a time
                most = want if len(own) > 40 else brute_coverage(text, template, 4)
                assert found[name] <= most + (0.05 if len(own) > 40 else 1e-6), (doc_id, name, most, found)
        assert got[doc_id]["n_licenses"] == len([f for f in got[doc_id]["licenses"].split(",") if f])
    assert exact >= 40


def test_documents(spark):
    docs = made.documents(spark)
    out = licenses.scan(docs).collect()
    assert len(out) == docs.count() and all(r["n_licenses"] == 0 and r["licenses"] == "" and r["coverage"] == 0.0 for r in out)
    assert licenses.scan(made.empty(spark)).collect() == []
    one = made.documents(spark, [(1, "İ licensed under CC-BY-NC-4.0 ok", "en", "a", 0, 0, 0, 0, "", "")])
    r = licenses.scan(one).first()
    assert r["licenses"] == "cc-by-nc-4.0-notice:2:29:1"
