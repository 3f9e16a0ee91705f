"""Personal data in texts, also where it is disguised.

The base kinds are found in the text as it stands.  A transducer then rewrites the
text: lookalike letters and digits to ASCII, invisible characters to nothing, "at"
and "dot" disguises to their signs, runs of spelled digits to digits.  It keeps, for
each piece that it copied or rewrote, where in the source it came from; identifiers
found in the rewritten text are mapped back by it to spans of source characters.
Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A failed match can't succeed from a later digit of the same run, nor can a match end inside one.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_DOTTED = re.compile(r"\.[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _ip_spans(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()


def _card_spans(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def _phone_spans(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            yield "phone", m.start(), m.end()


def _email_spans(text: str) -> Iterator[Span]:
    """As [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ matches, in time linear in the
    text: from each @, to the left over local characters that no match has taken."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    """The base kinds in the text as it stands, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += _email_spans(text)
    if _DIGITS.search(text):
        out += _card_spans(text)
        if _DOTTED.search(text):
            out += _ip_spans(text)
        if "+" in text:
            out += _phone_spans(text)
    return _order(out)


def _lookalikes() -> dict[int, str]:
    pairs = {
        "АВЕКМНОРСТХІЈЅ": "ABEKMHOPCTXIJS", "аеорсухіјѕԁһԛԝ": "aeopcyxijsdhqw", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX", "ονρ": "ovp",
        "ɑɡıℓ": "agil", "．。｡․": "....", "﹫＠": "@@", "‐‑‒–−﹣－": "-------", "＋﹢": "++",
    }
    out = {ord(a): b for k, v in pairs.items() for a, b in zip(k, v, strict=True)}
    for a, b, base in ((0xFF10, 0xFF1A, "0"), (0xFF21, 0xFF3B, "A"), (0xFF41, 0xFF5B, "a")):
        out |= {c: chr(ord(base) + c - a) for c in range(a, b)}
    for c in range(0x1D400, 0x1D800):  # mathematical letters and digits
        n = unicodedata.normalize("NFKC", chr(c))
        if len(n) == 1 and n.isascii() and n.isalnum():
            out[c] = n
    for c in [*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970)]:  # other digits
        out[c] = str(unicodedata.digit(chr(c)))
    for c in (0xA0, 0x2007, 0x2009, 0x202F, 0x3000):
        out[c] = " "
    return out


_LOOKALIKES = _lookalikes()
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_ODD = frozenset(map(chr, _LOOKALIKES)) | frozenset(_INVISIBLE)
#: Digits in English, German, Spanish and French; the articles un and une, which stand before numbers in prose, are left out.
_SPELLED = {w: str(d) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro - deux trois quatre cinq six sept huit neuf") for d, w in enumerate(words.split()) if w != "-"} | {"oh": "0", "zwo": "2", "fuenf": "5"}


def _any_of(words: list[str]) -> str:
    """A pattern of any of the words that reads each letter once."""
    by: dict[str, list[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    some = "|".join(c + _any_of(rest) for c, rest in sorted(by.items()))
    return (f"(?:{some})" if len(by) > 1 or "" in words and by else some) + ("?" if "" in words and by else "")


_DIGIT_WORD = _any_of(list(_SPELLED))
_NUMBER_SEP = r"(?:[ ]*[ ,-][ ]*|[ ]*\.[ ]*|[ ]+(?:dot|point|punkt|punto)[ ]+)"
#: Two neighbours of _NUMBER_WORDS of which one is a word, in lower case: every run that is rewritten holds such a pair.
_PAIR = re.compile(rf"\b(?:{_DIGIT_WORD}){_NUMBER_SEP}(?:(?:{_DIGIT_WORD})\b|[0-9])|[0-9]{_NUMBER_SEP}(?:{_DIGIT_WORD})\b")
#: Letters that match i and s where case is ignored.
_FOLD = {0x130: "i", 0x131: "i", 0x17F: "s"}
_BRACKETED = re.compile(r"[\[({<][ ]{0,3}(?:at|dot|@|\.)[ ]{0,3}[\])}>]", re.I)
_DOTS_SPOKEN = (" dot ", " punkt ", " punto ", " point ", " . ")
_AT_BRACKET = re.compile(r"[ ]{0,3}[\[({<][ ]{0,3}(?:at|@)[ ]{0,3}[\])}>][ ]{0,3}", re.I)
_DOT_BRACKET = re.compile(r"[ ]{0,3}[\[({<][ ]{0,3}(?:dot|\.)[ ]{0,3}[\])}>][ ]{0,3}", re.I)
_LABEL = r"[A-Za-z0-9-]{1,63}"
_DOT_SPOKEN = r"(?:[ ]{1,3}(?:dot|punkt|punto|point)[ ]{1,3}|[ ]{1,3}\.[ ]{1,3})"
_BRACKET = r"[ ]{{0,3}}[\[({{<][ ]{{0,3}}(?:{0})[ ]{{0,3}}[\])}}>][ ]{{0,3}}"
_ANY_DOT = rf"(?:{_DOT_SPOKEN}|{_BRACKET.format('dot|[.]')}|\.)"
#: Domains that bare words may end in; those that are words of prose (at, in, is, it, me, no, so, to, us) are left out.
_ENDS = "com|org|net|edu|gov|mil|int|info|biz|name|io|dev|app|ai|co|eu|uk|de|fr|es|ch|nl|pl|ru|jp|cn|br|ca|au|nz|se|fi|dk|pt|cz|gr|ie|kr|mx|ar|cl|za|ua|tr|test|example|invalid|localhost"
# "name at host dot com": bare words count only if what follows can be a domain
_SPOKEN = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9_%+-]{{1,64}}{_ANY_DOT}){{0,4}}[A-Za-z0-9_%+-]{{1,64}}(?P<at>[ ]{{1,3}}(?:at|arroba|@)[ ]{{1,3}}|{_BRACKET.format('at|@')}|@){_LABEL}(?:{_ANY_DOT}{_LABEL}){{0,5}}(?:{_DOT_SPOKEN}|{_BRACKET.format('dot|[.]')})(?:{_ENDS})(?![A-Za-z0-9])", re.I)
_IP_SPOKEN = re.compile(rf"\b[0-9]{{1,3}}(?:(?:{_DOT_SPOKEN})[0-9]{{1,3}}){{3}}\b", re.I)
_SPOKEN_DOT = re.compile(_DOT_SPOKEN, re.I)
_SPOKEN_AT = re.compile(r"[ ]{1,3}(?:at|arroba)[ ]{1,3}", re.I)
_NUMBER_WORDS = re.compile(rf"(?:\b(?:plus|más)[ ]+|\+[ ]*)?\b(?:{_DIGIT_WORD}|[0-9]+)(?:{_NUMBER_SEP}(?:{_DIGIT_WORD}|[0-9]+))+\b", re.I)
_NUMBER_PART = re.compile(rf"(?P<word>\b(?:{_DIGIT_WORD})\b)|(?P<digits>[0-9]+)|(?P<dot>[ ]+(?:dot|point|punkt|punto)[ ]+|[ ]*\.[ ]*)|(?P<plus>(?:plus|más|\+)[ ]+)|(?P<gap>[ ]*[ ,-][ ]*)", re.I)


class Rewritten:
    """A text rewritten piece by piece, with the source of each piece."""

    def __init__(self, source: str) -> None:
        self.source, self.parts, self.size = source, [], 0
        self.at: list[int] = []  # where pieces start in the new text
        self.src: list[tuple[int, int, bool]] = []  # their source start and end, and whether copied one to one
        self.done = 0

    def upto(self, end: int) -> None:
        if end > self.done:
            self._piece(self.source[self.done : end], self.done, end, True)

    def put(self, new: str, start: int, end: int) -> None:
        self.upto(start)
        self._piece(new, start, end, False)

    def _piece(self, new: str, start: int, end: int, copied: bool) -> None:
        if new:
            self.at.append(self.size)
            self.src.append((start, end, copied))
            self.parts.append(new)
            self.size += len(new)
        self.done = end

    def text(self) -> str:
        self.upto(len(self.source))
        return "".join(self.parts)

    def start(self, i: int) -> int:
        k = bisect_right(self.at, i) - 1
        a, _, copied = self.src[k]
        return a + (i - self.at[k] if copied else 0)

    def end(self, i: int) -> int:
        """The source end of the character before i."""
        k = bisect_right(self.at, i - 1) - 1
        a, b, copied = self.src[k]
        return a + (i - self.at[k]) if copied else b


def _odd(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
        return "\xa0" in text or "\xad" in text
    except UnicodeEncodeError:
        return not _ODD.isdisjoint(text)


def _plain(text: str) -> Rewritten:
    out = Rewritten(text)
    for i, c in enumerate(text):
        if c in _ODD:
            out.put(_LOOKALIKES.get(ord(c), ""), i, i + 1)
    return out


def _disguised(text: str) -> tuple[bool, bool, bool]:
    """Whether the text may hold bracketed signs, spoken dots, and spelled digits next to others."""
    low = text.lower()
    if not text.isascii():
        low = low.replace("\u017f", "s").replace("i\u0307", "i")
    dots = any(d in low for d in _DOTS_SPOKEN)
    return _BRACKETED.search(text) is not None, dots, _PAIR.search(low) is not None


def _said(text: str, brackets: bool, dots: bool, digits: bool) -> Rewritten:
    edits: list[tuple[int, int, str]] = []
    for m in _AT_BRACKET.finditer(text) if brackets else ():
        edits.append((m.start(), m.end(), "@"))
    for m in _DOT_BRACKET.finditer(text) if brackets else ():
        edits.append((m.start(), m.end(), "."))
    for m in _SPOKEN.finditer(text) if dots or brackets else ():
        if m["at"] != "@":
            edits.append((*m.span("at"), "@"))
        for d in _SPOKEN_DOT.finditer(text, m.start(), m.end()):
            edits.append((d.start(), d.end(), "."))
    for m in _IP_SPOKEN.finditer(text) if dots else ():
        edits += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(text, m.start(), m.end())]
    for m in _NUMBER_WORDS.finditer(text) if digits else ():
        parts = list(_NUMBER_PART.finditer(text, m.start(), m.end()))
        if not any(p["word"] for p in parts):
            continue
        kinds = [p.lastgroup for p in parts]
        for i, p in enumerate(parts):
            if p["word"]:
                edits.append((p.start(), p.end(), _SPELLED[p[0].translate(_FOLD).lower()]))
            elif p["dot"]:
                edits.append((p.start(), p.end(), "."))
            elif p["plus"]:
                edits.append((p.start(), p.end(), "+"))
            elif p["gap"] and "word" in kinds[i - 1 : i + 2]:
                # digits stay apart from a word, as "10.0.0.1 one" is no longer address
                edits.append((p.start(), p.end(), " " if "digits" in kinds[i - 1 : i + 2] else ""))
    out, done = Rewritten(text), 0
    for a, b, new in sorted(edits):
        if a >= done:
            out.put(new, a, b)
            done = b
    return out


def _strays(text: str, found: str, span: Span, spans: list[Span]) -> bool:
    """Whether a number of the rewritten text only takes one spelled digit of the prose beside it
    to a number that stands in digits ("+1 555 123 4567 one day")."""
    kind, a, b = span
    if kind == "email":
        return False
    digits = sum(map(str.isdigit, found))
    return any(k == kind and y < b and a < z and digits - sum(map(str.isdigit, text[y:z])) < 2 for k, y, z in spans)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans; an added one lies inside no other of
    its kind."""
    base = base_spans(text)
    plain = _plain(text) if _odd(text) else None
    flat = plain.text() if plain else text
    marks = _disguised(flat)
    said = _said(flat, *marks) if any(marks) else None
    if not plain and not (said and said.src):
        return base, base
    out = list(base)
    forms = []
    if plain:
        forms.append((flat, lambda i: plain.start(i), lambda i: plain.end(i), False))
    if said:
        up = (lambda i: plain.start(i)) if plain else (lambda i: i)
        up_end = (lambda i: plain.end(i)) if plain else (lambda i: i)
        forms.append((said.text(), lambda i: up(said.start(i)), lambda i: up_end(said.end(i)), True))
    for form, start, end, spelled in forms:
        digits = list(out) if spelled else []
        for kind, a, b in base_spans(form):
            s = (kind, start(a), end(b))
            if not any(k == kind and y <= s[1] and s[2] <= z for k, y, z in out) and not _strays(text, form[a:b], s, digits):
                out.append(s)
    return base, _order(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted of every row.

    Counts and the digest are of the base spans, ``spans`` lists all.  A null text counts
    as empty: no spans, the digest of the empty string; its redacted text is null.
    Repeated rows give repeated results, an empty table an empty one.  Very long texts are
    searched whole, in linear time.  Reads doc_id and text alone."""
    common.bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for i, text in zip(x["doc_id"], x["text"], strict=True):
                base, spans = all_spans(text or "")
                n = [sum(k == s[0] for s in base) for k in KINDS]
                rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), None if text is None else redacted(text, spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in ``text`` replaced by its kind in angle brackets, and n_chars, if
    it is a column of docs, that of the new text.  A null text stays null, all rows stay; columns
    of any other name are kept; an empty table stays empty."""

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [t if t is None else redacted(t, all_spans(t)[1]) for t in batch.column("text").to_pylist()]
        names = batch.schema.names
        batch = batch.set_column(names.index("text"), batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))
        if "n_chars" in names:
            field = batch.schema.field("n_chars")
            old = batch.column("n_chars").to_pylist()
            sizes = pa.array([o if t is None else len(t) for t, o in zip(new, old, strict=True)], pa.int64())
            batch = batch.set_column(names.index("n_chars"), field, sizes.cast(field.type))
        return batch

    return common.map_texts(docs, change)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents")).drop("redacted")
