"""SentencePiece encoding and decoding over a lattice of pieces.

The words of a text are the stretches that no piece crosses: spaces (written ▁) and the
letters, the digit or the signs that follow them.  A word's lattice has an edge for every substring, of at
most the longest piece's length, that the piece table holds; a path of edges is a
segmentation, and a fold over the edges by end keeps the best path to each place.

Two folds:

* ``viterbi``: Spark operations alone - explode the substrings, join them to the piece
  table, group the edges by word, fold with aggregate() - for the path of the
  greatest total score, which is what unigram models encode by.
* ``encode``: the piece table at hand here is a BPE model.  Its scores are merge ranks,
  and the path of the greatest sum isn't its encoding (see the README).  BPE's path
  is the one whose neighbouring pieces all survive each other's merges: a
  segmentation is BPE's if and only if BPE turns each two neighbours into
  themselves.  At most one edge into each place continues the path before it so;
  the fold keeps that one.  Every word is encoded by it.  It runs in Arrow batches next to
  the documents, each word once in a while (a task keeps CACHE of them), for exploding and
  shuffling words or substrings of whole documents would exceed the disk and the time that
  they may take (figures in the README).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_WORD = "▁*[^▁]+|▁+"
#: Words that a task keeps, and pairs of pieces.
CACHE, PAIRS = 500_000, 2_000_000
#: Longer words are folded one at a time and aren't kept.
KEPT = 64
#: Words that are folded together.
BATCH = 8192
_BASE = 0x9E3779B97F4A7C15
_NONE = 1 << 60


class Pieces:
    """A piece table: pieces and scores by id; byte pieces <0x00>..<0xFF> take what no
    other piece holds."""

    def __init__(self, pieces: list[str], scores: list[float], special: frozenset[int] = frozenset({0, 1, 2})) -> None:
        self.pieces, self.scores, self.special = pieces, scores, special
        self.bytes = {p: i for i, p in enumerate(pieces) if re.fullmatch("<0x[0-9A-F]{2}>", p)}
        hidden = special | set(self.bytes.values())
        self.ids = {p: i for i, p in enumerate(pieces) if i not in hidden}
        order = {x: k for k, x in enumerate(sorted(set(scores), reverse=True))}
        self.rank = {p: order[scores[i]] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.word = self._cut()
        self.byte_of = {i: int(p[3:5], 16) for p, i in self.bytes.items()}
        #: What a piece decodes to; a byte from 80 up as the surrogate that escapes it.
        self.shown = [chr(b + (0xDC00 if b > 0x7F else 0)) if (b := self.byte_of.get(i)) is not None else p.replace(SPACE, " ") for i, p in enumerate(pieces)]
        self.words: dict[str, tuple[int, ...]] = {}
        self.stable: dict[int, bool] = {}
        self.table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _cut(self) -> re.Pattern:
        """What a word is: finer than what lies between spaces, if every piece is part of one."""
        odd = "".join(sorted({re.escape(c) for p in self.ids if len(p) > 1 for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
        fine = re.compile(rf"▁*[^\W\d_{odd}]+|▁*\d|▁*(?:[^\w▁]|[_{odd}])+|▁+")
        return fine if all(map(fine.fullmatch, self.ids)) else re.compile(_WORD)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = frozenset(i for i in range(n) if m.is_control(i) or m.is_unknown(i))
        return cls([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], special)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": {}, "stable": {}, "table": None}

    def merge(self, text: str) -> list[str]:
        """BPE of a short string: the best-ranked neighbours merge, leftmost first."""
        rank, parts = self.rank, list(text)
        ranks = [rank.get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], _NONE)
        return parts

    def _symbol(self, piece: str) -> int:
        """A piece's id; of a character that is none, a number beyond them."""
        i = self.ids.get(piece)
        return len(self.pieces) + ord(piece) if i is None else i

    def _shown(self, symbol: int) -> str:
        return self.pieces[symbol] if symbol < len(self.pieces) else chr(symbol - len(self.pieces))

    def _survive(self, a: str, b: str) -> bool:
        """Whether BPE turns a + b into a and b; a may be empty, at a word's start."""
        return self._survives((self._symbol(a) + 1 << 32 if a else 0) | self._symbol(b))

    def _survives(self, pair: int) -> bool:
        found = self.stable.get(pair)
        if found is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            a, b = self._shown((pair >> 32) - 1) if pair >> 32 else "", self._shown(pair & 0xFFFFFFFF)
            found = self.stable[pair] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def path(self, word: str) -> list[str]:
        """BPE's segmentation of a word, by the fold over its lattice: time is linear in the word."""
        ids, n = self.ids, len(word)
        last = [""] * (n + 1)  # the piece that ends the path to each place; none yet: empty
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                piece = word[start:end]
                if (end - start == 1 or piece in ids) and (start == 0 or last[start]) and self._survive(last[start], piece):
                    last[end] = piece
                    break
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def _ids(self, path: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in path:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[f"<0x{b:02X}>"] for b in p.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def _edges(self, codes: np.ndarray) -> np.ndarray:
        """edges[n - 1][:, i]: the piece (-1: none) that is the n characters from place i of each
        word of codes [words, length], looked up by a 64-bit hash of the characters."""
        mix = lambda c: ((c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) ^ (c + np.uint64(1)) * np.uint64(0x94D049BB133111EB) >> np.uint64(29)) | np.uint64(1)

        if self.table is None:
            by: dict[int, list[str]] = {}
            for piece in self.ids:
                by.setdefault(len(piece), []).append(piece)
            names, keys = [], []
            for n, own in by.items():
                mixed = mix(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, n))
                names += own
                h = np.zeros(len(own), np.uint64)
                for k in range(n):
                    h = h * np.uint64(_BASE) + mixed[:, k]
                keys.append(h ^ np.uint64(n))
            keys = np.concatenate([*keys, np.array([0, (1 << 64) - 1], np.uint64)])
            if len(set(keys.tolist())) < len(keys):
                raise ValueError("two pieces have one hash")
            order, some = np.argsort(keys), np.zeros(1 << 21, bool)
            some[keys >> np.uint64(43)] = True
            self.table = keys[order], np.array([*(self.ids[p] for p in names), -1, -1], np.int64)[order], some
        keys, ids, some = self.table
        mixed = mix(codes.astype(np.uint64))
        out, h = np.full((min(self.longest, codes.shape[1]), *codes.shape), -1, np.int64), np.zeros_like(mixed)
        for n in range(1, len(out) + 1):
            h = h[:, : codes.shape[1] - n + 1] * np.uint64(_BASE) + mixed[:, n - 1 :]
            own = h ^ np.uint64(n)
            row, col = np.nonzero(some[own >> np.uint64(43)])  # few that are no piece
            maybe = own[row, col]
            at = np.searchsorted(keys, maybe)
            out[n - 1][row, col] = np.where(keys[at] == maybe, ids[at], -1)
        return out

    def fold_many(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of words of one length, by the fold of ``path`` over all their lattices at once."""
        count, size, first = len(words), len(words[0]), len(self.pieces)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(count, size)
        edges = self._edges(codes)
        edges[0] = np.where(edges[0] < 0, codes.astype(np.int64) + first, edges[0])
        last = np.full((size + 1, count), -1, np.int64)  # the symbol that ends the path to each place
        last[0] = -2
        length = np.zeros((size + 1, count), np.int64)
        for end in range(1, size + 1):
            open_ = np.arange(count)
            for n in range(min(len(edges), end), 0, -1):
                piece, before = edges[n - 1][open_, end - n], last[end - n][open_]
                there = np.flatnonzero((piece >= 0) & (before != -1))
                if not len(there):
                    continue
                pairs = (np.where(before[there] == -2, 0, before[there] + 1 << 32) | piece[there]).tolist()
                found = list(map(self.stable.get, pairs))
                if None in found:
                    found = [self._survives(p) if f is None else f for p, f in zip(pairs, found, strict=True)]
                there = there[np.array(found, bool)]
                done = open_[there]
                last[end, done], length[end, done] = piece[there], n
                left = np.ones(len(open_), bool)
                left[there] = False
                open_ = open_[left]
                if not len(open_):
                    break
        out: list[list[int]] = [[] for _ in words]
        at, live = np.full(count, size), np.arange(count)
        while len(live):
            symbols, steps = last[at[live], live], length[at[live], live]
            for w, i in zip(live.tolist(), symbols.tolist(), strict=True):
                out[w].append(i)
            at[live] -= steps
            live = live[at[live] > 0]
        return [tuple(o[::-1]) if max(o) < first else self._ids([self._shown(i) for i in o[::-1]]) for o in out]

    def learn_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of all words, and of words met before; those of over KEPT characters aren't kept."""
        words, known = set(words), self.words
        fresh = words.difference(known)
        if len(known) + len(fresh) > CACHE:
            known.clear()
            fresh = words
        by: dict[int, list[str]] = {}
        for w in fresh:
            by.setdefault(len(w), []).append(w)
        long = {w: self._ids(self.path(w)) for n, own in by.items() if n > KEPT for w in own}
        for n, own in by.items():
            for i in range(0, len(own) if n <= KEPT else 0, BATCH):
                known.update(zip(own[i : i + BATCH], self.fold_many(own[i : i + BATCH]), strict=True))
        return known | long if long else known

    def _words(self, text: str, first: bool = True) -> list[str]:
        return self.word.findall((SPACE if first else "") + text.replace(" ", SPACE))

    def _of_words(self, words: list[str]) -> list[int]:
        look = self.learn_words(words)
        return list(chain.from_iterable(map(look.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None], chars: int = 4_000_000) -> list[list[int]]:
        """Ids of each text; about ``chars`` characters' words are held at a time."""
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            size, end, words = 0, at, []
            while end < len(texts) and (size == 0 or size + len(texts[end] or "") <= chars):
                text = texts[end] or ""
                if SPACE in text or len(text) > chars:
                    break
                words.append(self._words(text) if text else [])
                size, end = size + len(text), end + 1
            if words:
                look = self.learn_words(chain.from_iterable(words))
                out += [list(chain.from_iterable(map(look.__getitem__, own))) for own in words]
                at = end
            else:
                out.append(self._long(texts[at], chars))
                at += 1
        return out

    def _long(self, text: str, chars: int) -> list[int]:
        """A text that is long or holds ▁: cut before spaces, which nothing crosses."""
        out: list[int] = []
        first = True
        for k, part in enumerate(text.split(SPACE)):
            if k:
                if first:
                    out.append(self.ids[SPACE])
                    first = False
                out += [self.bytes[f"<0x{b:02X}>"] for b in SPACE.encode()]
            at = 0
            while at < len(part):
                cut = part.find(" ", at + chars)
                while cut > 0 and part[cut - 1] == " ":  # not inside a run of spaces
                    cut = part.find(" ", cut + 1)
                cut = len(part) if cut < 0 else cut
                out += self._of_words(self._words(part[at:cut], first))
                at, first = cut, False
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids.  Byte pieces stand for the bytes of characters that no piece holds;
        bytes that make no character are shown as U+FFFD."""
        text = "".join(map(self.shown.__getitem__, ids))
        if not self.byte_of.keys().isdisjoint(ids):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, ids of every row: a null or empty text has no ids.

    ids are those of the model's own encoder; only a ▁ of the text itself is encoded as
    bytes, so that decoding gives each text back exactly.  Repeated rows give repeated
    results, an empty table an empty one.  Very long texts are encoded whole, in parts that
    no piece crosses.  Reads doc_id and text alone."""
    common.bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"doc_id": x["doc_id"], "ids": pieces.encode_many(list(x["text"]))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, text of rows(doc_id, ids)."""
    common.bounded_batches(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"doc_id": x["doc_id"], "text": [pieces.decode([] if i is None else list(i)) for i in x["ids"]]})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of little-endian 32-bit ids), round_trip (whether the ids
    decode to the text; a null text counts as empty) of every row."""
    common.bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for i, t, ids in zip(x["doc_id"], x["text"], pieces.encode_many(list(x["text"])), strict=True):
                rows.append((i, len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), pieces.decode(ids) == (t or "")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_pieces long, ids_sha256 string, round_trip boolean")


def viterbi(words: DataFrame, table: DataFrame, longest: int, unknown: float = -1e6) -> DataFrame:
    """word, pieces, score: for each distinct non-empty word of words(word), the segmentation
    with the greatest sum of the scores of table(piece, score); ties go to the longer last
    piece.  A character that no piece holds is a piece of its own with score ``unknown``.

    table is a vocabulary, of a size that doesn't follow the corpus; Spark broadcasts it
    if it is below the session's threshold and else shuffles."""
    w = words.select("word").filter(F.length("word") > 0).distinct()
    spans = w.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("end"))
    spans = spans.select("word", "end", F.explode(F.sequence(F.greatest(F.lit(1), F.col("end") - (longest - 1)), F.col("end"))).alias("start"))
    spans = spans.withColumn("piece", F.expr("substring(word, start, end - start + 1)"))
    edges = spans.join(table.select("piece", "score"), "piece", "left").filter(F.col("score").isNotNull() | (F.col("start") == F.col("end")))
    edge = F.struct("end", "start", "piece", F.coalesce("score", F.lit(float(unknown))).alias("score"))
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    # state: for each place from 0, the best score to it and where its last piece starts
    place = lambda score, start: F.struct(score.alias("score"), start.alias("start"))
    first = F.array(place(F.lit(0.0), F.lit(0)))

    def step(acc, e):
        score = F.element_at(acc, e["start"])["score"] + e["score"]
        new = F.size(acc) == e["end"]  # no edge has ended here yet
        better = score > F.element_at(acc, -1)["score"]
        head = F.slice(acc, 1, F.size(acc) - 1)
        return F.when(new, F.concat(acc, F.array(place(score, e["start"])))).when(better, F.concat(head, F.array(place(score, e["start"])))).otherwise(acc)

    best = grouped.select("word", F.aggregate("edges", first, step).alias("best"))
    state = F.struct(F.length("word").alias("at"), F.array().cast("array<string>").alias("pieces"))

    def back(acc, _):
        start = F.element_at(F.col("best"), acc["at"] + 1)["start"]
        piece = F.substring(F.col("word"), start, acc["at"] - start + 1)
        moved = F.struct((start - 1).alias("at"), F.concat(F.array(piece), acc["pieces"]).alias("pieces"))
        return F.when(acc["at"] > 0, moved).otherwise(acc)

    path = F.aggregate(F.sequence(F.lit(1), F.length("word")), state, back)["pieces"]
    return best.select("word", path.alias("pieces"), F.element_at("best", -1)["score"].alias("score"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"), Pieces.load())
