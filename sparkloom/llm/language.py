"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on words of
a bounded sample of labelled documents.  Two GRUs read a word's bytes forwards and
backwards from a zero state; a softmax on both states labels every position.  ASCII
letters are lower-cased and other ASCII bytes separate words, so a position is a
letter's byte or the separator that ends the word.  A document's probabilities are
the mean over all of its positions.  As a word's labels depend on the word alone,
a word that occurs again in a task is looked up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Longer words are read in pieces of so many bytes.
LONGEST = 48
#: Words whose labels a task keeps.
CACHE = 200_000
#: The labeller that a worker's tasks share: one at most, by its network's digest.
_shared: dict[str, Labeller] = {}
_FOLD = bytes((i + 32 if 65 <= i <= 90 else i) if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text, each with its closing separator."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """p: E/U/b of the forward (0) and backward (1) GRU, W and c of the softmax."""

    langs: list[str]
    p: dict[str, np.ndarray]

    def digest(self) -> str:
        h = hashlib.sha256(repr(self.langs).encode())
        for k in sorted(self.p):
            h.update(self.p[k].tobytes())
        return h.hexdigest()

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, seed: int) -> Network:
        rng, p = np.random.default_rng(seed), {}
        for d in "01":
            p[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            p[f"U{d}"] = rng.normal(0, 0.7 / np.sqrt(hidden), (hidden, 3 * hidden))
            p[f"b{d}"] = np.zeros(3 * hidden)
        p["W"] = rng.normal(0, 0.3, (2 * hidden, len(langs)))
        p["c"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def _states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: [words, length] bytes in reading order; states [length, words, hidden]."""
        e, u = self.p[f"E{d}"] + self.p[f"b{d}"], self.p[f"U{d}"]
        n = u.shape[0]
        h = np.zeros((len(x), n), u.dtype)
        out = np.empty((x.shape[1], len(x), n), u.dtype)
        for t in range(x.shape[1]):
            g, a = h @ u, e[x[:, t]]
            zr = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            m = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            if keep is not None:
                keep.append((h, z, r, m, g[:, 2 * n :]))
            h = m + z * (h - m)
            out[t] = h
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities [length, words, languages] of the bytes x [words, length]."""
        s = np.concatenate([self._states(x, "0"), self._states(x[:, ::-1], "1")[::-1]], axis=2)
        v = s @ self.p["W"] + self.p["c"]
        v = np.exp(v - v.max(axis=2, keepdims=True))
        return v / v.sum(axis=2, keepdims=True)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions of words x with languages y, and its gradient."""
        kept: dict[str, list] = {"0": [], "1": []}
        n, size = self.p["U0"].shape[0], x.size
        f = self._states(x, "0", kept["0"])
        b = self._states(x[:, ::-1], "1", kept["1"])[::-1]
        s = np.concatenate([f, b], axis=2)
        v = s @ self.p["W"] + self.p["c"]
        v = np.exp(v - v.max(axis=2, keepdims=True))
        v /= v.sum(axis=2, keepdims=True)
        loss = float(-np.log(v[:, np.arange(len(x)), y] + 1e-12).mean())
        v[:, np.arange(len(x)), y] -= 1
        v /= size
        grad = {"W": np.einsum("tnh,tnk->hk", s, v), "c": v.sum((0, 1))}
        ds = v @ self.p["W"].T
        for d, dh_at, xs in (("0", ds[:, :, :n], x), ("1", ds[::-1, :, n:], x[:, ::-1])):
            u = self.p[f"U{d}"]
            g_e, g_u, g_b = np.zeros_like(self.p[f"E{d}"]), np.zeros_like(u), np.zeros_like(self.p[f"b{d}"])
            dh = np.zeros((len(x), n), u.dtype)
            for t in range(x.shape[1] - 1, -1, -1):
                h, z, r, m, gm = kept[d][t]
                dh = dh + dh_at[t]
                dz = dh * (h - m) * z * (1 - z)
                dm = dh * (1 - z) * (1 - m * m)
                dr = dm * gm * r * (1 - r)
                da = np.concatenate([dz, dr, dm], axis=1)
                dg = np.concatenate([dz, dr, dm * r], axis=1)
                g_u += h.T @ dg
                g_b += da.sum(0)
                np.add.at(g_e, xs[:, t], da)
                dh = dh * z + dg @ u.T
            grad |= {f"E{d}": g_e, f"U{d}": g_u, f"b{d}": g_b}
        return loss, grad


def train(samples: list[tuple[str, list[bytes]]], hidden: int = 8, steps: int = 700, batch: int = 256, seed: int = 1) -> Network:
    """A network from (language, words) samples.  Each step takes words of one length,
    languages evenly; Adam with a falling rate.  Equal samples give an equal network."""
    langs = sorted({lang for lang, _ in samples})
    net = Network.fresh(langs, hidden, seed)
    rng = np.random.default_rng(seed)
    by: dict[int, dict[int, list[bytes]]] = {}
    for lang, words in samples:
        for w in words:
            by.setdefault(len(w) + 1, {}).setdefault(langs.index(lang), []).append(w + b" ")
    arrays = {n: {k: np.frombuffer(b"".join(w), np.uint8).reshape(-1, n) for k, w in g.items()} for n, g in sorted(by.items())}
    lengths = list(arrays)
    weight = np.array([sum(map(len, arrays[n].values())) for n in lengths], float)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    var = {k: np.zeros_like(v) for k, v in net.p.items()}
    total = {k: sum(len(g[k]) for g in arrays.values() if k in g) for k in range(len(langs))}
    for step in range(1, steps + 1):
        group = arrays[lengths[rng.choice(len(lengths), p=weight / weight.sum())]]
        # a language's words of this length, as often as they are among its words
        share = np.array([len(g) / total[k] for k, g in group.items()])
        picks = rng.choice(list(group), size=batch, p=share / share.sum())
        x = np.concatenate([group[k][rng.integers(len(group[k]), size=int((picks == k).sum()))] for k in group])
        y = np.concatenate([np.full(int((picks == k).sum()), k) for k in group])
        _, grad = net.step(x, y)
        rate = 0.02 * (1 - step / (steps + 1)) + 1e-4
        for k, g in grad.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.999 * var[k] + 0.001 * g * g
            net.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_sample(docs: DataFrame, per_lang: int, words: int) -> list[tuple[str, list[bytes]]]:
    """Up to ``words`` words of each of up to ``per_lang`` different texts of each language, those
    whose hash is least; documents whose crc32(doc_id) mod 5 is 0 are held out.

    Texts, not rows, are ranked: copies, and rows that repeat or have no doc_id, count once, so that
    neither they nor the rows of one doc_id can crowd others out or exceed the bound."""
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64("text").alias("_h"))
    # only hashes that can be among a language's least come to its ranking: twice as many as it takes,
    # or all of a language with few texts
    texts = F.approx_count_distinct("_h", 0.02)
    share = F.least(F.lit(1.0), F.lit(2.0 * per_lang) / F.col("_n"))
    counts = usable.groupBy("lang").agg(texts.alias("_n")).select(F.col("lang").alias("_lang"), (share * 2.0**64 - 2.0**63).alias("_least"))
    # a row for each language; the network, which every task gets, has as many
    low = usable.select("lang", "_h").join(F.broadcast(counts), (F.col("lang") == F.col("_lang")) & (F.col("_h").cast("double") <= F.col("_least")))
    ranked = low.select("lang", "_h").distinct().withColumn("_at", F.row_number().over(Window.partitionBy("lang").orderBy("_h")))
    picks = ranked.filter(F.col("_at") <= per_lang).select(F.col("lang").alias("_lang"), F.col("_h").alias("_pick"))  # per_lang for each language

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()  # the picks met in this task: no more than there are
        for x in frames:
            out = []
            for lang, t, h in zip(x["lang"], x["text"], x["_h"], strict=True):
                if (lang, h) in seen:
                    continue
                seen.add((lang, h))
                own = words_of(t)
                if len(own) > words:
                    at = np.random.default_rng(h + (1 << 63)).choice(len(own), words, replace=False)
                    own = [own[j] for j in sorted(at)]
                out.append((lang, h, own))
            yield pd.DataFrame(out, columns=["lang", "h", "words"])

    picked = usable.join(F.broadcast(picks), (F.col("lang") == F.col("_lang")) & (F.col("_h") == F.col("_pick")), "left_semi")
    found = picked.mapInPandas(run, "lang string, h long, words array<binary>")
    rows = found.groupBy("lang", "h").agg(F.first("words").alias("words")).collect()
    return [(r["lang"], [bytes(w) for w in r["words"]]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


class Labeller:
    """Sums of position probabilities by word, kept for words met before."""

    def __init__(self, net: Network) -> None:
        self.net, self.known = net, {}
        self.sums = np.empty((CACHE, len(net.langs)), np.float32)

    def label(self, words: list[bytes]) -> np.ndarray:
        """Row numbers in self.sums of words; there are at most CACHE different ones."""
        known = self.known
        fresh = [w for w in set(words) if w not in known]
        if len(known) + len(fresh) > CACHE:
            known.clear()
            fresh = list(set(words))
        fresh.sort(key=len)
        at, i = len(known), 0
        while i < len(fresh):
            n, j = len(fresh[i]), i
            while j < len(fresh) and len(fresh[j]) == n and j - i < 4096:
                j += 1
            x = np.frombuffer(b" ".join([*fresh[i:j], b""]), np.uint8).reshape(j - i, n + 1)
            self.sums[at : at + j - i] = self.net.positions(x).sum(axis=0)
            known.update(zip(fresh[i:j], range(at, at + j - i), strict=True))
            at, i = at + j - i, j
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def documents(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """Mean position probabilities of each text, None where it has no word; the words of
        about CACHE / 2 words' texts are labelled together, and longer texts in parts."""
        some: list[list[bytes]] = []
        size = 0
        for text in texts:
            words = words_of(text)
            if size + len(words) > CACHE // 2:
                yield from self._pooled(some)
                some, size = [], 0
            some.append(words)
            size += len(words)
        yield from self._pooled(some)

    def _pooled(self, docs: list[list[bytes]]) -> Iterator[np.ndarray | None]:
        if len(docs) == 1 and len(docs[0]) > CACHE // 2:
            words = docs[0]
            total = sum(self.sums[self.label(words[i : i + CACHE // 2])].sum(axis=0, dtype=np.float64) for i in range(0, len(words), CACHE // 2))
            yield total / sum(len(w) + 1 for w in words)
            return
        rows = self.label([w for d in docs for w in d])
        at = 0
        for d in docs:
            if d:
                yield self.sums[rows[at : at + len(d)]].sum(axis=0, dtype=np.float64) / (sum(map(len, d)) + len(d))
            else:
                yield None
            at += len(d)


def labeller(net: Network) -> Labeller:
    """The worker's labeller of an equal network, with the words that it has met; that of another
    network goes."""
    key = net.digest()
    if key not in _shared:
        _shared.clear()
        _shared[key] = Labeller(net)
    return _shared[key]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every row; und and 0.0 where the text is null or has
    no letter, or where there was nothing to learn from.  Ties go to the language
    that sorts first; repeated rows give repeated results, an empty table an empty one.  Very
    long texts are read whole, in parts.  Reads doc_id and text alone."""
    common.bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = labeller(net) if net else None
        for x in frames:
            pred, score = ["und"] * len(x), [0.0] * len(x)
            at = np.flatnonzero(x["letters"].to_numpy(bool)) if own else []
            for i, p in zip(at, own.documents([x["text"].iat[i] for i in at]) if own else (), strict=True):
                if p is not None:
                    pred[i] = net.langs[int(p.argmax())]
                    score[i] = min(1.0, float(p.max()))
            yield pd.DataFrame({"doc_id": x["doc_id"], "lang_pred": pred, "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", letters.alias("letters")).mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def least_score(net: Network, sureness: float) -> float:
    """The score that lies ``sureness`` of the way from an even guess among the languages to 1."""
    even = 1 / len(net.langs)
    return even + (1 - even) * sureness


def keep_identified(docs: DataFrame, net: Network | None, sureness: float) -> DataFrame:
    """The rows of docs whose language is identified with a score of least_score(net, sureness) or
    more, as they are.  Rows go that ``identify`` would call und; where there was nothing to
    learn from, those without a letter.  Repeated rows stay or go together; columns of any
    other name are kept; an empty table stays empty."""
    least = least_score(net, sureness) - 1e-9 if net else 0.0

    def change(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        keep = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if net:
            at = [i for i, k in enumerate(keep) if k]
            own = labeller(net)
            for i, p in zip(at, own.documents([texts[i] for i in at]), strict=True):
                keep[i] = p is not None and float(p.max()) >= least
        return batch.filter(pa.array(keep, pa.bool_()))

    return common.map_texts(docs, change)


def learn(docs: DataFrame, per_lang: int = 300, words: int = 150) -> Network | None:
    """A network from a sample of at most per_lang different texts a language; None where no text
    has a language and a letter (an empty table too).  Very long texts give ``words`` words."""
    common.bounded_batches(docs.sparkSession)
    samples = [s for s in training_sample(docs, per_lang, words) if s[1]]
    return train(samples) if samples else None


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    out = identify(docs, learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
