"""Small tables with the odd cases: nulls in every column, empty and long texts, ties, repeated
rows, groups of copies, columns whose names operators use themselves."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _fp long, size int, shard int, rank string, _size string"
WORDS = {
    "en": "the house of water and light was under a tree with some birds that sang in the morning".split(),
    "de": "das haus über dem wasser und ein licht unter den bäumen mit vögeln die am morgen sangen".split(),
    "fr": "la maison près de l'eau et une lumière sous les arbres avec des oiseaux qui chantaient".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def rows(n: int = 120, seed: int = 5) -> list[tuple]:
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i * 3, sentence(rng, lang, rng.randint(1, 60)), lang, rng.choice(["web", "books", "code", "Ünï"]), 0))
    copied = out[4][1]
    out += [(1000 + i, copied, "en", "web", 0) for i in range(40)]  # copies, a quarter of all rows
    out += [(1100 + i, copied + f" {i}", "en", "web", 0) for i in range(5)]
    out += [(2000, None, "en", "web", 0), (2001, "", None, None, None), (2002, "   \t\n", "de", "web", 0), (2003, "12 345 !?", "fr", "books", 0), (None, "a row without an id", "en", "web", 0)]
    out += [(2004, sentence(rng, "en", 30_000), "en", "books", 0), (2005, "x" * 200_000, "en", "code", 0), (2006, "ﬀ 𝔘𝔫𝔦 ÄÖ\u0000 ▁▁ a▁b   c　d", None, "web", 0)]
    out += [out[7], out[7], (3000, "alone", "en", None, 0)]
    return [(*r, 7, i, None, "x", "y") for i, r in enumerate(out)]


def documents(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
