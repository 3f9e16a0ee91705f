"""Full-text search: analyzers, postings, BM25, phrases, fuzzy terms, queries, fusion."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.shared import written

STOP = {
    "en": ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"),
    "de": ("der", "die", "das", "und", "oder", "ein", "eine", "in", "im", "ist", "mit", "von", "zu", "den", "dem", "des", "auf", "nicht"),
    "fr": ("le", "la", "les", "et", "ou", "un", "une", "de", "des", "du", "en", "est", "que", "qui", "dans", "pas"),
    "es": ("el", "la", "los", "las", "y", "o", "un", "una", "de", "del", "en", "es", "que", "con", "no", "por"),
    "it": ("il", "lo", "la", "i", "gli", "le", "e", "o", "un", "una", "di", "del", "della", "in", "che", "con", "non", "per", "è"),
    "pt": ("o", "a", "os", "as", "e", "ou", "um", "uma", "de", "do", "da", "em", "no", "na", "que", "com", "não", "por"),
    "nl": ("de", "het", "een", "en", "of", "in", "is", "van", "op", "te", "met", "niet", "dat", "die", "voor"),
    "sv": ("och", "en", "ett", "den", "det", "i", "på", "av", "är", "som", "med", "inte", "att", "för", "till"),
    "da": ("og", "en", "et", "den", "det", "i", "på", "af", "er", "som", "med", "ikke", "at", "for", "til"),
    "no": ("og", "en", "et", "den", "det", "i", "på", "av", "er", "som", "med", "ikke", "at", "for", "til"),
    "fi": ("ja", "tai", "on", "ei", "että", "se", "joka", "kun", "niin", "mutta", "ovat", "oli"),
    "pl": ("i", "w", "z", "na", "do", "nie", "to", "się", "jest", "że", "o", "a", "od", "po"),
    "ru": ("и", "в", "не", "на", "с", "что", "по", "как", "это", "из", "за", "у", "к", "о"),
    "tr": ("ve", "bir", "bu", "da", "de", "için", "ile", "ne", "mi", "çok", "ama"),
}

#: Endings that a light stem leaves off, of the Romance and Germanic languages beside English and German.
ENDINGS = {
    "fr": "issements issement atrices atrice ations ation ements ement euses euse ables able iques ique istes iste ités ité ives ive eurs eur aient ées ée és er ir es s e x é",
    "es": "amientos amiento imientos imiento aciones ación adoras adores adora ador mente idades idad ables able istas ista osos osas oso osa ando iendo aron ieron ados adas ado ada idos idas ido ida ar er ir es os as o a e s",
    "it": "amenti amento imenti imento azioni azione atrici atrice mente ità abili abile isti ista osi ose oso osa ando endo ati ate ato ata iti ite ito ita are ere ire i e o a",
    "pt": "amentos amento imentos imento ações ação adoras adores adora ador mente idades idade áveis ável istas ista osos osas oso osa ando endo indo ados adas ado ada idos idas ido ida ar er ir es os as o a e s",
    "nl": "heden heid ingen ing lijke lijk baar eren eer ende end en er st te e s t",
    "sv": "heterna heten heter het arna erna orna ande ende aste ast are ar er or en et na a e s t",
}


# Analyzers: Column of text -> Column of array<string>


def tokens(text: Column | str, stop: str | None = None) -> Column:
    """Lower-cased runs of letters and digits."""
    c = F.col(text) if isinstance(text, str) else text
    out = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.filter(out, lambda w: ~w.isin(*STOP[stop])) if stop else out


def ngrams(text: Column | str, n: int) -> Column:
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def edge_ngrams(text: Column | str, low: int, high: int) -> Column:
    def edges(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.length(w), F.lit(high)))), lambda i: F.substring(w, F.lit(1), i))

    return F.array_distinct(F.flatten(F.transform(F.filter(tokens(text), lambda w: F.length(w) >= low), edges)))


def keyword(text: Column | str) -> Column:
    return F.array(F.col(text) if isinstance(text, str) else text)


def cjk_bigrams(text: Column | str) -> Column:
    """Bigrams of runs of CJK characters, words of the rest."""
    c = F.col(text) if isinstance(text, str) else text
    runs = F.regexp_extract_all(c, F.lit(r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+)"), 1)
    two = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(two, tokens(F.regexp_replace(c, r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+", " ")))


def stem_en(word: Column) -> Column:
    """Light English stemming: plurals, -ing, -ed, -ly."""
    w = F.regexp_replace(word, "(ss|us)$", "$1\u0000")
    w = F.regexp_replace(w, "ies$", "y")
    w = F.regexp_replace(F.regexp_replace(w, "s$", ""), "\u0000", "")
    return F.regexp_replace(w, "(?<=[a-z]{3})(ing|edly|ed|ly)$", "")


def light_stem(word: Column, lang: str) -> Column:
    """A word without its longest ending of ENDINGS, three letters of it staying at least.  Lighter than the
    full algorithms of functions.stem, and all in generated code."""
    return F.regexp_replace(word, light_pattern(lang), "$1")


def light_pattern(lang: str) -> str:
    return f"^(.{{3,}}?)(?:{'|'.join(ENDINGS[lang].split())})$"


# Index


def postings(docs: DataFrame, key: str, text: str, stop: str | None = None) -> DataFrame:
    """key, term, tf, dl: a row for each document and term, with the document's length."""
    t = docs.select(key, tokens(text, stop).alias("_t"))
    return t.select(key, F.explode("_t").alias("term"), F.size("_t").alias("dl")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def _count(word: str) -> Column:
    """How often the lower-cased text _t has a word, without making an array of its words."""
    if not re.fullmatch(r"[^\W_]+", word):
        return F.lit(0)
    return F.coalesce(F.regexp_count("_t", F.lit(rf"{word}(?<![\p{{L}}\p{{N}}]{word})(?![\p{{L}}\p{{N}}])")), F.lit(0))


def _is(word: str):
    return lambda w: w == word


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k: int | None = None, k1: float = 1.2, b: float = 0.75, synonyms: dict[str, list[str]] | None = None, stop: str | None = None) -> DataFrame:
    """key, score of the documents that hold a query term, best first.

    Terms are counted where the text lies: no posting of another term is made, and the counts are
    a table in the shared folder from which statistics and scores come."""
    terms = list(dict.fromkeys(query + [s for q in query for s in (synonyms or {}).get(q, [])]))
    if stop is None:
        t = docs.select(key, F.lower(text).alias("_t"))
        tf = t.select(key, F.coalesce(F.regexp_count("_t", F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).alias("dl"), *(_count(q).alias(f"tf{i}") for i, q in enumerate(terms)))
    else:
        t = docs.select(key, tokens(text, stop).alias("_t")).withColumn("dl", F.size("_t"))
        tf = t.select(key, "dl", *(F.size(F.filter("_t", _is(q))).alias(f"tf{i}") for i, q in enumerate(terms)))
    tf = written(tf, "term_counts")  # texts are read once; what is kept is a few numbers a document
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))))
    joined = tf.join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    any_hit = F.greatest(*(F.col(f"tf{i}") for i in range(len(terms)))) > 0 if len(terms) > 1 else F.col("tf0") > 0
    out = joined.filter(any_hit).select(key, score.alias("score"))
    return out.orderBy(F.desc("score"), key).limit(k) if k else out


def weighted_bm25(docs: DataFrame, key: str, fields: dict[str, float], query: list[str], k: int) -> DataFrame:
    """Sum of weighted BM25 scores of several text fields."""
    parts = [bm25(docs, key, f, query).select(key, (F.col("score") * w).alias("score")) for f, w in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("score").alias("score")).orderBy(F.desc("score"), key).limit(k)


def and_then_or(docs: DataFrame, key: str, text: str, query: list[str], k: int) -> DataFrame:
    """Documents with every term; if there is none, those with any, scores times the share of
    terms that they hold."""
    scored = bm25(docs, key, text, query)
    t = docs.select(F.col(key).alias("_k"), tokens(text).alias("_t"))
    held = sum((F.array_contains("_t", q).cast("int") for q in query), F.lit(0)) / len(query)
    both = scored.join(t.select("_k", held.alias("held")), F.col(key) == F.col("_k")).drop("_k")
    best = both.agg(F.max("held").alias("most"))
    out = both.join(F.broadcast(best)).filter((F.col("most") < 1) | (F.col("held") == 1))
    return out.select(key, (F.col("score") * F.col("held")).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _spaced(text: Column | str) -> Column:
    """The words, each with a space before and after it; words themselves hold none."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def phrase_count(text: Column | str, phrase: list[str]) -> Column:
    """Places where the words of the phrase follow each other, found in one pass over the words."""
    if not phrase:
        return F.coalesce(F.size(tokens(text)) + 1, F.lit(0))
    if not all(re.fullmatch(r"[^\W_]+", w) for w in phrase):
        return F.lit(0)  # no word of a text looks like that
    return F.coalesce(F.regexp_count(_spaced(text), F.lit(f"(?= {' '.join(phrase)} )")), F.lit(0))


def fuzzy_match(text: Column | str, term: str) -> Column:
    """Whether a word is within Levenshtein 1 (terms of 4 to 6 letters) or 2 (longer)."""
    most = 0 if len(term) < 4 else 1 if len(term) <= 6 else 2
    near = lambda w: (F.abs(F.length(w) - len(term)) <= most) & (F.levenshtein(w, F.lit(term), most) >= 0)
    return F.exists(F.array_distinct(tokens(text)), near)


def highlight(text: Column | str, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, r"(?i)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, terms)) + r")(?![\p{L}\p{N}])", f"{before}$1{after}")


def offsets(text: Column | str, terms: list[str]) -> Column:
    """Where the terms stand: an array of (start, end), code points from 0, end exclusive."""
    c = F.col(text) if isinstance(text, str) else text
    rx = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, terms)) + r")(?![\p{L}\p{N}])"
    sizes = lambda parts: F.transform(parts, lambda x: F.length(x))
    gaps, hits = sizes(F.split(c, rx, -1)), sizes(F.regexp_extract_all(c, F.lit(rx), 0))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    kind = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, p: Column) -> Column:
        at = a["at"] + p["gap"]
        end = at + p["hit"]
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(at.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


# Queries: a & b | !c, "phrase", prefix:*


@dataclass
class Node:
    kind: str
    parts: list = field(default_factory=list)
    word: str = ""


def parse(text: str) -> Node:
    """tsquery: & and |, ! for not, parentheses, quotes for phrases, :* for prefixes; words
    side by side mean &, a leading - means !."""
    toks = re.findall(r'-?"[^"]*"|[&|!()]|-?[\w]+(?::\*)?', text)
    at = 0

    def peek() -> str | None:
        return toks[at] if at < len(toks) else None

    def either() -> Node:
        nonlocal at
        parts = [both()]
        while peek() == "|" or (peek() or "").upper() == "OR":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    def both() -> Node:
        nonlocal at
        parts = [unary()]
        while peek() not in (None, "|", ")") and peek().upper() != "OR":
            if peek() == "&" or peek().upper() == "AND":
                at += 1
            parts.append(unary())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def unary() -> Node:
        nonlocal at
        tok = peek()
        if tok is None:
            raise ValueError(f"query ends early: {text!r}")
        at += 1
        if tok == "!":
            return Node("not", [unary()])
        if tok == "(":
            inside = either()
            if peek() != ")":
                raise ValueError(f"unclosed parenthesis: {text!r}")
            at += 1
            return inside
        if tok[:2] == '-"':
            return Node("not", [Node("phrase", [w.lower() for w in re.findall(r"\w+", tok)])])
        if tok[0] == '"':
            return Node("phrase", [w.lower() for w in re.findall(r"\w+", tok)])
        if tok[0] == "-":
            return Node("not", [Node("word", word=tok[1:].lower())])
        return Node("prefix", word=tok[:-2].lower()) if tok.endswith(":*") else Node("word", word=tok.lower())

    out = either()
    if at != len(toks):
        raise ValueError(f"unexpected {toks[at]!r}: {text!r}")
    return out


def plain_query(text: str) -> Node:
    """Every word, whatever signs stand between."""
    return Node("and", [Node("word", word=w) for w in re.findall(r"\w+", text.lower())])


def phrase_query(text: str) -> Node:
    return Node("phrase", re.findall(r"\w+", text.lower()))


def web_query(text: str) -> Node:
    """As search boxes have it: words, "phrases", OR, and a leading - for not."""
    return parse(re.sub(r"[&|!():*]", " ", text))


def matches(text: Column | str, q: str | Node) -> Column:
    n = parse(q) if isinstance(q, str) else q
    t = tokens(text)
    if n.kind == "word":
        return F.array_contains(t, n.word)
    if n.kind == "prefix":
        return F.exists(t, lambda w: w.startswith(n.word))
    if n.kind == "phrase":
        return phrase_count(text, n.parts) > 0
    if n.kind == "not":
        return ~matches(text, n.parts[0])
    out = matches(text, n.parts[0])
    for p in n.parts[1:]:
        out = out & matches(text, p) if n.kind == "and" else out | matches(text, p)
    return out


# Fusion


#: Rows that one task may sort.
FEW = 100_000


def places(df: DataFrame, *order: Column) -> DataFrame:
    """df with ``place``, the rows' numbers from 1 in a total order: ranges of it are sorted each in a
    task, and offset by the sizes of those before, a row for each.  A list whose plan holds it to
    FEW rows, as a limit does, is sorted in one task."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    if most.isDefined() and int(most.get()) <= FEW:
        return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return dealt.join(F.broadcast(sizes), "_part").withColumn("place", place).drop("_part", "_before")


def rrf(lists: list[DataFrame], key: str, score: str, k: int, const: float = 60.0, weights: list[float] | None = None, consts: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (const + rank + 1) over lists of (key, score),
    greatest score first (rank 0), ties by key.  Lists may be of any length."""
    parts = []
    for i, df in enumerate(lists):
        c, w = (consts or [const] * len(lists))[i], (weights or [1.0] * len(lists))[i]
        parts.append(places(df.select(key, score), F.desc(score), F.col(key)).select(key, (F.lit(w) / (F.lit(c) + F.col("place"))).alias("rrf")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("rrf").alias("rrf")).orderBy(F.desc("rrf"), key).limit(k)
