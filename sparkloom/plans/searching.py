"""Vector and full-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import relational as R
from sparkloom.operators import search as X
from sparkloom.operators import vector as V
from sparkloom.plans.registry import query

Q = [((i * 37) % 64 - 32) / 64.0 for i in range(64)]
Q2 = [((i * 29) % 64 - 32) / 64.0 for i in range(64)]
QL2 = "[" + ", ".join(f"{x!r}::DOUBLE" for x in Q2) + "]"
QL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in Q) + "]"
E = "CAST(embedding AS DOUBLE[])"
_METRICS = {
    "l2": f"list_distance({E}, {QL})",
    "cosine": f"1 - list_cosine_similarity({E}, {QL})",
    "ip": f"-list_inner_product({E}, {QL})",
    "manhattan": f"list_sum(list_transform(list_zip({E}, {QL}), lambda p: abs(p[1] - p[2])))",
    "chebyshev": f"list_max(list_transform(list_zip({E}, {QL}), lambda p: abs(p[1] - p[2])))",
    "hamming": f"list_sum(list_transform(list_zip({E}, {QL}), lambda p: CASE WHEN p[1] <> p[2] THEN 1.0::DOUBLE ELSE 0.0 END))",
}
for _m, _sql in _METRICS.items():
    query(f"vector_topk_{_m}", f"SELECT vec_id, round({_sql}, 6) AS d FROM embeddings ORDER BY {_sql}, vec_id LIMIT 10")(lambda t, m=_m: V.topk(t.embeddings, "embedding", Q, 10, "vec_id", m).select("vec_id", F.round("distance", 6).alias("d")))


@query("vector_distance_pearson_jaccard", f"SELECT vec_id, round(1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 6) AS p FROM (SELECT vec_id, list_transform({E}, lambda x: x - list_avg({E})) AS a, list_transform({QL}, lambda x: x - list_avg({QL})) AS b FROM embeddings)")
def _(t):
    return t.embeddings.select("vec_id", F.round(V.distance("embedding", V.literal(Q), "pearson"), 6).alias("p"))


@query("vector_filtered_topk", f"SELECT vec_id, round({_METRICS['l2']}, 6) AS d FROM embeddings WHERE label = 3 ORDER BY {_METRICS['l2']}, vec_id LIMIT 5")
def _(t):
    return V.topk(t.embeddings, "embedding", Q, 5, "vec_id", "l2", F.col("label") == 3).select("vec_id", F.round("distance", 6).alias("d"))


@query("vector_sql_operators", f"SELECT vec_id, round(power({_METRICS['l2']}, 2), 5) AS d, round({_METRICS['cosine']}, 6) AS c, round({_METRICS['ip']}, 5) AS i FROM embeddings ORDER BY {_METRICS['l2']}, vec_id LIMIT 10")
def _(t):
    from sparkloom.plans import sql

    q = "[" + ", ".join(map(repr, Q)) + "]"
    return sql.run(t, f"SELECT vec_id, round(embedding <-> {q}, 5) AS d, round(vector_cosine_distance(embedding, {q}), 6) AS c, round(embedding <#> {q}, 5) AS i FROM embeddings ORDER BY embedding <-> {q}, vec_id LIMIT 10")


@query("vector_matryoshka", f"WITH c AS (SELECT * FROM embeddings ORDER BY list_distance({E}[1:16], {QL}[1:16]), vec_id LIMIT 50) SELECT vec_id, round({_METRICS['l2']}, 6) AS d FROM c ORDER BY {_METRICS['l2']}, vec_id LIMIT 10")
def _(t):
    return V.matryoshka_topk(t.embeddings, "embedding", Q, 16, 50, 10, "vec_id").select("vec_id", F.round("distance", 6).alias("d"))


@query("vector_quantized_rerank", f"WITH x AS (SELECT min(c)::DOUBLE AS lo, (max(c)::DOUBLE - min(c)::DOUBLE) / 255 AS step FROM (SELECT unnest(embedding) AS c FROM embeddings)), c AS (SELECT vec_id, embedding FROM embeddings, x ORDER BY list_distance(list_transform({E}, lambda v: round((v - lo) / step) * step + lo), {QL}), vec_id LIMIT 100) SELECT vec_id, round({_METRICS['l2']}, 6) AS d FROM c ORDER BY {_METRICS['l2']}, vec_id LIMIT 10")
def _(t):
    return V.quantized_topk(t.embeddings, "embedding", Q, 10, "vec_id").select("vec_id", F.round("distance", 6).alias("d"))


@query("multi_vector_maxsim", f"""WITH q AS (SELECT * FROM (VALUES (0, {QL}), (1, {QL2})) v(q, qv)), s AS (SELECT e.label AS doc, q.q, max(list_inner_product(CAST(e.embedding AS DOUBLE[]), q.qv)) AS s FROM embeddings e, q GROUP BY 1, 2) SELECT doc, round(sum(s), 6) AS score FROM s GROUP BY doc""")
def _(t):
    q = t.spark.createDataFrame([(0, Q), (1, Q2)], "q int, qv array<double>")
    d = t.embeddings.select(F.col("label").alias("doc"), "embedding")
    return V.maxsim(q, d, "doc", "embedding", 100).select("doc", F.round("score", 6).alias("score"))


@query("sparse_search", "SELECT l_orderkey AS doc, round(sum(l_quantity * CASE l_suppkey % 10 WHEN 1 THEN 0.5 ELSE 2.0 END), 4) AS score FROM lineitem WHERE l_suppkey % 10 IN (1, 4) GROUP BY l_orderkey ORDER BY sum(l_quantity * CASE l_suppkey % 10 WHEN 1 THEN 0.5 ELSE 2.0 END) DESC, l_orderkey LIMIT 20")
def _(t):
    w = t.lineitem.groupBy("l_orderkey", (F.col("l_suppkey") % 10).cast("int").alias("d")).agg(F.sum("l_quantity").alias("w"))
    docs = w.groupBy(F.col("l_orderkey").alias("doc")).agg(F.map_from_entries(F.collect_list(F.struct("d", "w"))).alias("m"))
    return V.sparse_score(docs, "doc", "m", {1: 0.5, 4: 2.0}, 20).select("doc", F.round("score", 4).alias("score"))


@query("array_prefiltered_vector_search", f"SELECT vec_id, round({_METRICS['l2']}, 6) AS d FROM embeddings WHERE vec_id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3 AND l_orderkey BETWEEN 10 AND 200) ORDER BY {_METRICS['l2']}, vec_id LIMIT 8")
def _(t):
    ids = t.lineitem.filter("l_linenumber BETWEEN 2 AND 3 AND l_orderkey BETWEEN 10 AND 200").select(F.col("l_orderkey").alias("vec_id"))
    return V.topk(t.embeddings.join(ids, "vec_id", "left_semi"), "embedding", Q, 8, "vec_id").select("vec_id", F.round("distance", 6).alias("d"))


# Full text

TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: w <> '')"
_TF = "(SELECT doc_id, len(tk)::DOUBLE AS dl, len(list_filter(tk, lambda w: w = 'the'))::DOUBLE AS a, len(list_filter(tk, lambda w: w = 'und'))::DOUBLE AS b FROM (SELECT doc_id, " + TOK + " AS tk FROM documents))"
_BM25 = f"""WITH f AS {_TF}, s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE a > 0)::DOUBLE AS da, count(*) FILTER (WHERE b > 0)::DOUBLE AS db FROM f),
r AS (SELECT doc_id, CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END AS score FROM f, s WHERE a > 0 OR b > 0)"""


@query("bm25_scores", f"{_BM25} SELECT doc_id, round(score, 6) AS score FROM r")
def _(t):
    return X.bm25(t.documents, "doc_id", "text", ["the", "und"]).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_topk", f"{_BM25} SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 10")
def _(t):
    return X.bm25(t.documents, "doc_id", "text", ["the", "und"], 10).select("doc_id", F.round("score", 6).alias("score"))


@query("fts_postings_df", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY term HAVING count(DISTINCT doc_id) > 20")
def _(t):
    return X.postings(t.documents, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df")).filter("df > 20")


@query("fts_match_boolean", f"SELECT doc_id FROM (SELECT doc_id, {TOK} AS tk FROM documents) WHERE list_contains(tk, 'the') AND NOT list_contains(tk, 'by') OR list_contains(tk, 'vieux')")
def _(t):
    return t.documents.filter(X.matches("text", "the & !by | vieux")).select("doc_id")


@query("fts_prefix", f"SELECT doc_id FROM (SELECT doc_id, {TOK} AS tk FROM documents) WHERE len(list_filter(tk, lambda w: starts_with(w, 'lich'))) > 0")
def _(t):
    return t.documents.filter(X.matches("text", "lich:*")).select("doc_id")


@query("fts_phrase", f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({TOK}, ' ') || ' ' AS s FROM documents) WHERE contains(s, ' of the ')")
def _(t):
    return t.documents.filter(X.matches("text", '"of the"')).select("doc_id")


@query("fts_fuzzy", f"SELECT doc_id FROM (SELECT doc_id, list_distinct({TOK}) AS tk FROM documents) WHERE len(list_filter(tk, lambda w: levenshtein(regexp_replace(w, '[^\x00-\x7F]', '#', 'g'), 'vieux') <= 1)) > 0")
def _(t):
    return t.documents.filter(X.fuzzy_match("text", "vieux")).select("doc_id")


@query("fts_highlight", "SELECT doc_id, regexp_replace(text, '\\b(the|of)\\b', '<b>\\1</b>', 'gi') AS h FROM documents WHERE lang = 'en'")
def _(t):
    return t.documents.filter("lang = 'en'").select("doc_id", X.highlight("text", ["the", "of"]).alias("h"))


@query("fts_ngrams", "SELECT count(*) AS n, count(DISTINCT g) AS d FROM (SELECT substr(n_name, i, 3) AS g FROM (SELECT lower(n_name) AS n_name, unnest(range(1, length(n_name) - 1)) AS i FROM nation))")
def _(t):
    return t.nation.select(F.explode(X.ngrams("n_name", 3)).alias("g")).agg(F.count("*").alias("n"), F.count_distinct("g").alias("d"))


@query("fts_edge_ngrams", "SELECT n_nationkey, array_to_string(list_sort(list_distinct(flatten([[w[1:i] FOR i IN range(2, least(len(w), 4) + 1)] FOR w IN regexp_split_to_array(lower(n_name), '[^\\pL\\pN]+') IF len(w) >= 2]))), ' ') AS g FROM nation")
def _(t):
    return t.nation.select("n_nationkey", F.array_join(F.array_sort(X.edge_ngrams("n_name", 2, 4)), " ").alias("g"))


_AND_OR = _BM25.replace("w = 'und'", "w = 'vieux'") + ", h AS (SELECT doc_id, score, (CASE WHEN a > 0 THEN 0.5 ELSE 0 END + CASE WHEN b > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS held FROM r JOIN f USING (doc_id))"


@query("fts_and_then_or", f"{_AND_OR} SELECT doc_id, round(score * held, 6) AS score FROM h WHERE (SELECT max(held) FROM h) < 1 OR held = 1 ORDER BY score * held DESC, doc_id LIMIT 10")
def _(t):
    return X.and_then_or(t.documents, "doc_id", "text", ["the", "vieux"], 10).select("doc_id", F.round("score", 6).alias("score"))


def _field(name: str, column: str, words: tuple[str, str]) -> str:
    """BM25 of a field of pages as CTEs: name(page_id, score)."""
    tf = f"SELECT page_id, len(tk)::DOUBLE AS dl, len(list_filter(tk, lambda w: w = '{words[0]}'))::DOUBLE AS a, len(list_filter(tk, lambda w: w = '{words[1]}'))::DOUBLE AS b FROM (SELECT page_id, {TOK.replace('text', column)} AS tk FROM pages)"
    idf = lambda c: f"CASE WHEN {c} > 0 THEN ln(1 + (n - d{c} + 0.5) / (d{c} + 0.5)) * {c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END"
    stats = f"SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE a > 0)::DOUBLE AS da, count(*) FILTER (WHERE b > 0)::DOUBLE AS db FROM {name}_f"
    return f"{name}_f AS ({tf}), {name}_s AS ({stats}), {name} AS (SELECT page_id, {idf('a')} + {idf('b')} AS score FROM {name}_f, {name}_s WHERE a > 0 OR b > 0)"


@query("fts_weighted_fields", f"WITH {_field('h', 'html', ('the', 'example'))}, {_field('u', 'url', ('the', 'example'))} SELECT page_id, round(sum(s), 6) AS score FROM (SELECT page_id, score AS s FROM h UNION ALL SELECT page_id, 2 * score FROM u) GROUP BY page_id ORDER BY sum(s) DESC, page_id LIMIT 10")
def _(t):
    return X.weighted_bm25(t.pages, "page_id", {"html": 1.0, "url": 2.0}, ["the", "example"], 10).select("page_id", F.round("score", 6).alias("score"))


_VEC = f"SELECT vec_id AS id, -({_METRICS['l2']}) AS s FROM embeddings ORDER BY {_METRICS['l2']}, vec_id LIMIT 30"
_FTS = f"SELECT doc_id AS id, score AS s FROM r ORDER BY score DESC, doc_id LIMIT 30"


@query("hybrid_rrf", f"{_BM25}, v AS ({_VEC}), x AS ({_FTS}), u AS (SELECT id, 1 / (60.0::DOUBLE + row_number() OVER (ORDER BY s DESC, id)) AS rrf FROM v UNION ALL SELECT id, 1 / (60.0::DOUBLE + row_number() OVER (ORDER BY s DESC, id)) FROM x) SELECT id, round(sum(rrf), 9) AS rrf FROM u GROUP BY id ORDER BY sum(rrf) DESC, id LIMIT 15")
def _(t):
    v = V.topk(t.embeddings, "embedding", Q, 30, "vec_id").select(F.col("vec_id").alias("id"), (-F.col("distance")).alias("s"))
    x = X.bm25(t.documents, "doc_id", "text", ["the", "und"], 30).select(F.col("doc_id").alias("id"), F.col("score").alias("s"))
    return X.rrf([v, x], "id", "s", 15).select("id", F.round("rrf", 9).alias("rrf"))


@query("search_with_facets", f"{_BM25} SELECT d.lang AS value, 'lang' AS field, count(*) AS n FROM r JOIN documents d USING (doc_id) GROUP BY d.lang")
def _(t):
    hits = X.bm25(t.documents, "doc_id", "text", ["the", "und"])
    return R.facet_counts(hits.join(t.documents.select("doc_id", "lang"), "doc_id"), ["lang"], 50)
