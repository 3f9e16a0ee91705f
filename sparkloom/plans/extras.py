"""User functions, analyzers, fusion forms, access paths and further scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sparkloom.functions import scalar as S
from sparkloom.functions import stem, user
from sparkloom.operators import access
from sparkloom.operators import search as X
from sparkloom.operators import vector as V
from sparkloom.plans import sql
from sparkloom.plans.graphs import E as GRAPH_EDGES
from sparkloom.plans.registry import query
from sparkloom.plans.searching import _BM25, _METRICS, QL, TOK, E, Q
from sparkloom.shared import written

# User functions


@query("udf_sql_expression", "SELECT p_partkey, round(p_retailprice * (1 - p_size / 100.0::DOUBLE), 6) AS x FROM part")
def _(t):
    user.sql_function(t.spark, "reduced", {"price": "double", "size": "int"}, "double", "price * (1 - size / 100.0D)")
    t.views("part")
    return t.spark.sql("SELECT p_partkey, round(reduced(p_retailprice, p_size), 6) AS x FROM part")


@query("udf_arrow_scalar", "SELECT c_custkey, reverse(c_name) || '!' AS x FROM customer")
def _(t):
    f = user.scalar(t.spark, "turned", lambda s: s.str[::-1] + "!", "string")
    return t.customer.select("c_custkey", f("c_name").alias("x"))


def _spread(v: pd.Series) -> float:
    return float(v.max() - v.min())


@query("udf_aggregate", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 2) AS x FROM customer GROUP BY 1")
def _(t):
    f = user.aggregate(t.spark, "spread", _spread, "double")
    return t.customer.groupBy("c_nationkey").agg(F.round(f("c_acctbal"), 2).alias("x"))


@query("udf_mergeable_aggregate", "SELECT l_returnflag, l_linestatus, round(exp(avg(ln(l_quantity))), 8) AS value FROM lineitem GROUP BY 1, 2")
def _(t):
    """A geometric mean from partial states of count and sum of logarithms."""
    import math

    out = user.mergeable(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity"], "n long, s double", lambda: (0, 0.0), lambda a, r: (a[0] + 1, a[1] + math.log(r[0])), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a: math.exp(a[1] / a[0]), "double")
    return out.select("l_returnflag", "l_linestatus", F.round("value", 8).alias("value"))


@query("udf_table_function", "SELECT n_nationkey, i, i * i AS square FROM nation, range(n_regionkey + 1) r(i)")
def _(t):
    user.table_function(t.spark, "squares", lambda n: ((i, i * i) for i in range(n)), "i long, square long")
    t.views("nation")
    return t.spark.sql("SELECT n_nationkey, i, square FROM nation, LATERAL squares(n_regionkey + 1)")


@query("procedure_call", "SELECT CAST(count(*) * (count(*) + 1) / 2 AS INT) AS total FROM nation")
def _(t):
    p = user.Procedure("sum_to", ["n"], "BEGIN DECLARE i INT DEFAULT 0; DECLARE total INT DEFAULT 0; WHILE i < :n DO SET i = i + 1; SET total = total + i; END WHILE; SELECT total AS total; END")
    return p.call(t.spark, t.nation.count())


# Text analysis


@query("fts_stemmed_terms", None)
def _(t):
    words = t.documents.filter("lang = 'en'").select(F.explode(stem.stems(F.array_distinct(X.tokens("text", "en")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


@query("fts_stop_words", f"SELECT doc_id, CAST(len(list_filter({TOK}, lambda w: NOT list_contains(['der','die','das','und','oder','ein','eine','in','im','ist','mit','von','zu','den','dem','des','auf','nicht'], w))) AS INT) AS n FROM documents WHERE lang = 'de'")
def _(t):
    return t.documents.filter("lang = 'de'").select("doc_id", F.size(X.tokens("text", "de")).alias("n"))


@query("fts_synonyms", _BM25.replace("w = 'und'", "w = 'that'") + " SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 10")
def _(t):
    return X.bm25(t.documents, "doc_id", "text", ["the"], 10, synonyms={"the": ["that"]}).select("doc_id", F.round("score", 6).alias("score"))


@query("fts_cjk_bigrams", "SELECT n_nationkey, array_to_string([substr(repeat('東京都', 1 + n_nationkey % 3), i, 2) FOR i IN range(1, 3 * (1 + n_nationkey % 3))] || ['nation', lower(split_part(n_name, '_', 2))], ' ') AS g FROM nation")
def _(t):
    text = F.concat(F.repeat(F.lit("東京都"), (F.col("n_nationkey") % 3 + 1).cast("int")), F.lit(" nation "), F.split_part("n_name", F.lit("_"), F.lit(2)))
    return t.nation.select("n_nationkey", F.array_join(X.cjk_bigrams(text), " ").alias("g"))


@query("fts_query_forms", f"SELECT doc_id, list_contains(tk, 'the') AND list_contains(tk, 'of') AS plain, contains(' ' || array_to_string(tk, ' ') || ' ', ' of the ') AS phrase, list_contains(tk, 'the') AND NOT list_contains(tk, 'by') AS web FROM (SELECT doc_id, {TOK} AS tk FROM documents)")
def _(t):
    forms = {"plain": X.matches("text", X.plain_query("the of")), "phrase": X.matches("text", X.phrase_query("of the")), "web": X.matches("text", X.web_query("the -by"))}
    return t.documents.select("doc_id", *(c.alias(n) for n, c in forms.items()))


# Fusion

_VEC = f"SELECT vec_id AS id, row_number() OVER (ORDER BY {_METRICS['l2']}, vec_id) AS r FROM embeddings ORDER BY r LIMIT 30"
_FTS = "SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM r ORDER BY r LIMIT 30"


def _legs(t):
    v = V.topk(t.embeddings, "embedding", Q, 30, "vec_id").select(F.col("vec_id").alias("id"), (-F.col("distance")).alias("s"))
    x = X.bm25(t.documents, "doc_id", "text", ["the", "und"], 30).select(F.col("doc_id").alias("id"), F.col("score").alias("s"))
    return v, x


@query("hybrid_weighted_rrf", f"{_BM25}, v AS ({_VEC}), x AS ({_FTS}) SELECT id, round(sum(s), 9) AS rrf FROM (SELECT id, 0.7::DOUBLE / (10 + r) AS s FROM v UNION ALL SELECT id, 0.3::DOUBLE / (60 + r) FROM x) GROUP BY id ORDER BY sum(s) DESC, id LIMIT 12")
def _(t):
    v, x = _legs(t)
    return X.rrf([v, x], "id", "s", 12, weights=[0.7, 0.3], consts=[10.0, 60.0]).select("id", F.round("rrf", 9).alias("rrf"))


_NEAR = f"{GRAPH_EDGES}, v AS ({_VEC}), g AS (SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM v UNION ALL SELECT CASE WHEN src = v.id THEN dst ELSE src END, 1 FROM e JOIN v ON v.id = src OR v.id = dst) GROUP BY id ORDER BY min(depth), id LIMIT 30)"


@query("hybrid_three_sources", f"{_BM25}, {_NEAR}, x AS ({_FTS}), u AS (SELECT id, 1 / (60.0::DOUBLE + r) AS s FROM v UNION ALL SELECT id, 1 / (60.0::DOUBLE + r) FROM x UNION ALL SELECT id, 1 / (60.0::DOUBLE + row_number() OVER (ORDER BY depth, id)) FROM g) SELECT id, round(sum(s), 9) AS rrf FROM u GROUP BY id ORDER BY sum(s) DESC, id LIMIT 15")
def _(t):
    from sparkloom.operators import graph
    from sparkloom.plans.graphs import parts

    v, x = _legs(t)
    near = graph.bfs(parts(t), v.select(F.col("id").alias("node")), 1, "both").orderBy("depth", "node").limit(30)
    g = near.select(F.col("node").alias("id"), (-F.col("depth")).cast("double").alias("s"))
    return X.rrf([v, x, g], "id", "s", 15).select("id", F.round("rrf", 9).alias("rrf"))


@query("vector_binary_rerank", f"WITH c AS (SELECT vec_id, embedding FROM embeddings ORDER BY list_sum(list_transform(list_zip(embedding, {QL}), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)), vec_id LIMIT 60) SELECT vec_id, round({_METRICS['l2']}, 6) AS d FROM c ORDER BY {_METRICS['l2']}, vec_id LIMIT 10")
def _(t):
    return V.binary_topk(t.embeddings, "embedding", Q, 60, 10, "vec_id").select("vec_id", F.round("distance", 6).alias("d"))


# Access


@query("metadata_filter", "SELECT p_partkey FROM part WHERE (p_size BETWEEN 10 AND 20 OR p_brand IN ('Brand#11', 'Brand#12')) AND NOT p_type LIKE '%A%' AND p_name IS NOT NULL")
def _(t):
    tree = {"or": [{"p_size": {"between": [10, 20]}}, {"p_brand": {"in": ["Brand#11", "Brand#12"]}}], "not": {"p_type": {"like": "%A%"}}, "p_name": {"is_null": False}}
    return t.part.filter(access.metadata_filter(tree)).select("p_partkey")


@query("array_predicates", "SELECT doc_id FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE list_has_all(w, ['the', 'of']) OR list_has_any(w, ['und', 'les'])")
def _(t):
    d = t.documents.select("doc_id", F.split("text", " ", -1).alias("w"))
    return d.filter(access.metadata_filter({"or": [{"w": {"array_contains_all": ["the", "of"]}}, {"w": {"array_overlap": ["und", "les"]}}]})).select("doc_id")


@query("row_level_security", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_totalprice < 100000")
def _(t):
    p = access.Policies()
    p.add("orders", "*", F.col("o_orderpriority") != "1-URGENT")
    p.add("orders", "clerk", F.col("o_totalprice") < 100000)
    return p.apply("orders", t.orders, "clerk").select("o_orderkey")


@query("sql_parameters", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 150000 AND o_orderpriority = '2-HIGH' GROUP BY 1")
def _(t):
    return sql.run(t, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > :least AND o_orderpriority = :priority GROUP BY 1", least=150000, priority="2-HIGH")


for _name, _hint in (("join_hints", "SHUFFLE_HASH(customer), MERGE(nation)"), ("join_hint_broadcast", "BROADCAST(nation)"), ("join_hint_merge", "MERGE(customer, nation)"), ("join_hint_shuffle", "SHUFFLE_HASH(nation)")):
    query(_name, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")(lambda t, h=_hint: sql.run(t, f"SELECT /*+ {h} */ n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"))


@query("materialized_view_refresh", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    from sparkloom.database import Database

    db = Database(t.spark, t.folder)
    db.put("orders", t.orders.filter("o_orderstatus = 'F'"))
    db.execute("CREATE MATERIALIZED VIEW per_customer AS SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
    db.put("orders", t.orders)
    return db.execute("REFRESH MATERIALIZED VIEW per_customer")


@query("continuous_aggregate_sketches", "SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days FROM events GROUP BY 1")
def _(t):
    """Distinct users from daily bitmaps, which merge without an estimate: one of 32,768 bits for each range of users."""
    user = F.col("user_id")
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day"), F.bitmap_bucket_number(user).alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(user)).alias("users"))
    merged = daily.groupBy("event_type", "range").agg(F.bitmap_or_agg("users").alias("users"))
    users = merged.groupBy("event_type").agg(F.sum(F.bitmap_count("users")).alias("users"))
    days = daily.groupBy("event_type").agg(F.count_distinct("day").alias("days"))
    return users.join(days, users["event_type"].eqNullSafe(days["event_type"])).select(users["event_type"], "users", "days")


# Scalars


@query("text_chunks_by_sentence", """WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS a, string_split(regexp_replace(text, '\\n[ \\t\\n\\x0B\\f\\r]*\\n', chr(1), 'g'), chr(1)) AS b FROM documents)
SELECT doc_id, CAST(len(list_filter(a, lambda x: trim(x) <> '')) AS INT) AS sentences, CAST(len(list_filter(b, lambda x: trim(x) <> '')) AS INT) AS paragraphs FROM s""")
def _(t):
    return t.documents.select("doc_id", F.size(S.chunk_sentences("text")).alias("sentences"), F.size(S.chunk_paragraphs("text")).alias("paragraphs"))


@query("json_operators", "SELECT event_id, json_contains(props, '{\"k\": 5}') AS has, json_array_length('[1,2,3]')::INT AS n, 'object' AS kind FROM events")
def _(t):
    return t.events.select("event_id", S.json_contains("props", F.lit('{"k": 5}')).alias("has"), F.json_array_length(F.lit("[1,2,3]")).alias("n"), S.json_type("props").alias("kind"))


@query("json_merge_any_all", "SELECT event_id, true AS any, false AS all_, '{\"k\":\"1\",\"z\":\"2\"}' AS merged FROM events")
def _(t):
    return t.events.select("event_id", S.json_has_any("props", ["k", "x"]).alias("any"), S.json_has_all("props", ["k", "x"]).alias("all_"), S.json_merge("props", F.lit('{"k":"1","z":"2"}')).alias("merged"))


#: Identifiers that a task compares.
IDS = 200_000


@query("generated_ids", f"SELECT count(*) AS n, {', '.join(f'count(*) AS {c}, count(*) AS {c}_fine' for c in ('u4', 'u7', 'ul', 'nano', 'cuid'))} FROM customer")
def _(t):
    """Identifiers are of their kinds, and none comes twice."""
    n = t.customer.count()
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), 5 * n // IDS)
    rows = t.customer.select("c_custkey").repartition(parts)  # as one file's rows may lie in one task
    ids = rows.select(S.uuid_v4().alias("u4"), S.uuid_v7().alias("u7"), S.ulid().alias("ul"), S.nanoid().alias("nano"), S.cuid2().alias("cuid"))
    fine = {"u4": S.uuid_version("u4") == 4, "u7": S.uuid_version("u7") == 7, "ul": S.is_ulid("ul"), "nano": S.is_nanoid("nano"), "cuid": S.is_cuid2("cuid")}
    # a row for each identifier, dealt out by it before any is compared: made once, and no task holds more than its share
    kinds = written(ids.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("id"), f.alias("fine")) for c, f in fine.items()))).alias("x")).select("x.*"), "ids")
    each = kinds.repartition(parts, "kind", "id").groupBy("kind", "id").agg(F.count_if("fine").alias("fine"))
    sums = each.groupBy("kind").agg(F.count("*").alias("d"), F.sum("fine").alias("fine"))
    own = lambda c, x: F.coalesce(F.sum(F.when(F.col("kind") == c, F.col(x))), F.lit(0))
    return sums.agg(F.lit(n).cast("long").alias("n"), *(x for c in fine for x in (own(c, "d").alias(c), own(c, "fine").alias(f"{c}_fine"))))


@query("decimal_and_duration_text", "SELECT p_partkey, round(p_retailprice, 2) AS d, CASE WHEN p_size % 24 = 0 THEN (p_size // 24) || 'd' WHEN p_size < 24 THEN p_size || 'h' ELSE (p_size // 24) || 'd ' || (p_size % 24) || 'h' END AS t FROM part")
def _(t):
    return t.part.select("p_partkey", F.col("p_retailprice").try_cast("decimal(18,2)").cast("double").alias("d"), S.duration_text(F.col("p_size") * 3600).alias("t"))


# Quantizers, sketches, constructors, numbering


@query("vector_product_rerank", f"SELECT vec_id, round({_METRICS['l2']}, 6) AS d FROM embeddings ORDER BY {_METRICS['l2']}, vec_id LIMIT 5")
def _(t):
    books = V.product_codebooks(t.embeddings, "embedding", key="vec_id")
    coded = t.embeddings.withColumn("codes", V.product_codes("embedding", books)).withColumn("error", V.product_errors("embedding", books))
    # 200 of those that the codes find are looked at first, then those that the errors don't rule out
    return V.product_topk(coded, "embedding", "codes", books, Q, 5, "vec_id", oversample=40, error="error").select("vec_id", F.round("distance", 6).alias("d"))


_TERNARY = "list_transform({v}, lambda x: CASE WHEN abs(x) < list_sum(list_transform({v}, lambda y: abs(y))) / 64 * 0.5 THEN 0 ELSE sign(x) END)"


@query("vector_ternary", f"WITH c AS (SELECT vec_id, embedding, list_inner_product(CAST({_TERNARY.format(v=E)} AS DOUBLE[]), CAST({_TERNARY.format(v=QL)} AS DOUBLE[])) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 60) SELECT vec_id, round({_METRICS['l2']}, 6) AS d FROM c ORDER BY {_METRICS['l2']}, vec_id LIMIT 10")
def _(t):
    """Search by the inner product of ternary codes, the best ranked again on the vectors."""
    return V.ternary_topk(t.embeddings, "embedding", Q, 60, 10, "vec_id").select("vec_id", F.round("distance", 6).alias("d"))


@query("agg_approx_percentile", "SELECT l_returnflag, true AS near, round(quantile_cont(l_extendedprice, 0.49), 4) AS lo, round(quantile_cont(l_extendedprice, 0.51), 4) AS hi FROM lineitem GROUP BY 1")
def _(t):
    """Within a hundredth of the exact median's rank."""
    near = t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5, 10000).alias("a"), F.percentile("l_extendedprice", F.lit(0.49)).alias("lo"), F.percentile("l_extendedprice", F.lit(0.51)).alias("hi"))
    return near.select("l_returnflag", F.col("a").between(F.col("lo"), F.col("hi")).alias("near"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("agg_approx_count", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """Estimates from daily count-min sketches: exact here, as the types are few."""
    from sparkloom.operators import relational as R

    daily = R.count_min(t.events.withColumn("day", F.to_date("ts")), "event_type", keys=["day"])
    return R.count_min_estimates(R.count_min_merged(daily), t.events.select(F.col("event_type").alias("value")).distinct())


@query("sequence_numbers", "SELECT count(*) AS n, CAST(min(x) AS BIGINT) AS lo, CAST(max(x) AS BIGINT) AS hi, count(DISTINCT x) AS d FROM (SELECT 100 + 5 * (row_number() OVER (ORDER BY c_custkey) - 1) AS x FROM customer)")
def _(t):
    from sparkloom.operators import dml

    return dml.numbered(t.customer, "x", 100, 5).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_distinct("x").alias("d"))


@query("period_lock", "SELECT 'update' AS op, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_totalprice > 100000")
def _(t):
    from sparkloom.operators import dml

    o = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    new = dml.update(o, {"o_totalprice": F.col("o_totalprice") * 2}, F.col("o_totalprice") > 100000)
    return dml.locked(o, new, ["o_orderkey"], "o_orderdate", F.expr("TIMESTAMP_NTZ '1996-01-01'")).select("op", "o_orderkey")


@query("geo_constructors", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS x, CAST(4 AS INT) AS points, CAST(6.0 AS DOUBLE) AS area FROM nation")
def _(t):
    from sparkloom.functions import spatial as P

    k = F.col("n_nationkey").cast("double")
    corner = lambda x, y: F.struct(x.alias("lng"), y.alias("lat"))
    ring = P.polygon(F.array(corner(k, F.lit(0.0)), corner(k + 1, F.lit(0.0)), corner(k + 1, F.lit(1.0))))
    return t.nation.select("n_nationkey", P.x_of(P.point(k, F.lit(1.0))).alias("x"), P.num_points(ring).alias("points"), P.st_area(P.box(k, F.lit(0.0), k + 3, F.lit(2.0))).alias("area"))
