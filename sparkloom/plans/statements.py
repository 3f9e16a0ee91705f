"""Statements of the database: changes with what they return, transactions, triggers, topics, cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.database import Database
from sparkloom.operators import access, graph, keyvalue, search
from sparkloom.plans import sql
from sparkloom.plans.registry import query, sql_query
from sparkloom.plans.searching import _BM25, _METRICS, Q
from sparkloom.shared import fresh_path
from sparkloom.streaming.topics import Topic


def database(t, name: str = "c") -> Database:
    """A database with a collection of customers (k, seg, bal)."""
    db = Database(t.spark, t.folder)
    db.put(name, t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal")), ["k"])
    return db


C = "SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal FROM customer"


@query("insert_select", f"SELECT k + 100000 AS k, bal FROM ({C}) WHERE bal > 5000")
def _(t):
    db = database(t)
    db.execute("CREATE COLLECTION rich (k BIGINT PRIMARY KEY, bal DOUBLE)")
    db.execute("INSERT INTO rich SELECT k + 100000, bal FROM c WHERE bal > 5000")
    return db.execute("SELECT * FROM rich")


@query("insert_returning", "SELECT CAST(k AS BIGINT) AS k, v * 2 AS twice FROM (VALUES (-1, 1.5::DOUBLE), (-2, 2.5)) x(k, v)")
def _(t):
    return database(t).execute("INSERT INTO c (k, seg, bal) VALUES (-1, 'x', 1.5), (-2, 'y', 2.5) RETURNING k, bal * 2 AS twice")


@query("update_returning", f"SELECT k, round(bal + 1, 2) AS bal FROM ({C}) WHERE seg = 'BUILDING'")
def _(t):
    return database(t).execute("UPDATE c SET bal = bal + 1 WHERE seg = 'BUILDING' RETURNING k, round(bal, 2) AS bal")


@query("delete_returning", f"SELECT k FROM ({C}) WHERE bal < 0")
def _(t):
    return database(t).execute("DELETE FROM c WHERE bal < 0 RETURNING k")


@query("transaction_rollback", f"SELECT seg, count(*) AS n, round(sum(bal), 2) AS total FROM (SELECT seg, CASE WHEN seg = 'BUILDING' THEN 0 ELSE bal END AS bal FROM ({C})) GROUP BY seg")
def _(t):
    db = database(t)
    for text in ("BEGIN", "UPDATE c SET bal = 0 WHERE seg = 'BUILDING'", "SAVEPOINT s", "DELETE FROM c WHERE bal > 0", "ROLLBACK TO SAVEPOINT s", "COMMIT", "BEGIN", "TRUNCATE c", "ROLLBACK"):
        db.execute(text)
    return db.execute("SELECT seg, count(*) AS n, round(sum(bal), 2) AS total FROM c GROUP BY seg")


@query("trigger_after_rows", f"SELECT k, bal AS was, bal * 2 AS now FROM ({C}) WHERE bal > 9000")
def _(t):
    db = database(t)
    db.execute("CREATE COLLECTION audit (k BIGINT, was DOUBLE, now DOUBLE)")
    db.execute("CREATE TRIGGER a AFTER UPDATE ON c FOR EACH ROW WHEN (old.bal > 9000) AS INSERT INTO audit VALUES (OLD.k, OLD.bal, NEW.bal)")
    db.execute("UPDATE c SET bal = bal * 2")
    return db.execute("SELECT * FROM audit")


@query("trigger_before_set", f"SELECT k, least(bal * 2, 5000) AS bal FROM ({C})")
def _(t):
    db = database(t)
    db.execute("CREATE TRIGGER b BEFORE INSERT OR UPDATE ON c WHEN (new.bal > 5000) AS SET NEW.bal = 5000")
    db.execute("UPDATE c SET bal = bal * 2")
    return db.execute("SELECT k, CASE WHEN bal > 5000 THEN -1 ELSE bal END AS bal FROM c")


@query("trigger_instead_of", f"SELECT k, bal >= 0 AS there FROM ({C})")
def _(t):
    db = database(t)
    db.execute("CREATE COLLECTION gone (k BIGINT PRIMARY KEY)")
    db.execute("CREATE TRIGGER i INSTEAD OF DELETE ON c AS INSERT INTO gone VALUES (OLD.k)")
    db.execute("DELETE FROM c WHERE bal < 0")
    return db.execute("SELECT c.k, gone.k IS NULL AS there FROM c LEFT JOIN gone ON c.k = gone.k")


@query("clone_and_mirror", f"SELECT sum(bal) > 0 AS cloned, 0 AS mirrored, count(*) AS n FROM ({C})")
def _(t):
    db = database(t)
    db.execute("CREATE COLLECTION d CLONE OF c")
    db.execute("CREATE MIRROR m OF c")
    db.execute("UPDATE c SET bal = 0")
    return db.execute("SELECT sum(d.bal) > 0 AS cloned, CAST(sum(abs(m.bal)) AS INT) AS mirrored, count(*) AS n FROM d JOIN m ON d.k = m.k")


@query("convert_collection", f"SELECT k, bal FROM ({C})")
def _(t):
    db = database(t)
    db.execute("CONVERT COLLECTION c TO DOCUMENT")
    db.execute("CONVERT COLLECTION c TO COLUMNAR (seg STRING, bal DOUBLE)")
    return db.execute("SELECT k, bal FROM c")


@query("index_family", f"SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT k, seg FROM ({C}))) AS terms FROM ({C}) WHERE bal BETWEEN 100 AND 200")
def _(t):
    """A layout, a unique index and postings: the results stay the same."""
    db = database(t)
    for text in ("CREATE INDEX b ON c (bal)", "CREATE UNIQUE INDEX u ON c (k)", "CREATE FULLTEXT INDEX f ON c (seg)"):
        db.execute(text)
    return db.execute("SELECT count(*) AS n, (SELECT count(*) FROM f) AS terms FROM c WHERE bal BETWEEN 100 AND 200")


@query("search_using_vector", f"SELECT vec_id, round({_METRICS['l2']}, 6) AS d FROM embeddings ORDER BY {_METRICS['l2']}, vec_id LIMIT 7")
def _(t):
    db = Database(t.spark, t.folder, keys={"embeddings": ["vec_id"]})
    return db.execute(f"SEARCH embeddings USING VECTOR (embedding, ARRAY[{', '.join(map(repr, Q))}], 7)").select("vec_id", F.round("distance", 6).alias("d"))


@query("search_using_text", f"{_BM25} SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 9")
def _(t):
    db = Database(t.spark, t.folder, keys={"documents": ["doc_id"]})
    return db.execute("SEARCH documents USING TEXT (text, 'the und', 9)").select("doc_id", F.round("score", 6).alias("score"))


@query("search_using_fusion", f"{_BM25}, v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {_METRICS['l2']}, vec_id) AS r FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY r LIMIT 18), x AS (SELECT r.doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM r JOIN embeddings ON doc_id = vec_id ORDER BY 2 LIMIT 18) SELECT id, round(sum(1 / (60.0::DOUBLE + r)), 9) AS rrf FROM (SELECT * FROM v UNION ALL SELECT * FROM x) GROUP BY id ORDER BY sum(1 / (60.0::DOUBLE + r)) DESC, id LIMIT 6".replace("FROM documents))", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)))"))
def _(t):
    """Documents with the vector of their number."""
    db = Database(t.spark)
    db.put("d", t.documents.join(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id").select(F.col("doc_id").alias("id"), "text", "embedding"), ["id"])
    return db.execute(f"SEARCH d USING FUSION (embedding, ARRAY[{', '.join(map(repr, Q))}], text, 'the und', 6)").select("id", F.round("rrf", 9).alias("rrf"))


@query("graph_edges_put_delete", "SELECT * FROM (VALUES ('alice', 'bob', 'knows'), ('bob', 'carol', 'knows')) v(src, dst, label)")
def _(t):
    db = Database(t.spark)
    for a, b in (("alice", "bob"), ("bob", "carol"), ("carol", "alice"), ("alice", "bob")):
        db.execute(f"GRAPH INSERT EDGE FROM '{a}' TO '{b}' TYPE 'knows'")
    db.execute("GRAPH DELETE EDGE FROM 'carol' TO 'alice' TYPE 'knows'")
    return db.execute("SELECT * FROM edges")


@query("analyze_columns", f"SELECT * FROM (SELECT 'bal' AS \"column\", count(*) - count(bal) AS nulls, count(*) AS rows, min(bal)::VARCHAR AS least, max(bal)::VARCHAR AS greatest FROM ({C}) UNION ALL SELECT 'k', count(*) - count(k), count(*), min(k)::VARCHAR, max(k)::VARCHAR FROM ({C}) UNION ALL SELECT 'seg', count(*) - count(seg), count(*), min(seg), max(seg) FROM ({C}))")
def _(t):
    return database(t).execute("ANALYZE c").select("column", "nulls", "rows", "least", "greatest")


@query("cursor_fetch", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def _(t):
    cursor = access.Cursor(t.nation.orderBy("n_nationkey").select("n_name"))
    rows = cursor.fetch(3) + cursor.fetch(4)
    cursor.close()
    return t.spark.createDataFrame(rows, "n_name string")


@query("consumer_groups", "SELECT 'a' AS g, count(*) AS n FROM events UNION ALL SELECT 'b', count(*) FROM events WHERE event_type = 'click'")
def _(t):
    """Group a reads twice and meets each row once; b begins after a and meets all of them."""
    topic = Topic(t.spark, fresh_path(t.spark, "topic"), "event_id long, event_type string")
    out = fresh_path(t.spark, "seen")

    def take(group, keep):
        return lambda rows, n: rows.filter(keep).select(F.lit(group).alias("g"), "event_id").write.mode("append").parquet(out)

    topic.publish(t.events.filter("event_id % 2 = 0"))
    topic.consume("a", take("a", F.lit(True)))
    topic.publish(t.events.filter("event_id % 2 = 1"))
    topic.consume("a", take("a", F.lit(True)))
    topic.consume("b", take("b", F.col("event_type") == "click"))
    return t.spark.read.schema("g string, event_id long").parquet(out).groupBy("g").agg(F.count("*").alias("n"))


@query("kv_field_get", "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer WHERE c_custkey IN (3, 5, 8)")
def _(t):
    table = t.customer.select(F.col("c_custkey").alias("key"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))).alias("value"))
    return keyvalue.get(table, "key", 3, 5, 8).select("key", F.get_json_object("value", "$.segment").alias("segment"))


@query("temporary_table", "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n > 12")
def _(t):
    db = Database(t.spark, t.folder)
    db.put("busy", db.execute("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1"), keep=False)
    return db.execute("SELECT * FROM busy WHERE n > 12")


@query("array_statements", "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 5.0::DOUBLE)) v(x, y, q)")
def _(t):
    db = Database(t.spark)
    db.execute("CREATE ARRAY g DIMS (x INT64 [0..9], y INT64 [0..9]) ATTRS (q FLOAT64)")
    a = db.arrays["g"]
    db.arrays["g"] = a._with(t.spark.createDataFrame([(1, 2, 3.0, 1), (1, 2, 5.0, 4), (7, 7, 1.0, 2)], "x long, y long, q double, _ts_system long"))
    db.execute("SELECT ARRAY_COMPACT('g', 9)")
    return db.execute("SELECT x, y, q FROM ARRAY_SLICE('g', '{x: [0, 3], y: [0, 5]}')")


@query("array_alter", "SELECT * FROM (VALUES (1::BIGINT, 5.0::DOUBLE, NULL::BIGINT)) v(x, q, r)")
def _(t):
    db = Database(t.spark)
    db.execute("CREATE ARRAY g DIMS (x INT64 [0..9]) ATTRS (q FLOAT64, s STRING) TILE_EXTENTS (x 4)")
    a = db.arrays["g"]
    db.arrays["g"] = a._with(t.spark.createDataFrame([(1, 5.0, "a", 1)], "x long, q double, s string, _ts_system long"))
    for text in ("ALTER ARRAY g ADD ATTR r INT64", "ALTER ARRAY g DROP ATTR s", "ALTER ARRAY g TILE_EXTENTS (x 2)"):
        db.execute(text)
    return db.execute("SELECT x, q, r FROM ARRAY_SLICE('g', '{x: [0, 9]}')")


@query("vector_index_lifecycle", "SELECT count(*) AS vectors, count(*) > 0 AS listed FROM embeddings WHERE vec_id % 7 <> 0")
def _(t):
    """An index follows deletions and changes of its collection, and is built anew."""
    db = Database(t.spark)
    db.put("v", t.embeddings.select("vec_id", "embedding"), ["vec_id"])
    db.execute("CREATE VECTOR INDEX i ON v (embedding)")
    db.execute("DELETE FROM v WHERE vec_id % 7 = 0")
    db.execute("UPDATE v SET embedding = reverse(embedding) WHERE vec_id % 7 = 1")
    stats = db.execute("SELECT VECTOR_STATS('i')")
    db.execute("REBUILD VECTOR INDEX i")
    return stats.select("vectors", (F.col("lists") > 1).alias("listed"))


@query("index_lookup_nocase", "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#11'")
def _(t):
    return t.part.filter(F.lower("p_brand") == "brand#11").select("p_partkey")


@query("kv_batch_put_field_set", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN '{\"b\":\"' || c_nationkey || '\",\"a\":\"x\"}' ELSE '{\"a\":\"1\",\"b\":\"' || c_nationkey || '\"}' END AS value FROM customer")
def _(t):
    table = t.customer.select(F.col("c_custkey").alias("key"), F.to_json(F.struct(F.lit("1").alias("a"), F.col("c_nationkey").cast("string").alias("b"))).alias("value"))
    sets = t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.create_map(F.lit("a"), F.lit("x")).alias("fields"))
    return keyvalue.fields_set(table, "key", "value", sets)


@query("kv_truncate", "SELECT 0 AS left, count(*) AS n FROM customer")
def _(t):
    db = database(t)
    n = db.execute("SELECT count(*) AS n FROM c").first()["n"]
    db.execute("TRUNCATE c")
    return db.execute(f"SELECT CAST(count(*) AS INT) AS left, CAST({n} AS BIGINT) AS n FROM c")


@query("kv_rate_gate_reset", "SELECT event_id, n <= 2 AS allowed FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, d, era, event_type = 'error' ORDER BY ts, event_id) AS n FROM (SELECT *, CAST(ts AS DATE) AS d, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS era FROM events)) WHERE event_type <> 'error'")
def _(t):
    return keyvalue.rate_gate(t.events, "ts", "user_id", 86400, 2, "event_id", reset=F.col("event_type") == "error").select("event_id", "allowed")


@query("fts_offsets", "SELECT doc_id, CAST(len(a) - 1 AS INT) AS n, CAST(CASE WHEN len(a) > 1 THEN length(a[1]) END AS INT) AS first FROM (SELECT doc_id, regexp_split_to_array(text, '(?i)\\b(?:the|of)\\b') AS a FROM documents WHERE lang = 'en')")
def _(t):
    o = search.offsets("text", ["the", "of"])
    return t.documents.filter("lang = 'en'").select("doc_id", F.size(o).alias("n"), F.get(o, F.lit(0))["start"].alias("first"))


@query("semi_join_pushdown", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 11)")
def _(t):
    return t.lineitem.join(t.orders.filter("o_custkey = 11").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("graph_temporal_components", "SELECT n_nationkey AS node, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation WHERE n_nationkey <= 20 AND n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey <= 20 GROUP BY 1 HAVING count(*) > 1)")
def _(t):
    """Edges between nations of one region, each from the greater of its ends' numbers on: components as of 20."""
    a, b = (t.nation.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias("r")) for k in ("src", "dst"))
    e = a.join(b, "r").filter("src < dst").withColumn("since", F.col("dst"))
    return graph.components(e.filter("since <= 20"))


@query("explain_analyze", "SELECT 'rows: ' || count(*) AS plan FROM orders WHERE o_totalprice > 200000")
def _(t):
    return Database(t.spark, t.folder).execute("EXPLAIN ANALYZE SELECT o_orderkey FROM orders WHERE o_totalprice > 200000").filter("plan LIKE 'rows: %'")


@query("now_and_user", "SELECT true AS at, true AS day, true AS who, count(*) AS n FROM nation")
def _(t):
    return sql.run(t, "SELECT now() = current_timestamp() AS at, current_date() = to_date(now()) AS day, current_user() = user() AS who, count(*) AS n FROM nation")


sql_query(
    "named_windows",
    "SELECT o_orderkey, sum(o_totalprice) OVER w AS running, row_number() OVER w AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
sql_query(
    "json_array_object",
    "SELECT n_nationkey, to_json(array(n_nationkey, n_regionkey)) AS a, to_json(named_struct('name', n_name, 'region', n_regionkey)) AS o FROM nation",
    "SELECT n_nationkey, '[' || n_nationkey || ',' || n_regionkey || ']' AS a, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS o FROM nation",
)
