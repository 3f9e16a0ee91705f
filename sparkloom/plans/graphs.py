"""Graph queries: parts that follow each other in an order, and the nations' regions as a tree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.operators.match import match
from sparkloom.plans.registry import query


def parts(t):
    """Part to the part on an order's next line; label: the line's return flag."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("weight"))
    return e.filter("dst IS NOT NULL")


def tree(t):
    """Nation to the nation of its region's number."""
    return t.nation.filter("n_nationkey <> n_regionkey").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.lit("in").alias("label"))


def rings(t):
    """Customers of one nation and segment in a ring, with chords to the fifth next: many components,
    cycles, and several shortest paths between two nodes."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    first = F.first("c_custkey").over(w)
    c = t.customer.select(F.col("c_custkey").alias("src"), F.array(F.coalesce(F.lead("c_custkey").over(w), first), F.lead("c_custkey", 5).over(w)).alias("ends"))
    return c.select("src", F.explode("ends").alias("dst")).filter("dst IS NOT NULL AND src <> dst").distinct()


def cliques(t):
    """Nations of one region all with each other, and a supplier at its nation's end."""
    a, b = (t.nation.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias("r")) for k in ("src", "dst"))
    inner = a.join(b, "r").filter("src < dst").select("src", "dst")
    return inner.unionByName(t.supplier.select((F.col("s_suppkey") + 1000).cast("int").alias("src"), F.col("s_nationkey").alias("dst")))


E = "e AS (SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS dst, l_returnflag AS label, l_quantity AS weight FROM lineitem) WHERE dst IS NOT NULL)"
#: Undirected, without loops and repeats, both ways
U = E + ", u AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst)"
N = U + ", n AS (SELECT DISTINCT src AS node FROM (SELECT src FROM e UNION ALL SELECT dst FROM e))"
T = "t AS (SELECT n_nationkey AS src, n_regionkey AS dst FROM nation WHERE n_nationkey <> n_regionkey), u AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), n AS (SELECT DISTINCT src AS node FROM u)"
#: The rings' edges both ways, and distances within them
C = "c AS (SELECT c_custkey AS k, c_nationkey AS a, c_mktsegment AS b, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer), o AS (SELECT DISTINCT x.k AS src, y.k AS dst FROM c x JOIN c y ON x.a = y.a AND x.b = y.b AND (y.i = x.i % x.n + 1 OR y.i = x.i + 5) AND x.k <> y.k), u AS (SELECT src, dst FROM o UNION SELECT dst, src FROM o), n AS (SELECT DISTINCT src AS node FROM u)"
D = C + ", w(source, node, depth) AS (SELECT node, node, 0 FROM n UNION SELECT source, dst, depth + 1 FROM w JOIN u ON w.node = u.src WHERE depth < 30), d AS (SELECT source, node, min(depth) AS depth FROM w GROUP BY 1, 2)"


@query("graph_degree", f"WITH {N} SELECT n.node, CAST(coalesce(d, 0) AS BIGINT) AS degree, round(coalesce(d, 0) / (SELECT count(*) - 1 FROM n), 9) AS centrality FROM n LEFT JOIN (SELECT src AS node, count(*) AS d FROM (SELECT src FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) USING (node)")
def _(t):
    return G.degrees(parts(t)).select("node", "degree", F.round("centrality", 9).alias("centrality"))


@query("graph_neighbors", f"WITH {E} SELECT DISTINCT src, dst AS node FROM e WHERE src = 7 AND label = 'R'")
def _(t):
    return G.neighbors(parts(t), 7, "R")


@query("graph_neighbors_multi", f"WITH {E} SELECT DISTINCT src, dst AS node FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src IN (3, 5, 9)")
def _(t):
    return G.neighbors(parts(t), [3, 5, 9], direction="both")


@query("graph_bfs", f"WITH RECURSIVE {E}, r(node, depth) AS (SELECT 11, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON r.node = e.src WHERE depth < 2) SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node")
def _(t):
    return G.bfs(parts(t), t.spark.sql("SELECT bigint(11) AS node"), 2)


@query("graph_shortest_path_length", f"WITH RECURSIVE {T}, r(node, depth) AS (SELECT 7, 0 UNION SELECT dst, depth + 1 FROM r JOIN u ON node = src WHERE depth < 6) SELECT CAST(min(depth) AS INT) AS length FROM r WHERE node = 2")
def _(t):
    return G.shortest_path(G.directed(tree(t).select("src", "dst"), "both"), 7, 2).select("length")


@query("graph_subgraph", f"WITH {E}, d AS (SELECT 11 AS node UNION SELECT dst FROM e WHERE src = 11) SELECT src, dst, label FROM e WHERE src IN (SELECT node FROM d) AND dst IN (SELECT node FROM d)")
def _(t):
    return G.subgraph(parts(t), t.spark.sql("SELECT bigint(11) AS node"), 1).select("src", "dst", "label")


@query("graph_stats", f"WITH {E} SELECT label, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY label")
def _(t):
    return G.stats(parts(t))


@query("graph_components", f"WITH {C} SELECT k AS node, min(k) OVER (PARTITION BY a, b) AS component FROM c WHERE n > 1")
def _(t):
    return G.components(rings(t))


_PAGERANK = f""", m AS (SELECT count(*)::DOUBLE AS c FROM n), s AS (SELECT DISTINCT src, dst FROM e), g AS (SELECT src, count(*) AS d FROM s GROUP BY src),
r(i, node, rank) AS (SELECT 0, node, 1 / c FROM n, m UNION ALL
SELECT i, node, 0.15 / max(c) + 0.85 * (sum(got) + max(dangling) / max(c)) FROM (
SELECT r.i + 1 AS i, s.dst AS node, r.rank / g.d AS got, 0.0 AS dangling FROM r JOIN s ON r.node = s.src JOIN g ON g.src = r.node WHERE r.i < 5
UNION ALL SELECT DISTINCT r.i + 1, n.node, 0.0, (SELECT coalesce(sum(rank), 0) FROM r WHERE node NOT IN (SELECT src FROM g)) FROM r, n WHERE r.i < 5), m GROUP BY i, node)
SELECT node, round(rank, 10) AS rank FROM r WHERE i = 5"""


@query("graph_pagerank", f"WITH RECURSIVE {N}{_PAGERANK}")
def _(t):
    return G.pagerank(parts(t), iterations=5, tolerance=0.0).select("node", F.round("rank", 10).alias("rank"))


_PERSONAL = """, g AS (SELECT src, count(*) AS d FROM t GROUP BY src), r(i, node, rank) AS (SELECT 0, node, CASE WHEN node = 3 THEN 1.0::DOUBLE ELSE 0 END FROM n UNION ALL
SELECT i, node, (0.15 + 0.85 * max(dangling)) * CASE WHEN node = 3 THEN 1 ELSE 0 END + 0.85 * sum(got) FROM (
SELECT r.i + 1 AS i, t.dst AS node, r.rank / g.d AS got, 0.0::DOUBLE AS dangling FROM r JOIN t ON r.node = t.src JOIN g ON g.src = r.node WHERE r.i < 12
UNION ALL SELECT DISTINCT r.i + 1, n.node, 0.0::DOUBLE, (SELECT coalesce(sum(rank), 0) FROM r WHERE node NOT IN (SELECT src FROM g)) FROM r, n WHERE r.i < 12) GROUP BY i, node)
SELECT node, round(rank, 10) AS rank FROM r WHERE i = 12"""


@query("graph_pagerank_personal", f"WITH RECURSIVE {T}{_PERSONAL}")
def _(t):
    return G.pagerank(tree(t), iterations=12, tolerance=0.0, personal=t.spark.sql("SELECT 3 AS node")).select("node", F.round("rank", 10).alias("rank"))


@query("graph_triangles", f"WITH {N} SELECT n.node, count(a.dst) AS triangles FROM n LEFT JOIN (SELECT x.src, x.dst FROM u x JOIN u y ON x.src = y.src AND x.dst < y.dst JOIN u z ON z.src = x.dst AND z.dst = y.dst) a ON a.src = n.node GROUP BY n.node")
def _(t):
    return G.triangles(parts(t))


@query("graph_lcc", f"WITH {N}, k AS (SELECT src AS node, count(*) AS d FROM u GROUP BY 1), a AS (SELECT x.src AS node, count(*) AS tri FROM u x JOIN u y ON x.src = y.src AND x.dst < y.dst JOIN u z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1) SELECT n.node, round(CASE WHEN d >= 2 THEN 2.0 * coalesce(tri, 0) / (d * (d - 1)) ELSE 0 END, 9) AS lcc FROM n LEFT JOIN k USING (node) LEFT JOIN a USING (node)")
def _(t):
    return G.local_clustering(parts(t)).select("node", F.round("lcc", 9).alias("lcc"))


@query("graph_sssp", f"WITH RECURSIVE {C}, r(node, distance) AS (SELECT 1, 0.0::DOUBLE UNION SELECT u.dst, distance + 1.0 + (u.dst % 7) / 4.0 FROM r JOIN u ON r.node = u.src WHERE distance < 40) SELECT node, round(min(distance), 6) AS distance FROM r GROUP BY node")
def _(t):
    e = G.directed(rings(t), "both").withColumn("weight", 1.0 + F.col("dst") % 7 / 4.0)
    return G.sssp(e, 1).select("node", F.round("distance", 6).alias("distance"))


@query("graph_k_core", "SELECT n_nationkey AS node, CAST(count(*) OVER (PARTITION BY n_regionkey) - 1 AS INT) AS core FROM nation UNION ALL SELECT CAST(s_suppkey + 1000 AS INT), CAST(1 AS INT) FROM supplier")
def _(t):
    return G.k_core(cliques(t))


#: Core numbers are where degrees settle that are again and again the h-index of the neighbours' own.
@query("graph_k_core_parts", f"WITH RECURSIVE {N}, h(i, node, h) AS (SELECT 0, src, count(*) FROM u GROUP BY src UNION ALL SELECT i + 1, src, max(least(place, h)) FROM (SELECT h.i, u.src, h.h, row_number() OVER (PARTITION BY u.src ORDER BY h.h DESC) AS place FROM h JOIN u ON u.dst = h.node WHERE h.i < 60) GROUP BY i, src) SELECT CAST(coalesce(h, 0) AS INT) AS core, count(*) AS nodes FROM n LEFT JOIN (SELECT * FROM h WHERE i = 60) USING (node) GROUP BY 1")
def _(t):
    return G.k_core(parts(t)).groupBy("core").agg(F.count("*").alias("nodes"))


@query("graph_closeness", f"WITH RECURSIVE {D} SELECT source AS node, round((count(*) - 1) / sum(depth), 9) AS closeness, round(sum(CASE WHEN depth > 0 THEN 1.0::DOUBLE / depth ELSE 0 END), 9) AS harmonic FROM d GROUP BY source")
def _(t):
    return G.closeness(rings(t)).select("node", F.round("closeness", 9).alias("closeness"), F.round("harmonic", 9).alias("harmonic"))


_PATHS_OF = ", p(source, node, depth, n) AS (SELECT node, node, 0, 1.0::DOUBLE FROM n UNION ALL SELECT p.source, u.dst, d.depth, sum(p.n) FROM p JOIN u ON u.src = p.node JOIN d ON d.source = p.source AND d.node = u.dst AND d.depth = p.depth + 1 GROUP BY p.source, u.dst, d.depth)"


@query("graph_betweenness", f"WITH RECURSIVE {D}{_PATHS_OF}, x AS (SELECT a.node, a.n * b.n / c.n AS share FROM p c JOIN p a ON a.source = c.source JOIN p b ON b.source = a.node AND b.node = c.node AND a.depth + b.depth = c.depth WHERE c.source < c.node AND a.node <> c.source AND a.node <> c.node) SELECT n.node, round(coalesce(sum(share), 0), 6) AS betweenness FROM n LEFT JOIN x USING (node) GROUP BY n.node")
def _(t):
    return G.betweenness(rings(t)).select("node", F.round("betweenness", 6).alias("betweenness"))


@query("graph_diameter_exact", f"WITH RECURSIVE {D}, f AS (SELECT source, max(depth) AS far FROM d GROUP BY source) SELECT CAST(max(far) AS INT) AS diameter, CAST(min(far) AS INT) AS radius FROM f")
def _(t):
    return G.diameter(rings(t), exact=True)


@query("graph_diameter_sweep", f"WITH RECURSIVE {N}, a(node, depth) AS (SELECT min(node), 0 FROM n UNION SELECT dst, depth + 1 FROM a JOIN u ON node = src WHERE depth < 12), f AS (SELECT node, min(depth) AS depth FROM a GROUP BY node), b(node, depth) AS (SELECT node, 0 FROM (SELECT node FROM f ORDER BY depth DESC, node DESC LIMIT 1) UNION SELECT dst, depth + 1 FROM b JOIN u ON node = src WHERE depth < 12) SELECT CAST(max(depth) AS INT) AS diameter, CAST(ceil(max(depth) / 2) AS INT) AS radius FROM (SELECT node, min(depth) AS depth FROM b GROUP BY node)")
def _(t):
    return G.diameter(parts(t))


_VOTES = """, r(i, node, c) AS (SELECT 0, node, node FROM n UNION ALL SELECT i + 1, src, c FROM (SELECT r.i, u.src, r.c, count(*) AS n FROM r JOIN u ON u.dst = r.node WHERE r.i < 10 GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, c) = 1)
SELECT node, c AS community FROM r WHERE i = 10"""


@query("graph_label_propagation", f"WITH RECURSIVE {T}{_VOTES}")
def _(t):
    return G.label_propagation(tree(t))


@query("graph_louvain", None)
def _(t):
    return G.louvain(tree(t))


# The same over the parts, a graph that grows with the input


@query("graph_components_parts", f"WITH RECURSIVE {N}, r(i, node, c) AS (SELECT 0, node, node FROM n UNION ALL SELECT i, node, min(c) FROM (SELECT r.i + 1 AS i, u.dst AS node, r.c FROM r JOIN u ON u.src = r.node WHERE r.i < 40 UNION ALL SELECT i + 1, node, c FROM r WHERE i < 40) GROUP BY i, node) SELECT node, c AS component FROM r WHERE i = 40")
def _(t):
    return G.components(parts(t))


@query("graph_sssp_parts", f"WITH RECURSIVE {E}, r(i, node, distance) AS (SELECT 0, 7, 0.0::DOUBLE UNION ALL SELECT i, node, min(distance) FROM (SELECT r.i + 1 AS i, e.dst AS node, distance + weight AS distance FROM r JOIN e ON r.node = e.src WHERE r.i < 60 UNION ALL SELECT i + 1, node, distance FROM r WHERE i < 60) GROUP BY i, node) SELECT node, round(distance, 6) AS distance FROM r WHERE i = 60")
def _(t):
    return G.sssp(parts(t), 7).select("node", F.round("distance", 6).alias("distance"))


@query("graph_label_propagation_parts", f"WITH RECURSIVE {N}{_VOTES}")
def _(t):
    return G.label_propagation(parts(t))


@query("graph_louvain_parts", None)
def _(t):
    return G.louvain(parts(t))


@query("graph_temporal_neighbors", "SELECT DISTINCT o_custkey AS src, l_partkey AS node FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate <= TIMESTAMP '1996-01-01'")
def _(t):
    e = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("o_orderdate").alias("since"))
    return e.filter("since <= TIMESTAMP_NTZ '1996-01-01'").select("src", F.col("dst").alias("node")).distinct()


@query("graph_rag_fusion", f"WITH {E}, h AS (SELECT p_partkey AS id, p_retailprice AS s FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10), g AS (SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM h UNION ALL SELECT CASE WHEN src = h.id THEN dst ELSE src END, 1 FROM e JOIN h ON h.id = src OR h.id = dst) GROUP BY id), x AS (SELECT id, 1 / (60.0::DOUBLE + row_number() OVER (ORDER BY s DESC, id)) AS s FROM h UNION ALL SELECT id, 1 / (10.0::DOUBLE + row_number() OVER (ORDER BY depth, id)) FROM g) SELECT id, round(sum(s), 9) AS score FROM x GROUP BY id ORDER BY sum(s) DESC, id LIMIT 20")
def _(t):
    hits = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("s"))
    return G.graph_rag(hits, parts(t), 1, 20).select("id", F.round("score", 9).alias("score"))


# Patterns


@query("match_two_hops", f"WITH {E} SELECT DISTINCT a.src AS a, b.dst AS c FROM e a JOIN e b ON a.dst = b.src WHERE a.label = 'R' AND b.label = 'A' AND a.src = 5")
def _(t):
    return match(parts(t), "MATCH (a)-[:R]->(b)-[:A]->(c) WHERE a.id = 5 RETURN DISTINCT a.id AS a, c.id AS c")


@query("match_reverse_count", f"WITH {E} SELECT b.dst AS b, count(*) AS n FROM e a JOIN e b ON a.dst = b.dst AND a.label = 'R' AND b.label = 'A' GROUP BY 1 ORDER BY n DESC, b LIMIT 10")
def _(t):
    return match(parts(t), "MATCH (a)-[:R]->(b)<-[:A]-(c) RETURN b, count(*) AS n ORDER BY n DESC, b LIMIT 10")


@query("match_labels_fields", f"WITH {E} SELECT p.p_name AS name, q.p_size AS size FROM e JOIN part p ON e.src = p.p_partkey JOIN part q ON e.dst = q.p_partkey WHERE p.p_brand = 'Brand#11' AND q.p_brand = 'Brand#22' AND q.p_size > 20")
def _(t):
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.regexp_replace("p_brand", "Brand#", "B").alias("label"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return match(parts(t), "MATCH (a:B11)-[e]->(b:B22) WHERE b.size > 20 RETURN a.name AS name, b.size AS size", nodes)


@query("match_variable_length", f"WITH {E}, x AS (SELECT DISTINCT src, dst FROM e WHERE label = 'A') SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM x UNION SELECT x.src, y.dst FROM x JOIN x y ON x.dst = y.src) WHERE a = 9")
def _(t):
    return match(parts(t), "MATCH (a)-[:A*1..2]->(b) WHERE a.id = 9 RETURN DISTINCT a, b")


@query("match_optional", f"WITH {E}, x AS (SELECT DISTINCT src, dst FROM e WHERE label = 'R'), y AS (SELECT DISTINCT src, dst FROM e WHERE label = 'N') SELECT x.src AS a, count(y.dst) AS n FROM x LEFT JOIN y ON x.src = y.dst AND x.dst = y.src GROUP BY 1")
def _(t):
    e = parts(t).select("src", "dst", "label").distinct()
    return match(e, "MATCH (a)-[:R]->(b) OPTIONAL MATCH (b)-[f:N]->(a) RETURN a, count(f) AS n")


@query("match_not_exists", f"WITH {E} SELECT DISTINCT a.src AS a, a.dst AS b FROM e a WHERE label = 'R' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.src = a.dst AND b.dst = a.src)")
def _(t):
    return match(parts(t), "MATCH (a)-[:R]->(b) WHERE NOT EXISTS { MATCH (b)-[]->(a) } RETURN DISTINCT a, b")
