"""Graph operators over an edge table (src, dst, and maybe label and weight).

Iterative algorithms write each round's state to the shared folder (``shared.written``): a
round's plan stays small, and a lost executor costs one round.  All of them shuffle
node-sized states against edge-sized tables; none gathers a neighbourhood in one row unless
its docstring says so.  Driver loops read only counts."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import allpairs
from sparkloom.operators.search import rrf
from sparkloom.shared import written

#: Levels of a traversal that are kept as tables of their own.
MERGED = 16
ENDS = ["src", "dst"]


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges to follow: out as they are, in reversed, both with their reverses."""
    turned = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    back = edges.select(*(turned.get(c, F.col(c)) for c in edges.columns))
    return {"out": lambda: edges, "in": lambda: back, "both": lambda: edges.unionByName(back)}[direction]()


def simple(edges: DataFrame) -> DataFrame:
    """Undirected edges without loops and repeats, each once with src < dst."""
    e = edges.filter("src <> dst").select(F.least(*ENDS).alias("src"), F.greatest(*ENDS).alias("dst"))
    return e.distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(*ENDS)).alias("node")).distinct()


def neighbors(edges: DataFrame, node: Column | object, label: str | None = None, direction: str = "out") -> DataFrame:
    """Distinct neighbours of a node, or of several (a list)."""
    e = directed(edges if label is None else edges.filter(F.col("label") == label), direction)
    start = F.col("src").isin(node) if isinstance(node, list) else F.col("src") == F.lit(node)
    return e.filter(start).select("src", F.col("dst").alias("node")).distinct()


def stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("label").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


# Traversals


def bfs(edges: DataFrame, seeds: DataFrame, hops: int | None = None, direction: str = "out", source: bool = False) -> DataFrame:
    """node, depth of what seeds(node) reach within hops (None: however far); with ``source``, per
    seed: source, node, depth.  Each hop joins the frontier alone against edges and drops what
    was seen."""
    e = directed(edges.select(*ENDS), direction).distinct()
    if hops is None or hops > 2:  # a table: each hop would make the edges again
        e = written(e, "edges")
    return _walked(e, seeds, hops, direction, source)


def _walked(e: DataFrame, seeds: DataFrame, hops: int | None = None, direction: str = "both", source: bool = False) -> DataFrame:
    """bfs over distinct edges that are directed as they are followed."""
    own = [F.col("node").alias("source")] if source else []
    key = ["source", "node"] if source else ["node"]
    seen = written(seeds.select(*own, "node", F.lit(0).alias("depth")).distinct(), "bfs0")
    frontier, parts = seen, [seen]
    for depth in itertools.count(1) if hops is None else range(1, hops + 1):
        # without direction a step leads to the level before, the same or a new one
        known = parts[-2:] if direction == "both" else parts
        step = frontier.join(e, frontier["node"] == e["src"]).select(*key[:-1], F.col("dst").alias("node")).distinct()
        frontier = written(step.join(_all(known).select(*key), key, "left_anti").withColumn("depth", F.lit(depth)), f"bfs{depth}")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > MERGED + 2:  # a long walk's levels become one table now and then; the last two stay
            parts = [written(_all(parts[:-2]), f"seen{depth}"), *parts[-2:]]
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out") -> DataFrame:
    """The edges between nodes within hops of the seeds."""
    inside = bfs(edges, seeds, hops, direction).select("node")
    return edges.join(inside, F.col("src") == F.col("node"), "left_semi").join(inside, F.col("dst") == F.col("node"), "left_semi")


def shortest_path(edges: DataFrame, start, goal, most: int | None = None) -> DataFrame:
    """path (array of nodes) and length of a shortest path, the least among equals; no row if
    there is none, or none within ``most`` hops.  The frontier keeps one path a node."""
    e = edges.select(*ENDS).distinct()
    kind = edges.schema["src"].dataType
    at = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node")).withColumn("path", F.array("node"))
    seen, frontier = at.select("node"), written(at, "path0")
    for depth in itertools.count(1) if most is None else range(1, most + 1):
        hit = frontier.filter(F.col("node") == F.lit(goal))
        if start == goal or not hit.isEmpty() or frontier.isEmpty():
            break
        step = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        frontier = written(step, f"path{depth}")
        seen = seen.unionByName(frontier.select("node"))
        if depth % MERGED == 0:
            seen = written(seen, f"seen{depth}")
    return frontier.filter(F.col("node") == F.lit(goal)).select("path", (F.size("path") - 1).alias("length"))


def sssp(edges: DataFrame, start) -> DataFrame:
    """node, distance from start along edges of weight >= 0; Bellman and Ford's relaxation of
    the nodes that changed alone, until none does.  A negative weight is an error."""
    # a table: each round would make the edges again
    e = written(edges.groupBy(*ENDS).agg(F.min("weight").cast("double").alias("weight")), "weights")
    if not e.filter("weight < 0").isEmpty():
        raise ValueError("weights are at least 0")
    kind = edges.schema["src"].dataType
    dist = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0.0).alias("distance"))
    changed = dist = written(dist, "sssp")
    for i in itertools.count():
        step = changed.join(e, changed["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
        both = written(dist.join(step, "node", "full").select("node", F.least("distance", "new").alias("distance"), (F.col("distance").isNull() | (F.col("new") < F.col("distance"))).alias("moved")), f"sssp{i}")
        dist, changed = both.select("node", "distance"), both.filter("moved").select("node", "distance")
        if changed.isEmpty():
            break
    return dist


# Components, ranks, communities


def fingerprint(edges: DataFrame):
    """Number and hash of distinct edges; a sum of hashes would overflow."""
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64(*ENDS))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node): alternating large and small stars."""
    all_nodes = written(nodes(edges), "nodes")
    e = written(simple(edges), "star")
    was = None
    while (now := fingerprint(e)) != was and now[0]:
        was = now
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.filter("dst > src").join(least, "src").select(F.col("m").alias("src"), "dst").filter("src <> dst").distinct()
        large = written(large, "large")
        least = large.groupBy("dst").agg(F.min("src").alias("m"))
        small = large.join(least, "dst").select(F.col("m").alias("src"), F.col("src").alias("dst")).unionByName(least.select(F.col("m").alias("src"), "dst"))
        e = written(small.filter("src <> dst").select(F.least(*ENDS).alias("src"), F.greatest(*ENDS).alias("dst")).distinct(), "small")
    roots = e.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("root"))
    return all_nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-7, personal: DataFrame | None = None) -> DataFrame:
    """node, rank.  Nodes without outgoing edges spread their rank as jumps do: evenly, or, with
    personal(node), over those nodes.  Stops where ranks move by under tolerance in all."""
    e = written(edges.select(*ENDS).distinct(), "edges")
    degree = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    state = nodes(e).join(degree, "node", "left")
    if personal is None:
        state = state.withColumn("jump", F.lit(1.0))
    else:
        state = state.join(personal.select("node", F.lit(1.0).alias("jump")).distinct(), "node", "left").fillna(0.0, ["jump"])
    state = written(state, "jumps")
    total = state.agg(F.sum("jump")).first()[0] or 1.0
    state = written(state.withColumn("jump", F.col("jump") / total).withColumn("rank", F.col("jump")), "rank")
    for i in range(iterations):
        dangling = state.filter("degree IS NULL").agg(F.sum("rank")).first()[0] or 0.0
        sent = e.join(state.select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("share")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        new = (1 - damping) * F.col("jump") + damping * (F.coalesce("got", F.lit(0.0)) + dangling * F.col("jump"))
        state = written(state.join(sent, "node", "left").select("node", "degree", "jump", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")), f"rank{i}")
        if (state.agg(F.sum("moved")).first()[0] or 0.0) < tolerance:
            break
        state = state.drop("moved")
    return state.select("node", "rank")


def label_propagation(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """node, community: in each round a node takes the label most frequent among its
    neighbours (the least of equals); all nodes move together."""
    e = written(directed(simple(edges), "both"), "edges")
    state = written(nodes(edges).withColumn("community", F.col("node")), "labels")
    for i in range(iterations):
        votes = e.join(state, e["dst"] == state["node"]).groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("few"), "community")).alias("b")).select(F.col("src").alias("node"), F.col("b.community").alias("new"))
        both = written(state.join(best, "node", "left").select("node", F.coalesce("new", "community").alias("community"), (F.col("new") != F.col("community")).alias("moved")), f"labels{i}")
        state = both.select("node", "community")
        if both.filter("moved").isEmpty():
            break
    return state


def _ranked(edges: DataFrame) -> DataFrame:
    """Edges from lower to higher degree: no node has over sqrt(2 * edges) of them, so that
    joining them with each other stays near linear however skewed degrees are."""
    e = written(simple(edges), "simple")
    d = directed(e, "both").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    e = e.join(d.withColumnsRenamed({"node": "src", "d": "ds"}), "src").join(d.withColumnsRenamed({"node": "dst", "d": "dd"}), "dst")
    forward = F.struct("ds", "src") < F.struct("dd", "dst")
    return written(e.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("dst")), "ranked")


def _triangle_list(edges: DataFrame) -> DataFrame:
    """x, y, z of each triangle: an edge's ends compare their lists of higher neighbours, which no degree makes
    longer than sqrt(2 * edges), so that pairs of neighbours aren't rows of a shuffle."""
    e = _ranked(edges)
    above = written(e.groupBy(F.col("src").alias("x")).agg(F.collect_list("dst").alias("above")), "above")
    own = above.select("x", F.col("above").alias("zs"), F.explode("above").alias("y"))
    both = own.join(above.select(F.col("x").alias("y"), F.col("above").alias("others")), "y")
    return both.select("x", "y", F.explode(F.array_intersect("zs", "others")).alias("z"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles of every node."""
    edges = written(edges.select(*ENDS).distinct(), "edges")  # made once, not for each of its uses
    per = _triangle_list(edges).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    return nodes(edges).join(per, "node", "left").fillna(0, ["triangles"])


def local_clustering(edges: DataFrame) -> DataFrame:
    """node, lcc: 2 * triangles / (degree * (degree - 1)); 0 where the degree is under 2."""
    edges = written(edges.select(*ENDS).distinct(), "edges")
    degree = directed(simple(edges), "both").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    d = F.col("d")
    lcc = F.when(d >= 2, 2.0 * F.col("triangles") / (d * (d - 1))).otherwise(F.lit(0.0))
    return triangles(edges).join(degree, "node", "left").select("node", lcc.alias("lcc"))


def degrees(edges: DataFrame, direction: str = "both") -> DataFrame:
    """node, degree, centrality (degree / (nodes - 1)), repeated edges counted."""
    all_nodes = nodes(edges)
    d = directed(edges.select(*ENDS), direction).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    n = all_nodes.count()
    return all_nodes.join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")).withColumn("centrality", F.col("degree") / max(1, n - 1))


def k_core(edges: DataFrame) -> DataFrame:
    """node, core: peels nodes of degree under k for k = 1, 2, ..; edges shrink as k rises."""
    e = written(directed(simple(edges), "both"), "core")
    done, k, i = [], 1, 0
    while not e.isEmpty():
        d = e.groupBy("src").agg(F.count("*").alias("d"))
        low = written(d.filter(F.col("d") <= k).select(F.col("src").alias("node"), F.lit(k).alias("core")), f"peel{i}")
        if low.isEmpty():
            k = d.agg(F.min("d")).first()[0]
            continue
        done.append(low)
        gone = low.select("node")
        left = written(e.join(gone, e["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti"), f"core{i}")
        # nodes that lost all their edges to peeled ones are of this core too
        alone = e.select("src").distinct().join(gone, F.col("src") == F.col("node"), "left_anti").join(left.select(F.col("src").alias("s")).distinct(), F.col("src") == F.col("s"), "left_anti")
        done.append(written(alone.select(F.col("src").alias("node"), F.lit(k).alias("core")), f"alone{i}"))
        e, i = left, i + 1
    out = nodes(edges)
    found = None
    for x in done:
        found = x if found is None else found.unionByName(x)
    if found is None:
        return out.withColumn("core", F.lit(0))
    return out.join(found, "node", "left").select("node", F.coalesce("core", F.lit(0)).alias("core"))


# Centralities over shortest paths from all nodes, or from a sample of sources


def path_counts(edges: DataFrame, sources: DataFrame, direction: str = "both") -> DataFrame:
    """source, node, depth, paths: how far each node is from each of sources(node) and over how
    many shortest paths.  State is sources times nodes: give a sample for large graphs."""
    e = written(directed(edges.select(*ENDS), direction).filter("src <> dst").distinct(), "edges")
    level = written(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")).distinct(), "level0")
    parts = [level]
    for depth in itertools.count(1):
        # without direction a step leads to the level before, the same or a new one
        known = parts[-2:] if direction == "both" else parts
        step = level.join(e, level["node"] == e["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        step = step.join(_all(known).select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(depth).alias("depth"), "paths")
        level = written(step, f"level{depth}")
        if level.isEmpty():
            break
        parts.append(level)
        if len(parts) > 2 * MERGED:  # a long walk's levels become fewer tables; the last two stay
            parts = [written(_all(parts[:-2]), f"seen{depth}"), *parts[-2:]]
    return _all(parts)


def _sized(edges: DataFrame, sources: DataFrame | None, direction: str = "both") -> tuple[list, list]:
    """(edges, sources, components) whose components fit a task, and (edges, sources) of the others; a list is empty
    if there is none."""
    e = written(directed(edges.select(*ENDS), direction).filter("src <> dst").distinct(), "edges")
    of = written(components(edges), "components")
    own = of.select("node") if sources is None else sources.select("node").distinct()
    sizes = e.join(of.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("m"))
    large = written(sizes.filter(F.col("m") > allpairs.LOCAL).select("component"), "large")
    if large.isEmpty():
        return [e, own, of], []
    inside = written(of.join(large, "component", "left_semi").select("node"), "inside")
    few = of.join(large, "component", "left_anti")
    at = lambda how: (e.join(inside, F.col("src") == F.col("node"), how), own.join(inside, "node", how))
    return [*at("left_anti"), few], list(at("left_semi"))


def _distances(edges: DataFrame, sources: DataFrame | None, direction: str = "both") -> DataFrame:
    """source, reached (nodes, itself too), total (of distances), harmonic (sum of 1 / distance), far."""
    small, large = _sized(edges, sources, direction)
    kind = edges.schema["src"].dataType.simpleString()
    out = allpairs.swept(*small, f"source {kind}, reached long, total long, harmonic double, far int", False)
    if large:
        d = F.col("depth")
        own = path_counts(large[0], large[1], "out" if direction != "both" else direction)
        out = out.unionByName(own.groupBy("source").agg(F.count("*").alias("reached"), F.sum("depth").alias("total"), F.coalesce(F.sum(F.when(d > 0, 1.0 / d)), F.lit(0.0)).alias("harmonic"), F.max("depth").alias("far")))
    return out


def closeness(edges: DataFrame, sources: DataFrame | None = None, direction: str = "both") -> DataFrame:
    """node, closeness ((reached - 1) / sum of distances, 0 if none) and harmonic (sum of
    1 / distance)."""
    near = F.coalesce(F.try_divide((F.col("reached") - 1).cast("double"), F.col("total")), F.lit(0.0))
    return _distances(edges, sources, direction).select(F.col("source").alias("node"), near.alias("closeness"), "harmonic")


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, betweenness of undirected edges: dependencies are summed backwards, level by level,
    from all sources at once; each pair of ends counts once.  With a sample of sources the
    sums are those of the sample."""
    small, large = _sized(edges, sources)
    kind = edges.schema["src"].dataType.simpleString()
    sums = allpairs.swept(*small, f"node {kind}, got double", True)
    if large:
        sums = sums.unionByName(_shares(*large))
    sums = sums.groupBy("node").agg((F.sum("got") / 2).alias("betweenness"))
    return nodes(edges).join(sums, "node", "left").fillna(0.0, ["betweenness"])


def _shares(e: DataFrame, sources: DataFrame) -> DataFrame:
    """node, got of components beyond a task: level by level, from all sources at once."""
    p = written(path_counts(e, sources), "paths")
    deepest = p.agg(F.max("depth")).first()[0] or 0
    below, done = None, [p.filter("depth < 0").select("node", F.lit(0.0).alias("got"))]
    for depth in range(deepest, 0, -1):
        at = p.filter(F.col("depth") == depth)
        if below is not None:
            at = at.join(below, ["source", "node"], "left")
        else:
            at = at.withColumn("got", F.lit(0.0))
        at = written(at.select("source", "node", "paths", F.coalesce("got", F.lit(0.0)).alias("got")), f"back{depth}")
        done.append(at.groupBy("node").agg(F.sum("got").alias("got")))
        if len(done) > MERGED:
            done = [written(_all(done), f"sums{depth}")]
        up = p.filter(F.col("depth") == depth - 1).select(F.col("source").alias("s"), F.col("node").alias("parent"), F.col("paths").alias("up"))
        pairs = at.join(e, at["node"] == e["src"]).join(up, (F.col("source") == F.col("s")) & (F.col("dst") == F.col("parent")))
        below = pairs.groupBy("source", F.col("parent").alias("node")).agg(F.sum(F.col("up") / F.col("paths") * (1 + F.col("got"))).alias("got"))
    return _all(done)


def diameter(edges: DataFrame, exact: bool = False) -> DataFrame:
    """diameter and radius of the graph as undirected: exact from all nodes, or a lower bound
    by a double sweep from the least node."""
    if exact:
        return _distances(edges, None).agg(F.max("far").alias("diameter"), F.min("far").alias("radius"))
    e = written(directed(edges.select(*ENDS), "both").distinct(), "edges")
    seed = e.agg(F.min("src").alias("node"))
    far = written(_walked(e, seed), "sweep")
    end = far.agg(F.max_by("node", F.struct("depth", "node")).alias("node"))
    return _walked(e, end).agg(F.max("depth").alias("diameter"), F.ceil(F.max("depth") / 2).cast("int").alias("radius"))


def louvain(edges: DataFrame, resolution: float = 1.0, levels: int = 10, rounds: int = 10) -> DataFrame:
    """node, community by greedy modularity: in a round, nodes move to the neighbouring
    community of the greatest gain, to smaller ids in even rounds and to larger in odd ones
    (so that no two nodes swap); communities then become the nodes of the next level."""
    e = directed(simple(edges), "both").withColumn("weight", F.lit(1.0))
    e = written(e, "weighted")
    total = e.agg(F.sum("weight")).first()[0] or 0.0
    member = written(nodes(edges).withColumn("community", F.col("node")), "member")
    for level in range(levels if total else 0):
        degree = written(e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "degree")
        state, any_moved = written(degree.withColumn("community", F.col("node")), "state"), False
        for r in range(rounds):
            sizes = state.groupBy("community").agg(F.sum("k").alias("tot"))
            to = e.filter("src <> dst").join(state.select(F.col("node").alias("dst"), F.col("community").alias("other")), "dst").groupBy(F.col("src").alias("node"), "other").agg(F.sum("weight").alias("w"))
            own = state.join(to, ["node"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
            own = own.join(sizes.withColumnsRenamed({"community": "other", "tot": "tot_other"}), "other", "left")
            same = F.col("other") == F.col("community")
            gain = F.col("w") - resolution * F.col("k") * (F.col("tot_other") - F.when(same, F.col("k")).otherwise(0.0)) / total
            stay = F.max(F.when(same, gain)).alias("stay")
            best = F.min(F.when(~same, F.struct((-gain).alias("loss"), F.col("other").alias("c")))).alias("best")
            lone = sizes.withColumnsRenamed({"tot": "tot_own"})
            picked = own.groupBy("node", "k", "community").agg(stay, best).join(lone, "community")
            stay_gain = F.coalesce("stay", -resolution * F.col("k") * (F.col("tot_own") - F.col("k")) / total)
            new = F.col("best.c")
            way = new < F.col("community") if r % 2 == 0 else new > F.col("community")
            moves = way & (-F.col("best.loss") > stay_gain + 1e-12)
            state = written(picked.select("node", "k", F.when(moves, new).otherwise(F.col("community")).alias("community"), F.coalesce(moves, F.lit(False)).alias("moved")), f"louvain{level}_{r}")
            moved = not state.filter("moved").isEmpty()
            state = state.drop("moved")
            any_moved = any_moved or moved
            if not moved and r % 2 == 1:
                break
        if not any_moved:
            break
        to = state.select(F.col("node").alias("community"), F.col("community").alias("next"))
        member = written(member.join(to, "community", "left").select("node", F.coalesce("next", "community").alias("community")), f"member{level}")
        rename = lambda c: state.select(F.col("node").alias(c), F.col("community").alias(f"c_{c}"))
        e = written(e.join(rename("src"), "src").join(rename("dst"), "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("weight").alias("weight")), f"folded{level}")
    return member


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    e = directed(simple(edges), "both")
    c = communities.select("node", "community")
    total = e.count()
    inside = e.join(c.withColumnsRenamed({"node": "src", "community": "a"}), "src").join(c.withColumnsRenamed({"node": "dst", "community": "b"}), "dst")
    per = inside.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("inner"), F.count("*").alias("tot"))
    return per.agg(F.sum(F.col("inner") / total - F.pow(F.col("tot") / total, F.lit(2.0))).alias("modularity"))


def graph_rag(vector_hits: DataFrame, edges: DataFrame, hops: int, k: int, vector_k: float = 60.0, graph_k: float = 10.0, text_hits: DataFrame | None = None, text_k: float = 60.0) -> DataFrame:
    """Fusion of a vector result (id, s), the graph around it and maybe a text result: 1 / (k +
    rank + 1) summed, graph ranks by hops and then id, over all nodes that are reached."""
    reached = bfs(edges, vector_hits.select(F.col("id").alias("node")), hops, "both").select(F.col("node").alias("id"), (-F.col("depth")).cast("double").alias("s"))
    lists, consts = [vector_hits.select("id", "s"), reached], [vector_k, graph_k]
    if text_hits is not None:
        lists, consts = [*lists, text_hits.select("id", "s")], [*consts, text_k]
    return rrf(lists, "id", "s", k, consts=consts).select("id", F.col("rrf").alias("score"))
