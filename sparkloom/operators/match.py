"""MATCH: graph patterns compiled to joins.

    MATCH (a:Part)-[e:next*1..2]->(b), (b)<-[:knows]-(c)
    OPTIONAL MATCH (c)-[:likes]->(d)
    WHERE a.id = 3 AND c.id <> a.id AND NOT EXISTS { MATCH (a)-[:knows]->(c) }
    RETURN DISTINCT a, c.name AS name, count(*) AS n ORDER BY n DESC LIMIT 5

Each edge of a pattern is one equi-join of the edge table with what is bound so far, so
Catalyst orders, prunes and shuffles them as any other joins.  Edges: (src, dst, label);
nodes, if given: (id, label, ..).

Hops: * is one, *n exactly n, *m..n from m to n, *m.. from m to MOST_HOPS, *..n from 1.  Such
steps walk from the end that is bound before or whose id the WHERE clause gives, a level at
a time; where neither end is known, from all nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.shared import written

#: What a range of hops without an upper end goes to.
MOST_HOPS = 10

_NODE = re.compile(r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*\)")
_EDGE = re.compile(r"(<?)-\s*(?:\[\s*(\w*)\s*(?::\s*(\w+))?\s*(\*\s*(\d+)?\s*(?:\.\.\s*(\d+)?)?)?\s*\]\s*)?-(>?)")
_CLAUSE = re.compile(r"\b(OPTIONAL\s+MATCH|MATCH|WHERE|RETURN|ORDER\s+BY|LIMIT)\b", re.I)


@dataclass
class Step:
    left: tuple[str, str | None]
    right: tuple[str, str | None]
    edge: str
    label: str | None
    way: str
    low: int = 1
    high: int = 1


def _clauses(text: str) -> list[tuple[str, str]]:
    """Clauses in order; those inside braces stay with their clause."""
    depth, cuts = 0, []
    marks = {m.start(): m for m in _CLAUSE.finditer(text)}
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if i in marks and depth == 0:
            cuts.append(marks[i])
    # an OPTIONAL MATCH holds a MATCH: keep the outer one
    cuts = [m for k, m in enumerate(cuts) if not (k and m.start() < cuts[k - 1].end())]
    return [(re.sub(r"\s+", " ", m[1].upper()), text[m.end() : n.start() if n else len(text)].strip()) for m, n in zip(cuts, [*cuts[1:], None], strict=True)]


def parse_patterns(text: str) -> list[Step]:
    out, at, anonymous = [], 0, 0

    def node() -> tuple[str, str | None]:
        nonlocal at, anonymous
        m = _NODE.match(text, at)
        if not m:
            raise ValueError(f"a node is expected at {text[at : at + 20]!r}")
        at = m.end()
        if not m[1]:
            anonymous += 1
        return m[1] or f"_n{anonymous}", m[2]

    while at < len(text):
        left = node()
        alone = True
        while m := _EDGE.match(text, at + len(text[at:]) - len(text[at:].lstrip())):
            at = m.end()
            at += len(text[at:]) - len(text[at:].lstrip())
            right = node()
            if m[1] and m[7]:
                raise ValueError("an edge has one direction at most")
            anonymous += 1
            low, high = 1, 1
            if m[4]:
                low = int(m[5] or 1)
                high = int(m[6]) if m[6] else MOST_HOPS if ".." in m[4] else low
                if low > high:
                    raise ValueError(f"at least {low} hops and at most {high}")
            out.append(Step(left, right, m[2] or f"_e{anonymous}", m[3], "in" if m[1] else "out" if m[7] else "both", low, high))
            left, alone = right, False
        if alone:
            out.append(Step(left, left, "", None, "none"))
        rest = text[at:].lstrip()
        at = len(text) - len(rest)
        if rest.startswith(","):
            at += 1
            at += len(text[at:]) - len(text[at:].lstrip())
        elif rest:
            raise ValueError(f"unexpected {rest[:20]!r}")
    return out


class Matcher:
    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None) -> None:
        self.edges, self.nodes = edges, nodes
        self.known: dict[str, str] = {}  # nodes whose id the WHERE clauses give

    def _all_nodes(self, label: str | None) -> DataFrame:
        if self.nodes is None:
            if label is not None:
                raise ValueError("node labels need a node table")
            return graph.nodes(self.edges)
        n = self.nodes if label is None else self.nodes.filter(F.col("label") == label)
        return n.select(F.col("id").alias("node")).distinct()

    def _starts(self, bound: DataFrame | None, name: str) -> DataFrame | None:
        """The nodes, as _s, that a step from this one can start from, if something says so."""
        if bound is not None and name in bound.columns:
            return bound.select(F.col(name).alias("_s")).distinct()
        if name in self.known:
            kind = self.edges.schema["src"].dataType
            return self.edges.sparkSession.range(1).select(F.expr(self.known[name]).cast(kind).alias("_s"))
        return None

    def _hop(self, step: Step, bound: DataFrame | None = None) -> DataFrame:
        """(_s, _d[, edge label]) pairs that the step joins."""
        e = self.edges if step.label is None else self.edges.filter(F.col("label") == step.label)
        e = graph.directed(e.select("src", "dst", "label"), step.way)
        if (step.low, step.high) == (1, 1):
            return e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("label").alias(step.edge))
        # m..n hops: pairs by length, each pair once, from the end that is known; a level is a table
        one = e.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
        starts, turned = self._starts(bound, step.left[0]), False
        if starts is None and (ends := self._starts(bound, step.right[0])) is not None:
            starts, turned, one = ends, True, one.select(F.col("_d").alias("_s"), F.col("_s").alias("_d"))
        found = []
        if step.low == 0:
            zero = self._all_nodes(None).select(F.col("node").alias("_s"))
            zero = zero if starts is None else zero.join(starts, "_s", "left_semi")
            found.append(zero.select("_s", F.col("_s").alias("_d")))
        now = written(one if starts is None else one.join(starts, "_s", "left_semi"), "hop1") if step.high else None
        for k in range(1, step.high + 1):
            if k > 1:
                now = now.withColumnRenamed("_d", "_m").join(one.withColumnRenamed("_s", "_m"), "_m").select("_s", "_d").distinct()
                now = written(now, f"hop{k}")
            if k >= step.low:
                found.append(now)
        out = reduce(DataFrame.unionByName, found).distinct()
        out = out.select(F.col("_d").alias("_s"), F.col("_s").alias("_d")) if turned else out
        return out.withColumn(step.edge, F.lit(None).cast("string"))

    def _labelled(self, df: DataFrame, name: str, label: str | None) -> DataFrame:
        if label is None:
            return df
        own = self._all_nodes(label)
        return df.join(own, df[name] == own["node"], "left_semi")

    def _match(self, bound: DataFrame | None, steps: list[Step]) -> DataFrame:
        for s in steps:
            (a, la), (b, lb) = s.left, s.right
            if s.way == "none":
                own = self._all_nodes(la).select(F.col("node").alias(a))
                bound = own if bound is None else bound.join(own, a, "left_semi") if a in bound.columns else bound.crossJoin(own)
                continue
            hop = self._hop(s, bound)
            if a == b:
                hop = hop.filter("_s = _d")
            if bound is None:
                bound = hop.select(F.col("_s").alias(a), *([F.col("_d").alias(b)] if a != b else []), s.edge)
            else:
                on, new = [], [s.edge]
                for end, name in (("_s", a), ("_d", b)):
                    if name in bound.columns:
                        on.append(bound[name] == hop[end])
                    elif name not in [n for n in new if isinstance(n, str)]:
                        new.append(F.col(end).alias(name))
                if not on:
                    raise ValueError(f"({a}) and ({b}) meet nothing that is bound before")
                cond = on[0] if len(on) == 1 else on[0] & on[1]
                bound = bound.join(hop, cond).select(*[bound[c] for c in bound.columns], *new)
            bound = self._labelled(self._labelled(bound, a, la), b, lb)
        return bound

    def _optional(self, bound: DataFrame, steps: list[Step]) -> DataFrame:
        keys = [n for n in dict.fromkeys(x for s in steps for x in (s.left[0], s.right[0])) if n in bound.columns]
        if not keys:
            raise ValueError("OPTIONAL MATCH starts from something bound")
        inner = self._match(None, steps) if len(steps) == 1 or keys else None
        more = [c for c in inner.columns if c not in bound.columns]
        return bound.join(inner.select(*keys, *more).distinct(), keys, "left")

    def _exists(self, bound: DataFrame, steps: list[Step], wanted: bool) -> DataFrame:
        inner = self._match(None, steps)
        keys = [c for c in inner.columns if c in bound.columns and not c.startswith("_e")]
        return bound.join(inner.select(*keys).distinct(), keys, "left_semi" if wanted else "left_anti")

    def _with_fields(self, df: DataFrame, text: str) -> tuple[DataFrame, str]:
        """Joins the node columns that text names as v.column; v.id is v itself."""
        fields: dict[str, set[str]] = {}
        for v, c in re.findall(r"\b(\w+)\.(\w+)\b", text):
            if v in df.columns and c != "id":
                fields.setdefault(v, set()).add(c)
        for v, cols in fields.items():
            cols = {c for c in cols if f"{v}_{c}" not in df.columns}
            if cols:
                own = self.nodes.select(F.col("id").alias("_id"), *(F.col(c).alias(f"{v}_{c}") for c in sorted(cols)))
                df = df.join(own, df[v] == own["_id"], "left").drop("_id")
        text = re.sub(r"\b(\w+)\.id\b", lambda m: m[1] if m[1] in df.columns else m[0], text)
        return df, re.sub(r"\b(\w+)\.(\w+)\b", lambda m: f"{m[1]}_{m[2]}" if m[1] in df.columns else m[0], text)

    def run(self, text: str) -> DataFrame:
        df, out, order, limit = None, None, None, None
        clauses = _clauses(text)
        for kind, body in clauses:
            if kind == "WHERE" and not re.search(r"\b(OR|NOT|CASE|EXISTS)\b", body, re.I):
                self.known |= {m[1]: m[2] for m in re.finditer(r"(?:^|\bAND\b)\s*(\w+)\.id\s*=\s*('[^']*'|-?\d+)\s*(?=\bAND\b|$)", body, re.I)}
        for kind, body in clauses:
            if kind == "MATCH":
                df = self._match(df, parse_patterns(body))
            elif kind == "OPTIONAL MATCH":
                df = self._optional(df, parse_patterns(body))
            elif kind == "WHERE":
                for m in re.finditer(r"\b(NOT\s+)?EXISTS\s*\{\s*MATCH\s+([^}]*)\}", body, re.I):
                    df = self._exists(df, parse_patterns(m[2].strip()), m[1] is None)
                body = re.sub(r"\b(?:NOT\s+)?EXISTS\s*\{[^}]*\}", "true", body, flags=re.I)
                df, body = self._with_fields(df, body)
                df = df.filter(F.expr(body))
            elif kind == "RETURN":
                out = body
            elif kind == "ORDER BY":
                order = body
            elif kind == "LIMIT":
                limit = int(body)
        if df is None or out is None:
            raise ValueError("a query has MATCH and RETURN")
        return self._returned(df, out, order, limit)

    def _returned(self, df: DataFrame, out: str, order: str | None, limit: int | None) -> DataFrame:
        distinct = re.match(r"DISTINCT\b", out, re.I)
        out = out[distinct.end() :] if distinct else out
        items = []
        for item in re.split(r",(?![^()]*\))", out):
            m = re.fullmatch(r"\s*(.+?)(?:\s+AS\s+(\w+))?\s*", item, re.I | re.S)
            name = m[2] or re.sub(r"\W+", "_", m[1]).strip("_")
            df, expr = self._with_fields(df, m[1])
            items.append((expr, name, re.match(r"(count|sum|avg|min|max|collect_list|collect_set)\s*\(", expr, re.I) is not None))
        cols: list[Column] = [F.expr(e).alias(n) for e, n, _ in items]
        if any(a for *_, a in items):
            keys = [c for c, (*_, a) in zip(cols, items, strict=True) if not a]
            aggs = [c for c, (*_, a) in zip(cols, items, strict=True) if a]
            df = df.groupBy(*keys).agg(*aggs).select(*(n for _, n, _ in items))
        else:
            df = df.select(*cols)
        df = df.distinct() if distinct else df
        if order:
            keys = []
            for item in order.split(","):
                m = re.fullmatch(r"\s*([\w.]+)(?:\s+(ASC|DESC))?\s*", item, re.I)
                c = re.sub(r"\W+", "_", m[1])
                c = c[:-3] if c.endswith("_id") and c not in df.columns else c
                keys.append(F.desc(c) if (m[2] or "").upper() == "DESC" else F.asc(c))
            df = df.orderBy(*keys)
        return df if limit is None else df.limit(limit)


def match(edges: DataFrame, text: str, nodes: DataFrame | None = None) -> DataFrame:
    return Matcher(edges, nodes).run(text)
