"""A database of named collections with one statement interface.

``execute`` takes Spark SQL with the extensions of ``plans.sql``, table functions (ARRAY_SLICE, TOPK,
FACET_COUNTS, ..), and statements that Spark has no form for: GRAPH, MATCH, SEARCH, COPY, UPSERT,
MERGE and other changes to collections, transactions, triggers and schedules.  A change makes a new
image of the collection, written to the shared folder; readers that hold the old DataFrame keep
the old image."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.catalog import NAMES
from sparkloom.operators import dml, graph, keyvalue, relational, search, timeseries, vector
from sparkloom.operators.match import match
from sparkloom.operators.ndarray import Array
from sparkloom.plans import sql
from sparkloom.shared import written
from sparkloom.sources import files
from sparkloom.streaming import schedule


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts between separators that stand outside quotes and brackets."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == sep and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    out.append(text[start:].strip())
    return [x for x in out if x]


def literal(text: str):
    """A quoted text, number, NULL or ARRAY[..] as a Python value."""
    text = text.strip()
    if text[:1] in "'\"":
        return text[1:-1].replace("''", "'")
    if m := re.fullmatch(r"(?:ARRAY)?\s*\[(.*)\]", text, re.I | re.S):
        return [literal(x) for x in split_top(m[1])]
    if text.upper() == "NULL":
        return None
    if text.upper() in ("TRUE", "FALSE"):
        return text.upper() == "TRUE"
    return float(text) if re.search(r"[.eE]", text) else int(text)


def _balanced(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                return i + 1
    raise ValueError("a bracket is not closed")


@dataclass
class Trigger:
    name: str
    when: str
    events: tuple[str, ...]
    table: str
    each_row: bool
    condition: str | None
    mode: str
    body: str


#: What a transaction takes back: images don't change, so their names are enough.
_STATE = ("tables", "keys", "arrays", "indexes", "views", "trees", "triggers", "mirrors", "schedules", "centroids", "unique")


@dataclass
class Database:
    spark: SparkSession
    folder: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)
    arrays: dict[str, Array] = field(default_factory=dict)
    indexes: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    trees: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    mirrors: dict[str, str] = field(default_factory=dict)
    schedules: dict[str, tuple[str, str]] = field(default_factory=dict)
    centroids: dict[str, tuple] = field(default_factory=dict)
    unique: dict[str, list[str]] = field(default_factory=dict)
    #: Trigger runs that wait for the end of the transaction, or for RUN TRIGGERS.
    deferred: list[tuple[Trigger, DataFrame]] = field(default_factory=list)
    waiting: list[tuple[Trigger, DataFrame]] = field(default_factory=list)
    _saved: list[tuple[str | None, dict]] = field(default_factory=list)
    _depth: int = 0
    _n: int = 0

    # Collections

    def table(self, name: str) -> DataFrame:
        name = self.mirrors.get(name, name)
        if name in self.tables:
            return self.tables[name]
        if self.folder is not None and name in NAMES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise ValueError(f"no such collection: {name}")

    def put(self, name: str, df: DataFrame, key: list[str] | None = None, keep: bool = True) -> DataFrame:
        """Makes df the collection's image; keep: written to the shared folder."""
        self.tables[name] = written(df, name) if keep else df
        if key is not None:
            self.keys[name] = key
        return self.tables[name]

    def _view(self, df: DataFrame) -> str:
        self._n += 1
        name = f"_t{id(self) % 10**6}_{self._n}"
        df.createOrReplaceTempView(name)
        return name

    def _key(self, name: str) -> list[str]:
        if not self.keys.get(name):
            raise ValueError(f"{name} has no primary key")
        return self.keys[name]

    # Statements

    def execute(self, text: str, *args) -> DataFrame:
        text = text.strip().rstrip(";").strip()
        named = {f"p{i}": a for i, a in enumerate(args, 1)}
        if args:
            text = re.sub(r"\$(\d+)", r":p\1", text)
        for rx, handler in _STATEMENTS:
            if m := rx.match(text):
                return handler(self, m, text)
        return self.select(text, named)

    def select(self, text: str, args: dict | None = None) -> DataFrame:
        text = self._functions(text)
        text = sql.rewrite(text)
        words = set(re.findall(r"\w+", text))
        for name in words & (set(self.tables) | set(self.mirrors) | (set(NAMES) if self.folder else set())):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def _functions(self, text: str) -> str:
        """Table functions become views."""
        while m := _TABLE_FUNCTION.search(text):
            end = _balanced(text, m.end() - 1)
            args = split_top(text[m.end() : end - 1])
            tail = re.match(r"\s+AS\s+OF\s+SYSTEM\s+TIME\s+(\d+)", text[end:], re.I)
            df = getattr(self, f"_fn_{m[1].lower()}")(args, int(tail[1]) if tail else None)
            text = text[: m.start()] + self._view(df) + text[end + (tail.end() if tail else 0) :]
        return text

    def _array(self, name: str, as_of: int | None) -> Array:
        a = self.arrays[literal(name)]
        return a if as_of is None else a.as_of("_ts_system", as_of)

    def _fn_array_slice(self, args: list[str], as_of: int | None) -> DataFrame:
        bounds = {}
        box = args[1].strip().strip("'").strip()
        for d, lo, hi, close in re.findall(r"\"?(\w+)\"?\s*:\s*[\[(]\s*(-?\d+|null)\s*,\s*(-?\d+|null)\s*([\])])", box):
            bounds[d] = (None if lo == "null" else int(lo), None if hi == "null" else int(hi) - (close == ")"))
        attrs = literal(args[2]) if len(args) > 2 else "*"
        limit = int(args[3]) if len(args) > 3 else None
        return self._array(args[0], as_of).slice(bounds, None if attrs == "*" else attrs, limit).cells

    def _fn_array_project(self, args: list[str], as_of: int | None) -> DataFrame:
        return self._array(args[0], as_of).project(literal(args[1])).cells

    def _fn_array_agg(self, args: list[str], as_of: int | None) -> DataFrame:
        return self._array(args[0], as_of).agg(literal(args[1]), literal(args[2]), literal(args[3]) if len(args) > 3 else None)

    def _fn_array_elementwise(self, args: list[str], as_of: int | None) -> DataFrame:
        return self._array(args[0], as_of).elementwise(self._array(args[1], as_of), literal(args[2]), literal(args[3])).cells

    def _fn_topk(self, args: list[str], _) -> DataFrame:
        table, score, key = self.indexes[args[0]]
        return keyvalue.ranked(keyvalue.top(self.table(table), score, key, int(args[1])), score, key).select("rank", key, score)

    def _fn_range(self, args: list[str], _) -> DataFrame:
        table, score, key = self.indexes[args[0]]
        return keyvalue.score_range(self.table(table), score, literal(args[1]), literal(args[2])).select(key, score)

    def _fn_facet_counts(self, args: list[str], _) -> DataFrame:
        df = self.table(args[0].strip("'"))
        where = literal(args[1]) if args[1].strip()[:1] in "'\"" else None
        fields = [f.strip("'\" ") for f in (literal(args[2]) if args[2].strip()[:1] in "[A" else [args[2]])]
        return relational.facet_counts(df.filter(F.expr(where)) if where else df, fields, int(args[3]) if len(args) > 3 else 1000)

    def _fn_weighted_pick(self, args: list[str], _) -> DataFrame:
        seed = next((int(a.split("=>")[-1]) for a in args[3:] if re.search(r"\d+$", a)), 0)
        return relational.weighted_pick(self.table(args[0].strip("'")), args[1].strip("'"), int(args[2]), seed=seed)

    # Graph

    def _edges(self, name: str | None = None) -> DataFrame:
        return self.table(name or "edges")

    def _graph_algo(self, m: re.Match, _: str) -> DataFrame:
        name, on, rest = m[1].upper(), m[2], m[3]
        opt = {k.upper(): v for k, v in re.findall(r"(\w+)\s+('[^']*'|[\w.+-]+)", rest)}
        e = self._edges(on).select(*(c for c in ("src", "dst", "label", "weight") if c in self._edges(on).columns))
        sources = graph.nodes(e).orderBy(F.xxhash64("node")).limit(int(opt["SAMPLE"])) if "SAMPLE" in opt else None
        n = int(opt.get("ITERATIONS", 0))
        if name in ("PAGERANK", "PPR"):
            return graph.pagerank(e, float(opt.get("DAMPING", 0.85)), n or 20, float(opt.get("TOLERANCE", 1e-7)), self.spark.createDataFrame([(literal(opt["FROM"]),)], ["node"]) if "FROM" in opt else None)
        if name == "SSSP":
            return graph.sssp(e if "weight" in e.columns else e.withColumn("weight", F.lit(1.0)), literal(opt["FROM"]))
        if name == "TRIANGLES" and opt.get("MODE", "").lower() == "global":
            return graph.triangles(e).agg((F.sum("triangles") / 3).cast("long").alias("triangles"))
        if name == "DIAMETER":
            return graph.diameter(e, exact="EXACT" in rest.upper())
        if name in ("LOUVAIN", "COMMUNITY"):
            return graph.louvain(e, float(opt.get("RESOLUTION", 1.0)), rounds=n or 10)
        if name in ("LABEL_PROPAGATION", "LPA"):
            return graph.label_propagation(e, n or 10)
        if name == "DEGREE":
            return graph.degrees(e, opt.get("DIRECTION", "both").lower())
        simple = {"WCC": graph.components, "LCC": graph.local_clustering, "TRIANGLES": graph.triangles, "KCORE": graph.k_core}
        if name in simple:
            return simple[name](e)
        if name in ("CLOSENESS", "HARMONIC"):
            return graph.closeness(e, sources).select("node", name.lower())
        if name == "BETWEENNESS":
            return graph.betweenness(e, sources)
        raise ValueError(f"no such graph algorithm: {name}")

    def _start(self, value) -> DataFrame:
        return self.spark.range(1).select(F.lit(value).cast(self._edges().schema["src"].dataType).alias("node"))

    def _options(self, rest: str) -> dict[str, str]:
        return {k.upper(): v.strip("'") for k, v in re.findall(r"(\w+)\s+('[^']*'|\w+)", rest)}

    def _labelled(self, opt: dict[str, str]) -> DataFrame:
        e = self._edges(opt.get("ON"))
        return e.filter(F.col("label") == opt["LABEL"]) if "LABEL" in opt else e

    def _graph_traverse(self, m: re.Match, _: str) -> DataFrame:
        opt = self._options(m[2])
        return graph.bfs(self._labelled(opt), self._start(literal(m[1])), int(opt.get("DEPTH", 2)), opt.get("DIRECTION", "out").lower())

    def _graph_path(self, m: re.Match, _: str) -> DataFrame:
        opt = self._options(m[3])
        return graph.shortest_path(self._labelled(opt), literal(m[1]), literal(m[2]), int(opt.get("MAX_DEPTH", 10)))

    def _graph_neighbors(self, m: re.Match, _: str) -> DataFrame:
        opt = self._options(m[2])
        return graph.neighbors(self._edges(opt.get("ON")), literal(m[1]), opt.get("LABEL"), opt.get("DIRECTION", "out").lower()).select("node")

    def _graph_insert(self, m: re.Match, _: str) -> DataFrame:
        name, row = m[1] or "edges", (literal(m[2]), literal(m[3]), m[4])
        if name not in self.tables:
            self.put(name, self.spark.createDataFrame([row], "src string, dst string, label string"), ["src", "dst", "label"])
            return self.table(name)
        e = self.table(name)
        new = self.spark.createDataFrame([row], e.select("src", "dst", "label").schema)
        return self.put(name, dml.insert_absent(e.select("src", "dst", "label"), new, ["src", "dst", "label"]))

    def _graph_delete(self, m: re.Match, _: str) -> DataFrame:
        name = m[1] or "edges"
        gone = (F.col("src") == literal(m[2])) & (F.col("dst") == literal(m[3])) & (F.col("label") == m[4])
        return self.put(name, dml.delete(self.table(name), gone))

    def _match(self, _: re.Match, text: str) -> DataFrame:
        return match(self._edges(), text, self.tables.get("nodes"))

    # Search

    def _search(self, m: re.Match, _: str) -> DataFrame:
        df, kind, args = self.table(m[1]), m[2].upper(), split_top(m[3])
        key = self.keys.get(m[1], [df.columns[0]])[0]
        if kind == "VECTOR":
            return vector.topk(df, args[0], literal(args[1]), int(args[2]), key)
        if kind == "TEXT":
            terms = re.findall(r"\w+", literal(args[1]).lower())
            return search.bm25(df, key, args[0], terms, int(args[2]))
        # FUSION(vector column, ARRAY[..], text column, 'query', k)
        k = int(args[4])
        v = vector.topk(df, args[0], literal(args[1]), 3 * k, key).select(F.col(key).alias("id"), (-F.col("distance")).alias("s"))
        x = search.bm25(df, key, args[2], re.findall(r"\w+", literal(args[3]).lower()), 3 * k).select(F.col(key).alias("id"), F.col("score").alias("s"))
        return search.rrf([v, x], "id", "s", k).withColumnRenamed("id", key)

    # Changes

    def _create(self, m: re.Match, _: str) -> DataFrame:
        cols, key = [], []
        for part in split_top(m[2]):
            if pk := re.match(r"PRIMARY\s+KEY\s*\((.*)\)", part, re.I):
                key += split_top(pk[1])
                continue
            c = re.match(r"(\w+)\s+([\w()<>, ]+?)(\s+PRIMARY\s+KEY|\s+TIME_KEY|\s+NOT\s+NULL)*$", part, re.I)
            if re.search(r"PRIMARY\s+KEY", part, re.I):
                key.append(c[1])
            cols.append(f"{c[1]} {c[2].strip().upper().replace('TEXT', 'STRING')}")
        return self.put(m[1], self.spark.createDataFrame([], ", ".join(cols)), key)

    def _create_array(self, m: re.Match, _: str) -> DataFrame:
        dims = {d: (int(a), int(b)) for d, a, b in re.findall(r"(\w+)\s+INT\w*\s*\[\s*(-?\d+)\s*\.\.\s*(-?\d+)\s*\]", m[2], re.I)}
        attrs = re.findall(r"(\w+)\s+(\w+)", m[3])
        kinds = {"FLOAT64": "double", "INT64": "long", "STRING": "string"}
        schema = ", ".join([*(f"{d} long" for d in dims), *(f"{a} {kinds.get(k.upper(), k)}" for a, k in attrs), "_ts_system long"])
        extents = {d: int(n) for d, n in re.findall(r"(\w+)\s+(\d+)", m[4] or "")}
        self.arrays[m[1]] = Array(self.spark.createDataFrame([], schema), dims, [a for a, _ in attrs], extents)
        return self.arrays[m[1]].cells

    def _alter_array(self, m: re.Match, _: str) -> DataFrame:
        """ADD ATTR name TYPE, DROP ATTR name, or TILE_EXTENTS (..)."""
        a, what = self.arrays[m[1]], m[2]
        if add := re.match(r"ADD\s+ATTR\s+(\w+)\s+(\w+)$", what, re.I):
            kind = {"FLOAT64": "double", "INT64": "long", "STRING": "string"}.get(add[2].upper(), add[2])
            new = a._with(a.cells.withColumn(add[1], F.lit(None).cast(kind)), [*a.attrs, add[1]])
        elif drop := re.match(r"DROP\s+ATTR\s+(\w+)$", what, re.I):
            new = a._with(a.cells.drop(drop[1]), [x for x in a.attrs if x != drop[1]])
        elif tiles := re.match(r"TILE_EXTENTS\s*\((.*)\)$", what, re.I):
            new = a.rechunk({d: int(n) for d, n in re.findall(r"(\w+)\s+(\d+)", tiles[1])})
        else:
            raise ValueError(f"an array can't {what}")
        self.arrays[m[1]] = new
        return new.cells

    def _insert(self, m: re.Match, _: str) -> DataFrame:
        upsert, name, cols, body = m[1].upper() == "UPSERT", m[2], m[3], m[4].strip()
        body, returning = self._returning(body)
        conflict = re.search(r"\bON\s+CONFLICT\s*(?:\(([^)]*)\))?\s*DO\s+(NOTHING|UPDATE\s+SET\s+(.*))$", body, re.I | re.S)
        if conflict:
            body = body[: conflict.start()].strip()
        table = self.table(name)
        names = split_top(cols) if cols else table.columns
        if body[:1] in "{[":
            rows = files.from_objects(self.spark, body, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema))
        elif v := re.match(r"VALUES\s*(.*)$", body, re.I | re.S):
            rows = self.spark.sql(f"SELECT * FROM VALUES {v[1]} AS v({', '.join(names)})")
        else:
            rows = self.select(body)
            rows = rows.toDF(*names[: len(rows.columns)])
        rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema))
        key = split_top(conflict[1]) if conflict and conflict[1] else self.keys.get(name)
        if upsert:
            new = dml.upsert(table, rows, self._key(name))
        elif conflict and conflict[2].upper() == "NOTHING":
            new = dml.insert_absent(table, rows, key)
        elif conflict:
            sets = dict(re.split(r"\s*=\s*", s, maxsplit=1) for s in split_top(conflict[3]))
            alias = lambda e: re.sub(rf"\b{re.escape(name)}\.", "t.", re.sub(r"\bexcluded\.", "excluded.", e, flags=re.I))
            new = dml.upsert(table, rows, key, update={c: F.expr(alias(e)) for c, e in sets.items()})
        else:
            new = dml.insert_strict(table, rows, key) if key else table.unionByName(rows)
        new = self.commit(name, new)
        return self._returned(new.join(rows.select(*key), key, "left_semi") if key else rows, returning)

    def _returning(self, body: str) -> tuple[str, str | None]:
        m = re.search(r"\bRETURNING\s+(.*)$", body, re.I | re.S)
        return (body[: m.start()].strip(), m[1]) if m else (body, None)

    def _returned(self, rows: DataFrame, returning: str | None) -> DataFrame:
        if returning is None:
            return rows.agg(F.count("*").alias("count"))
        return rows if returning.strip() == "*" else rows.selectExpr(*split_top(returning))

    def _update(self, m: re.Match, _: str) -> DataFrame:
        name, body = m[1], m[2]
        body, returning = self._returning(body)
        w = re.search(r"\bWHERE\b(.*)$", body, re.I | re.S)
        where = w[1].strip() if w else "true"
        body = body[: w.start()].strip() if w else body
        f = re.search(r"\bFROM\s+(\w+)(?:\s+(?:AS\s+)?(\w+))?\s*$", body, re.I)
        body = body[: f.start()].strip() if f else body
        sets = dict(re.split(r"\s*=\s*", s, maxsplit=1) for s in split_top(body))
        table = self.table(name)
        if f is None:
            hit = F.expr(where)
            changed = table.filter(hit)
            values = {c: F.expr(e).cast(table.schema[c].dataType) for c, e in sets.items()}
            out = self._returned(dml.update(changed, values, F.lit(True)), returning)
            self.commit(name, dml.update(table, values, hit))
            return out
        source, alias = self.table(f[1]), f[2] or f[1]
        own = lambda e: re.sub(rf"\b{alias}\.", "s.", re.sub(rf"\b{name}\.", "t.", e))
        conds = re.split(r"\bAND\b", where, flags=re.I)
        pairs = [p for c in conds if (p := re.fullmatch(rf"\s*(?:{name}\.(\w+)\s*=\s*{alias}\.(\w+)|{alias}\.(\w+)\s*=\s*{name}\.(\w+))\s*", c))]
        if not pairs:
            raise ValueError("UPDATE .. FROM needs an equality between the tables")
        key = {p[1] or p[4]: p[2] or p[3] for p in pairs}
        rest = [c for c in conds if not any(p[0] == c for p in pairs)]
        keyed = source.withColumns({k: F.col(c) for k, c in key.items()})
        values = {c: F.expr(own(e)).cast(table.schema[c].dataType) for c, e in sets.items()}
        new = dml.update_from(table, keyed, list(key), values, F.expr(own(" AND ".join(rest))) if rest else None)
        changed = new.join(keyed.select(*key), list(key), "left_semi")
        self.commit(name, new)
        return self._returned(changed, returning)

    def _delete(self, m: re.Match, _: str) -> DataFrame:
        body, returning = self._returning(m[2] or "")
        where = F.expr(re.sub(r"^\s*WHERE\b", "", body, flags=re.I) or "true")
        gone = self._returned(self.table(m[1]).filter(where), returning)
        self.commit(m[1], dml.delete(self.table(m[1]), where))
        return gone

    def _truncate(self, m: re.Match, _: str) -> DataFrame:
        return self.put(m[1], self.table(m[1]).limit(0))

    def _merge(self, m: re.Match, _: str) -> DataFrame:
        name, t, s = m[1], m[2] or m[1], m[4]
        source = self.select(m[3][1:-1]) if m[3][0] == "(" else self.table(m[3])
        s = s or (m[3] if m[3][0] != "(" else "s")
        own = lambda e: re.sub(rf"\b{s}\.", "s.", re.sub(rf"\b{t}\.", "t.", e))
        on, *parts = re.split(r"\bWHEN\s+", m[5], flags=re.I)
        key = {}
        for c in re.split(r"\bAND\b", on, flags=re.I):
            p = re.fullmatch(r"\s*([ts])\.(\w+)\s*=\s*([ts])\.(\w+)\s*", own(c))
            key[p[2] if p[1] == "t" else p[4]] = p[4] if p[1] == "t" else p[2]
        source = source.withColumns({k: F.col(c) for k, c in key.items()})
        clauses = []
        for part in parts:
            p = re.match(r"(NOT\s+MATCHED\s+BY\s+SOURCE|NOT\s+MATCHED(?:\s+BY\s+TARGET)?|MATCHED)(?:\s+AND\s+(.*?))?\s+THEN\s+(.*)$", part.strip(), re.I | re.S)
            when = re.sub(r"\s+", " ", p[1].upper())
            when = {"MATCHED": "matched", "NOT MATCHED BY SOURCE": "not_by_source"}.get(when, "not_matched")
            cond, do = F.expr(own(p[2])) if p[2] else None, p[3].strip()
            if u := re.match(r"UPDATE\s+SET\s+(.*)$", do, re.I | re.S):
                sets = dict(re.split(r"\s*=\s*", x, maxsplit=1) for x in split_top(u[1]))
                clauses.append((when, cond, "update", {re.sub(r"^\w+\.", "", c): F.expr(own(e)) for c, e in sets.items()}))
            elif i := re.match(r"INSERT\s*\((.*?)\)\s*VALUES\s*\((.*)\)$", do, re.I | re.S):
                clauses.append((when, cond, "insert", {c: F.expr(own(e)) for c, e in zip(split_top(i[1]), split_top(i[2]), strict=True)}))
            else:
                clauses.append((when, cond, {"DELETE": "delete", "DO NOTHING": "nothing"}[re.sub(r"\s+", " ", do.upper())], None))
        before = self.table(name)
        new = dml.merge(before, source, list(key), clauses).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in before.schema))
        return dml.changes(before, self.commit(name, new), list(key)).agg(F.count("*").alias("count"))

    # Files, indexes, views

    def _copy_from(self, m: re.Match, _: str) -> DataFrame:
        opt = m[3].upper()
        sep = re.search(r"DELIMITER\s+'(.)'", m[3], re.I)
        t = self.table(m[1])
        rows = files.copy_from(self.spark, m[2], t.schema, delimiter=sep[1] if sep else None, header="HEADER FALSE" not in opt)
        self.put(m[1], dml.insert_strict(t, rows, self.keys[m[1]]) if self.keys.get(m[1]) else t.unionByName(rows))
        return rows.agg(F.count("*").alias("count"))

    def _copy_to(self, m: re.Match, _: str) -> DataFrame:
        df = self.select(m[1].strip()[1:-1]) if m[1].strip()[0] == "(" else self.table(m[1].strip())
        files.copy_to(df, m[2])
        return df.agg(F.count("*").alias("count"))

    def _sorted_index(self, m: re.Match, _: str) -> DataFrame:
        self.indexes[m[1]] = (m[2], m[3], m[4])
        return self.table(m[2])

    def _rank(self, m: re.Match, _: str) -> DataFrame:
        table, score, key = self.indexes[m[1]]
        return keyvalue.rank_of(self.table(table), score, key, literal(m[2]))

    def _sorted_count(self, m: re.Match, _: str) -> DataFrame:
        return self.table(self.indexes[m[1]][0]).agg(F.count("*").alias("count"))

    # Functions that are statements

    def _kv(self, m: re.Match, _: str) -> DataFrame:
        """KV_INCR, KV_DECR, KV_INCR_FLOAT, KV_CAS and KV_GETSET on a collection of (key, value)."""
        op, args = m[1].upper(), split_top(m[2])
        name, key, *rest = (literal(a.split("=>")[-1]) for a in args)
        if name not in self.tables:
            kind = {"KV_INCR": "long", "KV_DECR": "long", "KV_INCR_FLOAT": "double"}.get(op, "string")
            self.put(name, self.spark.createDataFrame([], f"key string, value {kind}"), ["key"])
        t = self.table(name)
        kind = t.schema["value"].dataType
        one = self.spark.range(1).select(F.lit(key).alias("key"))
        if op in ("KV_INCR", "KV_DECR", "KV_INCR_FLOAT"):
            by = -rest[0] if op == "KV_DECR" else rest[0]
            self.put(name, keyvalue.incremented(t, one.withColumn("delta", F.lit(by).cast(kind)), "key", "value", "delta").select("key", F.col("value").cast(kind)))
            return self.table(name).filter(F.col("key") == key).select("value")
        if op == "KV_CAS":
            wants = one.withColumn("expected", F.lit(rest[0]).cast(kind)).withColumn("new", F.lit(rest[1]).cast(kind))
            hit = t.filter((F.col("key") == key) & F.col("value").eqNullSafe(F.lit(rest[0]).cast(kind)))
            out = one.select((F.lit(not hit.isEmpty())).alias("success"))
            self.put(name, keyvalue.compare_and_set(t, "key", "value", wants))
            return out
        before = t.filter(F.col("key") == key).select("value")
        self.put(name, dml.upsert(t, one.withColumn("value", F.lit(rest[0]).cast(kind)), ["key"]))
        return before

    def _graph_index(self, m: re.Match, _: str) -> DataFrame:
        self.trees[m[1]] = (m[2], m[3], m[4])
        return self.table(m[2])

    def _below(self, tree: str, root) -> DataFrame:
        table, parent, key = self.trees[tree]
        t = self.table(table)
        links = t.select(F.col(parent).alias("_parent"), F.col(key).alias("_child"))
        seed = self.spark.range(1).select(F.lit(root).cast(t.schema[key].dataType).alias("_child"))
        return relational.reachable(seed, links, "_child", "_parent", "_child")

    def _tree(self, m: re.Match, _: str) -> DataFrame:
        args = split_top(m[2])
        if m[1].upper() == "TREE_CHILDREN":
            root = literal(args[1])
            return self._below(args[0], root).filter(F.col("_child") != root).withColumnRenamed("_child", "id")
        table, _parent, key = self.trees[args[1]]
        below = self._below(args[1], literal(args[2]))
        t = self.table(literal(args[3]) if len(args) > 3 else table)
        return t.join(below, F.col(key) == F.col("_child"), "left_semi").agg(F.sum(args[0]).alias("sum"))

    def _lookup(self, m: re.Match, _: str) -> DataFrame:
        name, args = m[1].upper(), [literal(a) for a in split_top(m[2])]
        if name == "TEMPORAL_LOOKUP":
            table, value, at, key, ts = args
            own = self.table(table).filter(F.col(key) == value)
            return timeseries.latest_as_of(own, [key], ts, F.lit(at).cast(own.schema[ts].dataType)).select(*own.columns)
        if name == "CONVERT_CURRENCY_LOOKUP":
            amount, source, target, table, at, key, rate, ts, *digits = args
            own = self.table(table).filter(F.col(key) == f"{source}/{target}")
            best = own.filter(F.col(ts) <= F.lit(at).cast(own.schema[ts].dataType)).agg(F.max_by(rate, ts).alias("rate"))
            return best.select(F.round(F.lit(float(amount)) * F.col("rate"), int(digits[0]) if digits else 2).alias("converted"))
        if name == "ESTIMATE_COUNT":
            return self.table(args[0]).agg(F.approx_count_distinct(args[1], 0.02).alias("count"))
        if name == "LAST_VALUES":
            t = self.table(args[0])
            return timeseries.latest_as_of(t, self._key(args[0]), "ts", F.lit("9999-01-01").cast(t.schema["ts"].dataType))
        t = self.table(args[0])
        return timeseries.latest_as_of(t.filter(F.col(self._key(args[0])[0]) == args[1]), self._key(args[0]), "ts", F.lit("9999-01-01").cast(t.schema["ts"].dataType))

    def _analyze(self, m: re.Match, _: str) -> DataFrame:
        """Rows, distinct values, nulls, least and greatest of each column, in one pass."""
        t = self.table(m[1])
        plain = [f.name for f in t.schema if f.dataType.typeName() not in ("map", "array", "struct", "variant", "binary")]
        stats = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_n").alias("distinct"), F.col(f"{c}_z").alias("nulls"), F.col(f"{c}_a").alias("least"), F.col(f"{c}_b").alias("greatest")) for c in plain))
        aggs = [x for c in plain for x in (F.approx_count_distinct(c).alias(f"{c}_n"), F.count_if(F.col(c).isNull()).alias(f"{c}_z"), F.min(c).cast("string").alias(f"{c}_a"), F.max(c).cast("string").alias(f"{c}_b"))]
        return t.agg(F.count("*").alias("rows"), *aggs).select("rows", F.explode(stats).alias("s")).select("s.*", "rows")

    def _explain(self, m: re.Match, _: str) -> DataFrame:
        """EXPLAIN: all plans; FORMATTED, COST, CODEGEN, EXTENDED or SIMPLE: Spark's form of that name; ANALYZE:
        the plan as it was run, with the rows of the result and the seconds it took."""
        form, text = (m[1] or "").upper(), m[2]
        df = self.select(text)
        if form == "ANALYZE":
            began = time.perf_counter()
            rows = df.count()
            lines = [f"rows: {rows}", f"seconds: {time.perf_counter() - began:.3f}", *df._jdf.queryExecution().executedPlan().toString().split("\n")]
        elif form:
            mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(form.lower())
            lines = df._jdf.queryExecution().explainString(mode).split("\n")
        else:
            lines = df._jdf.queryExecution().toString().split("\n")
        return self.spark.createDataFrame([(x,) for x in lines], "plan string")

    # Transactions: a statement makes new images, so names are all that is taken back

    def _begin(self, _m: re.Match, _: str) -> DataFrame:
        if self._saved:
            raise ValueError("a transaction is open already")
        return self._save(None)

    def _save(self, name: str | None) -> DataFrame:
        self._saved.append((name, {k: dict(getattr(self, k)) for k in _STATE} | {"deferred": list(self.deferred)}))
        return self.spark.range(0)

    def _restore(self, place: int) -> DataFrame:
        for k, v in self._saved[place][1].items():
            setattr(self, k, v.copy())
        return self.spark.range(0)

    def _savepoint(self, m: re.Match, _: str) -> DataFrame:
        if not self._saved:
            raise ValueError("no transaction is open")
        return self._save(m[1].lower())

    def _place(self, name: str) -> int:
        found = [i for i, (n, _) in enumerate(self._saved) if n == name.lower()]
        if not found:
            raise ValueError(f"no such savepoint: {name}")
        return found[-1]

    def _release(self, m: re.Match, _: str) -> DataFrame:
        del self._saved[self._place(m[1]) :]
        return self.spark.range(0)

    def _rollback(self, m: re.Match, _: str) -> DataFrame:
        if not self._saved:
            raise ValueError("no transaction is open")
        place = self._place(m[1]) if m[1] else 0
        self._restore(place)
        del self._saved[place + 1 if m[1] else 0 :]
        return self.spark.range(0)

    def _commit(self, _m: re.Match, _: str) -> DataFrame:
        if not self._saved:
            raise ValueError("no transaction is open")
        queue, self.deferred = self.deferred, []
        try:
            for trigger, feed in queue:
                self._fire(trigger, feed)
        except Exception:  # a deferred trigger that fails takes the transaction back
            self._restore(0)
            self._saved = []
            raise
        self._saved = []
        return self.spark.range(0)

    # Triggers: a statement's changes are a table (op, old, new) that the body reads

    def _create_trigger(self, m: re.Match, _: str) -> DataFrame:
        events = tuple(e.lower() for e in re.split(r"\s+OR\s+", m[3], flags=re.I))
        self.triggers[m[1]] = Trigger(m[1], re.sub(r"\s+", " ", m[2].upper()), events, m[4], (m[5] or "ROW").upper() == "ROW", m[6], (m[7] or "SYNC").upper(), m[8].strip())
        return self.spark.range(0)

    def _feed(self, before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
        feed = dml.changes(before, after, key)
        rest = [c for c in before.columns if c not in key]
        whole = lambda side, op: F.when(F.col("op") != op, F.struct(*(F.col(c) if c in key else F.col(f"{side}.{c}") for c in before.columns)))
        return feed.select("op", *key, whole("old", "insert").alias("old"), whole("new", "delete").alias("new")) if rest else feed

    def commit(self, name: str, new: DataFrame) -> DataFrame:
        """Makes ``new`` the collection's image, and runs the triggers on what it changes."""
        own = [t for t in self.triggers.values() if t.table == name]
        if name in self.unique and (fields := self.unique[name]):
            n = F.count("*").over(Window.partitionBy(*fields))
            new = new.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{name} has a value of {', '.join(fields)} twice")).cast("boolean")).otherwise(F.lit(True))).drop("_n")
        if not own:
            new = self.put(name, new)
            self._listed_changes(name, new)
            return new
        if self._depth >= 16:
            raise RecursionError("triggers call each other more than 16 deep")
        before, key = self.table(name), self._key(name)
        new = written(new, name)
        for t in (t for t in own if t.when == "BEFORE"):
            new = written(self._before(t, before, new, key), name)
        feed = written(self._feed(before, new, key), "changes")
        instead = [t for t in own if t.when == "INSTEAD OF"]
        taken = sorted({e for t in instead for e in t.events})
        if taken:  # those changes go to the body, not to the collection
            back = feed.filter(F.col("op").isin(*taken))
            kept = new.join(back.select(*key), key, "left_anti")
            new = written(kept.unionByName(back.filter("op <> 'insert'").select("old.*")), name)
        self.put(name, new, keep=False)
        self._listed_changes(name, new)
        for t in own:
            if t.when == "BEFORE":
                continue
            some = feed.filter(F.col("op").isin(*t.events))
            if t.mode == "ASYNC":
                self.waiting.append((t, some))
            elif t.mode == "DEFERRED" and self._saved:
                self.deferred.append((t, some))
            else:
                self._fire(t, some)
        return self.table(name)

    def _before(self, t: Trigger, before: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
        """SET NEW.column = expression, .. or RAISE 'text', for the rows that the condition takes."""
        feed = self._feed(before, new, key).filter(F.col("op").isin(*t.events))
        hit = F.expr(t.condition) if t.condition else F.lit(True)
        if m := re.match(r"RAISE\s+('(?:[^']|'')*')", t.body, re.I):
            if not feed.filter(hit).isEmpty():
                raise ValueError(literal(m[1]))
            return new
        m = re.match(r"SET\s+(.*)$", t.body, re.I | re.S)
        if not m:
            raise ValueError("a BEFORE trigger sets columns of NEW or raises")
        sets = {re.sub(r"^new\.", "", c.strip(), flags=re.I): e for c, e in (re.split(r"\s*=\s*", x, maxsplit=1) for x in split_top(m[1]))}
        changed = feed.filter(F.col("new").isNotNull() & F.coalesce(hit, F.lit(False)))
        rows = changed.select(*((F.expr(sets[c]) if c in sets else F.col(f"new.{c}")).cast(new.schema[c].dataType).alias(c) for c in new.columns))
        return dml.upsert(new, rows, key)

    def _fire(self, t: Trigger, feed: DataFrame) -> None:
        some = feed if t.condition is None else feed.filter(F.expr(t.condition))
        if some.isEmpty():
            return
        body = t.body
        if t.each_row and (m := re.match(r"((?:INSERT|UPSERT)\s+INTO\s+\w+\s*(?:\([^)]*\))?)\s*VALUES\s*\((.*)\)\s*$", body, re.I | re.S)):
            body = f"{m[1]} SELECT {m[2]} FROM changes"
        was = self.tables.get("changes")
        self.tables["changes"], self._depth = some, self._depth + 1
        try:
            self.execute(body)
        finally:
            self._depth -= 1
            self.tables.pop("changes")
            if was is not None:
                self.tables["changes"] = was

    def _run_triggers(self, _m: re.Match, _: str) -> DataFrame:
        """Runs what ASYNC triggers have waiting; one that fails leaves the others to run, and is told at the end."""
        queue, self.waiting, failed = self.waiting, [], []
        for t, feed in queue:
            try:
                self._fire(t, feed)
            except Exception as e:  # noqa: BLE001
                failed.append(f"{t.name}: {e}")
        if failed:
            raise RuntimeError("; ".join(failed))
        return self.spark.createDataFrame([(len(queue),)], "count long")

    def _drop_trigger(self, m: re.Match, _: str) -> DataFrame:
        del self.triggers[m[1]]
        return self.spark.range(0)

    # Schedules

    def _create_schedule(self, m: re.Match, _: str) -> DataFrame:
        schedule.parsed(m[2])
        self.schedules[m[1]] = (m[2], m[3])
        return self.spark.range(0)

    def run_due(self, start, end) -> list[str]:
        """Runs each schedule's statement once for each of its minutes from start on, before end; the names, in order."""
        names = {n: F.lit(n) for n in self.schedules}
        plans = [schedule.runs(self.spark, c, start, end).withColumn("name", names[n]) for n, (c, _) in self.schedules.items()]
        if not plans:
            return []
        order = [r["name"] for r in reduce(DataFrame.unionByName, plans).orderBy("at", "name").collect()]  # a row a run
        for n in order:
            self.execute(self.schedules[n][1])
        return order

    # Copies and other forms of collections

    def _clone(self, m: re.Match, _: str) -> DataFrame:
        """A clone shares the image, and diverges as either changes; AS OF: the newest versions at a system time."""
        source = self.table(m[2])
        if m[3]:
            key = self._key(m[2])
            source = dml.as_of(source, [k for k in key if k != "_ts_system"], "_ts_system", int(m[3]))
        self.tables[m[1]] = source
        if m[2] in self.keys:
            self.keys[m[1]] = [k for k in self.keys[m[2]] if not m[3] or k != "_ts_system"]
        return self.spark.range(0)

    def _mirror(self, m: re.Match, _: str) -> DataFrame:
        self.mirrors[m[1]] = m[2]
        return self.spark.range(0)

    def _convert(self, m: re.Match, _: str) -> DataFrame:
        """TO DOCUMENT: the columns beside the key as one JSON text, doc; TO COLUMNAR (name TYPE, ..): the other way;
        TO KV: the key as text and the rest as JSON value."""
        name, kind, schema = m[1], m[2].upper(), m[3]
        t, key = self.table(name), self._key(m[1])
        rest = [c for c in t.columns if c not in key]
        if kind == "COLUMNAR":
            if not schema:
                raise ValueError("columns are needed")
            new = t.select(*key, F.from_json("doc", re.sub(r"\bTEXT\b", "STRING", schema, flags=re.I)).alias("_d")).select(*key, "_d.*")
        elif kind == "DOCUMENT":
            new = t.select(*key, F.to_json(F.struct(*rest)).alias("doc"))
        else:
            new = t.select(F.concat_ws(":", *(F.col(k).cast("string") for k in key)).alias("key"), F.to_json(F.struct(*rest)).alias("value"))
            key = ["key"]
        return self.put(name, new, key)

    def _create_index(self, m: re.Match, _: str) -> DataFrame:
        """UNIQUE holds from now on; FULLTEXT makes a table of postings, VECTOR one of inverted lists (both named as the
        index); others lay the collection out by the columns, so that ranges of them skip most files."""
        kind, name, table, cols = (m[1] or "").upper(), m[2], m[3], split_top(m[4])
        t = self.table(table)
        if kind == "UNIQUE":
            self.unique[table] = cols
            try:
                self.commit(table, t).count()
            except Exception:
                del self.unique[table]
                raise
        elif kind == "FULLTEXT":
            self.put(name, search.postings(t, self._key(table)[0], cols[0]))
        elif kind == "VECTOR":
            key = self._key(table)[0]
            lists = max(1, round(t.count() ** 0.5))
            books = vector.inverted_lists(t, cols[0], key, lists)
            self.centroids[name] = (table, cols[0], books)
            self.put(name, vector.listed(t, cols[0], books))
        else:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.put(table, t.repartitionByRange(parts, *cols).sortWithinPartitions(*cols))
        return self.spark.range(0)

    def _listed_changes(self, name: str, new: DataFrame) -> None:
        """Vector indexes of a collection follow it: rows that stay keep their lists, others are listed."""
        for index, (table, column, books) in self.centroids.items():
            if table == name:
                old, key = self.table(index), self._key(name)
                same = [*key, column]
                kept = old.select(*same, "list").join(new.select(*same), same, "left_semi")
                lists = kept.select(*key, "list").unionByName(vector.listed(new.join(kept.select(*key), key, "left_anti"), column, books).select(*key, "list"))
                self.put(index, new.join(lists, key))

    def _rebuild(self, m: re.Match, _: str) -> DataFrame:
        """Centroids and lists anew, for a collection that has changed much."""
        table, column, _books = self.centroids[m[1]]
        t, key = self.table(table), self._key(table)[0]
        books = vector.inverted_lists(t, column, key, max(1, round(t.count() ** 0.5)))
        self.centroids[m[1]] = (table, column, books)
        return self.put(m[1], vector.listed(t, column, books)).agg(F.count("*").alias("count"))

    def _vector_stats(self, m: re.Match, _: str) -> DataFrame:
        per = self.table(m[1]).groupBy("list").agg(F.count("*").alias("n"))
        return per.agg(F.count("*").alias("lists"), F.sum("n").alias("vectors"), F.max("n").alias("largest"))

    def _approximate(self, m: re.Match, _: str) -> DataFrame:
        """SEARCH index APPROXIMATE (ARRAY[..], k, probes)."""
        table, column, books = self.centroids[m[1]]
        args = split_top(m[2])
        return vector.listed_topk(self.table(m[1]), column, books, literal(args[0]), int(args[1]), self._key(table)[0], int(args[2]))

    def _array_maintained(self, m: re.Match, _: str) -> DataFrame:
        """ARRAY_FLUSH(name): writes the cells; ARRAY_COMPACT(name, time): leaves out versions that no read from that time
        on needs.  Gives the number of cells."""
        args = [literal(x) for x in split_top(m[2])]
        a = self.arrays[args[0]]
        if m[1].upper() == "ARRAY_COMPACT":
            a = a.compacted("_ts_system", int(args[1]))
        self.arrays[args[0]] = a._with(written(a.cells, args[0]))
        return self.arrays[args[0]].cells.agg(F.count("*").alias("count"))

    def _view_create(self, m: re.Match, _: str) -> DataFrame:
        self.views[m[1]] = m[2]
        return self.put(m[1], self.select(m[2]))

    def _view_refresh(self, m: re.Match, _: str) -> DataFrame:
        return self.put(m[1], self.select(self.views[m[1]]))

    def _drop(self, m: re.Match, _: str) -> DataFrame:
        for d in (self.tables, self.arrays, self.indexes, self.views, self.keys):
            d.pop(m[1], None)
        return self.spark.range(0)


_TABLE_FUNCTION = re.compile(r"\b(ARRAY_SLICE|ARRAY_PROJECT|ARRAY_ELEMENTWISE|FACET_COUNTS|WEIGHTED_PICK|(?<=FROM )(?:ARRAY_AGG|TOPK|RANGE))\s*\((?=\s*['\w])", re.I)
_V = r"('[^']*'|[-\w.]+)"
_STATEMENTS = [
    (re.compile(p, re.I | re.S), h)
    for p, h in (
        (r"GRAPH\s+ALGO\s+(\w+)\s+ON\s+(\w+)(.*)$", Database._graph_algo),
        (rf"GRAPH\s+TRAVERSE\s+FROM\s+{_V}(.*)$", Database._graph_traverse),
        (rf"GRAPH\s+PATH\s+FROM\s+{_V}\s+TO\s+{_V}(.*)$", Database._graph_path),
        (rf"GRAPH\s+NEIGHBORS\s+OF\s+{_V}(.*)$", Database._graph_neighbors),
        (rf"GRAPH\s+INSERT\s+EDGE\s+(?:IN\s+'?(\w+)'?\s+)?FROM\s+{_V}\s+TO\s+{_V}\s+TYPE\s+'(\w+)'", Database._graph_insert),
        (rf"GRAPH\s+DELETE\s+EDGE\s+(?:IN\s+'?(\w+)'?\s+)?FROM\s+{_V}\s+TO\s+{_V}\s+TYPE\s+'(\w+)'", Database._graph_delete),
        (r"MATCH\s*\(", Database._match),
        (r"SEARCH\s+(\w+)\s+USING\s+(VECTOR|TEXT|FUSION)\s*\((.*)\)$", Database._search),
        (r"CREATE\s+(?:TABLE|COLLECTION)\s+(\w+)\s*\((.*)\)[^)]*$", Database._create),
        (r"CREATE\s+ARRAY\s+(\w+)\s+DIMS\s*\((.*?)\)\s*ATTRS\s*\((.*?)\)(?:\s*TILE_EXTENTS\s*\((.*?)\))?", Database._create_array),
        (r"CREATE\s+SORTED\s+INDEX\s+(\w+)\s+ON\s+(\w+)\s*\(\s*(\w+)(?:\s+DESC)?\s*\)\s*KEY\s+(\w+)", Database._sorted_index),
        (r"CREATE\s+MATERIALIZED\s+VIEW\s+(\w+)\s+AS\s+(.*)$", Database._view_create),
        (r"REFRESH\s+MATERIALIZED\s+VIEW\s+(\w+)$", Database._view_refresh),
        (r"DROP\s+(?:TABLE|COLLECTION|ARRAY|MATERIALIZED\s+VIEW|SORTED\s+INDEX)\s+(\w+)$", Database._drop),
        (r"(INSERT|UPSERT)\s+INTO\s+(\w+)\s*(?:\(([^)]*)\)\s*(?=VALUES|SELECT))?(.*)$", Database._insert),
        (r"UPDATE\s+(\w+)\s+SET\s+(.*)$", Database._update),
        (r"DELETE\s+FROM\s+(\w+)(\s+.*)?$", Database._delete),
        (r"TRUNCATE\s+(?:TABLE\s+)?(\w+)", Database._truncate),
        (r"MERGE\s+INTO\s+(\w+)(?:\s+(?:AS\s+)?(?!USING\b)(\w+))?\s+USING\s+(\(.*?\)|\w+)(?:\s+(?:AS\s+)?(?!ON\b)(\w+))?\s+ON\s+(.*)$", Database._merge),
        (r"COPY\s+(\w+)\s+FROM\s+'([^']*)'(.*)$", Database._copy_from),
        (r"COPY\s+(\w+|\(.*\))\s+TO\s+'([^']*)'", Database._copy_to),
        (rf"SELECT\s+RANK\s*\(\s*(\w+)\s*,\s*{_V}\s*\)$", Database._rank),
        (r"SELECT\s+(KV_INCR_FLOAT|KV_INCR|KV_DECR|KV_CAS|KV_GETSET)\s*\((.*)\)$", Database._kv),
        (r"CREATE\s+GRAPH\s+INDEX\s+(\w+)\s+ON\s+(\w+)\s*\(\s*(\w+)\s*->\s*(\w+)\s*\)", Database._graph_index),
        (r"SELECT\s+(TREE_CHILDREN|TREE_SUM)\s*\((.*?)\)(?:\s+FROM\s.*)?$", Database._tree),
        (r"SELECT\s+(?:\*\s+FROM\s+)?(TEMPORAL_LOOKUP|CONVERT_CURRENCY_LOOKUP|ESTIMATE_COUNT|LAST_VALUES?)\s*\((.*)\)$", Database._lookup),
        (r"ANALYZE\s+(\w+)$", Database._analyze),
        (r"EXPLAIN\s+(?:(ANALYZE|FORMATTED|COST|CODEGEN|EXTENDED|SIMPLE)\s+)?(.*)$", Database._explain),
        (r"ALTER\s+ARRAY\s+(\w+)\s+(.*)$", Database._alter_array),
        (r"REBUILD\s+VECTOR\s+INDEX\s+(\w+)$", Database._rebuild),
        (r"SELECT\s+VECTOR_STATS\s*\(\s*'(\w+)'\s*\)$", Database._vector_stats),
        (r"BEGIN(?:\s+(?:TRANSACTION|WORK))?$", Database._begin),
        (r"COMMIT(?:\s+(?:TRANSACTION|WORK))?$", Database._commit),
        (r"ROLLBACK(?:\s+(?:TRANSACTION|WORK))?(?:\s+TO\s+(?:SAVEPOINT\s+)?(\w+))?$", Database._rollback),
        (r"SAVEPOINT\s+(\w+)$", Database._savepoint),
        (r"RELEASE\s+(?:SAVEPOINT\s+)?(\w+)$", Database._release),
        (r"CREATE\s+TRIGGER\s+(\w+)\s+(BEFORE|AFTER|INSTEAD\s+OF)\s+((?:INSERT|UPDATE|DELETE)(?:\s+OR\s+(?:INSERT|UPDATE|DELETE))*)\s+ON\s+(\w+)(?:\s+FOR\s+EACH\s+(ROW|STATEMENT))?(?:\s+WHEN\s*\((.*?)\))?(?:\s+(SYNC|ASYNC|DEFERRED))?\s+AS\s+(.*)$", Database._create_trigger),
        (r"DROP\s+TRIGGER\s+(\w+)$", Database._drop_trigger),
        (r"RUN\s+TRIGGERS$", Database._run_triggers),
        (r"CREATE\s+SCHEDULE\s+(\w+)\s+CRON\s+'([^']*)'\s+AS\s+(.*)$", Database._create_schedule),
        (r"CREATE\s+(?:TABLE|COLLECTION)\s+(\w+)\s+CLONE\s+OF\s+(\w+)(?:\s+AS\s+OF\s+(?:SYSTEM\s+TIME\s+)?(\d+))?$", Database._clone),
        (r"CREATE\s+MIRROR\s+(\w+)\s+OF\s+(\w+)$", Database._mirror),
        (r"CONVERT\s+COLLECTION\s+(\w+)\s+TO\s+(DOCUMENT|COLUMNAR|KV)(?:\s*\((.*)\))?$", Database._convert),
        (r"CREATE\s+(?:(UNIQUE|FULLTEXT|VECTOR|SPATIAL)\s+)?INDEX\s+(\w+)\s+ON\s+(\w+)\s*\((.*?)\)$", Database._create_index),
        (r"SEARCH\s+(\w+)\s+APPROXIMATE\s*\((.*)\)$", Database._approximate),
        (r"SELECT\s+(ARRAY_FLUSH|ARRAY_COMPACT)\s*\((.*)\)$", Database._array_maintained),
        (r"SELECT\s+SORTED_COUNT\s*\(\s*(\w+)\s*\)$", Database._sorted_count),
    )
]
