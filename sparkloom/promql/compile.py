"""PromQL trees to DataFrames.

Samples: metric, labels (map), ts (milliseconds), value.  A vector is a DataFrame of labels (a
sorted array of (k, v), with __name__ while it applies), step (milliseconds) and value; all steps
of a range query are evaluated at once.  A sample is sent to the steps whose windows hold it;
functions that combine (sum, avg, min, ..) aggregate there before the shuffle, others
gather a series' samples of one window, in time order, and fold them in generated code."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.promql import parse as P

LOOKBACK = 300_000
_EMPTY = "cast(array() as array<struct<k:string,v:string>>)"


@dataclass
class Scalar:
    """A number for each step: a Column over ``step``."""

    value: Column


@dataclass
class Vector:
    df: DataFrame


@dataclass
class Matrix:
    """(labels, step, ts, value): a row for each sample of each window."""

    df: DataFrame
    range_ms: int


def _without_name(labels: Column) -> Column:
    return F.filter(labels, lambda x: x["k"] != "__name__")


def _keep(labels: Column, names: list[str], keep: bool) -> Column:
    names = list(names)
    if keep:
        return F.filter(labels, lambda x: x["k"].isin(names)) if names else F.expr(_EMPTY)
    return F.filter(labels, lambda x: ~x["k"].isin([*names, "__name__"]))


def _get(labels: Column, name: str) -> Column:
    return F.coalesce(F.filter(labels, lambda x: x["k"] == name)[0]["v"], F.lit(""))


def _put(labels: Column, name: str, value: Column) -> Column:
    """Labels with one set; an empty value takes it away."""
    rest = F.filter(labels, lambda x: x["k"] != name)
    new = F.array(F.struct(F.lit(name).alias("k"), value.alias("v")))
    return F.when(value == "", rest).otherwise(F.array_sort(F.concat(rest, new)))


class Compiler:
    def __init__(self, samples: DataFrame, start: int, end: int, step: int, lookback: int = LOOKBACK) -> None:
        self.samples, self.start, self.end, self.step, self.lookback = samples, start, end, max(1, step), lookback
        self.n = (end - start) // self.step + 1

    def steps(self) -> DataFrame:
        return self.samples.sparkSession.range(self.n).select((F.col("id") * self.step + self.start).alias("step"))

    # Selectors

    def _series(self, s: P.Selector) -> DataFrame:
        df = self.samples
        if s.name is not None:
            df = df.filter(F.col("metric") == s.name)
        for k, op, v in s.matchers:
            c = F.col("metric") if k == "__name__" else F.coalesce(F.col("labels")[k], F.lit(""))
            df = df.filter({"=": lambda: c == v, "!=": lambda: c != v, "=~": lambda: c.rlike(f"^(?:{v})$"), "!~": lambda: ~c.rlike(f"^(?:{v})$")}[op]())
        pairs = F.transform(F.map_entries("labels"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
        name = F.array(F.struct(F.lit("__name__").alias("k"), F.col("metric").alias("v")))
        return df.select(F.array_sort(F.concat(name, pairs)).alias("labels"), "ts", "value")

    def _dealt(self, df: DataFrame, offset: int, span: int, closed: bool) -> DataFrame:
        """Each sample to the steps whose window holds it: (step - offset - span, step - offset],
        or with the lower end too if closed."""
        low = self.start - offset
        first = F.greatest(F.lit(0), F.ceil((F.col("ts") - low) / self.step)).cast("long")
        edge = F.col("ts") + span - low
        last = F.least(F.lit(self.n - 1), F.floor(edge / self.step) if closed else F.ceil(edge / self.step) - 1).cast("long")
        df = df.filter((F.col("ts") <= self.end - offset) & (F.col("ts") >= low - span))
        hit = df.withColumn("_a", first).withColumn("_z", last).filter("_a <= _z")
        return hit.select("labels", F.explode(F.sequence("_a", "_z")).alias("_i"), "ts", "value").select("labels", (F.col("_i") * self.step + self.start).alias("step"), "ts", "value")

    def _selector(self, s: P.Selector) -> Vector | Matrix:
        own = self._series(s)
        if s.range_ms is not None:
            return Matrix(self._dealt(own, s.offset_ms, s.range_ms, False), s.range_ms)
        near = self._dealt(own, s.offset_ms, self.lookback, True)
        return Vector(near.groupBy("labels", "step").agg(F.max_by("value", "ts").alias("value")))

    def _subquery(self, s: P.Subquery) -> Matrix:
        step = s.step_ms or self.step
        low = self.start - s.offset_ms - s.range_ms
        first = -(-(low + 1) // step) * step  # aligned to the step, as windows are open below
        inner = Compiler(self.samples, first, self.end - s.offset_ms, step, self.lookback)
        v = inner.vector(s.expr).df.select("labels", F.col("step").alias("ts"), "value")
        return Matrix(self._dealt(v, s.offset_ms, s.range_ms, False), s.range_ms)

    # Expressions

    def run(self, e) -> Scalar | Vector | Matrix:
        if isinstance(e, P.Number):
            return Scalar(F.lit(e.value))
        if isinstance(e, P.Selector):
            return self._selector(e)
        if isinstance(e, P.Subquery):
            return self._subquery(e)
        if isinstance(e, P.Negative):
            v = self.run(e.expr)
            return Scalar(-v.value) if isinstance(v, Scalar) else Vector(v.df.select(_without_name(F.col("labels")).alias("labels"), "step", (-F.col("value")).alias("value")))
        if isinstance(e, P.Aggregate):
            return self._aggregate(e)
        if isinstance(e, P.Binary):
            return self._binary(e)
        if isinstance(e, P.Call):
            return self._call(e)
        raise ValueError(f"a number or vector is expected, not {e}")

    def vector(self, e) -> Vector:
        v = self.run(e)
        if isinstance(v, Scalar):
            return Vector(self.steps().select(F.expr(_EMPTY).alias("labels"), "step", v.value.cast("double").alias("value")))
        if isinstance(v, Matrix):
            raise ValueError("a range vector needs a function")
        return v

    def scalar(self, e) -> Column:
        v = self.run(e)
        if not isinstance(v, Scalar):
            raise ValueError("a scalar is expected")
        return v.value

    def number(self, e) -> float:
        if isinstance(e, P.Negative):
            return -self.number(e.expr)
        if not isinstance(e, P.Number):
            raise ValueError("a number is expected")
        return e.value

    # Aggregations

    def _aggregate(self, e: P.Aggregate) -> Vector:
        df = self.vector(e.expr).df
        key = _keep(F.col("labels"), e.labels, e.by)
        v = F.col("value")
        if e.op in ("topk", "bottomk"):
            order = F.desc("value") if e.op == "topk" else F.asc("value")
            at = F.row_number().over(Window.partitionBy("_key", "step").orderBy(F.isnan("value"), order, "labels"))
            return Vector(df.withColumn("_key", key).withColumn("_at", at).filter(F.col("_at") <= int(self.number(e.param))).select("labels", "step", "value"))
        if e.op == "count_values":
            name = e.param.value
            shown_ = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
            df = df.select(_put(key, name, shown_).alias("labels"), "step", "value")
            return Vector(df.groupBy("labels", "step").agg(F.count("*").cast("double").alias("value")))
        f = {
            "sum": F.sum(v), "avg": F.avg(v), "min": F.min(v), "max": F.max(v), "count": F.count("*").cast("double"), "group": F.first(F.lit(1.0)), "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v),
        }
        out = F.percentile(v, F.lit(min(1.0, max(0.0, self.number(e.param))))) if e.op == "quantile" else f[e.op]
        return Vector(df.groupBy(key.alias("labels"), "step").agg(out.alias("value")))

    # Binary operators

    def _binary(self, e: P.Binary) -> Scalar | Vector:
        left, right = self.run(e.left), self.run(e.right)
        if isinstance(left, Matrix) or isinstance(right, Matrix):
            raise ValueError("operators are between numbers and instant vectors")
        if e.op in ("and", "or", "unless"):
            return self._set(e, left, right)
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            if e.op in P.COMPARE and not e.as_bool:
                raise ValueError("comparisons of scalars need bool")
            out = _apply(e.op, left.value, right.value)
            return Scalar(out.cast("double"))
        if isinstance(left, Scalar) or isinstance(right, Scalar):
            df = (right if isinstance(left, Scalar) else left).df
            a = left.value if isinstance(left, Scalar) else F.col("value")
            b = right.value if isinstance(right, Scalar) else F.col("value")
            out = _apply(e.op, a, b)
            if e.op in P.COMPARE and not e.as_bool:
                return Vector(df.filter(out))
            return Vector(df.select(_without_name(F.col("labels")).alias("labels"), "step", out.cast("double").alias("value")))
        return self._matched(e, left.df, right.df)

    def _key(self, e: P.Binary) -> Column:
        return _keep(F.col("labels"), e.labels, True) if e.on else _keep(F.col("labels"), e.labels, False)

    def _matched(self, e: P.Binary, left: DataFrame, right: DataFrame) -> Vector:
        many_right = e.group == "group_right"
        many, one = (right, left) if many_right else (left, right)
        # one side has a label set once: more than one match is an error
        n = F.count("*").over(Window.partitionBy("_key", "step"))
        single = F.when(n > 1, F.raise_error(F.lit("many-to-many matching"))).otherwise(F.lit(1))
        one = one.withColumn("_key", self._key(e)).withColumn("_ok", single).filter("_ok = 1").select("_key", "step", F.col("labels").alias("_labels"), F.col("value").alias("_value"))
        many = many.withColumn("_key", self._key(e))
        if e.group is None:
            many = many.withColumn("_ok", single).filter("_ok = 1").drop("_ok")
        j = many.join(one, ["_key", "step"])
        a, b = (F.col("_value"), F.col("value")) if many_right else (F.col("value"), F.col("_value"))
        out = _apply(e.op, a, b)
        labels = F.col("labels") if e.op in P.COMPARE and not e.as_bool else _without_name(F.col("labels"))
        if e.group is None and not (e.op in P.COMPARE and not e.as_bool):
            labels = F.col("_key")
        for name in e.include:
            labels = _put(labels, name, _get(F.col("_labels"), name))
        if e.op in P.COMPARE and not e.as_bool:
            return Vector(j.filter(out).select(labels.alias("labels"), "step", a.alias("value")))
        return Vector(j.select(labels.alias("labels"), "step", out.cast("double").alias("value")))

    def _set(self, e: P.Binary, left, right) -> Vector:
        if isinstance(left, Scalar) or isinstance(right, Scalar):
            raise ValueError(f"{e.op} is between vectors")
        a, b = left.df.withColumn("_key", self._key(e)), right.df.withColumn("_key", self._key(e))
        cols = ["labels", "step", "value"]
        if e.op == "or":
            return Vector(a.select(*cols).unionByName(b.join(a.select("_key", "step").distinct(), ["_key", "step"], "left_anti").select(*cols)))
        return Vector(a.join(b.select("_key", "step"), ["_key", "step"], "left_semi" if e.op == "and" else "left_anti").select(*cols))

    # Functions

    def _call(self, e: P.Call) -> Scalar | Vector:
        name, args = e.name, e.args
        if name == "time":
            return Scalar(F.col("step") / 1000.0)
        if name == "pi":
            return Scalar(F.lit(math.pi))
        if name == "vector":
            return self.vector(args[0])
        if name == "scalar":
            v = self.vector(args[0]).df
            one = v.groupBy("step").agg(F.when(F.count("*") == 1, F.first("value")).otherwise(F.lit(float("nan"))).alias("value"))
            out = self.steps().join(one, "step", "left").select(F.expr(_EMPTY).alias("labels"), "step", F.coalesce("value", F.lit(float("nan"))).alias("value"))
            return Vector(out)
        if name in ("label_replace", "label_join"):
            return self._relabel(e)
        if name in ("absent", "absent_over_time"):
            return self._absent(args[0])
        if name == "histogram_quantile":
            return self._histogram(self.number(args[0]), self.vector(args[1]).df)
        if name in _OVER_TIME or name in _FOLDS:
            return self._over_time(e)
        if name in ("sort", "sort_desc"):
            return self.vector(args[0])  # rows of a result have no order
        if name == "timestamp":
            return Vector(self.vector(args[0]).df.select(_without_name(F.col("labels")).alias("labels"), "step", (F.col("step") / 1000.0).alias("value")))
        f = _ELEMENT.get(name)
        if f is None:
            raise ValueError(f"no such function: {name}")
        v = self.run(args[0])
        more = [self.scalar(a) for a in args[1:]]
        if isinstance(v, Scalar):
            return Scalar(f(v.value, *more))
        return Vector(v.df.select(_without_name(F.col("labels")).alias("labels"), "step", f(F.col("value"), *more).cast("double").alias("value")))

    def _over_time(self, e: P.Call) -> Vector:
        matrix = next((m for m in map(self._maybe_matrix, e.args) if m is not None), None)
        if matrix is None:
            raise ValueError(f"{e.name} takes a range vector")
        params = [self.number(a) for a in e.args if not isinstance(a, (P.Selector, P.Subquery))]
        df = matrix.df.withColumn("labels", _without_name(F.col("labels")))
        if e.name in _OVER_TIME:  # times from the step on, as squares of whole times lose their last digits
            out = df.groupBy("labels", "step").agg(_OVER_TIME[e.name](F.col("value"), F.col("ts") - F.col("step"), *params).alias("value"))
        else:
            window = df.groupBy("labels", "step").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("s"))
            out = window.select("labels", "step", _FOLDS[e.name](F.col("s"), *params).alias("value"))
        return Vector(out.filter("value IS NOT NULL"))

    def _maybe_matrix(self, a) -> Matrix | None:
        return self.run(a) if isinstance(a, P.Subquery) or (isinstance(a, P.Selector) and a.range_ms is not None) else None

    def _relabel(self, e: P.Call) -> Vector:
        df = self.vector(e.args[0]).df
        texts = [a.value for a in e.args[1:]]
        if e.name == "label_join":
            to, sep, *sources = texts
            new = F.concat_ws(sep, *(_get(F.col("labels"), s) for s in sources))
            return Vector(df.withColumn("labels", _put(F.col("labels"), to, new)))
        to, replacement, source, rx = texts
        old = _get(F.col("labels"), source)
        new = F.regexp_replace(old, f"^(?:{rx})$", replacement)
        return Vector(df.withColumn("labels", F.when(old.rlike(f"^(?:{rx})$"), _put(F.col("labels"), to, new)).otherwise(F.col("labels"))))

    def _absent(self, a) -> Vector:
        v = self.run(a)
        gone = self.steps().join(v.df.select("step").distinct(), "step", "left_anti")
        own = sorted((k, x) for k, op, x in a.matchers if op == "=" and k != "__name__") if isinstance(a, P.Selector) else []
        labels = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("v")) for k, x in own)) if own else F.expr(_EMPTY)
        return Vector(gone.select(labels.alias("labels"), "step", F.lit(1.0).alias("value")))

    def _histogram(self, q: float, df: DataFrame) -> Vector:
        le = _get(F.col("labels"), "le")
        bound = F.when(le.isin("+Inf", "Inf", "inf"), F.lit(math.inf)).otherwise(F.coalesce(le.try_cast("double"), F.lit(math.inf)))
        keyed = df.select(_keep(F.col("labels"), ["le"], False).alias("labels"), "step", bound.alias("le"), "value")
        g = keyed.groupBy("labels", "step").agg(F.array_sort(F.collect_list(F.struct("le", F.col("value").alias("n")))).alias("b"))
        total = F.element_at("b", -1)["n"]
        g = g.withColumn("total", total).withColumn("rank", F.lit(min(1.0, max(0.0, q))) * total)
        at = F.greatest(F.lit(1), F.size(F.filter("b", lambda x: x["n"] < F.col("rank"))) + 1)
        g = g.withColumn("at", F.least(at, F.size("b")))
        hit = F.element_at("b", F.col("at"))
        low = F.when(F.col("at") > 1, F.get("b", F.col("at") - 2)["le"]).otherwise(F.lit(0.0))
        below = F.when(F.col("at") > 1, F.get("b", F.col("at") - 2)["n"]).otherwise(F.lit(0.0))
        inside = F.when(hit["n"] == below, low).otherwise(low + (hit["le"] - low) * (F.col("rank") - below) / (hit["n"] - below))
        value = F.when(F.col("total") == 0, F.lit(math.nan)).when(hit["le"] == math.inf, low).otherwise(inside)
        return Vector(g.select("labels", "step", value.alias("value")))


def _apply(op: str, a: Column, b: Column) -> Column:
    """IEEE arithmetic: x / 0 is infinite or NaN, as Prometheus has it."""
    if op == "/":
        sign = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).otherwise(F.lit(math.nan))
        return F.when(b == 0, sign).otherwise(F.try_divide(a, b))
    if op == "%":
        return F.when(b == 0, F.lit(math.nan)).otherwise(F.try_mod(a, b))
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: F.pow(a, b), "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


_OVER_TIME = {
    "sum_over_time": lambda v, ts: F.sum(v),
    "avg_over_time": lambda v, ts: F.avg(v),
    "min_over_time": lambda v, ts: F.min(v),
    "max_over_time": lambda v, ts: F.max(v),
    "count_over_time": lambda v, ts: F.count("*").cast("double"),
    "last_over_time": lambda v, ts: F.max_by(v, ts),
    "first_over_time": lambda v, ts: F.min_by(v, ts),
    "present_over_time": lambda v, ts: F.first(F.lit(1.0)),
    "stddev_over_time": lambda v, ts: F.when(F.count("*") >= 2, F.stddev_pop(v)),
    "stdvar_over_time": lambda v, ts: F.when(F.count("*") >= 2, F.var_pop(v)),
    "quantile_over_time": lambda v, ts, q: F.percentile(v, F.lit(min(1.0, max(0.0, q)))),
    "delta": lambda v, ts: F.when(F.count("*") >= 2, F.max_by(v, ts) - F.min_by(v, ts)),
    "deriv": lambda v, ts: F.when(F.count_distinct(ts) >= 2, F.regr_slope(v, ts / 1000.0)),
    "predict_linear": lambda v, ts, t: F.when(F.count_distinct(ts) >= 2, F.max_by(v, ts) + F.regr_slope(v, ts / 1000.0) * t),
}


def _pairs(s: Column, f) -> Column:
    """f(before, after) of neighbouring samples, summed."""
    start = F.struct(s[0]["value"].alias("before"), F.lit(0.0).alias("total"))
    return F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), start, lambda a, x: F.struct(x["value"].alias("before"), (a["total"] + f(a["before"], x["value"])).alias("total")))["total"]


def _grown(before: Column, after: Column) -> Column:
    return F.when(after >= before, after - before).otherwise(after)


def _span(s: Column) -> Column:
    return (F.element_at(s, -1)["ts"] - s[0]["ts"]) / 1000.0


def _last_two(s: Column, f) -> Column:
    return F.when(F.size(s) >= 2, f(F.element_at(s, F.lit(-2)), F.element_at(s, -1)))


def _smoothed(s: Column, sf: float, tf: float) -> Column:
    if not (0 < sf < 1 and 0 < tf < 1):
        raise ValueError("smoothing factors lie between 0 and 1")
    start = F.struct(s[0]["value"].alias("level"), F.when(F.size(s) > 1, F.get(s, F.lit(1))["value"] - s[0]["value"]).otherwise(F.lit(0.0)).alias("trend"))

    def step(a: Column, x: Column) -> Column:
        level = F.lit(sf) * x["value"] + F.lit(1 - sf) * (a["level"] + a["trend"])
        return F.struct(level.alias("level"), (F.lit(tf) * (level - a["level"]) + F.lit(1 - tf) * a["trend"]).alias("trend"))

    return F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), start, step)["level"]


_FOLDS = {
    "increase": lambda s: F.when((F.size(s) >= 2) & (_span(s) > 0), _pairs(s, _grown)),
    "rate": lambda s: F.when((F.size(s) >= 2) & (_span(s) > 0), _pairs(s, _grown) / _span(s)),
    "irate": lambda s: _last_two(s, lambda a, b: F.when(b["ts"] > a["ts"], _grown(a["value"], b["value"]) / ((b["ts"] - a["ts"]) / 1000.0))),
    "idelta": lambda s: _last_two(s, lambda a, b: b["value"] - a["value"]),
    "changes": lambda s: _pairs(s, lambda a, b: F.when(a != b, F.lit(1.0)).otherwise(F.lit(0.0))),
    "resets": lambda s: _pairs(s, lambda a, b: F.when(b < a, F.lit(1.0)).otherwise(F.lit(0.0))),
    "holt_winters": _smoothed,
}

_ELEMENT = {n: getattr(F, n) for n in ("abs", "ceil", "floor", "sqrt", "log2", "log10", "exp", "acos", "asin", "atan", "cos", "sin", "tan", "cosh", "sinh", "tanh")} | {
    "ln": lambda v: F.log(v),
    "deg": F.degrees,
    "rad": F.radians,
    "sgn": F.signum,
    "round": lambda v, to=None: F.floor(v + 0.5) if to is None else F.floor(v / to + 0.5) * to,
    "clamp": lambda v, a, b: F.greatest(a, F.least(b, v)),
    "clamp_min": lambda v, a: F.greatest(v, a),
    "clamp_max": lambda v, b: F.least(v, b),
    "minute": lambda v: F.minute(F.timestamp_seconds(v)),
    "hour": lambda v: F.hour(F.timestamp_seconds(v)),
    "day_of_week": lambda v: F.dayofweek(F.timestamp_seconds(v)) - 1,
    "day_of_month": lambda v: F.dayofmonth(F.timestamp_seconds(v)),
    "month": lambda v: F.month(F.timestamp_seconds(v)),
    "year": lambda v: F.year(F.timestamp_seconds(v)),
}


def query_range(samples: DataFrame, text: str, start: int, end: int, step: int, lookback: int = LOOKBACK) -> DataFrame:
    """labels, step, value at every step from start to end (milliseconds)."""
    return Compiler(samples, start, end, step, lookback).vector(P.parse(text)).df


def query(samples: DataFrame, text: str, at: int, lookback: int = LOOKBACK) -> DataFrame:
    return query_range(samples, text, at, at, 1, lookback).select("labels", "value")


def shown(labels: Column | str) -> Column:
    """Labels as text: a="x",b="y"."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.array_join(F.transform(c, lambda x: F.concat(x["k"], F.lit('="'), x["v"], F.lit('"'))), ",")
