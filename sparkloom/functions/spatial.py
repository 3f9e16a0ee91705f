"""Spatial functions.  Points and distances are Column expressions on longitude and latitude;
other geometries are WKT or GeoJSON texts, read by Arrow-batched functions in planar degrees.
Distances are metres on a sphere of radius 6371000."""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.shared import written

RADIUS = 6_371_000.0
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Points


def haversine(lng1, lat1, lng2, lat2) -> Column:
    a1, a2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dl = F.radians(_col(lng2)) - F.radians(_col(lng1))
    s = lambda x: F.sin(x / 2) * F.sin(x / 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), s(a2 - a1) + F.cos(a1) * F.cos(a2) * s(dl))))


def bearing(lng1, lat1, lng2, lat2) -> Column:
    """Degrees from north, 0 to 360."""
    a1, a2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dl = F.radians(_col(lng2)) - F.radians(_col(lng1))
    b = F.degrees(F.atan2(F.sin(dl) * F.cos(a2), F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(dl)))
    return F.pmod(b + 360.0, F.lit(360.0))


def point(lng, lat) -> Column:
    return F.concat(F.lit("POINT("), _col(lng).cast("string"), F.lit(" "), _col(lat).cast("string"), F.lit(")"))


def line(points: Column | str) -> Column:
    """A line string of an array of structs (lng, lat)."""
    pairs = F.transform(_col(points), lambda p: F.concat(p["lng"].cast("string"), F.lit(" "), p["lat"].cast("string")))
    return F.concat(F.lit("LINESTRING("), F.array_join(pairs, ", "), F.lit(")"))


def polygon(points: Column | str) -> Column:
    """A polygon of one ring, closed where the array of structs (lng, lat) isn't."""
    c = _col(points)
    ring = F.when(c[0] == F.element_at(c, -1), c).otherwise(F.concat(c, F.array(c[0])))
    pairs = F.transform(ring, lambda p: F.concat(p["lng"].cast("string"), F.lit(" "), p["lat"].cast("string")))
    return F.concat(F.lit("POLYGON(("), F.array_join(pairs, ", "), F.lit("))"))


def box(west, south, east, north) -> Column:
    w, s, e, n = (_col(c).cast("string") for c in (west, south, east, north))
    corners = [(w, s), (e, s), (e, n), (w, n), (w, s)]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *(F.concat_ws(" ", x, y) for x, y in corners)), F.lit("))"))


def st_circle(lng, lat, metres: float, sides: int = 32) -> Column:
    return st_buffer(point(lng, lat), metres, sides)


_NUMBER = r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"


def _json(c: Column) -> Column:
    return F.ltrim(c).startswith("{")


def _coordinate(a, i: int) -> Column:
    """A point's coordinate from its WKT or GeoJSON text, in generated code."""
    c = _col(a)
    wkt_ = F.regexp_extract(c, rf"(?i)^\s*POINT\s*\(\s*({_NUMBER})\s+({_NUMBER})", i + 1)
    own = F.coalesce(F.get_json_object(c, f"$.coordinates[{i}]"), F.get_json_object(c, f"$.geometry.coordinates[{i}]"))
    return F.when(_json(c), own.try_cast("double")).otherwise(wkt_.try_cast("double"))


def x_of(a) -> Column:
    """The longitude of a point; null of other geometries."""
    return _coordinate(a, 0)


def y_of(a) -> Column:
    return _coordinate(a, 1)


def geohash(lng, lat, size: int) -> Column:
    """Base-32 geohash of ``size`` characters: bits of longitude and latitude in turn, computed
    as whole numbers of cells, so that it stays in generated code."""
    n = 5 * size
    xbits, ybits = (n + 1) // 2, n // 2
    cell = lambda v, low, span, bits: F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor((v - low) / span * float(1 << bits)))).cast("long")
    x, y = cell(_col(lng), -180.0, 360.0, xbits), cell(_col(lat), -90.0, 180.0, ybits)
    out = []
    for c in range(size):
        digit = F.lit(0).cast("long")
        for b in range(5):
            i = 5 * c + b  # bit from the highest; even ones are of the longitude
            v, k = (x, xbits - 1 - i // 2) if i % 2 == 0 else (y, ybits - 1 - i // 2)
            digit = digit * 2 + F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long"))
        out.append(F.substring(F.lit(_BASE32), (digit + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def geohash_bounds(code: str) -> tuple[float, float, float, float]:
    """west, south, east, north of a geohash."""
    lo, hi = [-180.0, -90.0], [180.0, 90.0]
    for i, bit in enumerate(b for c in code for b in f"{_BASE32.index(c):05b}"):
        d = i % 2
        mid = (lo[d] + hi[d]) / 2
        (lo if bit == "1" else hi)[d] = mid
    return lo[0], lo[1], hi[0], hi[1]


def _encode(lng: float, lat: float, size: int) -> str:
    n = 5 * size
    xb, yb = (n + 1) // 2, n // 2
    cell = lambda v, low, span, bits: max(0, min((1 << bits) - 1, int((v - low) / span * (1 << bits))))
    x, y = cell(lng, -180.0, 360.0, xb), cell(lat, -90.0, 180.0, yb)
    bits = "".join(str((x >> (xb - 1 - i // 2) if i % 2 == 0 else y >> (yb - 1 - i // 2)) & 1) for i in range(n))
    return "".join(_BASE32[int(bits[i : i + 5], 2)] for i in range(0, n, 5))


def _neighbors(code: str) -> list[str]:
    w, s, e, n = geohash_bounds(code)
    x, y, dx, dy = (w + e) / 2, (s + n) / 2, e - w, n - s
    out = []
    for j in (1, 0, -1):
        for i in (-1, 0, 1):
            if (i or j) and -90 < y + j * dy < 90:
                out.append(_encode((x + i * dx + 180) % 360 - 180, y + j * dy, len(code)))
    return out


# Geometries: {"type": .., "coordinates": ..} as in GeoJSON


def parse(text: str) -> dict:
    """A geometry from WKT or GeoJSON."""
    text = text.strip()
    if text[:1] == "{":
        g = json.loads(text)
        return g["geometry"] if g.get("type") == "Feature" else g
    m = re.fullmatch(r"([A-Za-z]+)\s*(\(.*\)|EMPTY)", text, re.S)
    if not m:
        raise ValueError(f"no geometry: {text[:40]!r}")
    kind = {k.upper(): k for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}[m[1].upper()]
    body = "[]" if m[2] == "EMPTY" else re.sub(r"([-+.\deE]+)\s+([-+.\deE]+)", r"[\1,\2]", m[2]).replace("(", "[").replace(")", "]")
    c = json.loads(body)
    if kind == "Point":
        c = c[0]
    if kind == "MultiPoint":
        c = [p[0] if isinstance(p[0], list) else p for p in c]
    return {"type": kind, "coordinates": c}


def wkt(g: dict) -> str:
    num = lambda v: repr(float(v)).removesuffix(".0")
    point_ = lambda p: f"{num(p[0])} {num(p[1])}"
    nest = lambda c: point_(c) if not isinstance(c[0], list) else "(" + ", ".join(map(nest, c)) + ")"
    c = g["coordinates"]
    return g["type"].upper() + (" EMPTY" if not c else f" ({point_(c)})" if g["type"] == "Point" else " " + nest(c))


def _parts(g: dict) -> tuple[list, list, list]:
    """points, lines and polygons of a geometry."""
    c, k = g["coordinates"], g["type"]
    return {"Point": lambda: ([c], [], []), "MultiPoint": lambda: (c, [], []), "LineString": lambda: ([], [c], []), "MultiLineString": lambda: ([], c, []), "Polygon": lambda: ([], [], [c]), "MultiPolygon": lambda: ([], [], c)}[k]()


def _all_points(g: dict) -> list:
    p, lines, polys = _parts(g)
    return p + [x for line in lines for x in line] + [x for poly in polys for ring in poly for x in ring]


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _on(p, a, b) -> bool:
    return abs(_cross(a, b, p)) <= 1e-12 * (1 + abs(b[0] - a[0]) + abs(b[1] - a[1])) and min(a[0], b[0]) - 1e-12 <= p[0] <= max(a[0], b[0]) + 1e-12 and min(a[1], b[1]) - 1e-12 <= p[1] <= max(a[1], b[1]) + 1e-12


def _segments_meet(a, b, c, d) -> bool:
    s = lambda v: (v > 0) - (v < 0)
    o = [s(_cross(a, b, c)), s(_cross(a, b, d)), s(_cross(c, d, a)), s(_cross(c, d, b))]
    return (o[0] != o[1] and o[2] != o[3]) or _on(c, a, b) or _on(d, a, b) or _on(a, c, d) or _on(b, c, d)


def _edges(g: dict) -> list:
    _, lines, polys = _parts(g)
    rings = lines + [r for p in polys for r in p]
    return [(a, b) for r in rings for a, b in zip(r, r[1:], strict=False)]


def _ring_holds(ring, p) -> int:
    """1 inside, 0 on the border, -1 outside."""
    inside = False
    for a, b in zip(ring, ring[1:], strict=False):
        if _on(p, a, b):
            return 0
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return 1 if inside else -1


def _holds(poly, p, border: bool) -> bool:
    at = _ring_holds(poly[0], p)
    if at < 0 or (at == 0 and not border):
        return at == 0 and border
    for hole in poly[1:]:
        h = _ring_holds(hole, p)
        if h > 0 or (h == 0 and not border):
            return False
    return True


def _covers(g: dict, p, border: bool = True) -> bool:
    pts, lines, polys = _parts(g)
    return any(_holds(poly, p, border) for poly in polys) or any(tuple(q[:2]) == tuple(p[:2]) for q in pts) or any(_on(p, a, b) for line in lines for a, b in zip(line, line[1:], strict=False))


def intersects(a: dict, b: dict) -> bool:
    if any(_covers(a, p) for p in _all_points(b)) or any(_covers(b, p) for p in _all_points(a)):
        return True
    return any(_segments_meet(*s, *t) for s in _edges(a) for t in _edges(b))


def contains(a: dict, b: dict) -> bool:
    """Every point of b lies in a, and not all of b on a's border."""
    pts = _all_points(b)
    if not pts or not all(_covers(a, p) for p in pts):
        return False
    polys = _parts(a)[2]
    if not polys:
        return True
    for s in _edges(b):  # between crossings with a's borders, a piece of an edge is inside or outside
        cuts = {0.0, 1.0}
        for c, d in _edges(a):
            r, q = (s[1][0] - s[0][0], s[1][1] - s[0][1]), (d[0] - c[0], d[1] - c[1])
            det = r[0] * q[1] - r[1] * q[0]
            if abs(det) > 1e-18:
                u = ((c[0] - s[0][0]) * q[1] - (c[1] - s[0][1]) * q[0]) / det
                if 0 < u < 1:
                    cuts.add(u)
        at = sorted(cuts)
        mids = [(x + y) / 2 for x, y in zip(at, at[1:], strict=False)]
        if not all(_covers(a, (s[0][0] + m * (s[1][0] - s[0][0]), s[0][1] + m * (s[1][1] - s[0][1]))) for m in mids):
            return False
    if _parts(b)[0] and not _edges(b):
        return any(_covers(a, p, False) for p in pts)
    return True


def _metres(p, q) -> float:
    a1, a2 = math.radians(p[1]), math.radians(q[1])
    dl = math.radians(q[0] - p[0])
    h = math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin(dl / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def _to_segment(p, a, b) -> float:
    k = math.cos(math.radians(p[1]))
    dx, dy = (b[0] - a[0]) * k, b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * k * dx + (p[1] - a[1]) * dy) / n))
    return _metres(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def distance(a: dict, b: dict) -> float:
    """Metres between the nearest points, 0 if they meet."""
    if intersects(a, b):
        return 0.0
    best = math.inf
    for g, h in ((a, b), (b, a)):
        edges = _edges(h)
        for p in _all_points(g):
            for q in _parts(h)[0]:
                best = min(best, _metres(p, q))
            for s in edges:
                best = min(best, _to_segment(p, *s))
    return best


def length(g: dict) -> float:
    return sum(_metres(a, b) for a, b in _edges(g))


def area(g: dict) -> float:
    """Planar area in square degrees, holes taken off."""
    shoelace = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))) / 2
    return sum(shoelace(p[0]) - sum(map(shoelace, p[1:])) for p in _parts(g)[2])


def envelope(g: dict) -> dict:
    pts = _all_points(g)
    w, e = min(p[0] for p in pts), max(p[0] for p in pts)
    s, n = min(p[1] for p in pts), max(p[1] for p in pts)
    return {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}


def circle(lng: float, lat: float, metres: float, sides: int = 32) -> dict:
    d, a = metres / RADIUS, math.radians(lat)
    ring = []
    for i in range(sides):
        t = 2 * math.pi * i / sides
        y = math.asin(math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(t))
        x = math.radians(lng) + math.atan2(math.sin(t) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(y))
        ring.append([math.degrees(x), math.degrees(y)])
    return {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}


def buffer(g: dict, metres: float, sides: int = 32) -> dict:
    """A polygon around a point; for other geometries around their envelope's corners, convex."""
    if g["type"] == "Point":
        return circle(*g["coordinates"][:2], metres, sides)
    pts = sorted({tuple(p) for q in _all_points(g) for p in circle(*q[:2], metres, sides)["coordinates"][0]})
    chain: list = []
    for seq in (pts, pts[::-1]):
        half: list = []
        for p in seq:
            while len(half) > 1 and _cross(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        chain += half[:-1]
    return {"type": "Polygon", "coordinates": [[*map(list, chain), list(chain[0])]]}


def intersection(a: dict, b: dict) -> dict:
    """The part of polygon or line a that lies in the convex polygon b, or a point of a in b."""
    if a["type"] == "Point":
        return a if _covers(b, a["coordinates"]) else {"type": "Point", "coordinates": []}
    ring = b["coordinates"][0]
    if sum(x[0] * y[1] - y[0] * x[1] for x, y in zip(ring, ring[1:], strict=False)) < 0:
        ring = ring[::-1]
    out = a["coordinates"][0][:-1]
    for c, d in zip(ring, ring[1:], strict=False):
        new = []
        for p, q in zip(out, out[1:] + out[:1], strict=True):
            u, v = _cross(c, d, p), _cross(c, d, q)
            if u >= 0:
                new.append(p)
            if (u > 0 > v) or (u < 0 < v):
                t = u / (u - v)
                new.append([p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])])
        out = new
    return {"type": "Polygon", "coordinates": [[*out, out[0]]] if out else []}


def union(a: dict, b: dict) -> dict:
    """Collected, not dissolved: parts of both as one multi-geometry."""
    parts = [_parts(g) for g in (a, b)]
    for i, kind in ((2, "MultiPolygon"), (1, "MultiLineString"), (0, "MultiPoint")):
        own = [x for p in parts for x in p[i]]
        if own and not any(p[j] for p in parts for j in range(3) if j != i):
            return {"type": kind, "coordinates": own}
    raise ValueError("geometries of one kind are collected")


def is_valid(g: dict) -> bool:
    """Rings are closed, of four points at least, and don't cross themselves."""
    for poly in _parts(g)[2]:
        for r in poly:
            if len(r) < 4 or r[0] != r[-1]:
                return False
            e = list(zip(r, r[1:], strict=False))
            for i in range(len(e)):
                for j in range(i + 2, len(e)):
                    if (i, j) != (0, len(e) - 1) and _segments_meet(*e[i], *e[j]):
                        return False
    return all(len(line) > 1 for line in _parts(g)[1])


def _udf(f, kind: T.DataType, *cols: Column | str) -> Column:
    """An Arrow-batched function of geometry texts; null in, null out; each text of a batch is
    read once."""

    @F.pandas_udf(kind)
    def run(*xs: pd.Series) -> pd.Series:
        known: dict[str, dict] = {}

        def read(v):
            if not isinstance(v, str):
                return v
            if v not in known:
                known[v] = parse(v)
            return known[v]

        return pd.Series([None if any(v is None for v in row) else f(*map(read, row)) for row in zip(*xs, strict=True)], dtype="object")

    return run(*map(_col, cols))


def st_intersects(a, b) -> Column:
    return _udf(intersects, T.BooleanType(), a, b)


def st_disjoint(a, b) -> Column:
    return ~st_intersects(a, b)


def st_contains(a, b) -> Column:
    return _udf(contains, T.BooleanType(), a, b)


def st_holds(shape, lng, lat, border: bool = False) -> Column:
    """st_contains of a point given by its coordinates: a batch's points are held against each different
    shape at once.  With ``border``, points on it are held too (a hole's border as well)."""

    @F.pandas_udf(T.BooleanType())
    def run(shapes: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = np.full(len(shapes), None, object)
        x, y = xs.to_numpy(np.float64, na_value=np.nan), ys.to_numpy(np.float64, na_value=np.nan)
        known = shapes.notna().to_numpy() & ~np.isnan(x) & ~np.isnan(y)
        for text, at in pd.Series(np.flatnonzero(known)).groupby(shapes.to_numpy()[known]):
            g, i = parse(text), at.to_numpy()
            polys = _parts(g)[2]
            if polys:
                out[i] = np.any([_inside(p, x[i], y[i], border) for p in polys], axis=0)
            else:
                holds = _covers if border else lambda g, p: contains(g, {"type": "Point", "coordinates": p})
                out[i] = [holds(g, [a, b]) for a, b in zip(x[i], y[i], strict=True)]
        return pd.Series(out)

    return run(_col(shape), _col(lng), _col(lat))


def st_covers(shape, lng, lat) -> Column:
    """Whether a point given by its coordinates is in a shape or on its border."""
    return st_holds(shape, lng, lat, True)


def _inside(poly: list, x: np.ndarray, y: np.ndarray, border: bool) -> np.ndarray:
    """Points inside a polygon, not in its holes; those on borders as ``border`` says.  An edge along an axis
    is met exactly, a slanted one within rounding."""
    odd, on = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ring in poly:
        for (ax, ay, *_), (bx, by, *_) in zip(ring, ring[1:], strict=False):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            slack = 0.0 if border and (ax == bx or ay == by) else 1e-12
            near = np.abs(cross) <= slack * (1 + abs(bx - ax) + abs(by - ay))
            on |= near & (min(ax, bx) - slack <= x) & (x <= max(ax, bx) + slack) & (min(ay, by) - slack <= y) & (y <= max(ay, by) + slack)
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd | on if border else odd & ~on


def st_within(a, b) -> Column:
    return st_contains(b, a)


def st_distance(a, b) -> Column:
    return _udf(distance, T.DoubleType(), a, b)


def st_dwithin(a, b, metres: float) -> Column:
    return st_distance(a, b) <= metres


def st_length(a) -> Column:
    return _udf(length, T.DoubleType(), a)


def st_area(a) -> Column:
    return _udf(area, T.DoubleType(), a)


def st_envelope(a) -> Column:
    return _udf(lambda g: wkt(envelope(g)), T.StringType(), a)


def st_buffer(a, metres: float, sides: int = 32) -> Column:
    return _udf(lambda g: wkt(buffer(g, metres, sides)), T.StringType(), a)


def st_intersection(a, b) -> Column:
    return _udf(lambda g, h: wkt(intersection(g, h)), T.StringType(), a, b)


def st_union(a, b) -> Column:
    return _udf(lambda g, h: wkt(union(g, h)), T.StringType(), a, b)


def as_wkt(a) -> Column:
    return _udf(wkt, T.StringType(), a)


def as_geojson(a) -> Column:
    return _udf(lambda g: json.dumps({"type": g["type"], "coordinates": g["coordinates"]}), T.StringType(), a)


_KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


def geometry_type(a) -> Column:
    c = _col(a)
    name = F.upper(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    wkt_ = F.coalesce(*(F.when(name == k.upper(), F.lit(k)) for k in _KINDS))
    return F.when(_json(c), F.coalesce(F.get_json_object(c, "$.geometry.type"), F.get_json_object(c, "$.type"))).otherwise(wkt_)


def num_points(a) -> Column:
    c = _col(a)
    in_json = F.regexp_count(c, F.lit(rf"\[\s*{_NUMBER}\s*,\s*{_NUMBER}"))
    return F.when(_json(c), in_json).otherwise(F.regexp_count(c, F.lit(rf"{_NUMBER}\s+{_NUMBER}"))).cast("int")


def valid(a) -> Column:
    return _udf(is_valid, T.BooleanType(), a)


def _cells(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rows of geohashes of one size."""
    text = np.frombuffer("".join(codes).encode("latin-1", "replace"), np.uint8).reshape(-1, size)
    digits = _DIGITS[text]
    if (digits < 0).any():
        raise ValueError("no geohash")
    xy = [np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)]
    for b in range(5 * size):
        xy[b % 2] = xy[b % 2] * 2 + (digits[:, b // 5] >> (4 - b % 5) & 1)
    return xy[0], xy[1]


def _codes(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    n = 5 * size
    xb, yb = (n + 1) // 2, n // 2
    out = np.zeros((len(x), size), np.int64)
    for b in range(n):
        out[:, b // 5] = out[:, b // 5] * 2 + (x >> (xb - 1 - b // 2) & 1 if b % 2 == 0 else y >> (yb - 1 - b // 2) & 1)
    letters = np.frombuffer(_BASE32.encode(), np.uint8)[out]
    return np.ascontiguousarray(letters).view(f"S{size}").ravel().astype(str)


#: The digit of a character, -1 if it has none.
_DIGITS = np.full(256, -1, np.int64)
_DIGITS[np.frombuffer(_BASE32.encode(), np.uint8)] = np.arange(32)
#: Sizes whose cells are whole numbers of a long.
WHOLE = 12


def _by_size(x: pd.Series, f) -> pd.Series:
    """f(codes, size) of a batch's codes of each size at once; null and empty texts are left to f by themselves."""
    out = np.full(len(x), None, object)
    known = x.notna().to_numpy()
    sizes = x.str.len().where(known, 0).to_numpy().astype(int)
    for size in np.unique(sizes[known]):
        at = np.flatnonzero(known & (sizes == size))
        made = np.empty(len(at), object)
        made[:] = f(x.to_numpy()[at], int(size))
        out[at] = made
    return pd.Series(out)


def _around(codes: np.ndarray, size: int) -> list[list[str]]:
    if not 0 < size <= WHOLE:
        return [_neighbors(c) for c in codes]
    x, y = _cells(codes, size)
    xs, ys = 1 << (5 * size + 1) // 2, 1 << 5 * size // 2
    steps = [(i, j) for j in (1, 0, -1) for i in (-1, 0, 1) if i or j]
    found = np.stack([_codes((x + i) % xs, (y + j) % ys, size) for i, j in steps], axis=1).tolist()
    for r in np.flatnonzero((y == 0) | (y == ys - 1)):  # none beyond a pole
        found[r] = [c for c, (_, j) in zip(found[r], steps, strict=True) if 0 <= y[r] + j < ys]
    return found


def geohash_neighbors(code: Column | str) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(x: pd.Series) -> pd.Series:
        return _by_size(x, _around)

    return run(_col(code))


def _middles(codes: np.ndarray, size: int) -> list[tuple[float, float]]:
    if not 0 < size <= WHOLE:
        return [((w + e) / 2, (s + n) / 2) for w, s, e, n in map(geohash_bounds, codes)]
    x, y = _cells(codes, size)
    xs, ys = 1 << (5 * size + 1) // 2, 1 << 5 * size // 2
    return list(zip(((x + 0.5) * 360 / xs - 180).tolist(), ((y + 0.5) * 180 / ys - 90).tolist(), strict=True))


def geohash_decode(code: Column | str) -> Column:
    """struct(lng, lat) of the cell's middle."""

    @F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("lng", "lat")]))
    def run(x: pd.Series) -> pd.DataFrame:
        b = [p or (None, None) for p in _by_size(x, _middles)]
        return pd.DataFrame({"lng": [p[0] for p in b], "lat": [p[1] for p in b]}, dtype=float)

    return run(_col(code))


# Joins


#: Pairs that a task of near_join compares, about, and the most tasks.
PAIRS = 4_000_000
TASKS = 20_000


def near_join(points: DataFrame, others: DataFrame, metres: float) -> DataFrame:
    """points(lng, lat, ..) with each row of others(lng2, lat2, ..) within ``metres``, and
    ``distance``: an equi-join on cells at least that wide, a point against the cells around
    it, so that only neighbours are compared.  Each row of cells has as many columns as are wide
    enough at its latitudes, one around a pole."""
    dlat = math.degrees(metres / RADIUS) * 1.0001
    rows = lambda lat: F.floor(F.col(lat) / dlat).cast("long")

    def columns(row) -> Column:
        """How many cells the row has: a point of the rows beside it reaches over one at most."""
        far = F.greatest(F.abs((row - 1) * dlat), F.abs((row + 2) * dlat)) + dlat
        reach = F.degrees(F.asin(F.sin(F.lit(math.radians(dlat))) / F.cos(F.radians(F.least(far, F.lit(89.0)) - dlat))))
        return F.when(far >= 89.0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 / reach))).cast("long")

    place = lambda lng, n: F.floor((F.pmod(F.col(lng) + 180.0, F.lit(360.0))) / (360.0 / n)).cast("long")
    steps = [F.lit(i).cast("long") for i in (-1, 0, 1)]
    right = others.withColumn("_y", F.explode(F.array(*(rows("lat2") + i for i in steps)))).withColumn("_n", columns(F.col("_y")))
    right = right.withColumn("_x", F.explode(F.array_distinct(F.array(*(F.pmod(place("lng2", F.col("_n")) + i, F.col("_n")) for i in steps))))).drop("_n")
    left = points.withColumn("_y", rows("lat")).withColumn("_x", F.pmod(place("lng", columns(F.col("_y"))), columns(F.col("_y"))))
    d = haversine("lng", "lat", "lng2", "lat2")
    # a task compares some PAIRS pairs: partitions follow their number, and a cell of more has its points dealt to salts
    cell = ["_y", "_x"]
    sizes = left.groupBy(*cell).agg(F.count("*").alias("_l")).join(right.groupBy(*cell).agg(F.count("*").alias("_r")), cell)
    sizes = written(sizes.withColumn("_pairs", F.col("_l") * F.col("_r")), "cells")
    total = sizes.agg(F.sum("_pairs")).first()[0] or 0
    parts = min(TASKS, max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * total // PAIRS))
    hot = sizes.filter(F.col("_pairs") > PAIRS).select(*cell, F.ceil(F.col("_pairs") / PAIRS).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    left = left.join(hot, cell, "left").withColumn("_s", F.pmod(F.xxhash64(*points.columns), salts).cast("int")).drop("_salts")
    right = right.join(hot, cell, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    met = left.repartition(parts, *cell, "_s").join(right.repartition(parts, *cell, "_s"), [*cell, "_s"])
    return met.withColumn("distance", d).filter(F.col("distance") <= metres).drop("_x", "_y", "_s")


def region_join(points: DataFrame, regions: DataFrame, shape: str, cell: float = 1.0) -> DataFrame:
    """points(lng, lat, ..) with each region whose geometry holds the point, its border too: regions go to the
    grid cells of ``cell`` degrees that their envelopes meet, points to theirs."""

    @F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in "wsen"]))
    def box(x: pd.Series) -> pd.DataFrame:
        pts = [_all_points(parse(v)) for v in x]
        return pd.DataFrame({"w": [min(p[0] for p in q) for q in pts], "s": [min(p[1] for p in q) for q in pts], "e": [max(p[0] for p in q) for q in pts], "n": [max(p[1] for p in q) for q in pts]})

    at = lambda c: F.floor(c / cell).cast("long")
    r = regions.withColumn("_b", box(F.col(shape)))
    r = r.withColumn("_x", F.explode(F.sequence(at(F.col("_b.w")), at(F.col("_b.e"))))).withColumn("_y", F.explode(F.sequence(at(F.col("_b.s")), at(F.col("_b.n")))))
    p = points.withColumn("_x", at(F.col("lng"))).withColumn("_y", at(F.col("lat")))
    inside = F.col("lng").between(F.col("_b.w"), F.col("_b.e")) & F.col("lat").between(F.col("_b.s"), F.col("_b.n"))
    j = p.join(r, ["_x", "_y"]).filter(inside)
    return j.filter(st_covers(shape, "lng", "lat")).drop("_x", "_y", "_b")
