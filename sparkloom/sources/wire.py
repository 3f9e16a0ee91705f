"""Binary and line protocols, decoded in Arrow batches: Prometheus remote write and read (Snappy and
protocol buffers) and Redis requests and replies."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = "map<string,string>"


# Snappy and protocol buffers


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _as_varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def snappy_decoded(data: bytes) -> bytes:
    size, at = _varint(data, 0)
    out = bytearray()
    while at < len(data):
        tag = data[at]
        at += 1
        kind = tag & 3
        if kind == 0:
            n = tag >> 2
            if n >= 60:
                more = n - 59
                n = int.from_bytes(data[at : at + more], "little")
                at += more
            out += data[at : at + n + 1]
            at += n + 1
            continue
        if kind == 1:
            n, back = (tag >> 2 & 7) + 4, tag >> 5 << 8 | data[at]
            at += 1
        else:
            width = 2 if kind == 2 else 4
            n, back = (tag >> 2) + 1, int.from_bytes(data[at : at + width], "little")
            at += width
        if not 0 < back <= len(out):
            raise ValueError("a copy reaches before the start")
        for _ in range(n):  # a copy may overlap itself
            out.append(out[-back])
    if len(out) != size:
        raise ValueError("a block is cut short")
    return bytes(out)


def snappy_encoded(data: bytes) -> bytes:
    """As literals alone, which every reader takes."""
    out = bytearray(_as_varint(len(data)))
    for i in range(0, len(data), 65536):
        part = data[i : i + 65536]
        out += bytes([61 << 2]) + (len(part) - 1).to_bytes(2, "little") + part
    return bytes(out)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message: integers, or bytes of the other kinds."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def message(*parts: tuple[int, int | float | bytes | str]) -> bytes:
    out = bytearray()
    for number, value in parts:
        if isinstance(value, float):
            out += _as_varint(number << 3 | 1) + struct.pack("<d", value)
        elif isinstance(value, int):
            out += _as_varint(number << 3) + _as_varint(value)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += _as_varint(number << 3 | 2) + _as_varint(len(data)) + data
    return bytes(out)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _series(data: bytes) -> tuple[dict[str, str], list[tuple[int, float]]]:
    labels, samples = {}, []
    for number, value in fields(data):
        own = dict(fields(value))
        if number == 1:
            labels[own.get(1, b"").decode()] = own.get(2, b"").decode()
        elif number == 2:
            samples.append((_signed(own.get(2, 0)), struct.unpack("<d", own.get(1, bytes(8)))[0]))
    return labels, samples


def remote_write(requests: DataFrame, column: str = "body") -> DataFrame:
    """metric, labels, ts (ms), value of every sample of Prometheus write requests (a Snappy block
    each)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for body in x[column]:
                for number, value in fields(snappy_decoded(bytes(body))):
                    if number == 1:
                        labels, samples = _series(value)
                        name = labels.pop("__name__", None)
                        out += [(name, labels, ts, v) for ts, v in samples]
            yield pd.DataFrame(out, columns=["metric", "labels", "ts", "value"])

    return requests.select(column).mapInPandas(run, f"metric string, labels {LABELS}, ts long, value double")


def _grouped(samples: DataFrame, most: int) -> DataFrame:
    """A row for each series and stretch of ``most`` samples: metric, labels (sorted entries), points."""
    entries = F.array_sort(F.map_entries("labels"))
    keyed = samples.select("metric", entries.alias("labels"), F.struct("ts", "value").alias("p"))
    part = F.pmod(F.xxhash64("p"), F.greatest(F.lit(1), F.ceil(F.col("n") / most)))
    sizes = keyed.groupBy("metric", "labels").agg(F.count("*").alias("n"))
    return keyed.join(sizes, ["metric", "labels"]).withColumn("part", part).groupBy("metric", "labels", "part").agg(F.array_sort(F.collect_list("p")).alias("points"))


def remote_write_requests(samples: DataFrame, most: int = 10_000) -> DataFrame:
    """samples(metric, labels, ts, value) as write requests (body): a series each, cut where it has
    over about ``most`` samples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for metric, labels, points in zip(x["metric"], x["labels"], x["points"], strict=True):
                pairs = sorted([("__name__", metric), *((e["key"], e["value"]) for e in labels)])
                series = message(*((1, message((1, k), (2, v))) for k, v in pairs), *((2, message((1, float(p["value"])), (2, int(p["ts"])))) for p in points))
                out.append(snappy_encoded(message((1, series))))
            yield pd.DataFrame({"body": out})

    return _grouped(samples, most).mapInPandas(run, "body binary")


_MATCH = {0: lambda c, v: c == v, 1: lambda c, v: c != v, 2: lambda c, v: c.rlike(f"^(?:{v})$"), 3: lambda c, v: ~c.rlike(f"^(?:{v})$")}


def remote_read(request: bytes, samples: DataFrame) -> DataFrame:
    """Samples that a read request (a Snappy block) asks for: query (its number), metric, labels, ts,
    value."""
    out = None
    for number, value in fields(snappy_decoded(request)):
        if number != 1:
            continue
        own = list(fields(value))
        span = dict((n, v) for n, v in own if n in (1, 2))
        rows = samples.filter(F.col("ts").between(_signed(span.get(1, 0)), _signed(span.get(2, 0))))
        for m in (dict(fields(v)) for n, v in own if n == 3):
            name, want = m.get(2, b"").decode(), m.get(3, b"").decode()
            c = F.col("metric") if name == "__name__" else F.coalesce(F.col("labels")[name], F.lit(""))
            rows = rows.filter(_MATCH[m.get(1, 0)](c, want))
        n = 0 if out is None else n + 1
        rows = rows.select(F.lit(n).alias("query"), "metric", "labels", "ts", "value")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("a read request has a query")
    return out


def read_request(start: int, end: int, matchers: list[tuple[str, str, str]]) -> bytes:
    """A read request of one query; matchers: (label, =, !=, =~ or !~, value)."""
    kinds = {"=": 0, "!=": 1, "=~": 2, "!~": 3}
    query = message((1, start), (2, end), *((3, message((1, kinds[op]), (2, name), (3, value))) for name, op, value in matchers))
    return snappy_encoded(message((1, query)))


# Redis


def commands(data: bytes) -> list[list[str]]:
    """The requests of a stream of arrays of bulk strings."""
    out, at = [], 0

    def line() -> bytes:
        nonlocal at
        end = data.index(b"\r\n", at)
        got, at = data[at:end], end + 2
        return got

    while at < len(data):
        head = line()
        if head[:1] != b"*":
            out.append(head.decode().split())  # an inline request
            continue
        own = []
        for _ in range(int(head[1:])):
            n = int(line()[1:])
            own.append(data[at : at + n].decode())
            at += n + 2
        out.append(own)
    return out


def resp_commands(streams: DataFrame, column: str = "body") -> DataFrame:
    """at (the request's place), command (upper case) and args of the requests in each stream; the
    other columns are kept."""
    kept = [c for c in streams.columns if c != column]

    @F.pandas_udf("array<struct<at:int,command:string,args:array<string>>>")
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([[{"at": i, "command": c[0].upper(), "args": c[1:]} for i, c in enumerate(commands(bytes(b))) if c] for b in bodies])

    return streams.select(*kept, F.explode(run(column)).alias("c")).select(*kept, "c.*")


def resp_request(*args) -> bytes:
    parts = [str(a).encode() for a in args]
    return b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%b\r\n" % (len(p), p) for p in parts)


def resp_reply(value):
    """A reply of a column's values: bulk strings, integers, or nil."""
    kind = value if not isinstance(value, str) else F.col(value)
    text = kind.cast("string")
    bulk = F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit("\r\n"), text, F.lit("\r\n"))
    number = F.concat(F.lit(":"), text, F.lit("\r\n"))
    return F.when(kind.isNull(), F.lit("$-1\r\n")).when(F.typeof(kind).isin("int", "bigint", "smallint", "tinyint"), number).otherwise(bulk)
