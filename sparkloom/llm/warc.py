"""WARC archives as tables of chunks.

An archive is a Parquet table: a row for each chunk of a record, with the record's
identifier, the chunk's number, whether it is the last, and the SHA-1 of the payload up to
its end.  A record's chunks in order are its bytes, a WARC 1.1 record; all chunks in order
are a WARC file, which ``export`` writes.  Python holds a chunk at a time on either side:
``write`` gets a payload cut into chunks by Spark, ``read`` hashes chunks as they come and
holds each against the digest that it carries.  A record that a split of the files cuts is
read again, by itself, in order of its chunks.  (Spark holds a page's html, a value of
the input table, as it does whatever reads it.)

Of records with equal payloads, the one with the largest page_id is the response; the
others are revisits, which have headers alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK = 256 << 10
_END = b"\r\n\r\n"
#: Names of record identifiers: urn:uuid from the page.
_SPACE = uuid.UUID("5d1f6f0e-6b0b-5b5e-9a3b-6f2f6b6f7761")


def record_urn(page_id) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}"


def header(page_id, url: str | None, size: int, digest: str, refers_to) -> bytes:
    """The WARC header of a page; refers_to: the page whose response has its payload."""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_urn(page_id)}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("X-Page-ID", str(page_id))]
    if url:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "%20" for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_urn(refers_to)}>"), ("X-Refers-To-Page", str(refers_to)), ("X-Payload-Length", str(size))]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(size if refers_to is None else 0))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


class RecordReader:
    """Reads a record's chunks in order: header fields, then payload size and SHA-1."""

    def __init__(self) -> None:
        self.fields: dict[str, str] | None = None
        self.left, self.size, self.sha, self.head = 0, 0, hashlib.sha1(usedforsecurity=False), b""
        self.tail = b""

    def feed(self, data: bytes, digest: bytes | None = None) -> None:
        """digest: the payload's SHA-1 up to here, if known."""
        if self.fields is None:
            self.head += data
            cut = self.head.find(_END)
            if cut < 0:
                return
            lines = self.head[:cut].decode("utf-8").split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"no WARC record: {lines[0]!r}")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            self.left = int(self.fields["Content-Length"])
            data, self.head = self.head[cut + 4 :], b""
        part = data[: self.left]
        self.sha.update(part)
        self.size += len(part)
        self.left -= len(part)
        self.tail += data[len(part) :]
        if digest is not None and self.fields["WARC-Type"] == "response" and self.sha.digest() != digest:
            raise ValueError(f"payload of {self.fields['WARC-Record-ID']} has another digest after {self.size} bytes")

    def finish(self) -> tuple:
        """page, payload bytes, payload digest, type and page referred to, checked."""
        f = self.fields
        if f is None or self.left or self.tail != _END:
            raise ValueError("a WARC record is cut short")
        digest = base64.b32encode(self.sha.digest()).decode()
        said = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response" and said != digest:
            raise ValueError(f"payload of {f['WARC-Record-ID']} has another digest")
        size = self.size if f["WARC-Type"] == "response" else int(f["X-Payload-Length"])
        return f["X-Page-ID"], size, said, f["WARC-Type"], f.get("X-Refers-To-Page")


def write(pages: DataFrame, path: str, chunk: int = CHUNK, least: int = 0) -> None:
    """Writes the archive of pages(page_id, url, html) to the folder ``path``.

    Payload: the html in UTF-8; null is empty.  Payloads of under ``least`` bytes are all
    responses, as are those of pages without an id.  Of rows with the same page_id and payload one is the response: that of
    the least url, nulls first.  Which payloads are equal is found from digests; a digest that very many
    pages share is salted.  The pages that share payloads are a table of ids, which is
    broadcast if it is below the session's threshold; else the html is shuffled by page_id
    once.  Other columns aren't read; an empty table gives an archive without rows."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"))
    size = F.octet_length("html")
    keyed = base.filter((size >= least) & F.col("page_id").isNotNull()).select("page_id", F.unhex(F.sha1("html")).alias("digest"))
    groups = keyed.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    groups = common.written(groups, "payload_groups")
    n = pages.count()
    roles = common.salted_join(keyed, groups, "digest", "n", n, F.col("page_id")).filter("keeper is not null")
    # one row a page that revisits; rows that repeat the keeper's page_id revisit it but for one, see below
    roles = common.written(roles.groupBy("page_id", "digest").agg(F.max("keeper").alias("keeper"), F.count("*").alias("same")), "revisits")
    rows = base.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("size", size)
    of_role = roles.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "keeper", "same")
    rows = rows.join(of_role, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    again = (F.col("same") > 1) & (F.col("page_id") == F.col("keeper"))
    refers = F.when(F.col("page_id") != F.col("keeper"), F.col("keeper"))
    fields = ["page_id", "url", "payload", "size", "digest", "refers_to"]
    out = rows.filter(~F.coalesce(again, F.lit(False))).select("page_id", "url", F.when(refers.isNull(), F.col("html").cast("binary")).alias("payload"), "size", "digest", refers.alias("refers_to"))
    if not roles.filter(again).isEmpty():
        # a keeper with repeated rows: its response is made from any of them, its revisits from counts
        alike = rows.filter(again)
        urls = common.written(alike.groupBy("page_id", "digest", "url").agg(F.first("size").alias("size"), F.count("*").alias("n")), "repeated_urls")
        order = F.struct(F.col("url").isNotNull().alias("some"), "url")
        least_url = urls.groupBy(F.col("page_id").alias("_page"), F.col("digest").alias("_digest")).agg(F.min(order)["url"].alias("_url"))
        same = (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest"))
        payload = alike.groupBy("page_id", "digest", "size").agg(F.first(F.col("html").cast("binary")).alias("payload"))
        response = payload.join(least_url, same).select("page_id", F.col("_url").alias("url"), "payload", "size", "digest", F.lit(None).cast("long").alias("refers_to"))
        left = F.col("n") - F.when(F.col("url").eqNullSafe(F.col("_url")), 1).otherwise(0)
        starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("left") - 1, F.lit(10_000).cast("long"))).alias("start")
        spread = urls.join(least_url, same).withColumn("left", left).filter("left > 0").select("page_id", "url", "size", "digest", "left", starts).repartition("page_id", "url", "start")
        revisit = spread.withColumn("_at", F.explode(F.sequence(F.col("start"), F.least(F.col("left"), F.col("start") + 10_000) - 1)))
        revisit = revisit.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "size", "digest", F.col("page_id").alias("refers_to"))
        out = out.unionByName(response.select(fields)).unionByName(revisit)
    # payloads reach Python in chunks
    parts = F.greatest(F.ceil(F.coalesce(F.octet_length("payload"), F.lit(0)) / F.lit(chunk)), F.lit(1)).cast("int")
    out = out.withColumn("chunk", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("last", F.col("chunk") == parts - 1)
    out = out.withColumn("payload", F.substring("payload", F.col("chunk") * F.lit(chunk) + 1, F.lit(chunk)))
    out = out.select("page_id", "url", "payload", "size", "digest", "refers_to", "chunk", "last")
    common.bounded_batches(pages.sparkSession, rows=200)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, records, record, sha = TaskContext.get().partitionId(), 0, "", hashlib.sha1(usedforsecurity=False)
        for x in frames:
            out = []
            for p, url, payload, n, digest, ref, k, last in zip(x["page_id"], x["url"], x["payload"], x["size"], x["digest"], x["refers_to"], x["chunk"], x["last"], strict=True):
                page = "" if pd.isna(p) else int(p)
                to = None if pd.isna(ref) else int(ref)
                data, head = b"" if payload is None else bytes(payload), b""
                if k == 0:  # a record's chunks come one after another
                    name = base64.b32encode(bytes(digest)).decode()
                    head, sha = header(page, url, int(n), name, to), hashlib.sha1(usedforsecurity=False)
                    record = uuid.uuid5(_SPACE, f"{page} {name} {url} {task} {records}").hex
                    records += 1
                sha.update(data)
                if last and to is None and sha.digest() != bytes(digest):
                    raise ValueError(f"payload of page {page} has another digest")
                out.append((record, k, head + data + (_END if last else b""), bool(last), sha.digest()))
            yield pd.DataFrame(out, columns=["record", "chunk", "data", "last", "digest"])

    out.mapInPandas(run, "record string, chunk int, data binary, last boolean, digest binary").write.mode("error").parquet(path)


def read(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of an
    archive's chunk table.

    A task parses the records whose chunks it has from first to last.  Of a record that is cut
    it gives the identifier, and its chunks are read again by record.  A chunk whose payload
    hasn't the digest that it carries, and a record that is cut short, are errors."""
    common.bounded_batches(archive.sparkSession, rows=200)
    fields = "record string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    names = [f.split()[0] for f in fields.split(", ")]
    archive = archive.select("record", "chunk", "data", "last", "digest")

    def parse(frames: Iterator[pd.DataFrame], cut_ok: bool) -> Iterator[pd.DataFrame]:
        own, at, reader = None, 0, RecordReader()
        for x in frames:
            out = []
            for record, chunk, data, last, digest in zip(x["record"], x["chunk"], x["data"], x["last"], x["digest"], strict=True):
                if own is not None and (record != own or chunk != at):  # its other chunks are elsewhere
                    out.append((own, *[None] * 5))
                    own = None
                if chunk == 0:
                    own, at, reader = record, 0, RecordReader()
                if own is None:
                    continue
                reader.feed(bytes(data), bytes(digest))
                at += 1
                if last:
                    out.append((None, *reader.finish()))
                    own = None
            yield pd.DataFrame(out, columns=names)
        if own is not None:
            if not cut_ok:
                raise ValueError("a WARC record is cut short")
            yield pd.DataFrame([(own, *[None] * 5)], columns=names)

    parsed = common.written(archive.mapInPandas(lambda frames: parse(frames, True), fields), "parsed")
    whole = parsed.filter(F.col("record").isNull())
    cut = parsed.filter(F.col("record").isNotNull()).select(F.col("record").alias("_cut"))
    n = cut.count()  # one a split of the files, unless rows were dealt anew
    if n:
        ids = F.broadcast(cut) if n <= 100_000 else cut
        again = archive.join(ids, F.col("record") == F.col("_cut"), "left_semi")
        whole = whole.unionByName(again.repartition("record").sortWithinPartitions("record", "chunk").mapInPandas(lambda frames: parse(frames, False), fields))
    as_long = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long").alias(c)
    return whole.select(as_long("page_id"), "payload_bytes", "payload_digest", "record_type", as_long("refers_to"))


def export(archive: DataFrame, file) -> int:
    """Writes an archive as a WARC file to a binary file object, record by record through the
    driver without collecting; for looking at small archives.  Returns the bytes."""
    n = 0
    for row in archive.orderBy("record", "chunk").select("data").toLocalIterator():
        n += file.write(bytes(row["data"]))
    return n


def round_trip(pages: DataFrame, chunk: int = CHUNK, least: int = 0) -> DataFrame:
    """Writes an archive, which is deleted when the driver ends, and reads it."""
    spark = pages.sparkSession
    path = common.fresh_path(spark, "archive")
    write(pages, path, chunk, least)
    return read(spark.read.parquet(path))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.read(spark, sf_dir, "pages"))


#: Base32 of the hex digest, five bits at a time.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keeper FROM p),
b AS (SELECT *, array_to_string([lpad(bin(strpos('0123456789abcdef', x[i]) - 1), 4, '0') FOR i IN range(1, 41)], '') AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(list_sum([CAST(bits[5 * i + 1 + k] AS INT) * (16 >> k) FOR k IN range(5)]) AS INT)] FOR i IN range(32)], '') AS payload_digest,
CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM b
"""
