from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections import Counter

import pytest

from sparkloom.llm import common, warc

SCHEMA = "page_id long, url string, html string, digest string, size int, copy string, last int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "c", 2) for r in rows], SCHEMA).repartition(4)


def brute(rows, least=0):
    out = []
    keeper = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= least and p is not None:
            keeper[h or ""] = max(keeper.get(h or "", p), p)
    for p, _, h in rows:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        k = keeper.get(h or "") if len(data) >= least else None
        out.append((p, len(data), digest, "response" if k is None or k == p else "revisit", None if k is None or k == p else k))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a.example/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://ü b/\n", "<p>one</p>"), (4, "http://d", None), (9, "http://e", ""),
    (11, "u", "ä" * 400_000), (12, "u", "ä" * 400_000), (13, "u", "x" * (256 << 10)), (14, "", "\r\n\r\nWARC/1.1\r\n\r\n"), (15, "u", "\0퟿🙂"), (16, "u", "z" * ((256 << 10) - 400)),
]
ROWS += [(100 + i, f"http://m/{i}", "<p>one</p>") for i in range(200)]
names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("chunk,least", [(256 << 10, 0), (1000, 0), (1000, 5)])
def test_round_trip_equals_brute_force(spark, chunk, least):
    out = warc.round_trip(pages(spark, ROWS), chunk=chunk, least=least)
    assert out.columns == names
    assert sorted(map(tuple, out.collect()), key=repr) == brute(ROWS, least)


def test_records_cut_by_file_splits_are_joined(spark):
    path = f"{common.shared_dir(spark)}/{uuid.uuid4().hex}"
    warc.write(pages(spark, ROWS), path, chunk=500)
    torn = spark.read.parquet(path).repartition(13)
    assert sorted(map(tuple, warc.read(torn).collect()), key=repr) == brute(ROWS)


def test_the_archive_is_a_warc_file(spark):
    path = f"{common.shared_dir(spark)}/{uuid.uuid4().hex}"
    warc.write(pages(spark, ROWS), path, chunk=700)
    f = io.BytesIO()
    n = warc.export(spark.read.parquet(path), f)
    data, records = f.getvalue(), 0
    assert n == len(data)
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1") and rest[size : size + 4] == b"\r\n\r\n"
        if fields[b"WARC-Type"] == b"response":
            assert fields[b"WARC-Payload-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(rest[:size]).digest())
        data, records = rest[size + 4 :], records + 1
    assert records == len(ROWS)


def test_a_cut_or_changed_record_is_an_error(spark):
    path = f"{common.shared_dir(spark)}/{uuid.uuid4().hex}"
    warc.write(pages(spark, ROWS[:1]), path)
    rows = spark.read.parquet(path)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="another digest"):
        warc.read(rows.withColumn("data", F.expr("cast(replace(cast(data AS string), '>one<', '>owe<') AS binary)"))).collect()


def test_chunks_carry_running_digests_and_no_worker_holds_a_record(spark):
    big = "".join(chr(97 + i % 26) for i in range(1 << 20)) * 24  # 24 MB in chunks of 64 kB
    path = f"{common.shared_dir(spark)}/{uuid.uuid4().hex}"
    warc.write(pages(spark, [(1, "u", big), (2, "u", "small")]), path, chunk=64 << 10)
    rows = spark.read.parquet(path).orderBy("record", "chunk").collect()
    assert max(len(r["data"]) for r in rows) < (64 << 10) + 1000 and len(rows) == 24 * 16 + 1
    sha = hashlib.sha1()
    for r in (r for r in rows if r["record"] == max(rows, key=lambda r: r["chunk"])["record"]):
        data = bytes(r["data"]).split(b"\r\n\r\n", 1)[1] if r["chunk"] == 0 else bytes(r["data"])
        sha.update(data.removesuffix(b"\r\n\r\n"))
        assert bytes(r["digest"]) == sha.digest()
    assert sorted(map(tuple, warc.read(spark.read.parquet(path)).collect())) == brute([(1, "u", big), (2, "u", "small")])


def test_rows_that_repeat_a_page_very_often(spark):
    rows = [(7, "v", "same")] * 30_000 + [(7, None, "same"), (3, "w", "same")]
    out = Counter(tuple(r)[3:] for r in warc.round_trip(pages(spark, rows)).collect())
    assert out == {("response", None): 1, ("revisit", 7): 30_001}


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []
    out = sorted(tuple(r)[3:] for r in warc.round_trip(pages(spark, [(5, "u", "same"), (5, "u", "same")])).collect())
    assert out == [("response", None), ("revisit", 5)]
    out = warc.round_trip(pages(spark, [(None, "u", "x"), (None, "u", "x"), (1, "u", "y")])).collect()
    assert sorted((r["page_id"] is None, r["record_type"]) for r in out) == [(False, "response"), (True, "response"), (True, "response")]


def test_pages_equal_the_sql(spark, folder):
    from tests.oracle import difference, rows_of_spark, rows_of_sql

    assert not difference(rows_of_spark(warc.op6_warc(spark, folder)), rows_of_sql(folder, warc.ORACLE_SQL))
