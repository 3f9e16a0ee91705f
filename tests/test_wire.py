from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.operators.search import light_pattern
from sparkloom.sources import wire
from sparkloom.streaming import schedule


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200_000))
def test_snappy_round_trip(data):
    assert wire.snappy_decoded(wire.snappy_encoded(data)) == data


def test_snappy_copies():
    # "abcd", then a copy of 4 bytes 4 back, and one of 7 bytes 1 back that overlaps itself
    block = bytes([15, 3 << 2]) + b"abcd" + bytes([0 << 2 | 1, 4]) + bytes([6 << 2 | 2, 1, 0])
    assert wire.snappy_decoded(block) == b"abcdabcd" + b"d" * 7
    with pytest.raises(ValueError):
        wire.snappy_decoded(bytes([4, 0 << 2 | 1, 9]))
    with pytest.raises(ValueError):
        wire.snappy_decoded(bytes([9, 0]) + b"a")


@given(st.lists(st.tuples(st.integers(1, 2000), st.one_of(st.integers(-(1 << 63), (1 << 63) - 1), st.binary(max_size=50)))))
def test_messages(parts):
    got = [(n, wire._signed(v) if isinstance(v, int) else v) for n, v in wire.fields(wire.message(*parts))]
    assert got == parts


def test_redis_requests():
    data = wire.resp_request("set", "k", "a\r\nb ü") + b"PING now\r\n" + wire.resp_request("GET", "k")
    assert wire.commands(data) == [["set", "k", "a\r\nb ü"], ["PING", "now"], ["GET", "k"]]


def test_series_are_cut_and_labels_survive(spark):
    rows = [("m", {"a": f"x{i % 3}", "é": "ü"}, i, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts long, value double")
    requests = wire.remote_write_requests(df, 100)
    assert requests.count() > 20
    back = wire.remote_write(requests).collect()
    assert sorted((r["metric"], tuple(sorted(r["labels"].items())), r["ts"], r["value"]) for r in back) == sorted((m, tuple(sorted(b.items())), t, v) for m, b, t, v in rows)


@pytest.mark.parametrize("text", ["* * * *", "60 * * * *", "* 24 * * *", "*/0 * * * *", "x * * * *", "5-2 * * * *"])
def test_odd_schedules_are_errors(text):
    with pytest.raises(ValueError):
        schedule.parsed(text)


def test_schedules():
    minute, hour, day, month, weekday = (v for v, _ in schedule.parsed("5,10-12 */8 1 jan-mar sun,7,2"))
    assert (minute, hour, day, month, weekday) == ({5, 10, 11, 12}, {0, 8, 16}, {1}, {1, 2, 3}, {0, 2})
    assert schedule.parsed("@daily") == schedule.parsed("0 0 * * *")


def test_light_stems():
    import re

    stem = lambda w, lang: re.sub(light_pattern(lang), r"\1", w)
    assert stem("maisons", "fr") == stem("maison", "fr") and stem("nationalités", "fr") == "national"
    assert stem("canciones", "es") == "cancion" and stem("rápidamente", "es") == "rápida"
    assert stem("les", "fr") == "les"  # three letters stay
