"""Every registered query against its SQL; those without SQL run and have a stable schema."""

from __future__ import annotations

import pytest

from sparkloom.plans import all_oracles, all_queries
from tests.oracle import difference, rows_of_spark, rows_of_sql

QUERIES, ORACLES = all_queries(), all_oracles()


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    got = rows_of_spark(QUERIES[name](spark, folder))
    assert not (said := difference(got, rows_of_sql(folder, ORACLES[name]))), said


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns
    assert len(df.collect()) > 0
