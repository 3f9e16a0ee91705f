"""One session for all tests; no SparkSession is made by a test itself."""

from __future__ import annotations

import os

import pytest

from sparkloom.session import local_session

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(os.environ.get("TEST_CORES", "4"), partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    return FOLDER
