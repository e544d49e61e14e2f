"""Every registered query against its SQL text on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from tidemark.plans.oracle import ORACLE
from tidemark.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


# Streams have tests of their own; here the six-stream query stands for them.
NAMES = [n for n in sorted(QUERIES) if not n.startswith("stream_") or n == "stream_detection"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, data, name):
    _, verdict, sample = compare(spark, con, data, name)
    assert verdict == "equal", sample


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 6
