"""The registered queries against their SQL, where SQL can say them."""

import pytest

from check import compare, connect
from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, data, name):
    _, verdict, sample = compare(spark, connect(data), data, name)
    assert verdict == "equal", sample


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)
