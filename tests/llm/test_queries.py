"""Queries of the package with a SQL twin give the same rows in DuckDB; the others run."""

import pytest
from oracle import compare, connect

from tallyweave.llm import queries


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, con, name):
    if name in queries.SQL:
        compare(spark, con, data, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, data).count() > 0
