"""Every query with a SQL twin gives the same rows in DuckDB."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from tallyweave.plans import data_queries, ledger_queries

CORE = {**data_queries.QUERIES, **ledger_queries.QUERIES}
CORE_SQL = {**data_queries.SQL, **ledger_queries.SQL}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_same_rows(spark, data, con, name):
    compare(spark, con, data, CORE[name], CORE_SQL[name])


# these have tests of their own; test_analysis covers those of the analysis
ELSEWHERE = {"graph_scores", "hdbscan_cohorts", "analysis_ranking", "analysis_clusters", "components", "p3_flat_rows"}


@pytest.mark.parametrize("name", sorted(set(CORE) - set(CORE_SQL) - ELSEWHERE))
def test_others_give_rows(spark, data, name):
    assert CORE[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["first_delivery_id", "delivery_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
