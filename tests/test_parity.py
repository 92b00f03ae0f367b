"""Every registered query against its reference SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

D = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    problem, _n, _ts, _td = compare(spark, con, D, queries()[name], SQL[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert queries()[name](spark, D).limit(5).collect()


def test_entry(spark):
    assert entry(spark).count() > 0
