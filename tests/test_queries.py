"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# at this scale the result is empty or needs more rows
SMALL = {"w5_round_robin"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem = compare(name, spark, con, SF, QUERIES[name], SQL.get(name))
    assert problem is None or problem == "both empty", problem


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"category", "asset_id", "quality", "rank", "available", "band"}


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
