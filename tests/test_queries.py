"""Every catalogue query against its SQL twin on the smallest tables."""

import compare
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert compare.differences(QUERIES[name](spark, SF), duck, SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
