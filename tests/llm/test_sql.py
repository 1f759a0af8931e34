"""Registered queries next to their SQL, over whole tables."""

import sys
from pathlib import Path

import pytest

from skein.llm.queries import QUERIES, SQL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import compare  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    assert compare.differences(QUERIES[name](spark, sf), duck, SQL[name]) is None


def test_one_query_for_each_operator():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))
