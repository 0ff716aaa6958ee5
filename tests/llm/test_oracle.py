"""Queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from edgeloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name], FOLDER)
