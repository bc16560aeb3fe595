"""Registered queries against their SQL twins on the smallest tables."""

import pytest
from oracle import compare

from findery.workload import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, QUERIES[name], SQL[name])
    assert ok, note
