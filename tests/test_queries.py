"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from workload import check, oracles, queries

QUERIES, SQL = queries.registry(), oracles.registry()


@pytest.fixture(scope="module")
def duck(sf):
    pytest.importorskip("duckdb")
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    ours = check.spark_rows(QUERIES[name](spark, sf))
    if name not in SQL:
        assert ours[1]
        return
    assert check.difference(ours, check.duck_rows(duck, SQL[name])) is None


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
