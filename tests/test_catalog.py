"""Every query with a SQL twin gives the same rows as DuckDB on the small tables."""

from __future__ import annotations

import pytest
from compare import compare, duck

from sparkrounds.catalog import FIXTURE_SQL, FIXTURES, QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    assert compare(spark, db, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_generator_equals_sql(spark, db, name):
    assert compare(spark, db, FIXTURES[name], FIXTURE_SQL[name], SF) is None


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).first()
    assert row["n_edges"] > 0
    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
