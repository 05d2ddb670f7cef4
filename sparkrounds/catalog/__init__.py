"""Every operator bound to the test tables, with the SQL that checks it."""

from sparkrounds.catalog import graphs, tables, generators, points, evaluations  # noqa: F401, I001
from sparkrounds.catalog.registry import FIXTURE_SQL, FIXTURES, QUERIES, SQL

__all__ = ["FIXTURES", "FIXTURE_SQL", "QUERIES", "SQL"]
