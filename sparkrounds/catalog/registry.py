"""Registration of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
# Generators make the input of tests and benchmarks: checked like queries, but none.
FIXTURES: dict[str, Query] = {}
FIXTURE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def fixture(name: str, sql: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        FIXTURES[name], FIXTURE_SQL[name] = fn, sql
        return fn

    return register
