"""Run a query and its SQL twin on the same tables and compare the results."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple(row[i] for i in order) for row in rows]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    return [columns[i] for i in order], sorted(shown, key=key)


def compare(spark, connection, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want_columns, want = _rows(names, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    different = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w) or
                 [type(v) for v in g if v is not None] != [type(v) for v in w if v is not None]]
    return f"{len(different)} rows differ, first {different[0]}" if different else None


if __name__ == "__main__":
    from conftest import make_session

    from sparkrounds.catalog import QUERIES, SQL

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    session, db = make_session(), duck(sf)
    bad = []
    for name, fn in QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        started = time.time()
        if name in SQL:
            try:
                verdict = compare(session, db, fn, SQL[name], sf) or "equal"
            except Exception as error:  # noqa: BLE001
                verdict = f"error {type(error).__name__}: {str(error)[:600]}"
        else:
            try:
                verdict = f"{len(fn(session, sf).collect())} rows, no SQL"
            except Exception as error:  # noqa: BLE001
                verdict = f"error {type(error).__name__}: {str(error)[:600]}"
        if verdict != "equal" and not verdict.endswith("no SQL"):
            bad.append(name)
        print(f"{name:34s} {time.time() - started:6.1f}s  {verdict}", flush=True)
    print("NOT EQUAL:", bad)
