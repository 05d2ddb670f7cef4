"""Column checks: every operator names the columns it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require(df: DataFrame, *columns: str, what: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; it has {df.columns}")
    return df


def one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {list(allowed)}, not {value!r}")
    return value
