"""Tabular operators for run logs: labels, means, pivots, transposes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def case_label(
    df: DataFrame, out: str, cases: Sequence[tuple[Column, str]], default: str | None = None
) -> DataFrame:
    """Add a label: that of the first true condition, else ``default``."""
    label = F.lit(default).cast("string")
    for condition, value in reversed(list(cases)):
        label = F.when(condition, F.lit(value)).otherwise(label)
    return df.withColumn(out, label)


def derived_ratio(df: DataFrame, part: str, whole: str, out: str = "ratio") -> DataFrame:
    """Add ``part / whole * 100``, rounded so that it can be compared for equality."""
    ratio = F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")) * 100
    return df.withColumn(out, F.round(ratio, 4))


def group_means(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of every value column per key; missing values are skipped."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def mean_all_numeric(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of every numeric column that is not a key."""
    numeric = [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys
    ]
    return group_means(df, keys, numeric)


def pivot_mean(
    df: DataFrame, keys: Sequence[str], column: str, categories: Sequence[str], value: str
) -> DataFrame:
    """One row per key, one mean per category.  Extra keys make facets."""
    return df.groupBy(*keys).pivot(column, list(categories)).agg(F.avg(value))


def method_report(
    log: DataFrame,
    cases: Sequence[tuple[Column, str]],
    default: str,
    keys: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """The report of a run log: one row per key and value column, one mean per method.

    ``cases`` and ``default`` label every run with its method (see
    :func:`case_label`).  Means are taken before anything is turned, so only a
    row per key and method is; a method without runs of a key has a null mean.
    """
    methods = [label for _, label in cases] + [default]
    labelled = case_label(log, "method", cases, default)
    means = group_means(labelled, [*keys, "method"], values)
    long = means.unpivot([*keys, "method"], list(values), "measure", "mean")
    return long.groupBy(*keys, "measure").pivot("method", list(dict.fromkeys(methods))).agg(F.first("mean"))


def transpose_means(
    df: DataFrame, key: str, categories: Sequence[str], values: Sequence[str], out: str = "measure"
) -> DataFrame:
    """Means per key with the value columns as rows and the keys as columns."""
    # Means first: only one row per key is turned.
    long = group_means(df, [key], values).unpivot([key], list(values), out, "value")
    return long.groupBy(out).pivot(key, list(categories)).agg(F.first("value"))


def log10_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log10 of positive values, null otherwise."""
    return df.withColumns({c: F.when(F.col(c) > 0, F.log10(F.col(c))) for c in columns})


def rounds_long(df: DataFrame, keys: Sequence[str], rounds: str = "RoundTimes") -> DataFrame:
    """One row per round from a list column: ``round`` counts from 1."""
    exploded = df.select(*keys, F.posexplode(rounds).alias("pos", "secs"))
    return exploded.select(*keys, (F.col("pos") + 1).alias("round"), "secs")


def rounds_wide(df: DataFrame, count: int = 3, rounds: str = "RoundTimes") -> DataFrame:
    """List column to ``RoundTimes1..count``; missing rounds are null."""
    return df.withColumns({f"{rounds}{i + 1}": F.get(rounds, F.lit(i)) for i in range(count)})


def rounds_list(df: DataFrame, count: int = 3, rounds: str = "RoundTimes") -> DataFrame:
    """``RoundTimes1..count`` back to one list column without the missing rounds."""
    cells = [F.col(f"{rounds}{i + 1}") for i in range(count)]
    return df.withColumn(rounds, F.array_compact(F.array(*cells)))
