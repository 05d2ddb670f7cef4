"""Size-checked broadcasts and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup table of at most this many (id, value) rows is broadcast; a larger
# one is joined by shuffle.  Rounds broadcast several such tables each, and every
# one passes through the driver.
BROADCAST_ROWS = 100_000

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there can be
# at most HOT_SHARE hot keys whatever the size of the data.
HOT_SHARE = 1000
SALTS = 4096
# Counters of a key sketch: a count is off by at most 3.5 / 16384 of the rows, far below 1 / HOT_SHARE.
SKETCHED_KEYS = 12_000


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the counted size allows it, else the table as it is."""
    return F.broadcast(df) if rows <= limit else df


def heavy_keys(df: DataFrame, key: str, total: int) -> DataFrame:
    """Keys holding more than ``total / HOT_SHARE`` rows, and perhaps some with nearly as many: at most HOT_SHARE rows.

    Whole numbers and strings are counted by a sketch of fixed size per task, so
    next to nothing is shuffled; other keys are counted one by one.
    """
    if isinstance(df.schema[key].dataType, (T.IntegralType, T.StringType)):
        top = df.agg(F.expr(f"approx_top_k(`{key}`, {HOT_SHARE}, {SKETCHED_KEYS})").alias("top"))
        counts = top.select(F.inline("top").alias("hot_key", "hot_n"))
    else:
        counts = df.groupBy(F.col(key).alias("hot_key")).agg(F.count(F.lit(1)).alias("hot_n"))
    return counts.filter(F.col("hot_n") * HOT_SHARE > F.lit(total)).select("hot_key")


def lookup(
    big: DataFrame,
    key: str,
    table: DataFrame,
    out: str,
    *,
    table_rows: int,
    big_rows: int | None = None,
    spread: list[str],
    limit: int = BROADCAST_ROWS,
    counted_in: DataFrame | None = None,
) -> DataFrame:
    """Left lookup: add column ``out`` = ``table.v`` where ``table.k = big[key]``.

    ``table(k, v)`` has unique ``k``.  A small table is broadcast.  Otherwise
    the few hot keys are looked up by broadcast (their number has a fixed bound)
    and their rows are salted by ``spread`` so that the shuffle join, which
    serves all other keys, gets no oversized partition.  Hot keys are counted in
    ``counted_in``, where given: a stored table whose ``key`` occurs as often as
    in ``big``, so that ``big`` is made once only.
    """
    small = table.select(F.col("k").alias("lk"), F.col("v").alias("lv"))
    if table_rows <= limit:
        joined = big.join(F.broadcast(small), F.col(key) == F.col("lk"), "left")
        return joined.withColumn(out, F.col("lv")).drop("lk", "lv")
    total = big.count() if big_rows is None else big_rows
    hot = F.broadcast(heavy_keys(big if counted_in is None else counted_in, key, total))
    hot_values = small.join(hot, F.col("lk") == F.col("hot_key"), "left_semi")
    hot_values = hot_values.select(F.col("lk").alias("hk"), F.col("lv").alias("hv"))
    salted = big.join(F.broadcast(hot_values), F.col(key) == F.col("hk"), "left").withColumn(
        "salt",
        F.when(F.col("hk").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.lit(SALTS)) + 1
        ).cast("int"),
    )
    cold = small.withColumn("cold_salt", F.lit(0))
    joined = salted.join(
        cold, (F.col(key) == F.col("lk")) & (F.col("salt") == F.col("cold_salt")), "left"
    )
    value = F.when(F.col("hk").isNull(), F.col("lv")).otherwise(F.col("hv"))
    return joined.withColumn(out, value).drop("lk", "lv", "hk", "hv", "salt", "cold_salt")
