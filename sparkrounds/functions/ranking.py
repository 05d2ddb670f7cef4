"""Global positions and bottom-s selections without an unbounded sort in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrounds.functions.hashing import hash60, order_key
from sparkrounds.functions.sizing import broadcast_if_small
from sparkrounds.plans.lineage import discard, materialize, materialize_counted

ROWS_PER_TASK = 1_000_000
# Rows of a group's last selection bucket, which one window ranks.
ROWS_PER_BUCKET = 10_000
# Bits of a hash, and how many of them each histogram looks at.
HASH_BITS = 60
PASS_BITS = 12


def global_rank(
    df: DataFrame, order: list[Column], out: str = "pos", *, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """1-based position of each row in the (total) order of the ``order`` columns.

    Rows are range-partitioned by the order and written with their partition
    number; positions are row numbers inside a partition plus the running count
    of the partitions before it.  ``order`` names columns of ``df``.
    """
    stored, n = materialize_counted(df, "rank-input")
    parts = max(1, math.ceil(n / rows_per_task))
    if parts == 1:
        return stored.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
    ranged = stored.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id())
    table = materialize(ranged, "rank-ranges")
    discard(stored)
    counts = table.groupBy("pid").agg(F.count(F.lit(1)).alias("pid_n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "pid", F.coalesce(F.sum("pid_n").over(before), F.lit(0)).alias("pid_off")
    )
    row = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    return (
        table.withColumn("pid_rn", row)
        .join(broadcast_if_small(offsets, parts), "pid")
        .withColumn(out, F.col("pid_off") + F.col("pid_rn"))
        .drop("pid", "pid_off", "pid_rn")
    )


def bottom_by_hash(
    df: DataFrame,
    group: list[str],
    size: int,
    *,
    seed: object,
    key: str,
    weight: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """A seeded sample of exactly ``min(size, group rows)`` rows of every group.

    The sample is the ``size`` rows with the smallest ``md5(seed:key)``.  A
    histogram of the hash's next ``PASS_BITS`` bits finds the bucket of every
    group in which its cut falls: lower buckets are taken whole, higher ones
    left, and the cut bucket is divided again until no group's holds more than
    ``rows_per_bucket`` rows.  Only those are ranked, however large a group is.

    Adds ``group_n`` and ``group_w``, the group's row count and total weight.
    ``df`` is read in every pass, so it should be stored.
    """
    start = df.groupBy(*group).agg(F.count(F.lit(1)).alias("group_n"), F.sum(weight).alias("group_w"))
    # Per group: the cut lies at a hash that begins as ``low``, ``below`` rows lie under it.
    cut, groups = materialize_counted(
        start.withColumns(
            {
                "low": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "inside": F.col("group_n"),
                "open": F.col("group_n") > F.greatest(F.lit(size), F.lit(rows_per_bucket)),
            }
        ),
        "hash-cut",
    )
    hashed = df.withColumn("h60", hash60(seed, key))
    used = 0
    while used < HASH_BITS and not cut.filter("open").isEmpty():
        left = HASH_BITS - used - PASS_BITS
        found = broadcast_if_small(cut.filter("open").select(*group, "low"), groups)
        within = hashed.join(found, group).filter(F.shiftright("h60", HASH_BITS - used) == F.col("low"))
        counts = within.groupBy(*group, F.shiftright("h60", left).alias("hb")).agg(F.count(F.lit(1)).alias("hb_n"))
        running = counts.withColumn("hb_end", F.sum("hb_n").over(Window.partitionBy(*group).orderBy("hb")))
        # The first bucket in which the running count reaches what is wanted.
        wanted = running.join(broadcast_if_small(cut.select(*group, "below"), groups), group)
        first = wanted.filter(F.col("hb_end") + F.col("below") >= size).groupBy(*group).agg(
            F.min_by("hb_n", "hb").alias("new_inside"),
            F.min(F.col("hb_end") - F.col("hb_n")).alias("more"), F.min("hb").alias("new_low"),
        )
        step = cut.join(first, group, "left")
        moved = F.col("new_low").isNotNull()
        used += PASS_BITS
        cut = materialize(
            step.select(
                *group, "group_n", "group_w",
                F.when(moved, F.col("new_low")).otherwise(F.shiftleft("low", PASS_BITS)).alias("low"),
                (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"),
                F.coalesce("new_inside", "inside").alias("inside"),
                (moved & (F.col("new_inside") > rows_per_bucket)).alias("open"),
                F.coalesce(F.when(moved, F.lit(used)), F.col("bits") if "bits" in cut.columns else F.lit(0)).alias("bits"),
            ),
            "hash-cut",
        )
        # Groups that were done keep their own depth: their prefix is of fewer bits.
        cut = cut.withColumn(
            "low", F.when(F.col("bits") == used, F.col("low")).otherwise(F.shiftright("low", PASS_BITS))
        )
    if "bits" not in cut.columns:
        cut = cut.withColumn("bits", F.lit(0))
    placed = hashed.join(broadcast_if_small(cut.drop("inside", "open"), groups), group)
    prefix = F.expr(f"shiftright(h60, {HASH_BITS} - bits)")
    whole = placed.filter((prefix < F.col("low")) | (F.col("group_n") <= size))
    edge = placed.filter((prefix == F.col("low")) & (F.col("group_n") > size))
    row = F.row_number().over(Window.partitionBy(*group).orderBy(order_key(seed, key), key))
    chosen = edge.withColumn("rn", row).filter(f"rn <= {size} - below").drop("rn")
    return whole.unionByName(chosen).drop("h60", "low", "below", "bits")


BUCKETS = 4096


def _bucket(df: DataFrame, column: str, low: object, high: object) -> Column:
    """Number in [0, BUCKETS) that never falls as ``column`` rises from ``low`` to ``high``."""
    x = F.col(f"`{column}`")
    if dict(df.dtypes)[column] in ("double", "float"):
        # Halves, so that the width of any two finite numbers is finite.
        share = (x / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2) * BUCKETS
        place = F.when(x >= F.lit(high), BUCKETS - 1).when(x <= F.lit(low), 0).otherwise(F.floor(share))
        return F.least(place.cast("int"), F.lit(BUCKETS - 1))
    width = (high - low) // BUCKETS + 1
    wide = x.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    return F.floor(wide / F.lit(width).cast("decimal(20,0)")).cast("int")


def kth_row(df: DataFrame, order: list[str], k: int) -> tuple:
    """The values of the ``order`` columns in the k-th row (from 1) in ascending order.

    ``df`` should be stored and have at least k rows; the columns are numbers
    without null or NaN.  Column by column, a histogram finds the bucket that
    holds the row, and is refined within it until one value is left: each pass
    is an aggregate of at most ``BUCKETS`` groups, without a sort, however many
    rows come before or tie.
    """
    found: list = []
    for column in order:
        x = F.col(f"`{column}`")
        low, high = df.agg(F.min(x), F.max(x)).first()
        while low != high:
            if math.inf in (high, -low):
                # Infinite ends are buckets of their own.
                finite = df.filter(x.cast("double").isin(math.inf, -math.inf) == F.lit(False))
                sizes = df.agg(F.count_if(x == F.lit(-math.inf)), F.count_if(x < F.lit(math.inf))).first()
                if k <= sizes[0] or k > sizes[1]:
                    low = high = -math.inf if k <= sizes[0] else math.inf
                    k -= 0 if k <= sizes[0] else sizes[1]
                    break
                df, k = finite, k - sizes[0]
                low, high = df.agg(F.min(x), F.max(x)).first()
                continue
            counts = (
                df.groupBy(_bucket(df, column, low, high).alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
                .collect()
            )
            for row in sorted(counts, key=lambda r: r["b"]):
                if k <= row["n"]:
                    break
                k -= row["n"]
            low, high = row["low"], row["high"]
            df = df.filter((x >= F.lit(low)) & (x <= F.lit(high)))
        found.append(low)
        df = df.filter(x == F.lit(low))
    return tuple(found)


def beyond(order: list[str], row: tuple) -> Column:
    """1, 0 or -1 as a row comes after, at or before ``row`` (see :func:`kth_row`)."""
    out = F.lit(0)
    for column, value in reversed(list(zip(order, row))):
        x = F.col(f"`{column}`")
        out = F.when(x > F.lit(value), 1).when(x < F.lit(value), -1).otherwise(out)
    return out
