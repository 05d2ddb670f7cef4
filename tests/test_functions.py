"""Ranking, sampling and lookups, with hot keys and many partitions."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkrounds.functions.ranking import beyond, bottom_by_hash, global_rank, kth_row
from sparkrounds.functions.sizing import lookup
from sparkrounds.functions.sums import exact_sum_sql, exact_sums


@pytest.mark.parametrize("rows_per_task", [50, 10_000])
def test_global_rank(spark, rows_per_task):
    rows = spark.range(1000).withColumn("v", F.pmod(F.col("id") * 7, F.lit(10)))
    ranked = global_rank(rows, [-F.col("v"), F.col("id")], rows_per_task=rows_per_task).collect()
    want = sorted(range(1000), key=lambda i: (-(i * 7 % 10), i))
    assert [r["id"] for r in sorted(ranked, key=lambda r: r["pos"])] == want
    assert [r["pos"] for r in sorted(ranked, key=lambda r: r["pos"])] == list(range(1, 1001))


@pytest.mark.parametrize("rows_per_bucket", [0, 10, 100_000])
@pytest.mark.parametrize("size", [1, 30, 400, 5000])
def test_bottom_by_hash(spark, size, rows_per_bucket):
    """One group holds two thirds of the rows; samples are exact at any bucket width."""
    group = F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7)
    rows = spark.range(3000).withColumn("g", group)
    got = bottom_by_hash(
        rows, ["g"], size, seed=5, key="id", weight="id", rows_per_bucket=rows_per_bucket,
    ).collect()
    groups = {}
    for i in range(3000):
        groups.setdefault(0 if i < 2000 else i % 7, []).append(i)
    want = set()
    for members in groups.values():
        members.sort(key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
        want |= set(members[:size])
    assert sorted(r["id"] for r in got) == sorted(want)
    totals = {g: (len(members), sum(members)) for g, members in groups.items()}
    assert all((r["group_n"], r["group_w"]) == totals[r["g"]] for r in got)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_lookup_with_a_hot_key(spark, limit):
    big = spark.range(5000).withColumn(
        "key", F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id"))
    )
    table = spark.range(0, 4000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    found = lookup(
        big, "key", table, "out", table_rows=4000, big_rows=5000, spread=["id"], limit=limit
    ).collect()
    assert len(found) == 5000
    for r in found:
        key = 3 if r["id"] % 2 == 0 else r["id"]
        assert r["out"] == (key * 10 if key < 4000 else None)


def test_kth_row_and_what_lies_beyond(spark):
    """Ties, infinities, tiny and huge numbers, negative ids; every place of the order."""
    inf = float("inf")
    values = [0.0, 1.0, 1.0, 1.0, -inf, inf, inf, 1e-300, 3e-300, -1e308, 1e308, 5.5, 5.5000001]
    rows = [(w, src, -src // 3) for w in values for src in (-(2**63), -3, 2**63 - 1)]
    order = ["w", "src", "dst"]
    df = spark.createDataFrame(rows, "w double, src long, dst long")
    want = sorted((r["w"], r["src"], r["dst"]) for r in df.collect())
    for k in (1, 2, 3, 7, 12, 20, 26, 33, 38, 39):
        row = kth_row(df, order, k)
        assert row == want[k - 1]
        assert df.filter(beyond(order, row) > 0).count() == sum(x > row for x in want)


def test_exact_sums_are_the_same_bits_for_any_order(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(5000)] + [0.0, None]
    rows = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v double")
    for top in (None, 31):
        seen = set()
        for parts in (1, 7, 50):
            out = exact_sums(rows.repartition(parts), ["g"], {"t": "v"}, F.count(F.lit(1)).alias("n"), top=top)
            seen.add(tuple(sorted((r["g"], r["t"], r["n"]) for r in out.collect())))
        (found,) = seen
        for g, total, n in found:
            mine = [v for i, v in enumerate(values) if i % 3 == g and v is not None]
            assert abs(total - math.fsum(mine)) <= 4e-16 * abs(total) + 1e-7 * (top is not None) and n in (1667, 1668)
    one = spark.sql(f"SELECT {exact_sum_sql('v')} AS t FROM VALUES (0.1D), (0.2D), (-0.3D) AS x(v)").first()
    assert one["t"] == math.fsum([0.1, 0.2, -0.3])


def test_lookup_tables_of_many_rows_are_not_sent_to_the_driver(spark):
    """By default only tables of at most 100,000 rows are broadcast, whatever their number."""
    big = spark.range(10).withColumn("key", F.col("id"))
    table = spark.range(200_000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    with pytest.MonkeyPatch.context() as patch:
        seen = []
        hint = F.broadcast
        patch.setattr("sparkrounds.functions.sizing.F.broadcast", lambda df: seen.append(df.columns) or hint(df))
        lookup(big, "key", table, "out", table_rows=200_000, big_rows=10, spread=["id"])
    assert ["lk", "lv"] not in seen
