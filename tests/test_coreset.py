"""Coresets keep all weight, follow the ring rules, and cluster like the data."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sparkrounds.operators import coreset, kmeans
from sparkrounds.operators.nearest import nearest_of_many
from sparkrounds.operators.seeding import kmeanspp_seed, parallel_seed
from sparkrounds.schemas import CENTERS, POINTS
from sparkrounds.sources.pointgen import points_blobs


@pytest.fixture(scope="module")
def blobs(spark):
    made = coreset.unit_weight(points_blobs(spark, 1500)).select("id", "x", "y", "w")
    return made.cache()


def pts(spark, *places):
    rows = [(i, float(x), float(y), 1.0) for i, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, POINTS)


def centers(spark, *places):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, CENTERS)


@pytest.mark.parametrize(("n", "levels"), [(7, 0), (8, 1), (188, 6), (1250, 10), (6250, 13), (50000, 19)])
def test_levels(spark, n, levels):
    points = spark.range(n).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"))
    row = coreset.ring_params(points, centers(spark, (0, 0))).first()
    assert row["levels"] == levels and row["n"] == n


def ring_of(d, r, levels, schedule):
    bounds = [(0, r), (r, 2 * r)] if schedule == "two_ring" else [
        (0 if i == 0 else r * 2 ** (i - 1), r * 2**i) for i in range(levels)
    ]
    for i, (lo, hi) in enumerate(bounds[:levels]):
        if lo < d < hi:
            return i
    return None


@pytest.mark.parametrize("schedule", coreset.SCHEDULES)
@pytest.mark.parametrize("k", [2, 30])
def test_ring_assignment(spark, schedule, k):
    """Points on centers and exactly on radii are in no ring of that center."""
    r, levels = 0.75, 5
    places = [(r * m / 4, 0.0) for m in range(0, 120)] + [(0.1 * i, 0.2 * i) for i in range(60)]
    spots = [(float(3 * i), 0.5 * (i % 2)) for i in range(k)]
    params = spark.createDataFrame([(0, levels, r)], "set int, levels int, r double")
    found = coreset.ring_assign(pts(spark, *places), centers(spark, *spots), params, schedule=schedule)
    for row in found.collect():
        x, y = places[row["id"]]
        hits = []
        for c, (cx, cy) in enumerate(spots):
            level = ring_of(math.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), r, levels, schedule)
            if level is not None:
                hits.append((level, c))
        want = min(hits) if hits else (None, None)
        assert (row["level"], row["c"]) == want
        if hits:
            assert row["hi"] == r * 2 ** want[0]


def test_grid_has_twelve_cells_per_axis(spark):
    places = [(0.01 * i - 1.0, 0.0) for i in range(1, 200)]
    params = spark.createDataFrame([(0, 1, 1.0)], "set int, levels int, r double")
    assigned = coreset.ring_assign(pts(spark, *places), centers(spark, (0, 0)), params)
    cells = coreset.grid_cell(assigned, eps=0.25).agg(F.min("gx"), F.max("gx")).first()
    assert tuple(cells) == (0, 11)


@pytest.mark.parametrize("sampling", coreset.SAMPLINGS)
@pytest.mark.parametrize("schedule", coreset.SCHEDULES)
def test_one_reduction_keeps_the_weight(spark, blobs, sampling, schedule):
    spots = centers(spark, (-6, -4), (0, 5), (7, -2))
    small = coreset.coreset_once(
        blobs, spots, sampling=sampling, sample_size=20, schedule=schedule
    )
    n, total = small.agg(F.count("*"), F.sum("w")).first()
    assert total == pytest.approx(1500.0) and n < 1500
    assert small.join(blobs.select("id", "x", "y"), ["id", "x", "y"], "left_anti").count() == 0


@pytest.mark.parametrize("sets", [1, 3, 8])
def test_merge_and_reduce(spark, blobs, sets):
    rounds = []
    small = coreset.coreset_merge_reduce(
        blobs, 3, sets=sets, on_round=lambda number, rows: rounds.append(rows)
    )
    n, total, distinct = small.agg(F.count("*"), F.sum("w"), F.count_distinct("id")).first()
    assert total == pytest.approx(1500.0)
    assert n == distinct == rounds[-1] < 1500


def test_merge_and_reduce_ignores_partitioning(spark, blobs):
    seen = {
        frozenset((r["id"], r["w"]) for r in coreset.coreset_merge_reduce(
            blobs.repartition(p), 3, sets=2).collect())
        for p in (1, 5)
    }
    assert len(seen) == 1


def test_tiny_sets_pass_through(spark):
    """More sets than points, equal points, and fewer points than centers."""
    points = pts(spark, (0, 0), (0, 0), (5, 5))
    small = coreset.coreset_merge_reduce(points, 4, sets=8)
    assert small.count() == 3


def test_coreset_clusters_like_the_data(spark, blobs):
    small = coreset.coreset_merge_reduce(blobs, 3, sets=4)
    full = kmeans.kmeans_sse(blobs, kmeans.kmeans_fit(blobs, 3, seed=1)).first()["sse"]
    reduced = kmeans.kmeans_sse(blobs, kmeans.kmeans_fit(small, 3, seed=1)).first()["sse"]
    assert reduced <= 1.3 * full


def test_kmeans_step_reads_centers_as_numbers(spark, blobs):
    """A step takes no center out of an array for every point, and gives the same means as the general one."""
    places = {0: (0.0, 0.0), 1: (5.0, 5.0), 2: (-3.0, 4.0)}
    step = kmeans._step(blobs, places, 12)
    assert "get(centers" not in step._jdf.queryExecution().analyzed().toString()
    centers = spark.createDataFrame([(c, x, y) for c, (x, y) in places.items()], CENTERS)
    general = kmeans._means(kmeans.nearest_center(blobs, centers), 12)
    assert sorted(map(tuple, step.collect())) == sorted(map(tuple, general.collect()))


def test_kmeans_ignores_partitioning(spark, blobs):
    fits = {tuple(map(tuple, kmeans.kmeans_fit(blobs.repartition(p), 3, seed=2).collect())) for p in (1, 7, 200)}
    assert len(fits) == 1


def test_seeds_are_distinct_points_of_their_set(spark, blobs):
    dealt = coreset.partition_points(blobs, 4, seed=3)
    seeds = kmeanspp_seed(dealt, 5, seed=3)
    own = seeds.join(dealt.select("id", "set"), ["id", "set"], "left_semi")
    assert own.select("set", "cx", "cy").distinct().count() == 20


def test_too_many_centers_are_refused(spark, blobs):
    many = spark.range(coreset.MAX_CENTERS + 1).select(
        F.col("id").cast("int").alias("c"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy")
    )
    with pytest.raises(ValueError, match="broadcast bound"):
        coreset.center_distance(blobs, many)


def test_measures(spark):
    left, right = centers(spark, (0, 0), (3, 4)), centers(spark, (0, 0), (0, 4))
    assert kmeans.centroid_pairwise_avg(left, right).first()[0] == pytest.approx((0 + 4 + 5 + 3) / 2)
    assert kmeans.centroid_norm(left, right).first()[0] == pytest.approx(3.0)
    labelled = pts(spark, (0, 1), (3, 4)).withColumn("label", F.lit(0))
    assert kmeans.kmeans_sse(labelled, left).first()[0] == pytest.approx(26.0)
    step = kmeans.lloyd_step(pts(spark, (0, 2), (2, 0), (3, 5)), left).orderBy("c").collect()
    assert [tuple(r) for r in step] == [(0, 1.0, 1.0, 2.0), (1, 3.0, 5.0, 1.0)]


def test_sample_sizes(spark):
    row = spark.range(1).select(F.inline(coreset.sample_sizes(F.lit(1500)))).collect()
    assert [(r["fraction"], r["used_size"]) for r in row] == [(0.001, 2), (0.01, 15), (0.1, 150)]


def test_many_seeds_in_linear_work(spark, blobs):
    import time

    dealt = coreset.partition_points(blobs, 4, seed=3).cache()
    dealt.count()
    took = []
    for k in (10, 20):
        started = time.monotonic()
        assert kmeanspp_seed(dealt, k, seed=3).count() == 4 * k
        took.append(time.monotonic() - started)
    assert took[1] < 3.5 * took[0]


def test_oversampled_seeds(spark, blobs):
    dealt = coreset.partition_points(blobs, 3)
    seeds = [tuple(r) for r in parallel_seed(dealt, 40, seed=3, passes=2).collect()]
    assert len(seeds) == len({(r[0], r[4]) for r in seeds}) == 3 * 40
    places = {(r["set"], r["id"]): (r["x"], r["y"]) for r in dealt.collect()}
    assert all(places[r[0], r[4]] == (r[2], r[3]) for r in seeds)
    again = {tuple(r) for r in parallel_seed(dealt.repartition(5), 40, seed=3, passes=2).collect()}
    assert again == set(seeds)
    # They spread as the data does: no worse than twice k-means++ one by one.
    cost = {}
    for name, found in (("at once", parallel_seed(blobs, 8, seed=1)), ("one by one", kmeanspp_seed(blobs, 8, seed=1))):
        cost[name] = kmeans.kmeans_sse(blobs, found.select("c", "cx", "cy")).first()["sse"]
    assert cost["at once"] <= 2 * cost["one by one"]
    # Fewer places than seeds, and none at all.
    few = spark.createDataFrame([(i, float(i % 2), 0.0) for i in range(9)], "id long, x double, y double")
    assert parallel_seed(few, 5).count() == 2
    assert parallel_seed(few.limit(0), 5).count() == 0


@pytest.mark.parametrize("spread", ["even", "clumped"])
def test_nearest_of_many_is_exact(spark, monkeypatch, spread):
    """Clumps, ties, equal places, points far outside the centers' box and without a place."""
    import random

    rng = random.Random(8)
    scale = (lambda: rng.random()) if spread == "even" else (lambda: rng.random() ** 9 * 1e4)
    spots = [(c, scale(), scale()) for c in range(300)] + [(300, 0.5, 0.5), (301, 0.5, 0.5)]
    places = [(i, scale(), scale(), 1.0) for i in range(400)] + [(400, 0.5, 0.5, 1.0), (401, -70.0, 3e3, 1.0), (402, 1e6, 1e6, 1.0)]
    points = spark.createDataFrame([*places, (403, None, 1.0, 1.0)], POINTS)
    table = spark.createDataFrame(spots, CENTERS)

    def best(x, y):
        return min(((x - a) * (x - a) + (y - b) * (y - b), c) for c, a, b in spots)

    want = {i: best(x, y) for i, x, y, _ in places} | {403: (None, None)}
    assert {r["id"]: (r["d2"], r["c"]) for r in nearest_of_many(points, table).collect()} == want
    monkeypatch.setattr(kmeans, "MAX_CENTERS", 100)
    assert {r["id"]: (r["d2"], r["c"]) for r in kmeans.nearest_center(points, table).collect()} == want
    assert kmeans.lloyd_step(points.filter("x IS NOT NULL"), table).agg(F.sum("w")).first()[0] == len(places)
    one = spark.createDataFrame([(7, 2.0, 2.0)], CENTERS)
    assert {r["c"] for r in nearest_of_many(points.filter("id < 400"), one).collect()} == {7}
    assert {r["c"] for r in nearest_of_many(points, one.limit(0)).collect()} == {None}


def test_centers_at_one_place_neither_fill_a_cell_nor_refine_the_grid(spark, monkeypatch):
    """Thousands of centers at three places are three: one grid, and a point meets no more than the places."""
    from sparkrounds.operators import nearest

    lists = []
    keep = nearest.materialize

    def watched(df, tag, **options):
        if tag == "nearest-best":
            lists.append(df)
        return keep(df, tag, **options)

    monkeypatch.setattr(nearest, "materialize", watched)
    spots = [(c, float(c % 3), 0.0) for c in range(3000)]
    places = [(i, (i % 30) / 10, 0.0, 1.0) for i in range(600)]
    found = nearest_of_many(spark.createDataFrame(places, POINTS), spark.createDataFrame(spots, CENTERS)).collect()
    want = {i: min(((x - a) ** 2, a) for a in (0.0, 1.0, 2.0))[1] for i, x, _, _ in places}
    assert {r["id"]: float(r["c"]) for r in found} == want
    assert len(lists) <= 2
