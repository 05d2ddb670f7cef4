"""Weighted k-means on points and coresets, and measures of the result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrounds.functions.checks import require
from sparkrounds.functions.sizing import broadcast_if_small
from sparkrounds.functions.sums import exact_steps, exact_sums
from sparkrounds.operators.coreset import (
    MAX_CENTERS,
    UNROLL,
    CenterSets,
    _with_set,
    squared_distance,
)
from sparkrounds.operators.nearest import nearest_of_many
from sparkrounds.operators.seeding import kmeanspp_seed
from sparkrounds.plans.lineage import materialize
from sparkrounds.schemas import CENTERS


def kmeans_fit(
    points: DataFrame, k: int, *, seed: int = 0, max_iter: int = 50, tolerance: float = 1e-4
) -> DataFrame:
    """Centers ``(c, cx, cy)`` of weighted k-means, numbered by position (cx, cy).

    Starts from the seeded k-means++ seeds and repeats weighted Lloyd steps until
    no center moves by more than ``tolerance``; a center without points stays.
    Points are stored once, a step is one job, and sums are exact, so the centers
    are the same bits for any partitioning.
    """
    require(points, "id", "x", "y", "w", what="points")
    spark = points.sparkSession
    rows = points.select(
        "id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w")]
    )
    rows = materialize(rows, "kmeans-points")
    largest = rows.agg(F.max(F.greatest(F.abs("w"), F.abs(F.col("x") * F.col("w")), F.abs(F.col("y") * F.col("w"))))).first()[0]
    top = math.frexp(largest or 1.0)[1]
    seeds = kmeanspp_seed(rows, k, seed=seed, sets=1).select("c", "cx", "cy").collect()
    places = {r.c: (r.cx, r.cy) for r in seeds}
    for _ in range(max_iter):
        moved = {r.c: (r.cx, r.cy) for r in _step(rows, places, top).collect()}
        far = max((math.dist(p, places[c]) for c, p in moved.items()), default=0.0)
        places.update(moved)
        if far <= tolerance:
            break
    rows_out = [(i, x, y) for i, (x, y) in enumerate(sorted(places.values()))]
    return spark.createDataFrame(rows_out, CENTERS)


def _step(rows: DataFrame, places: dict[int, tuple[float, float]], top: int) -> DataFrame:
    """:func:`lloyd_step` around known places, of stored points.

    Centers travel as a value, not as literals, so all steps share their generated
    code; while they are few, they are the fields of one struct and a step is one SQL
    text, analysed once.
    """
    spark, k = rows.sparkSession, len(places)
    if k > UNROLL:
        listed = ", ".join(
            f"named_struct('c', {c}, 'cx', {float(x)!r}D, 'cy', {float(y)!r}D)" for c, (x, y) in sorted(places.items())
        )
        centers = f"SELECT * FROM VALUES (0, array({listed})) AS t(set, centers)"
        return _means(_nearest(rows, CenterSets(spark.sql(centers), k, shared=True)), top)
    fields = ", ".join(f"'x{i}', {float(x)!r}D, 'y{i}', {float(y)!r}D" for i, (_, (x, y)) in enumerate(sorted(places.items())))
    centers = f"SELECT named_struct({fields}) AS centers FROM VALUES (0) AS t(z)"
    far = [f"((x - centers.x{i}) * (x - centers.x{i}) + (y - centers.y{i}) * (y - centers.y{i})) AS far_{i}" for i in range(k)]
    least = f"least({', '.join(f'far_{i}' for i in range(k))})" if k > 1 else "far_0"
    at = " ".join(f"WHEN far_{i} = d2 THEN {c}" for i, c in enumerate(sorted(places)))
    pieces, rests, totals = exact_steps(["xw", "yw", "w"], top)
    text = f"SELECT x, y, w, {', '.join(far)} FROM (SELECT x, y, w, ({centers}) AS centers FROM {{rows}})"
    text = f"SELECT x, y, w, {least} AS d2, * EXCEPT (x, y, w) FROM ({text})"
    text = f"SELECT x * w AS xw, y * w AS yw, w, CASE {at} END AS c FROM ({text})"
    for piece, rest in zip(pieces, rests):
        for items in filter(None, (piece, rest)):
            text = f"SELECT *, {', '.join(items)} FROM ({text})"
    text = f"SELECT c, {totals['xw']} AS sx, {totals['yw']} AS sy, {totals['w']} AS sw FROM ({text}) GROUP BY c"
    return spark.sql(f"SELECT c, sx / sw AS cx, sy / sw AS cy, sw AS w FROM ({text}) WHERE sw > 0", rows=rows)


def _distances(k: int) -> tuple[list[str], str, str]:
    """SQL text: distances to k centers, the least of them, and the branches that name its center."""
    far = [f"{squared_distance(f'get(centers, {i})')} AS far_{i}" for i in range(k)]
    least = f"least({', '.join(f'far_{i}' for i in range(k))})" if k > 1 else "far_0"
    return far, least, " ".join(f"WHEN far_{i} = d2 THEN get(centers, {i}).c" for i in range(k))


def _nearest(points: DataFrame, sets: CenterSets) -> DataFrame:
    """``id, x, y, w, c, d2``: each point's nearest center; ties go to the first, which has the smallest number."""
    rows = sets.attach(points)
    if 0 < sets.k <= UNROLL:
        # Plain numbers in generated code, staged so that each distance is computed once.
        far, least, at = _distances(sets.k)
        rows = rows.selectExpr("id", "x", "y", "w", "centers", *far)
        rows = rows.selectExpr("*", f"{least} AS d2")
        return rows.selectExpr("id", "x", "y", "w", f"CASE {at} END AS c", "d2")
    rows = rows.withColumn("far", sets.each(squared_distance)).withColumn("d2", F.array_min("far"))
    return rows.selectExpr("id", "x", "y", "w", "get(centers, int(array_position(far, d2)) - 1).c AS c", "d2")


def _means(near: DataFrame, top: int | None = None) -> DataFrame:
    """Weighted mean place and weight of every cluster, by exact sums of terms below 2^top."""
    near = near.selectExpr("c", "w", "x * w AS xw", "y * w AS yw")
    sums = exact_sums(near, ["c"], {"sx": "xw", "sy": "yw", "sw": "w"}, top=top)
    return sums.filter("sw > 0").select(
        "c", (F.col("sx") / F.col("sw")).alias("cx"), (F.col("sy") / F.col("sw")).alias("cy"), F.col("sw").alias("w")
    )


def nearest_center(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Adds the nearest center ``c`` (smaller number on ties) and ``d2`` to each point.

    More centers than may be broadcast are met by way of a grid.
    """
    shared = not isinstance(centers, CenterSets) and "set" not in centers.columns
    if shared and centers.count() > MAX_CENTERS:
        return nearest_of_many(points, centers)
    return _nearest(_with_set(points), CenterSets.of(centers))


def lloyd_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """One weighted Lloyd step: new centers ``(c, cx, cy, w)`` of non-empty clusters."""
    return _means(nearest_center(points, centers))


def kmeans_sse(points: DataFrame, centers: DataFrame) -> DataFrame:
    """One row: weighted sum of squared distances to each point's own center.

    The own center is ``points.label`` when there is such a column, else the
    nearest one.
    """
    if "label" not in points.columns:
        near = nearest_center(points, centers)
        return near.agg(F.sum(F.col("w") * F.col("d2")).alias("sse"))
    own = centers.select(F.col("c").alias("label"), "cx", "cy")
    rows = points.join(broadcast_if_small(own, own.count(), MAX_CENTERS), "label")
    return rows.agg(
        F.expr("sum(w * ((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS sse")
    )


def centroid_pairwise_avg(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: all k x k distances between two center sets, summed, over k."""
    sets = CenterSets.of(right)
    reach = sets.total(lambda c: f"sqrt({squared_distance(c, 'lx', 'ly')})")
    rows = left.select(F.col("cx").alias("lx"), F.col("cy").alias("ly"), F.lit(0).alias("set"))
    return sets.attach(rows).agg(
        (F.sum(reach) / F.count(F.lit(1))).alias("avg_quality")
    )


def centroid_norm(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: Frobenius norm of the difference of centers with equal numbers."""
    other = right.select("c", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    dx, dy = F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy")
    return left.join(other, "c").agg(F.sqrt(F.sum(dx * dx + dy * dy)).alias("norm_quality"))
