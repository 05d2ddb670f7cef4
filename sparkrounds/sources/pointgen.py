"""Deterministic 2-D point tables: ``(id, x, y, label)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrounds.functions.hashing import normal_pair
from sparkrounds.functions.ranking import beyond, kth_row
from sparkrounds.plans.lineage import materialize

# Centers, spreads and the linear map of the blob data sets, and the sets' names.
BLOB_CENTERS = ((-6.0, -4.0), (0.0, 5.0), (7.0, -2.0))
BLOB_SPREAD = (1.0, 1.0, 1.0)
VARIED_SPREAD = (1.0, 2.5, 0.5)
AFFINE = ((0.6, -0.6), (-0.4, 0.8))
DATASETS = ("Noisy circle", "Noisy moon", "Blobs", "Aniso", "varied", "Gaussian quantile")


def _noisy(x: Column, y: Column, noise: float, seed: object) -> tuple[Column, Column]:
    if not noise:
        return x, y
    zx, zy = normal_pair(seed, "id")
    return x + zx * noise, y + zy * noise


def points_circles(
    spark: SparkSession, n: int, *, noise: float = 0.05, factor: float = 0.5, seed: int = 0
) -> DataFrame:
    """Two concentric circles; the inner one is scaled by ``factor``."""
    outer = n // 2
    inner = F.col("id") >= outer
    step = F.when(inner, (F.col("id") - outer) / F.lit(float(max(n - outer, 1)))).otherwise(
        F.col("id") / F.lit(float(max(outer, 1)))
    )
    angle = step * (2.0 * math.pi)
    scale = F.when(inner, F.lit(factor)).otherwise(F.lit(1.0))
    x, y = _noisy(scale * F.cos(angle), scale * F.sin(angle), noise, f"{seed}:circles")
    return spark.range(n).select(
        "id", x.alias("x"), y.alias("y"), inner.cast("int").alias("label")
    )


def points_moons(
    spark: SparkSession, n: int, *, noise: float = 0.05, seed: int = 0
) -> DataFrame:
    """Two interleaved half circles."""
    upper = n // 2
    lower = F.col("id") >= upper
    rest = max(n - upper - 1, 1)
    angle = math.pi * F.when(lower, (F.col("id") - upper) / F.lit(float(rest))).otherwise(
        F.col("id") / F.lit(float(max(upper - 1, 1)))
    )
    x = F.when(lower, 1.0 - F.cos(angle)).otherwise(F.cos(angle))
    y = F.when(lower, 0.5 - F.sin(angle)).otherwise(F.sin(angle))
    x, y = _noisy(x, y, noise, f"{seed}:moons")
    return spark.range(n).select(
        "id", x.alias("x"), y.alias("y"), lower.cast("int").alias("label")
    )


def points_blobs(
    spark: SparkSession,
    n: int,
    *,
    centers: tuple[tuple[float, float], ...] = BLOB_CENTERS,
    spread: tuple[float, ...] = BLOB_SPREAD,
    seed: int = 0,
) -> DataFrame:
    """Isotropic Gaussians around ``centers``, dealt in turn."""
    k = len(centers)
    label = F.pmod(F.col("id"), F.lit(k)).cast("int")

    def pick(values: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), label + 1)

    zx, zy = normal_pair(f"{seed}:blobs", "id")
    sd = pick(list(spread))
    return spark.range(n).select(
        "id",
        (pick([c[0] for c in centers]) + sd * zx).alias("x"),
        (pick([c[1] for c in centers]) + sd * zy).alias("y"),
        label.alias("label"),
    )


def points_varied(spark: SparkSession, n: int, *, seed: int = 0) -> DataFrame:
    """Blobs whose spread differs per center."""
    return points_blobs(spark, n, spread=VARIED_SPREAD, seed=seed)


def affine_points(
    points: DataFrame, matrix: tuple[tuple[float, float], tuple[float, float]] = AFFINE
) -> DataFrame:
    """Row vectors times ``matrix``; other columns stay."""
    (a, b), (c, d) = matrix
    x, y = F.col("x"), F.col("y")
    return points.withColumns({"x": x * a + y * c, "y": x * b + y * d})


def quantile_shells(points: DataFrame, *, shells: int = 3, n: int | None = None) -> DataFrame:
    """Label by squared distance from the mean: ``shells`` classes of equal count.

    The first shells hold one point more where the number does not divide.  Each
    cut is the place of one point in the order of (distance, id), found by
    refined histograms: no point is sorted.
    """
    total = points.count() if n is None else n
    mean = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    dx = F.col("x") - mean.select("mx").scalar()
    dy = F.col("y") - mean.select("my").scalar()
    measured = materialize(points.withColumn("d2", F.round(dx * dx + dy * dy, 9)), "shell-distances")
    size, extra = divmod(total, shells)
    label, end = F.lit(0), 0
    for shell in range(shells - 1):
        end += size + (shell < extra)
        if 0 < end < total:
            label = label + F.when(beyond(["d2", "id"], kth_row(measured, ["d2", "id"], end)) > 0, 1).otherwise(0)
        else:
            label = label + F.lit(int(end == 0))
    return measured.withColumn("label", label.cast("int")).drop("d2")


def gaussian_quantile_points(spark: SparkSession, n: int, *, seed: int = 0) -> DataFrame:
    """One standard Gaussian labelled by three equal-count shells."""
    zx, zy = normal_pair(f"{seed}:gauss", "id")
    cloud = spark.range(n).select("id", zx.alias("x"), zy.alias("y"))
    return quantile_shells(cloud, n=n).select("id", "x", "y", "label")


def points_catalog(spark: SparkSession, sizes: list[int], *, seed: int = 0) -> DataFrame:
    """All six data sets at every size, with ``dataset`` and ``n`` columns."""
    parts = []
    for n in sizes:
        made = {
            "Noisy circle": points_circles(spark, n, seed=seed),
            "Noisy moon": points_moons(spark, n, seed=seed),
            "Blobs": points_blobs(spark, n, seed=seed),
            "Aniso": affine_points(points_blobs(spark, n, seed=f"{seed}:aniso")),
            "varied": points_varied(spark, n, seed=seed),
            "Gaussian quantile": gaussian_quantile_points(spark, n, seed=seed),
        }
        for name in DATASETS:
            parts.append(
                made[name].select(
                    F.lit(name).alias("dataset"), F.lit(n).alias("n"), "id", "x", "y", "label"
                )
            )
    catalog = parts[0]
    for part in parts[1:]:
        catalog = catalog.unionByName(part)
    return catalog
