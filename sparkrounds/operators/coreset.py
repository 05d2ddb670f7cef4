"""Mergeable weighted coresets of 2-D points.

``points(id, x, y, w, set)``: each set is reduced on its own, but only as a
grouping key.  All steps are column expressions and aggregates that combine
map-side, so one set may hold any share of the rows.  Centers travel as one
short array per set, broadcast by set: sets times k entries, both parameters.

A point within ring ``i`` of a center (``lo < d < hi``) belongs to the first
(level, center) in that order; points in no ring pass through unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrounds.functions.checks import one_of, require
from sparkrounds.functions.hashing import bucket, hash60
from sparkrounds.functions.ranking import bottom_by_hash
from sparkrounds.functions.sums import exact_sums
from sparkrounds.operators.seeding import seed_arrays
from sparkrounds.plans.lineage import materialize
from sparkrounds.plans.rounds import merge_rounds

# Centers over all sets; they are broadcast, so more than this is refused.
MAX_CENTERS = 100_000
# Up to this many centers per set, expressions are unrolled into generated code.
UNROLL = 24
SCHEDULES = ("geometric", "two_ring")
SAMPLINGS = ("grid", "annulus")
POINT = ["id", "x", "y", "w"]


def unit_weight(points: DataFrame) -> DataFrame:
    """Give every point weight 1."""
    return points.withColumn("w", F.lit(1.0))


def label_count(points: DataFrame) -> DataFrame:
    """One row: the number of distinct labels, used as k."""
    return points.agg(F.count_distinct("label").alias("k"))


def partition_points(points: DataFrame, sets: int, *, seed: int = 0) -> DataFrame:
    """Deal points into ``sets`` sets by a seeded hash of the id."""
    return points.withColumn("set", bucket(seed, sets, "id").cast("int"))


class CenterSets:
    """Centers as one row per set: ``(set, centers ARRAY<STRUCT<c, cx, cy, ...>>)``.

    ``k`` bounds the centers of a set; sets times k is at most ``MAX_CENTERS``.
    """

    def __init__(self, table: DataFrame, k: int, *, shared: bool = False):
        self.table, self.k, self.shared = table, k, shared

    @classmethod
    def of(cls, centers: DataFrame | CenterSets) -> CenterSets:
        """From rows ``([set,] c, cx, cy)``, whose number is checked.

        Without a ``set`` column all sets share the centers.
        """
        if isinstance(centers, CenterSets):
            return centers
        require(centers, "c", "cx", "cy", what="centers")
        shared = "set" not in centers.columns
        if shared:
            centers = centers.withColumn("set", F.lit(0))
        size = centers.agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c")).first()
        _check_centers(size["n"])
        table = centers.groupBy(F.col("set").cast("int").alias("set")).agg(
            F.array_sort(F.collect_list(F.struct("c", "cx", "cy"))).alias("centers")
        )
        return cls(table, int(size["c"]) + 1 if size["n"] else 0, shared=shared)

    @classmethod
    def seeded(cls, points: DataFrame, k: int, *, seed: object, sets: int) -> CenterSets:
        """k-means++ seeds of every set."""
        _check_centers(sets * k)
        return cls(seed_arrays(points, k, seed=seed, sets=sets), k)

    def attach(self, points: DataFrame) -> DataFrame:
        if self.shared:
            return points.withColumn("centers", self.table.select("centers").scalar())
        return points.join(F.broadcast(self.table), "set")

    def each(self, fn: Callable[[str], str]) -> Column:
        """Array of ``fn(center)`` over the row's centers; ``fn`` maps SQL text to SQL text."""
        if self.k <= UNROLL:
            cells = ", ".join(fn(f"get(centers, {i})") for i in range(self.k))
            return F.expr(f"array({cells})")
        return F.expr(f"transform(centers, center -> {fn('center')})")

    def total(self, fn: Callable[[str], str]) -> Column:
        """Sum of ``fn(center)`` over the row's centers."""
        if self.k <= UNROLL:
            terms = (f"coalesce({fn(f'get(centers, {i})')}, 0D)" for i in range(self.k))
            return F.expr(" + ".join(terms))
        return F.expr(f"aggregate(centers, 0D, (acc, center) -> acc + {fn('center')})")


    def among(self, distances: str, text: str, estimates: str = "NULL") -> Column:
        """Array of ``text`` over the centers, with ``{d}`` and ``{e}`` from the arrays named.

        Generated code, without a function per element, up to ``UNROLL`` centers.
        """
        if self.k <= UNROLL:
            cells = (
                text.format(d=f"get({distances}, {i})", e=f"get({estimates}, {i})") for i in range(self.k)
            )
            return F.expr(f"array({', '.join(cells)})")
        if estimates == "NULL":
            return F.expr(f"transform({distances}, d -> {text.format(d='d', e='NULL')})")
        return F.expr(f"zip_with({distances}, {estimates}, (d, e) -> {text.format(d='d', e='e')})")


def _check_centers(count: int) -> None:
    if count > MAX_CENTERS:
        raise ValueError(f"{count} centers exceed the broadcast bound {MAX_CENTERS}")


def _with_set(points: DataFrame) -> DataFrame:
    require(points, *POINT, what="points")
    return points if "set" in points.columns else points.withColumn("set", F.lit(0))


def squared_distance(center: str, x: str = "x", y: str = "y") -> str:
    """SQL text: squared distance of a place to a center."""
    dx, dy = f"({x} - {center}.cx)", f"({y} - {center}.cy)"
    return f"({dx} * {dx} + {dy} * {dy})"


def center_distance(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``(id, c, dist)``: distance of every point to every center of its set."""
    sets = CenterSets.of(centers)
    far = sets.each(
        lambda c: f"named_struct('c', {c}.c, 'dist', sqrt({squared_distance(c)}))"
    )
    rows = sets.attach(_with_set(points)).select("id", F.inline(far))
    return rows.filter("c IS NOT NULL")


def coreset_cost(points: DataFrame, centers: DataFrame | CenterSets) -> DataFrame:
    """Per set ``(set, n, k, cost)``.

    ``cost`` is the weighted sum of each point's root of summed squared
    distances to all centers, divided by the number of centers.  The sum is exact,
    so it does not depend on the order of the points.
    """
    sets = CenterSets.of(centers)
    rows = sets.attach(_with_set(points)).select(
        "set", F.size("centers").alias("k"), (F.col("w") * F.sqrt(sets.total(squared_distance))).alias("spread")
    )
    count = F.count(F.lit(1)).alias("n")
    totals = exact_sums(rows, ["set"], {"total": "spread"}, count, F.max("k").alias("k"))
    return totals.select("set", "n", "k", (F.col("total") / F.col("k")).alias("cost"))


def ring_params(
    points: DataFrame, centers: DataFrame | CenterSets, *, a: float = 0.5
) -> DataFrame:
    """Per set ``(set, n, cost, levels, r)``: number of rings and first radius.

    Where ``a * ln(n) <= 1`` there are no rings and the set passes through.
    """
    log_n = F.log(F.col("n").cast("double"))
    scaled = F.lit(a) * log_n
    usable = F.col("n") > math.exp(1.0 / a) if a > 0 else F.lit(False)
    levels = F.when(usable, F.ceil(log_n * F.log(scaled))).otherwise(0)
    radius = F.when(usable, F.sqrt(F.col("cost") / (scaled * F.col("n"))))
    return coreset_cost(points, centers).select(
        "set", "n", "cost", levels.cast("int").alias("levels"), radius.alias("r")
    )


def ring_assign(
    points: DataFrame,
    centers: DataFrame | CenterSets,
    params: DataFrame,
    *,
    schedule: str = "geometric",
) -> DataFrame:
    """Adds ``level, c, hi, cx, cy`` to the points; all null for left-over points.

    ``two_ring`` has the rings (0, r) and (r, 2r) only; ``geometric`` doubles the
    outer radius at every level.  ``params`` has one row per set.
    """
    one_of(schedule, SCHEDULES, "schedule")
    sets = CenterSets.of(centers)
    rows = sets.attach(_with_set(points))
    if "set" in points.columns:
        # One row per set, and every set has a center: MAX_CENTERS bounds this too.
        rows = rows.join(F.broadcast(params.select("set", "levels", "r")), "set")
    else:
        only = params.select(F.struct("levels", "r")).scalar()
        rows = rows.withColumn("rp", only).select("*", "rp.levels", "rp.r").drop("rp")
    # Staged columns: each is computed once per row and read by the next.
    rows = rows.withColumn("dists", sets.each(lambda c: f"sqrt({squared_distance(c)})"))
    if schedule == "geometric":
        rows = rows.withColumn("guesses", sets.among("dists", _ESTIMATE))
        rings = sets.among("dists", _SETTLE, "guesses")
    else:
        rings = sets.among("dists", _TWO_RINGS)
    rows = rows.withColumn("rings", rings).withColumn("level", F.array_min("rings"))
    # Centers are in order of c, so the first one at that level is the smallest.
    at = F.expr("get(centers, int(array_position(rings, level)) - 1)")
    return rows.withColumn("at", at).selectExpr(
        *POINT,
        "set",
        "level",
        "at.c AS c",
        "CASE WHEN level IS NOT NULL THEN r * pow(2D, level) END AS hi",
        "at.cx AS cx",
        "at.cy AS cy",
    )


# The level of the ring around a center that holds a point at distance {d}, or
# null.  log2 may miss by one next to a power of two, and a point on a boundary
# is in no ring, so the estimate {e} is checked against the exact radii.
_ESTIMATE = "greatest(0D, double(ceil(log2({d} / nullif(r, 0D)))))"
_SETTLE = """CASE WHEN {d} > 0 AND {e} > 0 AND {d} < r * pow(2D, {e}) / 2 AND {e} <= levels THEN int({e}) - 1
  WHEN {d} > r * pow(2D, {e}) AND {e} + 1 < levels THEN int({e}) + 1
  WHEN {d} > 0 AND {d} < r * pow(2D, {e}) AND ({e} = 0 OR {d} > r * pow(2D, {e}) / 2) AND {e} < levels THEN int({e}) END"""
_TWO_RINGS = """CASE WHEN {d} > 0 AND {d} < r AND levels > 0 THEN 0
  WHEN {d} > r AND {d} < r * 2 AND levels > 1 THEN 1 END"""


def grid_cell(assigned: DataFrame, *, eps: float = 0.25) -> DataFrame:
    """Adds the half-open grid cell ``(gx, gy)`` of every point that lies in a ring.

    Cells have side ``eps * hi / sqrt(2)``; their number per axis covers the ring's
    box, with the center in the middle.
    """
    side = f"({float(eps)!r}D * hi / sqrt(2D))"

    def cell(v: str) -> Column:
        return F.expr(f"int(floor(({v} - c{v}) / {side} + ceil(hi * 2 / {side}) / 2))")

    return assigned.withColumns({"gx": cell("x"), "gy": cell("y")})


def grid_coreset(assigned: DataFrame, *, eps: float = 0.25, seed: int = 0) -> DataFrame:
    """One seeded random point per non-empty cell, carrying the cell's weight.

    Left-over points bypass the aggregate, so only points in rings are shuffled;
    ``assigned`` is read twice, so pass a stored table.
    """
    inside = assigned.filter("level IS NOT NULL")
    # Plain numbers in the aggregate's buffers keep it a hash aggregate.
    drawn = grid_cell(inside, eps=eps).withColumn("draw", hash60(seed, "id"))
    cells = (
        drawn.groupBy("set", "level", "c", "gx", "gy")
        .agg(
            *[F.min_by(v, "draw").alias(v) for v in ("id", "x", "y")], F.sum("w").alias("w")
        )
        .select(*POINT, "set")
    )
    return cells.unionByName(_leftover(assigned))


def annulus_coreset(assigned: DataFrame, sample_size: int, *, seed: int = 0) -> DataFrame:
    """``min(sample_size, ring size)`` seeded random points per ring, sharing its weight.

    ``assigned`` is read several times, so pass a stored table.
    """
    ring = ["set", "level", "c"]
    sample = bottom_by_hash(
        assigned.filter("level IS NOT NULL").select(*POINT, *ring),
        ring, sample_size, seed=seed, key="id", weight="w",
    )
    share = F.expr(f"group_w / least({sample_size}, group_n)")
    weighted = sample.select("id", "x", "y", share.alias("w"), "set")
    return weighted.unionByName(_leftover(assigned))


def _leftover(assigned: DataFrame) -> DataFrame:
    return assigned.filter("level IS NULL").select(*POINT, "set")


def coreset_once(
    points: DataFrame,
    centers: DataFrame | CenterSets,
    *,
    sampling: str = "grid",
    sample_size: int = 10,
    eps: float = 0.25,
    a: float = 0.5,
    seed: int = 0,
    schedule: str = "geometric",
) -> DataFrame:
    """Reduce every set once around the given centers; total weight is unchanged."""
    one_of(sampling, SAMPLINGS, "sampling")
    sets = CenterSets.of(centers)
    params = ring_params(points, sets, a=a)
    assigned = ring_assign(points, sets, params, schedule=schedule)
    # Stored once: points in rings are aggregated, the others pass by.
    stored = materialize(assigned, "ring-assigned")
    if sampling == "grid":
        return grid_coreset(stored, eps=eps, seed=seed)
    return annulus_coreset(stored, sample_size, seed=seed)


def coreset_merge_reduce(
    points: DataFrame,
    k: int,
    *,
    sets: int = 8,
    sampling: str = "grid",
    sample_size: int = 10,
    eps: float = 0.25,
    a: float = 0.5,
    seed: int = 0,
    schedule: str = "geometric",
    on_round: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """Coreset of all points by reducing ``sets`` sets and merging neighbours in rounds.

    Every round seeds k centers per set, reduces, and renumbers the sets: pairs
    unite, and with an odd count the last three do.  ``on_round`` gets each
    round's number and row count.
    """
    if sets < 1 or k < 1:
        raise ValueError("sets and k must be at least 1")
    current = materialize(
        partition_points(points.select(*POINT), sets, seed=seed), "coreset-points"
    )
    for number in range(1, merge_rounds(sets) + 1):
        centers = CenterSets.seeded(current, k, seed=f"{seed}:{number}", sets=sets)
        # A set of at most k points is its own coreset: all distances to the
        # seeds that matter are zero, and left-over points pass through.
        reduced = coreset_once(
            current, centers, sampling=sampling, sample_size=sample_size,
            eps=eps, a=a, seed=f"{seed}:{number}", schedule=schedule,
        )
        merged = max(sets // 2, 1)
        target = F.least(F.floor(F.col("set") / 2), F.lit(merged - 1)).cast("int")
        current = materialize(reduced.withColumn("set", target), "coreset-points")
        sets = merged
        if on_round is not None:
            on_round(number, current.count())
    return current.select(*POINT)


def sample_sizes(n: Column, fractions: tuple[float, ...] = (0.001, 0.01, 0.1)) -> Column:
    """Array of ``(fraction, exact, used)`` sample sizes; ``used`` is rounded up."""
    return F.array(
        *[
            F.struct(
                F.lit(f).alias("fraction"),
                (n * f).alias("exact_size"),
                F.ceil(n * f).cast("long").alias("used_size"),
            )
            for f in fractions
        ]
    )
