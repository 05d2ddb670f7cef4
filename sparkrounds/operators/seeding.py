"""k-means++ seeding, for all sets at once.

Sampling proportional to squared distance is an exponential race: the point
with the smallest ``-ln(u) / d2`` wins, with ``u`` a seeded uniform of its id.
So one pass is one aggregate per set, and nothing is drawn on the driver.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrounds.functions.checks import require
from sparkrounds.functions.hashing import order_key, uniform
from sparkrounds.functions.sizing import broadcast_if_small
from sparkrounds.plans.lineage import materialize


# Seeds over all sets that may be broadcast; more are joined by shuffle.
MAX_SEEDS = 100_000
# Up to this many new candidates of a set, distances are unrolled into generated code.
UNROLLED = 64
# Passes between two stores of the distances; in between they are a few columns more.
STORE_EVERY = 8


def kmeanspp_seed(
    points: DataFrame, k: int, *, seed: object = 0, sets: int | None = None
) -> DataFrame:
    """``(set, c, cx, cy, id)``: ``k`` seeds per set, fewer if a set has fewer places."""
    arrays = seed_arrays(points, k, seed=seed, sets=sets)
    return arrays.selectExpr("set", "inline(centers)")


def seed_arrays(
    points: DataFrame, k: int, *, seed: object = 0, sets: int | None = None
) -> DataFrame:
    """``(set, centers ARRAY<STRUCT<c, cx, cy, id>>)`` from a stored table: the seeds of every set.

    Work is linear in ``k``: a pass updates each point's distance to its nearest
    seed by the newest one.  ``points`` is read for the first passes only, then
    stored distances are; ``sets`` is the number of sets (counted if not given).
    """
    require(points, "id", "x", "y", what="points")
    rows = points if "set" in points.columns else points.withColumn("set", F.lit(0))
    rows = rows.select("set", "id", "x", "y").withColumn("place", F.expr("struct(x, y, id)"))
    if sets is None:
        sets = rows.select("set").distinct().count()
    start = rows.withColumn("h", order_key(f"{seed}:0", "id"))
    chosen = start.groupBy("set").agg(F.expr("array(min_by(place, struct(h, id))) AS seeds"))
    # The running least distance to a seed; a pass compares with the newest seed only.
    state = rows.withColumn("d2", F.lit(float("inf")))
    chosen = materialize(chosen, "seeds")
    for number in range(1, k):
        newest = chosen.selectExpr("set", "get(seeds, size(seeds) - 1) AS newest")
        newest = broadcast_if_small(newest, sets, MAX_SEEDS)
        state = state.join(newest, "set").withColumn(
            "d2", F.expr(f"least(d2, {_squared('newest')})")
        ).drop("newest")
        if number % STORE_EVERY == 0:
            state = materialize(state, "seed-distances")
        raced = state.withColumn("u", uniform(f"{seed}:{number}", "id")).withColumn(
            "arrival", F.expr("CASE WHEN d2 > 0 THEN -ln(u) / d2 END")
        )
        # A set whose points all coincide with seeds has no arrivals and keeps its seeds.
        won = raced.groupBy("set").agg(
            F.expr(
                "min_by(place, struct(arrival, id)) FILTER (WHERE arrival IS NOT NULL) AS place"
            ),
        )
        chosen = materialize(
            chosen.join(broadcast_if_small(won, sets, MAX_SEEDS), "set").selectExpr(
                "set", "concat(seeds, array_compact(array(place))) AS seeds"
            ),
            "seeds",
        )
    # The seeds are stored; numbering them is a projection.
    return chosen.selectExpr(
        "int(set) AS set",
        "transform(seeds, (p, i) -> named_struct('c', i, 'cx', p.x, 'cy', p.y, 'id', p.id)) AS centers",
    )


def _squared(seed: str) -> str:
    return f"(x - {seed}.x) * (x - {seed}.x) + (y - {seed}.y) * (y - {seed}.y)"


def parallel_seed(
    points: DataFrame, k: int, *, seed: object = 0, passes: int = 4, oversample: int = 2
) -> DataFrame:
    """``(set, c, cx, cy, id)``: ``k`` seeds per set by oversampling, in a number of passes that k does not change.

    Every pass draws ``oversample * k`` points of each set at once, proportionally
    to the squared distance to the candidates so far: those that arrive first in
    the exponential race.  A candidate weighs as many points as are nearest to it
    (the earlier pass, then the earlier arrival, on ties).  The weighted candidates
    of a set, at most ``passes * oversample * k + 1`` whatever its size, are then
    seeded one by one in a task.  Points that coincide with a candidate are not
    drawn, so a set may have fewer seeds than ``k``, as many as it has places.
    """
    require(points, "id", "x", "y", what="points")
    rows = points if "set" in points.columns else points.withColumn("set", F.lit(0))
    state = materialize(
        rows.select(F.col("set").cast("int").alias("set"), "id", "x", "y").withColumns(
            {"d2": F.lit(float("inf")), "near": F.lit(None).cast("long")}
        ),
        "parallel-points",
    )
    drawn = state.groupBy("set").agg(F.expr(f"min_by(struct(x, y, id), struct({_order(seed)} AS h, id)) AS p"))
    newest = materialize(drawn.select("set", "p.x", "p.y", "p.id", F.lit(0).alias("nr")), "parallel-drawn")
    candidates = [newest]
    for number in range(1, passes + 1):
        state = materialize(_nearer(state, newest, 1 if number == 1 else oversample * k), "parallel-points")
        race = state.filter("d2 > 0").withColumn("u", uniform(f"{seed}:{number}", "id")).withColumn(
            "arrival", F.expr("-ln(u) / d2")
        )
        # A row number under a limit keeps no more than that many rows of a set in any task before the shuffle.
        place = F.row_number().over(Window.partitionBy("set").orderBy("arrival", "id"))
        drawn = race.withColumn("nr", place).filter(f"nr <= {oversample * k}")
        newest = materialize(drawn.select("set", "x", "y", "id", "nr"), "parallel-drawn")
        candidates.append(newest)
    state = _nearer(state, newest, oversample * k)
    weights = state.groupBy("set", F.col("near").alias("id")).agg(F.count(F.lit(1)).alias("w"))
    every = candidates[0]
    for more in candidates[1:]:
        every = every.unionByName(more)
    weighted = every.join(weights, ["set", "id"])
    return weighted.groupBy("set").applyInPandas(
        _seeded_one_by_one(k, seed), "set int, c int, cx double, cy double, id long"
    )


def _order(seed: object) -> str:
    return f"md5(concat('{seed}:0:', string(id)))"


def _nearer(state: DataFrame, newest: DataFrame, most: int) -> DataFrame:
    """The state with d2 and near brought up to date by at most ``most`` new candidates of each set."""
    lists = newest.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("nr", "x", "y", "id"))).alias("new"))
    rows = state.join(lists, "set", "left")
    if most <= UNROLLED:
        far = ", ".join(_squared(f"get(new, {i})") for i in range(most))
        far = f"array({far})"
    else:
        far = f"transform(new, p -> {_squared('p')})"
    rows = rows.withColumn("far", F.expr(far)).withColumn("least", F.array_min("far"))
    closer = F.col("least") < F.col("d2")
    at = F.expr("get(new, int(array_position(far, least)) - 1).id")
    return rows.select(
        "set", "id", "x", "y",
        F.when(closer, F.col("least")).otherwise(F.col("d2")).alias("d2"),
        F.when(closer, at).otherwise(F.col("near")).alias("near"),
    )


def _seeded_one_by_one(k: int, seed: object):
    """Group function: the weighted race among a set's candidates, k times."""

    def uniforms(number: int, ids: list[int]) -> list[float]:
        heads = (hashlib.md5(f"{seed}:again:{number}:{i}".encode()).hexdigest()[:8] for i in ids)
        return [(int(h, 16) + 0.5) / 4294967296 for h in heads]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, xs, ys, ws = (rows[c].tolist() for c in ("id", "x", "y", "w"))
        far, out = [math.inf] * len(ids), []
        for c in range(min(k, len(ids))):
            u = uniforms(c, ids)
            weight = [w if c == 0 else w * d for w, d in zip(ws, far)]
            arrivals = [(-math.log(a) / b, i) for i, (a, b) in enumerate(zip(u, weight)) if b > 0]
            if not arrivals:
                break
            i = min(arrivals)[1]
            out.append((int(rows["set"].iloc[0]), c, xs[i], ys[i], ids[i]))
            far = [min(d, (x - xs[i]) * (x - xs[i]) + (y - ys[i]) * (y - ys[i])) for d, x, y in zip(far, xs, ys)]
        return pd.DataFrame(out, columns=["set", "c", "cx", "cy", "id"])

    return run
