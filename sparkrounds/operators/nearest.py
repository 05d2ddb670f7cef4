"""Nearest centers where centers are too many to travel with every point.

Centers that share a place count as one.  The places lie in a grid whose cells
hold a few each.  A point meets those of its own cell and the eight around it, as
one list; the nearest of these is the nearest of all if it is no farther than the
block's border.  Points without such an answer go on to a grid of twice the side,
and so on: most points stop at once, and a level is an equi-join of points with
lists, so no point is multiplied, whatever the number of centers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrounds.functions.checks import require
from sparkrounds.plans.lineage import materialize, materialize_counted

# Centers that a cell of the finest grid should hold at most.
CELL_CENTERS = 16
# Levels looked at for it, beyond the one where cells are as many as centers; the second only if the first are too coarse.
FINER = ((0, 2, 4, 6, 8, 10), tuple(range(12, 42, 2)))


def nearest_of_many(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``(id, x, y, w, c, d2)``: each point's nearest center (smaller number on ties), exactly.

    Centers are ``(c, cx, cy)``.  Null places have no nearest center: c and d2
    are null, as they are for all points where there is no center.
    """
    require(points, "id", "x", "y", "w", what="points")
    require(centers, "c", "cx", "cy", what="centers")
    open_, n = materialize_counted(points.select("id", "x", "y", "w"), "nearest-points")
    # Of centers at one place only that with the smallest number can be an answer.
    places = centers.filter("cx IS NOT NULL AND cy IS NOT NULL").groupBy("cx", "cy").agg(F.min(F.struct("c"))["c"].alias("c"))
    places = materialize(places.select("c", "cx", "cy"), "nearest-centers")
    box = places.agg(
        F.count(F.lit(1)).alias("k"), F.min("cx").alias("x0"), F.max("cx").alias("x1"),
        F.min("cy").alias("y0"), F.max("cy").alias("y1"),
    ).first()
    nowhere = open_.filter("x IS NULL OR y IS NULL") if box["k"] else open_
    done = [nowhere.select("id", "x", "y", "w", F.lit(None).cast(places.schema["c"].dataType).alias("c"), F.lit(None).cast("double").alias("d2"))]
    if box["k"]:
        open_ = open_.filter("x IS NOT NULL AND y IS NOT NULL")
        width = max(box["x1"] - box["x0"], box["y1"] - box["y0"]) or 1.0
        level = _finest(places, box, width)
        while n:
            side = width / 2.0**level
            best = materialize(_within_block(open_, places, box, side), "nearest-best")
            # A block that holds the whole box holds every center.
            sure = (F.col("d2") <= F.col("margin") * F.col("margin")) | F.col("whole")
            done.append(best.filter(sure).select("id", "x", "y", "w", "c", "d2"))
            open_, n = materialize_counted(
                best.filter(~F.coalesce(sure, F.lit(False))).select("id", "x", "y", "w"), "nearest-points"
            )
            level -= 1 if level > 0 else 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _cell(v: str, low: float, side: float) -> str:
    return f"bigint(floor(({v} - {low!r}D) / {side!r}D))"


def _finest(places: DataFrame, box, width: float) -> int:
    """The first level at which no cell holds more than ``CELL_CENTERS``, else the last one looked at."""
    start = max(0, math.ceil(math.log2(math.sqrt(box["k"] / CELL_CENTERS)))) if box["k"] > CELL_CENTERS else 0
    for finer in FINER:
        cells = F.array(
            *[
                F.struct(
                    F.lit(start + i).alias("level"), F.expr(_cell("cx", box["x0"], width / 2.0 ** (start + i))).alias("gx"),
                    F.expr(_cell("cy", box["y0"], width / 2.0 ** (start + i))).alias("gy"),
                )
                for i in finer
            ]
        )
        full = places.select(F.inline(cells)).groupBy("level", "gx", "gy").agg(F.count(F.lit(1)).alias("n"))
        most = {r["level"]: r["most"] for r in full.groupBy("level").agg(F.max("n").alias("most")).collect()}
        for level in sorted(most):
            if most[level] <= CELL_CENTERS:
                return level
    return max(most)


def _within_block(points: DataFrame, places: DataFrame, box, side: float) -> DataFrame:
    """Every point with the nearest center of the nine cells around it, and how far these reach."""
    around = places.selectExpr("*", f"{_cell('cx', box['x0'], side)} AS hx", f"{_cell('cy', box['y0'], side)} AS hy")
    for axis in ("x", "y"):
        around = around.withColumn(f"d{axis}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    around = around.selectExpr("c", "cx", "cy", "hx + dx AS gx", "hy + dy AS gy")
    lists = around.groupBy("gx", "gy").agg(F.collect_list(F.struct("c", "cx", "cy")).alias("near"))
    rows = points.selectExpr("*", f"{_cell('x', box['x0'], side)} AS gx", f"{_cell('y', box['y0'], side)} AS gy")
    d2 = "(x - p.cx) * (x - p.cx) + (y - p.cy) * (y - p.cy)"
    best = rows.join(lists, ["gx", "gy"], "left").withColumn(
        "hit", F.expr(f"array_min(transform(near, p -> named_struct('d2', {d2}, 'c', p.c)))")
    )
    x0, y0 = f"{box['x0']!r}D", f"{box['y0']!r}D"
    s = f"{side!r}D"
    gaps = [
        f"x - ({x0} + (gx - 1) * {s})", f"({x0} + (gx + 2) * {s}) - x",
        f"y - ({y0} + (gy - 1) * {s})", f"({y0} + (gy + 2) * {s}) - y",
    ]
    last_x = math.floor((box["x1"] - box["x0"]) / side)
    last_y = math.floor((box["y1"] - box["y0"]) / side)
    whole = f"gx <= 1 AND gx + 1 >= {last_x} AND gy <= 1 AND gy + 1 >= {last_y}"
    return best.selectExpr(
        "id", "x", "y", "w", "hit.c AS c", "hit.d2 AS d2",
        # A hair less than the true distance, for the rounding of the borders.
        f"least({', '.join(gaps)}) * (1 - 1e-9D) AS margin", f"{whole} AND gx >= -1 AND gy >= -1 AS whole",
    )
