"""Connected components by alternating stars, and single-linkage clusters.

Components: links point from the larger vertex (hi) to the smaller (lo).  First
every task folds the links it holds into stars.  Then two steps alternate until
nothing moves.  Large star: a link's lower end gives way to its own smallest
neighbour.  Small star: of all lower ends of a vertex the smallest stays, and
the others are linked to it.  Both keep the components, and the smallest vertex
of each ends up as the center of all its others.

A step is one map-side-combining aggregate and one lookup by vertex.  Centers
with very many links are served by broadcast and their rows salted (see
:func:`lookup`), so one component may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrounds.functions.checks import require
from sparkrounds.functions.forests import streaming_stars
from sparkrounds.functions.ranking import beyond, kth_row
from sparkrounds.functions.sizing import BROADCAST_ROWS, lookup
from sparkrounds.operators.graph import vertices_of
from sparkrounds.plans.lineage import discard, materialize, materialize_counted, materialize_measured

# Links that a task folds at once.
TASK_LINKS = 4_000_000


def stars(
    links: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, task_links: int = TASK_LINKS
) -> DataFrame:
    """``(id, center)`` of every vertex of ``links`` (src, dst) but the centers, stored.

    ``center`` is the smallest vertex that the links reach.  Loops and repeated
    links do no harm; ids are LONG.
    """
    require(links, "src", "dst", what="links")
    ends = links.select(F.greatest("src", "dst").cast("long").alias("hi"), F.least("src", "dst").cast("long").alias("lo"))
    folded = ends.filter("hi <> lo").mapInArrow(streaming_stars(task_links), "hi long, lo long")
    now, seen = materialize_measured(folded, "stars")
    moved = seen["rows"]
    while moved:
        last = now
        step = _round(now.select("hi", "lo"), seen["rows"], broadcast_rows)
        now, seen = materialize_measured(step, "stars", moved=F.count_if("moved"))
        moved = seen["moved"]
        discard(last)
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("center"))


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("v"))


def _round(links: DataFrame, n: int, limit: int) -> DataFrame:
    """One large and one small star step; ``moved`` marks links that either of them changed."""
    sizes = {"table_rows": n, "big_rows": n, "limit": limit}
    large = lookup(links, "lo", _smallest(links), "m", spread=["hi"], **sizes)
    large = large.select("hi", F.coalesce("m", "lo").alias("lo"), F.col("m").isNotNull().alias("moved"))
    if n > limit:
        large = materialize(large, "stars-large")
    small = lookup(large, "hi", _smallest(large), "m", spread=["lo"], **sizes)
    pairs = F.when(F.col("lo") == F.col("m"), F.array(F.struct("hi", F.col("m").alias("lo"), "moved"))).otherwise(
        F.array(
            F.struct("hi", F.col("m").alias("lo"), F.lit(True).alias("moved")),
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"), F.lit(True).alias("moved")),
        )
    )
    return small.select(F.inline(pairs)).groupBy("hi", "lo").agg(F.max("moved").alias("moved"))


def connected_components(
    edges: DataFrame, vertices: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``(id, cluster)`` with ``cluster`` = smallest vertex id of the component."""
    centers = stars(edges, broadcast_rows=broadcast_rows)
    named = vertices.select("id").join(centers, "id", "left")
    return named.select("id", F.coalesce("center", "id").alias("cluster"))


def mst_cut(tree: DataFrame, clusters: int) -> DataFrame:
    """The tree without its ``clusters - 1`` heaviest edges under ``(w, src, dst)``.

    The lightest edge to go is found by refined histograms, whatever its place;
    the cut itself is a filter.  All edges go where there are fewer.
    """
    require(tree, "src", "dst", "w", what="tree")
    if clusters < 1:
        raise ValueError("clusters must be at least 1")
    tree = tree.select("src", "dst", "w")
    if clusters == 1:
        return tree
    tree, n = materialize_counted(tree, "cut-tree")
    if clusters > n:
        return tree.filter("false")
    order = ["w", "src", "dst"]
    return tree.filter(beyond(order, kth_row(tree, order, n - clusters + 1)) <= 0)


def single_linkage(
    tree: DataFrame,
    clusters: int,
    vertices: DataFrame | None = None,
    *,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(id, cluster)``; ``cluster`` is the smallest vertex id of the cluster."""
    ids = vertices_of(tree) if vertices is None else vertices
    return connected_components(mst_cut(tree, clusters), ids, broadcast_rows=broadcast_rows)
