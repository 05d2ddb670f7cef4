"""Edge and vertex tables.

``edges(src LONG, dst LONG, w DOUBLE)`` is canonical when ``src < dst`` and each
pair occurs once.  ``vertices(id LONG)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrounds.functions.checks import require
from sparkrounds.functions.sizing import BROADCAST_ROWS, lookup
from sparkrounds.plans.lineage import materialize_counted


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Orient every edge low-to-high, drop loops, keep the lightest of parallel edges."""
    require(edges, "src", "dst", "w", what="edges")
    pair = edges.filter(F.col("src") != F.col("dst")).select(
        F.least("src", "dst").cast("long").alias("src"),
        F.greatest("src", "dst").cast("long").alias("dst"),
        F.col("w").cast("double").alias("w"),
    )
    return pair.groupBy("src", "dst").agg(F.min("w").alias("w"))


def weighed(edges: DataFrame) -> DataFrame:
    """The edges, failing the job that meets a null or NaN weight: it has no place in any order."""
    bad = F.col("w").isNull() | F.isnan(F.col("w").cast("double"))
    wrong = F.raise_error(
        F.concat(F.lit("null or NaN weight of edge "), F.concat_ws("-", F.to_json(F.struct("src", "dst"))))
    )
    kind = edges.schema["w"].dataType
    return edges.withColumn("w", F.when(bad, wrong.cast(kind)).otherwise(F.col("w")))


def vertices_of(edges: DataFrame) -> DataFrame:
    """Distinct end points of the edges."""
    require(edges, "src", "dst", what="edges")
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Adjacency view: each edge in both directions, from one scan."""
    require(edges, "src", "dst", "w", what="edges")
    both = F.array(
        F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
        F.struct(F.col("dst").alias("u"), F.col("src").alias("v")),
    )
    return edges.select(F.inline(both), F.col("w"))


def vertex_degree(edges: DataFrame) -> DataFrame:
    """Number of edges at each vertex that has any."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: number of edges and of distinct end points."""
    sizes = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    order = vertices_of(edges).agg(F.count(F.lit(1)).alias("n_vertices"))
    return sizes.select(
        F.col("n_edges"), order.select("n_vertices").scalar().alias("n_vertices")
    )


def mst_weight(tree: DataFrame) -> DataFrame:
    """One row: number of edges of a forest and their total weight."""
    return tree.agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.round(F.coalesce(F.sum("w"), F.lit(0.0)), 2).alias("total_weight"),
    )


def remove_edges(
    edges: DataFrame, removed: DataFrame, *, removed_rows: int | None = None
) -> DataFrame:
    """Edges that are not in ``removed`` (by end points)."""
    gone = removed.select("src", "dst")
    if removed_rows is not None and removed_rows <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return edges.join(gone, ["src", "dst"], "left_anti")


def edge_length(edges: DataFrame, coords: DataFrame) -> DataFrame:
    """Weight every edge by the Euclidean distance of its end points' coordinates.

    An edge with an end that has no coordinates fails the job.
    """
    require(coords, "id", "x", "y", what="coords")
    places = coords.select(F.col("id").alias("k"), F.struct("x", "y").alias("v"))
    rows = coords.count()
    stored, m = materialize_counted(edges.select("src", "dst"), "length-pairs")
    ends = stored
    for end, place in (("src", "p"), ("dst", "q")):
        ends = lookup(ends, end, places, place, table_rows=rows, big_rows=m, spread=["src", "dst"], counted_in=stored)
    dx, dy = F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")
    lost = F.raise_error(
        F.concat(F.lit("no coordinates for an end of edge "), F.concat_ws("-", "src", "dst"))
    ).cast("double")
    missing = F.col("p").isNull() | F.col("q").isNull()
    return ends.select(
        "src", "dst", F.when(missing, lost).otherwise(F.sqrt(dx * dx + dy * dy)).alias("w")
    )
