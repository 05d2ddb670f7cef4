"""Headline timings on local[$BENCH_CPUS]; prints one JSON line.

Two groups: the published configurations (generated graphs with n = 500 and
eps = 1/8; point sets of 1 500 to 50 000 points in 8 sets), and the same
operators over the tables in $BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkrounds.catalog import FIXTURES, QUERIES
from sparkrounds.catalog.bindings import part_supplier_edges
from sparkrounds.operators.boruvka import minimum_spanning_forest
from sparkrounds.operators.components import single_linkage
from sparkrounds.operators.coreset import coreset_merge_reduce
from sparkrounds.operators.filtering import mst_filtering
from sparkrounds.operators.graph import mst_weight
from sparkrounds.plans.lineage import materialize
from sparkrounds.sources.graphgen import build_graph
from sparkrounds.sources.pointgen import affine_points, points_blobs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("sparkrounds-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.log.level", "ERROR")
    )
    return builder.getOrCreate()


def cases(spark: SparkSession) -> dict:
    def graph(sparsity: float, method: str = "RANDOM", cliques: int = 0):
        coords = spark.range(1000).select(
            "id", F.cos("id").alias("x"), F.sin(F.col("id") * 2).alias("y")
        )
        return materialize(
            build_graph(
                spark, 500, sparsity, method=method, w_max=100, cliques=cliques, coords=coords
            ),
            "bench-graph",
        )

    def tree(edges, n: int):
        return lambda: mst_weight(mst_filtering(edges, n_vertices=n).tree).collect()

    def reduce(points, k: int, sampling: str, size: int = 10):
        return lambda: coreset_merge_reduce(
            points, k, sets=8, sampling=sampling, sample_size=size, schedule="two_ring"
        ).count()

    out = {}
    for sparsity in (0.2, 0.6, 1.0):
        out[f"mst_n500_s{sparsity}"] = tree(graph(sparsity), 500)
    out["mst_n500_s1.0_cliques200"] = tree(graph(1.0, cliques=200), 1000)
    out["mst_n500_s1.0_incident"] = tree(graph(1.0, "INCIDENT_EDGES_THE_SAME"), 500)
    for n in (1500, 10000, 50000):
        blobs = affine_points(points_blobs(spark, n)).withColumn("w", F.lit(1.0))
        points = materialize(blobs.select("id", "x", "y", "w"), "bench-points")
        out[f"coreset_grid_{n}"] = reduce(points, 3, "grid")
        if n == 50000:
            for share in (0.001, 0.01, 0.1):
                out[f"coreset_annulus_{n}_{share}"] = reduce(
                    points, 3, "annulus", int(n * share)
                )
    edges = materialize(part_supplier_edges(spark, SF_DIR), "bench-edges")
    out["mst_filtering_table"] = lambda: mst_weight(mst_filtering(edges).tree).collect()
    out["mst_boruvka_table"] = lambda: mst_weight(minimum_spanning_forest(edges)).collect()
    out["single_linkage_table"] = lambda: single_linkage(mst_filtering(edges).tree, 10).count()
    for name in (
        "canonical_edges", "partition_forests", "coreset_once", "coreset_merge_reduce",
        "kmeanspp_seed", "kmeans_fit", "build_graph", "build_graph_incident", "pivot_mean",
        "facet_pivot", "mean_all_numeric", "transpose_means", "rounds_long",
    ):
        out[name] = lambda name=name: {**FIXTURES, **QUERIES}[name](spark, SF_DIR).count()
    return out


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    for name, run in cases(spark).items():
        started = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
