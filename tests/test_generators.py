"""Generated graphs and points against hand-worked and published sizes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkrounds.functions.sizing import heavy_keys
from sparkrounds.operators.filtering import mst_filtering
from sparkrounds.operators.graph import edge_length, mst_weight, vertices_of
from sparkrounds.plans.rounds import merge_rounds, worst_case_rounds
from sparkrounds.sources import graphgen, pointgen

# Hand-worked graph of 5 vertices at sparsity 0.5: edge -> weight per method.
HAND = {
    "UNIQUE": {(0, 1): 1, (1, 2): 2, (2, 3): 3, (3, 4): 4, (0, 2): 5, (0, 3): 6},
    "UNIQUE_REVERSED": {(0, 1): 11, (1, 2): 10, (2, 3): 9, (3, 4): 8, (0, 2): 7, (0, 3): 6},
    "INCIDENT_EDGES_THE_SAME": {
        (0, 1): 1, (1, 2): 2, (2, 3): 2, (3, 4): 3, (0, 2): 1, (0, 3): 1,
    },
    "INCIDENT_EDGES_THE_SAME_REVERSED": {
        (0, 1): 6, (1, 2): 5, (2, 3): 5, (3, 4): 4, (0, 2): 6, (0, 3): 6,
    },
    "ALL_THE_SAME": dict.fromkeys([(0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (0, 3)], 1),
}


@pytest.mark.parametrize("method", list(HAND))
def test_hand_worked_graph(spark, method):
    made = graphgen.build_graph(spark, 5, 0.5, method=method).collect()
    assert {(r["src"], r["dst"]): r["w"] for r in made} == HAND[method]


def test_random_weights_stay_in_range(spark):
    made = graphgen.build_graph(spark, 40, 1.0, method="RANDOM", w_min=100, w_max=110)
    low, high, n = made.agg(F.min("w"), F.max("w"), F.count_distinct("w")).first()
    assert (low, high, n) == (100.0, 110.0, 11)


# (sparsity, cliques) -> edges, for n = 500 and cliques of 5.
@pytest.mark.parametrize(
    ("sparsity", "cliques", "m"),
    [(0.2, 0, 24951), (0.8, 0, 99801), (1.0, 0, 124750), (0.2, 200, 24951), (1.0, 200, 124751)],
)
def test_edge_counts(spark, sparsity, cliques, m):
    coords = spark.range(1000).select("id", F.sin("id").alias("x"), F.cos("id").alias("y"))
    made = graphgen.build_graph(
        spark, 500, sparsity, method="UNIQUE", cliques=cliques, clique_size=5, coords=coords
    )
    assert made.count() == made.select("src", "dst").distinct().count() == m
    assert vertices_of(made).count() == max(500, 5 * cliques)


def test_unique_weights_make_the_path_the_tree(spark):
    made = graphgen.build_graph(spark, 60, 0.7, method="UNIQUE")
    assert mst_weight(mst_filtering(made).tree).first() == (59, 59 * 60 / 2)


def test_fill_positions_at_scale(spark):
    """Closed-form rows stay exact far out in the sequence."""
    n = 1_000_000
    last = graphgen.max_edges(n) - (n - 1)
    fill = graphgen._exact_start(n)
    for position in (0, n, last // 3, last - 1):
        row = graphgen.fill_rows(spark.range(position, position + 1), n).first()
        start = spark.range(1).select(fill(F.lit(row["src"]).cast("long"))).first()[0]
        assert start <= position < start + n - 2 - row["src"]
        assert row["dst"] == row["src"] + 2 + position - start


@pytest.mark.parametrize(
    ("n", "m", "subsets"),
    [
        (500, 24951, [5, 2]), (500, 49901, [7, 2]), (500, 74851, [9, 2]),
        (500, 99801, [10, 3, 1]), (500, 124750, [11, 3, 2]),
        (1000, 24951, [4, 2]), (1000, 124751, [8, 2]), (1, 0, []), (4, 0, []),
    ],
)
def test_round_schedule(n, m, subsets):
    assert [r.subsets for r in worst_case_rounds(n, m, 0.125)] == subsets


def test_merge_rounds():
    goldens = {1: 1, 2: 2, 3: 2, 5: 3, 6: 3, 7: 3, 8: 4, 16: 5}
    assert {sets: merge_rounds(sets) for sets in goldens} == goldens


def test_point_sets(spark):
    made = pointgen.points_catalog(spark, [300])
    sizes = {(r["dataset"], r["label"]): r["count"] for r in made.groupBy("dataset", "label").count().collect()}
    assert sizes == {
        **{("Noisy circle", i): 150 for i in range(2)},
        **{("Noisy moon", i): 150 for i in range(2)},
        **{(name, i): 100 for name in pointgen.DATASETS[2:] for i in range(3)},
    }


def test_circle_radii(spark):
    made = pointgen.points_circles(spark, 1000, noise=0.0)
    radius = F.round(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), 6)
    found = {(r["label"], r["r"]) for r in made.select("label", radius.alias("r")).distinct().collect()}
    assert found == {(0, 1.0), (1, 0.5)}


def test_shells_are_nested(spark):
    made = pointgen.gaussian_quantile_points(spark, 1001)
    center = made.agg(F.avg("x"), F.avg("y")).first()
    d2 = (F.col("x") - center[0]) ** 2 + (F.col("y") - center[1]) ** 2
    shells = made.groupBy("label").agg(F.min(d2), F.max(d2), F.count("*")).orderBy("label").collect()
    assert [s[3] for s in shells] == [334, 334, 333]
    assert shells[0][2] <= shells[1][1] and shells[1][2] <= shells[2][1]


def _counted(spark, edges):
    """The edges as a table that counts how many of its rows are made, and that count."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(edges, "src long, dst long")
    return df.mapInArrow(run, "src long, dst long"), seen


def test_lookups_by_vertex_make_the_edges_once(spark):
    """Not anew for every count, set of hot keys and join."""
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 39)]
    df, seen = _counted(spark, edges)
    weights = {(r["src"], r["dst"]): r["w"] for r in graphgen.weight_incident(df).collect()}
    assert seen.value == len(edges) and weights[(0, 7)] == 1.0 and len(weights) == len(edges)
    df, seen = _counted(spark, edges)
    coords = spark.range(40).selectExpr("id", "double(id) AS x", "0D AS y")
    lengths = {(r["src"], r["dst"]): r["w"] for r in edge_length(df, coords).collect()}
    assert seen.value == len(edges) and lengths == {(a, b): float(b - a) for a, b in edges}


def test_hot_keys_are_found_by_a_sketch(spark):
    """Every key above the share is found, whatever its type; no count of all keys is shuffled."""
    rows = spark.range(60_000).selectExpr("if(id % 5 = 0, 7, if(id % 100 = 1, NULL, id)) AS key")
    for kind in ("long", "string", "binary"):
        keyed = rows.selectExpr(f"CAST(CAST(key AS string) AS {kind}) AS key")
        hot = heavy_keys(keyed, "key", 60_000)
        found = {r["hot_key"] if r["hot_key"] is None else str(int(r["hot_key"])) for r in hot.collect()}
        assert found - {None} == {"7"}
    plan = heavy_keys(rows, "key", 60_000)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" not in plan
