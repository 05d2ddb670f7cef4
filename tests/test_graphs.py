"""Forests, filtering rounds and clusters against a tiny Kruskal."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkrounds.functions import forests
from sparkrounds.functions.hashing import uniform
from sparkrounds.operators import boruvka, evaluate, filtering, graph
from sparkrounds.operators.boruvka import contract, minimum_spanning_forest
from sparkrounds.operators.components import connected_components, mst_cut, single_linkage, stars
from sparkrounds.operators.filtering import (
    forest_gap,
    mst_filtering,
    partition_edges,
    partition_forests,
    reduce_round,
)
from sparkrounds.schemas import EDGES


def kruskal(edges):
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    kept = []
    for src, dst, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        a, b = root(src), root(dst)
        if a != b:
            parent[a] = b
            kept.append((src, dst, w))
    groups = {}
    for v in list(parent):
        groups.setdefault(root(v), set()).add(v)
    return set(kept), {frozenset(g) for g in groups.values()}


def random_graph(n, m, seed, ties=False):
    rng = random.Random(seed)
    pairs = set()
    while len(pairs) < m:
        a, b = sorted(rng.sample(range(n), 2))
        pairs.add((a, b))
    return [(a, b, float(rng.randint(1, 3) if ties else rng.random())) for a, b in sorted(pairs)]


def star(n):
    return [(0, i, 1.0) for i in range(1, n)]


GRAPHS = {
    "random": random_graph(60, 300, 1),
    "ties": random_graph(60, 300, 2, ties=True),
    "sparse": random_graph(80, 60, 3),
    "star": star(120),
    "path": [(i, i + 1, float(1000 - i)) for i in range(100)],
    "far ids": [(a * 10**12 - 5, b * 10**12, w) for a, b, w in random_graph(20, 40, 4)],
}


def table(spark, edges):
    return spark.createDataFrame(edges, EDGES)


def rows(df):
    return {(r["src"], r["dst"], r["w"]) for r in df.select("src", "dst", "w").collect()}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_forest_by_contraction(spark, name):
    tree, _ = kruskal(GRAPHS[name])
    assert rows(minimum_spanning_forest(table(spark, GRAPHS[name]))) == tree


@pytest.mark.parametrize("name", ["ties", "star", "sparse"])
def test_forest_with_shuffled_lookups(spark, name):
    """A broadcast limit of zero sends every lookup down the salted path."""
    tree, _ = kruskal(GRAPHS[name])
    assert rows(minimum_spanning_forest(table(spark, GRAPHS[name]), broadcast_rows=0)) == tree


@pytest.mark.parametrize("name", ["random", "ties", "sparse", "far ids"])
def test_filtering_equals_kruskal(spark, name):
    tree, _ = kruskal(GRAPHS[name])
    result = mst_filtering(table(spark, GRAPHS[name]), epsilon=0.05)
    assert rows(result.tree) == tree


def test_filtering_without_room_for_a_forest(spark):
    """Forests larger than a task are passed on; contraction still gives the exact tree."""
    edges = GRAPHS["random"]
    tree, _ = kruskal(edges)
    for room in (8, 130, 200):
        result = mst_filtering(table(spark, edges), epsilon=0.05, max_task_rows=room)
        assert rows(result.tree) == tree


def test_filtering_logs_its_rounds(spark):
    edges = random_graph(40, 700, 5)
    result = mst_filtering(table(spark, edges), epsilon=0.125)
    log = result.log.orderBy("round").collect()
    assert [r["round"] for r in log] == list(range(1, result.rounds + 1))
    assert log[0]["edges_in"] == 700
    assert all(a["edges_out"] == b["edges_in"] for a, b in zip(log, log[1:]))


def test_result_ignores_partitioning(spark):
    edges = table(spark, GRAPHS["ties"])
    seen = {frozenset(rows(mst_filtering(edges.repartition(p), epsilon=0.05).tree)) for p in (1, 7)}
    assert len(seen) == 1


@pytest.mark.parametrize("room", [10_000, 60])
def test_subset_forests(spark, room):
    """Per subset the forest is Kruskal's, streamed or contracted."""
    parted = partition_edges(table(spark, GRAPHS["random"]), 4, seed=7)
    by_part = {}
    for r in parted.collect():
        by_part.setdefault(r["part"], []).append((r["src"], r["dst"], r["w"]))
    want = {(p, *e) for p, edges in by_part.items() for e in kruskal(edges)[0]}
    forests = partition_forests(parted, 4, n_vertices=60, max_task_rows=room)
    assert {(r["part"], r["src"], r["dst"], r["w"]) for r in forests.collect()} == want
    for r in forest_gap(parted, forests, 60).collect():
        assert r["forest_gap"] == 59 - len(kruskal(by_part[r["part"]])[0])


def test_reduce_round_keeps_the_tree(spark):
    edges = GRAPHS["random"]
    kept = rows(reduce_round(table(spark, edges), 3, n_vertices=60))
    assert kruskal(edges)[0] <= kept < set(edges)


def test_empty_and_loops(spark):
    empty = table(spark, [])
    assert minimum_spanning_forest(empty).count() == 0
    assert mst_filtering(empty).tree.count() == 0
    raw = table(spark, [(2, 1, 5.0), (1, 2, 3.0), (4, 4, 1.0)])
    assert rows(graph.canonical_edges(raw)) == {(1, 2, 3.0)}


@pytest.mark.parametrize("limit", [0, 1_000_000])
@pytest.mark.parametrize("name", ["sparse", "star"])
def test_components(spark, name, limit):
    edges = GRAPHS[name]
    _, groups = kruskal(edges)
    ids = sorted({v for e in edges for v in e[:2]}) + [9999]
    vertices = spark.createDataFrame([(i,) for i in ids], "id long")
    found = connected_components(table(spark, edges), vertices, broadcast_rows=limit).collect()
    want = {v: min(g) for g in groups for v in g} | {9999: 9999}
    assert {r["id"]: r["cluster"] for r in found} == want


@pytest.mark.parametrize("clusters", [1, 2, 5, 200])
def test_single_linkage(spark, clusters):
    tree, _ = kruskal(GRAPHS["ties"])
    ordered = sorted(tree, key=lambda e: (e[2], e[0], e[1]))
    left = ordered[: max(0, len(ordered) - clusters + 1)]
    _, groups = kruskal(left)
    want = {v: v for e in tree for v in e[:2]} | {v: min(g) for g in groups for v in g}
    edges = table(spark, sorted(tree))
    assert rows(mst_cut(edges, clusters)) == set(left)
    found = single_linkage(edges, clusters).collect()
    assert {r["id"]: r["cluster"] for r in found} == want


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_stars_of_hot_centers_and_long_paths(spark, limit):
    """One center with most links, a long path dealt over tasks, loops and repeats, folds of two rows."""
    links = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(7000, 7000), (6999, 6998)] * 2
    random.Random(1).shuffle(links)
    df = spark.createDataFrame(links, "src long, dst long").repartition(7)
    want = {i: 0 for i in range(1, 3000)} | {i: 5000 for i in range(5001, 5201)} | {6999: 6998}
    found = stars(df, broadcast_rows=limit, task_links=2 if limit else 1000).collect()
    assert {r["id"]: r["center"] for r in found} == want and len(found) == len(want)
    assert stars(df.filter("false")).count() == 0


def test_forest_sorts_nothing_but_the_ranking(spark):
    plan = boruvka._lightest_edge(
        spark.createDataFrame([(1, 2, 3)], "a long, b long, r long")
    )._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_contraction_halves_components(spark):
    steps = contract(table(spark, GRAPHS["random"]))
    assert all(2 * b <= a for a, b in zip(steps.sizes, steps.sizes[1:]))


def test_views(spark):
    edges = table(spark, [(1, 2, 5.0), (1, 3, 4.0)])
    degrees = {r["id"]: r["degree"] for r in graph.vertex_degree(edges).collect()}
    assert degrees == {1: 2, 2: 1, 3: 1}
    assert graph.symmetric_edges(edges).count() == 4
    assert graph.graph_size(edges).first() == (2, 3)
    gone = table(spark, [(1, 3, 0.0)])
    assert rows(graph.remove_edges(edges, gone)) == {(1, 2, 5.0)}
    coords = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, 1.0)], "id long, x double, y double")
    assert rows(graph.edge_length(edges, coords)) == {(1, 2, 5.0), (1, 3, 1.0)}
    with pytest.raises(ValueError, match="lacks column"):
        graph.canonical_edges(edges.select(F.col("src")))


def test_vertex_blocks_filter_when_a_forest_exceeds_a_task(spark):
    edges = random_graph(120, 3000, 9)
    df = spark.createDataFrame(edges, EDGES)
    want, _ = kruskal(edges)
    # A forest of 120 vertices exceeds 100 rows; one of two blocks does not.
    result = mst_filtering(df, max_task_rows=100)
    assert {tuple(r) for r in result.tree.collect()} == want
    log = result.log.filter("round > 0").orderBy("round").collect()
    assert result.rounds == len(log) >= 1 and log[0]["edges_out"] < log[0]["edges_in"]


@pytest.mark.parametrize("weight", [None, float("nan")])
def test_every_path_refuses_weights_without_order(spark, weight):
    df = spark.createDataFrame([(0, 1, weight), (1, 2, 1.0), (0, 2, 2.0)], EDGES)
    for run in (minimum_spanning_forest, lambda e: mst_filtering(e).tree):
        with pytest.raises(Exception, match="null or NaN weight"):
            run(df).collect()


def test_edges_without_coordinates_fail(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], EDGES)
    coords = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0)], "id long, x double, y double")
    with pytest.raises(Exception, match="no coordinates"):
        graph.edge_length(edges, coords).collect()


def _folded(edges, limit):
    """The forest that a task emits for ``edges`` in batches of 50."""
    columns = [pa.array([0] * len(edges), pa.int32()), *(pa.array(c) for c in zip(*edges))]
    whole = pa.Table.from_arrays(columns, ["part", "src", "dst", "w"])
    out = forests.streaming_forest(limit)(iter(whole.to_batches(50)))
    return {r for b in out for r in zip(*(b.column(c).to_pylist() for c in ("src", "dst", "w")))}


def test_folds_take_few_bytes_a_row():
    """A fold needs under 80 bytes a row beside the rows."""
    rng = np.random.default_rng(3)
    m, n = 1_500_000, 60_000
    src, dst = rng.integers(0, n, m), rng.integers(n, 2 * n, m)
    rows_ = [(np.zeros(m, np.int32), src, dst, rng.random(m))]
    tracemalloc.start()
    kept = forests._forest_of(rows_)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept[0]) <= 2 * n - 1 and peak < 80 * m


def test_folded_forest_is_kruskals():
    for name in GRAPHS:
        tree, _ = kruskal(GRAPHS[name])
        assert _folded(GRAPHS[name], 1000) == tree


@pytest.mark.parametrize("room", [150, 10_000])
def test_remainders_are_finished_by_tasks_that_hold_a_forest(spark, room):
    """However many edges are left, no contraction is needed where a forest of all vertices fits a task."""
    edges = random_graph(70, 1500, 4, ties=True)
    parted = partition_edges(table(spark, edges), 2, seed=3)
    want = set()
    for p in (0, 1):
        mine = [(r["src"], r["dst"], r["w"]) for r in parted.filter(F.col("part") == p).collect()]
        want |= {(p, *e) for e in kruskal(mine)[0]}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(filtering, "minimum_spanning_forest", None)
        found = filtering.exact_forests(parted, 2, 1500, n_vertices=70, max_task_rows=room).collect()
    assert {tuple(r) for r in found} == want


def test_sweep_equals_its_configurations_one_by_one(spark):
    """Also with repeated and unsorted sparsities; every weighted edge is stored once."""
    edges = table(spark, random_graph(80, 900, 6))
    sizes = (1.0, 0.2, 0.6, 0.2)
    stored = []
    keep = evaluate.materialize

    def watched(df, tag, **options):
        out = keep(df, tag, **options)
        if tag == "sweep-edges":
            stored.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(evaluate, "materialize", watched)
        found = evaluate.graph_sweep(edges, sparsities=sizes).collect()
    weighted = evaluate.weightings(edges).withColumn("u", uniform("101:keep", "src", "dst")).collect()
    want = []
    for method in evaluate.METHODS:
        for s in sizes:
            mine = [(r["src"], r["dst"], r["w"]) for r in weighted if r["method"] == method and r["u"] < s]
            tree, _ = kruskal(mine)
            want.append((method, s, len(mine), len(tree), sum(e[2] for e in tree)))
    assert sorted(map(tuple, found)) == sorted(want)
    assert stored == [6 * 900]


def test_timed_sweep_stores_and_hashes_an_edge_once(spark):
    edges = table(spark, random_graph(80, 900, 6))
    stored = {}
    keep = evaluate.materialize_measured

    def watched(df, tag, *options, **measures):
        out, seen = keep(df, tag, *options, **measures)
        stored[tag] = seen["rows"]
        return out, seen

    calls = []
    solve = evaluate.mst_filtering

    def solved(rows, **options):
        calls.append((rows.columns, options["stored_rows"], rows.count(), options["n_vertices"], filtering.vertices_of(rows).count()))
        return solve(rows, **options)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(evaluate, "materialize_measured", watched)
        patch.setattr(evaluate, "mst_filtering", solved)
        log = evaluate.table_eval(edges, methods=("UNIQUE",), sparsities=(1.0, 0.2)).collect()
    assert stored == {"sweep-wide": 900}
    assert [c[0] for c in calls] == [["src", "dst", "w", "dealt"]] * 2
    assert all(c[1] == c[2] and c[3] == c[4] for c in calls)
    assert [(r["Sparsity"], r["Vertices"]) for r in log] == [(1.0, calls[0][3]), (0.2, calls[1][3])]


def test_filtering_of_stored_edges_equals_filtering(spark):
    edges = random_graph(70, 1500, 4, ties=True)
    rows = table(spark, edges)
    dealt = rows.withColumn("dealt", filtering.first_deal(5))
    want = filtering.mst_filtering(rows, seed=5)
    found = filtering.mst_filtering(dealt, seed=5, stored_rows=1500)
    assert want.rounds == found.rounds > 0
    for a, b in ((want.tree, found.tree), (want.forests, found.forests)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(map(tuple, found.tree.collect())) == sorted(kruskal(edges)[0])


def test_order_of_tied_edges_whatever_their_ids():
    draw = np.random.default_rng(1)
    for w in (draw.random(2000), draw.integers(0, 9, 2000).astype(float), np.ones(2000)):
        for most in (100, 1 << 40, (1 << 62) + 5):
            ends = np.unique(draw.integers(-most, most, (2000, 2)), axis=0)
            src, dst = ends[draw.permutation(len(ends))].T
            some = w[: len(src)]
            assert np.array_equal(forests._weight_order(some, src, dst), np.lexsort((dst, src, some)))
