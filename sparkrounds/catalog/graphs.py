"""Graph queries: views of edge tables, spanning forests, filtering rounds, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrounds.catalog.bindings import (
    NATION_EDGES,
    PART_SUPPLIER_EDGES,
    nation_edges,
    nation_ids,
    nation_pairs,
    part_supplier_edges,
    part_supplier_pairs,
    sql_forest,
    sql_hash32,
    sql_minimax,
    table,
)
from sparkrounds.catalog.registry import query
from sparkrounds.operators import boruvka, components, filtering, graph
from sparkrounds.plans.lineage import materialize, materialize_counted
from sparkrounds.plans.rounds import FilterSchedule, worst_case_rounds

EPSILON = 0.125
_TREE = f"WITH {NATION_EDGES}, {sql_minimax()}"
_PS_TREE = (
    f"WITH {PART_SUPPLIER_EDGES}, keyed AS (SELECT 0 AS g, * FROM raw), "
    + sql_forest("keyed", "tree")
)
# n, m and k of the first filtering round, as scalars.
_SIZES = """sizes AS (SELECT (SELECT count(*) FROM raw) AS m,
  (SELECT count(DISTINCT v) FROM (SELECT src AS v FROM raw UNION ALL SELECT dst FROM raw)) AS n)"""
_FIRST_K = """k1 AS (SELECT greatest(1, ceil(pow(n, (ln(m::DOUBLE / n) / ln(n) - 0.125) / 2)))::BIGINT
  AS k FROM sizes)"""


def _dealt(seed: str, source: str, k: str) -> str:
    return f"SELECT ({sql_hash32(seed, 'src', 'dst')} % (SELECT k FROM {k})) AS g, src, dst, w FROM {source}"


@query(
    "canonical_edges",
    f"WITH {NATION_EDGES} SELECT src, dst, w FROM raw",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.canonical_edges(nation_pairs(spark, sf))


@query(
    "canonical_edges_part_supplier",
    f"WITH {PART_SUPPLIER_EDGES} SELECT src, dst, w FROM raw",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.canonical_edges(part_supplier_pairs(spark, sf))


@query(
    "vertices_of",
    f"WITH {PART_SUPPLIER_EDGES} SELECT src AS id FROM raw UNION SELECT dst FROM raw",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.vertices_of(part_supplier_edges(spark, sf))


@query(
    "vertex_degree",
    f"""WITH {PART_SUPPLIER_EDGES} SELECT id, count(*) AS degree FROM
    (SELECT src AS id FROM raw UNION ALL SELECT dst FROM raw) GROUP BY id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.vertex_degree(part_supplier_edges(spark, sf))


@query(
    "graph_size",
    f"""WITH {PART_SUPPLIER_EDGES}, {_SIZES}
    SELECT m AS n_edges, n AS n_vertices FROM sizes""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_size(part_supplier_edges(spark, sf))


@query(
    "symmetric_edges",
    f"""WITH {PART_SUPPLIER_EDGES} SELECT src AS u, dst AS v, w FROM raw
    UNION ALL SELECT dst, src, w FROM raw""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graph.symmetric_edges(part_supplier_edges(spark, sf))


@query(
    "edge_length",
    f"""WITH {PART_SUPPLIER_EDGES}, coords AS
    (SELECT event_id AS id, hour(ts)::DOUBLE AS x, value AS y FROM events)
    SELECT src, dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS w
    FROM raw JOIN coords a ON src = a.id JOIN coords b ON dst = b.id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    coords = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.hour("ts").cast("double").alias("x"), F.col("value").alias("y")
    )
    far = graph.edge_length(part_supplier_edges(spark, sf), coords)
    return far.withColumn("w", F.round("w", 6))


@query(
    "remove_edges",
    f"""WITH {PART_SUPPLIER_EDGES} SELECT src, dst, w FROM raw
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R'
      AND least(2 * l_partkey, 2 * l_suppkey + 1) = src
      AND greatest(2 * l_partkey, 2 * l_suppkey + 1) = dst)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        (F.col("l_partkey") * 2).alias("src"),
        (F.col("l_suppkey") * 2 + 1).alias("dst"),
        F.lit(0.0).alias("w"),
    )
    return graph.remove_edges(part_supplier_edges(spark, sf), graph.canonical_edges(returned))


@query("mst_boruvka", f"{_PS_TREE} SELECT src, dst, w FROM tree")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return boruvka.minimum_spanning_forest(part_supplier_edges(spark, sf))


@query("mst_boruvka_nation", f"{_TREE} SELECT src, dst, w FROM tree")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return boruvka.minimum_spanning_forest(nation_edges(spark, sf))


@query(
    "mst_weight",
    f"{_TREE} SELECT count(*) AS n_edges, round(sum(w), 2) AS total_weight FROM tree",
)
def mst_weight(spark: SparkSession, sf: str) -> DataFrame:
    return graph.mst_weight(boruvka.minimum_spanning_forest(nation_edges(spark, sf)))


@query("mst_filtering", f"{_PS_TREE} SELECT src, dst, w FROM tree")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filtering.mst_filtering(part_supplier_edges(spark, sf), epsilon=EPSILON).tree


@query("mst_filtering_nation", f"{_TREE} SELECT src, dst, w FROM tree")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filtering.mst_filtering(nation_edges(spark, sf), epsilon=EPSILON).tree


@query(
    "round_plan",
    f"""WITH RECURSIVE {PART_SUPPLIER_EDGES}, {_SIZES},
    plan AS (
      SELECT 0 AS round, 0::BIGINT AS k, m, n, ln(m::DOUBLE / n) / ln(n) AS c FROM sizes
      UNION ALL
      SELECT round + 1, kk, least(m, kk * (n - 1)), n, c2 FROM
        (SELECT *, greatest(1, ceil(pow(n, (c - 0.125) / 2)))::BIGINT AS kk, (c - 0.125) / 2 AS c2
         FROM plan WHERE m > pow(n, 1.125)))
    SELECT round, k, m AS edges_bound FROM plan WHERE round > 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    size = graph.graph_size(part_supplier_edges(spark, sf)).first()
    rounds = worst_case_rounds(size["n_vertices"], size["n_edges"], EPSILON)
    return spark.createDataFrame(
        [(r.number, r.subsets, r.edges_bound) for r in rounds],
        "round int, k long, edges_bound long",
    )


@query(
    "partition_edges",
    f"""WITH {PART_SUPPLIER_EDGES} SELECT src, dst, w,
    ({sql_hash32('100:1', 'src', 'dst')} % 8)::INTEGER AS part FROM raw""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filtering.partition_edges(part_supplier_edges(spark, sf), 8, seed=100)


def _first_round(spark: SparkSession, sf: str) -> tuple[DataFrame, int, int]:
    """Stored edges dealt for round 1 of the schedule, with k and the vertex count."""
    edges, m = materialize_counted(part_supplier_edges(spark, sf), "edges")
    n = graph.vertices_of(edges).count()
    k = FilterSchedule(n, m, EPSILON).next_subsets()
    return filtering.partition_edges(edges, k), k, n


_ROUND_ONE = (
    f"WITH {PART_SUPPLIER_EDGES}, {_SIZES}, {_FIRST_K}, dealt AS ({_dealt('100:1', 'raw', 'k1')}), "
    + sql_forest("dealt", "kept")
)


@query("partition_forests", f"{_ROUND_ONE} SELECT g::INTEGER AS part, src, dst, w FROM kept")
def _(spark: SparkSession, sf: str) -> DataFrame:
    parted, k, n = _first_round(spark, sf)
    return filtering.partition_forests(parted, k, n_vertices=n)


@query(
    "forest_gap",
    f"""{_ROUND_ONE} SELECT a.g::INTEGER AS part, edges_in, forest_edges,
    (SELECT n FROM sizes) - 1 - forest_edges AS forest_gap
    FROM (SELECT g, count(*) AS edges_in FROM dealt GROUP BY g) a
    JOIN (SELECT g, count(*) AS forest_edges FROM kept GROUP BY g) b ON a.g = b.g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parted, k, n = _first_round(spark, sf)
    forests = filtering.partition_forests(parted, k, n_vertices=n)
    return filtering.forest_gap(parted, forests, n)


@query("reduce_round", f"{_ROUND_ONE} SELECT src, dst, w FROM kept")
def _(spark: SparkSession, sf: str) -> DataFrame:
    parted, k, n = _first_round(spark, sf)
    return filtering.reduce_round(parted, k, n_vertices=n)


_ROUND_TWO = (
    """k2 AS (SELECT greatest(1, ceil(pow(n, ((ln(m::DOUBLE / n) / ln(n) - 0.125) / 2 - 0.125) / 2)))::BIGINT
      AS k FROM sizes), """
    + f"dealt2 AS ({_dealt('100:2', 'kept', 'k2')}), "
    + sql_forest("dealt2", "kept2")
    + ", m1 AS (SELECT count(*) AS m FROM kept), m2 AS (SELECT count(*) AS m FROM kept2)"
)


@query(
    "round_forests",
    # Two rounds, which is what the schedule takes on this table.
    f"""{_ROUND_ONE}, {_ROUND_TWO}
    SELECT 1 AS round, g::INTEGER AS part, src, dst, w FROM kept
    UNION ALL SELECT 2, g::INTEGER, src, dst, w FROM kept2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return filtering.mst_filtering(part_supplier_edges(spark, sf), epsilon=EPSILON).forests


@query(
    "round_log",
    # Two rounds, which is what the schedule takes on this table.
    f"""{_ROUND_ONE}, {_ROUND_TWO}
    SELECT 'run' AS run, 1 AS round, k::INTEGER AS k, sizes.m AS edges_in, m1.m AS edges_out
    FROM sizes, k1, m1 WHERE sizes.m > pow(n, 1.125)
    UNION ALL SELECT 'run', 2, k::INTEGER, m1.m, m2.m FROM sizes, k2, m1, m2
    WHERE m1.m > pow(n, 1.125)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = filtering.mst_filtering(part_supplier_edges(spark, sf), epsilon=EPSILON).log
    return log.drop("secs")


@query(
    "mst_cut",
    f"""{_PS_TREE} SELECT src, dst, w FROM (SELECT *, row_number() OVER
    (ORDER BY w DESC, src DESC, dst DESC) AS h FROM tree) WHERE h > 9""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    tree = filtering.mst_filtering(part_supplier_edges(spark, sf)).tree
    return components.mst_cut(tree, 10)


@query(
    "single_linkage",
    f"""{_TREE} SELECT n_nationkey::BIGINT AS id, coalesce(
      (SELECT min(v) FROM closed WHERE u = n_nationkey AND r < (SELECT min(r) FROM
        (SELECT r FROM tree ORDER BY r DESC LIMIT 6))), n_nationkey)::BIGINT AS cluster
    FROM nation""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    tree = materialize(boruvka.minimum_spanning_forest(nation_edges(spark, sf)), "tree")
    return components.single_linkage(tree, 7, nation_ids(spark, sf))


@query(
    "single_linkage_sizes",
    f"""{_PS_TREE.replace("WITH", "WITH RECURSIVE", 1)}, cut AS (SELECT src, dst FROM
      (SELECT *, row_number() OVER (ORDER BY w DESC, src DESC, dst DESC) AS h FROM tree) WHERE h > 9),
    sides AS MATERIALIZED (SELECT src AS a, dst AS b FROM cut UNION ALL SELECT dst, src FROM cut),
    reach AS (
      SELECT id AS u, id AS v FROM (SELECT src AS id FROM raw UNION SELECT dst FROM raw)
      UNION SELECT u, b FROM reach JOIN sides ON v = a)
    SELECT cluster, count(*) AS size FROM (SELECT u, min(v) AS cluster FROM reach GROUP BY u)
    GROUP BY cluster""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    tree = filtering.mst_filtering(part_supplier_edges(spark, sf)).tree
    clusters = components.single_linkage(tree, 10)
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
