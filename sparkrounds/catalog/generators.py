"""Generated graphs and points as fixtures of tests, and weightings and shells of table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrounds.catalog.bindings import (
    EMBEDDING_POINTS,
    EVENT_POINTS,
    PART_SUPPLIER_EDGES,
    embedding_points,
    event_points,
    part_supplier_edges,
    row_count,
    sql_hash32,
    sql_normals,
)
from sparkrounds.catalog.registry import fixture, query
from sparkrounds.functions.ranking import global_rank
from sparkrounds.operators.graph import vertices_of
from sparkrounds.plans.lineage import materialize
from sparkrounds.sources import graphgen, pointgen

SPARSITY = 0.6
_N = "n AS (SELECT count(*) AS n FROM supplier)"
# All pairs in lexicographic order with their fill position (0 on the backbone).
_PAIRS = f"""{_N}, ids AS (SELECT unnest(generate_series(0, (SELECT n FROM n) - 1)) AS id),
pairs AS (SELECT a.id AS src, b.id AS dst FROM ids a JOIN ids b ON a.id < b.id),
walked AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS pos FROM pairs WHERE dst > src + 1),
backbone AS (SELECT src, dst, src + 1 AS pos FROM pairs WHERE dst = src + 1),
total AS (SELECT round_even((n * (n - 1) / 2)::DOUBLE * {SPARSITY}, 0)::BIGINT AS total FROM n)"""
_LAYERS = f"""{_PAIRS}, fill AS (SELECT src, dst, pos FROM walked
  WHERE pos <= (SELECT total + 1 - (n - 1) FROM total, n)),
layers AS (SELECT *, TRUE AS path FROM backbone UNION ALL SELECT *, FALSE FROM fill)"""
_UNIQUE = "CASE WHEN path THEN pos ELSE (SELECT n FROM n) - 1 + pos END"
_MAX = "(SELECT n * (n - 1) // 2 FROM n)"


def _owners(edges: str, bare: str) -> str:
    """CTEs ending in ``weighted(src, dst, rank)`` by the owner rule."""
    return f"""degree AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM {edges}
      UNION ALL SELECT dst FROM {edges}) GROUP BY id),
    ranks AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS place FROM degree),
    owned AS (SELECT src, dst, least(a.place, b.place) AS place FROM {bare}
      JOIN ranks a ON src = a.id JOIN ranks b ON dst = b.id),
    weighted AS (SELECT src, dst, dense_rank() OVER (ORDER BY place) AS rank FROM owned)"""


def _size(spark: SparkSession, sf: str) -> int:
    return row_count(spark, sf, "supplier")


def _plain_layers(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    n = _size(spark, sf)
    total = graphgen.target_edges(n, SPARSITY)
    fill = graphgen.graph_fill(spark, n, total + 1 - (n - 1))
    return graphgen.graph_backbone(spark, n).unionByName(fill), n


@fixture("graph_backbone", f"WITH {_PAIRS} SELECT src, dst, pos FROM backbone")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graphgen.graph_backbone(spark, _size(spark, sf))


@fixture("graph_fill", f"WITH {_LAYERS} SELECT src, dst, pos FROM fill")
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = _size(spark, sf)
    return graphgen.graph_fill(spark, n, graphgen.target_edges(n, SPARSITY) + 1 - (n - 1))


@fixture(
    "weight_random",
    f"""WITH {_LAYERS} SELECT src, dst,
    (1 + {sql_hash32(100, 'src', 'dst')} % 100)::DOUBLE AS w FROM layers""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    layers, _ = _plain_layers(spark, sf)
    return graphgen.weight_random(layers, w_min=1, w_max=100, seed=100).drop("pos")


@fixture("weight_constant", f"WITH {_LAYERS} SELECT src, dst, 1.0::DOUBLE AS w FROM layers")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graphgen.weight_constant(_plain_layers(spark, sf)[0]).drop("pos")


@fixture("weight_unique", f"WITH {_LAYERS} SELECT src, dst, ({_UNIQUE})::DOUBLE AS w FROM layers")
def _(spark: SparkSession, sf: str) -> DataFrame:
    layers, n = _plain_layers(spark, sf)
    return graphgen.weight_unique(layers, n).drop("pos")


@fixture(
    "weight_unique_reversed",
    f"WITH {_LAYERS} SELECT src, dst, ({_MAX} + 2 - ({_UNIQUE}))::DOUBLE AS w FROM layers",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    layers, n = _plain_layers(spark, sf)
    return graphgen.weight_unique_reversed(layers, n).drop("pos")


@fixture(
    "weight_incident",
    f"""WITH {_LAYERS}, {_owners('layers', 'layers')}
    SELECT src, dst, rank::DOUBLE AS w FROM weighted""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graphgen.weight_incident(_plain_layers(spark, sf)[0])


@fixture(
    "weight_incident_reversed",
    f"""WITH {_LAYERS}, {_owners('layers', 'layers')}
    SELECT src, dst, ((SELECT n FROM n) + 2 - rank)::DOUBLE AS w FROM weighted""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    layers, n = _plain_layers(spark, sf)
    return graphgen.weight_incident(layers, reversed_from=n)


# Weightings of the part-supplier graph: positions are ranks of the pairs (src, dst).
_TABLE = f"""{PART_SUPPLIER_EDGES}, n AS (SELECT count(*) AS m FROM raw),
ids AS (SELECT src AS id FROM raw UNION SELECT dst FROM raw),
placed AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS pos FROM raw)"""


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    pairs = part_supplier_edges(spark, sf).select("src", "dst")
    return global_rank(pairs, [F.col("src"), F.col("dst")])


@query(
    "weight_random",
    f"""WITH {PART_SUPPLIER_EDGES} SELECT src, dst,
    (1 + {sql_hash32(100, 'src', 'dst')} % 100)::DOUBLE AS w FROM raw""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = part_supplier_edges(spark, sf).select("src", "dst")
    return graphgen.weight_random(pairs, w_min=1, w_max=100, seed=100)


@query("weight_constant", f"WITH {PART_SUPPLIER_EDGES} SELECT src, dst, 1.0::DOUBLE AS w FROM raw")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graphgen.weight_constant(part_supplier_edges(spark, sf).select("src", "dst"))


@query("weight_unique", f"WITH {_TABLE} SELECT src, dst, pos::DOUBLE AS w FROM placed")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(spark, sf).select("src", "dst", F.col("pos").cast("double").alias("w"))


@query(
    "weight_unique_reversed",
    f"WITH {_TABLE} SELECT src, dst, (m + 1 - pos)::DOUBLE AS w FROM placed, n",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    placed = _placed(spark, sf)
    m = placed.count()
    return placed.select("src", "dst", (F.lit(m + 1) - F.col("pos")).cast("double").alias("w"))


@query(
    "weight_incident",
    f"""WITH {_TABLE}, {_owners('raw', 'raw')} SELECT src, dst, rank::DOUBLE AS w FROM weighted""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graphgen.weight_incident(part_supplier_edges(spark, sf))


@query(
    "weight_incident_reversed",
    f"""WITH {_TABLE}, {_owners('raw', 'raw')}
    SELECT src, dst, ((SELECT count(*) FROM ids) + 2 - rank)::DOUBLE AS w FROM weighted""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = materialize(part_supplier_edges(spark, sf).select("src", "dst"), "incident-edges")
    return graphgen.weight_incident(pairs, reversed_from=vertices_of(pairs).count())


CLIQUE = 5


def _ring(cliques: str) -> str:
    """CTE ``ring(src, dst)`` of cliques of five."""
    return f"""q AS (SELECT {cliques} AS q FROM n),
    ring_ids AS (SELECT unnest(generate_series(0, (SELECT q * {CLIQUE} FROM q) - 1)) AS id),
    ring AS (SELECT a.id AS src, b.id AS dst FROM ring_ids a JOIN ring_ids b
        ON a.id // {CLIQUE} = b.id // {CLIQUE} AND a.id < b.id
      UNION ALL SELECT least(id + 1, (id + {CLIQUE}) % (q * {CLIQUE})),
        greatest(id + 1, (id + {CLIQUE}) % (q * {CLIQUE})) FROM ring_ids, q WHERE id % {CLIQUE} = 0)"""


@fixture(
    "ring_of_cliques",
    f"WITH {_N}, {_ring('n // 4')} SELECT src, dst FROM ring",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return graphgen.ring_of_cliques(spark, _size(spark, sf) // 4, CLIQUE)


def _clique_graph(weight: str, *, incident: bool) -> str:
    """The clique-mode graph: walk all pairs until one edge more than wanted exists."""
    distance = """ring_w AS (SELECT src, dst,
      sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w
      FROM ring JOIN pts a ON src = a.id JOIN pts b ON dst = b.id)"""
    head = f"""WITH {_PAIRS}, {_ring('n // 4')}, {EVENT_POINTS}, {distance},
    base AS (SELECT count(*) AS m FROM (SELECT src, dst FROM ring UNION SELECT src, dst FROM backbone)),
    counted AS (SELECT walked.*, sum(CASE WHEN ring.src IS NULL THEN 1 ELSE 0 END)
        OVER (ORDER BY pos) AS added, ring.src IS NULL AS fresh
      FROM walked LEFT JOIN ring ON walked.src = ring.src AND walked.dst = ring.dst),
    fill AS (SELECT src, dst, pos FROM counted, base, total WHERE total + 1 - m > 0
      AND added - CASE WHEN fresh THEN 1 ELSE 0 END < total + 1 - m
      AND (fresh OR added < total + 1 - m)),
    layers AS (SELECT *, TRUE AS path FROM backbone UNION ALL SELECT *, FALSE FROM fill)"""
    if not incident:
        return f"""{head} SELECT src, dst, round({weight}, 6) AS w FROM layers
        UNION ALL SELECT src, dst, round(w, 6) FROM ring_w r WHERE NOT EXISTS
          (SELECT 1 FROM layers l WHERE l.src = r.src AND l.dst = r.dst)"""
    return f"""{head}, bare AS (SELECT src, dst FROM layers l WHERE NOT EXISTS
        (SELECT 1 FROM ring r WHERE l.src = r.src AND l.dst = r.dst)),
      whole AS (SELECT src, dst FROM ring UNION ALL SELECT src, dst FROM bare),
      {_owners('whole', 'bare')}
      SELECT src, dst, {weight} AS w FROM weighted
      UNION ALL SELECT src, dst, round(w, 6) FROM ring_w"""


def _build(spark: SparkSession, sf: str, method: str) -> DataFrame:
    n = _size(spark, sf)
    graph = graphgen.build_graph(
        spark, n, SPARSITY, method=method, seed=100, w_min=1, w_max=100,
        cliques=n // 4, clique_size=CLIQUE, coords=event_points(spark, sf),
    )
    return graph.withColumn("w", F.round("w", 6))


@fixture(
    "build_graph",
    _clique_graph(f"(1 + {sql_hash32(100, 'src', 'dst')} % 100)::DOUBLE", incident=False),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _build(spark, sf, "RANDOM")


@fixture("build_graph_same", _clique_graph("1.0::DOUBLE", incident=False))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _build(spark, sf, "ALL_THE_SAME")


@fixture("build_graph_unique", _clique_graph(f"({_UNIQUE})::DOUBLE", incident=False))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _build(spark, sf, "UNIQUE")


@fixture(
    "build_graph_unique_reversed",
    _clique_graph(f"({_MAX} + 2 - ({_UNIQUE}))::DOUBLE", incident=False),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _build(spark, sf, "UNIQUE_REVERSED")


@fixture("build_graph_incident", _clique_graph("rank::DOUBLE", incident=True))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _build(spark, sf, "INCIDENT_EDGES_THE_SAME")


@fixture(
    "build_graph_incident_reversed",
    _clique_graph("((SELECT n FROM n) + 2 - rank)::DOUBLE", incident=True),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _build(spark, sf, "INCIDENT_EDGES_THE_SAME_REVERSED")


# Points -----------------------------------------------------------------------


def _ids(n: str) -> str:
    return f"(SELECT unnest(generate_series(0, {n} - 1)) AS id)"


def _circles(n: str) -> str:
    zx, zy = sql_normals("0:circles", "id")
    return f"""SELECT id, s * cos(t) + {zx} * 0.05 AS x, s * sin(t) + {zy} * 0.05 AS y, label FROM (
      SELECT id, CASE WHEN id >= {n} // 2 THEN 0.5 ELSE 1.0 END::DOUBLE AS s,
        2 * pi() * CASE WHEN id >= {n} // 2 THEN (id - {n} // 2)::DOUBLE / ({n} - {n} // 2)
          ELSE id::DOUBLE / ({n} // 2) END AS t, (id >= {n} // 2)::INTEGER AS label
      FROM {_ids(n)})"""


def _moons(n: str) -> str:
    zx, zy = sql_normals("0:moons", "id")
    return f"""SELECT id, CASE WHEN label = 1 THEN 1 - cos(t) ELSE cos(t) END + {zx} * 0.05 AS x,
      CASE WHEN label = 1 THEN 0.5 - sin(t) ELSE sin(t) END + {zy} * 0.05 AS y, label FROM (
      SELECT id, (id >= {n} // 2)::INTEGER AS label,
        pi() * CASE WHEN id >= {n} // 2 THEN (id - {n} // 2)::DOUBLE / ({n} - {n} // 2 - 1)
          ELSE id::DOUBLE / ({n} // 2 - 1) END AS t FROM {_ids(n)})"""


def _blobs(n: str, seed: str = "0", spread: tuple[float, ...] = pointgen.BLOB_SPREAD) -> str:
    zx, zy = sql_normals(f"{seed}:blobs", "id")

    def pick(values: list[float]) -> str:
        return "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "][label + 1]"

    cx = pick([c[0] for c in pointgen.BLOB_CENTERS])
    cy = pick([c[1] for c in pointgen.BLOB_CENTERS])
    return f"""SELECT id, {cx} + {pick(list(spread))} * {zx} AS x,
      {cy} + {pick(list(spread))} * {zy} AS y, label
      FROM (SELECT id, (id % 3)::INTEGER AS label FROM {_ids(n)})"""


def _affine(source: str) -> str:
    return f"SELECT id, x * 0.6 + y * -0.4 AS x, x * -0.6 + y * 0.8 AS y, label FROM ({source})"


def _shells(source: str) -> str:
    return f"""SELECT id, x, y, (ntile(3) OVER (ORDER BY d2, id) - 1)::INTEGER AS label FROM (
      SELECT id, x, y, round((x - mx) * (x - mx) + (y - my) * (y - my), 9) AS d2
      FROM ({source}), (SELECT avg(x) AS mx, avg(y) AS my FROM ({source})))"""


def _gauss(n: str) -> str:
    zx, zy = sql_normals("0:gauss", "id")
    return _shells(f"SELECT id, {zx} AS x, {zy} AS y FROM {_ids(n)}")


def _shown(source: str) -> str:
    return f"SELECT id, round(x, 6) AS x, round(y, 6) AS y, label FROM ({source})"


def _round_xy(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


_EVENTS = "(SELECT count(*) FROM events)"


@fixture("points_circles", _shown(_circles(_EVENTS)))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round_xy(pointgen.points_circles(spark, row_count(spark, sf, "events")))


@fixture("points_moons", _shown(_moons(_EVENTS)))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round_xy(pointgen.points_moons(spark, row_count(spark, sf, "events")))


@fixture("points_blobs", _shown(_blobs(_EVENTS)))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round_xy(pointgen.points_blobs(spark, row_count(spark, sf, "events")))


@fixture("points_varied", _shown(_blobs(_EVENTS, spread=pointgen.VARIED_SPREAD)))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round_xy(pointgen.points_varied(spark, row_count(spark, sf, "events")))


@query(
    "affine_points",
    f"WITH {EMBEDDING_POINTS} " + _shown(_affine("SELECT * FROM pts")),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round_xy(pointgen.affine_points(embedding_points(spark, sf))).drop("w", "pair")


@query(
    "quantile_shells",
    f"WITH {EVENT_POINTS} " + _shown(_shells("SELECT * FROM pts")),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _round_xy(pointgen.quantile_shells(event_points(spark, sf))).drop("w")


def _catalog_sql() -> str:
    parts = []
    for name in ("supplier", "customer"):
        n = f"(SELECT count(*) FROM {name})"
        sets = {
            "Noisy circle": _circles(n),
            "Noisy moon": _moons(n),
            "Blobs": _blobs(n),
            "Aniso": _affine(_blobs(n, seed="0:aniso")),
            "varied": _blobs(n, spread=pointgen.VARIED_SPREAD),
            "Gaussian quantile": _gauss(n),
        }
        parts += [
            f"SELECT '{label}' AS dataset, {n}::INTEGER AS n, * FROM ({_shown(sql)})"
            for label, sql in sets.items()
        ]
    return " UNION ALL ".join(parts)


@fixture("points_catalog", _catalog_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    sizes = [row_count(spark, sf, name) for name in ("supplier", "customer")]
    return _round_xy(pointgen.points_catalog(spark, sizes))
