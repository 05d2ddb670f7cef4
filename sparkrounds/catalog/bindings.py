"""Edges, points and centers taken from the test tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrounds.operators.graph import canonical_edges
from sparkrounds.schemas import CENTERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation to supplier nation, one raw edge per line item."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        item.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("c_nationkey").cast("long").alias("src"),
            F.col("s_nationkey").cast("long").alias("dst"),
            F.col("l_extendedprice").alias("w"),
        )
    )


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_edges(nation_pairs(spark, sf_dir))


def nation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.col("n_nationkey").cast("long").alias("id"))


NATION_EDGES = """raw AS (
  SELECT least(c_nationkey, s_nationkey)::BIGINT AS src,
         greatest(c_nationkey, s_nationkey)::BIGINT AS dst, min(l_extendedprice) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""


def part_supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part (even ids) to supplier (odd ids), one raw edge per line item."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") * 2).alias("src"),
        (F.col("l_suppkey") * 2 + 1).alias("dst"),
        F.col("l_extendedprice").alias("w"),
    )


def part_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_edges(part_supplier_pairs(spark, sf_dir))


PART_SUPPLIER_EDGES = """raw AS (
  SELECT least(2 * l_partkey, 2 * l_suppkey + 1) AS src,
         greatest(2 * l_partkey, 2 * l_suppkey + 1) AS dst, min(l_extendedprice) AS w
  FROM lineitem GROUP BY 1, 2)"""


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.hour("ts").cast("double").alias("x"),
        F.col("value").alias("y"),
        F.lit(1.0).alias("w"),
    )


EVENT_POINTS = """pts AS (
  SELECT event_id AS id, hour(ts)::DOUBLE AS x, value AS y, 1.0::DOUBLE AS w FROM events)"""


def event_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five centers: mean place of the events in five value bands."""
    band = F.least(F.floor(F.col("y") / 50), F.lit(4)).cast("int")
    return (
        event_points(spark, sf_dir)
        .groupBy(band.alias("c"))
        .agg(F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy"))
    )


EVENT_CENTERS = """centers AS (
  SELECT least(floor(y / 50), 4)::INTEGER AS c,
         round(avg(x), 3) AS cx, round(avg(y), 3) AS cy FROM pts GROUP BY 1)"""


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of every vector: a point for each pair of neighbouring coordinates."""
    pairs = F.expr(
        "transform(sequence(0, size(embedding) div 2 - 1), i -> named_struct('pair', i, "
        "'x', double(embedding[2 * i]), 'y', double(embedding[2 * i + 1])))"
    )
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.inline(pairs))
    return rows.select(
        (F.col("vec_id") * 4096 + F.col("pair")).alias("id"), "x", "y", F.lit(1.0).alias("w"),
        F.col("label").cast("int").alias("label"), "pair",
    )


EMBEDDING_POINTS = """pts AS (
  SELECT vec_id * 4096 + pair AS id, embedding[2 * pair + 1]::DOUBLE AS x, embedding[2 * pair + 2]::DOUBLE AS y,
         1.0::DOUBLE AS w, label, pair FROM embeddings, unnest(range(0, len(embedding) // 2)) AS u(pair))"""


def label_centers(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Mean place per label, numbered by label."""
    return points.groupBy(F.col("label").alias("c")).agg(
        F.round(F.avg(x), 6).alias("cx"), F.round(F.avg(y), 6).alias("cy")
    ).select(*CENTERS.names)


LABEL_CENTERS = """centers AS (
  SELECT label AS c, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM pts GROUP BY 1)"""


# SQL twins of the hashing helpers ------------------------------------------------


def sql_md5(seed: object, *keys: str) -> str:
    return "md5('" + str(seed) + "'" + "".join(f" || ':' || ({key})" for key in keys) + ")"


def sql_hash32(seed: object, *keys: str) -> str:
    return f"('0x' || substr({sql_md5(seed, *keys)}, 1, 8))::BIGINT"


def sql_uniform(seed: object, *keys: str) -> str:
    return f"(({sql_hash32(seed, *keys)} + 0.5) / 4294967296.0::DOUBLE)"


def sql_normals(seed: object, *keys: str) -> tuple[str, str]:
    radius = f"sqrt(-2.0 * ln({sql_uniform(f'{seed}:r', *keys)}))"
    angle = f"(2.0 * pi() * {sql_uniform(f'{seed}:t', *keys)})"
    return f"({radius} * cos({angle}))", f"({radius} * sin({angle}))"


# SQL for minimum spanning forests -------------------------------------------------


def sql_minimax(steps: int = 5) -> str:
    """CTEs ``e`` (ranked edges) and ``closed`` (minimax rank of every vertex pair).

    Repeated squaring: an edge is in the tree iff its rank equals its ends' minimax.
    Enough for ``2**steps`` vertices.
    """
    parts = [
        "e AS (SELECT *, row_number() OVER (ORDER BY w, src, dst) AS r FROM raw)",
        """d0 AS (SELECT src AS u, dst AS v, r FROM e UNION ALL SELECT dst, src, r FROM e
          UNION ALL SELECT DISTINCT src, src, 0 FROM e UNION ALL SELECT DISTINCT dst, dst, 0 FROM e)""",
    ]
    for i in range(steps):
        parts.append(
            f"""d{i + 1} AS MATERIALIZED (SELECT a.u, b.v, min(greatest(a.r, b.r)) AS r
              FROM d{i} a JOIN d{i} b ON a.v = b.u GROUP BY 1, 2)"""
        )
    parts.append(f"closed AS (SELECT * FROM d{steps})")
    parts.append(
        "tree AS (SELECT src, dst, w, e.r FROM e JOIN closed c ON src = u AND dst = v AND e.r = c.r)"
    )
    return ",\n".join(parts)


def sql_forest(
    source: str, out: str, *, rounds: int = 8, jumps: int = 6, stepwise: bool = False
) -> str:
    """CTEs that end in ``out(g, src, dst, w)``: the forest of each group of ``source``.

    ``source(g, src, dst, w)``; end points are keyed by group.  Contraction rounds
    are unrolled; ``rounds`` and ``jumps`` must be enough for the data at hand.
    ``stepwise`` renames one end of the edges after the other, for many groups.
    """
    p = out
    parts = [
        f"""{p}_e AS MATERIALIZED (SELECT g, src, dst, w, g * 1000000000 + src AS a,
          g * 1000000000 + dst AS b, row_number() OVER (ORDER BY w, src, dst, g) AS r
          FROM {source})""",
        f"{p}_w0 AS (SELECT a, b, r FROM {p}_e)",
    ]
    for i in range(1, rounds + 1):
        before = f"{p}_w{i - 1}"
        parts.append(
            f"""{p}_b{i} AS MATERIALIZED (SELECT k, min(r) AS r, arg_min(o, r) AS o FROM
              (SELECT a AS k, b AS o, r FROM {before} UNION ALL SELECT b, a, r FROM {before})
              GROUP BY k)"""
        )
        parts.append(
            f"""{p}_p{i}_0 AS MATERIALIZED (SELECT x.k, CASE WHEN y.o = x.k AND x.k < x.o THEN x.k
              ELSE x.o END AS p FROM {p}_b{i} x JOIN {p}_b{i} y ON x.o = y.k)"""
        )
        for j in range(1, jumps + 1):
            parts.append(
                f"""{p}_p{i}_{j} AS MATERIALIZED (SELECT x.k, y.p FROM {p}_p{i}_{j - 1} x
                  JOIN {p}_p{i}_{j - 1} y ON x.p = y.k)"""
            )
        last = f"{p}_p{i}_{jumps}"
        if stepwise:
            parts.append(
                f"""{p}_u{i} AS MATERIALIZED (SELECT x.p AS a, w.b, r FROM {before} w JOIN {last} x ON w.a = x.k),
                {p}_w{i} AS MATERIALIZED (SELECT u.a, y.p AS b, r FROM {p}_u{i} u JOIN {last} y ON u.b = y.k
                  WHERE u.a <> y.p)"""
            )
            continue
        parts.append(
            f"""{p}_w{i} AS MATERIALIZED (SELECT x.p AS a, y.p AS b, r FROM {before} w
              JOIN {last} x ON w.a = x.k JOIN {last} y ON w.b = y.k WHERE x.p <> y.p)"""
        )
    ranks = " UNION ".join(f"SELECT r FROM {p}_b{i}" for i in range(1, rounds + 1))
    parts.append(
        f"{out} AS MATERIALIZED (SELECT g, src, dst, w FROM {p}_e WHERE r IN ({ranks}))"
    )
    return ",\n".join(parts)
