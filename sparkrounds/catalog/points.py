"""Point queries: coresets, seeding, k-means and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrounds.catalog.bindings import (
    EMBEDDING_POINTS,
    EVENT_CENTERS,
    EVENT_POINTS,
    LABEL_CENTERS,
    embedding_points,
    event_centers,
    event_points,
    label_centers,
    sql_hash32,
    sql_md5,
    sql_uniform,
    table,
)
from sparkrounds.catalog.registry import query
from sparkrounds.functions.sums import exact_sum_sql
from sparkrounds.operators import coreset, kmeans, nearest, seeding
from sparkrounds.plans.lineage import materialize

# Shared CTEs: distances, cost, ring parameters and ring assignment in plain SQL.
_GIVEN = f"WITH {EVENT_POINTS}, {EVENT_CENTERS}"
_DIST = """dist AS (SELECT id, x, y, w, c, cx, cy, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2,
  sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM pts, centers)"""
_COST = f"""cost AS (SELECT count(*) AS n, {exact_sum_sql('ws')} / (SELECT count(*) FROM centers) AS cost
  FROM (SELECT id, any_value(w) * sqrt(sum(d2 ORDER BY c)) AS ws FROM dist GROUP BY id))"""
_PARAMS = """params AS (SELECT n, cost,
  CASE WHEN 0.5 * ln(n) > 1 THEN ceil(ln(n) * ln(0.5 * ln(n)))::INTEGER ELSE 0 END AS levels,
  CASE WHEN 0.5 * ln(n) > 1 THEN sqrt(cost / (0.5 * ln(n) * n)) END AS r FROM cost)"""
_SET_UP = f"{_GIVEN}, {_DIST}, {_COST}, {_PARAMS}"


def _rings(schedule: str) -> str:
    """CTEs ending in ``assigned(id, x, y, w, level, c, cx, cy, hi)`` by a join on rings."""
    if schedule == "two_ring":
        rings = """SELECT * FROM (SELECT 0 AS level, 0.0::DOUBLE AS lo, r AS hi FROM params
          UNION ALL SELECT 1, r, 2 * r FROM params) WHERE level < (SELECT levels FROM params)"""
    else:
        rings = """SELECT level::INTEGER AS level, CASE WHEN level = 0 THEN 0.0::DOUBLE
          ELSE r * pow(2.0, level - 1) END AS lo, r * pow(2.0, level) AS hi
          FROM params, (SELECT unnest(generate_series(0, 99)) AS level) WHERE level < levels"""
    return f"""rings AS ({rings}),
    hits AS (SELECT id, c, cx, cy, level, hi, row_number() OVER (PARTITION BY id ORDER BY level, c) AS nr
      FROM dist JOIN rings ON d > lo AND d < hi),
    assigned AS (SELECT p.id, p.x, p.y, p.w, h.level, h.c, h.cx, h.cy, h.hi
      FROM pts p LEFT JOIN (SELECT * FROM hits WHERE nr = 1) h ON p.id = h.id)"""


_CELLS = """celled AS (SELECT *, floor((x - cx) / side + ceil(hi * 2 / side) / 2)::INTEGER AS gx,
  floor((y - cy) / side + ceil(hi * 2 / side) / 2)::INTEGER AS gy
  FROM (SELECT *, 0.25::DOUBLE * hi / sqrt(2.0::DOUBLE) AS side FROM assigned))"""
_GRID = f"""{_CELLS}, grid AS (
  SELECT id, x, y, weight AS w FROM (SELECT id, x, y, sum(w) OVER cell AS weight,
      row_number() OVER (PARTITION BY level, c, gx, gy ORDER BY {sql_md5(0, 'id')}, id) AS nr
    FROM celled WHERE level IS NOT NULL WINDOW cell AS (PARTITION BY level, c, gx, gy)) WHERE nr = 1
  UNION ALL SELECT id, x, y, w FROM assigned WHERE level IS NULL)"""


def _annulus(size: str) -> str:
    return f"""annulus AS (
  SELECT id, x, y, ring_w / least({size}, ring_n) AS w FROM (SELECT id, x, y,
      sum(w) OVER ring AS ring_w, count(*) OVER ring AS ring_n,
      row_number() OVER (PARTITION BY level, c ORDER BY {sql_md5(0, 'id')}, id) AS nr
    FROM assigned WHERE level IS NOT NULL WINDOW ring AS (PARTITION BY level, c))
  WHERE nr <= {size}
  UNION ALL SELECT id, x, y, w FROM assigned WHERE level IS NULL)"""


@query(
    "unit_weight",
    f"WITH {EMBEDDING_POINTS} SELECT id, x, y, w FROM pts",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return coreset.unit_weight(embedding_points(spark, sf).select("id", "x", "y"))


@query("label_count", "SELECT count(DISTINCT label) AS k FROM embeddings")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return coreset.label_count(embedding_points(spark, sf))


@query(
    "partition_points",
    f'SELECT event_id AS id, ({sql_hash32(0, "event_id")} % 8)::INTEGER AS "set" FROM events',
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return coreset.partition_points(event_points(spark, sf), 8).select("id", "set")


@query("center_distance", f"{_GIVEN}, {_DIST} SELECT id, c, round(d, 6) AS dist FROM dist")
def _(spark: SparkSession, sf: str) -> DataFrame:
    far = coreset.center_distance(event_points(spark, sf), event_centers(spark, sf))
    return far.withColumn("dist", F.round("dist", 6))


@query("coreset_cost", f"{_GIVEN}, {_DIST}, {_COST} SELECT n, round(cost, 4) AS cost FROM cost")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cost = coreset.coreset_cost(event_points(spark, sf), event_centers(spark, sf))
    return cost.select("n", F.round("cost", 4).alias("cost"))


@query(
    "ring_params",
    f"{_SET_UP} SELECT n, round(cost, 4) AS cost, levels, round(r, 9) AS r FROM params",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    params = coreset.ring_params(event_points(spark, sf), event_centers(spark, sf))
    return params.select("n", F.round("cost", 4).alias("cost"), "levels", F.round("r", 9).alias("r"))


def _assigned(spark: SparkSession, sf: str, schedule: str) -> DataFrame:
    points, centers = event_points(spark, sf), event_centers(spark, sf)
    params = coreset.ring_params(points, centers)
    return coreset.ring_assign(points, centers, params, schedule=schedule)


@query("ring_assign", f"{_SET_UP}, {_rings('two_ring')} SELECT id, level, c FROM assigned")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, "two_ring").select("id", "level", "c")


@query(
    "ring_assign_geometric", f"{_SET_UP}, {_rings('geometric')} SELECT id, level, c FROM assigned"
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, "geometric").select("id", "level", "c")


@query(
    "grid_cell",
    f"{_SET_UP}, {_rings('geometric')}, {_CELLS} SELECT id, level, c, gx, gy FROM celled",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return coreset.grid_cell(_assigned(spark, sf, "geometric")).select("id", "level", "c", "gx", "gy")


@query(
    "grid_coreset",
    f"{_SET_UP}, {_rings('geometric')}, {_GRID} SELECT id, x, y, w FROM grid",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    stored = materialize(_assigned(spark, sf, "geometric"), "assigned")
    return coreset.grid_coreset(stored).drop("set")


@query(
    "annulus_coreset",
    f"{_SET_UP}, {_rings('geometric')}, {_annulus('100')} SELECT id, x, y, round(w, 6) AS w FROM annulus",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    stored = materialize(_assigned(spark, sf, "geometric"), "assigned")
    kept = coreset.annulus_coreset(stored, 100)
    return kept.drop("set").withColumn("w", F.round("w", 6))


@query(
    "coreset_once",
    f"{_SET_UP}, {_rings('two_ring')}, {_GRID} SELECT id, x, y, w FROM grid",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return coreset.coreset_once(
        event_points(spark, sf), event_centers(spark, sf), sampling="grid", schedule="two_ring"
    ).drop("set")


@query(
    "coreset_once_annulus",
    f"""{_SET_UP}, {_rings('two_ring')}, {_annulus('50')}
    SELECT id, x, y, round(w, 6) AS w FROM annulus""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kept = coreset.coreset_once(
        event_points(spark, sf), event_centers(spark, sf),
        sampling="annulus", sample_size=50, schedule="two_ring",
    )
    return kept.drop("set").withColumn("w", F.round("w", 6))


def _seed_ctes(points: str, name: str, k: int, seed: str) -> str:
    """k-means++ passes unrolled: seed ``i`` of every set from the seeds before it."""
    parts = [
        f"""{name}_0 AS MATERIALIZED (SELECT "set", 0 AS c, id, x, y FROM (SELECT *, row_number() OVER
          (PARTITION BY "set" ORDER BY {sql_md5(f'{seed}:0', 'id')}, id) AS nr FROM {points}) WHERE nr = 1)""",
    ]
    for i in range(1, k):
        seen = " UNION ALL ".join(f"SELECT * FROM {name}_{j}" for j in range(i))
        parts.append(
            f"""{name}_{i} AS MATERIALIZED (SELECT "set", {i} AS c, id, x, y FROM (SELECT *,
              row_number() OVER (PARTITION BY "set"
                ORDER BY -ln({sql_uniform(f'{seed}:{i}', 'id')}) / d2, id) AS nr FROM
              (SELECT d."set", d.id, any_value(d.x) AS x, any_value(d.y) AS y,
                 min((d.x - s.x) * (d.x - s.x) + (d.y - s.y) * (d.y - s.y)) AS d2
               FROM {points} d JOIN ({seen}) s ON d."set" = s."set" GROUP BY d."set", d.id) WHERE d2 > 0)
              WHERE nr = 1)"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM {name}_{j}" for j in range(k))
    parts.append(f'{name} AS (SELECT "set", c, x AS cx, y AS cy, id AS seed_id FROM ({every}))')
    return ",\n".join(parts)


def _dealt(sets: int) -> str:
    return f'dealt AS MATERIALIZED (SELECT *, ({sql_hash32(0, "id")} % {sets})::INTEGER AS "set" FROM pts)'


def _kept_sql(t: str, number: int, sample_size: int | None) -> str:
    """One round's reduced points: a point per cell, or ``sample_size`` points per ring."""
    order = f"ORDER BY {sql_md5(f'0:{number}', 'id')}, id"
    if sample_size is None:
        cell = 'PARTITION BY "set", level, c, gx, gy, alone'
        return f"""SELECT id, x, y, weight AS w, "set" FROM (SELECT id, x, y, "set",
          sum(w) OVER ({cell}) AS weight, row_number() OVER ({cell} {order}) AS nr
          FROM {t}_celled) WHERE nr = 1"""
    ring = 'PARTITION BY "set", level, c'
    return f"""SELECT id, x, y, ring_w / least({sample_size}, ring_n) AS w, "set" FROM (
        SELECT id, x, y, "set", sum(w) OVER ({ring}) AS ring_w, count(*) OVER ({ring}) AS ring_n,
          row_number() OVER ({ring} {order}) AS nr FROM {t}_celled WHERE level IS NOT NULL)
      WHERE nr <= {sample_size}
      UNION ALL SELECT id, x, y, w, "set" FROM {t}_celled WHERE level IS NULL"""


def _merge_sql(k: int, sets: int, sample_size: int | None = None) -> str:
    """Merge-and-reduce with geometric rings, every round unrolled."""
    parts = [EVENT_POINTS, _dealt(sets)]
    points, number = "dealt", 0
    while True:
        number += 1
        t = f"t{number}"
        parts.append(_seed_ctes(points, f"{t}_seeds", k, f"0:{number}"))
        merged = max(sets // 2, 1)
        parts.append(
            f"""{t}_dist AS MATERIALIZED (SELECT p."set", id, x, y, w, c, cx, cy, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2,
              sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d
              FROM {points} p JOIN {t}_seeds s ON p."set" = s."set"),
            {t}_cost AS (SELECT "set", count(*) AS n, {exact_sum_sql('ws')} / any_value(k) AS cost FROM
              (SELECT "set", id, any_value(w) * sqrt(sum(d2 ORDER BY c)) AS ws, count(*) AS k
               FROM {t}_dist GROUP BY "set", id) GROUP BY "set"),
            {t}_params AS MATERIALIZED (SELECT "set",
              CASE WHEN 0.5 * ln(n) > 1 THEN ceil(ln(n) * ln(0.5 * ln(n)))::INTEGER ELSE 0 END AS levels,
              CASE WHEN 0.5 * ln(n) > 1 THEN sqrt(cost / (0.5 * ln(n) * n)) END AS r
              FROM {t}_cost),
            {t}_rings AS MATERIALIZED (SELECT "set", level::INTEGER AS level,
              CASE WHEN level = 0 THEN 0.0::DOUBLE ELSE r * pow(2.0, level - 1) END AS lo,
              r * pow(2.0, level) AS hi
              FROM {t}_params, (SELECT unnest(generate_series(0, 99)) AS level) WHERE level < levels),
            {t}_hits AS (SELECT id, c, cx, cy, level, hi,
              row_number() OVER (PARTITION BY id ORDER BY level, c) AS nr
              FROM {t}_dist d JOIN {t}_rings g ON d."set" = g."set" AND d > lo AND d < hi),
            {t}_celled AS MATERIALIZED (SELECT p.id, p.x, p.y, p.w, p."set", level, c,
              floor((x - cx) / side + ceil(hi * 2 / side) / 2)::INTEGER AS gx,
              floor((y - cy) / side + ceil(hi * 2 / side) / 2)::INTEGER AS gy,
              CASE WHEN level IS NULL THEN p.id END AS alone
              FROM {points} p LEFT JOIN (SELECT *, 0.25::DOUBLE * hi / sqrt(2.0::DOUBLE) AS side
                FROM {t}_hits WHERE nr = 1) h ON p.id = h.id),
            {t}_out AS MATERIALIZED (SELECT id, x, y, w, least("set" // 2, {merged - 1})::INTEGER AS "set"
              FROM ({_kept_sql(t, number, sample_size)}))"""
        )
        points = f"{t}_out"
        if sets == 1:
            break
        sets = merged
    return "WITH " + ",\n".join(parts) + f" SELECT id, x, y, round(w, 6) AS w FROM {points}"


@query(
    "kmeanspp_seed",
    f"""WITH {EVENT_POINTS}, {_dealt(8)}, {_seed_ctes('dealt', 'seeds', 4, '0')}
    SELECT "set", c, cx, cy, seed_id AS id FROM seeds""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = materialize(coreset.partition_points(event_points(spark, sf), 8), "points")
    return seeding.kmeanspp_seed(points, 4, seed=0)


@query("coreset_merge_reduce", _merge_sql(5, 8))
def _(spark: SparkSession, sf: str) -> DataFrame:
    reduced = coreset.coreset_merge_reduce(event_points(spark, sf), 5, sets=8)
    return reduced.withColumn("w", F.round("w", 6))


@query("coreset_merge_reduce_annulus", _merge_sql(5, 8, 100))
def _(spark: SparkSession, sf: str) -> DataFrame:
    reduced = coreset.coreset_merge_reduce(
        event_points(spark, sf), 5, sets=8, sampling="annulus", sample_size=100
    )
    return reduced.withColumn("w", F.round("w", 6))


@query("coreset_merge_weight", "SELECT count(*)::DOUBLE AS total_weight FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    reduced = coreset.coreset_merge_reduce(
        event_points(spark, sf), 5, sets=8, schedule="two_ring"
    )
    return reduced.agg(F.round(F.sum("w"), 3).alias("total_weight"))


def _parallel_sql(k: int, passes: int, size: int, seed: str = "0") -> str:
    """Oversampled seeds of every set of ``dealt``: passes, weights and the weighted race unrolled."""
    parts = [
        f"""new0 AS MATERIALIZED (SELECT "set", id, x, y, 0 AS pass, 0 AS nr FROM (SELECT *, row_number() OVER
          (PARTITION BY "set" ORDER BY {sql_md5(f'{seed}:0', 'id')}, id) AS nr FROM dealt) WHERE nr = 1)"""
    ]
    for i in range(1, passes + 1):
        seen = " UNION ALL ".join(f"SELECT * FROM new{j}" for j in range(i))
        parts.append(
            f"""new{i} AS MATERIALIZED (SELECT "set", id, x, y, {i} AS pass, nr::INTEGER AS nr FROM (SELECT *,
              row_number() OVER (PARTITION BY "set" ORDER BY -ln({sql_uniform(f'{seed}:{i}', 'id')}) / d2, id) AS nr
              FROM (SELECT d."set", d.id, any_value(d.x) AS x, any_value(d.y) AS y,
                min((d.x - s.x) * (d.x - s.x) + (d.y - s.y) * (d.y - s.y)) AS d2
                FROM dealt d JOIN ({seen}) s ON d."set" = s."set" GROUP BY d."set", d.id) WHERE d2 > 0) WHERE nr <= {size})"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM new{j}" for j in range(passes + 1))
    parts.append(
        f"""cand AS MATERIALIZED ({every}),
        weighed AS MATERIALIZED (SELECT c."set", c.id, c.x, c.y, n.w FROM cand c JOIN (
          SELECT "set", near, count(*) AS w FROM (SELECT d."set", arg_min(s.id, ((d.x - s.x) * (d.x - s.x)
              + (d.y - s.y) * (d.y - s.y), pass, nr)) AS near
            FROM dealt d JOIN cand s ON d."set" = s."set" GROUP BY d."set", d.id) GROUP BY "set", near) n
          ON c."set" = n."set" AND c.id = n.near)"""
    )
    for i in range(k):
        seen = " UNION ALL ".join(f"SELECT * FROM seed{j}" for j in range(i))
        far = (
            f"""(SELECT d."set", d.id, any_value(d.x) AS x, any_value(d.y) AS y, any_value(w) * min((d.x - s.x) * (d.x - s.x)
              + (d.y - s.y) * (d.y - s.y)) AS r FROM weighed d JOIN ({seen}) s ON d."set" = s."set" GROUP BY d."set", d.id)"""
            if i else """(SELECT "set", id, x, y, w::DOUBLE AS r FROM weighed)"""
        )
        parts.append(
            f"""seed{i} AS MATERIALIZED (SELECT "set", {i} AS c, id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY "set"
              ORDER BY -ln({sql_uniform(f'{seed}:again:{i}', 'id')}) / r, id) AS nr FROM {far} WHERE r > 0) WHERE nr = 1)"""
        )
    last = " UNION ALL ".join(f"SELECT * FROM seed{j}" for j in range(k))
    return ",\n".join(parts) + f' SELECT "set", c, x AS cx, y AS cy, id FROM ({last})'


@query("parallel_seed", f"WITH {EVENT_POINTS}, {_dealt(8)}, {_parallel_sql(4, 3, 8)}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return seeding.parallel_seed(coreset.partition_points(event_points(spark, sf), 8), 4, passes=3)


@query(
    "kmeans_fit",
    # The seeds, then Lloyd steps over (c, cx, cy) until the centers rest or 50 steps are done.
    f"""WITH RECURSIVE {EVENT_POINTS}, one AS MATERIALIZED (SELECT *, 0 AS "set" FROM pts),
    {_seed_ctes('one', 'seeds', 5, '100')},
    steps AS (
      SELECT 0 AS step, 1e9::DOUBLE AS far, list((c, cx, cy) ORDER BY c) AS places FROM seeds
      UNION ALL
      SELECT step + 1, max(sqrt((cx - ox) * (cx - ox) + (cy - oy) * (cy - oy))), list((c, cx, cy) ORDER BY c) FROM (
        SELECT step, c, ox, oy, CASE WHEN sw > 0 THEN sx / sw ELSE ox END AS cx, CASE WHEN sw > 0 THEN sy / sw ELSE oy END AS cy
        FROM (
          SELECT step, c, any_value(ox) AS ox, any_value(oy) AS oy, {exact_sum_sql('xw')} AS sx, {exact_sum_sql('yw')} AS sy,
            {exact_sum_sql('nw')} AS sw
          FROM (
            SELECT step, c, ox, oy, CASE WHEN nr = 1 THEN x * w ELSE 0 END AS xw, CASE WHEN nr = 1 THEN y * w ELSE 0 END AS yw,
              CASE WHEN nr = 1 THEN w ELSE 0 END AS nw
            FROM (
              SELECT *, row_number() OVER (PARTITION BY id ORDER BY (x - ox) * (x - ox) + (y - oy) * (y - oy), c) AS nr
              FROM (SELECT step, p[1] AS c, p[2] AS ox, p[3] AS oy FROM (SELECT step, unnest(places) AS p FROM steps
                WHERE step < 50 AND far > 1e-4)) CROSS JOIN pts
            )
          ) GROUP BY step, c
        )
      ) GROUP BY step
    )
    SELECT (row_number() OVER (ORDER BY p[2], p[3]) - 1)::INTEGER AS c, round(p[2], 6) AS cx, round(p[3], 6) AS cy
    FROM (SELECT unnest(places) AS p FROM (SELECT places FROM steps ORDER BY step DESC LIMIT 1))""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    fit = kmeans.kmeans_fit(event_points(spark, sf), 5, seed=100)
    return fit.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query(
    "nearest_center",
    f"""{_GIVEN}, {_DIST} SELECT id, c, round(d, 6) AS d FROM (SELECT *, row_number() OVER
    (PARTITION BY id ORDER BY d, c) AS nr FROM dist) WHERE nr = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    near = kmeans.nearest_center(event_points(spark, sf), event_centers(spark, sf))
    return near.select("id", "c", F.round(F.sqrt("d2"), 6).alias("d"))


@query(
    "nearest_of_many",
    # Every tenth event is a center; many share a place.
    f"""WITH {EVENT_POINTS}, far AS (SELECT p.id, q.id AS c, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2
      FROM pts p, pts q WHERE q.id % 10 = 3)
    SELECT id, arg_min(c, (d2, c)) AS c, round(sqrt(min(d2)), 6) AS d FROM far GROUP BY id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = event_points(spark, sf)
    centers = points.filter("id % 10 = 3").select(F.col("id").alias("c"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = nearest.nearest_of_many(points, centers)
    return near.select("id", "c", F.round(F.sqrt("d2"), 6).alias("d"))


@query(
    "lloyd_step",
    f"""{_GIVEN}, {_DIST} SELECT c, round(sum(x * w) / sum(w), 6) AS cx,
    round(sum(y * w) / sum(w), 6) AS cy, sum(w) AS w FROM (SELECT *, row_number() OVER
    (PARTITION BY id ORDER BY d, c) AS nr FROM dist) WHERE nr = 1 GROUP BY c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    step = kmeans.lloyd_step(event_points(spark, sf), event_centers(spark, sf))
    return step.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


_LABELS = f"WITH {EMBEDDING_POINTS}, {LABEL_CENTERS}"
# Centers of the even and of the odd coordinate pairs.
_BOTH = f"""WITH {EMBEDDING_POINTS}, centers AS (
  SELECT label AS c, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM pts WHERE pair % 2 = 0 GROUP BY 1),
others AS (
  SELECT label AS c, round(avg(x), 6) AS ox, round(avg(y), 6) AS oy FROM pts WHERE pair % 2 = 1 GROUP BY 1)"""


def _both_centers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    points = embedding_points(spark, sf)
    return label_centers(points.filter("pair % 2 = 0")), label_centers(points.filter("pair % 2 = 1"))


@query(
    "kmeans_sse",
    f"""{_LABELS} SELECT round(sum(w * ((x - cx) * (x - cx) + (y - cy) * (y - cy))), 6) AS sse
    FROM pts JOIN centers ON label = c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    points = embedding_points(spark, sf)
    return kmeans.kmeans_sse(points, label_centers(points)).select(F.round("sse", 6).alias("sse"))


@query(
    "centroid_pairwise_avg",
    f"""{_BOTH} SELECT round(sum(sqrt((cx - ox) * (cx - ox) + (cy - oy) * (cy - oy)))
    / (SELECT count(*) FROM centers), 6) AS avg_quality FROM centers, others""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    quality = kmeans.centroid_pairwise_avg(*_both_centers(spark, sf))
    return quality.select(F.round("avg_quality", 6).alias("avg_quality"))


@query(
    "centroid_norm",
    f"""{_BOTH} SELECT round(sqrt(sum((cx - ox) * (cx - ox) + (cy - oy) * (cy - oy))), 6)
    AS norm_quality FROM centers JOIN others ON centers.c = others.c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    quality = kmeans.centroid_norm(*_both_centers(spark, sf))
    return quality.select(F.round("norm_quality", 6).alias("norm_quality"))


@query(
    "sample_sizes",
    """SELECT fraction, round(n * fraction, 6) AS exact_size, ceil(n * fraction)::BIGINT AS used_size
    FROM (SELECT count(*) AS n FROM events), (SELECT unnest([0.001::DOUBLE, 0.01, 0.1]) AS fraction)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").agg(F.count(F.lit(1)).alias("n"))
    sizes = n.select(F.inline(coreset.sample_sizes(F.col("n"))))
    return sizes.withColumn("exact_size", F.round("exact_size", 6))
