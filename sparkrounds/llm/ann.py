"""Approximate nearest neighbours over learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts by recursive
bisection.  A small network learns to tell from a vector in which parts its
neighbours lie.  Every row is indexed in its most probable part; a query visits
the most probable parts, and what they hold is ranked by exact distances.

How many parts a query visits is measured: bounded sets of sample vectors are
searched by brute force over all rows, and the fewest parts that reach the
target recall are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrounds.plans.lineage import materialize

SAMPLE_ROWS = 4096
ROWS_PER_PART = 2_000
MOST_PARTS = 128
GRAPH_NEIGHBOURS = 10
PROBE_QUERIES = 64
TARGET_RECALL = 0.95
# Rows and queries that one block compares at most, on average.
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 1_024


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer; its outputs are the parts' log odds."""

    parts: int
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def order(self, x: np.ndarray, most: int | None = None) -> np.ndarray:
        """Parts from the most to the least probable, for each row."""
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        return np.argsort(-z, axis=1, kind="stable")[:, :most]


def nearest(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its k nearest rows: positions and exact distances, ties to smaller ids."""
    norms = (rows * rows).sum(axis=1)
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64]
        rough = norms - 2 * (q @ rows.T) + (q * q).sum(axis=1)[:, None]
        slack = 1e-9 * (1 + norms.max(initial=0) + (q * q).sum(axis=1).max(initial=0))
        for i in range(len(q)):
            own = ids == q_ids[at + i]
            d = np.where(own, np.inf, rough[i])
            n = len(d) - int(own.sum())
            if n <= 0:
                continue
            edge = np.partition(d, min(k, n) - 1)[min(k, n) - 1] + slack
            near = np.flatnonzero(d <= edge)
            gap = rows[near] - q[i]
            exact = np.sqrt((gap * gap).sum(axis=1))
            best = np.lexsort((ids[near], exact))[:k]
            yield at + i, near[best], exact[best]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest other rows."""
    norms = (x * x).sum(axis=1)
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 256):
        d = norms - 2 * x[at : at + 256] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 256] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part number for each vertex; sizes differ by rounding only, few edges are cut."""
    n = len(graph)
    label = np.zeros(n, dtype=np.int64)
    todo = [(np.arange(n), parts, 0)]
    rng = np.random.default_rng(seed)
    while todo:
        members, p, first = todo.pop()
        if p == 1:
            label[members] = first
            continue
        left = p // 2
        side = _bisect(graph, members, round(len(members) * left / p), rng)
        todo += [(members[side], left, first), (members[~side], p - left, first + left)]
    return label


def _bisect(graph: np.ndarray, members: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Which members form a side of exactly ``size``: smoothing over the graph, then swaps."""
    inside = np.full(len(graph), -1)
    inside[members] = np.arange(len(members))
    row = np.repeat(np.arange(len(members)), graph.shape[1])
    col = inside[graph[members]].ravel()
    row, col = row[col >= 0], col[col >= 0]
    n = len(members)

    def around(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=v[col], minlength=n) + np.bincount(col, weights=v[row], minlength=n)

    degree = np.maximum(around(np.ones(n)), 1)
    x = rng.standard_normal(n)
    for _ in range(60):
        x = x + around(x) / degree
        x -= x.mean()
        x /= max(np.abs(x).max(), 1e-12)
    side = np.zeros(n, dtype=bool)
    side[np.argsort(x, kind="stable")[:size]] = True
    for _ in range(30):
        # How many more edges a vertex has to the other side than to its own.
        gain = around(side.astype(float)) - around((~side).astype(float))
        gain = np.where(side, -gain, gain)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b), max(1, n // 50))
        good = int((gain[a[:m]] + gain[b[:m]] > 2).sum())
        if not good:
            break
        side[a[:good]], side[b[:good]] = False, True
    return side


def train_router(x: np.ndarray, parts: int, seed: int = 7, *, hidden: int = 96, epochs: int = 60) -> Router:
    """Learn the parts of each vector's neighbourhood: half its own, half its neighbours'."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    k = min(GRAPH_NEIGHBOURS, len(x) - 1)
    if parts == 1 or k < 1:
        return Router(1, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, k)
    label = balanced_parts(graph, parts, seed)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), k), label[graph].ravel()), 0.5 / k)
    goal[np.arange(len(x)), label] += 0.5
    scale = 1 / max(np.sqrt((x * x).mean()), 1e-12)
    p = [
        rng.standard_normal((d, hidden)) * np.sqrt(2 / d) * scale, np.zeros(hidden),
        rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts),
    ]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    rates = [0.003 * scale, 0.003, 0.003, 0.003]
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(x[at] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (e / e.sum(axis=1, keepdims=True) - goal[at]) / len(at)
            dh = (dz @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[at].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rates[i] * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9)
    return Router(parts, *p)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _assign(router: Router) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.order(_matrix(batch.column("vec")), 1)[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(part.astype(np.int32))], ["id", "vec", "part"]
            )

    return run


def _probes(router: Router, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = router.order(_matrix(batch.column("vec")), most).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(list(order), pa.list_(pa.int32()))],
                ["id", "vec", "probes"],
            )

    return run


def _brute(queries: np.ndarray, ids: np.ndarray, k: int) -> Callable:
    """Task function: the k nearest of this task's rows for each of a few fixed queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own = _matrix(batch.column("vec")), batch.column("id").to_numpy()
            part, out = batch.column("part").to_numpy(), []
            for q, near, far in nearest(queries, ids, rows, own, k) if len(rows) else ():
                out += [(q, int(own[j]), float(x), int(part[j])) for j, x in zip(near, far)]
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["query", "id", "score", "part"]
            )

    return run


def _block(k: int) -> Callable:
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(queries) or not len(rows):
            return pd.DataFrame({n: np.zeros(0, dtype=t) for n, t in zip(names, ("i8", "i8", "f8"))})
        ids, q_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
        x = np.stack(rows["vec"].to_list()).astype(np.float64)
        q = np.stack(queries["vec"].to_list()).astype(np.float64)
        found = [(np.full(len(j), q_ids[i]), ids[j], d) for i, j, d in nearest(q, q_ids, x, ids, k)]
        if not found:
            return run(queries[:0], rows)
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found)))))

    return run


def usable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """id and vec of the rows that take part: finite, not zero, of the commonest length."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("vec"))
    rows = rows.filter(
        "id IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) "
        "AND abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)"
    )
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (common.d if common else 0))


def search(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vec: str = "embedding",
    queries: str = "id % 100 = 0",
    k: int = 10,
    recall: float = TARGET_RECALL,
    sample_rows: int = SAMPLE_ROWS,
    rows_per_part: int = ROWS_PER_PART,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of every query row.

    ``queries`` is a condition on the key, there named ``id``.  The score is the
    Euclidean distance in double precision.  Rows with the query's own key are
    no candidates.  Null, empty and zero vectors, and those with null or
    non-finite components or another length than most have, take no part.
    Repeated keys count as rows of their own.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vec)
    n = rows.count()
    place = F.xxhash64(F.lit(seed), "id")
    # The last of the sample only measure recall: the network has not seen them.
    sample = rows.orderBy(place, "id").limit(sample_rows + PROBE_QUERIES).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array([r.vec for r in sample], dtype=np.float64)
    asked_ids, asked_x = [r.id for r in sample[-PROBE_QUERIES:]], x[-PROBE_QUERIES:]
    x = x[: max(1, len(x) - PROBE_QUERIES)]
    parts = max(1, min(MOST_PARTS, len(x) // 32, n // rows_per_part))
    router = train_router(x, parts, seed)
    kind = rows.schema["vec"].dataType.simpleString()
    index = materialize(
        rows.mapInArrow(_assign(router), f"id long, vec {kind}, part int"), "ann-index"
    )
    most = _parts_to_visit(index, router, asked_x, asked_ids, k, recall)
    asked = index.filter(queries).select("id", "vec").mapInArrow(
        _probes(router, most), f"id long, vec {kind}, probes array<int>"
    ).select("id", "vec", F.explode("probes").alias("part"))
    # Blocks: a part's rows and queries are split by as many salts as their counts ask for.
    salts = index.groupBy("part").agg(F.expr(f"ceil(count(*) / {BLOCK_ROWS})").alias("xs"))
    turns = asked.groupBy("part").agg(F.expr(f"ceil(count(*) / {BLOCK_QUERIES})").alias("qs"))
    blocks = salts.join(turns, "part").hint("broadcast")
    dealt_rows = index.join(blocks, "part").select(
        "id", "vec", "part",
        F.expr("pmod(xxhash64(id), xs)").alias("x"),
        F.expr("explode(sequence(0L, qs - 1))").alias("q"),
    )
    dealt_queries = asked.join(blocks, "part").select(
        "id", "vec", "part",
        F.expr("explode(sequence(0L, xs - 1))").alias("x"),
        F.expr("pmod(xxhash64(id), qs)").alias("q"),
    )
    by = ["part", "x", "q"]
    found = dealt_queries.groupBy(*by).cogroup(dealt_rows.groupBy(*by)).applyInPandas(
        _block(k), "query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(f"rank <= {k}")


def _parts_to_visit(index: DataFrame, router: Router, x: np.ndarray, ids: list[int], k: int, recall: float) -> int:
    """The fewest parts in which the fixed queries find ``recall`` of their true neighbours."""
    if router.parts == 1:
        return 1
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    truth = (
        index.mapInArrow(_brute(x, np.array(ids), k), "query long, id long, score double, part long")
        .withColumn("rank", rank)
        .filter(f"rank <= {k}")
        .collect()
    )
    order = router.order(x)
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.broadcast_to(np.arange(router.parts), order.shape), axis=1)
    needed = np.sort([turn[r["query"], r.part] for r in truth])
    if not len(needed):
        return router.parts
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1
