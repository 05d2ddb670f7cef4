"""Packing documents into fixed windows by non-negative least squares.

Every document is cut into full windows and one remainder.  The histogram of
remainder lengths (at most ``window - 1`` bins, whatever the corpus) goes to the
driver.  There, shallow combinations of lengths that fill a window exactly are
enumerated, non-negative least squares solves how often each is used, the counts
are rounded down, and what room they leave is used greedily.  The remainders
that no combination takes are laid end to end, longest first, and cut where a
window ends, so only the very last sequence is padded.

Documents find their place by their rank among equal lengths: a number per
(task, length) plus the count of the tasks before, so no group is gathered.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrounds.llm.common import small_batches
from sparkrounds.llm.tokens import word_ids
from sparkrounds.plans.lineage import discard, materialize

WINDOW = 2048
END = 1
MOST_COMBINATIONS = 20_000
DESCENT_STEPS = 400

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


@dataclass
class Plan:
    """Where the remainder of length ``r`` and rank ``k`` goes."""

    window: int
    # Ranks of bin r that combinations take: runs first[r]..first[r+1] of these.
    first: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    # Where the left-over of bin r begins in the stream, which starts at this sequence.
    base: np.ndarray
    stream: int
    full: int


def combinations(present: np.ndarray, window: int, most: int = MOST_COMBINATIONS) -> np.ndarray:
    """Rows of up to three lengths out of ``present`` that sum to ``window`` (0: unused)."""
    there = np.zeros(window + 1, dtype=bool)
    there[present] = True
    a = present[(2 * present <= window)]
    a = a[there[window - a]]
    pairs = np.stack([a, window - a, np.zeros_like(a)], axis=1)
    # Triples over every second, third, ... pair of lengths, as the bound allows.
    step = max(1, int(np.ceil(len(present) ** 2 / 6 / most)))
    low = present[3 * present <= window]
    triples = [np.zeros((0, 3), dtype=pairs.dtype)]
    for i, x in enumerate(low):
        y = present[(present >= x) & (2 * present <= window - x)][i % step :: step]
        y = y[there[window - x - y]]
        triples.append(np.stack([np.full_like(y, x), y, window - x - y], axis=1))
    return np.concatenate([pairs, *triples])


def solve(combos: np.ndarray, counts: np.ndarray, steps: int = DESCENT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' lengths nearest to ``counts``.

    Accelerated projected gradient on ||A x - counts||^2; A has a column per
    combination with the number of times each length occurs in it.
    """
    if not len(combos):
        return np.zeros(0)
    target = counts.astype(float)
    target[0] = 0.0

    def lengths(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, j], weights=x, minlength=len(counts)) for j in range(3))
        out[0] = 0.0
        return out

    # The largest squared singular value of A is below (column sum) * (row sum).
    bound = 3.0 * max(1.0, lengths(np.ones(len(combos))).max())
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        gap = lengths(y) - target
        new = np.maximum(0.0, y - gap[combos].sum(axis=1) / bound)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / nxt * (new - x)
        x, t = new, nxt
    return x


def make_plan(counts: np.ndarray, window: int) -> Plan:
    """Places for ``counts[r]`` remainders of each length r in 1..window-1."""
    present = np.flatnonzero(counts)
    combos = combinations(present[present > 0], window)
    wanted = np.floor(solve(combos, counts)).astype(np.int64)
    left = counts.astype(np.int64).copy()
    runs: list[tuple[int, int, int, int]] = []
    sequence = 0
    # Rounded counts first; then each combination again as often as lengths are left.
    for limit in (wanted, np.full(len(combos), np.iinfo(np.int64).max)):
        for row, most in zip(combos[np.argsort(-wanted, kind="stable")], limit[np.argsort(-wanted, kind="stable")]):
            parts, times = np.unique(row[row > 0], return_counts=True)
            n = int(min(most, (left[parts] // times).min()))
            if n <= 0:
                continue
            at = 0
            for r in row[row > 0].tolist():
                runs.append((r, int(counts[r] - left[r]), sequence, at))
                left[r] -= n
                at += r
            sequence += n
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    order = np.arange(len(counts))[::-1]
    sizes = left[order] * order
    base = np.zeros(len(counts), dtype=np.int64)
    base[order] = np.cumsum(sizes) - sizes
    return Plan(
        window,
        np.searchsorted(table[:, 0], np.arange(len(counts) + 1)),
        table[:, 1], table[:, 2], table[:, 3],
        counts - left, base, sequence, sequence + int(-(-sizes.sum() // window)),
    )


def _encode(path: str, window: int, end: int) -> Callable:
    """Task function: ids of each document, and its rank among the task's remainders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        task = TaskContext.get().partitionId()
        seen, full = np.zeros(window, dtype=np.int64), 0
        tail = np.array([end], dtype=np.uint32).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids = [encode(x or "") + tail for x in part.column("text").to_pylist()]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                rem, whole = n % window, n // window
                ranks = np.empty_like(rem)
                for i, r in enumerate(rem.tolist()):
                    ranks[i] = seen[r]
                    seen[r] += 1
                before = full + np.cumsum(whole) - whole
                full += int(whole.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *map(pa.array, (n, rem, np.full_like(n, task), ranks, before)),
                        pa.array(ids if sys.byteorder == "little" else [np.frombuffer(x, np.uint32).astype("<u4").tobytes() for x in ids], pa.binary()),
                    ],
                    ["doc_id", "n", "rem", "task", "turn", "windows", "ids"],
                )

    return run


def _place(plan: Plan) -> Callable:
    """Task function: the pieces of each document; ids stay in the batch's buffers."""
    w = plan.window
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cuts(n: int, rem: int, rank: int, window: int) -> list[tuple[int, int, int, int]]:
        """Start, length, sequence and offset of each piece."""
        out = [(i * w, w, plan.full + window + i, 0) for i in range(n // w)]
        start = n - rem
        if rem and rank < plan.used[rem]:
            a, b = plan.first[rem], plan.first[rem + 1]
            i = a + int(np.searchsorted(plan.rank[a:b], rank, "right")) - 1
            out.append((start, rem, int(plan.sequence[i] + rank - plan.rank[i]), int(plan.offset[i])))
        elif rem:
            at = int(plan.base[rem]) + (rank - int(plan.used[rem])) * rem
            first = min(rem, w - at % w)
            out.append((start, first, plan.stream + at // w, at % w))
            if first < rem:
                out.append((start + first, rem - first, plan.stream + at // w + 1, 0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                numbers = zip(*(part.column(c).to_pylist() for c in ("doc_id", "n", "rem", "rank", "window")))
                for (doc, n, rem, rank, window), ids in zip(numbers, part.column("ids")):
                    data = memoryview(ids.as_buffer())
                    for begin, length, sequence, offset in cuts(n, rem, rank, window):
                        crc = zlib.crc32(data[4 * begin : 4 * (begin + length)])
                        rows.append((doc, begin, length, crc, n, sequence, offset))
                columns = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def pack(
    docs: DataFrame,
    *,
    tokenizer: str,
    text: str = "text",
    key: str = "doc_id",
    window: int = WINDOW,
    end: int = END,
) -> DataFrame:
    """One row per piece (:data:`PIECES`) of the documents' ids.

    A document is its ids by the tokenizer file and then id ``end``; null or
    empty text is the end alone.  Full windows are sequences of their own.  Only
    the last sequence may be shorter than the window.  Null and repeated keys
    are kept as they are: every row of ``docs`` is a document.  An empty table
    gives no rows.  Other columns are not read, so their names cannot clash.
    """
    encoded = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
    ).mapInArrow(
        _encode(tokenizer, window, end),
        "doc_id long, n long, rem long, task long, turn long, windows long, ids binary",
    )
    with small_batches(docs.sparkSession):
        ids = materialize(encoded, "pack-ids")
    cells = ids.groupBy("task", "rem").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.expr(f"n div {window}")).alias("whole")
    )
    cells = materialize(cells, "pack-histogram")
    counts = np.zeros(window, dtype=np.int64)
    for r in cells.groupBy("rem").agg(F.sum("docs").alias("docs")).collect():
        counts[r.rem] = r.docs
    counts[0] = 0
    plan = make_plan(counts, window)
    before = Window.partitionBy("rem").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = cells.groupBy("task").agg(F.sum("whole").alias("whole"))
    # One row per task of the first step; their running sum gives the window numbers.
    so_far = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("whole").over(so_far), F.lit(0)).alias("ahead"))
    offsets = cells.select(
        "task", "rem", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("above")
    ).join(tasks, "task")
    placed = ids.join(offsets, ["task", "rem"]).select(
        "doc_id", "n", "rem",
        (F.col("turn") + F.col("above")).alias("rank"),
        (F.col("windows") + F.col("ahead")).alias("window"),
        "ids",
    )
    with small_batches(docs.sparkSession):
        pieces = materialize(placed.mapInArrow(_place(plan), PIECES), "pack-pieces")
    discard(ids, cells)
    return pieces
