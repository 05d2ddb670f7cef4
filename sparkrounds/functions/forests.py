"""The Python functions that run inside tasks: forests and stars of edge batches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

# Ship this module's functions with the plan, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def streaming_forest(
    limit: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: fold batches into per-part forests within ``limit`` rows.

    Folding happens as soon as the rows held are twice the last forest (four times
    if that fold removed little), so the buffer stays small and each row is sorted
    only a few times.
    """
    names = ["part", "src", "dst", "w"]
    chunk = 1 << 18

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, trigger = 0, min(limit, chunk)
        for batch in batches:
            held.append(tuple(batch.column(name).to_numpy(False) for name in names))
            rows += batch.num_rows
            if rows >= trigger:
                folded, kept = rows, _forest_of(held)
                rows = len(kept[0])
                if 2 * rows > limit:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names)
                    held, rows = [], 0
                else:
                    held = [kept]
                # Where a fold removed little, the next one waits for more rows.
                trigger = min(limit, max(chunk, (2 if 4 * rows < 3 * folded else 4) * rows))
        if held:
            kept = _forest_of(held)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names)

    return fold


def _forest_of(chunks: list[tuple]) -> tuple:
    """Minimum spanning forest per part of the rows in ``chunks`` (numpy contraction).

    Empties ``chunks``.  Vertices and places are 32-bit numbers and columns stay
    as they came, so a row takes about 80 bytes at the most.
    """
    columns = [list(column) for column in zip(*chunks)]
    chunks.clear()
    part, src, dst, w = (_joined(column) for column in columns)
    m = len(w)
    if not m:
        return part, src, dst, w
    # Dense vertex numbers; one number per (part, vertex).
    ends, ids = pd.factorize(np.concatenate([src, dst]))
    n = len(ids)
    del ids
    if part.min() != part.max():
        ends += np.tile(part.astype(np.int64) * n, 2)
        ends, ids = pd.factorize(ends)
        n = len(ids)
        del ids
    ends = ends.astype(np.int32)
    order = _weight_order(w, src, dst).astype(np.int32)
    a, b = ends[:m][order], ends[m:][order]
    del ends
    keep = np.zeros(m, dtype=bool)
    rank = np.arange(m, dtype=np.int32)
    while len(rank):
        # Rows are in weight order, so writing them backwards leaves the lightest.
        back = np.arange(len(rank), dtype=np.int32)[::-1]
        none = np.int32(len(rank))
        best, other = np.full(n, none), np.full(n, none)
        best[a[::-1]] = back
        other[b[::-1]] = back
        best = np.minimum(best, other)
        tops = np.flatnonzero(best < none).astype(np.int32)
        chosen = best[tops]
        keep[rank[chosen]] = True
        parent = np.arange(n, dtype=np.int32)
        parent[tops] = np.where(a[chosen] == tops, b[chosen], a[chosen])
        parent[tops] = np.where(
            (parent[parent[tops]] == tops) & (tops < parent[tops]), tops, parent[tops]
        )
        while True:
            ahead = parent[parent]
            if np.array_equal(ahead, parent):
                break
            parent = ahead
        a, b = parent[a], parent[b]
        cross = a != b
        a, b, rank = a[cross], b[cross], rank[cross]
    kept = order[keep]
    return part[kept], src[kept], dst[kept], w[kept]


def _weight_order(w: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The rows' places in the order (w, src, dst): by weight, then only rows of equal weight by their ends."""
    order = np.argsort(w)
    ordered = w[order]
    same = ordered[1:] == ordered[:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if not len(tied):
        return order
    kinds = np.cumsum(np.append(False, ~same))[tied]
    rows = order[tied]
    a, b = src[rows], dst[rows]
    bits = [int(x.max() - x.min()).bit_length() if int(x.max()) - int(x.min()) < 1 << 62 else 64 for x in (kinds, a, b)]
    if sum(bits) <= 64:
        # All three as one number sort much faster than one after the other.
        key = (kinds - kinds.min()).astype(np.uint64)
        for x, width in ((a, bits[1]), (b, bits[2])):
            key = key << np.uint64(width) | (x - x.min()).astype(np.uint64)
        order[tied] = rows[np.argsort(key)]
    else:
        order[tied] = rows[np.lexsort((b, a, kinds))]
    return order


def _joined(chunks: list[np.ndarray]) -> np.ndarray:
    """The chunks as one array; the list is emptied."""
    whole = chunks[0] if len(chunks) == 1 else np.concatenate(chunks)
    chunks.clear()
    return whole


def streaming_stars(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: fold links (hi, lo) into one per vertex, to the smallest it reaches in the task.

    What is held never exceeds ``limit`` rows by more than a batch; beyond half of
    it the stars so far are emitted and a new fold begins.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, trigger = 0, min(limit, 1 << 18)

        def emit() -> pa.RecordBatch:
            hi, lo = held[0]
            return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["hi", "lo"])

        for batch in batches:
            held.append((batch.column("hi").to_numpy(False), batch.column("lo").to_numpy(False)))
            rows += batch.num_rows
            if rows >= trigger:
                held = [_stars_of(held)]
                rows = len(held[0][0])
                if 2 * rows > limit:
                    yield emit()
                    held, rows = [], 0
                trigger = min(limit, max(1 << 18, 4 * rows))
        if held:
            held = [_stars_of(held)]
            yield emit()

    return fold


def _stars_of(chunks: list[tuple]) -> tuple:
    """(vertex, smallest vertex of its component) for all that are not the smallest themselves."""
    hi, lo = (np.concatenate(column) for column in zip(*chunks))
    ids, ends = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = ends[: len(hi)], ends[len(hi) :]
    label = np.arange(len(ids))
    while len(a):
        p, q = label[a], label[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            ahead = label[label]
            if np.array_equal(ahead, label):
                break
            label = ahead
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]
