"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them).  A pattern supplies its words once per repetition level; level ``r``
costs ``r - 1`` a word, so costs are convex in the number of repetitions.  The
flow fills the sources' quotas at least cost, and every pattern's share is then
turned into whole copies of documents, in seeded order, the last of them chosen
so that their sizes add up.  What whole documents cannot reach may be taken as
words of one document more.

Only the pattern table, whose size follows the sources and not the documents,
comes to the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrounds.llm.common import packed, unpacked

MAX_PATTERNS = 200_000
# Rows of a pattern that one window may order; a larger pattern is cut by hash first.
CELL_ROWS = 2_000
CELL_BITS = 12
HASH_BITS = 60
# Rows of which the best subset is sought.
FIT_ROWS = 48
# The last of these bits come from the row's number: rows that share a key are told apart by them.
ROW_BITS = 20


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    weight: float
    target: float


def cycling_weights(position: int) -> float:
    """5, 2, 1, 5, 2, 1, ... for the sources in code-point order, null last."""
    return (5.0, 2.0, 1.0)[position % 3]


def water_fill(weights: list[float], caps: list[float], total: float) -> list[float]:
    """Shares of ``total`` by weight, none above its cap; what is cut off is reshared."""
    out, open_ = [0.0] * len(caps), set(range(len(caps)))
    left = min(total, sum(caps))
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = [i for i in open_ if left * weights[i] / weight > caps[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = caps[i]
            open_.discard(i)
        left = min(total, sum(caps)) - sum(out[i] for i in range(len(caps)) if i not in open_)
        left = max(left, 0.0)
    return out


def min_cost_flow(
    supply: list[int], edges: list[list[int]], quota: list[int], levels: int
) -> list[int]:
    """Words taken of each pattern: least total repetition cost among the fullest flows.

    Costs sit on the supply side only and grow with the level, so opening the
    levels one after the other and augmenting to a maximum flow in between is
    optimal: an augmentation never takes back what a cheaper level supplies.
    """
    taken, flow = [0] * len(supply), [dict.fromkeys(e, 0) for e in edges]
    members: list[list[int]] = [[] for _ in quota]
    for p, e in enumerate(edges):
        for s in e:
            members[s].append(p)
    left = list(quota)
    for level in range(1, levels + 1):
        room = [level * size - t for size, t in zip(supply, taken)]
        for p, e in enumerate(edges):  # what needs no rerouting
            for s in e:
                x = min(room[p], left[s])
                flow[p][s] += x
                room[p], left[s], taken[p] = room[p] - x, left[s] - x, taken[p] + x
        for p, e in enumerate(edges):
            while room[p] and len(e) and (path := _path(p, edges, members, flow, left)):
                x = min([room[p], left[path[-1]], *(flow[b][a] for a, b in zip(path[1::2], path[2::2]))])
                for a, b in zip(path[0::2], path[1::2]):
                    flow[a][b] += x
                for a, b in zip(path[1::2], path[2::2]):
                    flow[b][a] -= x
                room[p], left[path[-1]], taken[p] = room[p] - x, left[path[-1]] - x, taken[p] + x
    return taken


def _path(start: int, edges: list, members: list, flow: list, left: list) -> list[int]:
    """Pattern, source, pattern, ... to a source with quota left, by breadth-first search."""
    came: dict[int, tuple[int, int] | None] = {}
    queue, seen = deque([(start, None)]), {start}
    while queue:
        p, via = queue.popleft()
        for s in edges[p]:
            if s in came:
                continue
            came[s] = (p, via)
            if left[s] > 0:
                path = [s]
                while True:
                    p, via = came[path[-1]]
                    path.append(p)
                    if via is None:
                        return path[::-1]
                    path.append(via)
            for other in members[s]:
                if other not in seen and flow[other].get(s, 0) > 0:
                    seen.add(other)
                    queue.append((other, s))
    return []


def fit(sizes: list[int], gap: int, choices: int = FIT_ROWS) -> tuple[list[int], int]:
    """Places of sizes that add up to ``gap`` as nearly as whole ones from below may, and what is missing.

    All come from the front of the line but the last ones: of the rows where the
    line passes the gap, half of them before it, the best subset is taken.
    """
    front = len(list(takewhile(lambda end: end <= gap, accumulate(sizes))))
    first = max(0, front - choices // 2)
    left = gap - sum(sizes[:first])
    some = range(first, min(len(sizes), first + choices))
    # Bit i of reach[k]: the last k of the choices have a subset of sum i.
    reach, full = [1], (1 << (left + 1)) - 1
    for i in reversed(some):
        reach.append((reach[-1] | reach[-1] << min(sizes[i], left + 1)) & full)
    best = reach[-1].bit_length() - 1
    taken, missing = list(range(first)), left - best
    for k, i in zip(range(len(some) - 1, -1, -1), some):
        if sizes[i] <= best and reach[k] >> (best - sizes[i]) & 1:
            taken.append(i)
            best -= sizes[i]
    for i in range(some.stop, len(sizes)):
        if sizes[i] <= missing:
            taken.append(i)
            missing -= sizes[i]
    return taken, missing


def _fit_line(rows: pd.DataFrame) -> pd.DataFrame:
    """The turns of one cell's rows that are taken once more, and the first that is not."""
    rows = rows.sort_values("turn")
    taken, missing = fit(rows["size"].tolist(), int(rows["gap"].iloc[0]))
    chosen = set(taken)
    after = next((i + 1 for i in range(len(rows)) if i not in chosen and rows["size"].iloc[i] > missing), 0)
    turns = [i + 1 for i in sorted(chosen)]
    return pd.DataFrame({"q": [rows["p"].iloc[0]], "turns": [turns], "next": [after], "missing": [missing]})


def mix_to_weights(
    docs: DataFrame,
    *,
    membership: Column,
    size: Column,
    key: str = "doc_id",
    weight_of: Callable[[int], float] = cycling_weights,
    budget: float = 1.5,
    max_repeats: int = 2,
    seed: int = 17,
    split_last: bool = False,
) -> tuple[DataFrame, list[Source]]:
    """``docs`` with columns ``size``, ``copies``, ``part`` and ``taken``, and the sources' targets.

    ``membership`` is an array of source names (null is a source of its own; an
    empty or null array belongs to no source and is not taken).  Sources in code
    point order, null last, get ``weight_of(position)``; they share ``budget``
    times all sizes, none above ``max_repeats`` times its own size.  A document
    is taken 0 to ``max_repeats`` times, whole: that is ``copies``.  With
    ``split_last`` one document of each pattern gives ``part`` words more, so that
    every pattern gives exactly what the flow asks of it; else ``part`` is 0.
    ``taken`` is both together, at most ``max_repeats`` times the size.

    Null texts have whatever ``size`` says (0 in the queries); an empty table
    gives an empty table; repeated rows count each.  The seeded order is that of
    the keys' hashes; rows that share a key or have none follow their number in
    ``docs``, so it should be a stored table.  Columns of ``docs`` named like an
    added column are replaced.
    """
    spark = docs.sparkSession
    columns = docs.columns
    by_key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{key}`")), 64 - HASH_BITS + ROW_BITS)
    by_row = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 64 - ROW_BITS)
    place = F.shiftleft(by_key, ROW_BITS).bitwiseOR(by_row)
    base = docs.select(
        packed(docs),
        F.col(f"`{key}`").alias("id"),
        F.to_json(F.array_sort(F.array_distinct(membership))).alias("pattern"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        place.alias("place"),
    )
    slim = base.select("pattern", "size", "place")
    found = (
        slim.groupBy("pattern")
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        .limit(MAX_PATTERNS + 1)
        .collect()
    )
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; name sources more coarsely")
    import json

    found = sorted(found, key=lambda r: (r.pattern is None, r.pattern or ""))
    sets = [json.loads(r.pattern) if r.pattern else [] for r in found]
    names = sorted({s for one in sets for s in one}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    edges = [sorted({at[s] for s in one}) for one in sets]
    sizes = [0] * len(names)
    for r, e in zip(found, edges):
        for s in e:
            sizes[s] += r.words
    weights = [float(weight_of(i)) for i in range(len(names))]
    targets = water_fill(
        weights, [float(max_repeats * s) for s in sizes], budget * sum(r.words for r in found)
    )
    sources = [Source(*x) for x in zip(names, sizes, weights, targets)]
    taken = min_cost_flow(
        [r.words for r in found], edges, [round(t) for t in targets], max_repeats
    )
    plan = [
        (r.pattern, t // r.words if r.words else 0, t % r.words if r.words else 0, r.n)
        for r, t in zip(found, taken)
    ]
    cells = _cut_cells(slim, plan)
    cell = spark.createDataFrame(
        cells, "p string, whole long, low long, high long, gap long"
    ).hint("broadcast")
    placed = base.join(cell, F.col("pattern").eqNullSafe(F.col("p")))
    # Below the cell one more copy, above it none; rows inside are taken one by one.
    inside = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    rest = placed.filter(~inside).withColumn(
        "extra", (F.col("place") < F.col("low")).cast("long")
    ).withColumn("part", F.lit(0).cast("long"))
    edge = placed.filter(inside).withColumn(
        "turn", F.row_number().over(Window.partitionBy("p").orderBy("place", "id", "size"))
    )
    lines = edge.select("p", "gap", "turn", "size")
    picked = lines.groupBy("p").applyInPandas(_fit_line, "q string, turns array<int>, next int, missing long")
    edge = edge.join(picked, F.col("p").eqNullSafe(F.col("q")))
    last = F.lit(split_last) & (F.col("turn") == F.col("next"))
    edge = (
        edge.withColumn("extra", F.array_contains("turns", F.col("turn")).cast("long"))
        .withColumn("part", F.when(last, F.col("missing")).otherwise(F.lit(0)).cast("long"))
        .drop("turn", "q", "turns", "next", "missing")
    )
    out = rest.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra"))
    out = out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    return unpacked(out, columns, "size", "copies", "part", "taken"), sources


def _cut_cells(slim: DataFrame, plan: list[tuple]) -> list[tuple]:
    """For each pattern the hash range in which its running size passes the rest.

    A histogram over the next hash bits finds the cell; a cell that still holds
    many rows is divided again, so no pattern is ever ordered whole.
    """
    top, enough = 1 << HASH_BITS, max(CELL_ROWS, FIT_ROWS)
    done, todo = [], []
    for pattern, whole, rest, n in plan:
        if not rest:
            done.append((pattern, whole, 0, 0, 0))
        elif n <= enough:
            done.append((pattern, whole, 0, top, rest))
        else:
            todo.append((pattern, whole, 0, HASH_BITS, rest))
    spark = slim.sparkSession
    while todo:
        step = spark.createDataFrame(
            todo, "p string, whole long, low long, bits int, gap long"
        ).hint("broadcast")
        within = slim.join(step, F.col("pattern").eqNullSafe(F.col("p"))).filter(
            "place >= low AND place - low < shiftleft(1L, bits)"
        )
        counts = within.groupBy(
            "p", "whole", "low", "bits", "gap",
            F.expr(f"shiftright(place - low, bits - {CELL_BITS})").alias("cell"),
        ).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        end = F.sum("words").over(Window.partitionBy("p").orderBy("cell"))
        first = (
            counts.withColumn("end", end)
            .filter("end > gap")
            .groupBy("p", "whole", "low", "bits", "gap")
            .agg(F.expr("min_by(struct(cell, n, end - words AS below), cell)").alias("c"))
            .collect()
        )
        todo = []
        for r in first:
            bits = r.bits - CELL_BITS
            low, gap = r.low + (r.c.cell << bits), r.gap - r.c.below
            if r.c.n <= enough or bits < CELL_BITS:
                done.append((r.p, r.whole, low, low + (1 << bits), gap))
            else:
                todo.append((r.p, r.whole, low, bits, gap))
    return done
