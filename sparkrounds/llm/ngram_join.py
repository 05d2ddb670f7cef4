"""Documents with similar sets of word shingles, by filters under several token orders.

Two sets with Jaccard similarity of at least 3/4 share a token among the first
quarter or so of each, whatever the order of tokens; and they share many there.
Candidates must pass that test under every one of several global orders before
the sets themselves are compared.

All orders put frequent tokens last, by a table of counts over all documents
that has a fixed number of cells.  A second table, sized by the counted tokens,
drops prefix tokens that no other prefix has.  A third one names one row of each
set, so that copies are not looked at again.  The tables only save work: what
they let through in excess is removed later, and nothing else is removed.

Equal sets are one class.  Within the documents that share a token, each is
first compared with one leader.  Only pairs of different components that these
links leave are examined further, and every one of them is: in small groups by
counting their common prefix tokens, in large ones in blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrounds.functions.sizing import broadcast_if_small
from sparkrounds.llm.common import small_batches
from sparkrounds.llm.shingles import STEP, U64, mix, shingle_sets
from sparkrounds.plans.lineage import discard, materialize, materialize_counted

# A power of two: a prefix token's lowest bits are the number of its order.
ORDERS = 2
ORDER = f"token & {ORDERS - 1}L"
CHUNKS = 64
FILE_CHUNKS = 8
COUNT_BITS = 22
# The table of prefix tokens has about so many cells for each of them, within these bounds.
CELLS_PER_TOKEN = 8
CELLS_PER_SET = 8
LEAST_CELL_BITS, MOST_CELL_BITS = 16, 28
SMALL_GROUP = 128
BLOCK = 1024
BROADCAST_ROWS = 100_000
PAIRS = "a long, b long"


def prefix_length(n: np.ndarray | int):
    """So many first tokens of a set of n hold one of any set with similarity 3/4."""
    return n - (3 * n + 3) // 4 + 1


def possible(common: str, m: str, n: str) -> str:
    """SQL: sets of sizes m and n with so many common prefix tokens may have similarity 3/4.

    Beyond the shorter-reaching prefix lie at most that set's other tokens.
    """
    rest = [f"({x} - ({x} - (3 * {x} + 3) div 4 + 1))" for x in (m, n)]
    return (
        f"4 * least({m}, {n}) >= 3 * greatest({m}, {n}) AND "
        f"7 * ({common} + greatest({rest[0]}, {rest[1]})) >= 3 * ({m} + {n})"
    )


def similar(common: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 100 * common >= 75 * (m + n - common)


def signature(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = mix(tokens ^ STEP).sum(dtype=U64, keepdims=True) + U64(len(tokens))
    return int(mix(total).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()])


def _chunked(kind: int, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n), none, none, none, none, pa.array(range(n), pa.int64()), pa.array(data, pa.binary())],
        ["kind", "doc_id", "body", "n", "sig", "chunk", "data"],
    )


def _profile() -> Callable:
    """Task function: size and name of each set (kind 0), and the task's token counts (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, dtype=np.uint8)
        for batch in batches:
            for part, sets in _sets(batch):
                n = len(sets)
                sizes = [len(x) for x in sets]
                names = [signature(x) if len(x) else None for x in sets]
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * n), part.column("doc_id"), part.column("body"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), none, pa.nulls(n, pa.binary())],
                    ["kind", "doc_id", "body", "n", "sig", "chunk", "data"],
                )
                cells = (np.concatenate(sets) >> U64(64 - COUNT_BITS)).astype(np.int64)
                cells, times = np.unique(cells, return_counts=True)
                counts[cells] = np.minimum(counts[cells].astype(np.int64) + times, 255)
        yield _chunked(1, [zlib.compress(x.tobytes(), 1) for x in np.split(counts, CHUNKS)])

    return run


def _add_counts(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << COUNT_BITS) // CHUNKS, dtype=np.int64)
    for data in rows["data"]:
        total += np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    return pd.DataFrame({"chunk": rows["chunk"][:1], "data": [total.astype(np.uint32).tobytes()]})


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """0 for cells as full as chance explains, then the count's power of two."""
    mean = counts.mean()
    usual = int(np.log2(mean + 6 * np.sqrt(mean) + 1))
    power = np.log2(np.maximum(counts, 1)).astype(np.uint8)
    return np.where(power <= usual, 0, power).astype(np.uint8)


def _prefix(tokens: np.ndarray, classes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix under one order, and the tokens' places in it."""
    place = mix(tokens ^ U64((order + 1) * int(STEP) % (1 << 64)))
    kind = classes[(tokens >> U64(64 - COUNT_BITS)).astype(np.int64)]
    first = np.lexsort((place, kind))[: prefix_length(len(tokens))]
    return tokens[first], place[first]


def _new_sets(sets: list[np.ndarray], met: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Names and sets without empty ones and those that the task has met."""
    if len(met) > 1_000_000:
        met.clear()
    for x in sets:
        if len(x) and (name := signature(x)) not in met:
            met.add(name)
            yield name, x


def cell_bits(cells: int) -> int:
    """Of a table with at least so many cells, within the bounds."""
    return min(MOST_CELL_BITS, max(LEAST_CELL_BITS, cells.bit_length()))


def _cell(place: np.ndarray, bits: int) -> np.ndarray:
    """By the low bits: the high ones are small for every prefix token."""
    return (place & U64((1 << bits) - 1)).astype(np.int64)


def _has(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (7 - (cell & 7))) & 1 == 1


def _by_chunk(cells: list[np.ndarray], order: int, width: int) -> pa.RecordBatch:
    """The cells under one order as a row for each chunk; empties the list."""
    all_ = np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *cells]))
    cells.clear()
    low = (all_ & ((1 << (width - 6)) - 1)).astype(np.uint32)
    edges = np.arange(1, CHUNKS, dtype=np.int64) << (width - 6)
    parts = [packed_cells(x) for x in np.split(low, np.searchsorted(all_, edges))]
    chunks = pa.array(range(order * CHUNKS, (order + 1) * CHUNKS), pa.int64())
    return pa.RecordBatch.from_arrays([chunks, pa.array(parts, pa.binary())], ["chunk", "data"])


def packed_cells(cells: np.ndarray) -> bytes:
    """Ascending cells by their distances, of two bytes each where these suffice; :func:`unpacked_cells` has them again."""
    far = np.diff(cells, prepend=np.uint32(0))
    small = not len(far) or int(far.max()) < 1 << 16
    return (b"\x02" if small else b"\x04") + far.astype(np.uint16 if small else np.uint32).tobytes()


def unpacked_cells(data: bytes) -> np.ndarray:
    far = np.frombuffer(data, dtype=np.uint16 if data[:1] == b"\x02" else np.uint32, offset=1)
    return np.cumsum(far, dtype=np.uint32)


def _row_cells(width: int) -> Callable:
    """Task function: the cells of all rows' names, by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(_cell(batch.column("name").to_numpy().view(U64), width))
            if sum(map(len, held)) > 2_000_000:
                yield _by_chunk(held, 0, width)
        yield _by_chunk(held, 0, width)

    return run


def _chosen(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
    """The rows that stand for their sets, and perhaps a few more."""
    width = len(first).bit_length() + 2
    return batch.filter(pa.array(_has(first, _cell(batch.column("name").to_numpy().view(U64), width))))


def _prefix_cells(classes, first, width: int) -> Callable:
    """Task function: the cells of all prefix tokens, by order and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        held: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
        size = 0
        met: set[int] = set()
        for batch in batches:
            for _, sets in _sets(_chosen(batch, first.value)):
                for _, x in _new_sets(sets, met):
                    for order in range(ORDERS):
                        place = _prefix(x, table, order)[1]
                        held[order].append(_cell(place, width))
                        size += len(place)
                if size > 2_000_000:
                    yield from (_by_chunk(cells, order, width) for order, cells in enumerate(held))
                    size = 0
        yield from (_by_chunk(cells, order, width) for order, cells in enumerate(held))

    return run


def _filled_cells(width: int, least: int) -> Callable:
    """Sums up cells: a bit for those filled at least once or twice."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        times = np.zeros(1 << (width - 6), dtype=np.uint8)
        for data in rows["data"]:
            cells, n = np.unique(unpacked_cells(data), return_counts=True)
            times[cells] = np.minimum(times[cells] + np.minimum(n, 2), 2)
        return pd.DataFrame({"chunk": rows["chunk"][:1], "data": [np.packbits(times >= least).tobytes()]})

    return run


def _prefix_rows(classes, first, shared, width: int) -> Callable:
    """Task function: token, set name and set size for tokens in shared cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = classes.value, shared.value
        met: set[int] = set()
        for batch in batches:
            for _, sets in _sets(_chosen(batch, first.value)):
                out = [(np.zeros(0, np.int64),) * 3]
                for name, x in _new_sets(sets, met):
                    for order in range(ORDERS):
                        token, place = _prefix(x, table, order)
                        # A token has another name under each order.
                        token = mix(token + U64(order)) & ~U64(ORDERS - 1) | U64(order)
                        kept = token[_has(bits[order], _cell(place, width))].view(np.int64)
                        n = len(kept)
                        out.append((kept, np.full(n, name), np.full(n, len(x))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out)], ["token", "sig", "n"]
                )

    return run


def _wanted_sets() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch):
                names = [signature(x) if len(x) else None for x in sets]
                right = [i for i, (a, b) in enumerate(zip(names, part.column("want").to_pylist())) if a == b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[i] for i in right], pa.int64()),
                        pa.array([len(sets[i]) for i in right], pa.int64()),
                        pa.array([sets[i].tobytes() for i in right], pa.binary()),
                    ],
                    ["sig", "n", "tokens"],
                )

    return run


def _verify() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(similar(common, len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links that join the block's components as all its links do; common tokens by matrix products."""
    out = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not len(left) or not len(right):
        return out
    sides = []
    for rows in (left, right):
        sets = [np.frombuffer(x, U64) for x in rows["tokens"]]
        sides.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)))
    both = np.intersect1d(sides[0][1], sides[1][1])
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(both), 4096):
        some = both[at : at + 4096]
        held = []
        for (row, token), rows in zip(sides, (left, right)):
            col = np.minimum(np.searchsorted(some, token), len(some) - 1)
            there = some[col] == token
            m = np.zeros((len(rows), len(some)), dtype=np.float32)
            m[row[there], col[there]] = 1
            held.append(m)
        common += held[0] @ held[1].T
    m, n = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None, :]
    apart = left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]
    i, j = np.nonzero(apart & similar(common.astype(np.int64), m, n))
    # One link for each pair of components, and of these only a spanning forest.
    p, q = left["comp"].to_numpy()[i], right["comp"].to_numpy()[j]
    _, first = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)]), axis=1, return_index=True)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    kept = []
    for f in first.tolist():
        one, two = find(int(p[f])), find(int(q[f]))
        if one != two:
            root[max(one, two)] = min(one, two)
            kept.append(f)
    a, b = left["sig"].to_numpy()[i[kept]], right["sig"].to_numpy()[j[kept]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def connected(links: DataFrame) -> DataFrame:
    """sig and comp (the smallest sig reachable) of every end of ``links`` (a, b).

    Alternates linking larger and smaller neighbours to the smallest one until
    nothing changes; each round is two aggregates and two joins.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(edges.filter("u <> v").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")
        ).distinct()
        large = materialize(large, "links-large")
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        edges = materialize(small.distinct(), "links")
    tips = edges.select(F.col("u").alias("sig"), F.col("v").alias("comp"))
    return tips.unionByName(edges.select(F.col("v").alias("sig"), F.col("v").alias("comp"))).distinct()


def _table(rows: DataFrame, add: Callable, orders: int, dtype: str, size: int) -> list[np.ndarray]:
    """Per order the whole table of cells, ``size`` bytes a chunk, filled chunk by chunk.

    A nearly empty table takes next to no room on disk, so a task would read it whole: files have few chunks.
    """
    summed = rows.groupBy("chunk").applyInPandas(add, "chunk long, data binary")
    summed = materialize(summed, "ngram-cells", maxRecordsPerFile=str(FILE_CHUNKS))
    out = [np.zeros(CHUNKS * size, dtype=np.uint8) for _ in range(orders)]
    for row in summed.toLocalIterator():
        at = row.chunk % CHUNKS * size
        out[row.chunk // CHUNKS][at : at + size] = np.frombuffer(row.data, np.uint8)
    discard(summed)
    return [table.view(dtype) for table in out]


def _first_rows(reps: DataFrame, width: int) -> np.ndarray:
    """The table of rows that stand for their sets, a bit a cell."""
    cells = reps.select(F.xxhash64("rep.doc_id", "rep.body").alias("name")).mapInArrow(
        _row_cells(width), "chunk long, data binary"
    )
    return _table(cells, _filled_cells(width, 1), 1, "u1", (1 << width) // 8 // CHUNKS)[0]


def jaccard_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Links are those of similarity 3/4 or more between sets of five-word shingles
    (fewer words: the whole sequence).  component_id is the smallest key that
    links reach; keys that are null count last.  Documents without words or text
    are linked with nothing and keep their own key.  Repeated rows are copies of
    each other.  An empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(*row_name(docs, text=text, key=key), F.col(f"`{text}`").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        named = _classed(rows)
    least = named.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return named.join(least, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def row_name(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> list[Column]:
    """doc_id and body (a hash of the text): with both, rows that share a key or have none are told apart."""
    return [F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("body")]


def near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, body (see :func:`row_name`), rows and kept of every different row.

    ``kept`` is true for one row of each component of :func:`jaccard_components`,
    the one with the smallest key (null counts last) and of these the smallest
    body, and for all rows without words; ``rows`` says how many repeat both.
    """
    rows = docs.select(*row_name(docs, text=text, key=key), F.col(f"`{text}`").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        named = _classed(rows)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body")
    each = materialize(named.groupBy("doc_id", "body", "comp").agg(F.count(F.lit(1)).alias("rows")), "ngram-rows")
    discard(named)
    least = each.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(place).alias("least"))
    kept = F.col("comp").isNull() | ((F.col("doc_id").eqNullSafe(F.col("least.doc_id"))) & (F.col("body") == F.col("least.body")))
    return each.join(least, "comp", "left").select("doc_id", "body", "rows", kept.alias("kept"))


def _classed(rows: DataFrame) -> DataFrame:
    """doc_id, body, n, sig and comp (null without words) of every one of ``rows`` (doc_id, body, text)."""
    spark = rows.sparkSession
    profile = materialize(
        rows.mapInArrow(_profile(), "kind long, doc_id long, body long, n long, sig long, chunk long, data binary"),
        "ngram-profile",
    )
    people = profile.filter("kind = 0").select("doc_id", "body", "n", "sig")
    counts = _table(profile.filter("kind = 1").select("chunk", "data"), _add_counts, 1, "u4", 4 * (1 << COUNT_BITS) // CHUNKS)[0]
    classes = spark.sparkContext.broadcast(frequency_class(counts))
    reps = people.filter("sig IS NOT NULL").groupBy("sig").agg(F.min(F.struct("doc_id", "body")).alias("rep"))
    reps, sets = materialize_counted(reps, "ngram-classes")
    first = spark.sparkContext.broadcast(_first_rows(reps, cell_bits(sets * CELLS_PER_SET)))
    # A quarter of all tokens stand in prefixes.
    width = cell_bits((people.agg(F.sum("n")).first()[0] or 0) * CELLS_PER_TOKEN // 4)
    texts = rows.select(F.xxhash64("doc_id", "body").alias("name"), "text")
    cells = texts.mapInArrow(_prefix_cells(classes, first, width), "chunk long, data binary")
    shared = spark.sparkContext.broadcast(_table(cells, _filled_cells(width, 2), ORDERS, "u1", (1 << width) // 8 // CHUNKS))
    prefixes = texts.mapInArrow(_prefix_rows(classes, first, shared, width), "token long, sig long, n long")
    prefixes = materialize(prefixes, "ngram-prefixes")
    # The tables have served; executors need not hold them through the rest.
    for table in (classes, first, shared):
        table.unpersist()
    # Where two sets alone share a token, as grows with chance, their sizes must fit each other.
    alike = Window.partitionBy("token")
    members = prefixes.withColumns(
        {
            "members": F.count(F.lit(1)).over(alike), "lead": F.min("sig").over(alike), "last": F.max("sig").over(alike),
            "least": F.min("n").over(alike), "most": F.max("n").over(alike), "m": F.min_by("n", "sig").over(alike),
        }
    ).filter("lead < last AND (members > 2 OR 4 * least >= 3 * most)").drop("last", "least", "most")
    members = materialize(members, "ngram-members")
    discard(prefixes)
    stars = (
        members.filter("sig <> lead AND 4 * least(m, n) >= 3 * greatest(m, n)")
        .groupBy(F.expr(ORDER).alias("ord"), F.col("lead").alias("a"), F.col("sig").alias("b"))
        .agg(F.count(F.lit(1)).alias("c"), F.first("m").alias("m"), F.first("n").alias("n"))
        .filter(possible("c", "m", "n"))
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("orders")).filter(f"orders = {ORDERS}")
    )
    stars = materialize(stars.select("a", "b"), "ngram-stars")
    links = _verified(rows, reps, stars)
    parts, n = materialize_counted(connected(links), "ngram-parts")
    comp = broadcast_if_small(parts, n, BROADCAST_ROWS)

    def apart(some: str) -> DataFrame:
        """The rows of groups of some size that have several components, and each group's least one."""
        placed = members.filter(some).select("token", "sig", "n").join(comp, "sig", "left")
        placed = placed.withColumn("comp", F.coalesce("comp", "sig"))
        placed = placed.withColumns({"main": F.min("comp").over(alike), "other": F.max("comp").over(alike)})
        return placed.filter("main <> other").drop("other")

    # Both sides read one exchange by token, and need no other after their windows.
    small = apart(f"members <= {SMALL_GROUP}").drop("main")
    one = small.select("token", F.col("sig").alias("a"), F.col("n").alias("m"), F.col("comp").alias("p"))
    two = small.select("token", F.col("sig").alias("b"), "n", F.col("comp").alias("q"))
    pairs = (
        one.join(two, "token")
        .filter("a < b AND p <> q AND 4 * least(m, n) >= 3 * greatest(m, n)")
        .groupBy(F.expr(ORDER).alias("ord"), "a", "b", "m", "n").agg(F.count(F.lit(1)).alias("c"))
        .filter(possible("c", "m", "n"))
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("orders")).filter(f"orders = {ORDERS}")
        .join(stars, ["a", "b"], "left_anti").select("a", "b")
    )
    pairs = materialize(pairs, "ngram-pairs")
    left = materialize(apart(f"members > {SMALL_GROUP}").withColumn("ord", F.expr(ORDER)), "ngram-left")
    discard(stars)
    more = _verified(rows, reps, pairs)
    far = _across_blocks(rows, reps, left)
    discard(left)
    links = links.unionByName(more).unionByName(far)
    parts = materialize(connected(links), "ngram-parts")
    named = people.join(parts, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    named = materialize(named, "ngram-named")
    discard(profile, reps, parts)
    return named


def _fetch(rows: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """sig, n and tokens of the wanted sets, from one document of each."""
    chosen, n = materialize_counted(
        reps.join(wanted, "sig", "left_semi").select(F.col("sig").alias("want"), "rep"), "ngram-wanted"
    )
    # Key and text together name a row, so rows without a key meet one wanted set at most.
    same = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & F.col("body").eqNullSafe(F.col("rep.body"))
    texts = rows.join(broadcast_if_small(chosen, n, BROADCAST_ROWS), same)
    sets = texts.select("text", "want").mapInArrow(_wanted_sets(), "sig long, n long, tokens binary")
    sets, found = materialize_counted(sets, "ngram-sets")
    if found == n:
        return sets
    # Repeated rows bring a set twice; only then are sets dealt out to find them.
    once = materialize(sets.dropDuplicates(["sig"]), "ngram-sets")
    discard(sets)
    return once


def _verified(rows: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    sets = _fetch(rows, reps, ends)
    x = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    links = materialize(both.mapInArrow(_verify(), PAIRS), "ngram-links")
    discard(sets)
    return links


def _across_blocks(rows: DataFrame, reps: DataFrame, left: DataFrame) -> DataFrame:
    """Links across components within large groups: those outside the main one against all.

    The tokens of a passage have the same documents; sets are compared whole, so one token stands for them all.
    """
    fetched = _fetch(rows, reps, left.select("sig").distinct())
    sets = fetched.select("sig", "tokens")
    names = [f"sum(shiftrightunsigned(xxhash64(sig, {i}), 30))" for i in range(3)]
    blocks = left.groupBy("ord", "token").agg(
        F.count(F.lit(1)).alias("ys"), F.count_if(F.expr("comp <> main")).alias("xs"),
        *[F.expr(name).alias(f"name{i}") for i, name in enumerate(names)],
    )
    blocks = blocks.groupBy("ys", "xs", *[f"name{i}" for i in range(len(names))]).agg(F.min(F.struct("ord", "token")).alias("one"))
    blocks = blocks.select("one.*", *[F.expr(f"ceil({c} / {BLOCK})").alias(c) for c in ("ys", "xs")])
    dealt = left.join(blocks, ["ord", "token"])
    by = ["ord", "token", "x", "y"]
    one = dealt.filter("comp <> main").select(
        "ord", "token", "sig", "n", "comp", F.expr("pmod(xxhash64(sig), xs)").alias("x"),
        F.expr("explode(sequence(0L, ys - 1))").alias("y"),
    ).join(sets, "sig")
    two = dealt.select(
        "ord", "token", "sig", "n", "comp", F.expr("explode(sequence(0L, xs - 1))").alias("x"),
        F.expr("pmod(xxhash64(sig), ys)").alias("y"),
    ).join(sets, "sig")
    one, two = materialize(one, "ngram-block-rows"), materialize(two, "ngram-block-rows")
    discard(fetched)
    found = one.groupBy(*by).cogroup(two.groupBy(*by)).applyInPandas(_compare_block, PAIRS)
    links = materialize(found, "ngram-links")
    discard(one, two)
    return links
