"""Scoring texts by logistic mixing of hashed-context bit predictors.

A token is coded by the bits of its path in a binary tree (Huffman's, over the
commonest tokens, the end of a text and one leaf for all other words).  Three
predictors estimate every bit: by the node alone, by a hash of node and previous
token, and by a hash of node and the two previous tokens.  Their log odds are
mixed by weights that a gate chooses from the predictors' confidence, corrected
online by what earlier blocks of the same text show, and refined by a map of
what final odds were worth.  Texts add up bits, so the score is a probability.

The hashed counts cover all training texts and have a fixed number of cells;
only these tables travel to the tasks.  The weights and the map are fitted to
all training texts too: while a task counts, it first tallies what the counts it
has so far predict of each run of tokens, and only then adds the run to them.  Counts of words of any number stay in a
table that is joined by shuffle.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrounds.llm.shingles import U64, word_hashes
from sparkrounds.plans.lineage import materialize

CODED_WORDS = 1 << 16
TABLE_BITS = 22
CHUNKS = 64
TABLES = 2
LEVELS = 6
BLOCK_TOKENS = 64
BATCH_TOKENS = 40_000
# Tokens whose bits are looked at together: their arrays stay in the processor's cache.
RUN_TOKENS = 6_000
# Step of the online correction, a parameter that is not learned.
RATE = 0.002
GATES = LEVELS * LEVELS
# Tallied log odds are whole numbers from -8 to 8.
ODDS = 17
TALLY = GATES * ODDS**3 * 2


@dataclass(frozen=True)
class Code:
    """Symbols 0..m-1 are the coded words by rising hash; then other words, end, start."""

    words: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    node_odds: np.ndarray
    # Of each leaf's path: its nodes' hashes.
    steps: np.ndarray

    @property
    def other(self) -> int:
        return len(self.words)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.other)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, self.other)


@dataclass(frozen=True)
class Model:
    code: Code
    cells: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    rate: float = RATE


def huffman(words: np.ndarray, counts: np.ndarray, others: int, ends: int) -> Code:
    """The code for the words (by rising hash), the other words together, and the end."""
    weight = np.maximum([*counts.tolist(), others + 1, ends + 1], 1).tolist()
    n = len(weight)
    heap = [(w, i) for i, w in enumerate(weight)]
    heapq.heapify(heap)
    parent, side, mass = [0] * (2 * n - 1), [0] * (2 * n - 1), weight + [0] * (n - 1)
    zeros = [0] * (n - 1)
    for new in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = new
        side[j] = 1
        mass[new], zeros[new - n] = a + b, a
        heapq.heappush(heap, (a + b, new))
    first, length, nodes, bits = [], [], [], []
    for leaf in range(n):
        path, at = [], leaf
        while at != 2 * n - 2:
            path.append((parent[at] - n, side[at]))
            at = parent[at]
        first.append(len(nodes))
        length.append(len(path))
        nodes += [x for x, _ in path[::-1]]
        bits += [y for _, y in path[::-1]]
    zero, total = np.array(zeros, dtype=float), np.array(mass[n:], dtype=float)
    odds = np.log((total - zero + 0.5) / (zero + 0.5))
    return Code(
        words, counts, np.array(first), np.array(length), np.array(nodes, dtype=np.uint32),
        np.array(bits, dtype=np.uint8), odds.astype(np.float32), np.array(nodes, dtype=np.uint32) * np.uint32(0x27D4EB2F),
    )


@dataclass
class Events:
    """The bits of a run of tokens; ``token`` says whose bit each is."""

    token: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    cells: tuple[np.ndarray, np.ndarray]


def events(code: Code, symbols: np.ndarray, fresh: np.ndarray) -> Events:
    """Bits of ``symbols``; ``fresh`` marks the first token of each text."""
    start = code.other + 2
    before = np.empty_like(symbols)
    before[0:1], before[1:] = start, symbols[:-1]
    before[fresh] = start
    second = np.empty_like(symbols)
    second[0:1], second[1:] = start, before[:-1]
    second[fresh] = start
    with np.errstate(over="ignore"):
        one = (before.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        two = (one ^ (one >> np.uint32(15))) * np.uint32(0x85EBCA77) + (second.astype(np.uint32) + np.uint32(7)) * np.uint32(0xC2B2AE3D)
        n = code.length[symbols]
        token = np.repeat(np.arange(len(symbols)), n)
        spot = np.arange(len(token)) + np.repeat(code.first[symbols] - (np.cumsum(n) - n), n)
        step = code.steps.take(spot)
        cells = []
        for i, context in enumerate((one, two)):
            x = np.repeat(context, n)
            x ^= step
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x2C1B3C6D)
            x >>= np.uint32(32 - TABLE_BITS)
            x += np.uint32(i << TABLE_BITS)
            cells.append(x)
    return Events(token, code.nodes.take(spot), code.bits.take(spot), tuple(cells))


def inputs(model: Model, e: Events) -> tuple[list[np.ndarray], np.ndarray]:
    """The predictors' log odds and the gate of every bit."""
    a, b = model.cells.take(e.cells[0]), model.cells.take(e.cells[1])
    odds = [model.code.node_odds.take(e.node)]
    for x in (a, b):
        x = (x & np.uint16(255)).astype(np.float32)
        x *= np.float32(1 / 16)
        x -= np.float32(8)
        odds.append(x)
    return odds, ((a >> np.uint16(8)) * np.uint16(LEVELS) + (b >> np.uint16(8))).astype(np.int64)


def cell_values(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """A cell's log odds, in sixteenths above -8, and its confidence level, in 16 bits."""
    n = ones + zeros
    odds = np.where(n > 0, np.log((ones + 0.3) / (zeros + 0.3)), 0.0)
    level = np.minimum(np.ceil(np.log2(n + 1.0)), LEVELS - 1).astype(np.uint16)
    return (np.clip(np.round(odds * 16 + 128), 0, 255).astype(np.uint16) | (level << np.uint16(8))).astype(np.uint16)


def mixed(model: Model, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
    return sum(np.ascontiguousarray(model.weights[:, i]).take(gate) * x for i, x in enumerate(odds))


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -14, 14)))


def _slots(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Places in the map of what odds were worth."""
    return gate * 33 + np.clip(np.round(z * 2 + 16), 0, 32).astype(np.int64)


def refined(model: Model, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Half the mixture's probability, half what such odds were worth in the training texts."""
    return 0.5 * (_probability(z) + model.refine.ravel().take(_slots(z, gate)))


def correct(odds: list[np.ndarray], z: np.ndarray, bit: np.ndarray, block: np.ndarray, text: np.ndarray, rate: float) -> np.ndarray:
    """The mixture after online correction: each block follows the errors of the text's earlier ones.

    ``block`` gives the first bit of each block and ``text`` the block's text.
    """
    if rate == 0 or not len(z):
        return z
    error = bit - _probability(z)
    sizes = np.diff(np.append(block, len(z)))
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    turn = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
    # Steps shrink with the square root of the blocks seen.
    step = rate / np.sqrt(turn + 1.0)
    for x in odds:
        sums = np.add.reduceat(error * x, block)
        ahead = np.cumsum(sums) - sums
        ahead -= np.repeat(ahead[begin], np.diff(np.append(begin, len(text))))
        z = z + np.repeat((step * ahead).astype(z.dtype), sizes) * x
    return z


def log10_by_token(model: Model, symbols: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Log10 probability of each token given those before it in its text."""
    e = events(model.code, symbols, fresh)
    odds, gate = inputs(model, e)
    z = mixed(model, odds, gate)
    if model.rate:
        text = np.cumsum(fresh) - 1
        turn = np.arange(len(symbols)) - np.flatnonzero(fresh)[text]
        first = np.flatnonzero(turn % BLOCK_TOKENS == 0)
        z = correct(odds, z, e.bit, np.searchsorted(e.token, first), text[first], model.rate)
    p = refined(model, z, gate)
    p = np.where(e.bit == 1, p, 1 - p)
    return np.bincount(e.token, weights=np.log10(np.clip(p, 1e-6, 1 - 1e-6)), minlength=len(symbols))


def _runs(begin: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about RUN_TOKENS tokens, or one long text; ``begin`` says where texts begin."""
    at = 0
    while at < len(begin):
        end = max(at + 1, int(np.searchsorted(begin, begin[at] + RUN_TOKENS, "right")) - 1)
        stop = begin[end] if end < len(begin) else n
        yield int(begin[at]), int(stop)
        at = end


def _token_batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[int]]]:
    """Row range, word hashes of those rows, each row's first word (one more at the end), and each row's bytes."""
    column = batch.column("text")
    at = 0
    while at < len(column):
        texts, size = [], 0
        while at + len(texts) < len(column):
            text = (column[at + len(texts)].as_py() or "").encode()
            if texts and size + len(text) >= 6 * BATCH_TOKENS:
                break
            texts.append(text)
            size += len(text)
        hashes, first = word_hashes(texts, seed=3)
        yield at, at + len(texts), hashes, first, [len(t) for t in texts]
        at += len(texts)


def _with_ends(code: Code, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with an end after every text, marks of first tokens, and where texts begin."""
    n = len(first) - 1
    symbols = np.insert(code.symbols(hashes), first[1:], code.other + 1)
    begin = first[:-1] + np.arange(n)
    fresh = np.zeros(len(symbols), dtype=bool)
    fresh[begin] = True
    return symbols, fresh, begin


def _count_words() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                words, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["h", "c"])

        for batch in batches:
            for _, _, hashes, _, _ in _token_batches(batch):
                held.append(hashes)
                size += len(hashes)
            if size > 4_000_000:
                yield from emit()
                size = 0
        yield from emit()

    return run


def _tally_places(levels: list[np.ndarray], odds: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
    """Places in a tally, which counts bits by the cells' levels, the predictors' rounded log odds and the bit."""
    at = levels[0].astype(np.int32) * np.int32(LEVELS) + levels[1]
    for x in odds:
        at *= np.int32(ODDS)
        at += np.clip(np.rint(x), -8, 8).astype(np.int32) + np.int32(8)
    return at * np.int32(2) + bit


def _tally(code: Code, counts: np.ndarray, e: Events, tally: np.ndarray) -> None:
    """Add to the tally what counts of (zeros, ones) that do not hold these bits predict of them."""
    levels, odds = [], [code.node_odds.take(e.node)]
    for cells in e.cells:
        pair = counts.view("<u8").take(cells)
        ones, zeros = (pair >> U64(32)).astype(np.float32), (pair & U64(0xFFFFFFFF)).astype(np.float32)
        n = ones + zeros
        level = (n > 0).astype(np.uint8)
        for i in range(1, LEVELS - 1):
            level += n >= 1 << i
        levels.append(level)
        ones += np.float32(0.3)
        zeros += np.float32(0.3)
        ones /= zeros
        odds.append(np.log(ones, out=ones))
    np.add.at(tally, _tally_places(levels, odds, e.bit), tally.dtype.type(1))


def _packed_chunks(first: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(parts), 16):
        some = [zlib.compress(x.tobytes(), 1) for x in parts[at : at + 16]]
        chunks = pa.array(range(first + at, first + at + len(some)), pa.int64())
        yield pa.RecordBatch.from_arrays([chunks, pa.array(some, pa.binary())], ["chunk", "data"])


def _count_bits(model_code, tallied: bool = False) -> Callable:
    """Task function: the cells' counts of ones and zeros over this task's texts; if asked, then the tally as one more chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(**model_code.value)
        counts = np.zeros(TABLES << (TABLE_BITS + 1), dtype=np.uint32)
        tally = np.zeros(TALLY, dtype=np.uint32)
        for batch in batches:
            for _, _, hashes, first, _ in _token_batches(batch):
                symbols, fresh, begin = _with_ends(code, hashes, first)
                for at, end in _runs(begin, len(symbols)):
                    e = events(code, symbols[at:end], fresh[at:end])
                    if tallied:
                        _tally(code, counts, e, tally)
                    for cells in e.cells:
                        np.add.at(counts, 2 * cells + e.bit, np.uint32(1))
        yield from _packed_chunks(0, np.split(counts, TABLES * CHUNKS))
        if tallied:
            yield from _packed_chunks(TABLES * CHUNKS, [tally])

    return run


def _sum_cells() -> Callable:
    """Task function: adds up its chunks as they come in, one task's after another's; of cells it gives their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                counts = np.frombuffer(zlib.decompress(data.as_py()), np.uint32)
                if chunk not in totals:
                    totals[chunk] = np.zeros(len(counts), dtype=np.int64)
                totals[chunk] += counts
        values = [(cell_values(t[1::2], t[0::2]) if c < TABLES * CHUNKS else t).tobytes() for c, t in totals.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int64()), pa.array(values, pa.binary())], ["chunk", "data"]
        )

    return run


def fit(code: Code, cells: np.ndarray, tally: np.ndarray) -> Model:
    """Mixing weights and refinement from a tally; its size does not grow with the texts."""
    weights = np.tile(np.array([0.4, 0.4, 0.4], dtype=np.float32), (GATES, 1))
    spots = np.flatnonzero(tally)
    if not len(spots):
        usual = np.tile(_probability((np.arange(33) - 16) / 2), (GATES, 1))
        return Model(code, cells, np.tile(np.array([1, 0, 0], dtype=np.float32), (GATES, 1)), usual)
    times, bit, at = tally[spots].astype(float), spots % 2, spots // 2
    odds = [at // ODDS**i % ODDS - 8.0 for i in (2, 1, 0)]
    gate = at // ODDS**3
    n = np.maximum(np.bincount(gate, weights=times, minlength=GATES), 1)
    m, v = np.zeros((GATES, 3)), np.zeros((GATES, 3))
    w = weights.astype(float)
    for t in range(1, 81):
        error = times * (_probability(sum(w[gate, i] * x for i, x in enumerate(odds))) - bit)
        for i, x in enumerate(odds):
            g = np.bincount(gate, weights=error * x, minlength=GATES) / n + 0.0005 * (w[:, i] - weights[:, i])
            m[:, i] = 0.9 * m[:, i] + 0.1 * g
            v[:, i] = 0.99 * v[:, i] + 0.01 * g * g
            w[:, i] -= 0.05 * (m[:, i] / (1 - 0.9**t)) / (np.sqrt(v[:, i] / (1 - 0.99**t)) + 1e-8)
    slot = _slots(sum(w[gate, i] * x for i, x in enumerate(odds)), gate)
    seen = np.bincount(slot, weights=times, minlength=GATES * 33)
    ones = np.bincount(slot, weights=times * bit, minlength=GATES * 33)
    prior = np.tile(_probability((np.arange(33) - 16) / 2), GATES)
    return Model(code, cells, w.astype(np.float32), ((ones + 500 * prior) / (seen + 500)).reshape(GATES, 33))


def tune(code: Code, cells: np.ndarray, symbols: np.ndarray, fresh: np.ndarray) -> Model:
    """The model for given cells, fitted to texts that these have not counted."""
    e = events(code, symbols, fresh)
    odds, gate = inputs(Model(code, cells, np.zeros((GATES, 3)), np.zeros((GATES, 33))), e)
    places = _tally_places([gate // LEVELS, gate % LEVELS], odds, e.bit)
    return fit(code, cells, np.bincount(places, minlength=TALLY))


def _score(model_cell) -> Callable:
    """Task function: per text (kind 0) its sums over coded tokens; per other word (kind 1) a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = model_cell.value
        model = Model(**{**fields, "code": Code(**fields["code"])})
        code, task, seen = model.code, TaskContext.get().partitionId() << 40, 0
        logs = np.append(np.log10(code.counts + 1.0), [0.0, 0.0])
        names = ["kind", "row", "doc_id", "held_out", "n_tokens", "n_other", "logs", "score", "h", "tf", "n_bytes"]
        for batch in batches:
            docs, folds = batch.column("doc_id"), batch.column("held_out")
            for at, end, hashes, first, lengths in _token_batches(batch):
                symbols, fresh, begin = _with_ends(code, hashes, first)
                n = end - at
                runs = [log10_by_token(model, symbols[i:j], fresh[i:j]) for i, j in _runs(begin, len(symbols))]
                score = np.add.reduceat(np.concatenate(runs), begin)
                known = np.add.reduceat(logs[symbols], begin)
                other = np.add.reduceat((symbols == code.other).astype(np.int64), begin)
                sizes = np.diff(np.append(begin, len(symbols)))
                rows = task + seen + np.arange(n)
                seen += n
                zero = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int64)), pa.array(rows), docs.slice(at, n), folds.slice(at, n), pa.array(sizes), pa.array(other), pa.array(known), pa.array(score), zero, zero, pa.array(lengths, pa.int64())],
                    names,
                )
                rare = np.flatnonzero(np.delete(symbols, begin + sizes - 1) == code.other)
                owner = np.searchsorted(first, rare, "right") - 1
                order = np.lexsort((hashes[rare], owner))
                h, owner = hashes[rare][order], owner[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, np.int64)
                m = len(new)
                none, gap = pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(m, np.int64)), pa.array(rows[owner[new]]), none, pa.nulls(m, pa.bool_()), none, none, gap, gap, pa.array(h[new].view(np.int64)), pa.array(np.diff(np.append(new, len(h)))), none],
                    names,
                )

    return run


def held_out(key: Column) -> Column:
    """Texts that nothing is learned from: crc32 of the key as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_texts(docs: DataFrame, *, text: str = "text", key: str = "doc_id", coded_words: int = CODED_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Tokens are the words, A-Z in lower case, and an end.  ``base_score`` is the
    sum of log10((c + 1) / (N + V + 1)) over tokens, from training counts;
    ``score`` the mixture's log10 probability of the same tokens.  Null text is
    empty and has the end only; a null key counts as the empty text for the
    fold.  Repeated rows count each.  An empty table gives no rows.  Other
    columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        held_out(F.col(f"`{key}`")).alias("held_out"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    learn = rows.filter("NOT held_out").select("doc_id", "text")
    words = learn.select("text").mapInArrow(_count_words(), "h long, c long")
    words = materialize(words.groupBy("h").agg(F.sum("c").alias("c")), "lm-words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = learn.count()
    total, distinct = sums[0] + ends, sums[1] + (ends > 0)
    top = words.orderBy(F.desc("c"), "h").limit(coded_words).toPandas()
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(h)
    code = huffman(h[order], c[order], int(sums[0] - c.sum()), ends)
    others, kinds = int(sums[0] - c.sum()), sums[1] - len(h)
    shipped = spark.sparkContext.broadcast(vars(code))
    bits = learn.select("text").mapInArrow(_count_bits(shipped, tallied=True), "chunk long, data binary")
    # Chunks stream through their tasks, so memory follows the tables and not the corpus.
    dealt = bits.repartition(TABLES * CHUNKS, "chunk")
    found = dealt.mapInArrow(_sum_cells(), "chunk long, data binary").collect()
    cells = np.full(TABLES << TABLE_BITS, 128, dtype=np.uint16)
    tally = np.zeros(TALLY, dtype=np.int64)
    width = len(cells) // (TABLES * CHUNKS)
    for r in found:
        if r.chunk < TABLES * CHUNKS:
            cells[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.data, np.uint16)
        else:
            tally = np.frombuffer(r.data, np.int64)
    model = fit(code, cells, tally)
    parts = rows.mapInArrow(
        _score(spark.sparkContext.broadcast({**vars(model), "code": vars(code)})),
        "kind long, row long, doc_id long, held_out boolean, n_tokens long, n_other long, logs double, "
        "score double, h long, tf long, n_bytes long",
    )
    parts = materialize(parts, "lm-parts")
    rare = (
        parts.filter("kind = 1").select("row", "h", "tf").join(words, "h", "left")
        .groupBy("row").agg(
            F.sum(F.expr("tf * log10(coalesce(c, 0) + 1)")).alias("rare_logs"),
            F.sum(F.expr("if(c > 0, tf, 0)")).alias("rare_known"),
        )
    )
    whole, rest = f"log10({float(total + distinct + 1)!r}D)", f"log10({float(others + kinds + 1)!r}D)"
    end_log = f"log10({float(ends + 1)!r}D)"
    out = parts.filter("kind = 0").join(rare, "row", "left").selectExpr(
        "doc_id", "held_out", "n_tokens",
        f"n_tokens - n_other - {0 if ends else 1} + coalesce(rare_known, 0) AS n_known",
        f"{total}L AS train_tokens",
        f"logs + {end_log} + coalesce(rare_logs, 0) - n_tokens * {whole} AS base_score",
        f"score + coalesce(rare_logs, 0) - n_other * {rest} AS score",
        "n_bytes",
    )
    return out.selectExpr(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "if(n_bytes > 0, -score / log10(2) / n_bytes, NULL) AS bits_per_byte",
    )
