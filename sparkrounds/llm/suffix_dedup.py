"""Removal of byte strings that occur elsewhere, over a logarithmic family of suffix indexes.

Suffixes are sampled where they decide: every string of ``length`` bytes has an
anchor, its gram of the lowest hash, at the same distance in every copy.  The
suffix at an anchor is indexed by fingerprints of the strings around it: of all
strings that the anchor stands for together, and of blocks of these.  A batch of
documents gives a sorted table of fingerprints with counts.  Levels of the family
are such tables; two of equal rank merge into one of the next.  A fingerprint that
all levels together count twice is a long match.

Where a match ends within what an anchor stands for, the block with the end is
resolved string by string.  A table of cells, sized by the texts within bounds,
first drops anchors whose gram occurs once; it only saves work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrounds.llm.ngram_join import CHUNKS, _table
from sparkrounds.llm.shingles import ROOT, STEP, U64, mix, powers
from sparkrounds.plans.lineage import discard, materialize

LENGTH = 400
GRAM = 40
BLOCK = 32
BATCHES = 4
# The tables have about a cell for so many bytes of text, within these bounds: some 45 cells an anchor.
BYTES_PER_CELL = 4
LEAST_CELL_BITS, MOST_CELL_BITS = 16, 27
SEGMENT = 1 << 18
BATCH_BYTES = 1 << 19
# Strings that one bucket of the last step compares, on average.
BUCKET_STRINGS = 1 << 20
_INVERSE = U64(pow(int(ROOT), -1, 1 << 64))


class Batch:
    """Rolling hashes over the bytes of several texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        data = b"".join(texts)
        self.data = data
        self.bounds = np.cumsum([0, *map(len, texts)])
        n = len(data)
        with np.errstate(over="ignore"):
            values = mix((np.arange(256, dtype=U64) + U64(1)) * STEP)[np.frombuffer(data, np.uint8)]
            values *= powers(n, ROOT)
            self.sums = np.zeros(n + 1, dtype=U64)
            np.cumsum(values, out=self.sums[1:])
            self.back = powers(n + 1, _INVERSE)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from start to end, pairwise."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def all_hashes(self, length: int) -> np.ndarray:
        """Of the strings of one length at every place."""
        m = max(0, len(self.data) - length + 1)
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[: len(self.sums) - length])[:m] * self.back[:m])

    def anchors(self, length: int, gram: int = GRAM):
        """Places that stand for the strings of ``length``: text, place, first and last start.

        A string's anchor is its gram of the lowest hash, the leftmost of equals; so
        equal strings have it at the same distance from their start.
        """
        w = length - gram + 1
        grams = self.all_hashes(gram)
        m = len(grams)
        if m < w:
            return (np.zeros(0, np.int64),) * 4
        key = (grams >> U64(30) << U64(30)) | np.arange(m, dtype=U64)
        padded = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, dtype=U64)
        padded[:m] = key
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(m - w + 1)
        low = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
        place = (low & U64((1 << 30) - 1)).astype(np.int64)
        text = np.searchsorted(self.bounds, starts, "right") - 1
        ok = starts + length <= self.bounds[text + 1]
        starts, place, text = starts[ok], place[ok], text[ok]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) 
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        return text[first], place[first], starts[first], starts[last]


class IndexFamily:
    """Sorted tables of (fp, n): of rank 0 for a batch, of rank r + 1 for two merged ones of rank r."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def _level(entries: DataFrame) -> DataFrame:
        summed = entries.groupBy("fp").agg(F.sum("n").alias("n"))
        return materialize(summed.sortWithinPartitions("fp"), "suffix-level")

    def add(self, entries: DataFrame) -> None:
        """Index a batch of (fp, n)."""
        level, rank = self._level(entries), 0
        while self.levels and self.levels[-1][0] == rank:
            _, other = self.levels.pop()
            merged = self._level(level.unionByName(other))
            discard(level, other)
            level, rank = merged, rank + 1
        self.levels.append((rank, level))

    def shared(self) -> DataFrame:
        """The fingerprints that all levels together count more than once."""
        every = self.levels[0][1]
        for _, level in self.levels[1:]:
            every = every.unionByName(level)
        if len(self.levels) > 1:
            every = every.groupBy("fp").agg(F.sum("n").alias("n"))
        return every.filter("n > 1").select("fp")


def _segments(texts: list[str | None], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Batches of byte strings, the text each belongs to and where it starts there.

    A long text is cut into overlapping segments; each string starts in one of them.
    """
    parts, owner, offset, size = [], [], [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        for at in range(0, max(1, len(data) - length + 1), SEGMENT):
            part = data[at : at + SEGMENT + length - 1]
            if size + len(part) > BATCH_BYTES and parts:
                yield parts, np.array(owner), np.array(offset)
                parts, owner, offset, size = [], [], [], 0
            parts.append(part), owner.append(i), offset.append(at)
            size += len(part)
    if parts:
        yield parts, np.array(owner), np.array(offset)


def _salted(fp: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(fp + fp.dtype.type((kind + 1) * int(STEP) % (1 << 64)))


def _gram_names(batch: Batch, place: np.ndarray) -> np.ndarray:
    """Anchors are grams of low hashes: hashed anew, they spread over all cells."""
    return _salted(batch.hashes(place, place + GRAM), 3)


def _whole(batch: Batch, place, first, last, length: int) -> np.ndarray:
    """Fingerprints of all that anchors stand for, and how."""
    with np.errstate(over="ignore"):
        shape = ((place - first) * 1000003 + (last - first)).astype(U64) * STEP
        return mix(batch.hashes(first, last + length) + shape)


def cell_bits(n_bytes: int) -> int:
    return min(MOST_CELL_BITS, max(LEAST_CELL_BITS, (n_bytes // BYTES_PER_CELL).bit_length()))


def _cell(fp: np.ndarray, width: int) -> np.ndarray:
    return (fp >> U64(64 - width)).astype(np.int64)


def _has(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    # A table of 2^width bits has 2^(width - 3) bytes.
    cell = _cell(fp, len(bits).bit_length() + 2)
    return (bits[cell >> 3] >> (7 - (cell & 7))) & 1 == 1


def _cell_rows(fps: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], kinds: int, width: int) -> Callable:
    """Task function: the cells of all fingerprints that ``fps`` finds, by kind and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, CHUNKS, dtype=np.int64) << (width - 6)
        held: list[list[np.ndarray]] = [[] for _ in range(kinds)]
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for kind, cells in enumerate(held):
                all_ = np.sort(np.concatenate([np.zeros(0, dtype=np.uint32), *cells]))
                cells.clear()
                low = all_ & np.uint32((1 << (width - 6)) - 1)
                parts = [x.tobytes() for x in np.split(low, np.searchsorted(all_, edges))]
                chunks = pa.array(range(kind * CHUNKS, (kind + 1) * CHUNKS), pa.int64())
                yield pa.RecordBatch.from_arrays([chunks, pa.array(parts, pa.binary())], ["chunk", "data"])

        for batch in batches:
            for kind, fp in fps(batch):
                held[kind].append(_cell(fp, width).astype(np.uint32))
                size += len(fp)
            if size > 4_000_000:
                yield from emit()
                size = 0
        yield from emit()

    return run


def _filled(least: tuple[int, ...], width: int) -> Callable:
    """Sums up cells: those filled so many times, 1 or 2, by kind."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        times = np.zeros(1 << (width - 6), dtype=np.uint8)
        for data in rows["data"]:
            cells, n = np.unique(np.frombuffer(data, np.uint32), return_counts=True)
            times[cells] = np.minimum(times[cells] + np.minimum(n, 2), 2)
        enough = times >= least[int(rows["chunk"].iloc[0]) // CHUNKS]
        return pd.DataFrame({"chunk": rows["chunk"][:1], "data": [np.packbits(enough).tobytes()]})

    return add


@dataclass
class Anchored:
    """The anchors of some texts whose gram may be shared; first and last are starts in ``hashed``."""

    hashed: Batch
    owner: np.ndarray
    shift: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    whole: np.ndarray

    def blocks(self, which: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Of the chosen anchors: anchor, first and last start of each block, its outer and inner fingerprint."""
        place, first, last = self.place[which], self.first[which], self.last[which]
        # Blocks of distances place - start.
        low, high = (place - last) // BLOCK, (place - first) // BLOCK
        n = high - low + 1
        row = np.repeat(np.arange(len(place)), n)
        block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - low, n)
        begin = place[row] - block * BLOCK
        s, e = np.maximum(first[row], begin - BLOCK + 1), np.minimum(last[row], begin)
        outer = _whole(self.hashed, place[row], s, e, length)
        with np.errstate(over="ignore"):
            inner = mix(self.hashed.hashes(begin, begin + length - BLOCK + 1) + block.astype(U64) * STEP)
        return which[row], s, e, outer, inner


def _anchored(batch: pa.RecordBatch, grams: np.ndarray, length: int) -> Iterator[Anchored]:
    for parts, owner, offset in _segments(batch.column("text").to_pylist(), length):
        b = Batch(parts)
        text, place, first, last = b.anchors(length)
        keep = _has(grams, _gram_names(b, place))
        text, place, first, last = text[keep], place[keep], first[keep], last[keep]
        whole = _whole(b, place, first, last, length)
        yield Anchored(b, owner[text], offset[text] - b.bounds[text], place, first, last, whole)


def _gram_fps(length: int) -> Callable:
    def fps(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for parts, _, _ in _segments(batch.column("text").to_pylist(), length):
            b = Batch(parts)
            yield 0, _gram_names(b, b.anchors(length)[1])

    return fps


def _inner_fps(grams, alone, length: int) -> Callable:
    """Inner fingerprints of all blocks (kind 0), and of anchors whose whole may be alone (kind 1)."""

    def fps(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for a in _anchored(batch, grams.value, length):
            row, _, _, _, inner = a.blocks(np.arange(len(a.whole)), length)
            yield 0, inner
            yield 1, inner[_has(alone.value, a.whole)[row]]

    return fps


def _row_fps(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    yield 0, batch.column("fp").to_numpy().view(U64)


WHOLES = "doc long, body long, s long, e long, fp long"
BLOCKS = "doc long, body long, s long, e long, outer long, inner long, whole long"


def _wholes(grams, length: int) -> Callable:
    """Task function: a row for each anchor whose gram may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, bodies = batch.column("doc"), batch.column("body")
            for a in _anchored(batch, grams.value, length):
                at = pa.array(a.owner)
                columns = [docs.take(at), bodies.take(at), *map(pa.array, (a.first + a.shift, a.last + a.shift, a.whole.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WHOLES.split(", ")])

    return run


def _blocks(grams, alone, inners, length: int) -> Callable:
    """Task function: the blocks that may match another and are not known to match whole.

    Of anchors whose whole is found elsewhere too, only blocks beside those of
    others matter; the task's first of equal blocks stands for the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            docs, bodies = batch.column("doc"), batch.column("body")
            for a in _anchored(batch, grams.value, length):
                shared, beside = inners.value
                row, s, e, outer, inner = a.blocks(np.arange(len(a.whole)), length)
                single = _has(alone.value, a.whole)[row]
                keep = single & _has(shared, inner)
                for i in np.flatnonzero(~single & _has(beside, inner)).tolist():
                    if (fp := int(outer[i])) not in met:
                        met.add(fp)
                        keep[i] = True
                if len(met) > 300_000:
                    met.clear()
                row, s, e, outer, inner = row[keep], s[keep], e[keep], outer[keep], inner[keep]
                at, shift = pa.array(a.owner[row]), a.shift[row]
                fps = (_salted(outer, 1), _salted(inner, 2), a.whole[row])
                columns = [docs.take(at), bodies.take(at), pa.array(s + shift), pa.array(e + shift), *(pa.array(x.view(np.int64)) for x in fps)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])

    return run


def _strings(length: int, buckets: int) -> Callable:
    """Task function: fingerprints of single strings, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, bodies, fps, where = [], [], [], []
            for doc, body, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc", "body", "text", "ranges"))):
                starts = np.unique(np.concatenate([np.arange(r["s"], r["e"] + 1) for r in ranges]))
                data = text.encode()
                for at in np.unique(starts // SEGMENT).tolist():
                    some = starts[starts // SEGMENT == at]
                    b = Batch([data[at * SEGMENT : (at + 1) * SEGMENT + length]])
                    fps.append(b.hashes(some - at * SEGMENT, some - at * SEGMENT + length))
                    where.append(np.stack([np.full(len(some), len(docs)), some]))
                docs.append(doc), bodies.append(body)
            if not fps:
                continue
            fp, (doc, p) = np.concatenate(fps), np.concatenate(where, axis=1)
            bucket = (fp % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for i in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                own, doc_i = np.unique(doc[i], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[i[0]])]),
                        pa.array([[docs[j] for j in own]], pa.list_(pa.int64())),
                        pa.array([[bodies[j] for j in own]], pa.list_(pa.int64())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (fp[i], doc_i.astype(np.uint32), p[i].astype(np.int64))),
                    ],
                    ["bucket", "docs", "bodies", "fp", "at", "p"],
                )

    return run


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """The starts of strings that occur more than once in the bucket, as ranges."""
    fp = np.concatenate([np.frombuffer(x, U64) for x in rows["fp"]])
    sizes = [len(d) for d in rows["docs"]]
    base = np.cumsum([0, *sizes[:-1]])
    at = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + o for x, o in zip(rows["at"], base)])
    p = np.concatenate([np.frombuffer(x, np.int64) for x in rows["p"]])
    order = np.argsort(fp, kind="stable")
    same = fp[order][1:] == fp[order][:-1]
    hit = np.zeros(len(fp), dtype=bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    docs = pd.Series([d for x in rows["docs"] for d in x], dtype="Int64")
    bodies = np.concatenate([np.asarray(x, dtype=np.int64) for x in rows["bodies"]])
    return pd.DataFrame({"doc": docs.iloc[at[hit]].to_numpy(), "body": bodies[at[hit]], "s": p[hit], "e": p[hit]}).astype({"doc": "Int64"})


def covered(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under strings that start in the ranges."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length)
        else:
            out.append([s, e + length])
    return [tuple(x) for x in out]


def _cut(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "ranges"))):
                data = (text or "").encode()
                spans = covered([(r["s"], r["e"]) for r in ranges or ()], length)
                kept, at = [], 0
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                rest = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def remove_repeats(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, batches: int = BATCHES
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row.

    Every byte goes that lies in a string of ``length`` bytes which also starts
    elsewhere, in the same or another row.  Null text is empty.  Repeated rows
    are copies of each other.  An empty table gives no rows.  Other columns are
    not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    body: Column = F.xxhash64(F.col(f"`{text}`"))
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc"), body.alias("body"), F.col(f"`{text}`").cast("string").alias("text")
    )
    send = spark.sparkContext.broadcast
    cells = "chunk long, data binary"
    texts = rows.select("text")
    width = cell_bits(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    size = (1 << width) // 8 // CHUNKS
    grams = texts.mapInArrow(_cell_rows(_gram_fps(length), 1, width), cells)
    grams = send(_table(grams, _filled((2,), width), 1, "u1", size)[0])
    wholes = materialize(rows.mapInArrow(_wholes(grams, length), WHOLES), "suffix-wholes")
    family = IndexFamily()
    for i in range(batches):
        family.add(wholes.filter(f"pmod(body, {batches}) = {i}").select("fp", F.lit(1).alias("n")))
    shared = materialize(family.shared(), "suffix-shared")
    full = materialize(wholes.join(shared, "fp").select("doc", "body", "s", "e"), "suffix-full")
    single = wholes.select("fp").join(shared, "fp", "left_anti")
    alone = single.mapInArrow(_cell_rows(_row_fps, 1, width), cells)
    alone = send(_table(alone, _filled((1,), width), 1, "u1", size)[0])
    inners = texts.mapInArrow(_cell_rows(_inner_fps(grams, alone, length), 2, width), cells)
    inners = send(_table(inners, _filled((2, 1), width), 2, "u1", size))
    found = materialize(rows.mapInArrow(_blocks(grams, alone, inners, length), BLOCKS), "suffix-found")
    # The tables have served; executors need not hold them through the rest.
    for table in (grams, alone, inners):
        table.unpersist()
    family = IndexFamily()
    for i in range(batches):
        part = found.filter(f"pmod(body, {batches}) = {i}")
        family.add(part.select(F.explode(F.array("outer", "inner")).alias("fp"), F.lit(1).alias("n")))
    twice = materialize(family.shared(), "suffix-twice")
    blocks = found.join(twice.select(F.col("fp").alias("inner")), "inner")
    blocks = blocks.join(twice.select(F.col("fp").alias("outer"), F.lit(True).alias("o")), "outer", "left")
    blocks = blocks.join(shared.select(F.col("fp").alias("whole"), F.lit(True).alias("w")), "whole", "left")
    blocks = materialize(
        blocks.select("doc", "body", "s", "e", "outer", "inner", F.expr("coalesce(o, w, false)").alias("done")),
        "suffix-blocks",
    )
    open_ = blocks.filter("NOT done")
    # What is resolved may be what an open block matches: one copy of each stands for it.
    beside = (
        blocks.filter("done")
        .join(open_.select("inner").distinct(), "inner", "left_semi")
        .groupBy("inner", "outer").agg(F.min(F.struct("doc", "body", "s", "e")).alias("r")).select("r.*")
    )
    asked = open_.select("doc", "body", "s", "e").unionByName(beside)
    asked = materialize(
        asked.groupBy(F.col("doc").alias("d"), F.col("body").alias("b")).agg(F.collect_set(F.struct("s", "e")).alias("ranges")),
        "suffix-asked",
    )
    n = asked.agg(F.sum(F.expr("aggregate(ranges, 0L, (a, r) -> a + r.e - r.s + 1)"))).first()[0] or 0
    on = F.col("doc").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b"))
    # Rows that repeat key and text are copies anyway: their anchors were found whole.
    strings = rows.join(asked, on).drop("d", "b").mapInArrow(
        _strings(length, max(1, n // BUCKET_STRINGS)),
        "bucket long, docs array<long>, bodies array<long>, fp binary, at binary, p binary",
    )
    ends = strings.groupBy("bucket").applyInPandas(_repeated, "doc long, body long, s long, e long")
    done = blocks.filter("done").select("doc", "body", "s", "e")
    ranges = (
        full.unionByName(done).unionByName(materialize(ends, "suffix-ends"))
        .groupBy(F.col("doc").alias("d"), F.col("body").alias("b"))
        .agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    )
    out = rows.join(ranges, on, "left").select("doc", "text", "ranges")
    return out.mapInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
