"""Near copies by odd sketches: banded MinHash proposes, parity bitmaps estimate, full sets decide.

Every document has ``SAMPLES`` MinHash values of its set of two-word shingles.
They go into ``BANDS`` bands, and documents that agree on a whole band are
candidates.  The samples, each with its number, are also folded into a bitmap of
``BITS`` parities.  The exclusive or of two bitmaps holds the parities of the
samples that differ, so its population count estimates how many differ, most
precisely where few do.  What lies within six standard deviations of the sought
similarity is verified on the full sets.

Two sets at the sought similarity of 0.8 miss each other with a probability of
(1 - 0.8^5)^40 = 1.3e-7 in the bands and about 1e-9 in the sketch, less the more
similar they are.

Equal sets are one class, and only one document of each goes on.  Of the members
of a band's bucket each is first compared with the bucket's first and last.
Pairs that these links leave in different components are all examined: in small
buckets as pairs, in large ones in blocks of bounded size, in which links are
sought from the most similar pair on until the block's components hang together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrounds.functions.checks import require
from sparkrounds.functions.sizing import broadcast_if_small
from sparkrounds.llm.shingles import STEP, U64, mix, shingle_sets
from sparkrounds.operators.components import stars
from sparkrounds.plans.lineage import discard, materialize, materialize_counted, materialize_measured

SIZE = 2
SIMILAR = 0.8
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
BITS = 1024
WORDS = BITS // 64
SMALL_BUCKET = 64
#: Shingles of one side of a block, on average.
BLOCK_SHINGLES = 1 << 19
BLOCK_ROWS = 512
BROADCAST_ROWS = 100_000
PAIRS = "a long, b long"


def farthest(similar: float = SIMILAR, samples: int = SAMPLES, bits: int = BITS, sigmas: float = 6.0) -> int:
    """The largest population count that sets of this similarity may show, within ``sigmas``."""
    differing = 2 * samples * (1 - similar)
    mean = bits / 2 * (1 - math.exp(-2 * differing / bits))
    slope = math.exp(-2 * differing / bits)
    sampling = 2 * math.sqrt(samples * similar * (1 - similar)) * slope
    folding = math.sqrt(bits / 4 * (1 - math.exp(-4 * differing / bits)))
    return math.ceil(mean + sigmas * math.hypot(sampling, folding))


def _odd(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=U64) + U64(seed)) * STEP) | U64(1)


def minhashes(tokens: np.ndarray) -> np.ndarray:
    """The samples of one set: the least of its tokens under each of ``SAMPLES`` multipliers."""
    out = np.full(SAMPLES, np.iinfo(U64).max, dtype=U64)
    factors = _odd(SAMPLES, 1)
    step = max(1, (1 << 17) // SAMPLES)
    with np.errstate(over="ignore"):
        for at in range(0, len(tokens), step):
            some = tokens[at : at + step]
            some = some ^ (some >> U64(29))
            np.minimum(out, (factors[:, None] * some).min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A key for each band of each row of samples; the band's number is mixed in."""
    with np.errstate(over="ignore"):
        parts = mix(samples.reshape(len(samples), BANDS, ROWS) + _odd(SAMPLES, 10_001).reshape(BANDS, ROWS))
        return mix((parts * _odd(ROWS, 20_001)).sum(axis=2, dtype=U64)).view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of each row of samples, as ``WORDS`` longs."""
    with np.errstate(over="ignore"):
        place = (mix(samples ^ _odd(SAMPLES, 30_001)) >> U64(64 - BITS.bit_length() + 1)).astype(np.int64)
    n = len(samples)
    flat = (place + np.arange(n)[:, None] * BITS).ravel()
    odd = (np.bincount(flat, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def name(tokens: np.ndarray) -> bytes:
    """128 bits that name a set: two sums of independent hashes of its tokens."""
    with np.errstate(over="ignore"):
        sums = [mix(mix(tokens ^ U64(seed)) * STEP).sum(dtype=U64) for seed in (0x51ED270B, 0xA5A5A5A55A5A5A5A)]
    return np.array(sums, dtype=U64).tobytes() + len(tokens).to_bytes(8, "little")


def _sets(texts: pa.Array, step: int = 64) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at in range(0, len(texts), step):
        yield at, shingle_sets([(t or "").encode() for t in texts.slice(at, step).to_pylist()], SIZE)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: size, name, band keys and sketch of each row's set; nulls without words."""
    for batch in batches:
        for at, sets in _sets(batch.column("text")):
            n = len(sets)
            full = [i for i in range(n) if len(sets[i])]
            samples = np.array([minhashes(sets[i]) for i in full], dtype=U64).reshape(len(full), SAMPLES)
            # Position of each row among the rows with words; null for the others.
            where = np.full(n, -1)
            where[full] = np.arange(len(full))
            where = pa.array(where, pa.int64(), mask=where < 0)
            part = batch.slice(at, n)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("body"), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([name(x) if len(x) else None for x in sets], pa.binary()),
                    _lists(band_keys(samples)).take(where), _lists(odd_sketches(samples)).take(where),
                ],
                ["doc_id", "body", "n", "name", "keys", "sketch"],
            )


PROFILE = "doc_id long, body long, n long, name binary, keys array<long>, sketch array<long>"


def close(x: str = "x", y: str = "y", limit: int | None = None) -> str:
    """SQL: two sketches may belong to similar sets."""
    count = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(WORDS))
    return f"{count} <= {farthest() if limit is None else limit}"


def similar(common: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 100 * common >= 80 * (m + n - common)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, sets in _sets(batch.column("text")):
            part = batch.slice(at, len(sets))
            yield pa.RecordBatch.from_arrays(
                [part.column("rid"), pa.array([x.tobytes() for x in sets], pa.binary())], ["rid", "tokens"]
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = (np.frombuffer(side.as_buffer(), U64) for side in (x, y))
            keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _joined(limit: int) -> Callable:
    """Group function: links that make the components of two sides of a block hang together as all its links would."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows["side"] == side] for side in (0, 1))
        found: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        if len(left) and len(right):
            one, two = (np.stack(side["sketch"].to_numpy()).view(U64) for side in (left, right))
            far = np.zeros((len(one), len(two)), dtype=np.int32)
            for i in range(WORDS):
                far += np.bitwise_count(one[:, i, None] ^ two[None, :, i])
            comps = left["comp"].to_numpy(), right["comp"].to_numpy()
            sets = [[np.frombuffer(x, U64) for x in side["tokens"]] for side in (left, right)]
            ids = left["rid"].to_numpy(), right["rid"].to_numpy()
            i, j = np.nonzero((far <= limit) & (comps[0][:, None] != comps[1][None, :]))
            for k in np.argsort(far[i, j], kind="stable").tolist():
                p, q = find(int(comps[0][i[k]])), find(int(comps[1][j[k]]))
                if p == q:
                    continue
                x, y = sets[0][i[k]], sets[1][j[k]]
                if similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    root[max(p, q)] = min(p, q)
                    found.append((int(ids[0][i[k]]), int(ids[1][j[k]])))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def _with_sets(rows: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid and tokens of the wanted classes, each from the text of its representative."""
    chosen = reps.join(wanted.select("rid").distinct(), "rid", "left_semi").select(
        "rid", F.col("doc_id").alias("d"), F.col("body").alias("b")
    )
    chosen, n = materialize_counted(chosen, "odd-wanted")
    # Both columns name a row, so rows without a key meet no more than one wanted set each.
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b"))
    texts = rows.join(broadcast_if_small(chosen, n, BROADCAST_ROWS), same).select("rid", "text")
    return materialize(texts.mapInArrow(_shingled, "rid long, tokens binary").dropDuplicates(["rid"]), "odd-sets")


def _verified(rows: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose sketches are close and whose full sets are similar."""
    pairs = materialize(
        pairs.join(reps.select(F.col("rid").alias("a"), F.col("sketch").alias("x")), "a")
        .join(reps.select(F.col("rid").alias("b"), F.col("sketch").alias("y")), "b")
        .filter(close()).select("a", "b"),
        "odd-close",
    )
    sets = _with_sets(rows, reps, pairs.select(F.explode(F.array("a", "b")).alias("rid")))
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("rid").alias("b"), F.col("tokens").alias("y")), "b"
    )
    links = materialize(both.select("a", "b", "x", "y").mapInArrow(_verify, PAIRS), "odd-links")
    discard(sets)
    return links


def _fits(m: str = "m", n: str = "n") -> str:
    return f"5 * least({m}, {n}) >= 4 * greatest({m}, {n})"


def _across_blocks(rows: DataFrame, reps: DataFrame, open_: DataFrame) -> DataFrame:
    """Links across components within large buckets: what lies outside a bucket's main component against all."""
    sets = _with_sets(rows, reps, open_)
    blocks = open_.groupBy("key").agg(
        F.expr(f"greatest(ceil(count(*) / {BLOCK_ROWS}), ceil(sum(n) / {BLOCK_SHINGLES}))").alias("ys"),
        F.expr(
            f"greatest(ceil(count_if(comp <> main) / {BLOCK_ROWS}), "
            f"ceil(sum(n) FILTER (WHERE comp <> main) / {BLOCK_SHINGLES}))"
        ).alias("xs"),
    )
    full = reps.select("rid", "sketch").join(sets, "rid")
    dealt = open_.join(blocks, "key").select("key", "rid", "comp", "main", "xs", "ys", F.xxhash64("rid").alias("h"))
    one = dealt.filter("comp <> main").select(
        "key", "rid", "comp", F.expr("pmod(h, xs)").alias("x"), F.expr("explode(sequence(0L, ys - 1))").alias("y")
    )
    two = dealt.select(
        "key", "rid", "comp", F.expr("explode(sequence(0L, xs - 1))").alias("x"), F.expr("pmod(h, ys)").alias("y")
    )
    by = ["key", "x", "y"]
    sides = one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1))).join(full, "rid")
    found = sides.groupBy(*by).applyInPandas(_joined(farthest()), PAIRS)
    return materialize(found, "odd-block-links")


def _links(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between classes that connect what all links connect."""
    bands = reps.select("rid", "n", F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("rid").alias("first"), F.max("rid").alias("last")
    ).filter("members > 1")
    buckets = materialize(buckets, "odd-buckets")
    wide, n_wide = materialize_counted(buckets.filter("members > 2"), "odd-wide")
    members = materialize(bands.join(broadcast_if_small(wide, n_wide, BROADCAST_ROWS), "key"), "odd-members")
    ends = members.select(F.inline(F.expr("array(struct(rid AS p, first AS q), struct(rid AS p, last AS q))")))
    pairs = buckets.select(F.col("first").alias("p"), F.col("last").alias("q")).unionByName(ends)
    pairs = pairs.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    tried = materialize(pairs, "odd-pairs")
    links = _verified(rows, reps, tried)

    # Buckets that these links leave in several components.
    parts, seen = materialize_measured(stars(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "odd-parts")
    centers = broadcast_if_small(parts.select(F.col("id").alias("rid"), "center"), seen["rows"], BROADCAST_ROWS)
    placed = members.join(centers, "rid", "left").select(
        "key", "rid", "n", "members", F.coalesce("center", "rid").alias("comp")
    )
    several = placed.groupBy("key").agg(F.min("comp").alias("main"), F.max("comp").alias("other")).filter("main <> other")
    several, n_open = materialize_counted(several.select("key", "main"), "odd-several")
    open_ = materialize(placed.join(broadcast_if_small(several, n_open, BROADCAST_ROWS), "key"), "odd-open")
    small = open_.filter(f"members <= {SMALL_BUCKET}")
    one = small.select("key", F.col("rid").alias("a"), F.col("n").alias("m"), F.col("comp").alias("p"))
    two = small.select("key", F.col("rid").alias("b"), "n", F.col("comp").alias("q"))
    more = one.join(two, "key").filter(f"a < b AND p <> q AND {_fits()}").select("a", "b").distinct()
    more = _verified(rows, reps, materialize(more.join(tried, ["a", "b"], "left_anti"), "odd-pairs"))
    far = _across_blocks(rows, reps, open_.filter(f"members > {SMALL_BUCKET}"))
    discard(members, open_)
    return links.unionByName(more).unionByName(far)


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Links are those of similarity 0.8 or more between sets of distinct two-word
    shingles (one word: that alone).  component_id is the smallest key that links
    reach; null keys count last.  Texts that are null, empty or without words are
    linked with nothing and keep their own key.  Repeated rows are copies of each
    other.  ``kept`` says that a row's key is its component's, also where both
    are null, so no component goes whole.  An empty table gives no rows; other
    columns are not read.
    """
    require(docs, key, text, what="documents")
    string = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(string).alias("body"), string.alias("text"))
    profile = rows.mapInArrow(_profile, PROFILE).withColumn("rid", F.monotonically_increasing_id())
    profile = materialize(profile, "odd-profile")
    classes = profile.filter("name IS NOT NULL").groupBy("name").agg(
        F.min("rid").alias("rid"), F.min("doc_id").alias("least")
    )
    classes = materialize(classes, "odd-classes")
    reps = profile.join(classes.select("rid"), "rid", "left_semi").select("rid", "doc_id", "body", "n", "keys", "sketch")
    reps = materialize(reps, "odd-representatives")
    links = _links(rows, reps)
    parts = stars(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = classes.join(parts, F.col("rid") == F.col("id"), "left").select(
        "name", "least", F.coalesce("center", "rid").alias("comp")
    )
    named = materialize(named, "odd-named")
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    keyed = materialize(named.join(smallest, "comp").select("name", "component_id"), "odd-components")
    out = profile.select("doc_id", "n", "name").join(keyed, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
