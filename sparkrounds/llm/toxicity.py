"""A toxicity classifier that group mentions do not sway.

Logistic regression over the words of a text and their beginnings.  Training
swaps the identity terms of labelled texts for those of another group and
penalises every change of the score, so that naming a group is not evidence.

The fit uses a bounded sample of labelled rows (``sample_rows``).  Features are
counted in tasks; the driver holds the ``most_features`` strongest ones and, for
each sampled row, which of them it has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrounds.llm.common import small_batches
from sparkrounds.plans.lineage import materialize

SAMPLE_ROWS = 20_000
MOST_FEATURES = 4_000
LEAST_TEXTS = 5
BEGINNINGS = (4, 5)
WORDS = re.compile(r"[^\W\d_]+")

# Terms that name groups of people; the terms of one row can replace each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "españoles"),
)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings marked with a star."""
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "*" for w in words if len(w) >= n)
    return out


def swap_terms(terms: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """Each term's replacement: the next one of its row."""
    return {t: row[(i + 1) % len(row)] for row in terms for i, t in enumerate(row)}


def _counts() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen[label].update(features(set(WORDS.findall((text or "").lower()))))
            if len(seen[0]) + len(seen[1]) > 2_000_000:
                yield from emit(seen)
                seen[0].clear(), seen[1].clear()
        yield from emit(seen)

    def emit(seen: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        for label, counts in enumerate(seen):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([label] * len(counts), pa.int64()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["feature", "label", "n"],
            )

    return run


def _design(number: dict[str, int], swaps: dict[str, str]) -> Callable:
    """Task function: the numbers of the features that a text, and its swapped twin, has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has, twin = [], []
            for text in batch.column("text").to_pylist():
                words = set(WORDS.findall((text or "").lower()))
                has.append(sorted(number[f] for f in features(words) if f in number))
                other = {swaps.get(w, w) for w in words}
                same = other == words
                twin.append(None if same else sorted(number[f] for f in features(other) if f in number))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(has, kind), pa.array(twin, kind)],
                ["label", "has", "twin"],
            )

    return run


def fit_weights(
    labels: np.ndarray,
    has: list[list[int]],
    twins: list[list[int] | None],
    n_features: int,
    *,
    penalty: float,
    sparsity: float,
    steps: int = 300,
) -> np.ndarray:
    """Weights and, last, the bias, by accelerated proximal gradient descent.

    Minimises mean log loss + penalty * mean (w . (x - swapped x))^2 over texts
    that name a group + sparsity * |w|.
    """

    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        return row, np.array([i for x in lists for i in x], dtype=np.int64)

    n = len(labels)
    row, col = flat(has)
    named = [i for i, t in enumerate(twins) if t is not None]
    row_a, col_a = flat([has[i] for i in named])
    row_b, col_b = flat([twins[i] for i in named])
    # Both classes count alike, however rare one is.
    ones = max(1, int(labels.sum()))
    importance = np.where(labels == 1, n / (2.0 * ones), n / (2.0 * max(1, n - ones)))
    w = y = np.zeros(n_features + 1)
    t, rate = 1.0, 1.0

    def loss_and_gradient(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = v[-1] + np.bincount(row, weights=v[col], minlength=n)
        loss = float((importance * (np.logaddexp(0, z) - labels * z)).mean())
        error = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        g = np.zeros_like(v)
        g[:-1] = np.bincount(col, weights=error[row], minlength=n_features)
        g[-1] = error.sum()
        if named:
            k = len(named)
            change = np.bincount(row_a, weights=v[col_a], minlength=k)
            change = change - np.bincount(row_b, weights=v[col_b], minlength=k)
            loss += penalty * float((change**2).mean())
            pull = 2 * penalty * change / k
            g[:-1] += np.bincount(col_a, weights=pull[row_a], minlength=n_features)
            g[:-1] -= np.bincount(col_b, weights=pull[row_b], minlength=n_features)
        return loss, g

    for _ in range(steps):
        at, g = loss_and_gradient(y)
        while True:
            new = y - rate * g
            new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - rate * sparsity)
            step = new - y
            if rate < 1e-6 or loss_and_gradient(new)[0] <= at + g @ step + step @ step / (2 * rate) + 1e-12:
                break
            rate /= 2
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / nxt * (new - w)
        w, t = new, nxt
    return w


def fit(
    labelled: DataFrame,
    *,
    text: str = "text",
    label: str = "toxic",
    order: str = "doc_id",
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    sample_rows: int = SAMPLE_ROWS,
    most_features: int = MOST_FEATURES,
    penalty: float = 1.0,
    sparsity: float = 2e-4,
) -> Model:
    """Fit on at most ``sample_rows`` rows of ``labelled``, those of the lowest hash of ``order``.

    Rows without a label are left out; a null text is empty.  Without rows of
    both labels the model gives every text the same score, a harmless one if there are no toxic rows.
    """
    rows = labelled.select(
        F.col(f"`{text}`").alias("text"),
        F.col(f"`{label}`").cast("long").alias("label"),
        F.xxhash64(F.lit(3), F.col(f"`{order}`")).alias("place"),
    ).filter("label IN (0, 1)")
    last = rows.select("place").orderBy("place").limit(sample_rows).agg(F.max("place")).first()[0]
    if last is None:
        return Model({}, -2.0)
    sample = rows.filter(F.col("place") <= last).select("text", "label")
    sample = materialize(sample, "toxic-sample")
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model({}, 2.0 if n1 else -2.0)
    counts = (
        sample.mapInArrow(_counts(), "feature string, label long, n long")
        .groupBy("feature")
        .agg(
            F.sum(F.expr("if(label = 1, n, 0)")).alias("a"),
            F.sum(F.expr("if(label = 0, n, 0)")).alias("b"),
        )
        .filter(f"a + b >= {LEAST_TEXTS}")
    )
    # Difference of the two shares in standard errors, with half a text added to each count.
    share = "((a + b + 1) / ({0} + {1} + 2))".format(float(n1), float(n0))
    z = f"abs((a + 0.5D) / {n1 + 1} - (b + 0.5D) / {n0 + 1}) / sqrt({share} * greatest(1 - {share}, 1e-9D) * {1 / n1 + 1 / n0!r}D)"
    best = counts.select("feature", F.expr(z).alias("z")).orderBy(F.desc("z"), "feature").limit(most_features)
    names = [r.feature for r in best.collect()]
    number = {f: i for i, f in enumerate(names)}
    design = sample.mapInArrow(
        _design(number, swap_terms(terms)), "label long, has array<int>, twin array<int>"
    ).toArrow()
    w = fit_weights(
        design.column("label").to_numpy().astype(float),
        design.column("has").to_pylist(),
        design.column("twin").to_pylist(),
        len(names),
        penalty=penalty,
        sparsity=sparsity,
    )
    return Model({f: float(x) for f, x in zip(names, w) if x}, float(w[-1]))


def _scores(model: Model) -> Callable:
    weights, bias = model.weights, model.bias
    starts = {f.rstrip("*")[: min(BEGINNINGS)] for f in weights}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = min(BEGINNINGS)
        for batch in batches:
            z = []
            for at in range(0, batch.num_rows, 1000):
                for text in batch.column("text").slice(at, 1000).to_pylist():
                    words = {w for w in WORDS.findall((text or "").lower()) if w[:cut] in starts}
                    z.append(bias + sum(weights.get(f, 0.0) for f in sorted(features(words))))
            score = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30)))
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(score)], [*(c for c in batch.schema.names if c != "text"), "score"]
            )

    return run


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` of every row and the ``score`` of its whole text (null: empty)."""
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text}`").cast("string").alias("text"))
    kept = rows.drop("text").schema
    return rows.mapInArrow(_scores(model), kept.add("score", "double"))


def held_out(key: Column) -> Column:
    """Rows that never serve for training: crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_on_documents(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Fit on the labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").alias("labelled"), F.col("toxic").alias("label")).filter(
        F.col("label").isNotNull() & ~held_out(F.col("labelled"))
    )
    sample = options.get("sample_rows", SAMPLE_ROWS)
    # Labels are few and narrow: they find their documents; equal hashes all stay in the sample.
    place = F.xxhash64(F.lit(3), F.col("labelled"))
    last = known.select(place.alias("p")).orderBy("p").limit(sample).agg(F.max("p")).first()[0]
    chosen = known.filter(place <= F.lit(last))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("labelled"))
    return fit(rows, label="label", **options)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null doc_id counts as the empty text for the fold.  Repeated rows get the
    same score; an empty table gives no rows.
    """
    model = fit_on_documents(docs, labels)
    scored = score(
        docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held_out(F.col("doc_id"))}
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is null, empty or not predicted toxic, with all their columns."""
    model = fit_on_documents(docs, labels)
    scored = score(docs, model, keep={f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    said = F.coalesce(F.col(f"c{docs.columns.index('text')}").cast("string"), F.lit(""))
    clean = scored.filter((F.col("score") < 0.5) | (said == ""))
    # Whole rows pass through Python and back.
    with small_batches(docs.sparkSession):
        clean = materialize(clean.drop("score"), "toxic-clean")
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
