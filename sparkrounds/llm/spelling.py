"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols.  Every word probes with the whole one-edit
neighbourhood of its reduced form; the vocabulary answers by its reduced forms;
the pairs that meet are verified on the original strings.

Two words one edit apart have reduced forms at most one edit apart, whatever the
number of symbols, so nothing is lost.  That number is chosen for every length
from the vocabulary: the smallest with as many reduced forms as there are words
of that length.  A word thus reduces once for each length it probes: its own,
one less and one more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrounds.functions.checks import require
from sparkrounds.functions.sizing import broadcast_if_small
from sparkrounds.llm.shingles import ROOT, STEP, U64, mix, powers
from sparkrounds.plans.lineage import materialize, materialize_counted

MIN_LENGTH = 5
MIN_COUNT = 3
TYPO_RATE = 97
#: Lengths beyond this take two symbols: 2^64 forms are more than any vocabulary has.
LONGEST_COUNTED = 64
BROADCAST_WORDS = 200_000
# Letters as UTF-8 bytes, A-Z in lower case: U+00C0 to U+00FF begin with C3.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
PIECE = 1 << 20
HELD_WORDS = 200_000


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between letters, so no run is cut."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        inside = RUN.match(data, end - 1) or RUN.match(data, end)
        end = inside.end() if inside else end
        yield data[at:end]
        at = end
    yield data[at:]


def _count_words(key: str, text: str) -> Callable:
    """Task function: words and their counts, added up within the task."""

    def misspelt(run: bytes, h: int) -> bytes:
        letters = run.decode()
        i = h % len(letters)
        return (letters[:i] + letters[i + 1 :]).encode()

    def rows(total: Counter) -> pa.RecordBatch:
        words, counts = list(total.keys()), list(total.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for k, t in zip(batch.column(key), batch.column(text)):
                t = t.as_py()
                if not t:
                    continue
                k = k.as_py()
                start = zlib.crc32(f"{'' if k is None else k}:".encode())
                for piece in _pieces(t.encode().lower()):
                    found = Counter(RUN.findall(piece))
                    for word in found:
                        h = zlib.crc32(word, start)
                        if h % TYPO_RATE == 0:
                            total[misspelt(word, h)] += found[word]
                            found[word] = 0
                    total.update(found)
                if len(total) > HELD_WORDS:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    return run


def word_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of the words of at least five letters that occur at least three times."""
    require(docs, key, text, what="documents")
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    counts = rows.mapInArrow(_count_words("k", "t"), "word string, n long").filter(
        (F.length("word") >= MIN_LENGTH) & (F.col("n") > 0)
    )
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(f"n >= {MIN_COUNT}")


def symbols_for(words: int, length: int) -> int:
    """The smallest alphabet, of two symbols at least, with as many forms of this length as words."""
    s = 2
    while s**length < words:
        s += 1
    return s


def alphabet(s: int) -> np.ndarray:
    """The symbol, 1 to s, of every code point up to 255."""
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=U64) + U64(1)) * STEP) % U64(s) + U64(1)


def _symbols(counts: dict[int, int], length: int) -> int:
    """The alphabet for one length; 0 if no word has it."""
    return symbols_for(counts[length], length) if length in counts else 0 if length <= LONGEST_COUNTED else 2


def _key(forms: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(forms + U64(length) * STEP).view(np.int64)


def neighbourhood(codes: np.ndarray, length: int, s: int) -> np.ndarray:
    """Per row of codes (words of one length), the keys of all reduced forms of ``length`` within one edit.

    A form's key is a polynomial of its symbols, so each edit takes one addition.
    Two forms with one key only make a candidate more.
    """
    k, n = codes.shape
    with np.errstate(over="ignore"):
        power = powers(n + 2, ROOT)
        back = U64(pow(int(ROOT), -1, 1 << 64))
        terms = alphabet(s)[codes] * power[:n]
        before = np.concatenate([np.zeros((k, 1), U64), np.cumsum(terms, axis=1, dtype=U64)], axis=1)
        whole, each = before[:, -1:], np.arange(1, s + 1, dtype=U64)
        if length == n:
            out = (whole - terms)[:, :, None] + power[:n, None] * each
        elif length == n - 1:
            out = before[:, :-1] + (whole - before[:, 1:]) * back
        else:
            out = (before + (whole - before) * ROOT)[:, :, None] + power[: n + 1, None] * each
    return _key(out.reshape(k, -1), length)


def _by_length(words: pa.Array, room: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and codes of words of equal length, so many at once as fit."""
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.array([len(w) for w in coded])
    for n in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == n)
        step = max(1, room // (8 * (n + 1)))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            joined = b"".join(coded[i] for i in some.tolist())
            yield n, some, np.frombuffer(joined, np.uint8).reshape(len(some), n)


def _probes(counts: dict[int, int]) -> Callable:
    """Task function: key and word for every reduced form within one edit, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            for n, places, codes in _by_length(words):
                for length in (n - 1, n, n + 1):
                    s = _symbols(counts, length)
                    if not s or length < MIN_LENGTH:
                        continue
                    keys = np.sort(neighbourhood(codes, length, s), axis=1)
                    fresh = np.ones(keys.shape, bool)
                    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    at = np.repeat(places, fresh.sum(axis=1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[fresh]), words.take(pa.array(at))], ["key", "word"]
                    )

    return run


def _forms(counts: dict[int, int]) -> Callable:
    """Task function: key of every word's own reduced form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            for n, places, codes in _by_length(batch.column("word")):
                with np.errstate(over="ignore"):
                    form = (alphabet(_symbols(counts, n))[codes] * powers(n, ROOT)).sum(axis=1, dtype=U64)
                keys[places] = _key(form, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column("word"), batch.column("n")], ["key", "near", "near_n"]
            )

    return run


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, near and near_n for all pairs of words one code point apart, in both directions.

    ``vocabulary`` (word, n) has distinct words of letters up to U+00FF.
    """
    size = F.length("word")
    lengths = vocabulary.filter(size <= LONGEST_COUNTED).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words"))
    counts = {r["size"]: r["words"] for r in lengths.collect()}  # 64 rows at most
    probes = vocabulary.select("word").mapInArrow(_probes(counts), "key long, word string")
    forms = vocabulary.select("word", "n").mapInArrow(_forms(counts), "key long, near string, near_n long")
    met = probes.join(forms.hint("shuffle_hash"), "key")
    return met.filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def roots(links: DataFrame) -> DataFrame:
    """word and root for ``links`` (word, form): the last word that following forms leads to.

    Pointers double each round; a form occurs twice as often as its word, so
    chains end and their length is at most the logarithm of the largest count.
    """
    now, n = materialize_counted(links.select("word", F.col("form").alias("root")), "spelling-links")
    while n:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(broadcast_if_small(ahead, n, BROADCAST_WORDS), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        now = materialize(moved, "spelling-links")
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary.

    Words are runs of letters (A-Z, U+00C0 to U+00FF), A-Z in lower case; a run
    whose CRC-32 after ``<key>:`` is divisible by 97 loses one code point (a
    null key counts as empty).  Null texts have no words, repeated rows count
    again, other columns are not read, an empty table gives no rows.  A word's
    form is its near word of largest n (ties: the smaller), if that is at least
    twice the word's own, else null; root is the last of the chain of forms.
    """
    vocabulary = materialize(word_counts(docs, key=key, text=text), "spelling-words")
    best = near_words(vocabulary).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    strong = -F.col("best.less") >= 2 * F.col("n")
    judged = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    judged = materialize(judged, "spelling-judged")
    last = roots(judged.filter("form IS NOT NULL"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
