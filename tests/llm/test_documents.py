"""Operators on documents against plain Python, on small and on odd tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import compare, duck
from fixtures import CLASHING, LOWER, ODD, SF, near_texts, odd_docs, shingles, words

from sparkrounds.llm import exact_dedup, line_dedup, lm_scoring, mixing, ngram_join, packing, suffix_dedup, toxicity
from sparkrounds.llm.common import word_count
from sparkrounds.llm.queries import SQL, QUERIES, tokenizer_path
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare(spark, duck(SF), QUERIES[name], SQL[name], SF) is None


# Mixing


def test_water_fill_reshares_the_excess():
    assert mixing.water_fill([5, 2, 1], [100, 100, 100], 160) == [100, 40, 20]
    assert mixing.water_fill([5, 2, 1], [100, 30, 100], 160) == [100, 30, 30]
    assert mixing.water_fill([1], [0], 5) == [0]


def test_flow_prefers_first_copies():
    # The shared pattern must serve the source that has nothing else.
    assert mixing.min_cost_flow([10, 10], [[0], [0, 1]], [10, 10], 2) == [10, 10]
    # The pattern of both sources gives way to the one that can only serve the first.
    assert mixing.min_cost_flow([10, 10], [[0, 1], [0]], [10, 10], 1) == [10, 10]
    assert sum(mixing.min_cost_flow([10, 10], [[0], [0, 1]], [15, 10], 2)) == 25
    assert mixing.min_cost_flow([4], [[0]], [100], 2) == [8]
    assert mixing.min_cost_flow([5], [[]], [], 2) == [0]


def test_mix_hits_targets_whatever_the_cells(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    args = {"membership": F.array("source"), "size": word_count(F.col("text"))}
    plain, sources = mixing.mix_to_weights(docs, **args)
    took = {r.source: r.t for r in plain.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    for s in sources:
        assert took[s.name] <= round(s.target) <= 2 * s.size and took[s.name] >= 0.8 * s.target
    assert {r.copies for r in plain.select("copies").distinct().collect()} <= {0, 1, 2}
    monkeypatch.setattr(mixing, "CELL_ROWS", 3)
    monkeypatch.setattr(mixing, "CELL_BITS", 4)
    again, _ = mixing.mix_to_weights(docs, **args)
    took = {r.source: r.t for r in again.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(took[s.name] - s.target) <= 0.25 * s.target for s in sources)


def test_mix_to_the_word(spark):
    """With words of one more document every source gives its target, and no document more than twice itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    args = {"membership": F.array("source"), "size": word_count(F.col("text")), "split_last": True}
    out, sources = mixing.mix_to_weights(docs, **args)
    rows = out.select("doc_id", "source", "size", "copies", "part", "taken").collect()
    for s in sources:
        assert sum(r.taken for r in rows if r.source == s.name) == round(s.target)
    assert all(r.taken == r.copies * r["size"] + r.part and 0 <= r.taken <= 2 * r["size"] for r in rows)
    again = mixing.mix_to_weights(docs.repartition(5), **args)[0].select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}


def test_fit_is_the_best_subset():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(0, 60, rng.integers(1, 11)).tolist()
        gap = int(rng.integers(0, max(1, sum(sizes))))
        taken, missing = mixing.fit(sizes, gap)
        sums = {sum(s for i, s in enumerate(sizes) if pick >> i & 1) for pick in range(1 << len(sizes))}
        assert len(taken) == len(set(taken)) and sum(sizes[i] for i in taken) + missing == gap
        assert gap - missing == max(x for x in sums if x <= gap)
        # A long line takes all but the last from its front.
        line = sizes * 300
        taken, missing = mixing.fit(line, gap * 200, choices=8)
        assert sum(line[i] for i in taken) + missing == gap * 200 and missing >= 0


def test_mix_rows_without_keys_are_told_apart(spark, monkeypatch):
    """Rows that share a key or have none are divided by the histogram as others are."""
    monkeypatch.setattr(mixing, "CELL_ROWS", 8)
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("x y").alias("text"))
    docs = docs.unionByName(spark.range(9).select("id", F.lit("b"), F.lit("z " * 50)).toDF("doc_id", "source", "text"))
    size = word_count(F.col("text"))
    whole = mixing._fit_line

    def bounded(rows):
        assert len(rows) <= 64
        return whole(rows)

    monkeypatch.setattr(mixing, "_fit_line", bounded)
    out, sources = mixing.mix_to_weights(docs, membership=F.array("source"), size=size, weight_of=lambda i: (1.0, 9.0)[i])
    took = {r.source: r.t for r in out.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(took[s.name] - s.target) <= 50 for s in sources)


def test_mix_overlapping_and_odd(spark):
    docs = odd_docs(spark)
    both = F.when(F.col("doc_id") == 10, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))
    out, sources = mixing.mix_to_weights(docs, membership=both, size=word_count(F.col("text")))
    assert [s.name for s in sources] == ["a", "b", "c", None]
    rows = out.collect()
    assert len(rows) == len(ODD) and set(CLASHING) <= set(out.columns)
    assert all(r.taken == r.copies * r["size"] and r.copies <= 2 for r in rows)
    empty, sources = mixing.mix_to_weights(docs.limit(0), membership=both, size=word_count(F.col("text")))
    assert empty.count() == 0 and sources == []


# Exact deduplication


def _parquet(df, tmp_path, name="docs"):
    df.write.parquet(f"{tmp_path}/{name}")
    return f"{tmp_path}/{name}"


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_odd(spark, tmp_path, weak):
    path = _parquet(odd_docs(spark).repartition(3), tmp_path)
    # A digest of few values makes different texts meet; their bytes tell them apart.
    digest = (lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)).substr(1, 1)) if not weak else (lambda t: F.lit(b"x"))
    args = {"digest": digest} if weak else {}
    out = exact_dedup.exact_dedup(spark, path, files_per_batch=1, **args).collect()
    groups: dict[str, list] = {}
    for doc, text, _ in ODD:
        groups.setdefault((text or "").translate(LOWER), []).append(doc)
    keep = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    want = Counter(
        (doc, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        for t, docs in groups.items() for doc in docs
    )
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)


def test_exact_dedup_state_goes_on(spark, tmp_path):
    path, state = _parquet(odd_docs(spark), tmp_path), f"{tmp_path}/state"
    first = exact_dedup.fill_state(spark, path, state)
    assert first.agg(F.sum("n")).first()[0] == len(ODD)
    odd_docs(spark, ODD[:3]).write.mode("append").parquet(path)
    assert exact_dedup.fill_state(spark, path, state).agg(F.sum("n")).first()[0] == len(ODD) + 3


def test_exact_dedup_empty(spark, tmp_path):
    assert exact_dedup.exact_dedup(spark, _parquet(odd_docs(spark, ODD[:1]).limit(0), tmp_path)).count() == 0


# Toxicity


def _labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_swapping_takes_weight_off_group_names(spark):
    rows = []
    for i in range(400):
        # Toxic texts name one group more often than harmless ones do.
        group = "muslims" if i % 2 and i % 8 else "christians"
        bad = ["awful", "vile", "nasty"][i % 3] if i % 2 and i % 5 else ""
        rows.append((i, f"those {group} are {bad} people number {i % 17}", i % 2))
    data = _labelled(spark, rows)
    plain = toxicity.fit(data, penalty=0.0).weights
    fair = toxicity.fit(data, penalty=50.0).weights
    gap = lambda w: abs(w.get("muslims", 0.0) - w.get("christians", 0.0))
    assert gap(plain) > 0.2 and gap(fair) < 0.1 * gap(plain)
    model = toxicity.fit(data, penalty=50.0)
    out = toxicity.score(data, model, keep={"doc_id": F.col("doc_id")}).collect()
    clear = [r for r in out if r.doc_id % 2 and r.doc_id % 5]
    assert all(r.score >= 0.5 for r in clear)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.score_documents(docs, labels).filter("held_out").join(labels, "doc_id")
    r = out.agg(
        F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"),
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("found"),
    ).first()
    assert r.right > 0.98 and r.found > 0.9


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(odd_docs(spark), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    clean = toxicity.drop_toxic(odd_docs(spark), labels)
    assert clean.columns == odd_docs(spark).columns
    assert toxicity.score_documents(odd_docs(spark), labels.limit(0)).count() == len(ODD)
    assert toxicity.score_documents(odd_docs(spark).limit(0), labels).count() == 0


def test_drop_toxic_without_usable_labels(spark):
    docs, kind = odd_docs(spark), "doc_id long, toxic int"
    held = next(i for i in range(1, 13) if zlib.crc32(str(i).encode()) % 5 == 0)
    for rows in ([], [(1, None), (5, None)], [(None, 1)], [(held, 1)], [(99, 1), (98, 0)]):
        labels = spark.createDataFrame(rows, kind)
        assert toxicity.drop_toxic(docs, labels).count() == len(ODD), rows
    assert toxicity.score_documents(docs, labels).filter("predicted = 1").count() == 0
    # Where every text counts as toxic, null and empty ones stay.
    only = next(i for i in (1, 5, 7, 8) if zlib.crc32(str(i).encode()) % 5)
    left = toxicity.drop_toxic(docs, spark.createDataFrame([(only, 1)], kind)).collect()
    assert {r.doc_id for r in left} == {2, 3}


# Line deduplication


def _within_one(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def lines_left(docs):
    first: dict[str, tuple] = {}
    for d, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, (d, p))
    far = [x for x in first if len(x) >= 20]
    near = {x for x in far if any(first[y] < first[x] and _within_one(x, y) for y in far if y != x)}
    return {
        d: None if t is None else "\n".join(
            x for p, x in enumerate(t.split("\n")) if not x.strip() or (x not in near and first[x] == (d, p))
        )
        for d, t in docs
    }


def test_lines_within_one_edit(spark):
    import random

    rng = random.Random(5)
    base = ["the quick brown fox jumps over the lazy dog " * k + "end" for k in (1, 2, 3, 7)]
    base += ["a" * 24, "é" * 20 + "üü", "x" * 64 + "y" * 64, "z" * 63, "z" * 64, "z" * 65]
    lines = list(base)
    for b in base * 8:
        i, kind = rng.randrange(len(b)), rng.choice("sdi2")
        c = b[:i] + rng.choice("qwé" if kind in "s2" else "qé" if kind == "i" else [""]) + b[i + (kind != "i") :]
        if kind == "2":
            k = rng.randrange(len(c))
            c = c[:k] + c[k + 1 :]
        lines.append(c)
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4 + 1)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == lines_left(docs)


@pytest.mark.parametrize("longer_first", [False, True])
def test_lines_that_fill_their_blocks(spark, longer_first):
    import random

    rng = random.Random(7)
    docs = []
    for n in (63, 64, 65, 127, 128, 129, 192):
        line = "".join(rng.choice("abcdefgh ") for _ in range(n - 1)) + "k"
        pair = [line, line + "."]
        docs.append((n, "\n".join(pair[::-1] if longer_first else pair)))
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == lines_left(docs)
    assert all(r.n_near == 1 for r in out)


def test_lines_odd(spark):
    out = line_dedup.dedup_lines(odd_docs(spark))
    assert set(CLASHING) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].text is None and by[2].n_lines == 0 and by[3].text == "" and by[4].text == " \t\n "
    assert by[12].text == SENTENCE_LINES and by[12].n_near == 1 and by[12].n_exact == 1
    assert by[10].text == "short" and by[11].text == ""
    assert [r.text for r in rows if r.doc_id == 1] == [ODD[0][1]] * 2
    assert line_dedup.dedup_lines(odd_docs(spark).limit(0)).count() == 0


SENTENCE_LINES = ODD[-1][1].split("\n")[0] + "\n"


# Language-model scoring


def test_lm_counts_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tokens = {i: [*words(t), None] for i, t in rows}
    counts: Counter = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    # Few coded words: most go through the table of other words.
    for coded in (1 << 16, 200):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        out = lm_scoring.score_texts(docs, coded_words=coded).collect()
        assert len(out) == len(rows)
        for r in out:
            t = tokens[r.doc_id]
            base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in t)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
            assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
        held = [r for r in out if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_predictions_sum_to_one():
    code = lm_scoring.huffman(np.arange(5, dtype=np.uint64), np.array([9, 5, 3, 1, 1]), 4, 2)
    cells = lm_scoring.cell_values(*np.random.default_rng(0).integers(0, 9, (2, lm_scoring.TABLES << lm_scoring.TABLE_BITS)))
    seq = np.array([0, 2, 1, 5, 6, 3, 3, 0, 6])
    fresh = np.isin(np.arange(9), [0, 5])
    model = lm_scoring.tune(code, cells, seq, fresh)
    total = 0.0
    for symbol in range(7):
        total += 10 ** lm_scoring.log10_by_token(model, np.array([0, 2, symbol]), np.array([True, False, False]))[2]
    assert abs(total - 1) < 1e-4


def test_lm_cells_add_up_whole_counts():
    from types import SimpleNamespace

    import pyarrow as pa

    from sparkrounds.llm.shingles import word_hashes

    # One task has seen a context far more often than the other, which tells another story.
    texts = ["a b " * 100_000, "a c " * 30_000]
    hashes = [word_hashes([t.encode()], seed=3) for t in texts]
    words, n = np.unique(np.concatenate([h for h, _ in hashes]), return_counts=True)
    code = lm_scoring.huffman(words, n, 0, 2)
    count = lm_scoring._count_bits(SimpleNamespace(value=vars(code)))
    parts = [x for t in texts for x in count(iter([pa.RecordBatch.from_pydict({"text": [t]})]))]
    (found,) = lm_scoring._sum_cells()(iter(parts))
    got = {c: np.frombuffer(d, np.uint16) for c, d in zip(*(found.column(i).to_pylist() for i in (0, 1)))}
    want = np.zeros(lm_scoring.TABLES << (lm_scoring.TABLE_BITS + 1), dtype=np.int64)
    for h, first in hashes:
        symbols, fresh, _ = lm_scoring._with_ends(code, h, first)
        e = lm_scoring.events(code, symbols, fresh)
        for cells in e.cells:
            np.add.at(want, 2 * cells + e.bit, 1)
    assert want.max() > 65_535
    assert (np.concatenate([got[i] for i in sorted(got)]) == lm_scoring.cell_values(want[1::2], want[0::2])).all()


def test_ngram_groups_of_the_same_sets_are_compared_once(spark, monkeypatch):
    texts = [" ".join(f"w{j}" for j in range(40)) + (f" x{i}" if i else "") for i in range(6)] + ["a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(*ngram_join.row_name(docs), "text")
    sigs = [ngram_join.signature(x) for x in ngram_join.shingle_sets([t.encode() for t in texts])]
    body = {r.doc_id: r.body for r in rows.collect()}
    reps = spark.createDataFrame(
        [(s, (i, body[i]), 40) for i, s in enumerate(sigs)], "sig long, rep struct<doc_id: long, body: long>, size long"
    )
    # Tokens 1 to 9 of both orders have the first six sets; token 10 has one more, and token 11 lacks one.
    groups = [(o, t, sigs[:6]) for o in (0, 1) for t in range(1, 10)] + [(0, 10, sigs), (1, 11, sigs[:5])]
    left = spark.createDataFrame(
        [(o, t, s, 37, 200, s, min(x)) for o, t, x in groups for s in x],
        "ord long, token long, sig long, n long, members long, comp long, main long",
    )
    rows_of, keep = [], ngram_join.materialize

    def counted(df, tag, **options):
        out = keep(df, tag, **options)
        if tag == "ngram-block-rows":
            rows_of.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    links = {(r.a, r.b) for r in ngram_join._across_blocks(rows, reps, left).collect()}
    assert rows_of == [5 + 6 + 4, 6 + 7 + 5]
    root = {s: s for s in sigs}
    for _ in sigs:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert [root[s] == root[sigs[0]] for s in sigs] == [True] * 6 + [False]


def test_ngram_pairs_of_unlike_sizes_are_not_gone_through(spark, monkeypatch):
    """A token of two sets whose sizes cannot be similar is dropped where it is found; near copies stay linked."""
    long = [f"w{j}" for j in range(80)]
    texts = [" ".join(long), " ".join(long[70:78]), " ".join(long[:78]), "a b c d e f g h", "a b c d e f g h i"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, keep = {}, ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag, **o: met.setdefault(tag, keep(df, tag, **o)) if tag == "ngram-members" else keep(df, tag, **o))
    pair = ngram_join.jaccard_components(docs.filter("doc_id < 2"))
    assert {(r.doc_id, r.component_id) for r in pair.collect()} == {(0, 0), (1, 1)}
    assert met.pop("ngram-members").isEmpty()
    found = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3}
    assert not met["ngram-members"].isEmpty()


def test_ngram_copies_are_looked_at_once(spark, monkeypatch):
    """One row of a set gives its tokens, whatever task its copies are in; those without a key or with the same one too."""
    text, near, other = (" ".join(f"{x}{j}" for j in range(60)) for x in "wvu")
    rows = [(4, text), (1, text), (None, text), (1, text + "\n"), (2, near), (7, near + " end"), (3, other), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id", "text")
    assert docs.select(F.spark_partition_id()).distinct().count() > 4
    tokens, keep = [], ngram_join.materialize

    def counted(df, tag, **options):
        out = keep(df, tag, **options)
        if tag == "ngram-prefixes":
            tokens.append({(r.sig, r.n): r["count"] for r in out.groupBy("sig", "n").count().collect()})
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    found = ngram_join.jaccard_components(docs).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(4, 56, 1), (1, 56, 1), (None, 56, 1), (1, 56, 1), (2, 56, 2), (7, 57, 2), (3, 56, 3), (None, 0, None)], key=str
    )
    # Only the two near copies share tokens with another set.
    assert len(tokens) == 1 and sorted(n for _, n in tokens[0]) == [56, 57]


def test_lm_fits_to_every_training_text(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, 400) % 50) for _ in range(700)]
    fitted, fit = [], lm_scoring.fit
    monkeypatch.setattr(lm_scoring, "fit", lambda *a: fitted.append(a) or fit(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lm_scoring.score_texts(docs).count() == len(texts)
    (code, cells, tally), = fitted
    learn = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    hashes, first = lm_scoring.word_hashes(learn, seed=3)
    symbols, fresh, _ = lm_scoring._with_ends(code, hashes, first)
    e = lm_scoring.events(code, symbols, fresh)
    # More than 200,000 tokens: all their bits are tallied once, and all are counted in the cells.
    assert len(symbols) > 200_000 and tally.sum() == len(e.bit)
    counts = np.zeros(lm_scoring.TABLES << (lm_scoring.TABLE_BITS + 1), dtype=np.int64)
    for at in e.cells:
        np.add.at(counts, 2 * at + e.bit, 1)
    assert (cells == lm_scoring.cell_values(counts[1::2], counts[0::2])).all()
    # What is tallied was not counted yet: the first bits of a task meet empty cells.
    assert tally.reshape(lm_scoring.GATES, -1)[0].sum() > 0


def test_lm_odd(spark):
    out = {r.doc_id: r for r in lm_scoring.score_texts(odd_docs(spark)).collect()}
    assert len(out) == len({d for d, *_ in ODD}) and out[2].n_tokens == out[3].n_tokens == out[4].n_tokens == 1
    assert lm_scoring.score_texts(odd_docs(spark).limit(0)).count() == 0
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in out.values())


# Repeated byte strings


def repeats_left(texts: list[str | None], length: int) -> list[bytes]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        keep = np.ones(len(d), dtype=bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                keep[p : p + length] = False
        out.append(bytes(np.frombuffer(d, np.uint8)[keep]))
    return out


@pytest.mark.parametrize("segment", [1 << 20, 1000])
def test_repeats(spark, monkeypatch, segment):
    import random

    rng = random.Random(segment)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    base, passage = [make(2500) for _ in range(3)], make(700)
    texts = [make(900) + passage[rng.randrange(200) : rng.randrange(450, 700)] + make(300) for _ in range(12)]
    for i in range(24):
        t = list(base[i % 3])
        for _ in range(i % 5):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [None, "", "ab" * 900, make(399), make(400), base[0][:401], base[0][-400:], base[1] + base[1]]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, want in enumerate(repeats_left(texts, 400)):
        assert bytes(out[i].kept) == want and out[i].kept_sha256 == hashlib.sha256(want).hexdigest(), i
        assert out[i].n_removed == out[i].n_bytes - len(want)


def test_repeats_odd(spark):
    out = suffix_dedup.remove_repeats(odd_docs(spark)).collect()
    want = repeats_left([t for _, t, _ in ODD[:8]], 400)
    assert len(out) == len(ODD)
    got = {r.doc_id: bytes(r.kept) for r in out}
    assert got[5] == want[6] and got[6] == want[7] and got[1] == want[0]
    assert suffix_dedup.remove_repeats(odd_docs(spark).limit(0)).count() == 0


# Packing


def test_suffix_tables_grow_with_the_texts(spark, monkeypatch):
    """Few texts have small tables, and a file of a table has few chunks, so little of it comes to the driver at once."""
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1000, n))
    shared = word(120)
    texts = [f"{word(60)} {shared} {word(60)}" if i < 6 else word(200) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables, keep = [], suffix_dedup._table
    monkeypatch.setattr(suffix_dedup, "_table", lambda *a: tables.append(keep(*a)) or tables[-1])
    stored, write = [], ngram_join.materialize

    def counted(df, tag, **options):
        out = write(df, tag, **options)
        stored.append(max(r["count"] for r in out.groupBy(F.input_file_name()).count().collect()))
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [out[i].n_removed > 300 for i in range(12)] == [i < 6 for i in range(12)]
    assert [len(t) for t in tables] == [1, 1, 2] and sum(x.nbytes for t in tables for x in t) < 1 << 18
    assert max(stored) <= 8
    assert [suffix_dedup.cell_bits(n) for n in (0, 10**7, 10**12)] == [16, 22, 27]


def check_packing(pieces, docs, window=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    short = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        short += at < window
    assert short <= 1


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    pieces = packing.pack(docs, tokenizer=tokenizer_path()).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in docs.collect()])


def test_texts_pass_to_python_in_small_batches(spark, monkeypatch):
    """Encoding and shingling take at most 1,000 rows at once, whatever the session's own bound, which stays."""
    bound, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", set()
    before = spark.conf.get(bound)
    assert int(before) > 1000
    for module in (packing, ngram_join):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, tag, keep=keep, **o: seen.add((tag, spark.conf.get(bound))) or keep(df, tag, **o))
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.format_string("a b c %d d e", "id").alias("text"))
    assert packing.pack(docs, tokenizer=tokenizer_path()).count() >= 2500
    assert ngram_join.jaccard_components(docs).count() == 2500
    assert {("pack-ids", "1000"), ("ngram-profile", "1000"), ("ngram-prefixes", "1000")} <= seen
    assert spark.conf.get(bound) == before


def test_rows_with_texts_or_ids_pass_to_python_in_small_batches(spark, monkeypatch):
    """Placing pieces and judging whole rows take at most 1,000 rows at once too."""
    bound, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", set()
    for module in (packing, toxicity):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, tag, keep=keep, **o: seen.add((tag, spark.conf.get(bound))) or keep(df, tag, **o))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.format_string("a b c %d d e", "id").alias("text"))
    labels = docs.select("doc_id", F.expr("int(doc_id % 2)").alias("toxic"))
    assert packing.pack(docs, tokenizer=tokenizer_path()).count() >= 300
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert {("pack-pieces", "1000"), ("toxic-clean", "1000")} <= seen


def test_packing_odd(spark):
    once = [r for i, r in enumerate(ODD) if i != 1]
    check_packing(packing.pack(odd_docs(spark, once), tokenizer=tokenizer_path()).collect(), [r[:2] for r in once])
    assert packing.pack(odd_docs(spark).limit(0), tokenizer=tokenizer_path()).count() == 0


def test_least_squares_uses_exact_fits():
    counts = np.zeros(2048, dtype=np.int64)
    counts[[700, 648]] = 200, 100
    counts[[1000, 1048]] = 50
    plan = packing.make_plan(counts, 2048)
    assert plan.used[[700, 648, 1000, 1048]].tolist() == [200, 100, 50, 50] and plan.stream == 150


# N-gram join


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("small", [128, 2])
def test_ngram_components(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    docs = near_texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert out == brute_components(docs)


def test_ngram_odd(spark):
    out = ngram_join.jaccard_components(odd_docs(spark)).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert by[6] == (by[5][0], 5) and by[11] == (1, 10) and by[2] == (0, 2) and by[4] == (0, 4)
    assert ngram_join.jaccard_components(odd_docs(spark).limit(0)).count() == 0


def test_ngram_cells_travel_as_distances():
    draw = np.random.default_rng(3)
    for most, size in ((1 << 22, 20_000), (1 << 22, 5), (3, 50), (1, 0)):
        cells = np.sort(draw.integers(0, most, size)).astype(np.uint32)
        data = ngram_join.packed_cells(cells)
        assert np.array_equal(ngram_join.unpacked_cells(data), cells)
        assert size < 20_000 or len(data) == 1 + 2 * size


@pytest.mark.parametrize("times", [1, 2])
def test_ngram_small_groups_are_not_stored_and_sets_are_dealt_out_only_if_repeated(spark, monkeypatch, times):
    """Words 0 to 59 with one more each are near copies of the first; repeated rows bring a set twice."""
    texts = [" ".join(f"w{j}" for j in range(60)) + (f" x{i}" if i else "") for i in range(4)] + ["another text of its own, you see"]
    docs = spark.createDataFrame(list(enumerate(texts)) * times, "doc_id long, text string")
    stored, keep = {}, ngram_join.materialize

    def watched(df, tag, **options):
        out = keep(df, tag, **options)
        stored.setdefault(tag, []).append(out.count())
        return out

    def watched_counted(df, tag):
        out = watched(df, tag)
        return out, out.count()

    monkeypatch.setattr(ngram_join, "materialize", watched)
    monkeypatch.setattr(ngram_join, "materialize_counted", watched_counted)
    found = sorted(tuple(r) for r in ngram_join.jaccard_components(docs).select("doc_id", "component_id").collect())
    assert found == sorted([(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)] * times)
    assert stored["ngram-left"] == [0] and "ngram-fetched" not in stored
    full = [n for n in stored["ngram-sets"] if n]
    assert full == ([4] if times == 1 else [8, 4])
