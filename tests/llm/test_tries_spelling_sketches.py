"""Conversation tries, spelling variants and odd sketches against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import CLASHING, LOWER, ODD, odd_docs, near_texts, words
from pyspark.sql import functions as F

from sparkrounds.llm import conversation_trie as trie
from sparkrounds.llm import odd_sketch, spelling
from sparkrounds.llm.shingles import U64

# Conversation trie


def plain_trie(rows, head=4, group=20):
    """rows: (conv_id, turn, role, text)."""

    def digest(role, text):
        role, text = role or "", text or ""
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest(role, text), role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % head
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [(p, m) for p, m in nodes.items() if p[: len(path)] == path]
        leaves = [p for p, _ in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(path))
        out.add(
            (
                min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                sum(1 for q in nodes if len(q) == len(path) + 1 and q[: len(path)] == path), len(leaves),
                sum((len(m) - 1) * len(words(p[-1][1]) if p else []) for p, m in below),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return out


def talk(spark, rows):
    extra = [*CLASHING, "depth", "x", "words", "ord"]
    names = ["conv_id long", "turn long", "role string", "text string", *(f"{c} string" for c in extra)]
    return spark.createDataFrame([(*r, *extra) for r in rows], ", ".join(names))


def nodes_of(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert len(found) == len(set(found))
    return set(found)


def odd_talk():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"turn {rng.randrange(2)} text") for c in range(80) for t in range(rng.randrange(1, 6))]
    rows += [(100 + 20 * i, t, "user", "the same words again") for i in range(30) for t in range(3)]  # copies
    rows += [(5000, 0, None, None), (5001, None, "a:b", ""), (5001, None, "a", ":b"), (5001, 0, "", None)]
    rows += [(5020, t, "user", f"{'long ' * 3000}{t}") for t in range(40)] + [(5020, 3, "user", "tie"), (5020, 3, "bot", "tie")]
    rows += [(5041, 0, "user", "alone without its base"), (-7, 0, "user", "below zero"), (-27, 1, "user", "below zero")]
    rows += [(None, 0, "user", "no conversation")] * 3 + [(7, 0, "user", "repeated")] * 2
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2, 4096])
def test_trie_equals_plain_python(spark, monkeypatch, block):
    """Also with blocks and end lists of two, so that everything is carried across pieces."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "ENDS", block)
    rows = odd_talk()
    want = plain_trie(rows)
    assert nodes_of(trie.conversation_trie(talk(spark, rows).repartition(5))) == want
    assert any(n[3] > 20 and n[1] == 3 for n in want) and any(n[2] is None for n in want)


def test_trie_of_one_conversation_and_of_none(spark):
    one = [(3, t, "user", "same") for t in range(700)]
    assert nodes_of(trie.conversation_trie(talk(spark, one))) == plain_trie(one)
    assert trie.conversation_trie(talk(spark, [])).count() == 0
    assert trie.conversation_trie(talk(spark, [(None, 1, "user", "x")])).count() == 0
    # The only turns are dropped with the missing base: a root without children.
    bare = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert nodes_of(trie.conversation_trie(talk(spark, [(bare, 0, "user", "x")]))) == plain_trie([(bare, 0, "user", "x")])


def test_long_conversations_are_numbered_in_pieces(spark):
    rows = [(1, t, "user", str(t)) for t in range(500)] + [(2, 0, "user", "x")]
    numbered = trie.numbered_turns(talk(spark, rows).repartition(6))
    assert sorted(r["ord"] for r in numbered.filter("conv_id = 1").collect()) == list(range(1, 501))
    order = {trie_digest(str(t)): t + 1 for t in range(500)}
    assert all(order[r["digest"]] == r["ord"] for r in numbered.filter("conv_id = 1").collect())


def trie_digest(text):
    return hashlib.sha256(f"4:user{text}".encode()).hexdigest()


# Spelling variants


def plain_words(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_variants(counts):
    forms, near_n = {}, {}
    for w in counts:
        near = [v for v in counts if one_edit(w, v)]
        near_n[w] = len(near)
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, counts[w], near_n[w], counts[forms[w]] if forms[w] else None))
    return out


def typos(n=400):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzàéîöüß÷×"
    out = []
    for i in range(n):
        text = []
        for _ in range(30):
            word = f"{'aardvark banana cherry éclair straße elephant'.split()[rng.randrange(6)]}"
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at, kind = rng.randrange(len(word)), rng.randrange(3)
                word = word[:at] + (rng.choice(letters[:4]) if kind else "") + word[at + (kind < 2) :]
            text.append(word.upper() if rng.random() < 0.1 else word)
        out.append((i, " ".join(text)))
    return out


def variants_of(df):
    found = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len({r[0] for r in found})
    return set(found)


def test_spelling_equals_plain_python(spark):
    docs = typos() + [(1, "banana")] * 5 + [(None, "banana bananas bananas Bananas,bananas"), (-3, None), (3, ""), (4, "ÀÉÎÖ ÀÉÎÖÜ")]
    docs += [(900, "x" * 5000 + " " + "x" * 4999 + " ") for _ in range(4)]
    # A text longer than a piece, with letters of two bytes at every cut.
    docs += [(901, "é" * (1 << 20) + " straße" * 3 + "日本語éclair" * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING}).withColumn("word", F.lit("w"))
    want = plain_variants(plain_words(docs))
    assert variants_of(spelling.spelling_variants(df.repartition(4))) == want
    assert any(w[1] and w[2] != w[1] for w in want), "some chain has two steps"


def test_spelling_empty_and_without_words(spark):
    empty = odd_docs(spark, [])
    assert spelling.spelling_variants(empty).count() == 0
    assert spelling.spelling_variants(odd_docs(spark, [(1, None, "a"), (2, "ab 12", "b")])).count() == 0
    lone = spelling.spelling_variants(odd_docs(spark, [(1, "lonely lonely lonely", "a")])).collect()
    assert [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in lone] in ([("lonely", None, "lonely", 3, 0, None)], [])


def test_spelling_flushes_and_pieces_keep_counts(spark, monkeypatch):
    docs = [(i, " ".join(f"word{chr(97 + i % 7)}{chr(97 + j % 26)}" for j in range(60))) for i in range(40)]
    run = spelling._count_words("k", "t")
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k, _ in docs]), pa.array([t for _, t in docs])], ["k", "t"])
    monkeypatch.setattr(spelling, "HELD_WORDS", 5)
    monkeypatch.setattr(spelling, "PIECE", 7)
    total = Counter()
    for part in run(iter([batch])):
        for w, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()):
            total[w] += n
    assert {w: n for w, n in total.items() if len(w) >= 5 and n >= 3} == plain_words(docs)


@pytest.mark.parametrize("s", [2, 3, 7])
def test_neighbourhood_holds_every_edit(s):
    rng = np.random.default_rng(s)
    for n in (5, 9):
        words_ = rng.integers(97, 123, (20, n)).astype(np.uint8)
        for length in (n - 1, n, n + 1):
            keys = spelling.neighbourhood(words_, length, s)
            for row, w in zip(keys, words_):
                for _ in range(10):
                    at = rng.integers(0, n)
                    c = rng.integers(97, 123)
                    v = {n: np.r_[w[:at], c, w[at + 1 :]], n - 1: np.r_[w[:at], w[at + 1 :]], n + 1: np.r_[w[:at], c, w[at:]]}[length]
                    with np.errstate(over="ignore"):
                        form = (spelling.alphabet(s)[v] * spelling.powers(length, spelling.ROOT)).sum(dtype=U64)
                    assert spelling._key(np.array([form]), length)[0] in row


# Odd sketches


def pairs_of(text):
    w = words(text)
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} if w else set()


def plain_components(docs):
    sets = [pairs_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        least.setdefault(find(i), []).append(key)
    out = []
    for i, (key, _) in enumerate(docs):
        keys = [k for k in least[find(i)] if k is not None]
        component = min(keys) if keys else None
        out.append((key, len(sets[i]), component, key == component))
    return Counter(out)


def copies_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def chains(n=150):
    """Copies that drift: neighbours are similar, ends are not; all share a passage of most of the words."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for i in range(n):
        for _ in range(2):
            base[rng.randrange(len(base))] = f"v{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(base)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [64, 2])
def test_sketches_equal_plain_python(spark, monkeypatch, small):
    """Also where nearly all buckets are compared in blocks, of few rows each."""
    monkeypatch.setattr(odd_sketch, "SMALL_BUCKET", small)
    if small == 2:
        monkeypatch.setattr(odd_sketch, "BLOCK_ROWS", 5)
        monkeypatch.setattr(odd_sketch, "BLOCK_SHINGLES", 300)
    docs = near_texts() + chains()
    docs += [(5000 + i, t) for i, t in enumerate(["one", "ONE", "one two", "a b c d e f", "a b c d e", "a b c d e f g", " ", "", None])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    assert copies_of(odd_sketch.near_copies(df.repartition(3))) == plain_components(docs)


def test_sketches_of_odd_rows(spark):
    rows = [(r[0], r[1]) for r in ODD]
    assert copies_of(odd_sketch.near_copies(odd_docs(spark))) == plain_components(rows)
    assert odd_sketch.near_copies(odd_docs(spark, [])).count() == 0
    # Keys that repeat or are null name no row: texts are told apart all the same.
    family = [t for _, t in near_texts(24)]
    docs = [(None, t) for t in family] + [(7, t) for t in family[::2]] + [(None, None)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert copies_of(odd_sketch.near_copies(df)) == plain_components(docs)


def test_many_rows_without_keys_cost_what_keyed_rows_do(spark):
    """Each wanted set meets the rows of its own text, not all rows without a key."""
    docs = [(None, f"{t} tail{i // 2}") for i, (_, t) in enumerate(chains(2000))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = odd_sketch.near_copies(df)
    assert found.count() == 2000 and found.filter("component_id IS NOT NULL").count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    limit = odd_sketch.farthest()
    for share, passes in ((1.0, True), (0.9, True), (0.8, True), (0.3, False)):
        for _ in range(30):
            common = rng.integers(0, 2**63, int(1000 * 2 * share / (1 + share)), dtype=np.uint64)
            own = [rng.integers(0, 2**63, 1000 - len(common), dtype=np.uint64) for _ in range(2)]
            samples = np.array([odd_sketch.minhashes(np.concatenate([common, o])) for o in own])
            x, y = odd_sketch.odd_sketches(samples).view(np.uint64)
            distance = int(np.bitwise_count(x ^ y).sum())
            assert (distance <= limit) == passes, (share, distance, limit)
            assert share < 1 or distance == 0
