"""Small tables with every oddity, and plain Python counterparts of the operators."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"

# Names that the operators use inside.
CLASHING = ("row", "size", "taken", "copies", "sig", "n", "first", "pos", "gone", "score", "kept", "ids", "doc", "body")

SENTENCE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river"
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta.\nAn idiot line that is long enough", "a"),
    (1, "Alpha beta gamma delta epsilon zeta eta theta.\nAn idiot line that is long enough", "a"),
    (2, None, None),
    (3, "", "b"),
    (4, " \t\n ", "b"),
    (None, "orphan text without any key at all", "a"),
    (5, SENTENCE * 30, "a"),
    (6, (SENTENCE * 30).upper(), "b"),
    (7, "word " * 30_000, "c"),
    (8, "é" * 5_000, "c"),
    (9, "<|endoftext|> 日本語 \x00 ﬁ straße", None),
    (10, "short", "a"),
    (11, "short", "b"),
    (12, SENTENCE + "\n" + SENTENCE[:-1] + "s\n\n" + SENTENCE, "a"),
]


def odd_docs(spark, rows=ODD):
    names = ["doc_id long", "text string", "source string", *(f"{c} string" for c in CLASHING)]
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], ", ".join(names))


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_texts(n: int = 60) -> list[tuple[int, str]]:
    """Families of edited copies, exact copies, one passage that all share, and loners."""
    import random

    rng = random.Random(3)
    make = lambda k: " ".join(f"w{rng.randrange(900)}" for _ in range(k))
    passage, base = make(120), [make(150) for _ in range(4)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append((i, make(60) + " " + passage + " " + make(60)))
            continue
        w = base[i % 4].split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out + [(n, out[1][1]), (n + 1, out[1][1].upper()), (n + 2, "one two"), (n + 3, "ONE  two")]
