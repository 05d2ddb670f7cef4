"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)
ROOT = U64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2^64
INVERSE = pow(int(ROOT), -1, 1 << 64)
BLOCK_BITS = 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_values(seed: int) -> np.ndarray:
    """A value for each byte; A-Z share those of a-z, separators are 0."""
    with np.errstate(over="ignore"):
        values = mix((np.arange(256, dtype=U64) + U64(1 + 256 * seed)) * STEP)
    values[65:91] = values[97:123]
    values[[32, *range(9, 14)]] = 0
    return values


def powers(n: int, root: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, dtype=U64), np.full(max(0, n - 1), root, dtype=U64)]))


@lru_cache(maxsize=4)
def _block_powers(root: int) -> np.ndarray:
    return powers(1 << BLOCK_BITS, U64(root))


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and each text's first position among them.

    Words are runs without ASCII white space, A-Z in lower case.
    """
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    values = _byte_values(seed)[data]
    solid = values != 0
    edge = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    block = 1 << BLOCK_BITS
    with np.errstate(over="ignore"):
        # Values times ROOT^position; positions restart in every block of bytes.
        turn, back = _block_powers(int(ROOT)), _block_powers(INVERSE)
        for at in range(0, len(values), block):
            values[at : at + block] *= turn[: len(values) - at]
        sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(values)])
        whole = sums[ends] - sums[starts]
        same = starts >> BLOCK_BITS == (ends - 1) >> BLOCK_BITS
        out = whole * back.take(starts & (block - 1))
        for i in np.flatnonzero(~same).tolist():
            # A word across a block's end: hash it on its own.
            part = _byte_values(seed)[data[starts[i] : ends[i]]]
            out[i] = (part * powers(len(part), ROOT)).sum(dtype=U64)
        out = mix(out + (ends - starts).astype(U64) * STEP)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return out, np.searchsorted(starts, begin)


def shingle_sets(texts: list[bytes], size: int = 5, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer words has one shingle, its whole sequence; one without words none.
    """
    words, first = word_hashes(texts, seed)
    n = len(words)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, n - size + 1), dtype=U64)
        for k in range(size):
            grams += words[k : k + len(grams)] * powers(size, ROOT)[k]
        grams = mix(grams)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(grams[a : b - size + 1]))
            elif b > a:
                short = (words[a:b] * powers(b - a, ROOT)).sum(dtype=U64) + U64(b - a)
                out.append(mix(np.array([short], dtype=U64) * STEP))
            else:
                out.append(np.zeros(0, dtype=U64))
    return out
