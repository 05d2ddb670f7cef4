"""Deterministic pseudo-randomness from md5.

All random choices are functions of ``(seed, row key)``, so they do not depend
on how rows are partitioned, on retries, or on the number of executors.
Keys are column names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296


def _md5(seed: object, keys: tuple[str, ...]) -> str:
    text = str(seed).replace("\\", "\\\\").replace("'", "\\'")
    return f"md5(concat_ws(':', '{text}', {', '.join(f'string(`{k}`)' for k in keys)}))"


def _hash32(seed: object, keys: tuple[str, ...]) -> str:
    return f"bigint(conv(substring({_md5(seed, keys)}, 1, 8), 16, 10))"


def _uniform(seed: object, keys: tuple[str, ...]) -> str:
    return f"(({_hash32(seed, keys)} + 0.5D) / {TWO_32}D)"


def order_key(seed: object, *keys: str) -> Column:
    """Hex md5 of ``seed:key:key...``; sorting by it is a seeded shuffle."""
    return F.expr(_md5(seed, keys))


def hash32(seed: object, *keys: str) -> Column:
    """First 32 bits of :func:`order_key` as a non-negative LONG."""
    return F.expr(_hash32(seed, keys))


def hash60(seed: object, *keys: str) -> Column:
    """First 60 bits of :func:`order_key` as a LONG: the same order, as a number."""
    return F.expr(f"bigint(conv(substring({_md5(seed, keys)}, 1, 15), 16, 10))")


def bucket(seed: object, n: int, *keys: str) -> Column:
    """Seeded bucket number in ``[0, n)``."""
    return F.expr(f"{_hash32(seed, keys)} % {int(n)}")


def uniform(seed: object, *keys: str) -> Column:
    """Seeded uniform DOUBLE strictly inside (0, 1)."""
    return F.expr(_uniform(seed, keys))


def normal_pair(seed: object, *keys: str) -> tuple[Column, Column]:
    """Two independent standard normals per row (Box-Muller)."""
    radius = f"sqrt(-2.0D * ln({_uniform(f'{seed}:r', keys)}))"
    angle = f"({2.0 * math.pi!r}D * {_uniform(f'{seed}:t', keys)})"
    return F.expr(f"{radius} * cos({angle})"), F.expr(f"{radius} * sin({angle})")
