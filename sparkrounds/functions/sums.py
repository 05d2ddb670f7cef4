"""Sums of doubles that do not depend on the order of their terms.

A double is cut, towards zero, into whole multiples of falling powers of two, of
22 bits each.
Cutting is exact, and so are the sums of the pieces, which are LONGs: 2^41 terms
fit.  The total is put together once, in a fixed order.  Terms keep 88 binary
places and their size should stay below 2^44; where a power of two above all
terms is known, three pieces below it do, 66 places of the largest.

The pieces of all terms are columns, made in stages, so that each is computed
once; :func:`exact_sum_sql` is the same sum in one expression of plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22
#: Binary places of the pieces' units.
PLACES = (-22, 0, 22, 44, 66, 88)


def exact_sums(
    df: DataFrame, by: list[str], totals: dict[str, str], *others: Column, top: int | None = None
) -> DataFrame:
    """``df`` grouped ``by`` with exact sums of DOUBLE columns, ``{name: column}``, and ``others``.

    With ``top`` all terms must be below 2^top.  A group without terms other
    than null has a null sum.
    """
    terms = list(dict.fromkeys(totals.values()))
    pieces, rests, sums = exact_steps(terms, top)
    for piece, rest in zip(pieces, rests):
        df = df.selectExpr("*", *piece)
        df = df.selectExpr("*", *rest) if rest else df
    return df.groupBy(*by).agg(*[F.expr(sums[t]).alias(name) for name, t in totals.items()], *others)


def exact_steps(terms: list[str], top: int | None = None) -> tuple[list[list[str]], list[list[str]], dict[str, str]]:
    """SQL text of the stages: select items with the pieces, those with what is left after them, and each term's sum."""
    all_places = PLACES if top is None else tuple(i * BITS - top for i in (1, 2, 3))
    last = len(all_places) - 1
    rest, pieces, rests = {t: f"`{t}`" for t in terms}, [], []
    for i, places in enumerate(all_places):
        # A cast cuts towards zero, so what is left has fewer bits, whatever the sign.
        pieces.append([f"bigint({rest[t]} * {_double(places)}) AS {_piece(t, i)}" for t in terms])
        rests.append([f"{rest[t]} - {_piece(t, i)} * {_double(-places)} AS {t}_rest_{i}" for t in terms if i < last])
        rest = {t: f"{t}_rest_{i}" for t in terms}
    sums = {
        t: " + ".join(f"double(sum({_piece(t, i)})) * {_double(-p)}" for i, p in enumerate(all_places)) for t in terms
    }
    return pieces, rests, sums


def _piece(term: str, i: int) -> str:
    return f"{term}_piece_{i}"


def exact_sum_sql(term: str) -> str:
    """SQL text of the same sum of ``term``, a column or a short expression, over a group."""
    rest, parts = f"({term})", []
    for places in PLACES:
        scaled = f"{rest} * {_double(places)}"
        piece = f"sign({scaled}) * floor(abs({scaled}))"
        parts.append(f"CAST(sum(CAST({piece} AS BIGINT)) AS DOUBLE) * {_double(-places)}")
        rest = f"({rest} - {piece} * {_double(-places)})"
    return "(" + " + ".join(parts) + ")"


def _double(power: int) -> str:
    """2^power as a literal that is a double in every engine."""
    return f"{2.0**power:.17e}"
