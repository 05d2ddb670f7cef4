"""Round schedules: driver-side arithmetic on counts."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Round:
    number: int
    subsets: int
    edges_bound: int


class FilterSchedule:
    """How many subsets each filtering round uses, and when filtering stops.

    With ``c = log_n(m/n)`` a round splits the edges into ``ceil(n^((c-eps)/2))``
    subsets, and then ``c`` becomes ``(c-eps)/2``.  Filtering goes on while more
    than ``n^(1+eps)`` edges remain.
    """

    def __init__(self, n: int, m: int, epsilon: float = 0.125):
        if epsilon <= 0:
            raise ValueError("epsilon must be positive")
        self.n, self.epsilon = n, epsilon
        self.stop_at = float(n) ** (1.0 + epsilon) if n > 1 else float("inf")
        self.c = math.log(m / n, n) if n > 1 and m > 0 else 0.0

    def wants_round(self, m: int) -> bool:
        return m > self.stop_at

    def next_subsets(self) -> int:
        k = max(1, math.ceil(self.n ** ((self.c - self.epsilon) / 2)))
        self.c = (self.c - self.epsilon) / 2
        return k


def worst_case_rounds(n: int, m: int, epsilon: float = 0.125) -> list[Round]:
    """The schedule when every subset keeps a full spanning tree (n-1 edges)."""
    schedule = FilterSchedule(n, m, epsilon)
    rounds: list[Round] = []
    while schedule.wants_round(m):
        k = schedule.next_subsets()
        m = min(m, k * (n - 1))
        rounds.append(Round(len(rounds) + 1, k, m))
    return rounds


def merge_rounds(sets: int) -> int:
    """Rounds of merge-and-reduce over ``sets`` starting sets."""
    return int(math.floor(math.log2(sets))) + 1 if sets > 0 else 0
