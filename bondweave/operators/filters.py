"""Predicates on bonds, as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def element_pair(symbols: Sequence[str], a: str = "sa", b: str = "sb") -> Column:
    """One symbol: either end has it. Two: the ends are these, in any order."""
    if len(symbols) == 1:
        return (F.col(a) == symbols[0]) | (F.col(b) == symbols[0])
    if len(symbols) != 2:
        raise ValueError("one or two element symbols")
    x, y = symbols
    return ((F.col(a) == x) & (F.col(b) == y)) | ((F.col(a) == y) & (F.col(b) == x))


def has_neighbors(neighbors: str, required: dict[str, int], strict: bool = False) -> Column:
    """An array of symbols holds at least (``strict``: exactly) the required number of each; ``strict`` allows no others."""
    def count(s: str) -> Column:
        return F.size(F.filter(neighbors, lambda x: x == s))

    tests = [count(s) == n if strict else count(s) >= n for s, n in required.items()]
    if strict:
        tests.append(F.size(neighbors) == sum(required.values()))
    return reduce(lambda p, q: p & q, tests, F.lit(True))


def allowed_class(column: str, allowed: Sequence[str], universe: Sequence[str]) -> Column:
    """Class among ``allowed``; none allowed rejects all, all allowed accepts all."""
    if not allowed:
        return F.lit(False)
    return F.lit(True) if set(allowed) >= set(universe) else F.col(column).isin(list(allowed))


@dataclass(frozen=True)
class BondFilter:
    """What bonds to keep; fields left alone do not filter. ``orders`` 1 and 12 are single and aromatic bonds."""

    elements: tuple[str, ...] = ()
    start_neighbors: tuple[tuple[str, int], ...] = ()
    end_neighbors: tuple[tuple[str, int], ...] = ()
    strict: bool = False
    classes: tuple[str, ...] | None = None
    orders: tuple[int, ...] = ()

    def column(self, universe: Sequence[str] = ()) -> Column:
        tests = []
        if self.elements:
            tests.append(element_pair(self.elements))
        if self.start_neighbors:
            tests.append(has_neighbors("na", dict(self.start_neighbors), self.strict))
        if self.end_neighbors:
            tests.append(has_neighbors("nb", dict(self.end_neighbors), self.strict))
        if self.classes is not None:
            tests.append(allowed_class("ring_class", self.classes, universe))
        if self.orders:
            tests.append(F.col("bond_order").isin(list(self.orders)))
        return reduce(lambda p, q: p & q, tests, F.lit(True))

    def apply(self, df: DataFrame, universe: Sequence[str] = ()) -> DataFrame:
        return df.where(self.column(universe))
