"""Structured predicates over document attributes, as data.

They describe a filter; a search evaluates them only where its caller passes a
table of attributes, and raises UnsupportedFilterPredicate otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = int | float | str


class Predicate:
    def column(self) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Eq(Predicate):
    name: str
    value: Value

    def column(self) -> Column:
        return F.col(self.name) == F.lit(self.value)


@dataclass(frozen=True)
class Range(Predicate):
    """Both ends belong to it; an end may be open."""

    name: str
    low: Value | None = None
    high: Value | None = None

    def column(self) -> Column:
        low = F.lit(True) if self.low is None else F.col(self.name) >= F.lit(self.low)
        return low if self.high is None else low & (F.col(self.name) <= F.lit(self.high))


@dataclass(frozen=True)
class In(Predicate):
    name: str
    values: tuple[Value, ...]

    def column(self) -> Column:
        return F.col(self.name).isin(list(self.values))


@dataclass(frozen=True)
class AllOf(Predicate):
    parts: tuple[Predicate, ...]

    def column(self) -> Column:
        return reduce(lambda a, p: a & p.column(), self.parts, F.lit(True))


@dataclass(frozen=True)
class AnyOf(Predicate):
    parts: tuple[Predicate, ...]

    def column(self) -> Column:
        return reduce(lambda a, p: a | p.column(), self.parts, F.lit(False))


@dataclass(frozen=True)
class NoneOf(Predicate):
    part: Predicate

    def column(self) -> Column:
        return ~self.part.column()
