"""BM25 and BM25F as columns in 32-bit arithmetic.

Every step is rounded to a float, in a fixed order, so that equal statistics
give equal bits everywhere.  Spark widens divisions and logarithms to double;
they are cast back at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import ClassVar, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_MAX = 3.4028234663852886e38


def f32(x: Column | float) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("float")


def sat(x: Column) -> Column:
    """A finite float: NaN becomes 0, infinities the largest value of their sign."""
    x = f32(x)
    return F.when(F.isnan(x), f32(0.0)).otherwise(F.least(F.greatest(x, f32(-FLOAT_MAX)), f32(FLOAT_MAX)))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used; generated code stays small."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def checked(score: float) -> float:
    """A score given by the caller; only finite ones are scores."""
    if not math.isfinite(score):
        raise ValueError("a score is finite")
    return score


def _saturated(tf: Column, length: Column, avg: Column, n: Column, df: Column, k1: float, b: float) -> Column:
    tf, length, avg, n, df = map(f32, (tf, length, avg, n, df))
    idf = f32(F.ln(f32((n - df + f32(0.5)) / (df + f32(0.5))) + f32(1.0)))
    norm = f32(1.0) - f32(b) + f32(b) * f32(length / avg)
    score = idf * f32((tf * (f32(k1) + f32(1.0))) / (tf + f32(k1) * norm))
    dead = (tf == 0) | (n == 0) | (df == 0) | (df > n) | F.isnan(avg) | (avg <= 0) | (avg > f32(FLOAT_MAX))
    return F.when(dead, f32(0.0)).otherwise(score)  # finite, as its parts are


@dataclass(frozen=True)
class BM25:
    """k1 is finite and not negative, b from 0 to 1."""

    k1: float = 1.2
    b: float = 0.75

    name = "bm25"
    by_fields = False

    def __post_init__(self) -> None:
        if not (math.isfinite(self.k1) and self.k1 >= 0 and 0 <= self.b <= 1):
            raise ValueError("k1 is finite and not negative, b from 0 to 1")

    def score(self, tf: Column, length: Column, avg: Column, n: Column, df: Column) -> Column:
        return _saturated(tf, length, avg, n, df, self.k1, self.b)


@dataclass(frozen=True)
class BM25F(BM25):
    """As BM25, over the weighted term counts and lengths of several fields; absent weights are 1."""

    weights: Mapping[int, float] = field(default_factory=dict)

    name = "bm25f"
    by_fields = True

    def score_fields(self, fields: Sequence[tuple[int, Column, Column]], avg: Column, n: Column, df: Column) -> Column:
        """``fields`` as (id, term count, length), in order of id; ``avg`` is the unweighted sum of the averages."""
        tf = length = f32(0.0)
        for i, t, l in fields:
            w = f32(float(self.weights.get(i, 1.0)))
            tf, length = tf + f32(t) * w, length + f32(l) * w
        return _saturated(tf, length, avg, n, df, self.k1, self.b)


def some(score: Column) -> Column:
    """A scorer's view: no score rather than 0."""
    return F.nullif(score, f32(0.0))


def combined(first: Column, first_weight: float, second: Column, second_weight: float) -> Column:
    """first * w1 + second * w2; an absent side is left out, and two absent sides give none. Can be nested."""
    a, b = sat(first * f32(first_weight)), sat(second * f32(second_weight))
    return F.when(first.isNotNull() & second.isNotNull(), sat(a + b)).when(first.isNotNull(), a).when(second.isNotNull(), b)


class Scorer(Protocol):
    """What a search takes as a scorer: an object with a name and a score of one posting, null for none.

    Counts are those of the posting and its field; ``avg`` is the field's
    average length, ``n`` the number of documents and ``df`` how many of them
    have the term there. A true ``by_fields`` asks for ``score_fields`` as well
    (see :class:`BM25F`); without the attribute it is false.
    """

    name: str

    def score(self, tf: Column, length: Column, avg: Column, n: Column, df: Column) -> Column: ...


@dataclass(frozen=True)
class Combined:
    """Two scorers by weight, a posting at a time; nest it for more. A side that scores 0 or nothing is left out."""

    first: Scorer
    first_weight: float
    second: Scorer
    second_weight: float

    name: ClassVar[str] = "combined"
    by_fields: ClassVar[bool] = False

    def score(self, tf: Column, length: Column, avg: Column, n: Column, df: Column) -> Column:
        both = F.struct(*(x.score(tf, length, avg, n, df).alias(side) for x, side in ((self.first, "a"), (self.second, "b"))))
        return once(both, lambda s: combined(some(s["a"]), self.first_weight, some(s["b"]), self.second_weight))
