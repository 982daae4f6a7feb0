"""What becomes of the matches: the best k, their number, or several of these at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlex.errors import MissingScorer
from lumenlex.functions.scoring import BM25, Scorer
from lumenlex.operators.search import Compiled, compiled, match
from lumenlex.plans.query import Node
from lumenlex.sources.index import Index
from lumenlex.storage import materialize


class Collector(Protocol):
    needs_scores: bool

    def collect(self, matches: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class TopK:
    """The k best: higher scores first, then higher ids."""

    k: int
    needs_scores: bool = field(default=True, init=False)

    def collect(self, matches: DataFrame) -> DataFrame:
        return matches.orderBy(F.desc("score"), F.desc("doc_id")).limit(self.k)

    def min_score(self, matches: DataFrame) -> float | None:
        """The k-th best score, once there are k."""
        best = self.collect(matches).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        return best.least if self.k and best.n == self.k else None


@dataclass(frozen=True)
class Count:
    """The number of matches; scores are not computed for it."""

    needs_scores: bool = field(default=False, init=False)

    def collect(self, matches: DataFrame) -> DataFrame:
        return matches.agg(F.count("*").alias("matches"))


def run(index: Index, query: Node | str | Compiled, collectors: Sequence[Collector], scorer: Scorer | None = BM25(), **options: object) -> list[DataFrame]:
    """One result for each collector, over one evaluation of the query."""
    scores = any(c.needs_scores for c in collectors)
    if scores and scorer is None:
        raise MissingScorer("a collector needs scores")
    matches = match(index, query, scorer if scores else None, **options)
    if len(collectors) > 1:
        matches = materialize(matches, "matches")
    return [c.collect(matches) for c in collectors]


def search(index: Index, query: Node | str | Compiled, limit: int = 10, scorer: Scorer = BM25(), **options: object) -> DataFrame:
    """The best matches of a query."""
    return run(index, query, [TopK(limit)], scorer, **options)[0]


def count(index: Index, query: Node | str | Compiled, **options: object) -> DataFrame:
    return run(index, query, [Count()], None, **options)[0]


def statistics(index: Index, query: Node | str | Compiled, limit: int, scorer: Scorer | None = BM25(), **options: object) -> dict[str, int]:
    """Counters of an execution: postings that were scored, blocks skipped (none: no block is pruned), hits collected."""
    plan = query if isinstance(query, Compiled) else compiled(index, query)
    scored = sum(plan.frequency.values()) if scorer is not None else 0
    return {"scored_postings": scored, "skipped_blocks": 0, "collected_hits": match(index, plan, scorer, **options).limit(limit).count()}
