"""Matching and scoring a search expression as one DataFrame.

The postings of all terms of the expression are read in one pruned scan,
scored once a posting against a small broadcast table of the terms' constants,
and grouped once by document.  Document frequencies are looked up in the stored
dictionary.  A document then has one nullable column for each
term, and the expression is a tree of columns: presence for matching, and sums
in the order of the expression for scores, so that floats add up alike
everywhere.  Statistics are those of the whole index, never of filtered rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlex.errors import InvalidFieldWeight, MissingFilter, ParseError, UnsupportedFilterPredicate
from lumenlex.functions.scoring import BM25, BM25F, Scorer, f32, once, sat
from lumenlex.plans.query import And, Constant, External, Node, Not, Or, Phrase, Term, Where, checked, parse
from lumenlex.sources.index import Index

#: A filter is a table with the accepted doc_id values, or a function from the doc_id column to a condition.
Filter = DataFrame | Callable[[Column], Column]

#: Up to so many terms a document's scores are pivoted to columns; beyond, they are looked up in a map.
PIVOT = 32


def _unit(boost: float) -> bool:
    return abs(boost - 1.0) <= 1.1920929e-07


@dataclass
class Compiled:
    """An expression resolved against an index, which can be run again with other scorers and filters.

    What a run needs of the index is looked up once.
    """

    index: Index
    node: Node
    terms: dict[tuple[int, str], int] = field(default_factory=dict)
    groups: list[tuple[int, ...]] = field(default_factory=list)  # terms of one text in several fields

    def term(self, field_id: int, text: str) -> int | None:
        """Number of a term; None unless the text is exactly one term for the field's analyzer."""
        terms = self.index.fields[field_id].analyzer.terms(text)
        return self.terms.setdefault((field_id, terms[0]), len(self.terms)) if len(terms) == 1 else None

    def parts(self, node: Term) -> list[tuple[int, int]]:
        """(field, term number) of a term in its field or in all fields."""
        if node.field is not None:
            wanted = [self.index.resolve(node.field)]
        else:
            wanted = self.index.default_fields
            if not wanted:
                raise ParseError("there is no field to search")
        return [(f, t) for f in wanted if (t := self.term(f, node.text)) is not None]

    def _wanted(self) -> Column:
        by_field: dict[int, list[str]] = {}
        for f, t in self.terms:
            by_field.setdefault(f, []).append(t)
        return reduce(lambda a, b: a | b, ((F.col("field_id") == f) & F.col("term").isin(ts) for f, ts in by_field.items()), F.lit(False))

    def postings(self) -> DataFrame:
        """Postings of the terms, with the number of each: by literals for a few terms, else by a table of at most as many rows as a query has nodes."""
        hits = self.index.postings.where(self._wanted())
        if len(self.terms) <= PIVOT:
            place = F.coalesce(*(F.when((F.col("field_id") == f) & (F.col("term") == t), F.lit(i)) for (f, t), i in self.terms.items()))
            average = F.coalesce(*(F.when(F.col("field_id") == f, F.lit(self.index.average_length(f))) for f in sorted({f for f, _ in self.terms})))
            return hits.withColumns({"place": place, "avg": average})
        rows = [(f, t, i, self.index.average_length(f)) for (f, t), i in self.terms.items()]
        table = self.index.spark.createDataFrame(rows, "field_id int, term string, place int, avg double")
        return hits.join(F.broadcast(table), ["field_id", "term"])

    @cached_property
    def frequency(self) -> dict[int, int]:
        """How many documents each term has; a look into the dictionary."""
        if not self.terms:
            return {}
        return {self.terms[r.field_id, r.term]: r.doc_freq for r in self.index.terms.where(self._wanted()).collect()}

    @cached_property
    def spread(self) -> dict[tuple[int, ...], int]:
        """How many documents have a term in any field, for all such terms at once."""
        several = sorted({tuple(sorted(g)) for g in self.groups})
        if not several:
            return {}
        of = self.index.spark.createDataFrame([(p, i) for i, g in enumerate(several) for p in g], "place int, g int")
        counts = self.postings().join(F.broadcast(of), "place").groupBy("g").agg(F.count_distinct("doc_id").alias("n")).collect()
        return {several[r.g]: r.n for r in counts}


def expression(query: Node | str, index: Index) -> Node:
    """A parsed query within its limits."""
    return checked(parse(query) if isinstance(query, str) else query, len(index.default_fields))


def compiled(index: Index, query: Node | str) -> Compiled:
    """A query planned once, for :func:`match` and the collectors."""
    plan = Compiled(index, expression(query, index))
    for n in plan.node.walk():
        if isinstance(n, Phrase):
            raise NotImplementedError("phrases can be described, not searched")
        if isinstance(n, Term):
            parts = plan.parts(n)
            if n.field is None and len(index.default_fields) > 1 and parts:
                plan.groups.append(tuple(t for _, t in parts))
    return plan


def match(index: Index, query: Node | str | Compiled, scorer: Scorer | None = BM25(), filters: Mapping[int, Filter] | None = None, attributes: DataFrame | None = None, default_boost: float = 1.0) -> DataFrame:
    """(doc_id, score) of all matches; without a scorer, doc_id alone.

    A document matches by its terms, whatever the scorer gives it; filters that
    the expression does not name wrap it in order of their slots. ``attributes``
    (doc_id and columns) lets structured predicates be evaluated.
    """
    plan = query if isinstance(query, Compiled) else compiled(index, query)
    node, filters = plan.node, filters or {}
    for slot in filters:
        if not any(isinstance(n, External) and n.slot == slot for n in node.walk()):
            node = External((node,), slot)
    for f, w in dict(getattr(scorer, "weights", {})).items():
        if not (w >= 0 and w != float("inf")):
            raise InvalidFieldWeight(f, w)
    for n in node.walk():
        if isinstance(n, Where) and attributes is None:
            raise UnsupportedFilterPredicate("pass attributes to evaluate structured predicates")
        if isinstance(n, External) and n.slot not in filters:
            raise MissingFilter(n.slot)
    docs = _documents(plan, node, scorer)
    for slot, f in filters.items():
        flag = f"accept_{slot}"
        if callable(f) and not isinstance(f, DataFrame):
            docs = docs.withColumn(flag, F.coalesce(f(F.col("doc_id")), F.lit(False)))
        else:
            accepted = f.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn(flag, F.lit(True))
            docs = docs.join(accepted, "doc_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    wheres = [n for n in node.walk() if isinstance(n, Where)]
    if wheres:
        flags = attributes.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(n.predicate.column(), F.lit(False)).alias(f"where_{i}") for i, n in enumerate(wheres)))
        docs = docs.join(flags, "doc_id", "left")
    places = {id(n): f"where_{i}" for i, n in enumerate(wheres)}
    matched, score = _column(plan, node, scorer, places, default_boost)
    docs = docs.where(matched)
    if scorer is None:
        return docs.select("doc_id")
    score = f32(0.0) if score is None else F.coalesce(score, f32(0.0))
    return docs.select("doc_id", score.alias("score"))


def by_fields(scorer: Scorer | None) -> bool:
    return bool(getattr(scorer, "by_fields", False))


def _documents(plan: Compiled, node: Node, scorer: Scorer | None) -> DataFrame:
    """A row for each document that may match, with the counts of its terms and what they score."""
    index = plan.index
    everything = index.documents.select("doc_id")
    if not plan.terms:
        return everything if _when_absent(node) else everything.where(F.lit(False))
    hits = plan.postings()
    score = f32(F.lit(None))
    if scorer is not None:
        counts = F.element_at(F.create_map(*(x for p in plan.terms.values() for x in (F.lit(p), F.lit(plan.frequency.get(p, 0))))), F.col("place"))
        score = scorer.score(F.col("term_freq"), F.col("doc_len"), F.col("avg"), F.lit(index.doc_count), counts)
        if not isinstance(scorer, BM25):  # of which all scores are finite
            score = once(f32(score), lambda s: F.when(s.isNotNull(), sat(s)))
    hits = hits.select("doc_id", "place", score.alias("score"), F.col("term_freq").alias("tf"))
    if len(plan.terms) <= PIVOT:
        columns = [F.max(F.when(F.col("place") == p, F.col(c))).alias(f"{c}_{p}") for p in plan.terms.values() for c in ("score", "tf")]
        docs = hits.groupBy("doc_id").agg(*columns)
    else:
        found = F.map_from_entries(F.collect_list(F.struct("place", F.struct("score", "tf"))))
        docs = hits.groupBy("doc_id").agg(found.alias("by_place"))
        docs = docs.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(len(plan.terms) - 1)), lambda i: F.try_element_at("by_place", i)).alias("found"))
    if plan.groups and by_fields(scorer):
        docs = docs.join(index.documents, "doc_id")
    return everything.join(docs, "doc_id", "left") if _when_absent(node) else docs


def _when_absent(node: Node) -> bool:
    """Whether a document without any of the terms may match."""
    kids = [_when_absent(c) for c in node.children]
    if isinstance(node, Not):
        return not kids[0]
    if isinstance(node, And):
        return bool(kids) and all(kids)
    return any(kids)


def _column(plan: Compiled, node: Node, scorer: Scorer | None, places: dict[int, str], default_boost: float) -> tuple[Column, Column | None]:
    """Whether the document matches the node, and its score there; null or None for none, as for all that do not match."""
    wide = len(plan.terms) > PIVOT

    def cell(what: str, place: int) -> Column:
        return F.get("found", F.lit(place))[what] if wide else F.col(f"{what}_{place}")

    def boost(score: Column, by: float) -> Column:
        return score if _unit(by) else F.when(score.isNotNull(), sat(score * f32(by)))

    def total(scores: list[Column | None]) -> Column | None:
        """Sum in order, absent ones left out; absent if all are."""
        some = [s for s in scores if s is not None]
        if not some:
            return None
        if len(some) > PIVOT:  # the same in an array: generated code stays small
            each = F.array(*some)
            return F.when(F.exists(each, lambda s: s.isNotNull()), F.aggregate(each, f32(0.0), lambda a, s: a + F.coalesce(s, f32(0.0))))
        added = reduce(lambda a, s: a + F.coalesce(s, f32(0.0)), some, f32(0.0))
        return F.when(F.coalesce(*some).isNotNull(), added)

    if isinstance(node, Term):
        parts = plan.parts(node)
        if not parts:
            return F.lit(False), None
        matched = reduce(lambda a, b: a | b, (cell("tf", t).isNotNull() for _, t in parts))
        if scorer is None:
            return matched, None
        by = node.boost * default_boost
        fields = plan.index.default_fields
        alike = len({text for (f, text), t in plan.terms.items() if t in {p for _, p in parts}}) == 1
        if by_fields(scorer) and node.field is None and len(fields) > 1 and alike:
            return matched, F.when(matched, boost(_by_fields(plan, scorer, dict(parts), cell), by))
        return matched, total([boost(cell("score", t), by) for _, t in parts])

    children = [_column(plan, c, scorer, places, default_boost) for c in node.children]
    if isinstance(node, Not):
        return ~children[0][0], None
    if isinstance(node, (And, Or)):
        if not children:
            return F.lit(False), None
        matched = reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), (m for m, _ in children))
        score = total([s for _, s in children])
        return matched, score if score is None else F.when(matched, boost(score, node.boost))
    matched, score = children[0]
    if isinstance(node, Constant):
        return matched, F.when(matched, sat(f32(node.score))) if abs(node.score) < float("inf") else F.when(matched, f32(0.0))
    keep = F.col(f"accept_{node.slot}") if isinstance(node, External) else F.coalesce(F.col(places[id(node)]), F.lit(False))
    return matched & keep, score if score is None else F.when(matched & keep, score)


def _by_fields(plan: Compiled, scorer: BM25F, parts: dict[int, int], cell: Callable[[str, int], Column]) -> Column:
    """One score over all searched fields of a document that has the term in any."""
    index = plan.index
    fields = index.default_fields
    df = plan.spread.get(tuple(sorted(parts.values())), 0)
    average = reduce(lambda a, b: a + b, (f32(index.average_length(f)) for f in fields), f32(0.0))
    counted = [(f, F.coalesce(cell("tf", parts[f]), F.lit(0)) if f in parts else F.lit(0), F.coalesce(F.try_element_at("lengths", F.lit(f)), F.lit(0))) for f in fields]
    return scorer.score_fields(counted, average, F.lit(index.doc_count), F.lit(df))
