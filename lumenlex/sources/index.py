"""Building, storing and opening an inverted index.

An index is four tables: ``postings`` (field_id, term, doc_id, term_freq,
doc_len), laid out by term so that Parquet prunes to a query's terms; ``terms``
(field_id, term, doc_freq, first_doc), the dictionary, laid out alike;
``documents`` (doc_id, lengths), the universe with each field's length; and
``stats`` (field_id, doc_count, total_terms).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.errors import DuplicateDocument, MissingAnalyzer, StoredIndexError, UnknownField
from lumenlex.functions.analysis import MAX_FIELDS, Analyzer
from lumenlex.storage import Scratch, fresh_path


@dataclass(frozen=True)
class Field:
    """A field by id, with an analyzer and perhaps a name that queries may use."""

    id: int
    name: str | None = None
    analyzer: Analyzer = Analyzer()

    def __post_init__(self) -> None:
        if not 0 <= self.id < MAX_FIELDS:
            raise ValueError(f"field ids are from 0 to {MAX_FIELDS - 1}")


def field_values(docs: DataFrame, key: str, values: Mapping[int, Column | str]) -> DataFrame:
    """(doc_id, field_id, value) of a table with a row for each document; a null value is an absent field.

    Raises DuplicateDocument if a key repeats.
    """
    twice = docs.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise DuplicateDocument(twice[0][key])
    cells = [F.struct(F.lit(i).alias("field_id"), (F.col(v) if isinstance(v, str) else v).cast("string").alias("value")) for i, v in values.items()]
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.inline(F.array(*cells)))


class Index:
    def __init__(self, fields: Sequence[Field], postings: DataFrame, terms: DataFrame, documents: DataFrame, stats: DataFrame, path: str):
        self.fields = {f.id: f for f in fields}
        self.names = {f.name: f.id for f in fields if f.name is not None}  # of fields with one name the last has it
        self.postings, self.terms, self.documents, self.stats, self.path = postings, terms, documents, stats, path
        rows = stats.orderBy("field_id").collect()  # a row for each field
        self.field_stats = {r.field_id: (r.doc_count, r.total_terms) for r in rows if r.field_id is not None}
        self.doc_count = next((r.doc_count for r in rows if r.field_id is None), 0)

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    @property
    def default_fields(self) -> list[int]:
        """Fields with values, else the named ones in order of name."""
        return sorted(self.field_stats) or [self.names[n] for n in sorted(self.names)]

    def resolve(self, field: str | int) -> int:
        """A name, or the id of a field as it is."""
        found = self.names.get(field) if isinstance(field, str) else field if field in self.fields else None
        if found is None:
            raise UnknownField(field)
        return found

    def average_length(self, field: int) -> float:
        """Mean length over the documents that carry the field, in 32 bits."""
        n, total = self.field_stats.get(field, (0, 0))
        return float(np.float32(total) / np.float32(n)) if n else 0.0

    def lookup(self, field: str | int, text: str) -> DataFrame:
        """Postings of one term; none if the text is not exactly one term."""
        field = self.resolve(field)
        terms = self.fields[field].analyzer.terms(text)
        return self.postings.where((F.col("field_id") == field) & (F.col("term") == terms[0] if len(terms) == 1 else F.lit(False)))

    @property
    def lengths(self) -> DataFrame:
        """(doc_id, field_id, length) of each present field."""
        return self.documents.select("doc_id", F.explode("lengths").alias("field_id", "length"))


#: Tokens that are counted at once inside an Arrow batch.
SLICE_TOKENS = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (doc_id, field_id, present, terms) rows, and for each row one without a term: term_freq 1 if it has a value, doc_len its length.

    A slice of rows leaves in the order of terms, so that the sort that follows merges runs.
    """
    names = ["field_id", "term", "doc_id", "term_freq", "doc_len"]
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        low = 0
        while low < batch.num_rows:
            before = ends[low] - sizes[low]
            high = max(low + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, side="right")))
            rows, size = batch.slice(low, high - low), sizes[low:high]
            low = high
            docs, fields = rows.column("doc_id"), rows.column("field_id")
            yield pa.RecordBatch.from_arrays([fields, pa.nulls(len(size), pa.string()), docs, rows.column("present").cast(pa.int32()), pa.array(size.astype(np.int32))], names)
            tokens = rows.column("terms").flatten()  # of lists that are not null
            if not len(tokens):
                continue
            coded = tokens.dictionary_encode()
            by_term = pc.sort_indices(coded.dictionary.cast(pa.binary()))  # in order of bytes, as Spark has it
            rank = np.empty(len(by_term), np.int64)
            rank[by_term.to_numpy()] = np.arange(len(by_term))
            by_row = np.lexsort((pc.fill_null(docs, -(1 << 63)).to_numpy(), fields.to_numpy()))
            place = np.empty(len(by_row), np.int64)
            place[by_row] = np.arange(len(by_row))
            held, counts = np.unique(rank[coded.indices.to_numpy()] * len(size) + np.repeat(place, size), return_counts=True)
            of = pa.array(by_row[held % len(size)])
            term = coded.dictionary.take(by_term).take(pa.array(held // len(size)))
            yield pa.RecordBatch.from_arrays([fields.take(of), term, docs.take(of), pa.array(counts.astype(np.int32)), pa.array(size.astype(np.int32)).take(of)], names)


def build_index(values: DataFrame, fields: Sequence[Field], path: str | None = None) -> Index:
    """An index of (doc_id, field_id, value) rows, written to ``path`` or the shared folder.

    Null values are absent fields and empty ones have length 0; values that
    repeat a document's field are merged.  Texts are analysed once, and terms
    counted inside each row's batch before anything is shuffled.  The postings of a term that a large
    share of the corpus has are split over several partitions and files.
    """
    spark = values.sparkSession
    path = path or fresh_path(spark, "index")
    values = values.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("field_id").cast("int").alias("field_id"), F.col("value").cast("string").alias("value"))
    known = {f.id for f in fields}
    for r in values.select("field_id").distinct().limit(MAX_FIELDS + 1).collect():
        if r.field_id not in known:
            raise MissingAnalyzer(r.field_id)

    present = F.col("value").isNotNull()
    analyzers: dict[Analyzer, list[int]] = {}
    for f in fields:
        analyzers.setdefault(f.analyzer, []).append(f.id)
    shares = [values.where(F.col("field_id").isin(ids)).select("doc_id", "field_id", present.alias("present"), a.column(F.col("value")).alias("terms")) for a, ids in analyzers.items()]
    with Scratch(spark, "postings") as tables:  # stored, as the sort samples it first
        stored = tables.table(reduce(DataFrame.union, shares).mapInArrow(_counted, "field_id int, term string, doc_id long, term_freq int, doc_len int"), "counted")
        cells = stored.where("term IS NULL").groupBy("doc_id", "field_id").agg(F.sum("term_freq").alias("rows"), F.sum("doc_len").cast("int").alias("length"))
        here = F.filter(F.collect_list(F.struct("field_id", "length", "rows")), lambda x: x["rows"] > 0)
        documents = cells.groupBy("doc_id").agg(F.map_from_entries(F.transform(here, lambda x: F.struct(x["field_id"], x["length"]))).alias("lengths"), (F.max("rows") > 1).alias("merged"))
        documents.write.parquet(f"{path}/documents")
        documents = spark.read.parquet(f"{path}/documents")
        postings = stored.where("term IS NOT NULL")
        if not documents.where("merged").isEmpty():
            lengths = documents.select("doc_id", F.explode("lengths").alias("field_id", "doc_len"))
            summed = postings.groupBy("field_id", "term", "doc_id").agg(F.sum("term_freq").cast("int").alias("term_freq"))
            postings = tables.table(summed.join(lengths, ["doc_id", "field_id"]).select("field_id", "term", "doc_id", "term_freq", "doc_len"), "merged")
        # By ranges that end inside a term as well, so that a frequent one fills several partitions. The term leads, as its first bytes decide most comparisons.
        order = ["term", "field_id", "doc_id"]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        postings.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(f"{path}/postings")
    terms = spark.read.parquet(f"{path}/postings").groupBy("field_id", "term").agg(F.count(F.lit(1)).alias("doc_freq"), F.min("doc_id").alias("first_doc"))
    terms.sortWithinPartitions("term", "field_id").write.parquet(f"{path}/terms")

    per_field = documents.select(F.explode("lengths").alias("field_id", "length")).groupBy("field_id").agg(F.count("*").alias("doc_count"), F.sum("length").alias("total_terms"))
    whole = documents.agg(F.lit(None).cast("int").alias("field_id"), F.count("*").alias("doc_count"), F.lit(0).cast("long").alias("total_terms"))
    per_field.unionByName(whole).coalesce(1).write.parquet(f"{path}/stats")
    return open_index(spark, path, fields)


def open_index(spark: SparkSession, path: str, fields: Sequence[Field], verify: bool = False) -> Index:
    """An index that was stored at ``path``.

    Raises StoredIndexError if a table or column is missing, and, with
    ``verify``, if the tables' totals do not agree.
    """
    wanted = {"postings": "field_id term doc_id term_freq doc_len", "terms": "field_id term doc_freq first_doc", "documents": "doc_id lengths", "stats": "field_id doc_count total_terms"}
    tables = {}
    for name, columns in wanted.items():
        try:
            tables[name] = spark.read.parquet(f"{path}/{name}").select(*columns.split())
        except AnalysisException as e:
            raise StoredIndexError(f"{path}/{name}: {e}") from e
    index = Index(fields, tables["postings"], tables["terms"], tables["documents"], tables["stats"], path)
    if missing := set(index.field_stats) - set(index.fields):
        raise MissingAnalyzer(min(missing))
    if verify:
        counted = dict(index.postings.groupBy("field_id").agg(F.sum("term_freq")).collect())
        for field, (_, total) in index.field_stats.items():
            if counted.get(field, 0) != total:
                raise StoredIndexError(f"field {field} has {counted.get(field, 0)} tokens in its postings, {total} in its statistics")
        if index.documents.count() != index.doc_count:
            raise StoredIndexError("documents and statistics differ in number")
    return index
