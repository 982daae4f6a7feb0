import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlex.errors import DuplicateDocument, InvalidFieldWeight, MissingAnalyzer, MissingFilter, MissingScorer, ParseError, StoredIndexError, UnknownField, UnsupportedFilterPredicate
from lumenlex.functions.analysis import Analyzer, Normalizer, Tokenizer
from lumenlex.functions.scoring import BM25, BM25F, Combined
from lumenlex.operators import collect
from lumenlex.operators.predicates import AnyOf, Eq, In, NoneOf, Range
from lumenlex.operators.search import compiled, match
from lumenlex.plans.query import Constant, External, Or, Phrase, Term, Where, parse
from lumenlex.sources import index as sources
from lumenlex.sources.index import Field, build_index, field_values, open_index

TWO = (Field(1, "title"), Field(2, "body"))
f = np.float32


def build(spark, rows, fields=TWO):
    """rows: (doc_id, {field: value or list of values})."""
    flat = [(d, i, v) for d, vs in rows for i, x in vs.items() for v in (x if isinstance(x, list) else [x])]
    return build_index(spark.createDataFrame(flat, "doc_id long, field_id int, value string"), fields)


def hits(df):
    return [(r.doc_id, r.score) for r in df.collect()]


def ids(df):
    return [r.doc_id for r in df.collect()]


def bm25(tf, length, avg, n, df, k1=1.2, b=0.75):
    idf = f(math.log(f(f(f(f(n) - f(df)) + f(0.5)) / f(f(df) + f(0.5))) + f(1)))
    norm = f(f(1) - f(b)) + f(b) * f(f(length) / f(avg))
    return f(idf * f(f(f(tf) * f(f(k1) + f(1))) / f(f(tf) + f(k1) * norm)))


@pytest.fixture(scope="module")
def smoke(spark):
    rows = [
        (1, {1: "Rust Retrieval", 2: "Rust retrieval systems use inverted indices"}),
        (2, {1: "Memory Safety", 2: "Rust memory safety relies on ownership"}),
        (3, {1: "Search Engines", 2: "Search engines rank retrieval results with bm25"}),
        (4, {1: "Unicode Text", 2: "Unicode normalization and case folding improve search"}),
    ]
    return build(spark, rows)


def test_smoke(smoke):
    assert set(ids(collect.search(smoke, "rust"))) == {1, 2}
    assert set(ids(collect.search(smoke, "retrieval"))) == {1, 3}
    assert ids(collect.search(smoke, "unicode")) == [4]
    assert ids(collect.search(smoke, "title:rust OR body:retrieval")) == [1, 3]
    assert ids(collect.search(smoke, "title:rust OR body:retrieval", scorer=BM25F())) == [1, 3]


def test_known_scores(smoke):
    got = dict(hits(match(smoke, "body:rust")))
    avg = smoke.average_length(2)
    assert got == {1: pytest.approx(bm25(1, 6, avg, 4, 2), rel=1e-6), 2: pytest.approx(bm25(1, 6, avg, 4, 2), rel=1e-6)}
    weighted = dict(hits(match(smoke, "rust", BM25F(weights={1: 2.0, 2: 0.5}))))
    average = f(smoke.average_length(1)) + f(avg)
    assert weighted[1] == pytest.approx(bm25(2.5, 2 * 2 + 6 * 0.5, average, 4, 2), rel=1e-6)
    assert weighted[2] == pytest.approx(bm25(0.5, 2 * 2 + 6 * 0.5, average, 4, 2), rel=1e-6)


def test_implicit_and_is_and(spark):
    index = build(spark, [(1, {1: "new york"}), (2, {1: "new jersey"}), (3, {1: "york city"})])
    assert ids(collect.search(index, "new york")) == [1]
    assert hits(match(index, "new york")) == hits(match(index, "new AND york"))
    assert len(ids(match(index, "new OR york"))) == 3


def test_repeats_merge_and_unnamed_fields_are_searched(spark):
    index = build(spark, [(1, {3: ["rust rust", "rust"]}), (2, {3: "rust"})], (Field(3),))
    assert ids(collect.search(index, "rust")) == [1, 2]
    assert {(r.doc_id, r.term_freq, r.doc_len) for r in index.postings.collect()} == {(1, 3, 3), (2, 1, 1)}


def test_statistics_are_by_field(spark):
    index = build(spark, [(1, {1: "noise " * 8, 2: "alpha"}), (2, {1: "", 2: "alpha"})])
    scores = dict(hits(match(index, "body:alpha")))
    assert scores[1] == scores[2]
    assert index.average_length(1) == 4.0 and index.doc_count == 2


def test_ties_to_higher_ids(spark):
    index = build(spark, [(1, {1: "alpha"}), (10, {1: "alpha"})])
    assert ids(collect.search(index, "alpha", 1)) == [10]
    assert ids(collect.search(index, "alpha", 0)) == []


def test_not_constant_and_boost(spark):
    index = build(spark, [(1, {1: "alpha"}), (2, {1: "alpha beta"}), (3, {1: "gamma"})], (Field(1, "t"),))
    alone = dict(hits(match(index, "alpha")))
    assert hits(match(index, "alpha AND NOT beta")) == [(1, alone[1])]
    assert dict(hits(match(index, "alpha OR NOT beta"))) == {1: alone[1], 2: alone[2], 3: 0.0}
    assert dict(hits(match(index, "NOT beta"))) == {1: 0.0, 3: 0.0}
    assert dict(hits(match(index, Constant((parse("NOT beta"),), 7.5)))) == {1: 7.5, 3: 7.5}
    assert dict(hits(match(index, Constant((Term("alpha"),), math.nan)))) == {1: 0.0, 2: 0.0}
    assert dict(hits(match(index, Term("alpha", boost=2.0)))) == {k: pytest.approx(2 * v) for k, v in alone.items()}
    assert dict(hits(match(index, "alpha OR alpha"))) == {k: pytest.approx(2 * v) for k, v in alone.items()}
    assert hits(match(index, Term("alpha", boost=math.inf)))[0][1] == pytest.approx(3.4028235e38)


def test_unknown(smoke):
    assert hits(match(smoke, "nowhere")) == [] and hits(match(smoke, "body:nowhere")) == []
    assert set(ids(match(smoke, "NOT nowhere"))) == {1, 2, 3, 4}
    for query in ("nofield:rust", ":rust"):
        with pytest.raises(UnknownField):
            match(smoke, query)
    with pytest.raises(NotImplementedError):
        match(smoke, Phrase(("a", "b")))
    for weight in (-1.0, math.nan, math.inf):
        with pytest.raises(InvalidFieldWeight):
            match(smoke, "rust", BM25F(weights={1: weight}))


def test_zero_weights_still_match(smoke):
    assert dict(hits(match(smoke, "rust", BM25F(weights={1: 0.0, 2: 0.0})))) == {1: 0.0, 2: 0.0}


def test_field_analyzers_and_fallback(spark):
    fields = (Field(1, "title"), Field(2, "body", Analyzer((Normalizer("NFC", "fold"),))))
    index = build(spark, [(1, {1: "Straße", 2: "STRASSE"}), (2, {1: "strasse", 2: "weg"})], fields)
    assert set(ids(match(index, "STRASSE"))) == {1, 2}
    separate = dict(hits(match(index, "title:straße OR body:straße")))
    assert dict(hits(match(index, "straße", BM25F()))) == separate  # the fields' terms differ, so scores are added


def test_filters(spark, smoke):
    some = spark.createDataFrame([(1,), (2,), (2,)], "doc_id long")
    free = dict(hits(match(smoke, "rust OR search")))
    assert dict(hits(match(smoke, "rust OR search", filters={0: some}))) == {k: v for k, v in free.items() if k < 3}
    assert ids(match(smoke, "rust", filters={0: some, 5: lambda d: d >= 2})) == [2]
    assert set(ids(match(smoke, Or((External((Term("rust"),), 0), Term("search"))), filters={0: lambda d: d == 2}))) == {2, 3, 4}
    with pytest.raises(MissingFilter):
        match(smoke, External((Term("rust"),), 9))


def test_structured_predicates(spark, smoke):
    query = Where((Term("rust"),), AnyOf((Eq("kind", "a"), Range("size", 5), NoneOf(In("size", (1, 2, 9))))))
    with pytest.raises(UnsupportedFilterPredicate):
        match(smoke, query)
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "doc_id long, kind string, size int")
    assert ids(match(smoke, query, attributes=table)) == [1]


def test_collectors(smoke):
    best, number = collect.run(smoke, "rust OR search", [collect.TopK(2), collect.Count()])
    assert len(ids(best)) == 2 and number.first().matches == 4
    assert collect.count(smoke, "NOT rust").first().matches == 2
    with pytest.raises(MissingScorer):
        collect.run(smoke, "rust", [collect.TopK(2)], scorer=None)
    assert collect.statistics(smoke, "rust", 1)["skipped_blocks"] == 0
    assert collect.statistics(smoke, "rust", 1, scorer=None)["scored_postings"] == 0
    assert collect.TopK(2).min_score(match(smoke, "rust")) is not None and collect.TopK(3).min_score(match(smoke, "rust")) is None


def test_many_terms_equal_few(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    index = build(spark, [(d, {1: " ".join(rng.choices(words, k=30))}) for d in range(30)], (Field(1, "t"),))
    wide = dict(hits(match(index, Or(tuple(map(Term, words))))))
    some = {}
    for w in words:
        for d, s in hits(match(index, w)):
            some[d] = f(some.get(d, f(0)) + f(s))
    assert wide == {d: pytest.approx(s, rel=1e-6) for d, s in some.items()}


def test_random_boolean(spark):
    rng = random.Random(11)
    names = ["alpha", "beta", "gamma"]
    docs = {d: {w for w in names if rng.random() < 0.4} for d in range(60)}
    index = build(spark, [(d, {1: " ".join(sorted(ws))}) for d, ws in docs.items()], (Field(1, "t"),))
    cases = {
        "alpha AND beta": lambda w: {"alpha", "beta"} <= w,
        "alpha OR beta": lambda w: bool(w & {"alpha", "beta"}),
        "NOT gamma": lambda w: "gamma" not in w,
        "alpha AND NOT beta OR gamma": lambda w: "alpha" in w and "beta" not in w or "gamma" in w,
        "NOT alpha beta": lambda w: not {"alpha", "beta"} <= w,
        "NOT NOT alpha OR NOT t:beta": lambda w: "alpha" in w or "beta" not in w,
    }
    for query, test in cases.items():
        assert set(ids(match(index, query))) == {d for d, w in docs.items() if test(w)}, query
        assert set(ids(match(index, query, scorer=None))) == {d for d, w in docs.items() if test(w)}


def test_empty_corpora(spark):
    blank = build(spark, [(1, {1: ""}), (2, {1: " "})], (Field(1, "t"),))
    assert hits(match(blank, "x")) == [] and set(ids(match(blank, "NOT x"))) == {1, 2}
    none = build(spark, [], (Field(1, "t"),))
    assert hits(match(none, "x")) == [] and none.doc_count == 0
    with pytest.raises(ParseError):
        match(build(spark, [], (Field(1),)), "x")


def test_null_is_absent(spark):
    index = build(spark, [(1, {1: None, 2: "x"}), (2, {1: None, 2: None})])
    assert index.field_stats == {2: (1, 1)} and index.doc_count == 2


def test_building_errors(spark):
    with pytest.raises(MissingAnalyzer):
        build(spark, [(7, {9: "x"})])
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, t string")
    with pytest.raises(DuplicateDocument):
        field_values(twice, "id", {1: "t"})
    with pytest.raises(ValueError):
        Field(1024)


def test_stored_index(spark, smoke, tmp_path):
    again = open_index(spark, smoke.path, TWO, verify=True)
    assert hits(collect.search(again, "rust")) == hits(collect.search(smoke, "rust"))
    with pytest.raises(StoredIndexError):
        open_index(spark, str(tmp_path), TWO)
    for t in ("documents", "stats"):
        spark.read.parquet(f"{smoke.path}/{t}").write.parquet(f"{tmp_path}/i/{t}")
    spark.read.parquet(f"{smoke.path}/postings").where("term <> 'rust'").write.parquet(f"{tmp_path}/i/postings")
    with pytest.raises(StoredIndexError):
        open_index(spark, f"{tmp_path}/i", TWO, verify=True)


def test_parameters():
    for k1, b in ((-1, 0.5), (math.inf, 0.5), (1, 1.5)):
        with pytest.raises(ValueError):
            BM25(k1, b)


def test_scorer_shape(spark):
    """Finite, rising with the count, falling with length and document frequency; 0 for impossible statistics."""
    rows = spark.createDataFrame([(t, n, d) for t in (0, 1, 5, 40) for n in (1, 50, 400) for d in (0, 1, 30, 99, 101)], "tf int, len int, df int")
    scored = rows.withColumn("s", BM25().score(F.col("tf"), F.col("len"), F.lit(60.0), F.lit(100), F.col("df"))).collect()
    s = {(r.tf, r.len, r.df): r.s for r in scored}
    assert all(math.isfinite(x) and x >= 0 for x in s.values())
    assert all(s[k] == 0 for k in s if k[0] == 0 or k[2] in (0, 101))
    assert s[1, 50, 30] < s[5, 50, 30] < s[40, 50, 30]
    assert s[5, 1, 30] > s[5, 50, 30] > s[5, 400, 30]
    assert s[5, 50, 1] > s[5, 50, 30] > s[5, 50, 99]
    dead = spark.range(1).select(*(BM25().score(F.lit(1), F.lit(1), F.lit(a), F.lit(n), F.lit(1)).alias(c) for c, a, n in (("a", 0.0, 1), ("b", math.nan, 1), ("c", math.inf, 1), ("d", 1.0, 0)))).first()
    assert tuple(dead) == (0.0, 0.0, 0.0, 0.0)


class Constantly:
    """A scorer of one's own: no score for documents of one token, else their count over their length."""

    name = "own"

    def score(self, tf, length, avg, n, df):
        return F.when(length > 1, tf / length)


def test_own_scorers(smoke, spark):
    index = build(spark, [(1, {1: "a"}), (2, {1: "a a b c"}), (3, {1: "b b"})], (Field(1, "t"),))
    assert hits(collect.search(index, "a OR b", scorer=Constantly())) == [(3, 1.0), (2, 0.75), (1, 0.0)]
    assert set(ids(match(index, "a", scorer=Constantly()))) == {1, 2}

    class Odd(Constantly):
        def score(self, tf, length, avg, n, df):
            return F.when(length > 1, F.lit(float("inf"))).otherwise(F.lit(float("nan")))

    assert hits(collect.search(index, "a", scorer=Odd())) == [(2, pytest.approx(3.4028235e38)), (1, 0.0)]


def test_combined_scorers(smoke):
    first, second = BM25(), BM25(2.0, 0.5)
    one, two, both = (dict(hits(match(smoke, "body:rust OR title:rust", s))) for s in (first, second, Combined(first, 0.7, second, 0.3)))
    assert both.keys() == one.keys() and all(both[d] == pytest.approx(0.7 * one[d] + 0.3 * two[d], rel=1e-5) for d in one)
    nested = dict(hits(match(smoke, "body:rust", Combined(Combined(first, 0.5, second, 0.5), 1.0, Constantly(), 2.0))))
    assert nested[1] == pytest.approx(0.5 * bm25(1, 6, smoke.average_length(2), 4, 2) + 0.5 * bm25(1, 6, smoke.average_length(2), 4, 2, 2.0, 0.5) + 2 / 6, rel=1e-5)


def test_a_plan_runs_again(smoke, spark):
    plan = compiled(smoke, "rust OR title:search")
    for scorer in (BM25(), BM25(2.0, 0.5), BM25F(weights={1: 2.0}), None):
        assert sorted(match(smoke, plan, scorer).collect()) == sorted(match(smoke, "rust OR title:search", scorer).collect())
    some = spark.createDataFrame([(2,), (4,)], "doc_id long")
    assert ids(collect.search(smoke, plan, filters={0: some})) == [2] and set(ids(collect.search(smoke, plan))) == {1, 2, 3}
    assert plan.spread == {(0, 1): 2} or set(plan.spread.values()) == {2}
    assert collect.statistics(smoke, plan, 10)["scored_postings"] == 4


def test_own_tokenizers_and_normalizers(spark):
    letters = Tokenizer(lambda text: F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda text: re.findall("[A-Za-z]+", text))

    @dataclass(frozen=True)
    class Stem:
        whole_text = False

        def text(self, value):
            return value.removesuffix("s")

    fields = (Field(1, "t", Analyzer((Normalizer(), Stem()), letters)), Field(2, "u"))
    index = build(spark, [(1, {1: "cats,Dogs;bird", 2: "cats,dogs"}), (2, {1: "no-one", 2: "cat"})], fields)
    assert ids(match(index, "t:cat")) == [1] and ids(match(index, "t:BIRDS")) == [1] and ids(match(index, "u:cat")) == [2]
    assert index.field_stats == {1: (2, 5), 2: (2, 2)}


def test_dictionary_is_stored(smoke, spark, tmp_path):
    terms = {(r.field_id, r.term): r.doc_freq for r in smoke.terms.collect()}
    assert terms[2, "rust"] == 2 and terms[1, "rust"] == 1 and len(terms) == smoke.postings.select("field_id", "term").distinct().count()
    for t in ("documents", "stats", "postings"):
        spark.read.parquet(f"{smoke.path}/{t}").write.parquet(f"{tmp_path}/i/{t}")
    with pytest.raises(StoredIndexError):
        open_index(spark, f"{tmp_path}/i", TWO)


def test_frequent_terms_are_split(spark):
    """Half of all postings are of one term; its postings fill several files, and stay whole."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("field_id"), F.concat(F.lit("all w"), F.col("id").cast("string")).alias("value"))
    index = build_index(rows, (Field(1, "t"),))
    files = index.postings.where("term = 'all'").groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 20_000 and len(files) > 1


def test_terms_are_counted_before_any_shuffle(monkeypatch):
    """A row for each distinct term of a row, in order of terms within a slice, and one for the row itself."""
    monkeypatch.setattr(sources, "SLICE_TOKENS", 4)
    terms = [["b", "a", "b"], None, [], ["é", "a", "a", "z", "a", "\U0001f600", "\uffee"], ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array([5, None, 7, 8, 3]), pa.array([2, 1, 1, 1, 1], pa.int32()), pa.array([True, False, True, True, True]), pa.array(terms, pa.list_(pa.string()))], ["doc_id", "field_id", "present", "terms"])
    found = [b.to_pylist() for b in sources._counted(iter([batch]))]
    own = [tuple(x.values()) for b in found for x in b if x["term"] is None]
    assert own == [(2, None, 5, 1, 3), (1, None, None, 0, 0), (1, None, 7, 1, 0), (1, None, 8, 1, 7), (1, None, 3, 1, 1)]
    rest = [[tuple(x.values()) for x in b] for b in found if b[0]["term"] is not None]
    assert rest == [[(2, "a", 5, 1, 3), (2, "b", 5, 2, 3)], [(1, "a", 8, 3, 7), (1, "z", 8, 1, 7), (1, "é", 8, 1, 7), (1, "\uffee", 8, 1, 7), (1, "\U0001f600", 8, 1, 7)], [(1, "a", 3, 1, 1)]]
