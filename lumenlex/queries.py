"""Registered queries on the reference tables, with the SQL that must give the same rows.

Corpora: ``lead`` has two fields of ``documents`` (1 title: the first line,
2 body: the whole text); ``part`` has short, tie-heavy fields of ``part``
(1 title: p_name, 2 body: p_type); ``chat`` merges the turns of a conversation
by role (1 user, 2 assistant).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlex.functions import analysis, scoring
from lumenlex.functions.analysis import Analyzer, Normalizer, Tokenizer
from lumenlex.functions.scoring import BM25, BM25F, Combined
from lumenlex.operators import collect, fusion, postings
from lumenlex.operators.predicates import AllOf, Eq, Range
from lumenlex.operators.search import compiled, match
from lumenlex.plans.query import Constant, Or, Term, Where, parse
from lumenlex.sources.index import Field, Index, build_index, field_values, open_index

FIELDS = (Field(1, "title"), Field(2, "body"))
WEIGHTS = {1: 2.0, 2: 0.5}

#: Frequent words of the corpus, for a wide query.
WIDE = "the in en and to of a that with for on is was by at la le el les un los der die und de que une as or an from this are it he she you have not but".split()

_built: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "lead":
        return field_values(table(spark, sf_dir, "documents"), "doc_id", {1: F.split_part("text", F.lit("\n"), F.lit(1)), 2: "text"})
    if name == "part":
        return field_values(table(spark, sf_dir, "part"), "p_partkey", {1: "p_name", 2: "p_type"})
    turns = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "user", 1).otherwise(2).alias("field_id"), F.col("text").alias("value"))


def index(spark: SparkSession, sf_dir: str, name: str = "lead") -> Index:
    """The corpus's index, built once for a session and read from its files after that."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _built:
        return open_index(spark, _built[key], FIELDS)
    built = build_index(corpus(spark, sf_dir, name), FIELDS)
    _built[key] = built.path
    return built


def _search(query: str | Callable, name: str = "lead", scorer: BM25 | BM25F = BM25(), limit: int = 10, **options: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {k: v(spark, sf_dir) for k, v in options.items()}
        return collect.search(index(spark, sf_dir, name), query() if callable(query) else query, limit, scorer, **given)

    return run


def _labelled(condition: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, "labels").where(condition).select("doc_id")


def _ranked(spark: SparkSession, sf_dir: str, repeat: bool = False) -> DataFrame:
    """Top 20 lists of three queries, as (list_id, id, rank); ``repeat`` adds every id again with a worse rank."""
    best_first = Window.orderBy(F.desc("score"), F.desc("doc_id"))  # over a top-k result only
    lists = None
    for i, query in enumerate(("title:the", "the AND of", "in OR to")):
        best = collect.search(index(spark, sf_dir), query, 20)
        one = best.withColumn("rank", F.row_number().over(best_first)).select(F.lit(i).alias("list_id"), F.col("doc_id").cast("string").alias("id"), "rank")
        lists = one if lists is None else lists.union(one)
    return lists.union(lists.withColumn("rank", F.col("rank") + 7)) if repeat else lists


def tokenize_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with position and byte range."""
    rows = analysis.token_rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "position", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.col("text").alias("token"), "term")


def normalize_nfc_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", analysis.normalized(F.col("text")).alias("normal"), analysis.needs_normalize(F.col("text")).alias("changed"))


def normalize_nfkc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility forms and full folding of each term; not in SQL."""
    analyzer = Analyzer((Normalizer("NFKC", "fold"),))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(analyzer.column(F.col("text"))).alias("position", "term"))


def custom_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ASCII letters as tokens, lower-cased."""
    letters = Tokenizer(lambda text: F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda text: re.findall("[A-Za-z]+", text))
    terms = Analyzer((Normalizer(None, "lower"),), letters).column(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(terms).alias("position", "term"))


def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).postings.select("field_id", "term", "doc_id", "term_freq", "doc_len")


def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).stats.where("field_id IS NOT NULL").select("field_id", "doc_count", "total_terms")


def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).lengths


def repeated_field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "chat").postings.select("field_id", "term", "doc_id", "term_freq", "doc_len")


def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.term_dictionary(index(spark, sf_dir).terms)


def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.posting_blocks(index(spark, sf_dir).postings)


def posting_list_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the turns that use a word in a conversation, the last one's count."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.col("role"), F.explode(analysis.split(F.col("text"))).alias("term"))
    counts = words.groupBy("term", "doc_id", "ordinal").agg(F.count("*").alias("term_freq"))
    return postings.posting_list(counts).select("term", "doc_id", "term_freq")


def cursor_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each document on, the first one with "the" in its body."""
    i = index(spark, sf_dir)
    targets = i.documents.select(F.lit(2).alias("field_id"), F.lit("the").alias("term"), F.col("doc_id").alias("target"))
    return postings.seek(i.postings, targets)


def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).lookup("body", " The ").select("doc_id", "term_freq", "doc_len")


def segment_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index, opened and verified again: its counts."""
    i = index(spark, sf_dir)
    again = open_index(spark, i.path, FIELDS, verify=True)
    terms = again.postings.select("field_id", "term").distinct().agg(F.count("*").alias("terms"))
    return terms.select(F.lit(again.doc_count).alias("documents"), "terms", F.lit(len(again.field_stats)).alias("fields"))


def count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.count(index(spark, sf_dir), "the OR NOT of")


def topk_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, number = collect.run(index(spark, sf_dir), "the AND of", [collect.TopK(5), collect.Count()])
    return best.crossJoin(number)  # five rows and one


def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match with its score, no limit."""
    return match(index(spark, sf_dir), "title:the OR in AND NOT to")


def combined_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 of one scorer and 0.3 of another over the postings of a term; no score rather than 0."""
    i = index(spark, sf_dir)
    rows = i.lookup("body", "the")
    df = rows.count()
    args = (F.col("term_freq"), F.col("doc_len"), F.lit(i.average_length(2)), F.lit(i.doc_count), F.lit(df))
    score = scoring.combined(scoring.some(BM25().score(*args)), 0.7, scoring.some(BM25(2.0, 0.5).score(*args)), 0.3)
    return rows.select("doc_id", score.alias("score"))


def planned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan, run with two scorers."""
    i = index(spark, sf_dir)
    plan = compiled(i, "body:the AND body:of")
    runs = [collect.search(i, plan, 10, s).withColumn("run", F.lit(n)) for n, s in enumerate((BM25(), BM25(2.0, 0.5)))]
    return runs[0].union(runs[1])


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(_ranked(spark, sf_dir))


def rrf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(_ranked(spark, sf_dir, repeat=True))


def rrf_custom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(_ranked(spark, sf_dir), k=10.0)


def search_structured_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in: a predicate over labels and lengths as attributes."""
    query = Where((parse("the"),), AllOf((Eq("quality", 1), Range("n_chars", 500, 4000))))
    attributes = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return collect.search(index(spark, sf_dir), query, 10, attributes=attributes)


def search_wide_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disjunction over more terms than are pivoted."""
    return collect.search(index(spark, sf_dir), Or(tuple(Term(w, "body") for w in WIDE)), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_positions, normalize_nfc_lower, normalize_nfkc_fold, custom_tokenizer, build_postings, field_stats, field_lengths, repeated_field_merge, term_dictionary,
        posting_blocks, posting_list_last_wins, cursor_seek, term_lookup, segment_roundtrip, count_matches, topk_and_count, all_matches, combined_scorer, planned_once,
        rrf_fusion, rrf_dedup, rrf_custom_k, search_structured_filter, search_wide_or,
    )
}
QUERIES |= {
    "search_bm25_term": _search("body:the"),
    "search_bm25_fielded": _search("title:the"),
    "search_bm25_implicit_and": _search("body:the AND body:of AND body:in"),
    "search_bm25_or": _search("body:the OR body:la OR body:der"),
    "search_multi_field_bm25": _search("the"),
    "search_implicit_and_fields": _search("the of"),
    "search_bm25_and_not": _search("body:the AND NOT body:of"),
    "search_bm25_or_not": _search("body:la OR NOT body:the", limit=1000),
    "search_bare_not": _search("NOT body:the", limit=1000),
    "search_mixed_scope": _search("title:the AND of"),
    "search_unknown_term": _search("body:zzzunknown"),
    "search_repeated_term": _search("body:the OR body:the"),
    "search_bm25f": _search("the", scorer=BM25F()),
    "search_bm25f_weighted": _search("the", scorer=BM25F(weights=WEIGHTS)),
    "search_bm25f_fielded": _search("title:the OR body:of", scorer=BM25F(weights=WEIGHTS)),
    "search_bm25f_and": _search("the AND of", scorer=BM25F(weights=WEIGHTS)),
    "bm25_custom_params": _search("body:the", scorer=BM25(2.0, 0.5)),
    "search_combined": _search("body:the OR title:of", scorer=Combined(BM25(), 0.7, BM25(2.0, 0.5), 0.3)),
    "boosted_terms": _search(lambda: Or((Term("the", "body", 2.5), Term("of", "body")), boost=0.5)),
    "constant_score": _search(lambda: Constant((parse("body:the"),), 7.5)),
    "external_filter": _search("body:the", filters=lambda s, d: {0: _labelled("quality = 1")(s, d)}),
    "external_filter_chain": _search("body:the", filters=lambda s, d: {0: _labelled("quality = 1")(s, d), 1: _labelled("toxic = 0")(s, d)}),
    "topk_tie_break": _search("title:red OR body:economy", "part", limit=25),
    "search_merged_fields": _search("the", "chat"),
}

# ---- SQL -------------------------------------------------------------------------------------------

_VALUES = {
    "lead": "SELECT doc_id, 1 AS f, split_part(text, chr(10), 1) AS v FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 2, text FROM documents WHERE text IS NOT NULL",
    "part": "SELECT p_partkey AS doc_id, 1 AS f, p_name AS v FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part",
    "chat": "SELECT conv_id AS doc_id, CASE role WHEN 'user' THEN 1 ELSE 2 END AS f, text AS v FROM conversations WHERE role IN ('user', 'assistant')",
}


def _base(name: str = "lead", k1: float = 1.2, b: float = 0.75) -> str:
    return rf"""
    WITH v AS MATERIALIZED ({_VALUES[name]}),
    d AS MATERIALIZED (SELECT DISTINCT doc_id FROM v),
    t AS (SELECT doc_id, f, unnest(regexp_split_to_array(nfc_normalize(lower(nfc_normalize(v))), '[\s\p{{Z}}\x0b\x85]+')) AS term FROM v),
    p AS MATERIALIZED (SELECT f, term, doc_id, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL),
    l AS MATERIALIZED (SELECT c.doc_id, c.f, coalesce(sum(tf), 0)::BIGINT AS len FROM (SELECT DISTINCT doc_id, f FROM v) c LEFT JOIN p USING (doc_id, f) GROUP BY ALL),
    a AS (SELECT f, count(*) AS doc_count, sum(len)::BIGINT AS total, sum(len)::FLOAT / count(*)::FLOAT AS avg FROM l GROUP BY f),
    n AS (SELECT count(*)::FLOAT AS n FROM d),
    x AS (SELECT *, count(*) OVER (PARTITION BY f, term) AS df FROM p),
    s AS MATERIALIZED (
        SELECT doc_id, x.f, term, tf, len, {_bm25('tf::FLOAT', 'len::FLOAT', 'avg', 'df::FLOAT', k1, b)} AS score
        FROM x JOIN l USING (doc_id, f) JOIN a ON a.f = x.f, n
    )"""


def _bm25(tf: str, length: str, avg: str, df: str, k1: float = 1.2, b: float = 0.75) -> str:
    return (
        f"(ln((((n - {df}) + 0.5::FLOAT) / ({df} + 0.5::FLOAT) + 1::FLOAT)::DOUBLE)::FLOAT)"
        f" * (({tf} * ({k1}::FLOAT + 1::FLOAT)) / ({tf} + {k1}::FLOAT * ((1::FLOAT - {b}::FLOAT) + {b}::FLOAT * ({length} / {avg}))))"
    )


def _sql(leaves: dict[str, tuple[int, str]], matches: str, score: str, limit: int = 10, name: str = "lead", where: str = "", k1: float = 1.2, b: float = 0.75) -> str:
    """Top of the documents that meet ``matches``; each leaf has its score under its name, null where the term is absent."""
    joins = "".join(f" LEFT JOIN (SELECT doc_id, score AS {k} FROM s WHERE f = {f} AND term = '{t}') USING (doc_id)" for k, (f, t) in leaves.items())
    return f"{_base(name, k1, b)} SELECT doc_id, ({score})::FLOAT AS score FROM d{joins} WHERE ({matches}) {where} ORDER BY score DESC, doc_id DESC LIMIT {limit}"


def _has(*names: str, op: str = " AND ") -> str:
    return op.join(f"{x} IS NOT NULL" for x in names)


def _sum(*names: str) -> str:
    return "(" + " + ".join(f"coalesce({x}, 0::FLOAT)" for x in names) + ")"


def _by_fields(terms: dict[str, str], matches: str, weights: dict[int, float]) -> str:
    """BM25F of terms over both fields; ``terms`` names each one's score."""
    w1, w2 = weights.get(1, 1.0), weights.get(2, 1.0)
    joins = ""
    for k, t in terms.items():
        score = _bm25("wtf", "wlen", "avgs", "df::FLOAT")
        joins += f""" LEFT JOIN (
            SELECT doc_id, {score} AS {k} FROM (
                SELECT h.doc_id, (coalesce(p1.tf, 0)::FLOAT * {w1}::FLOAT) + (coalesce(p2.tf, 0)::FLOAT * {w2}::FLOAT) AS wtf,
                       (coalesce(l1.len, 0)::FLOAT * {w1}::FLOAT) + (coalesce(l2.len, 0)::FLOAT * {w2}::FLOAT) AS wlen,
                       (SELECT avg FROM a WHERE f = 1) + (SELECT avg FROM a WHERE f = 2) AS avgs, count(*) OVER () AS df
                FROM (SELECT DISTINCT doc_id FROM p WHERE term = '{t}') h
                LEFT JOIN p p1 ON p1.doc_id = h.doc_id AND p1.f = 1 AND p1.term = '{t}' LEFT JOIN p p2 ON p2.doc_id = h.doc_id AND p2.f = 2 AND p2.term = '{t}'
                LEFT JOIN l l1 ON l1.doc_id = h.doc_id AND l1.f = 1 LEFT JOIN l l2 ON l2.doc_id = h.doc_id AND l2.f = 2
            ), n) USING (doc_id)"""
    return f"{_base()} SELECT doc_id, {_sum(*terms)}::FLOAT AS score FROM d{joins} WHERE {matches} ORDER BY score DESC, doc_id DESC LIMIT 10"


def _lists(repeat: bool = False) -> str:
    def top(leaves: str, matches: str, score: str, i: int) -> str:
        return f"SELECT {i} AS list_id, doc_id::VARCHAR AS id, row_number() OVER (ORDER BY sc DESC, doc_id DESC) AS rank FROM (SELECT doc_id, ({score})::FLOAT AS sc FROM d{leaves} WHERE {matches}) QUALIFY rank <= 20"

    def leaf(k: str, f: int, t: str) -> str:
        return f" LEFT JOIN (SELECT doc_id, score AS {k} FROM s WHERE f = {f} AND term = '{t}') USING (doc_id)"

    both = [leaf("a1", 1, "the") + leaf("a2", 2, "the") + leaf("b1", 1, "of") + leaf("b2", 2, "of"), leaf("a1", 1, "in") + leaf("a2", 2, "in") + leaf("b1", 1, "to") + leaf("b2", 2, "to")]
    parts = f"{_sum('a1', 'a2')} + {_sum('b1', 'b2')}"
    rows = " UNION ALL ".join([top(leaf("a", 1, "the"), "a IS NOT NULL", "a", 0), top(both[0], "(a1 IS NOT NULL OR a2 IS NOT NULL) AND (b1 IS NOT NULL OR b2 IS NOT NULL)", parts, 1), top(both[1], "coalesce(a1, a2, b1, b2) IS NOT NULL", parts, 2)])
    return f"SELECT * FROM ({rows})" + (f" UNION ALL SELECT list_id, id, rank + 7 FROM ({rows})" if repeat else "")


def _fused(k: float = 60.0, repeat: bool = False) -> str:
    return f"""{_base()}, lists AS MATERIALIZED ({_lists(repeat)}), best AS (SELECT list_id, id, min(rank) AS rank FROM lists GROUP BY ALL),
    sums AS (SELECT id, list_reduce(list_prepend(0::DOUBLE, list_transform(list_sort(list(rank)), lambda r: 1::DOUBLE / ({k}::DOUBLE + r))), lambda p, q: p + q) AS score, min(rank) AS low FROM best GROUP BY id)
    SELECT id, score, (row_number() OVER (ORDER BY score DESC, low, id DESC))::INT AS rank FROM sums"""


_THE, _OF, _IN, _LA, _DER = (2, "the"), (2, "of"), (2, "in"), (2, "la"), (2, "der")
_BOTH_THE = {"a1": (1, "the"), "a2": (2, "the")}
_BOTH_OF = {"b1": (1, "of"), "b2": (2, "of")}
_QUALITY = "AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"

ORACLES: dict[str, str] = {
    "tokenize_positions": r"""
        WITH t AS (SELECT doc_id, unnest(string_split_regex(text, '[\s\p{Z}\x0b\x85]+')) AS token, generate_subscripts(string_split_regex(text, '[\s\p{Z}\x0b\x85]+'), 1) AS k, text FROM documents),
        g AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\s\p{Z}\x0b\x85]+|[^\s\p{Z}\x0b\x85]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[\s\p{Z}\x0b\x85]+|[^\s\p{Z}\x0b\x85]+'), 1) AS k FROM documents),
        e AS (SELECT doc_id, piece, k, sum(octet_length(encode(piece))) OVER (PARTITION BY doc_id ORDER BY k) AS end_byte, NOT regexp_full_match(piece, '[\s\p{Z}\x0b\x85]+') AS word FROM g)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS position, (end_byte - octet_length(encode(piece)))::INT AS start_byte, end_byte::INT AS end_byte,
               piece AS token, nfc_normalize(lower(nfc_normalize(piece))) AS term FROM e WHERE word""",
    "normalize_nfc_lower": "SELECT doc_id, nfc_normalize(lower(nfc_normalize(text))) AS normal, nfc_normalize(lower(nfc_normalize(text))) <> text AS changed FROM documents",
    "build_postings": _base() + " SELECT f AS field_id, term, doc_id, tf::INT AS term_freq, len::INT AS doc_len FROM s",
    "repeated_field_merge": _base("chat") + " SELECT f AS field_id, term, doc_id, tf::INT AS term_freq, len::INT AS doc_len FROM s",
    "field_stats": _base() + " SELECT f AS field_id, doc_count, total AS total_terms FROM a",
    "field_lengths": _base() + " SELECT doc_id, f AS field_id, len::INT AS length FROM l",
    "term_dictionary": _base() + ", g AS (SELECT f, term, count(*) AS df, min(doc_id) AS first FROM p GROUP BY ALL) SELECT f AS field_id, term, (row_number() OVER (ORDER BY first, f, term) - 1)::INT AS term_id, df AS doc_freq FROM g",
    "posting_blocks": _base()
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY f, term ORDER BY doc_id) - 1 AS pos FROM s)
        SELECT f AS field_id, term, (pos >> 1)::INT AS block, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end", max(doc_id) AS end_doc, max(tf)::INT AS max_term_freq, min(len)::INT AS min_doc_length FROM r GROUP BY f, term, pos >> 1""",
    "posting_list_last_wins": r"""
        WITH t AS (SELECT conv_id AS doc_id, turn, unnest(regexp_split_to_array(text, '[\s\p{Z}\x0b\x85]+')) AS term FROM conversations),
        c AS (SELECT term, doc_id, turn, count(*) AS term_freq FROM t WHERE term <> '' GROUP BY ALL)
        SELECT term, doc_id, term_freq FROM c QUALIFY row_number() OVER (PARTITION BY term, doc_id ORDER BY turn DESC) = 1""",
    "cursor_seek": _base()
    + """, g AS (SELECT doc_id AS target FROM d), m AS (SELECT target, min(doc_id) AS doc_id FROM g LEFT JOIN (SELECT doc_id FROM p WHERE f = 2 AND term = 'the') h ON h.doc_id >= target GROUP BY target)
        SELECT 2 AS field_id, 'the' AS term, target, m.doc_id, coalesce(tf, 0)::INT AS term_freq FROM m LEFT JOIN p ON p.doc_id = m.doc_id AND f = 2 AND term = 'the'""",
    "term_lookup": _base() + " SELECT doc_id, tf::INT AS term_freq, len::INT AS doc_len FROM s WHERE f = 2 AND term = 'the'",
    "segment_roundtrip": _base() + " SELECT (SELECT count(*) FROM d)::INT AS documents, (SELECT count(*) FROM (SELECT DISTINCT f, term FROM p)) AS terms, (SELECT count(*) FROM a)::INT AS fields",
    "count_matches": _base() + ", w AS (SELECT DISTINCT doc_id FROM p WHERE term = 'the'), o AS (SELECT DISTINCT doc_id FROM p WHERE term = 'of') SELECT count(*) AS matches FROM d WHERE doc_id IN (FROM w) OR doc_id NOT IN (FROM o)",
    "topk_and_count": f"SELECT *, (SELECT count(*) FROM ({_sql(_BOTH_THE | _BOTH_OF, '(a1 IS NOT NULL OR a2 IS NOT NULL) AND (b1 IS NOT NULL OR b2 IS NOT NULL)', '0', 1 << 40)})) AS matches FROM ({_sql(_BOTH_THE | _BOTH_OF, '(a1 IS NOT NULL OR a2 IS NOT NULL) AND (b1 IS NOT NULL OR b2 IS NOT NULL)', _sum('a1', 'a2') + ' + ' + _sum('b1', 'b2'), 5)})",
    "all_matches": _sql({"a": (1, "the"), "b1": (1, "in"), "b2": (2, "in"), "c1": (1, "to"), "c2": (2, "to")}, "a IS NOT NULL OR (coalesce(b1, b2) IS NOT NULL AND coalesce(c1, c2) IS NULL)", "coalesce(a, 0::FLOAT) + CASE WHEN coalesce(c1, c2) IS NULL THEN " + _sum("b1", "b2") + " ELSE 0::FLOAT END", 1 << 40),
    "combined_scorer": _base() + f""" SELECT doc_id, (score * 0.7::FLOAT) + (({_bm25('tf::FLOAT', 'len::FLOAT', 'avg', 'df::FLOAT', 2.0, 0.5)}) * 0.3::FLOAT) AS score FROM s JOIN a USING (f), n, (SELECT count(*) AS df FROM p WHERE f = 2 AND term = 'the') WHERE f = 2 AND term = 'the'""",
    "custom_tokenizer": "WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_type), '[a-z]+') AS a FROM part) SELECT p_partkey, (generate_subscripts(a, 1) - 1)::INT AS position, unnest(a) AS term FROM t",
    "planned_once": " UNION ALL ".join(f"SELECT *, {i} AS run FROM ({_sql({'a': _THE, 'b': _OF}, _has('a', 'b'), _sum('a', 'b'), k1=k1, b=b)})" for i, (k1, b) in enumerate(((1.2, 0.75), (2.0, 0.5)))),
    "rrf_fusion": _fused(),
    "rrf_dedup": _fused(repeat=True),
    "rrf_custom_k": _fused(10.0),
    "search_structured_filter": _sql(_BOTH_THE, "coalesce(a1, a2) IS NOT NULL", _sum("a1", "a2"), where=_QUALITY + " AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 4000)"),
    "search_wide_or": _sql({f"w{i}": (2, w) for i, w in enumerate(WIDE)}, _has(*(f"w{i}" for i in range(len(WIDE))), op=" OR "), _sum(*(f"w{i}" for i in range(len(WIDE))))),
    "search_bm25_term": _sql({"a": _THE}, _has("a"), "a"),
    "search_bm25_fielded": _sql({"a": (1, "the")}, _has("a"), "a"),
    "search_bm25_implicit_and": _sql({"a": _THE, "b": _OF, "c": _IN}, _has("a", "b", "c"), _sum("a", "b", "c")),
    "search_bm25_or": _sql({"a": _THE, "b": _LA, "c": _DER}, _has("a", "b", "c", op=" OR "), _sum("a", "b", "c")),
    "search_multi_field_bm25": _sql(_BOTH_THE, _has("a1", "a2", op=" OR "), _sum("a1", "a2")),
    "search_implicit_and_fields": _sql(_BOTH_THE | _BOTH_OF, "coalesce(a1, a2) IS NOT NULL AND coalesce(b1, b2) IS NOT NULL", _sum("a1", "a2") + " + " + _sum("b1", "b2")),
    "search_bm25_and_not": _sql({"a": _THE, "b": _OF}, "a IS NOT NULL AND b IS NULL", "a"),
    "search_bm25_or_not": _sql({"a": _LA, "b": _THE}, "a IS NOT NULL OR b IS NULL", _sum("a"), 1000),
    "search_bare_not": _sql({"a": _THE}, "a IS NULL", "0", 1000),
    "search_mixed_scope": _sql({"a": (1, "the")} | _BOTH_OF, "a IS NOT NULL AND coalesce(b1, b2) IS NOT NULL", "a + " + _sum("b1", "b2")),
    "search_unknown_term": _sql({"a": (2, "zzzunknown")}, _has("a"), "a"),
    "search_repeated_term": _sql({"a": _THE}, _has("a"), "a + a"),
    "search_bm25f": _by_fields({"a": "the"}, _has("a"), {}),
    "search_bm25f_weighted": _by_fields({"a": "the"}, _has("a"), WEIGHTS),
    "search_bm25f_fielded": _sql({"a": (1, "the"), "b": _OF}, _has("a", "b", op=" OR "), _sum("a", "b")),
    "search_bm25f_and": _by_fields({"a": "the", "b": "of"}, _has("a", "b"), WEIGHTS),
    "bm25_custom_params": _sql({"a": _THE}, _has("a"), "a", k1=2.0, b=0.5),
    "search_combined": _base()
    + f""", m AS (SELECT doc_id, f, term, (score * 0.7::FLOAT) + (({_bm25('tf::FLOAT', 'len::FLOAT', 'avg', 'df::FLOAT', 2.0, 0.5)}) * 0.3::FLOAT) AS c
            FROM s JOIN a USING (f) JOIN (SELECT f, term, count(*) AS df FROM p GROUP BY ALL) USING (f, term), n WHERE (f = 2 AND term = 'the') OR (f = 1 AND term = 'of'))
        SELECT doc_id, (coalesce(x.c, 0::FLOAT) + coalesce(y.c, 0::FLOAT))::FLOAT AS score
        FROM d LEFT JOIN (SELECT doc_id, c FROM m WHERE f = 2) x USING (doc_id) LEFT JOIN (SELECT doc_id, c FROM m WHERE f = 1) y USING (doc_id)
        WHERE x.c IS NOT NULL OR y.c IS NOT NULL ORDER BY score DESC, doc_id DESC LIMIT 10""",
    "boosted_terms": _sql({"a": _THE, "b": _OF}, _has("a", "b", op=" OR "), "(coalesce(a * 2.5::FLOAT, 0::FLOAT) + coalesce(b, 0::FLOAT)) * 0.5::FLOAT"),
    "constant_score": _sql({"a": _THE}, _has("a"), "7.5"),
    "external_filter": _sql({"a": _THE}, _has("a"), "a", where=_QUALITY),
    "external_filter_chain": _sql({"a": _THE}, _has("a"), "a", where=_QUALITY + " AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)"),
    "topk_tie_break": _sql({"a": (1, "red"), "b": (2, "economy")}, _has("a", "b", op=" OR "), _sum("a", "b"), 25, "part"),
    "search_merged_fields": _sql(_BOTH_THE, _has("a1", "a2", op=" OR "), _sum("a1", "a2"), name="chat"),
}
