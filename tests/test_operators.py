import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenlex.functions.scoring import FLOAT_MAX, checked, combined, sat, some
from lumenlex.operators import postings
from lumenlex.operators.fusion import fuse
from lumenlex.operators.numbering import numbered, numbered_within
from lumenlex.storage import materialize


def lists(spark, rows):
    return spark.createDataFrame(rows, "list_id int, id string, rank int")


def test_rrf(spark):
    rows = [(0, "alpha", 1), (0, "beta", 2), (0, "gamma", 3), (1, "beta", 1), (1, "delta", 2), (1, "alpha", 3)]
    out = fuse(lists(spark, rows)).orderBy("rank").collect()
    assert [r.id for r in out] == ["beta", "alpha", "delta", "gamma"]
    assert out[0].score == 1 / 61 + 1 / 62 and [r.rank for r in out] == [1, 2, 3, 4]


def test_rrf_repeats_and_order(spark):
    rng = random.Random(4)
    rows = [(i, str(rng.randrange(40)), rng.randint(1, 49)) for i in range(5) for _ in range(19)]
    first = [tuple(r) for r in fuse(lists(spark, rows)).orderBy("rank").collect()]
    rng.shuffle(rows)
    assert [tuple(r) for r in fuse(lists(spark, rows)).orderBy("rank").collect()] == first
    best = {}
    for i, x, r in rows:
        best[i, x] = min(r, best.get((i, x), 99))
    want = {}
    for (_, x), r in sorted(best.items(), key=lambda kv: kv[1]):
        want[x] = want.get(x, 0.0) + 1.0 / (60.0 + r)
    assert {x: s for x, s, _ in first} == want


def test_rrf_limits(spark):
    assert fuse(lists(spark, [])).count() == 0
    for k in (0.0, -1.0, math.inf):
        with pytest.raises(ValueError):
            fuse(lists(spark, [(0, "a", 1)]), k)
    with pytest.raises(PySparkException):
        fuse(lists(spark, [(0, "a", 0)])).collect()


def test_saturation(spark):
    rows = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (1.5,), (1e300,)], "x double")
    assert [r[0] for r in rows.select(sat(F.col("x"))).collect()] == [0.0, pytest.approx(FLOAT_MAX), pytest.approx(-FLOAT_MAX), 1.5, pytest.approx(FLOAT_MAX)]
    with pytest.raises(ValueError):
        checked(math.nan)


def test_combined(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (0.0, 2.0), (0.0, 0.0)], "a float, b float")
    out = rows.select(combined(some(F.col("a")), 0.5, some(F.col("b")), 2.0).alias("s")).collect()
    assert [r.s for r in out] == [4.5, 0.5, 4.0, None]


def test_blocks_and_seek(spark):
    rows = spark.createDataFrame([(1, "a", 1, 3, 5), (1, "a", 3, 2, 7), (1, "a", 5, 1, 9)], "field_id int, term string, doc_id long, term_freq int, doc_len int")
    two = [tuple(r) for r in postings.posting_blocks(rows, 2).orderBy("block").collect()]
    assert two == [(1, "a", 0, 0, 2, 3, 3, 5), (1, "a", 1, 2, 3, 5, 1, 9)]
    assert postings.posting_blocks(rows, 0).count() == 3
    targets = spark.createDataFrame([(1, "a", t) for t in (0, 4, 5, 6)] + [(1, "b", 0)], "field_id int, term string, target long")
    found = {(r.term, r.target): (r.doc_id, r.term_freq) for r in postings.seek(rows, targets).collect()}
    assert found == {("a", 0): (1, 3), ("a", 4): (5, 1), ("a", 5): (5, 1), ("a", 6): (None, 0), ("b", 0): (None, 0)}


def test_seek_pairs_no_postings_with_targets(spark):
    """Every document as a target, over partition ends, terms without postings, repeats and nulls; no join by term."""
    rng = random.Random(5)
    held = [(f, t, d, rng.randint(1, 9)) for f in (1, 2) for t in ("a", "b") for d in range(0, 600, 2) if (t == "a" and rng.random() < 0.1) or (t == "b" and d > 550)]
    rows = spark.createDataFrame(held, "field_id int, term string, doc_id long, term_freq int").repartition(3)
    asked = [(f, t, d) for f in (1, 2) for t in ("a", "b", "none") for d in range(610)] + [(1, "a", 7), (1, "a", None), (None, "a", 1), (1, None, 1)]
    targets = spark.createDataFrame(asked, "field_id int, term string, target int")
    found = postings.seek(rows, targets)
    want = []
    for f, t, d in asked:
        after = [(x, n) for g, u, x, n in held if (g, u) == (f, t) and d is not None and x >= d]
        want.append((f, t, d, *(min(after) if after else (None, 0))))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert found.schema["target"].dataType.simpleString() == "int" and found.schema["term_freq"].dataType.simpleString() == "int"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(doc_id" not in plan and "Join Inner, ((field_id" not in plan
    assert postings.seek(rows.limit(0), targets).where("doc_id IS NOT NULL").count() == 0 and postings.seek(rows, targets.limit(0)).count() == 0


def test_dictionary_and_last_wins(spark):
    rows = spark.createDataFrame([(2, "b", 1), (1, "z", 1), (1, "a", 1), (1, "a", 0), (1, "m", 0)], "field_id int, term string, doc_id long")
    out = {(r.field_id, r.term): (r.term_id, r.doc_freq) for r in postings.term_dictionary(rows).collect()}
    assert out == {(1, "a"): (0, 2), (1, "m"): (1, 1), (1, "z"): (2, 1), (2, "b"): (3, 1)}
    puts = spark.createDataFrame([("t", 1, 4, 0), ("t", 1, 9, 1), ("t", 2, 1, 0)], "term string, doc_id long, term_freq int, ordinal int")
    assert {(r.term, r.doc_id, r.term_freq) for r in postings.posting_list(puts).collect()} == {("t", 1, 9), ("t", 2, 1)}


def test_numbering_inside_groups(spark):
    """One group has half of the rows."""
    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") * 3 % 3001).alias("k"))
    seen = {}
    for r in sorted(numbered_within(rows, ["g"], "k", "n").collect(), key=lambda r: (r.g, r.k)):
        assert r.n == seen.get(r.g, 0)
        seen[r.g] = r.n + 1
    assert sum(seen.values()) == 3000 and numbered_within(rows.limit(0), ["g"], "k", "n").count() == 0


def test_offsets_are_the_broadcast_side(spark):
    plan = numbered(spark.range(1000), [F.desc("id")], "n")._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_numbering(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id"))
    out = numbered(rows, [F.desc("k")], "n", start=5).orderBy("n").collect()
    assert [r.n for r in out] == list(range(5, 1005)) and [r.k for r in out] == sorted((r.k for r in out), reverse=True)
    assert numbered(rows.limit(0), [F.col("k")], "n").count() == 0


def test_blocks_of_a_term_over_many_partitions(spark):
    """Half of the rows are of one term; blocks go over partition ends, and nothing but a partition's ends is shuffled after the sort."""
    rng = random.Random(6)
    held = [(1, "the", d, rng.randint(1, 9), rng.randint(9, 99)) for d in range(0, 900, 3)] + [(f, f"w{rng.randrange(40)}", d, rng.randint(1, 9), 50) for f in (1, 2) for d in range(150)]
    held = sorted({x[:3]: x for x in held}.values())
    rows = spark.createDataFrame(held, "field_id int, term string, doc_id long, term_freq int, doc_len int").repartition(5)
    for size in (1, 2, 7, 1000):
        want = []
        for f, t in sorted({x[:2] for x in held}):
            own = [x for x in held if x[:2] == (f, t)]
            want += [(f, t, i // size, i, min(i + size, len(own)), own[i : i + size][-1][2], max(x[3] for x in own[i : i + size]), min(x[4] for x in own[i : i + size])) for i in range(0, len(own), size)]
        blocks = postings.posting_blocks(rows, size)
        assert sorted(map(tuple, blocks.collect())) == want
    assert "row_number" not in blocks._jdf.queryExecution().optimizedPlan().toString() and postings.posting_blocks(rows.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 64])
def test_seek_stores_only_the_terms_it_is_asked_for(spark, monkeypatch, few):
    sizes = []
    monkeypatch.setattr(postings, "FEW", few, raising=False)
    monkeypatch.setattr(postings, "materialize", lambda df, label: sizes.append((label, df.count())) or materialize(df, label))
    rows = spark.createDataFrame([(1, t, d, 1) for t in "abcdefgh" for d in range(50)], "field_id int, term string, doc_id long, term_freq int")
    targets = spark.createDataFrame([(1, "c", 7), (1, "none", 3)], "field_id int, term string, target long")
    assert sorted(map(tuple, postings.seek(rows, targets).collect())) == [(1, "c", 7, 7, 1), (1, "none", 3, None, 0)]
    assert sizes[0] == ("unsought", 52)
