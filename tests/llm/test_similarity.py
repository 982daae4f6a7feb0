"""Near duplicates and top-k search against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlex import storage
from lumenlex.llm import near_dedup, topk_search
from lumenlex.storage import Scratch


def components(rows, words):
    """Smallest key of each row's component, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(k, low.get(find(i), k))
    return [(k, len(s), low[find(i)] if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Straße", "x y"]
    passage = " ".join(rng.choices(vocabulary, k=50))
    out = [None, "", " \n", "one", "ONE", "one two", "One  Two\n", "é", "É", "a b c", "a b c d e f g h i j", "a b c d e f g h i j k"]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(3, 400))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    chain = rng.choices(vocabulary, k=120)
    for _ in range(12):  # each near the one before, the last far from the first
        chain = list(chain)
        for _ in range(5):
            chain[rng.randrange(len(chain))] = f"new{rng.randrange(9999)}"
        out.append(" ".join(chain))
    out += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(5, 80))) for _ in range(25)]
    hot = rng.choices(vocabulary, k=90)
    for _ in range(40):  # many copies, of which some pairs are near and some are not
        copy = list(hot)
        for _ in range(rng.randint(1, 8)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(99999)}"
        out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("words", "k", "an_entry"), [(2, 128, 2), (2, 128, 0), (5, 128, 2), (5, 32, 0)])
def test_near_duplicates(spark, monkeypatch, words, k, an_entry):
    monkeypatch.setattr(near_dedup, "PAIRS_AN_ENTRY", an_entry)
    monkeypatch.setattr(near_dedup, "FIRST_OF", 1 + an_entry)  # all lists have centres, or one in three
    rows = corpus(words + k)
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, uid int, node int, root int").repartition(3)
    out = near_dedup.near_duplicates(docs, words, k=k).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(components(rows, words))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


@pytest.mark.parametrize("words", [2, 5])
def test_documents_with_default_parameters(spark, words):
    """All pairs of a whole table, with the parameters as shipped: every link is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = near_dedup.near_duplicates(docs, words).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(components(rows, words))


def test_half_of_the_rows_alike(spark):
    """One text, near copies of it, and empty texts, each on many rows."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(500)] + [(500 + i, " ".join([*base[:i], f"n{i}", *base[i + 1 :]])) for i in range(100)] + [(600 + i, "") for i in range(300)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.component_id for r in out if r.doc_id < 600} == {0} and all(r.kept for r in out if r.doc_id >= 600) and sum(r.kept for r in out) == 301


def test_repeated_and_null_keys(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, "other text"), (1, "other text"), (2, long + " more"), (None, long + " more words"), (None, None)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in out) == [(0, 0, 0, True), (0, 61, 1, False), (1, 1, 1, True), (1, 1, 1, True), (1, 59, 1, True), (2, 60, 1, False)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 2).count() == 0


def best(rows, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints.setdefault(i, []).append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for q in ints:
        if q % 10:
            continue
        query = min(ints[q])
        scored = sorted((-sum(a * b for a, b in zip(query, v, strict=False)), i) for i, vs in ints.items() if i != q for v in vs)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["unit", "norms", "ties"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 12))
    if kind == "unit":
        v /= np.linalg.norm(v, axis=1)[:, None]
    elif kind == "norms":
        v *= rng.lognormal(0, 1.5, 400)[:, None]
    else:
        v = rng.integers(-1, 2, (400, 12)) / 4
        v[:150] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [float("nan")] * 12), (502, [None] + [1.0] * 11), (503, [float("inf")] * 12), (None, [1.0] * 12), (510, []), (20, v[3].tolist())]
    frame = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<float>, id int, score int")
    out = topk_search.top_k(frame, F.col("vec_id") % 10 == 0, block_size=64, query_block=16)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()) == best(rows, 5)


def taken(v, rows):
    """Share of all products that a block of queries computes, blocks of 64 vectors in descending length."""
    v = np.floor(256 * v)
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    ids, first = np.arange(len(v)), topk_search.Search(np.arange(0, len(v), rows), v[::rows], 5)
    first.visit(ids[:64], v[:64])
    search = topk_search.Search(first.ids, first.queries, 5, first.threshold)
    for i in range(0, len(v), 64):
        if np.linalg.norm(v[i]) >= first.reach():
            search.visit(ids[i : i + 64], v[i : i + 64])
    full = first.queries @ v.T
    full[np.arange(len(first.ids)), first.ids] = -np.inf
    for q in range(len(first.ids)):
        assert search.best[q][0].tolist() == sorted(full[q], reverse=True)[:5]
    return search.taken / full.size


def test_products_taken():
    """Lengths that differ let most products go untaken; of vectors of one length and low cosines all are taken."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 16))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert taken(unit * rng.lognormal(0, 1, 3000)[:, None], 50) < 0.35
    near = np.repeat(unit[:300], 10, axis=0) + rng.normal(0, 0.01, (3000, 16))
    assert taken(near, 50) < 0.6
    assert taken(unit, 50) <= 1


def test_top_k_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 768 + 512 * 1024)]
    assert topk_search.top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_components_hold_fewer_links_each_time(spark, monkeypatch):
    """Against union by hand: chains in and out of order, stars and random links, in two rounds; all steps hold few more links than there are."""
    rng = random.Random(8)
    chain, mixed = list(range(1000, 1040)), rng.sample(range(2000, 2040), 40)
    links = [*zip(chain[1:], chain, strict=False), *zip(mixed[1:], mixed, strict=False), *((x, 1) for x in range(2, 90)), *((rng.randrange(3000, 3060), rng.randrange(3000, 3060)) for _ in range(40))]
    links = [(max(x), min(x)) for x in links if x[0] != x[1]]
    rng.shuffle(links)
    rows, table = [], Scratch.table

    def counted(self, df, label):
        out = table(self, df, label)
        rows.append(out.count() if label == "edges" else 0)
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    with Scratch(spark, "test") as tables:
        labels = near_dedup.components(spark.createDataFrame(links[:100], "a long, b long"), None, tables)
        labels = near_dedup.components(spark.createDataFrame(links[100:], "a long, b long"), labels, tables)
        found = {r.node: r.root for r in labels.collect()}
    want = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    assert found == want and sum(rows) < 2 * len(links)


def test_small_sets_that_share_just_enough(spark):
    """Sets of 8 to 14 words, one of them replaced or left out: often five values are all that the first ones of two sets share."""
    rows = []
    for i in range(600):
        base = [f"b{i}x{j}" for j in range(8 + i % 7)]
        at = i % len(base)
        other = [*base[:at], *[f"n{i}"] * (i % 2 and len(base) > 8), *base[at + 1 :]]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=1).collect()
    assert [r.doc_id for r in out if r.component_id != r.doc_id - r.doc_id % 2] == []


def test_lists_that_met_in_one_part_are_done(spark, monkeypatch):
    """The last round holds no list of which all members met in the round of parts."""
    monkeypatch.setattr(near_dedup, "PAIRS_AN_ENTRY", 0)
    sizes, table = [], Scratch.table

    def seen(self, df, label):
        out = table(self, df, label)
        if label == "members":
            sizes.append(out.groupBy("list").count().agg(F.min("count")).first()[0])
        return out

    monkeypatch.setattr(Scratch, "table", seen)
    rows = corpus(7)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(components(rows, 2))
    assert sizes[0] <= near_dedup.MEET and all(x > near_dedup.MEET for x in sizes[1:])


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    """Shuffle files of a table go when it is stored; the session's own setting stays."""
    setting = spark.conf.get(storage.CLEANUP)

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    with Scratch(spark, "test") as tables:
        tables.table(spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count(), "x")
        assert not files() - before
    assert spark.conf.get(storage.CLEANUP) == setting
