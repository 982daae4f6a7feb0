"""Classifiers by held-out accuracy, and the pipeline's stages."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlex.llm import language_id, quality
from lumenlex.llm.held_out import held_out
from lumenlex.llm.queries import op2_language_id, op9_quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_languages_held_out(spark):
    rows = op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_without_letters_or_labels(spark):
    docs = spark.createDataFrame([(1, "hello there you", "en", "s", 1), (2, "hallo ihr da", "de", "s", 1), (3, None, "en", "s", 1), (4, "", None, "s", 1), (5, "12 34!", "en", "s", 1), (None, "x" * 100_000, None, "s", 1)], DOCS)
    model = language_id.fit(docs)
    out = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert out[1] == "en" and out[2] == "de" and out[3] == out[4] == out[5] == "und" and out[None] in ("en", "de")
    assert language_id.fit(docs.where("lang = 'xx'")) is None
    assert sorted(r.doc_id for r in language_id.keep_known(docs.where("doc_id IS NOT NULL"), model, 0.1).collect()) == [1, 2]
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_foreign_texts_go_and_clean_ones_stay(spark):
    """Scripts and languages that no training row has; all documents of the four languages stay."""
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
        "يولد جميع الناس أحرارًا متساوين في الكرامة والحقوق.",
        "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(-i, t * n, None, "s", 1) for i, (t, n) in enumerate(((t, n) for t in foreign for n in (1, 300)), 1)]
    out = corpus_pipeline.identify_language(spark, docs.union(spark.createDataFrame(rows, DOCS).select(*docs.columns)), SF)
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}


def test_kernel_counts_shared_ngrams():
    import pyarrow as pa

    rows = language_id.presence(pa.array(["abc", "ABC", "xyz", "", None]))
    assert (rows[0] == rows[1]).all() and rows[0].sum() == 6 and not (rows[0] & rows[2]).any() and rows[3].sum() == rows[4].sum() == 0


def test_quality_held_out(spark):
    rows = op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good plain words here" if i % 2 else "X!! Y!! %%%", None, "s", 1) for i in range(60)] + [(None, None, None, "s", 1), (99, "", None, "s", 1)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == 62 and all(0 <= r.score <= 1 for r in out)
    assert {r.predicted for r in out if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2} == {1}
    assert {r.predicted for r in out if r.doc_id is not None and r.doc_id < 60 and not r.doc_id % 2} == {0}
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and np.interp(2.5, x, y) == pytest.approx(0.5)


def test_held_out(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_stages(spark):
    words = " ".join(f"wort{i} und die" for i in range(60))
    rows = [
        (1, words, "de", "a", len(words)),
        (2, words.replace(" ", "\n"), "de", "b", len(words)),
        (3, words + " schluss", "de", "c", len(words) + 8),
        (4, "1234 !!", "de", "c", 7),
        (5, "this is the only text with password=hunter2hunter2 in it", "en", "d", 57),
        (6, None, None, None, None),
        (7, "this is the only text with password=hunter2hunter2 in it", "en", "d", 57),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        left.append(sorted(r.doc_id for r in docs.select("doc_id").distinct().collect()))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "secret_scan":
            assert docs.where("doc_id = 5").first().text == "this is the only text with [SECRET] in it"
    assert left == [[1, 2, 3, 5, 7], [1, 3, 5], [1, 5], [1, 5], [1, 5]]


def test_stages_with_repeated_rows_and_none(spark):
    rows = [(1, "this is the text of it", "en", "a", 1)] * 3 + [(1, "another text of the same key here", "en", "a", 1), (None, "no key at all here", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "no key at all here"), (1, "another text of the same key here"), (1, "this is the text of it")]
    assert len(corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def slots_of(text):
    """Slots of a text's n-grams, one n-gram at a time."""
    codes, out = [ord(c) for c in text.lower()], set()
    for n in language_id.LENGTHS:
        for i in range(len(codes) - n + 1):
            x = n * 0x165667B1 & 0xFFFFFFFF
            for c, m in zip(codes[i : i + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
                x = (x ^ c) * m & 0xFFFFFFFF
                x ^= x >> 15
            out.add(x >> 32 - 13)
    return out


def test_languages_against_a_direct_kernel(spark):
    """Scores of the fitted model against kernel ridge regression in the dual, with kernels of plain sets."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    words = {"aa": ["kala", "mitä", "olla", "yö"], "bb": ["the", "and", "cat", "you"], "cc": ["wir", "über", "haus", "ist"]}
    texts, labels = zip(*[(" ".join(rng.choice(w, 6)), x) for x, w in words.items() for _ in range(30)], strict=True)
    sets = [slots_of(t) for t in texts]
    rows = language_id.presence(pa.array(texts))
    assert [set(np.flatnonzero(r)) for r in rows] == sets
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    model = language_id.learn(sorted(words), [np.packbits(r).tobytes() for r in rows], list(labels), landmarks=24)
    turn = {i: [j for j, y in enumerate(labels) if y == labels[i]].index(i) for i in range(len(labels))}
    marks = sorted(range(len(labels)), key=lambda i: (turn[i], labels[i], i))[:24]
    gram = kernel[:, marks] @ np.linalg.pinv(kernel[np.ix_(marks, marks)], rcond=1e-6, hermitian=True) @ kernel[marks] + 1
    target = np.array([[x == y for x in sorted(words)] for y in labels], float)
    want = gram @ np.linalg.solve(gram + language_id.RIDGE * len(labels) * np.eye(len(labels)), target)
    assert np.abs(model.scores(pa.array(texts)) - want).max() < 2e-3


def test_many_languages_are_all_learned(spark):
    rows = [(i, f"q{i}x q{i}y z{i} " * 3, f"l{i % 600:03d}", "s", 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs)
    assert model.languages == [f"l{i:03d}" for i in range(600)]
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} <= set(model.languages)
    with pytest.raises(ValueError):
        language_id.fit(spark.range(5000).select("id", F.lit("abc").alias("text"), F.col("id").cast("string").alias("lang")), key="id")


def test_repeated_rows_do_not_swell_the_samples(spark):
    docs = spark.createDataFrame([(7, "one and the same", "en", "s", 1)] * 3000 + [(i, f"wort {i}", "de", "s", 1) for i in range(8, 60)], DOCS)
    model = language_id.fit(docs)
    assert model.languages == ["de", "en"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 60)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is not None


def plain_statistics(text):
    import math
    from collections import Counter

    raw = (text or "").encode()
    if not raw:
        return [0.0] * 16
    n, count = len(raw), Counter(raw)
    kinds = [
        lambda c: 65 <= c <= 90,
        lambda c: 97 <= c <= 122,
        lambda c: 48 <= c <= 57,
        lambda c: c in b" \t",
        lambda c: c in b"\n\v\f\r",
        lambda c: c in b".,;:'\"-()",
        lambda c: c in b"!?",
        lambda c: 33 <= c < 127 and not chr(c).isalnum() and c not in b".,;:'\"-()!?",
    ]
    words = raw.lower().split()
    sizes = [len(w) for w in words]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out = [sum(v for c, v in count.items() if k(c)) / n for k in kinds]
    out += [-sum(v / n * math.log2(v / n) for v in count.values()), math.log1p(n)]
    out += [np.mean(sizes), np.std(sizes), len(set(words)) / len(words) ** 0.8, sizes.count(1) / len(words)] if words else [0.0] * 4
    return out + ([len(set(lines)) / len(lines), math.log1p(n / len(lines))] if lines else [0.0] * 2)


def test_quality_against_a_direct_fit(spark):
    """Figures text by text, ridge regression in the dual, isotonic fit by its minimax formula."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["good", "words", "Here!", "12", "%%", "a", "line\n"], rng.integers(0, 40))) for _ in range(240)] + ["", None, "\n \n"]
    label = [int(t is not None and t.count("good") > t.count("%%")) for t in texts]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    x = np.array([plain_statistics(t) for t in texts])
    aside = np.array([r.a for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("a")).orderBy("doc_id").collect()])
    y = np.array(label, float)
    mean, scale = x[~aside].mean(0), x[~aside].std(0)
    z = np.clip((x - mean) / np.where(scale > 0, scale, 1), -8, 8) @ model.waves + model.phase
    z = np.hstack([np.cos(z) * np.sqrt(2 / quality.FEATURES), np.ones((len(z), 1))])
    fit = z[~aside]
    ridge = z @ fit.T @ np.linalg.solve(fit @ fit.T + quality.RIDGE * len(fit) / quality.FEATURES * np.eye(len(fit)), y[~aside])
    order = np.flatnonzero(aside)[np.argsort(ridge[aside], kind="stable")]
    level = [max(min(np.mean(y[order][a : b + 1]) for b in range(i, len(order))) for a in range(i + 1)) for i in range(len(order))]
    knots = {v: ridge[order][np.isclose(level, v)].mean() for v in sorted(set(np.round(level, 12)))}
    direct = np.interp(ridge, list(knots.values()), list(knots))
    assert np.abs(np.array([out[i] for i in range(len(texts))]) - direct).max() < 1e-6
