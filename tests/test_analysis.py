import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlex.functions import analysis
from lumenlex.functions.analysis import Analyzer, Normalizer, needs_normalize, normalized, split, tokens, words

POOL = ["CAFÉ", "café", "ΣΠΊΤΙ", "Straße", "ΟΣ", "ﬁne", "x²", "İ", "a", "the.", "Å", "가"]
SPACES = [" ", "\n", "\t", " ", " ", "　", "\u0085", "  "]


def texts():
    rng = random.Random(5)
    out = ["", " ", None, "​", "a\x1cb"]
    for _ in range(60):
        out.append("".join(rng.choice(SPACES) + rng.choice(POOL) for _ in range(rng.randint(1, 6))) + rng.choice(["", " "]))
    return out


@pytest.mark.parametrize("form", [None, "NFC", "NFKC"])
@pytest.mark.parametrize("case", [None, "lower", "fold"])
def test_columns_agree_with_driver(spark, form, case):
    analyzer = Analyzer((Normalizer(form, case),))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")
    for r in rows.select("t", analyzer.column(F.col("t")).alias("terms")).collect():
        assert r.terms == (None if r.t is None else analyzer.terms(r.t)), r.t


def test_sigma_and_folding():
    assert Analyzer().terms("ΟΣ") == ["ος"]
    assert Analyzer((Normalizer("NFC", "fold"),)).terms("Straße STRASSE") == ["strasse", "strasse"]
    assert Normalizer().changes("A") and not Normalizer().changes("a")


def test_positions_and_bytes(spark):
    rows = spark.createDataFrame([(" é b\n漢字 x",), ("",), (None,)], "t string")
    found = rows.select(tokens(F.col("t"), position_offset=3).alias("ts")).collect()
    assert [(t.text, t.position, t.start, t.end) for t in found[0].ts] == [("é", 3, 2, 4), ("b", 4, 5, 6), ("漢字", 5, 7, 13), ("x", 6, 14, 15)]
    assert found[1].ts == [] and found[2].ts is None


def test_normalized_columns(spark):
    rows = spark.createDataFrame([("CAFÉ",), ("ok",)], "t string")
    out = rows.select(normalized(F.col("t")).alias("n"), needs_normalize(F.col("t")).alias("c"), split(F.col("t")).alias("s")).collect()
    assert [(r.n, r.c) for r in out] == [("café", True), ("ok", False)]


def test_unknown_steps():
    with pytest.raises(ValueError):
        Normalizer("NFD")


def test_tokens_of_many_texts(spark):
    """Cut a batch at a time, against one text at a time."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts() * 3)], "i int, t string").repartition(2)
    for r in rows.select("t", tokens(F.col("t")).alias("ts")).collect():
        if r.t is None:
            assert r.ts is None
            continue
        raw, want = r.t.encode(), words(r.t)
        assert [t.text for t in r.ts] == want and [t.position for t in r.ts] == list(range(len(want)))
        assert [raw[t.start : t.end].decode() for t in r.ts] == want and [t.term for t in r.ts] == Analyzer().terms(r.t)


def test_ascii_stays_out_of_python(spark):
    """Texts of ASCII alone are not sent to a worker: the function that would map them gets nulls."""
    rows = spark.createDataFrame([("Plain TEXT",), ("CAFÉ",), (None,)], "t string")
    out = rows.select(Analyzer().column(F.col("t")).alias("x"), normalized(F.col("t"), Normalizer("NFKC", "fold")).alias("y")).collect()
    assert [(r.x, r.y) for r in out] == [(["plain", "text"], "plain text"), (["café"], "café"), (None, None)]


def test_token_rows_hold_one_slice(spark, monkeypatch):
    """The rows of one text after the other, cut in slices of a few bytes; also where one text is longer than a slice."""
    monkeypatch.setattr(analysis, "SLICE_BYTES", 16)
    values = pa.array(texts())
    parts = list(analysis._slices(values))
    assert [x for _, part in parts for x in part.to_pylist()] == texts() and len(parts) > 20
    assert all(sum(len((x or "").encode()) for x in part.to_pylist()) <= 16 or len(part) == 1 for _, part in parts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")
    want = rows.select("i", F.inline(tokens(F.col("t"), position_offset=2))).collect()
    found = analysis.token_rows(rows, "i", "t", position_offset=2)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and found.columns == ["i", "text", "position", "start", "end", "term"]
    assert analysis.token_rows(rows.limit(0), "i", "t").count() == 0
