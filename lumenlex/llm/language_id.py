"""Language identification with a string kernel.

A text is the set of its character n-grams of several lengths (the blended
spectrum, by presence), held in ``SLOTS`` hashed slots.  The kernel of two
texts is the number of shared slots over the root of both sets' sizes.  It is
approximated from ``LANDMARKS`` training texts (Nyström), and one ridge
regression against the rest for each language gives the scores, as two matrix
products for a batch of texts.

Those scores sum to about 1, so the best of a few is never small.  Whether a
text resembles its language at all is told by the commonness of its n-grams:
the mean, over all n-grams with a letter, of the share of the language's sample
rows that hold the n-gram's slot.  It does not depend on the text's length.

The fit uses a bounded sample of labelled rows (``SAMPLE_ROWS``, spread evenly
over the languages); prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlex.llm.chunks import slices
from lumenlex.storage import materialize

LENGTHS = (1, 2, 3)
SLOTS = 8192
LANDMARKS = 128
SAMPLE_ROWS = 4096
#: Rows of a language that are drawn at least, if it has as many.
LEAST_ROWS = 8
#: More different labels than this are an error: they are no languages, and the sample would have no bound.
MAX_LABELS = 4096
RIDGE = 1e-3
#: A text is foreign below this part of this quantile of the sample rows' commonness.
FOREIGN, QUANTILE = 0.77, 0.01
ROWS = 256

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def grams(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the length, all code points, a mask of the n-grams inside one text, and the row and slot of each of those."""
    text = pc.utf8_lower(pc.fill_null(text.cast(pa.string()), ""))
    lengths = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(text), dtype=np.int32), lengths)
    for p in LENGTHS:
        if len(codes) < p:
            continue
        n = len(codes) - p + 1
        mixed = np.full(n, p * 0x165667B1 & 0xFFFFFFFF, np.uint32)
        for k in range(p):
            mixed = (mixed ^ codes[k : k + n]) * _MIX[k]
            mixed ^= mixed >> np.uint32(15)
        inside = row[:n] == row[p - 1 :]
        yield p, codes, inside, row[:n][inside].astype(np.int64), mixed[inside] >> np.uint32(32 - SLOTS.bit_length() + 1)


def presence(text: pa.Array) -> np.ndarray:
    """A row of slots for each text, 1 where one of its n-grams falls."""
    out = np.zeros((len(text), SLOTS), np.uint8)
    flat = out.ravel()
    for _, _, _, row, slot in grams(text):
        flat[row * SLOTS + slot] = 1
    return out


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Marks the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def commonness(text: pa.Array, shares: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Mean share (languages by slots) of each text's n-grams with a letter, in the language given for it; 0 without a letter."""
    total, number = np.zeros(len(text)), np.zeros(len(text))
    flat = shares.ravel()
    for p, codes, inside, row, slot in grams(text):
        letter = letters()[codes]
        some = letter[: len(inside)].copy()
        for k in range(1, p):
            some |= letter[k : k + len(inside)]
        some = some[inside]
        row, slot = row[some], slot[some]
        total += np.bincount(row, flat[language[row] * SLOTS + slot], len(text))
        number += np.bincount(row, minlength=len(text))
    return total / np.maximum(number, 1)


def unit_kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel of presence rows with landmarks (slots by landmark, already divided by the roots of their sizes)."""
    rows = rows.astype(np.float32)
    size = rows.sum(1)
    return rows @ landmarks / np.sqrt(np.maximum(size, 1))[:, None]


class Model:
    """``languages`` in order, ``landmarks``, and each language's weights of the landmarks and constant.

    ``shares`` of each language's sample rows by slot, and the ``least`` commonness of a text that is not foreign.
    """

    shares: np.ndarray | None = None
    least = 0.0

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, constant: np.ndarray):
        self.languages, self.landmarks, self.weights, self.constant = languages, landmarks, weights, constant

    def scores(self, text: pa.Array) -> np.ndarray:
        return unit_kernel(presence(text), self.landmarks) @ self.weights + self.constant

    def known(self, text: pa.Array, scores: np.ndarray) -> np.ndarray:
        """Whether each text is as common as texts of the language with its best score are."""
        if self.shares is None:
            return np.ones(len(text), bool)
        return commonness(text, self.shares, scores.argmax(1)) >= self.least


def learn(languages: list[str], bits: list[bytes], labels: list[str], ridge: float = RIDGE, landmarks: int = LANDMARKS) -> Model:
    """From presence rows as packed bits. Landmarks are dealt over the languages in turn."""
    place = {x: i for i, x in enumerate(languages)}
    y = np.array([place[x] for x in labels])
    turn = np.zeros(len(y), np.int64)
    for i in range(len(languages)):
        turn[y == i] = np.arange((y == i).sum())
    chosen = np.lexsort((y, turn))[:landmarks]

    def unpacked(some: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(bits[i] for i in some), np.uint8).reshape(len(some), -1), axis=1)

    marks = unpacked(chosen).astype(np.float32).T
    marks = marks / np.sqrt(np.maximum(marks.sum(0), 1))
    kernel = np.concatenate([unit_kernel(unpacked(np.arange(i, min(i + 512, len(y)))), marks) for i in range(0, len(y), 512)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values.max()
    project = vectors[:, good] / np.sqrt(values[good])
    z = np.hstack([kernel @ project, np.ones((len(y), 1))])
    target = (y[:, None] == np.arange(len(languages))).astype(float)
    weights = np.linalg.solve(z.T @ z + ridge * len(y) * np.eye(z.shape[1]), z.T @ target)
    return Model(languages, marks, (project @ weights[:-1]).astype(np.float32), weights[-1].astype(np.float32))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """From rows with a label and a letter in their text; None if there are none.

    Every label that occurs is a language, however many there are: of each,
    ``sample_rows`` / languages rows are drawn, but ``LEAST_ROWS`` if it has them.
    Rows alike in key, text and label count once. Raises ValueError for more than
    ``MAX_LABELS`` labels.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = materialize(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels")
    many = counts.count()
    if not many:
        return None
    if many > MAX_LABELS:
        raise ValueError(f"{many} different labels, of which at most {MAX_LABELS} can be learned")
    # As many rows of each language, and all of those that have fewer.
    rate = F.least(F.lit(1.0), F.lit(max(sample_rows / many, LEAST_ROWS)) / F.col("n")) * (1 << 30)
    rates = counts.select("label", rate.cast("long").alias("rate"))  # a row for each language
    drawn = rows.withColumn("hash", F.xxhash64("key", "text")).join(F.broadcast(rates), "label")
    drawn = drawn.where(F.pmod(F.col("hash"), F.lit(1 << 30)) < F.col("rate")).groupBy("label", "hash").agg(F.min("text").alias("text"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                packed = np.packbits(presence(part.column("text")), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([x.tobytes() for x in packed], pa.binary())], ["label", "bits"])

    # About sample_rows rows of one kilobyte, whatever the texts' length.
    drawn = materialize(drawn.select("text", "label"), "sample")
    sample = sorted((r.label, bytes(r.bits)) for r in drawn.mapInArrow(rows_of, "label string, bits binary").collect())
    if not sample:
        return None
    labels, bits = [x for x, _ in sample], [x for _, x in sample]
    languages = sorted(set(labels))
    model = learn(languages, bits, labels)
    place = {x: i for i, x in enumerate(languages)}
    rows_in = np.zeros(len(languages), np.int64)
    held = np.zeros((len(languages), SLOTS))
    for x, y in zip(bits, labels, strict=True):
        rows_in[place[y]] += 1
        held[place[y]] += np.unpackbits(np.frombuffer(x, np.uint8))
    shares = (held / np.maximum(rows_in, 1)[:, None]).astype(np.float32)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                own = np.array([place[x] for x in part.column("label").to_pylist()])
                n = rows_in[own]
                # Without the row itself, which holds all of its slots; the only row of a language tells nothing.
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(n * commonness(part.column("text"), shares, own) - 1, 0) / np.maximum(n - 1, 1))], ["common"])

    if len(sample) * QUANTILE >= 1:
        seen = [r.common for r in drawn.mapInArrow(common, "common double").collect()]
        model.shares, model.least = shares, FOREIGN * float(np.quantile(seen, QUANTILE))
    return model


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (0 to 1) of every row, from its text alone.

    ``und`` with score 0 where the text is null or has no letter, and for all rows if nothing was learned.
    Of languages that score alike the first in order of name is taken.  Each row is judged for itself, whole texts of
    any length; other columns, however they are called, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for start in range(0, part.num_rows, ROWS):
                    some = part.slice(start, ROWS)
                    letters = some.column("letters").to_numpy(zero_copy_only=False)
                    names, best = ["und"] * some.num_rows, np.zeros(some.num_rows)
                    if model is not None and letters.any():
                        scores = model.scores(some.column("text"))
                        top = scores.argmax(1)
                        best = np.where(letters, np.clip(scores.max(1), 0, 1), 0.0)
                        names = [model.languages[t] if ok else "und" for t, ok in zip(top.tolist(), letters.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(names, pa.string()), pa.array(best, pa.float64())], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), value.alias("text"), value.rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def keep_known(docs: DataFrame, model: Model | None, min_score: float = 0.1, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a letter, scores ``min_score`` or more for some language and is not foreign to it. Narrow.

    Foreign is a text whose n-grams are less common than ``FOREIGN`` times a
    low quantile of the sample rows'; one that is foreign for its larger part
    goes as well.  A sample of fewer than ``1 / QUANTILE`` rows has no such
    quantile, and then no text is foreign.  Null and empty texts have no letter
    and go; without a model every text with a letter stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                for start in range(0, part.num_rows, ROWS):
                    some = part.slice(start, ROWS)
                    good = pc.fill_null(pc.match_substring_regex(some.column(text), r"\pL"), False)
                    if model is not None and pc.any(good).as_py():
                        scores = model.scores(some.column(text))
                        good = pc.and_(good, pa.array((scores.max(1) >= min_score) & model.known(some.column(text), scores)))
                    yield some.filter(good)

    return docs.mapInArrow(run, docs.schema)
