"""Quality scores of texts: random Fourier features, ridge regression, isotonic calibration.

Statistics of a whole text (shares of byte classes, entropy, word and line
figures) are standardised and mapped to random Fourier features, whose inner
product approximates a Gaussian kernel.  Each partition sums its share of the
normal equations; their sum gives the ridge weights.  Isotonic regression on
rows set aside from the fit turns ridge scores into shares of good documents.

The fit uses a bounded sample of labelled rows (``SAMPLE_ROWS``); scoring reads
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlex.llm.chunks import LOWER, slices
from lumenlex.storage import materialize

FEATURES = 256
RIDGE = 1e-3
SAMPLE_ROWS = 30_000
#: Partitions whose sums of the normal equations meet in the driver.
SUMS = 8
ROWS = 1000

_CLASS = np.zeros((256, 8), np.float64)
_CLASS[65:91, 0] = _CLASS[97:123, 1] = _CLASS[48:58, 2] = 1
_CLASS[[32, 9], 3] = _CLASS[[10, 11, 12, 13], 4] = 1
_CLASS[[ord(c) for c in ".,;:'\"-()"], 5] = _CLASS[[ord(c) for c in "!?"], 6] = 1
_CLASS[33:127, 7] = 1
_CLASS[:, 7] -= _CLASS[:, :7].sum(1) > 0
_CLASS[:, 7] = np.maximum(_CLASS[:, 7], 0)
STATISTICS = 8 + 8


def statistics(text: pa.Array) -> np.ndarray:
    """A row of figures for each text; an empty or null text has zeros."""
    text = pc.fill_null(text.cast(pa.binary()), b"")
    out = np.zeros((len(text), STATISTICS))
    for i, x in enumerate(text):
        raw = np.frombuffer(x.as_buffer(), np.uint8)
        n = len(raw)
        if not n:
            continue
        share = np.bincount(raw, minlength=256) / n
        out[i, :8] = share @ _CLASS
        some = share[share > 0]
        words = LOWER[raw].tobytes().split()
        lines = [y for y in x.as_py().split(b"\n") if y.strip()]
        lengths = np.fromiter(map(len, words), np.float64, len(words))
        out[i, 8] = -(some * np.log2(some)).sum()
        out[i, 9] = np.log1p(n)
        if len(words):
            out[i, 10:12] = lengths.mean(), lengths.std()
            out[i, 12] = len(set(words)) / len(words) ** 0.8
            out[i, 13] = (lengths == 1).mean()
        if lines:
            out[i, 14] = len(set(lines)) / len(lines)
            out[i, 15] = np.log1p(n / len(lines))
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, waves: np.ndarray, phase: np.ndarray, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.mean, self.scale, self.waves, self.phase, self.weights, self.knots = mean, scale, waves, phase, weights, knots

    def features(self, figures: np.ndarray) -> np.ndarray:
        z = np.clip((figures - self.mean) / self.scale, -8, 8) @ self.waves + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(z), 1))])

    def ridge(self, figures: np.ndarray) -> np.ndarray:
        return self.features(figures) @ self.weights

    def scores(self, figures: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(figures), *self.knots), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Model | None:
    """From documents with a 0/1 label (the mean, where labels repeat); None without any.

    Null and empty texts have figures of zeros, and whole texts of any length are read. Of rows that repeat a key, one
    is learned from (that of the smallest hash of its text). Documents without a label and labels without a document
    are left out, as are null keys.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label")).where("key IS NOT NULL AND label IS NOT NULL").groupBy("key").agg(F.avg("label").alias("label"))
    n = known.count()
    if not n:
        return None
    drawn = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30)))
    drawn = drawn.orderBy(F.xxhash64("key"), "key").limit(2 * sample_rows)  # the bound of what is broadcast
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "key")

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("hash"), part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATISTICS).cast(pa.list_(pa.float64())), part.column("aside")], ["key", "hash", "label", "x", "aside"])

    rows = rows.withColumn("aside", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(4)) == 0)
    kind = docs.schema[key].dataType.simpleString()
    seen = rows.select("key", F.xxhash64("text").alias("hash"), "label", "text", "aside").mapInArrow(figures, f"key {kind}, hash long, label double, x array<double>, aside boolean")
    sample = materialize(seen.groupBy("key").agg(F.min_by(F.struct("label", "x", "aside"), "hash").alias("row")).select("row.*"), "figures")
    moments = sample.where("NOT aside").select("label", F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale")).orderBy("at").collect()
    if not moments:
        return None
    mean, scale = np.array([r["mean"] for r in moments]), np.array([r["scale"] or 1.0 for r in moments])
    rng = np.random.default_rng(seed)
    waves = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS)
    model = Model(mean, scale, waves, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.zeros(1), np.zeros(1)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(np.stack(batch.column("x").to_numpy(zero_copy_only=False)))
            total += z.T @ np.hstack([z, batch.column("label").to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = sample.where("NOT aside").coalesce(SUMS).mapInArrow(sums, "total binary").collect()  # at most SUMS matrices
    total = sum(np.frombuffer(bytes(r.total)).reshape(FEATURES + 1, -1) for r in parts)
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * total[-1, -2] * np.eye(FEATURES + 1) / FEATURES, total[:, -1])
    aside = sample.where("aside").collect() or sample.collect()
    model.knots = isotonic(model.ridge(np.array([r.x for r in aside])), np.array([r.label for r in aside]))
    return model


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """key, score (0 to 1) and predicted (1 from ``threshold`` on) of every row, from its text alone; 0.5 if nothing was learned.

    Null and empty texts get the score of figures that are all zero; rows that repeat a key or a text are scored each
    for itself, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = np.full(part.num_rows, 0.5) if model is None else model.scores(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(s)], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    scored = rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
