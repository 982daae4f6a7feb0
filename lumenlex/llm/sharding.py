"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn at once, from
the multivariate hypergeometric law, so that every shard's total is exact.
Rows are permuted inside their partition, exchanged by those counts, and
permuted again inside their shard.  The second permutation deals a shard into
runs of bounded size at random and orders each by random keys; a shard is never
gathered into one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlex.storage import Scratch, materialize

_NUMPY_LIMIT = 10**9
#: Rows of a run, about.
RUN_ROWS = 200_000
#: Runs up to which their starts are broadcast.
FEW = 500_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Draws of ``sample`` from ``good + bad`` that are good, at any size.

    numpy stops at 10**9; beyond it, inversion over the ratios of neighbouring
    probabilities, 12 standard deviations around the mode.
    """
    if not sample or not good:
        return 0
    if not bad:
        return sample
    total = good + bad
    if total < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(sample, good)
    mode = (sample + 1) * (good + 1) // (total + 2)
    spread = int(12 * (sample * (good / total) * (bad / total) * ((total - sample) / (total - 1))) ** 0.5) + 12
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(steps)))
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows from each partition to each shard; columns sum to sizes that are at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        rest = sum(room)
        for s in range(shards):
            k = hypergeometric(rng, room[s], rest - room[s], n)
            rest -= room[s]
            matrix[p, s] = k
            room[s] -= k
            n -= k
    return matrix


def shard_rows(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` and ``slot`` (gapless from 0 inside a shard).

    Row counts of shards are at most one apart.  Nulls, ties and repeated rows
    are rows like any other; an empty table gives an empty one; columns that
    are named shard or slot are replaced.  The result is a
    function of the seed and of how the input is partitioned.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    with Scratch(spark, "sharding") as tables:
        return _sharded(df, shards, seed, tables)


def _sharded(df: DataFrame, shards: int, seed: int, tables: Scratch) -> DataFrame:
    spark = df.sparkSession
    rows = tables.table(df.select(F.struct(*map(F.col, df.columns)).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("uid")), "rows")
    counts = rows.groupBy("part").count().orderBy("part").collect()  # one small row a partition
    matrix = communication_matrix([r["count"] for r in counts], shards, seed)
    bounds = spark.createDataFrame([(r.part, list(map(int, np.cumsum(m)))) for r, m in zip(counts, matrix, strict=True)], "part int, bounds array<long>")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("uid", F.lit(seed)), "uid"))
    sent = rows.withColumn("place", place).join(F.broadcast(bounds), "part")  # partitions x shards numbers
    sent = sent.select("row", "uid", F.size(F.filter("bounds", lambda b: b < F.col("place"))).alias("shard"), F.xxhash64("uid", F.lit(seed + 1)).alias("key"))
    runs = max(1, -(-sum(r["count"] for r in counts) // (shards * RUN_ROWS)))
    sent = sent.withColumn("run", F.pmod(F.col("key"), F.lit(runs)).cast("int"))
    inside = F.row_number().over(Window.partitionBy("shard", "run").orderBy("key", "uid")) - 1
    placed = materialize(sent.select("row", "shard", "run", inside.alias("at")), "placed")
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # over one row a run
    starts = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.select("shard", "run", "start")
    starts = F.broadcast(starts) if shards * runs <= FEW else starts
    return placed.join(starts, ["shard", "run"]).select("row.*", "shard", (F.col("at") + F.col("start")).alias("slot"))
