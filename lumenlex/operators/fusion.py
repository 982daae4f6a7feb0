"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlex.operators.numbering import numbered

DEFAULT_K = 60.0


def fuse(lists: DataFrame, k: float = DEFAULT_K) -> DataFrame:
    """(id, score, rank) of rows (list_id, id, rank).

    A list counts with an id's best rank; the sum of 1 / (k + rank) is taken in
    ascending order of rank.  Higher scores come first, then better ranks, then
    higher ids.  Ranks below 1 are an error.
    """
    if not (math.isfinite(k) and k > 0):
        raise ValueError("k is finite and positive")
    good = F.when(F.col("rank") >= 1, F.col("rank")).otherwise(F.raise_error(F.lit("ranks start at 1")))
    best = lists.select("list_id", F.col("id").cast("string").alias("id"), good.alias("rank")).groupBy("list_id", "id").agg(F.min("rank").alias("rank"))
    scored = best.groupBy("id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    score = F.aggregate("ranks", F.lit(0.0), lambda a, r: a + F.lit(1.0) / (F.lit(float(k)) + r))
    scored = scored.select("id", score.alias("score"), F.get("ranks", F.lit(0)).alias("best"))
    ranked = numbered(scored, [F.desc("score"), F.asc("best"), F.desc("id")], "rank", start=1)
    return ranked.select("id", "score", F.col("rank").cast("int").alias("rank"))
