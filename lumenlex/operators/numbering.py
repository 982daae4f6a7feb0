"""Consecutive numbers over a whole table, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlex.storage import Scratch, materialize

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with a gapless number in the given total order.

    A range-partitioned sort, then one count for each partition: only those
    counts reach the driver, and go out again as a broadcast of as many rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(spark, "unnumbered") as tables:  # stored, as the sort samples it first
        ordered = tables.table(df, "rows").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        ordered = materialize(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))), "ordered")
    before, offsets = start, []
    for r in ordered.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((r._part, before))
        before += r["count"]
    shifts = spark.createDataFrame(offsets, "_part int, _before long")
    return ordered.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


#: Ranges of a table's order that :func:`numbered_within` deals a group over.
RANGES = 256


def numbered_within(df: DataFrame, groups: list[str], order: str, name: str) -> DataFrame:
    """``df`` with a gapless number from 0 inside each group, by ascending ``order``, which is numeric and unique in a group.

    A group is counted by ranges of the order and numbered range by range, so
    one that holds a large share of the table is never in one task.
    """
    edges = sorted(set(df.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
    at = F.size(F.filter(F.lit(edges), lambda e: e <= F.col(order).cast("double"))) if edges else F.lit(0)
    rows = df.withColumn("_range", at)
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows a group
    starts = rows.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(order)) - 1
    return rows.withColumn("_at", inside).join(starts.drop("_n"), [*groups, "_range"]).withColumn(name, F.col("_at") + F.col("_start")).drop("_range", "_at", "_start")
