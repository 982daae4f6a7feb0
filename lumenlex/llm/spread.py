"""Joins to a table with one row for each key, where a few keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is hot; there are fewer than that many hot keys.
HOT = 1000
#: Rows of two or three short columns up to which a side is broadcast.
FEW = 500_000


def small(rows: DataFrame, limit: int = FEW) -> DataFrame:
    """Stored rows, marked for broadcast if there are at most ``limit``; beyond that Spark shuffles them."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def joined(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row for each key ``on`` and the number of its rows as ``count``.

    Rows of hot keys find them in a broadcast of fewer than ``HOT`` rows, and
    are dealt at random in the shuffle that the others go through. Keys are not
    null. ``count`` stays in the result; ``how`` is left or inner.
    """
    values = [c for c in table.columns if c not in on]
    hot = F.col(count).cast("long") * HOT > F.lit(total).cast("long")
    found = F.struct(*map(F.col, values))
    first = rows.join(F.broadcast(table.where(hot).select(*on, found.alias("_hot"))), on, "left")
    salt = F.when(F.col("_hot").isNotNull(), 1 + F.floor(F.rand(0) * (1 << 20))).otherwise(0).cast("int")
    cold = table.where(~hot).select(*on, F.lit(0).alias("_salt"), found.alias("_cold"))
    both = first.withColumn("_salt", salt).join(cold, [*on, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    if how == "inner":
        both = both.where("_found IS NOT NULL")
    return both.select(*rows.columns, *(F.col("_found")[v].alias(v) for v in values))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that several rows have, null among them."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
