"""Applying decisions to whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlex.llm.spread import repeated, small
from lumenlex.storage import materialize


def kept_rows(docs: DataFrame, decisions: DataFrame, same_text: Column, decided_text: str, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, whose decision is ``kept``.

    ``decisions``, a stored table, has a row for each document with the key,
    ``kept`` and a figure of its text (``decided_text``) that ``same_text``
    computes as well.  Only the keys of dropped rows are joined, by broadcast as
    long as they are few.  Of keys that rows repeat, null among them, that
    figure tells the rows apart, and of rows alike in both one stays; no other
    row's text is looked at.
    """
    again = materialize(repeated(decisions, key).select(F.col(key).alias("_key")), "repeated")
    gone = decisions.where("NOT kept").select(F.col(key).alias("_key")).union(again).distinct()
    at = F.col(key).eqNullSafe(F.col("_key"))
    rows = docs.join(small(materialize(gone, "gone")), at, "left_anti")
    if again.isEmpty():
        return rows
    stay = decisions.where("kept").select(F.col(key).alias("_key"), F.col(decided_text).alias("_decided")).distinct()
    those = docs.join(small(again), at, "left_semi").withColumn("_same", same_text)
    those = those.join(stay, at & (F.col("_same") == F.col("_decided")), "left_semi").dropDuplicates([key, "_same"])
    return rows.unionByName(those.drop("_same"))
