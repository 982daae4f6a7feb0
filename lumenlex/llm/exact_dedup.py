"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A normalised text is cut into blocks of fixed size.  Equal blocks get equal
integer names: the high bits are the bucket a block falls into by its hash, the
low bits its position among the sorted distinct blocks of that bucket.  Then
adjacent names are paired and the pairs are named alike, level by level, until
a document has one name.  Two documents have equal names at the same level if,
and only if, their texts are equal: contents are compared wherever a bucket
holds more than one, so no hash decides alone.

Texts cross the network once, as distinct blocks combined before the shuffle;
after that there are only names.  No group is gathered: groups are aggregated
to their smallest key and joined back, the few very large ones by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlex.llm.spread import joined
from lumenlex.storage import Scratch, materialize

BLOCK_CHARS = 4096
#: Of a name's 63 bits: bucket, and rank inside the bucket.
BUCKET_BITS, RANK_BITS = 54, 9


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _named(rows: DataFrame, bucket_bits: int, rank_bits: int, tables: Scratch) -> DataFrame:
    """``items`` replaced by ``names``; equal items of all rows get equal names and others do not."""

    def bucket(x: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(x), 64 - bucket_bits)

    distinct = rows.select(F.explode("items").alias("item")).distinct().withColumn("bucket", bucket(F.col("item")))
    crowded = distinct.groupBy("bucket").count().where("count > 1").select("bucket")
    if crowded.isEmpty():
        return rows.withColumn("names", F.transform("items", lambda x: F.shiftleft(bucket(x), rank_bits))).drop("items")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("item")) - 1
    ranked = distinct.join(crowded, "bucket").select("item", rank.alias("rank")).where("rank > 0")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < 1 << rank_bits, F.col("rank")).otherwise(F.raise_error(F.lit("a bucket holds more blocks than its ranks can number: give more rank bits"))))
    moved = rows.select("uid", F.posexplode("items").alias("at", "item")).join(tables.table(ranked, "ranks"), "item")
    moved = moved.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("at", "rank"))).alias("moved"))

    def name(x: Column, at: Column) -> Column:
        return F.shiftleft(bucket(x), rank_bits) + F.coalesce(F.try_element_at("moved", at), F.lit(0))

    return rows.join(moved, "uid", "left").withColumn("names", F.transform("items", name)).drop("items", "moved")


def identities(docs: DataFrame, tables: Scratch, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, bucket_bits: int = BUCKET_BITS, rank_bits: int = RANK_BITS) -> DataFrame:
    """A row for each document: uid, key, text_sha256, and level and name, which only equal texts share.

    The empty text has level 0 and name -1.
    """
    rows = docs.select(F.col(key).alias("key"), normalised(F.col(text)).alias("norm"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.select("uid", "key", F.sha2("norm", 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0)).alias("items"))
    named = tables.table(_named(rows, bucket_bits, rank_bits, tables), "names")
    many = F.size("names") > 1
    done = named.where(~many).withColumn("level", F.lit(0))
    longest = named.agg(F.max(F.size("names"))).first()[0] or 0
    level = 0
    active = named.where(many)
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pair = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1).cast("long")).alias("b")),
        )
        named = tables.table(_named(active.withColumn("items", pair).drop("names"), bucket_bits, rank_bits, tables), "names")
        done = done.unionByName(named.where(~many).withColumn("level", F.lit(level)))
        active = named.where(many)
    return done.select("uid", "key", "text_sha256", "level", F.coalesce(F.get("names", F.lit(0)), F.lit(-1).cast("long")).alias("name"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **naming: int) -> DataFrame:
    """A row for each document: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest key stays (null counts as smallest);
    where rows repeat that key as well, one of them stays.  Null and empty texts
    are equal, and differ from a blank.  Other columns are ignored.
    """
    with Scratch(docs.sparkSession, "exact-dedup") as tables:
        rows = tables.table(identities(docs, tables, key, text, **naming), "identities")
        groups = rows.groupBy("level", "name").agg(F.min(F.struct("key", "uid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        found = joined(rows, tables.table(groups, "groups"), ["level", "name"], "group_size", rows.count())
        return materialize(found.select(F.col("key").alias(key), F.col("keep.key").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "text_sha256"), "exact-duplicates")
