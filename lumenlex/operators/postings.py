"""Term dictionaries, posting lists and blocks as tables.

What a cursor steps through is one sort of postings and targets here: ``seek``
is the smallest document from a target on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlex.operators.numbering import numbered
from lumenlex.storage import materialize

BLOCK = 2
#: Terms of targets up to which a seek names them to the scan.
FEW = 64


def term_dictionary(rows: DataFrame) -> DataFrame:
    """(field_id, term, term_id, doc_freq) of an index's terms, or of postings; ids from 0 by the first document that has a term, then field, then term."""
    if "doc_freq" not in rows.columns:
        rows = rows.groupBy("field_id", "term").agg(F.count("*").alias("doc_freq"), F.min("doc_id").alias("first_doc"))
    order = [F.col("first_doc"), F.col("field_id"), F.col("term")]
    return numbered(rows, order, "term_id").select("field_id", "term", F.col("term_id").cast("int").alias("term_id"), "doc_freq")


def posting_blocks(postings: DataFrame, size: int = BLOCK) -> DataFrame:
    """Each term's postings in blocks of ``size`` (1 at least) documents: bounds, last document, highest count, least length.

    One range-partitioned sort; blocks are closed inside its partitions.  Only
    what an earlier partition can shift, the first term of each, and the last
    block of each, which may go on in the next one, are grouped after that.
    """
    size = max(1, size)
    spark = postings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["term", "field_id", "doc_id"]
    rows = postings.where("field_id IS NOT NULL AND term IS NOT NULL AND doc_id IS NOT NULL").select("field_id", "term", "doc_id", "term_freq", "doc_len")
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    figures = ["start", "end", "end_doc", "max_term_freq", "min_doc_length"]
    names = ["part", "open", "field_id", "term", *figures]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = held = None  # the partition's first term, the last one seen and its number of postings, the last block, as its parts
        count, alone = 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            field, term = batch.column("field_id"), batch.column("term")
            ends = [(field[i].as_py(), term[i].as_py()) for i in (0, n - 1)]
            first = first or ends[0]
            new = np.append(ends[0] != last, pc.or_(pc.not_equal(field[1:], field[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)).astype(bool)
            alone = alone and ends[0] == first  # whether the partition has had no other term yet
            begins = np.flatnonzero(new)
            if not new[0]:
                begins = np.append(0, begins)
            at = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
            at[: begins[1] if len(begins) > 1 else n] += 0 if new[0] else count
            count, last = int(at[-1]) + 1, ends[1]
            shifted = np.zeros(n, bool)
            if alone:
                shifted[: begins[1] if len(begins) > 1 else n] = True
                alone = len(begins) == 1
            cut = np.flatnonzero(shifted | new | (at % size == 0) | (np.arange(n) == 0))
            stop = np.append(cut[1:], n) - 1
            doc, freq, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "term_freq", "doc_len"))
            made = pa.table(
                [batch.column("part").take(pa.array(cut)), pa.array(shifted[cut]), field.take(pa.array(cut)), term.take(pa.array(cut)), pa.array(at[cut]), pa.array(at[stop] + 1), pa.array(doc[stop]), pa.array(np.maximum.reduceat(freq, cut)), pa.array(np.minimum.reduceat(length, cut))],
                names,
            )
            if held is not None:
                if not new[0] and not shifted[0] and at[0] % size:  # goes on with the block that was held
                    head = made.slice(0, 1).to_pylist()[0]
                    head |= {"start": held["start"], "max_term_freq": max(held["max_term_freq"], head["max_term_freq"]), "min_doc_length": min(held["min_doc_length"], head["min_doc_length"])}
                    made = pa.concat_tables([pa.Table.from_pylist([head], made.schema), made.slice(1)])
                else:
                    yield from pa.Table.from_pylist([held], made.schema).to_batches()
            held = made.slice(made.num_rows - 1).to_pylist()[0]
            kinds = made.schema
            yield from made.slice(0, made.num_rows - 1).combine_chunks().to_batches()
        if held is not None:
            yield from pa.Table.from_pylist([held | {"open": True}], kinds).to_batches()

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = materialize(
        ordered.mapInArrow(blocks, f"part int, open boolean, field_id {kind['field_id']}, term {kind['term']}, start long, end long, end_doc {kind['doc_id']}, max_term_freq {kind['term_freq']}, min_doc_length {kind['doc_len']}"), "blocks"
    )
    some = made.where("open")
    before = Window.partitionBy("field_id", "term").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over two rows a partition
    shifts = some.groupBy("part", "field_id", "term").agg(F.max("end").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    some = some.join(F.broadcast(shifts), ["part", "field_id", "term"]).withColumns({x: F.col(x) + F.col("_before") for x in ("start", "end")})
    some = some.groupBy("field_id", "term", F.floor(F.col("start") / size).alias("block")).agg(*(f(x).alias(x) for f, x in zip((F.min, F.max, F.max, F.max, F.min), figures, strict=True)))
    whole = made.where("NOT open").select("field_id", "term", F.floor(F.col("start") / size).alias("block"), *figures)
    return whole.unionByName(some).withColumns({x: F.col(x).cast("int") for x in ("block", "start", "end")})


def posting_list(rows: DataFrame) -> DataFrame:
    """(term, doc_id, term_freq) of rows with an ``ordinal``; of rows for one term and document the last stays."""
    newest = Window.partitionBy("term", "doc_id").orderBy(F.desc("ordinal"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "ordinal")


def seek(postings: DataFrame, targets: DataFrame) -> DataFrame:
    """(field_id, term, target, doc_id, term_freq): for each (field_id, term, target), the first document not below the target.

    Past the end, and for a null target, doc_id is null and term_freq 0.

    Postings of terms that no target names are left out.  One range-partitioned
    sort of the others and targets together: a target takes
    the next posting of its partition, or else the first one of a later
    partition, for which one row a partition is kept.
    """
    spark = postings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = {"doc_id": postings.schema["doc_id"].dataType, "target": targets.schema["target"].dataType}
    some = postings.where("field_id IS NOT NULL AND term IS NOT NULL AND doc_id IS NOT NULL")
    asked = targets.select("field_id", "term").where("field_id IS NOT NULL AND term IS NOT NULL").distinct()
    few = asked.limit(FEW + 1).collect()
    if len(few) <= FEW:  # by literals, which prune the scan
        some = some.where(reduce(lambda a, b: a | b, ((F.col("field_id") == r.field_id) & (F.col("term") == r.term) for r in few), F.lit(False)))
    else:
        some = some.join(asked, ["field_id", "term"], "left_semi")
    rows = some.select("field_id", "term", F.col("doc_id").alias("at"), F.col("term_freq").cast("long").alias("freq"), F.lit(1).alias("posting"))
    rows = materialize(rows.unionByName(targets.select("field_id", "term", F.col("target").alias("at"), F.lit(None).cast("long").alias("freq"), F.lit(0).alias("posting"))), "unsought")
    # Backwards, so that the next posting is the last one seen; a target comes after a posting of its document.
    order = [F.desc(x) for x in ("field_id", "term", "at", "posting", "freq")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    names = ["field_id", "term", "at", "posting", "part", "next_field", "next_term", "next_at", "next_freq"]

    def following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Targets with the posting that follows, of whichever term; at the end the partition's first posting, as a row of its own."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            is_posting = both["posting"].to_numpy() == 1
            seen = np.maximum.accumulate(np.where(is_posting, np.arange(len(is_posting)), -1))
            at = np.flatnonzero(~is_posting)
            if len(at):
                found = both.take(pa.array(seen[at], mask=seen[at] < 0))
                own = both.take(pa.array(at))
                yield from pa.table([own[x] for x in names[:5]] + [found[x] for x in ("field_id", "term", "at", "freq")], names).to_batches()
            if seen[-1] >= 0:
                last = both.slice(seen[-1], 1).combine_chunks().to_batches()[0]
        if last is not None:
            yield from pa.table([last[x] for x in names[:5]] + [last[x] for x in ("field_id", "term", "at", "freq")], names).to_batches()

    kind = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    schema = f"field_id {kind['field_id']}, term {kind['term']}, at {kind['at']}, posting int, part int, next_field {kind['field_id']}, next_term {kind['term']}, next_at {kind['at']}, next_freq long"
    sought = materialize(ordered.mapInArrow(following, schema), "sought")
    # Partitions run backwards too: what follows a partition's last row is the first posting of the closest one before it that has any.
    firsts = sought.where("posting = 1").select("part", F.struct(*names[5:]).alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    ends = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(firsts, "part", "left").select("part", F.last("first", ignorenulls=True).over(before).alias("later"))
    open_ = F.col("next_field").isNull()
    out = sought.where("posting = 0").join(F.broadcast(ends), "part", "left")
    follows = {x: F.when(open_, F.col(f"later.{x}")).otherwise(F.col(x)) for x in names[5:]}
    out = out.withColumns(follows)
    hit = F.col("at").isNotNull() & (F.col("next_field") == F.col("field_id")) & (F.col("next_term") == F.col("term"))
    return out.select(
        "field_id",
        "term",
        F.col("at").cast(kinds["target"]).alias("target"),
        F.when(hit, F.col("next_at")).cast(kinds["doc_id"]).alias("doc_id"),
        F.coalesce(F.when(hit, F.col("next_freq")).cast(postings.schema["term_freq"].dataType), F.lit(0)).alias("term_freq"),
    )
