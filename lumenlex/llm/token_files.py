"""Token-id files: frequency-ranked ids, byte-aligned codes, separate control bytes.

The most frequent id becomes rank 0 and so on; each rank takes one to four
data bytes, and its two-bit length goes to a separate control stream.  Numpy
decodes both through a table of 256 control bytes.

A file is a Parquet part in the shared folder, so Spark's commit protocol
survives a lost executor.  Each row is a block of whole documents in ascending
key order: ``part, block, keys, counts, start`` (ids before the block in its
part), ``control, data``.  The ranks are a second table of at most one row for
each id of the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm import word_bpe
from lumenlex.storage import Scratch, fresh_path

#: Ids after which a block of documents is closed.
BLOCK_IDS = 1 << 18

_CODES = np.arange(256)
#: Bytes of each of the four numbers behind a control byte.
LENGTHS = np.stack([(_CODES >> 2 * k & 3) + 1 for k in range(4)], axis=1)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4", copy=False)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = extra
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = np.ascontiguousarray(ranks).view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers of :func:`pack_ranks`."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(lengths) - lengths
    padded = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)).astype(np.uint32)
    ranks = np.zeros(n, np.uint32)
    for k in range(4):
        if k == 0:
            ranks |= padded[start]
        elif (more := np.flatnonzero(lengths > k)).size:
            ranks[more] |= padded[start[more] + k] << np.uint32(8 * k)
    return ranks


def id_ranks(tokens: DataFrame, width: str) -> np.ndarray:
    """Ids in descending frequency over all documents, ties in ascending order; bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                ids = np.frombuffer(x.as_buffer(), width)
                if len(ids) > 4 * len(total) or len(ids) and ids.max() >= len(total):
                    grown = np.bincount(ids, minlength=len(total))
                    grown[: len(total)] += total
                    total = grown
                else:
                    total += np.bincount(ids, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(counts.collect(), key=lambda r: (-r.n, r.id))
    return np.array([r.id for r in rows], np.uint32)


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, key: str = "doc_id", parts: int | None = None, special_tokens: bool = False) -> str:
    """Encode whole texts and write them in ascending key order; returns the folder of ``files`` and ``ranks``.

    Null texts are empty, empty texts have the end id alone; null keys come first and rows of one key stay apart.
    ``special_tokens`` as in :func:`word_bpe.chunk_encoder`.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-files")
    width = word_bpe.id_width(tokenizer, end_id)
    tokens = word_bpe.encode(docs, tokenizer, end_id, key, width=width, special_tokens=special_tokens).select(F.col(key).alias("key"), "ids")
    kind = docs.schema[key].dataType.simpleString()
    with Scratch(spark, "token-ids") as tables:
        _write(spark, tables.table(tokens.withColumn("uid", F.monotonically_increasing_id()), "ids", small_batches=True), path, width, kind, parts)
    return path


def _write(spark: SparkSession, tokens: DataFrame, path: str, width: str, kind: str, parts: int | None) -> None:
    order = id_ranks(tokens, width)
    rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(order), dtype=np.int64), "id": order.astype(np.int64)}), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = start = size = 0
        part, keys, counts, held = None, [], [], []

        def closed() -> pa.RecordBatch:
            control, data = pack_ranks(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([keys]).cast(pa.list_(key_type)), pa.array([counts], pa.list_(pa.int32())), pa.array([start], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                ["part", "block", "keys", "counts", "start", "control", "data"],
            )

        for batch in batches:
            key_type = batch.schema.field("key").type
            for p, k, x in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(x.as_buffer(), width)
                part = p
                keys.append(k)
                counts.append(len(ids))
                held.append(rank_of[ids])
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield closed()
                    block, start, size, keys, counts, held = block + 1, start + size, 0, [], [], []
        if keys:
            yield closed()

    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(parts, "key", "uid").sortWithinPartitions("key", "uid")
    schema = f"part int, block long, keys array<{kind}>, counts array<int>, start long, control binary, data binary"
    ordered.select(F.spark_partition_id().alias("part"), "key", "ids").mapInArrow(code, schema).write.option("compression", "zstd").parquet(f"{path}/files")


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """Blocks with ``before`` (ids of all parts before theirs), and the id of each rank."""
    files = spark.read.parquet(f"{path}/files")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    totals = files.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()  # one small row a file
    before = np.cumsum([0, *(r.n for r in totals)])
    offsets = spark.createDataFrame([(r.part, int(b)) for r, b in zip(totals, before, strict=False)], "part int, before long")
    return files.join(F.broadcast(offsets), "part"), np.array([r.id for r in ranks], "<u4")


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of the files: key, start (ids of all documents before), n_tokens, and ids (little-endian unsigned 32-bit integers) or their crc32."""
    files, id_of = _files(spark, path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = batch.column("counts")[i].values.to_numpy().astype(np.int64)
                bounds = np.cumsum(np.append(0, counts))
                ids = id_of[unpack_ranks(batch.column("control")[i].as_buffer(), batch.column("data")[i].as_buffer(), int(bounds[-1]))]
                raw, at = memoryview(ids).cast("B"), (4 * bounds).tolist()
                start = pa.array(batch.column("before")[i].as_py() + batch.column("start")[i].as_py() + bounds[:-1])
                if digest:
                    last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
                else:
                    last = pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, start, pa.array(counts), last], ["key", "start", "n_tokens", "ids"])

    kind = files.schema["keys"].dataType.elementType.simpleString()
    return files.select("before", "start", "keys", "counts", "control", "data").mapInArrow(decoded, f"key {kind}, start long, n_tokens long, ids {'long' if digest else 'binary'}")
