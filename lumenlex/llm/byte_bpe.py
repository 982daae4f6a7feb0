"""Byte-level BPE with a hierarchical-bitmap rank queue.

All distinct pre-tokens of a batch form one linked list of bytes with gaps
between the pre-tokens.  Every adjacent pair that the vocabulary can merge
waits in the bucket of its merge rank, as its list position.  A three-level
bitmap tells the lowest rank that has a bucket (find first set); entries whose
pair has changed since are stale and skipped.  A bucket is merged as one numpy
operation, so a very long pre-token costs no more a byte than many short ones.

A null text counts as empty and has no ids.  Nothing is cut: each text is
encoded whole, whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlex.llm.chunks import ChunkEncoder, slices, split_at_words, to_lists

#: Bytes of text whose pre-tokens are merged at once: each merge rank that occurs costs one round of the queue, however few pairs it has.
MERGED_BYTES = 8 << 20


class BitmapQueue:
    """Positions by merge rank; ``pop`` gives those of the lowest rank."""

    def __init__(self, ranks: int):
        self.levels = [[0] * (ranks // 64 + 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * ((len(self.levels[-1]) - 1) // 64 + 1))
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            rank, bit = rank >> 6, rank & 63
            level[rank] |= 1 << bit

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = at << 6 | (word & -word).bit_length() - 1
        rest = at
        for level in self.levels:
            word, bit = rest >> 6, rest & 63
            level[word] &= ~(1 << bit)
            if level[word]:
                break
            rest = word
        return at, self.buckets.pop(at)


class Vocabulary:
    """Merge ranks of a ``.tiktoken`` file (token in base64, blank, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(self.ranks.values()) + 1
        by_rank = [b""] * self.size
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.tokens = pa.array(by_rank, pa.binary())
        self.whole = pa.array(list(self.ranks), pa.binary())
        self.whole_ranks = np.fromiter(self.ranks.values(), np.int32)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        #: Ranks whose token can take part in a pair of lower rank: their merges must go one by one.
        self.wary = set()
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
                    self.wary.update(x for x in (a, b) if x > rank)
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.first = np.array([[pairs.get(int(a) * self.size + int(b), -1) for b in self.bytes] for a in self.bytes], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces that begin at ``starts``, and how many each piece has."""
        n = len(data)
        last = np.zeros(n, bool)
        last[np.append(starts[1:], n) - 1] = True
        token = np.append(self.bytes[data], -1)
        follow = np.arange(1, n + 2, dtype=np.int32)
        follow[:n][last] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[starts] = n
        alive = np.ones(n, bool)
        pair = np.full(n + 1, -1, np.int32)
        pair[: n - 1] = np.where(last[:-1], -1, self.first[data[:-1], data[1:]])
        piece = np.cumsum(np.bincount(starts, minlength=n), dtype=np.int32) if self.wary else None
        queue = BitmapQueue(self.size)
        self._push(queue, pair, np.flatnonzero(pair >= 0))
        while (popped := queue.pop()) is not None:
            rank, parts = popped
            at = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
            at = at[pair[at] == rank]  # the others are stale
            if len(parts) > 1:
                at = at[np.append(True, at[1:] != at[:-1])[: len(at)]]
            if not len(at):
                continue
            if len(at) > 1:
                linked = follow[at[:-1]] == at[1:]
                if linked.any():  # in a a a the leftmost pair is merged
                    index = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(np.append(False, linked), 0, index))
                    at = at[(index - head) % 2 == 0]
                if rank in self.wary:
                    later = piece[at[1:]] == piece[at[:-1]]
                    rest = at[1:][later]
                    at = at[np.append(True, ~later)]
                    if len(rest):
                        queue.push(rank, rest)
            gone = follow[at]
            after = follow[gone]
            token[at] = rank
            alive[gone] = False
            pair[gone] = -1
            follow[at] = after
            before[after] = at
            left = before[at]
            left = left[left < n]
            touched = np.concatenate((at, left)) if len(left) else at
            right = follow[touched]
            pair[touched] = np.where(right < n, self.pair_ranks(token[touched], token[right]), -1)
            self._push(queue, pair, touched[pair[touched] >= 0])
        return token[:n][alive], np.add.reduceat(alive, starts, dtype=np.int64) if n else np.zeros(0, np.int64)

    @staticmethod
    def _push(queue: BitmapQueue, pair: np.ndarray, at: np.ndarray) -> None:
        if not len(at):
            return
        if len(at) > 1:
            at = at[np.argsort(pair[at], kind="stable")]
        ranks = pair[at]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        if not len(cuts):
            queue.push(int(ranks[0]), at)
            return
        bounds = [0, *cuts.tolist(), len(at)]
        for rank, a, b in zip(ranks[np.append(0, cuts)].tolist(), bounds, bounds[1:], strict=False):
            queue.push(rank, at[a:b])

    def encode_pieces(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of each piece; a piece that is a token needs no merging."""
        whole = pc.index_in(pieces, value_set=self.whole)
        rest = pieces.filter(pc.is_null(whole))
        place = pc.fill_null(whole, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.whole) + np.arange(len(rest))
        ids = to_lists(self.whole_ranks, np.ones(len(self.whole), np.int64))
        if len(rest):
            rest = pa.concat_arrays([rest])
            offsets = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1].astype(np.int64)
            data = np.frombuffer(rest.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            ids = pa.concat_arrays([ids, to_lists(*self.merge(data, offsets[:-1] - offsets[0]))])
        return ids.take(pa.array(place))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def chunk_encoder(path: str, pattern: str) -> ChunkEncoder:
    """Chunks to pre-tokens by the pattern, distinct pre-tokens to ids by the queue."""
    vocab = vocabulary(path)
    # The library's \s is the White_Space property.
    find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def encode(chunks: pa.Array) -> pa.ListArray:
        found = [find(x.decode("utf-8", "replace")) for x in chunks.to_pylist()]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        pieces = pa.array([x for xs in found for x in xs], pa.string()).cast(pa.binary()).dictionary_encode()
        ids = vocab.encode_pieces(pieces.dictionary).take(pieces.indices)
        where = ids.offsets.to_numpy(zero_copy_only=False)
        bounds = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        return pa.ListArray.from_arrays(pa.array((where - where[0])[bounds].astype(np.int32)), ids.flatten())

    return ChunkEncoder(split_at_words, encode)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row; other columns are dropped. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, size=MERGED_BYTES):
                flat, where = encoder(part.column("text"))
                ids = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("key"), ids], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_batch(ids: pa.ListArray, vocab: Vocabulary) -> pa.Array:
    """Bytes of each list of ids."""
    where = ids.offsets.to_numpy(zero_copy_only=False)
    pieces = vocab.tokens.take(ids.flatten())
    spans = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(spans[where - where[0]])), pieces.buffers()[2] if len(pieces) else pa.py_buffer(b"")])


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` and the ``decoded`` bytes of each row of :func:`encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = pc.fill_null(part.column("ids"), pa.scalar([], pa.list_(pa.int32())))
                ids = pa.concat_arrays([ids])
                yield pa.RecordBatch.from_arrays([part.column("key"), ids, decode_batch(ids, vocab)], ["key", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode the ids, and return counts and hashes of both, in one pass without a shuffle.

    ``ids_sha256`` hashes the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` the decoded bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocab = chunk_encoder(path, pattern), vocabulary(path)
        for batch in batches:
            for part in slices(batch, size=MERGED_BYTES):
                flat, where = encoder(part.column("text"))
                raw, bounds = memoryview(np.ascontiguousarray(flat.astype("<u4", copy=False))).cast("B"), where.tolist()
                ids_sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
                decoded = decode_batch(pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pa.array(flat)), vocab)
                text_sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(np.diff(where)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
