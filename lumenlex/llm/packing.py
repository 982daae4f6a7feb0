"""Best-fit packing into sequences of bounded length by bin completion.

Documents become pieces of at most ``capacity`` ids.  Pieces are dealt evenly
into groups of about ``group_size``; each group is packed on its own, so the
work spreads over executors and costs at most one part-filled sequence a group.

Inside a group the incumbent is best-fit decreasing.  While it is above the
lower bound, branch and bound completes the sequence of the largest piece left
with each undominated filling, best fit first, and prunes a branch whose waste
already rules out a better packing.  Fillings have any number of pieces.  Only
``node_limit`` bounds the search; the best packing found so far stands, and no
piece is ever dropped.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlex.llm import word_bpe
from lumenlex.llm.chunks import slices
from lumenlex.storage import materialize

#: Bins of a search whose tables of sums are kept.
KEPT_SUMS = 64


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths: each, in descending order, into the fullest bin that takes it."""
    room: list[int] = []  # ascending, with the bin of each beside it
    whose: list[int] = []
    bins: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, x)
        if at == len(room):
            left, b = capacity - x, len(bins)
            bins.append([x])
        else:
            left, b = room.pop(at) - x, whose.pop(at)
            bins[b].append(x)
        if left:
            at = bisect.bisect_left(room, left)
            room.insert(at, left)
            whose.insert(at, b)
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs: for each size k, pieces over capacity - k stand alone and those from k on must fill what is left."""
    count = np.bincount(lengths, minlength=capacity + 1)
    number = np.cumsum(count[::-1])[::-1]  # pieces of at least this length
    total = np.cumsum((count * np.arange(capacity + 1))[::-1])[::-1]
    k = np.arange(1, capacity // 2 + 1)
    big = np.append(number, 0)[capacity - k + 1]
    half = capacity // 2 + 1  # pieces over half a bin cannot meet
    middle_number = number[half] - big
    middle_room = middle_number * capacity - (total[half] - np.append(total, 0)[capacity - k + 1])
    small = total[k] - total[half]
    more = np.maximum(0, -(-(small - middle_room) // capacity))
    return int(max((big + middle_number + more).max(initial=0), -(-sum(lengths) // capacity)))


def reachable(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """For each i, as bits: the sums up to ``room`` of some of the first i lengths, each at most ``counts`` times."""
    mask, out = (1 << room + 1) - 1, [1]
    for x, n in zip(lengths, counts, strict=True):
        sums, step = out[-1], 1
        while n:
            step = min(step, n)
            sums |= sums << x * step & mask
            n -= step
            step *= 2
        out.append(sums)
    return out


class Fillings:
    """The undominated fillings of ``room`` by pieces of the ascending ``lengths``, fullest first, as far as they are asked for.

    All multisets of pieces that waste at most ``spare`` are met; ``next`` gives
    one, or an empty result for a dominated one, so that a caller can count both.
    A filling is dominated if some of its pieces can be replaced by one piece
    that is left, not smaller than them, which still fits: whatever packing uses
    the filling stays one when the pieces trade places.
    """

    def __init__(self, lengths: list[int], counts: list[int], room: int, spare: int):
        self.lengths, self.counts, self.room, self.spare = lengths, counts, room, spare
        self.sums: list[int] | None = None
        self.found = self._all()

    def next(self) -> tuple[bool, tuple[int, ...]] | None:
        """(whether it is undominated, the filling), or None at the end."""
        return next(self.found, None)

    def forget(self) -> None:
        """Gives up the table of sums, which is made again where it is needed."""
        self.sums = None

    def _sums(self) -> list[int]:
        if self.sums is None:
            self.sums = reachable(self.lengths, self.counts, self.room)
        return self.sums

    def _all(self) -> Iterator[tuple[bool, tuple[int, ...]]]:
        for waste in range(min(self.spare, self.room) + 1):
            if self._sums()[-1] >> self.room - waste & 1:
                for filling in self._exact(len(self.lengths), self.room - waste):
                    yield not self._dominated(filling, waste), filling

    def _exact(self, end: int, total: int) -> Iterator[tuple[int, ...]]:
        """Multisets of the first ``end`` lengths of that total, larger pieces first."""
        if not total:
            yield ()
            return
        for i in range(bisect.bisect_right(self.lengths, total, 0, end) - 1, -1, -1):
            x = self.lengths[i]
            for n in range(min(self.counts[i], total // x), 0, -1):
                if self._sums()[i] >> total - n * x & 1:
                    for rest in self._exact(i, total - n * x):
                        yield (x,) * n + rest
            if not self._sums()[i] >> total & 1:
                return  # no multiset of smaller lengths has this total

    def _dominated(self, filling: tuple[int, ...], waste: int) -> bool:
        used = Counter(filling)
        left = 0
        for x, n in zip(self.lengths, self.counts, strict=True):
            if n > used[x]:
                left |= 1 << x
        some, several = 1, 0  # sums of any of its pieces, and of two or more of them
        for x in filling:
            several |= (several | some & ~1) << x
            some |= some << x
        # A piece replaces pieces of its own sum, if these are several, or of a sum less by up to the waste.
        near, reach = some << 1, 1
        while reach < waste:
            step = min(reach, waste - reach)
            near |= near << step
            reach += step
        return bool(left & (several | near if waste else several))


def bin_completion(lengths: list[int], capacity: int, node_limit: int = 20_000) -> list[list[int]]:
    """As few bins as there can be, or as are found within ``node_limit`` nodes; never more than best-fit decreasing.

    A node is one filling, dominated or not, of one bin.
    """
    incumbent = best_fit(lengths, capacity)
    total, bound = sum(lengths), lower_bound(lengths, capacity)
    if len(incumbent) == bound:
        return incumbent
    count = Counter(lengths)
    left = sorted(count)

    def take(x: int, n: int) -> None:
        """Removes pieces of a length, or puts them back if n is negative."""
        if not count[x]:
            bisect.insort(left, x)
        count[x] -= n
        if not count[x]:
            left.pop(bisect.bisect_left(left, x))

    bins: list[list[int]] = []
    waste, nodes = 0, 0
    open_: list[Fillings] = []  # for each bin, the fillings still to try

    def spare() -> int:
        """Waste that a packing better than the incumbent may still have."""
        return (len(incumbent) - 1) * capacity - total - waste

    def start() -> None:
        largest = left[-1]
        bins.append([largest])
        take(largest, 1)
        fit = left[: bisect.bisect_right(left, capacity - largest)]
        open_.append(Fillings(fit, [count[x] for x in fit], capacity - largest, spare()))
        if len(open_) > KEPT_SUMS:
            open_[-KEPT_SUMS - 1].forget()

    start()
    while open_ and nodes < node_limit:
        nodes += 1
        tried = open_[-1].next()
        lost = 0 if tried is None else capacity - bins[-1][0] - sum(tried[1])
        if tried is None or lost > spare():  # nothing left to try here, as the rest wastes no less: back to the bin before
            open_.pop()
            take(bins.pop()[0], -1)
            if bins:
                for x in bins[-1][1:]:
                    take(x, -1)
                waste -= capacity - sum(bins[-1])
                del bins[-1][1:]
            continue
        good, filling = tried
        if not good:
            continue
        for x in filling:
            take(x, 1)
        bins[-1].extend(filling)
        waste += lost
        if left:
            start()
            continue
        if len(bins) < len(incumbent):
            incumbent = [b.copy() for b in bins]
            if len(incumbent) == bound:
                break
        for x in bins[-1][1:]:
            take(x, -1)
        waste -= lost
        del bins[-1][1:]
    return incumbent


def place(lengths: np.ndarray, capacity: int, node_limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Full pieces, and longer ones, have bins of their own and take no part in the search; those without length are at the start of bin 0."""
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = np.flatnonzero(lengths >= capacity)
    where[full] = np.arange(len(full))
    rest = np.flatnonzero((lengths < capacity) & (lengths > 0))
    by_length: dict[int, list[int]] = {}
    for i in rest.tolist():
        by_length.setdefault(int(lengths[i]), []).append(i)
    for b, items in enumerate(bin_completion(lengths[rest].tolist(), capacity, node_limit), len(full)):
        at = 0
        for x, k in Counter(items).items():
            for _ in range(k):
                i = by_length[x].pop()
                where[i], offset[i] = b, at
                at += x
    return where, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", special_tokens: bool = False) -> DataFrame:
    """A row for each piece: key, piece, start, length and ids (little-endian unsigned 32-bit integers).

    Only documents of over ``capacity`` ids (their end id included) are cut. A null or empty text is one piece, its end id.
    Rows that repeat a key are cut each for itself; other columns are dropped.
    ``special_tokens`` as in :func:`word_bpe.chunk_encoder`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe.chunk_encoder(tokenizer, special_tokens)
        for batch in batches:
            for part in slices(batch):
                flat, where = word_bpe.encode_batch(encoder, part.column("text"), end_id)
                size = np.diff(where)
                many = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                offsets = np.append(where[doc] + start, where[-1])
                ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat.astype("<u4", copy=False)))])
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids], ["key", "piece", "start", "length", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)


def pack(pieces: DataFrame, capacity: int = 4096, group_size: int = 20_000, node_limit: int = 20_000) -> DataFrame:
    """The pieces (any columns, one of them ``length``) with sequence_id and offset.

    Groups are dealt by row number, so rows that repeat one key spread as well. An empty table gives an empty one.
    A null, zero or negative length takes no room: such a piece is at offset 0 of some sequence. One over ``capacity``
    is a sequence of its own. Columns that are named like the results are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset", "_uid", "_group")
    rows = materialize(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces", small_batches=True)
    groups = max(1, round(rows.count() / group_size))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        where, offset = place(group["length"].fillna(0).to_numpy(np.int64), capacity, node_limit)
        return group.assign(sequence_id=where + (group["_group"].iloc[0].astype(np.int64) << 32), offset=offset)[columns]

    schema = rows.drop("_uid").schema.add("sequence_id", "long").add("offset", "long")
    columns = schema.names
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_uid"), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").applyInPandas(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and ids, joined in order of offset; at most ``capacity`` ids each."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return rows.select("sequence_id", F.aggregate("pieces", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
