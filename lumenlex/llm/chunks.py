"""Encoding texts through the distinct chunks of an Arrow batch.

Both tokenizers used here treat a text as independent chunks.  A batch's text
buffer is cut into chunks with numpy, Arrow's dictionary encoding finds the
distinct ones, only those are encoded, and Arrow's ``take`` spreads the ids
over the documents again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once inside an Arrow batch; a worker's copies of them and indices are tens of times as large.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: ASCII letters to lower case, ASCII white space to blanks.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[[9, 10, 11, 12, 13]] = 32
#: ASCII white space to blanks alone.
BLANK = np.arange(256, dtype=np.uint8)
BLANK[[9, 10, 11, 12, 13]] = 32
_PUNCT = np.zeros(256, bool)
_PUNCT[33:127] = True
_PUNCT &= ~_ALNUM


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def unicode_space(data: np.ndarray) -> np.ndarray:
    """Marks every byte of each White_Space character of a UTF-8 buffer."""
    space = _SPACE[data]
    n = len(data)

    def mark(at: np.ndarray, width: int) -> None:
        for k in range(width):
            space[at + k] = True

    two = np.flatnonzero(data[: n - 1] == 0xC2)
    mark(two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)], 2)
    for lead in (0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data[: max(0, n - 2)] == lead)
        if len(at):
            b, c = data[at + 1], data[at + 2]
            if lead == 0xE1:
                hit = (b == 0x9A) & (c == 0x80)
            elif lead == 0xE2:
                hit = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
            else:
                hit = (b == 0x80) & (c == 0x80)
            mark(at[hit], 3)
    return space


def split_at_words(data: np.ndarray) -> np.ndarray:
    """Starts of chunks ``White_Space* non-space+``: no match of a byte-level pre-tokenizer spans two."""
    space = unicode_space(data)
    return _runs(space)[0]


def split_at_words_and_stops(data: np.ndarray) -> np.ndarray:
    """As above by ASCII white space, and before ASCII punctuation that ends a word.

    A word tokenizer drops the white space and never joins a letter or digit
    with punctuation, unless an apostrophe starts a contraction.
    """
    space = _SPACE[data]
    starts, ends = _runs(_PUNCT[data])
    padded = np.append(data, 32)
    stops = starts[(starts > 0) & _ALNUM[padded[starts - 1]] & (padded[starts] != 39) & _SPACE[padded[ends]]]
    return np.concatenate((_runs(space)[0], stops))


def split_at_ascii_words(data: np.ndarray) -> np.ndarray:
    """Starts of chunks ``ASCII white space* other+``."""
    return _runs(_SPACE[data])[0]


class ChunkEncoder:
    """``encode(distinct chunks) -> lists of ids``, remembered for up to ``keep`` chunks of a worker.

    ``fold`` maps each byte to one that the encoder treats alike, so that fewer chunks are distinct.
    """

    def __init__(self, split: Callable[[np.ndarray], np.ndarray], encode: Callable[[pa.Array], pa.ListArray], keep: int = 500_000, fold: np.ndarray | None = None):
        self.split, self.encode, self.keep, self.fold = split, encode, keep, fold
        self.known = pa.array([], pa.binary())
        self.ids = pa.array([], pa.list_(pa.int32()))

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more at the end)."""
        text = text.cast(pa.binary())
        if text.null_count:
            text = pc.fill_null(text, b"")
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        base, ends = ends[0], ends - ends[0]
        if ends[-1] == 0:
            return np.zeros(0, np.int32), np.zeros(len(text) + 1, np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8)[base : base + ends[-1]]
        if self.fold is not None:
            data = self.fold[data]
        begins = np.zeros(len(data), bool)
        begins[self.split(data)] = True
        begins[ends[:-1][ends[:-1] < ends[-1]]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, ends[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes, words = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, self.encode(new)]) if len(new) else self.ids
        if room := max(0, self.keep - len(self.known)):
            self.known = pa.concat_arrays([self.known, new.slice(0, room)])
            self.ids = ids.slice(0, len(self.known))
        spread = ids.take(pa.array(place[codes]))
        where = spread.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        flat = spread.flatten().to_numpy(zero_copy_only=False)
        return flat, (where - where[0])[np.searchsorted(starts, ends)]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text bytes; a longer text is a piece of its own. After the last, memory that Arrow has freed but kept goes back."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // size
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(lengths)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def to_lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))
