"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library.

White space only separates words for such a tokenizer, so a text's ids are
those of its words one after another.  Each worker gives the distinct words of
a batch to the library: plain words joined by blanks in one string, as each
ends with an end-of-word token, and all others one by one.

Texts with a special-token string, or with an ASCII capital before a combining
mark (it may compose with the small letter only), are cut at white space alone
and reach the library as they are.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlex.llm.chunks import BLANK, LOWER, ChunkEncoder, slices, split_at_ascii_words, split_at_words_and_stops, to_lists

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Plain words in a string for the library, and words with it at a time.
JOINED, AT_ONCE = 200, 20_000


class TextEncoder:
    """Ids of texts by ``usual``, and by ``whole`` for those that match ``odd``."""

    def __init__(self, usual: ChunkEncoder, whole: ChunkEncoder, odd: str):
        self.usual, self.whole, self.odd = usual, whole, odd

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more at the end)."""
        odd = pc.fill_null(pc.match_substring_regex(text, self.odd), False)
        if not pc.any(odd).as_py():
            return self.usual(text)
        parts = [(encoder(text.filter(mask)), mask.to_numpy(zero_copy_only=False)) for encoder, mask in ((self.usual, pc.invert(odd)), (self.whole, odd))]
        counts = np.empty(len(text), np.int64)
        for (_, where), mask in parts:
            counts[mask] = np.diff(where)
        bounds = np.append(0, np.cumsum(counts))
        flat = np.empty(bounds[-1], np.int32)
        for (ids, _), mask in parts:
            flat[np.repeat(mask, counts)] = ids
        return flat, bounds


@lru_cache(maxsize=1)
def _library(path: str) -> Tokenizer:
    """One for all encoders of a worker, which tell it each time what to do with special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def chunk_encoder(path: str, special_tokens: bool = False) -> TextEncoder:
    """With ``special_tokens``, their strings in a text get their own ids, as the library does unless told otherwise; without, they are ordinary text."""
    library = _library(path)
    strings = [re.escape(x.content) for x in library.get_added_tokens_decoder().values()] if special_tokens else []
    odd = "|".join([r"[A-Z]\p{M}", *(f"(?i:{x})" for x in strings)])
    # Folding makes special-token strings of others, so only whole words see the library's way with them.
    usual = ChunkEncoder(split_at_words_and_stops, _encoder(path, False), keep=500_000, fold=LOWER)
    return TextEncoder(usual, ChunkEncoder(split_at_ascii_words, _encoder(path, special_tokens), keep=100_000, fold=BLANK), odd)


def _encoder(path: str, special_tokens: bool) -> Callable[[pa.Array], pa.ListArray]:
    """``encode(distinct chunks) -> lists of ids``."""
    library = _library(path)
    vocab = library.get_vocab()
    ends = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        ends[i] = token.endswith("</w>")

    def ids_of(texts: list[str]) -> list[list[int]]:
        library.encode_special_tokens = not special_tokens
        return [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(chunks: pa.Array) -> pa.ListArray:
        # The library's results are large beside their ids, so few words are with it at once.
        return pa.concat_arrays([encode_some(chunks.slice(i, AT_ONCE)) for i in range(0, len(chunks), AT_ONCE)])

    def encode_some(chunks: pa.Array) -> pa.ListArray:
        words = [x.decode("utf-8", "replace").strip(" ") for x in chunks.to_pylist()]
        plain = np.fromiter((x.isalpha() and (x.isascii() or unicodedata.normalize("NFC", x).lower().isalpha()) for x in words), bool, len(words))
        at = np.flatnonzero(plain)
        flat, counts = [], np.zeros(len(words), np.int64)
        joined = [at[i : i + JOINED] for i in range(0, len(at), JOINED)]
        alone = [np.flatnonzero(~plain)]
        for group, ids in zip(joined, ids_of([" ".join(words[i] for i in group) for group in joined]), strict=True):
            ids = np.array(ids, np.int32)
            stops = np.flatnonzero(ends[ids])
            if len(stops) == len(group) and stops[-1] == len(ids) - 1:
                counts[group] = np.diff(stops, prepend=-1)
                flat.append(ids)
            else:  # some word is more than one
                alone.append(group)
        order = [g for g in joined if counts[g[0]]]
        rest = np.concatenate(alone)
        lists = ids_of([words[i] for i in rest])
        counts[rest] = np.fromiter(map(len, lists), np.int64, len(lists))
        flat.append(np.fromiter(itertools.chain.from_iterable(lists), np.int32))
        order = np.concatenate([*order, rest])
        ids = to_lists(np.concatenate(flat), counts[order])
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return ids.take(pa.array(back))

    return encode


def id_width(path: str, end_id: int) -> str:
    """The numpy type that holds every id."""
    return "<u2" if max(end_id, *_library(path).get_vocab().values()) < 1 << 16 else "<u4"


def encode_batch(encoder: TextEncoder, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with ``end_id`` behind it, and the bounds of the texts."""
    flat, where = encoder(text)
    return np.insert(flat, where[1:], end_id), where + np.arange(len(where))


def encode(docs: DataFrame, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text", width: str = "<u4", special_tokens: bool = False) -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` (bytes of numpy type ``width``) of every row.

    A null text counts as empty: only the end id. ``special_tokens`` as in
    :func:`chunk_encoder`. Narrow; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path, special_tokens)
        for batch in batches:
            for part in slices(batch):
                flat, where = encode_batch(encoder, part.column("text"), end_id)
                raw = pa.py_buffer(np.ascontiguousarray(flat.astype(width, copy=False)))
                ids = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((np.dtype(width).itemsize * where).astype(np.int32)), raw])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(where)), ids], ["key", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)
