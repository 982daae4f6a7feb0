"""Text analysis: white-space tokens, canonical forms, case mapping.

Each analyzer exists twice, for columns and for a query's terms in the driver;
both give the same tokens.  Null text stays null; empty text has no tokens.

ASCII texts are mapped by built-in functions; only others reach a Python worker.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, for Java and for Python.
JAVA_SPACE = r"(?U)\s+"
_TOKEN = regex.compile(r"\P{White_Space}+")
_AROUND = regex.compile(r"^\p{White_Space}+|\p{White_Space}+$")

FORMS = (None, "NFC", "NFKC")
CASES = (None, "lower", "fold")
MAX_FIELDS = 1024


@dataclass(frozen=True)
class Normalizer:
    """Canonical form, case mapping, and the canonical form again."""

    form: str | None = "NFC"
    case: str | None = "lower"

    def __post_init__(self) -> None:
        if self.form not in FORMS or self.case not in CASES:
            raise ValueError(f"form is one of {FORMS} and case one of {CASES}")

    def text(self, value: str) -> str:
        if self.form:
            value = unicodedata.normalize(self.form, value)
        if self.case:
            value = value.lower() if self.case == "lower" else value.casefold()
            value = unicodedata.normalize(self.form, value) if self.form else value
        return value

    def changes(self, value: str) -> bool:
        return self.text(value) != value

    @property
    def whole_text(self) -> bool:
        """Whether a whole text may be mapped before it is split: no step makes or removes white space."""
        return self.form != "NFKC"


class Mapping(Protocol):
    """What an analyzer takes as a normalizer: any hashable object with these two.

    ``whole_text`` says that a whole text may be mapped before it is split, which
    is so if no white space is made or removed and each token is mapped alike
    wherever it stands.
    """

    @property
    def whole_text(self) -> bool: ...

    def text(self, value: str) -> str: ...


def words(value: str) -> list[str]:
    """The white-space tokens of a text, in the driver."""
    return _TOKEN.findall(value)


def trimmed(value: str) -> str:
    """A text without the white space around it."""
    return _AROUND.sub("", value)


def split(value: Column) -> Column:
    """Array of the white-space tokens of a text."""
    return F.filter(F.split(value, JAVA_SPACE), lambda t: t != "")


@dataclass(frozen=True)
class Tokenizer:
    """How texts become tokens: as a column (text to array of strings), and its twin for a query's text in the driver."""

    column: Callable[[Column], Column]
    words: Callable[[str], list[str]]


WHITE_SPACE = Tokenizer(split, words)


@dataclass(frozen=True)
class Analyzer:
    """Tokens, each through the normalizers in turn."""

    normalizers: tuple[Mapping, ...] = (Normalizer(),)
    tokenizer: Tokenizer = WHITE_SPACE

    def text(self, value: str) -> str:
        for n in self.normalizers:
            value = n.text(value)
        return value

    def terms(self, value: str) -> list[str]:
        """Terms of a query text, in the driver."""
        return [self.text(t) for t in self.tokenizer.words(value)]

    def column(self, value: Column) -> Column:
        """Array of the terms of each text.

        Lower-casing alone stays in the JVM, and so do ASCII texts whatever the
        form; canonical forms and folding of others are not built in and go
        through Arrow, once for a text.
        """
        usual = all(isinstance(n, Normalizer) for n in self.normalizers)
        lower = F.lower if usual and any(n.case for n in self.normalizers) else lambda x: x
        if usual and all(n.form is None and n.case != "fold" for n in self.normalizers):
            return self.tokenizer.column(lower(value)) if self.tokenizer is WHITE_SPACE else F.transform(self.tokenizer.column(value), lower)
        if self.tokenizer is WHITE_SPACE and all(n.whole_text for n in self.normalizers):
            return split(self.mapped(value))
        if not usual:
            return self._mapped("array<string>")(self.tokenizer.column(value))
        plain = F.transform(self.tokenizer.column(value), lower)
        return F.when(_ascii(value), plain).otherwise(self._mapped("array<string>")(self.tokenizer.column(F.when(~_ascii(value), value))))

    def mapped(self, value: Column) -> Column:
        """The whole text through the normalizers."""
        if not all(isinstance(n, Normalizer) for n in self.normalizers):
            return self._mapped("string")(value)
        plain = F.lower(value) if any(n.case for n in self.normalizers) else value
        return F.when(_ascii(value), plain).otherwise(self._mapped("string")(F.when(~_ascii(value), value)))

    def _mapped(self, kind: str):  # noqa: ANN202
        one = self.text

        @F.pandas_udf(kind)
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in batches:
                if kind == "string":
                    yield values.map(one, na_action="ignore")
                else:
                    yield values.map(lambda xs: None if xs is None else [one(x) for x in xs])

        return mapped


def _ascii(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def _space(data: np.ndarray) -> np.ndarray:
    """Marks every byte of each White_Space character of a UTF-8 buffer."""
    space = np.isin(data, np.array([9, 10, 11, 12, 13, 32], np.uint8))
    if not len(data) or data.max() < 0x80:
        return space
    padded = np.append(data, np.zeros(2, np.uint8))
    code = padded[:-2].astype(np.uint32) << 16 | padded[1:-1].astype(np.uint32) << 8 | padded[2:]
    # U+0085 and U+00A0 in two bytes; U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F and U+3000 in three.
    two = np.isin(code >> 8, np.array([0xC285, 0xC2A0], np.uint32))
    three = np.isin(code, np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080], np.uint32))
    for mark, width in ((two, 2), (three, 3)):
        for k in range(width):
            space[k:] |= mark[: len(space) - k]
    return space


#: Bytes of text that are cut at once inside an Arrow batch.
SLICE_BYTES = 1 << 20


def _cut(values: pa.Array, analyzer: Analyzer, position_offset: int) -> tuple[pa.StructArray, np.ndarray]:
    """(text, position, start, end, term) of all tokens of some texts, and how many each text has; each distinct token is mapped once."""
    raw = values.cast(pa.large_binary())
    size = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(x or b"" for x in raw.to_pylist()), np.uint8)
    ends_of = np.cumsum(size)
    begins_of = ends_of - size
    word = np.append(~_space(data), False)
    first = np.zeros(len(data) + 1, bool)
    first[begins_of] = True  # a text's first byte begins a token even right behind another text's last
    before = np.append(False, word[:-1])
    starts = np.flatnonzero(word & (~before | first))
    stop = np.flatnonzero(before & (~word | first))
    row = np.searchsorted(ends_of, starts, side="right")
    counts = np.bincount(row, minlength=len(size))
    place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    texts = pa.array([data[a:b].tobytes() for a, b in zip(starts.tolist(), stop.tolist(), strict=True)], pa.binary()).cast(pa.string())
    distinct = texts.dictionary_encode()
    terms = pa.array([analyzer.text(x) for x in distinct.dictionary.to_pylist()], pa.string()).take(distinct.indices)
    own = begins_of[row]
    cells = pa.StructArray.from_arrays([texts, *(pa.array(x.astype(np.int32)) for x in (place + position_offset, starts - own, stop - own)), terms], ["text", "position", "start", "end", "term"])
    return cells, counts


def _slices(values: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive texts of about ``SLICE_BYTES`` in all, one at least, with the place of the first."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(values):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE_BYTES, side="right")))
        yield low, values.slice(low, high - low)
        low = high


def tokens(value: Column, analyzer: Analyzer = Analyzer(), position_offset: int = 0) -> Column:
    """Array of (text, position, start, end, term) of the white-space tokens; positions from the offset, byte ranges in UTF-8.

    Holds the tokens of a whole batch of texts; :func:`token_rows` does not.
    """
    kind = pa.struct([("text", pa.string()), ("position", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())])

    @F.arrow_udf("array<struct<text:string,position:int,start:int,end:int,term:string>>")
    def found(values: pa.Array) -> pa.Array:
        parts = [_cut(part, analyzer, position_offset) for _, part in _slices(values)]
        bounds = np.append(0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)]))).astype(np.int32)
        cells = pa.concat_arrays([c for c, _ in parts]) if parts else pa.array([], kind)
        return pa.ListArray.from_arrays(pa.array(bounds), cells, mask=pc.is_null(values))

    return found(value)


def token_rows(docs: DataFrame, key: str, text: str, analyzer: Analyzer = Analyzer(), position_offset: int = 0) -> DataFrame:
    """(key, text, position, start, end, term) as :func:`tokens` has them, a row each; a worker holds the tokens of one slice of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, part in _slices(batch.column("text")):
                cells, counts = _cut(part, analyzer, position_offset)
                own = batch.column("key").take(pa.array(low + np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([own, *cells.flatten()], ["key", "text", "position", "start", "end", "term"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, text string, position int, start int, end int, term string").withColumnRenamed("key", key)


def normalized(value: Column, normalizer: Normalizer = Normalizer()) -> Column:
    """The whole text through a normalizer."""
    if normalizer.form is None and normalizer.case != "fold":
        return F.lower(value) if normalizer.case else value
    return Analyzer((normalizer,)).mapped(value)


def needs_normalize(value: Column, normalizer: Normalizer = Normalizer()) -> Column:
    return normalized(value, normalizer) != value
