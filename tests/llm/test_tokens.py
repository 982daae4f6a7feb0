"""Both tokenizers against their libraries, and token files read back."""

import hashlib
import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumenlex import storage
from lumenlex.llm import byte_bpe, packing, token_files, word_bpe

os.environ["TOKENIZERS_PARALLELISM"] = "false"
RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "b", "'s", "'t", "'", " ", " ", "  ", "\n", "\t", "　", " ", " ", "\x1c", "\x85", "é", "é", "漢", "😀", "1", "²", "_", ".", "<|endoftext|>", "aaaa", "the", "​", "\r\n", "ſ", "İ", "Σ", "ΑΣ", "̸", "=", "ǅ", "...", "?'", "'."]


def texts():
    rng = random.Random(1)
    out = [None, "", " ", "\n" * 999 + "x", "a" * 5000, "ab" * 3000, "ab " * 3000, "the quick brown fox " * 2000]
    return out + ["".join(rng.choices(BITS, k=rng.randint(0, 25))) for _ in range(3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", b"z") for i, t in enumerate(texts())] + [(None, "nobody", "x", "y", b"z"), (3, "again", "x", "y", b"z")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens string, ids binary").repartition(3)


def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(WORDS)
    out.encode_special_tokens = True
    return out


def test_byte_bpe(docs):
    vocab = byte_bpe.vocabulary(RANKS)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    want = {(r.doc_id, r.text): theirs.encode_ordinary(r.text or "") for r in docs.collect()}
    sha = sorted((len(v), hashlib.sha256(np.array(v, "<u4").tobytes()).hexdigest(), hashlib.sha256((k[1] or "").encode()).hexdigest()) for k, v in want.items())
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()) == sha
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, RANKS).collect()
    assert sorted((r.decoded, r.ids) for r in decoded) == sorted(((k[1] or "").encode(), v) for k, v in want.items())


def test_queue():
    queue, rng, held = byte_bpe.BitmapQueue(50_000), random.Random(2), set()
    for _ in range(3000):
        if held and rng.random() < 0.5:
            rank, _ = queue.pop()
            assert rank == min(held)
            held.remove(rank)
        else:
            rank = rng.randrange(50_000)
            queue.push(rank, np.zeros(1))
            held.add(rank)
    while held:
        held.remove(queue.pop()[0])
    assert queue.pop() is None


def test_repeated_merges_one_by_one():
    """Runs of one byte, where pairs overlap."""
    vocab = byte_bpe.vocabulary(RANKS)
    theirs = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocab.ranks, special_tokens={})
    for piece in (b"a" * n for n in range(1, 40)):
        ids, counts = vocab.merge(np.frombuffer(piece, np.uint8), np.array([0]))
        if piece not in vocab.ranks:
            assert ids.tolist() == theirs.encode_ordinary(piece.decode()) and counts.tolist() == [len(ids)]


def test_word_bpe(docs):
    theirs = library()
    want = sorted(np.array([*theirs.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in docs.collect())
    assert sorted(bytes(r.ids) for r in word_bpe.encode(docs, WORDS).collect()) == want


def test_token_files(spark, docs):
    theirs = library()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    path = token_files.write(docs, WORDS)
    out = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.key for r in out] == [r.doc_id for r in rows]
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert sorted(bytes(r.ids) for r in out) == sorted(np.array([*theirs.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in rows)
    crc = {(r.start, r.ids) for r in token_files.read(spark, path, digest=True).collect()}
    assert crc == {(r.start, zlib.crc32(bytes(r.ids))) for r in out}


@pytest.mark.parametrize("high", [2, 300, 70_000, 2**32])
def test_codes(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        control, data = token_files.pack_ranks(ranks)
        assert len(control) == -(-n // 4) and token_files.unpack_ranks(control, data, n).tolist() == ranks.tolist()


def test_pieces(docs):
    theirs = library()
    out = {}
    for r in packing.pieces(docs.where("doc_id IS NOT NULL AND NOT text <=> 'again'"), WORDS, capacity=50).collect():
        out.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts()):
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(out[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 50))) and [r.start for r in parts] == list(range(0, len(ids), 50))
        assert b"".join(bytes(r.ids) for r in parts) == np.array(ids, "<u4").tobytes() and [r.length for r in parts] == [len(r.ids) // 4 for r in parts]


def test_sequences(docs):
    packed = packing.pack(packing.pieces(docs, WORDS, capacity=200), capacity=200, group_size=1000)
    total = sum(r.length for r in packed.collect())
    out = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in out) == 4 * total and max(len(r.ids) for r in out) <= 800


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_files.read(spark, token_files.write(none, WORDS)).count() == 0
    assert packing.pack(packing.pieces(none, WORDS)).count() == 0


def test_special_tokens_and_capitals_before_marks(spark, tmp_path):
    """Ids of the library as it is, also through the registered queries."""
    from tokenizers import Tokenizer

    from lumenlex.llm import queries

    theirs, rng = Tokenizer.from_file(WORDS), random.Random(4)
    bits = [*BITS, "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "H\u0331", "h\u0331", "T\u0308", "J\u030c", "W\u030a", "A\u0301", "The", "\u0338"]
    texts = [None, "", "a <|endoftext|> b", "H\u0331 x", "the end. " * 500 + "<|endoftext|>"] + ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: [*theirs.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert want[2] == [320, 49407, 321, 1]
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in word_bpe.encode(docs, WORDS, special_tokens=True).collect()} == want
    ordinary = library()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in word_bpe.encode(docs, WORDS).collect()} == {i: [*ordinary.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    crc = {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in queries.op8_token_files(spark, str(tmp_path)).collect()} == crc
    assert {r.doc_id: (r.length, r.ids_crc32) for r in queries.op10_packing(spark, str(tmp_path)).collect()} == crc


def test_pieces_reach_workers_in_small_batches(spark):
    """Batches of whole texts are of a few MB while pieces are stored; the session's own setting stays."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"length": [batch.nbytes]})

    setting = spark.conf.get(storage.BATCH)
    docs = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 16_000).alias("text"))
    lengths = [r.length for r in packing.pack(docs.mapInArrow(sizes, "length long")).collect()]
    assert sum(lengths) >= 16_000_000 and max(lengths) <= 5_000_000
    assert spark.conf.get(storage.BATCH) == setting


MEMORY = r"""
import re, sys
import numpy as np
import pyarrow as pa
from lumenlex.llm import chunks, word_bpe

def text():
    words = rng.integers(97, 123, (750, 6), np.uint8)
    words[:, 5] = 32
    words[::2] = 97
    return words.tobytes().decode()

def peak():
    return int(re.search(r"VmHWM:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

rng = np.random.default_rng(5)
encoder = word_bpe.chunk_encoder(sys.argv[1], True)
batch = pa.record_batch({"text": [text() for _ in range(8000)]})
before = peak()
tokens = sum(len(word_bpe.encode_batch(encoder, part.column("text"), 1)[0]) for part in chunks.slices(batch))
print(tokens, peak() - before)
"""


def test_memory_of_a_batch():
    """What a worker adds to a batch of texts does not follow the batch's size: 36 MB here, half of its words mostly distinct."""
    out = subprocess.run([sys.executable, "-c", MEMORY, WORDS], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 6_000_000 and float(out[1]) < 100
