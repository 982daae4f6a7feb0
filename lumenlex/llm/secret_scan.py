"""Secret scans with corpus-wide ownership frequency.

Every text is scanned whole for three fixed kinds of span and for further
candidates: long mixed strings of high entropy.  The values' hashes are counted
over the corpus by distinct repositories and owners.  A value that many owners
carry, or many repositories of few owners, is a copied example; one that few
carry looks live.  Further
candidates count only if they look live; spans of the fixed kinds always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlex.llm.chunks import slices
from lumenlex.llm.spread import joined
from lumenlex.storage import Scratch, materialize

# The kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Any text with a span has a match; linear in Arrow's regex engine, so most texts never reach Python.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|[A-Za-z0-9+/_=-]{20}"""

#: Least entropy (bits a character) of a further candidate.
ENTROPY = 3.5
#: A value of more owners than this is a copied example.
LIVE_OWNERS = 2
#: And so is one of more repositories, whoever owns them.
LIVE_REPOSITORIES = 8
#: Spans up to which those to be masked are broadcast; a few MB.
FEW_SPANS = 200_000

FIGURES = ("n_live", "n_example", "most_owners", "most_repositories")
SPAN = "struct<kind:string,start:int,end:int,hash:string>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in order of start, then kind; code points, end exclusive."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end(), m[0]) for m in LONG_HEX.finditer(text)]  # [0-9a-f]+ of 32 or more
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Mixed strings outside the base spans."""
    found = []
    for m in MIXED.finditer(text):
        value = m[0]
        if any(s < m.end() and m.start() < e for _, s, e, _ in base):
            continue
        if re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value) and entropy(value) >= ENTROPY:
            found.append(("owned", m.start(), m.end(), value))
    return found


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "source", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """A row for each document: key, text_sha256, base and spans (arrays of kind, start, end, hash), n_live, n_example, and the most owners and repositories that any value of its spans has.

    ``text_sha256`` tells rows of one key apart; it is null for texts without spans and candidates.

    The owner of a repository is the part of its name before the first ``/``, or
    the whole name without one.  A document of a null or empty repository has an
    unknown owner, and counts as a repository and owner of its own.  A null or
    empty text has no spans; rows that repeat a key are scanned each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))

        def rows(spans: list[tuple[str, int, int, str]]) -> list[dict]:
            return [{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()} for k, s, e, v in spans]

        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                hit = pc.fill_null(pc.match_substring_regex(texts, ANY), False).to_pylist()
                base: list[list[dict]] = []
                more: list[list[dict]] = []
                sums: list[str | None] = []
                for i, h in enumerate(hit):
                    value = texts[i].as_py() if h else ""
                    spans = base_spans(value) if h else []
                    base.append(rows(spans))
                    more.append(rows(candidates(value, spans)) if h else [])
                    sums.append(hashlib.sha256(value.encode()).hexdigest() if base[-1] or more[-1] else None)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("repository"), pa.array(sums, pa.string()), pa.array(base, kind), pa.array(more, kind)], ["key", "repository", "text_sha256", "base", "more"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.nullif(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(run, f"key {kind}, repository string, text_sha256 string, base array<{SPAN}>, more array<{SPAN}>")
    with Scratch(docs.sparkSession, "secret-scan") as tables:
        return materialize(_judged(found, key, live_owners, live_repositories, tables), "scanned")


def _judged(found: DataFrame, key: str, live_owners: int, live_repositories: int, tables: Scratch) -> DataFrame:
    found = tables.table(found.withColumn("uid", F.monotonically_increasing_id()), "found", small_batches=True)
    unknown = F.concat(F.lit("\0"), F.col("uid").cast("string"))
    spans = tables.table(found.select("uid", F.coalesce("repository", unknown).alias("repository"), F.inline(F.concat("base", "more"))), "spans")
    held = spans.groupBy("hash", "repository").agg(F.count(F.lit(1)).alias("n")).withColumn("owner", F.substring_index("repository", "/", 1))
    owners = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n"))
    owners = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repositories").alias("n_repositories"), F.sum("n").alias("n_spans"))
    judged = joined(spans, tables.table(owners, "owners"), ["hash"], "n_spans", spans.count())
    judged = judged.withColumn("live", (F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories))
    own = judged.where((F.col("kind") != "owned") | F.col("live")).groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("start", F.array_position(F.lit(list(KINDS)), F.col("kind")).alias("place"), "kind", "end", "hash"))).alias("all"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
    )
    all_spans = F.coalesce(F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hash"].alias("hash"))), F.array().cast(f"array<{SPAN}>"))
    figures = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FIGURES]
    return found.join(own, "uid", "left").select(F.col("key").alias(key), "text_sha256", "base", all_spans.alias("spans"), *figures)


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans in one string."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(key, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *FIGURES)


def mask(docs: DataFrame, scanned: DataFrame, key: str = "doc_id", text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """The documents, with each span of ``scanned`` replaced in the text; overlapping spans become one.

    Rows that repeat a key, null keys among them, get the spans of their own
    text: the join is by key and the hash of the text.  Only documents with
    spans are joined, by broadcast as long as they have few; all other rows, null
    and empty texts among them, and all other columns pass unchanged, but for
    ``n_chars``, which follows the text if it is there.
    """
    places = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    spans = scanned.where(F.size("spans") > 0).select(F.col(key).alias("_key"), F.col("text_sha256").alias("_sha256"), places.alias("_spans")).dropDuplicates(["_key", "_sha256"])
    spans = materialize(spans, "places")
    most = spans.agg(F.sum(F.size("_spans"))).first()[0] or 0
    spans = F.broadcast(spans) if most <= FEW_SPANS else spans

    @F.pandas_udf("string")
    def replaced(texts, spans):  # noqa: ANN001, ANN202
        out = []
        for value, found in zip(texts, spans, strict=True):
            if found is None or value is None:
                out.append(value)
                continue
            parts, at = [], 0
            for s in found:
                if s["start"] >= at:
                    parts += [value[at : s["start"]], by]
                at = max(at, s["end"])
            out.append("".join(parts) + value[at:])
        return type(texts)(out, dtype=object)

    sizes = {"n_chars": F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    joined_docs = docs.join(spans, F.col(key).eqNullSafe(F.col("_key")) & (F.sha2(F.col(text).cast("string"), 256) == F.col("_sha256")), "left")
    return joined_docs.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(replaced(F.col(text), F.col("_spans")))).withColumns(sizes).select(*docs.columns)
