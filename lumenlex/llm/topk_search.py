"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets of bounded size, so a bucket's
longest vector bounds every product in it.  A query meets the buckets in
descending length, with a running threshold: its k-th best product so far.
Divided by the two lengths, that is the cosine a bucket's vectors must reach.
Above one, the bucket is passed over; if high, few coordinates of each vector
decide which can reach it; if low, only the bucket's long enough vectors are
taken.  What is left is verified by exact products.

Every query first meets the few longest blocks, which gives it a threshold to
begin with.  After that a block of vectors is sent only to those blocks of
queries of which some can reach their threshold in it, and each cell where they
meet holds a bounded number of blocks, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlex.storage import materialize

#: Local cosine thresholds from which coordinates prune better than lengths.
HIGH_COSINE = 0.6
FOCUS = 3
EXACT = 2.0**53
#: The longest blocks, which all queries meet first; a few MB.
FIRST = 2
#: Blocks of vectors in a cell, about.
CELL = 32
#: Queries whose products are taken at once.
AT_ONCE = 512


def integers(vectors: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or has a null or non-finite component."""
    whole = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(whole, F.transform(vectors, lambda x: F.floor(scale * x.cast("double")).cast("double")))


def width(rows: DataFrame) -> str:
    """The smallest numpy type that holds every component."""
    most = rows.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"


def blocks(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Rows (id, vector, norm) as blocks of about ``size`` vectors of similar length, components as numpy type ``kind``.

    Buckets are ranges of the norm; rows of one norm, however many, are dealt over the blocks of their bucket.
    """
    n = rows.count()
    count = max(1, min(4096, -(-n // size)))
    edges = sorted(set(rows.approxQuantile("norm", [i / count for i in range(1, count)], 0.2 / count))) if count > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("norm"))) if edges else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    many = {r.bucket: -(-r["count"] // size) for r in rows.groupBy("bucket").count().collect()}  # at most 4096 rows
    salts = F.element_at(F.create_map(*(F.lit(x) for pair in many.items() for x in pair)), F.col("bucket")) if many else F.lit(1)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), salts).cast("int"))

    def block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("norm", ascending=False, kind="stable")
        dim = max(map(len, group["vector"]))
        matrix = np.zeros((len(group), dim), kind)
        for i, v in enumerate(group["vector"]):
            matrix[i, : len(v)] = v
        norm = group["norm"].to_numpy()
        return pd.DataFrame({"block": [(int(group["bucket"].iloc[0]) << 32) + int(group["salt"].iloc[0])], "top": [norm[0]], "ids": [group["id"].to_numpy(np.int64).tobytes()], "vectors": [matrix.tobytes()]})

    return rows.groupBy("bucket", "salt").applyInPandas(block, "block long, top double, ids binary, vectors binary")


class Search:
    """Running top k of a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, threshold: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.norms = np.sqrt((queries**2).sum(1))
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        self.threshold = np.full(len(ids), -np.inf) if threshold is None else threshold.copy()
        self.taken = 0  # products that were computed

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (ids != self.ids[q]) & (scores >= self.threshold[q])
        if not keep.any():
            return
        scores, ids = scores[keep], ids[keep]
        if len(scores) > self.k:
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[keep], ids[keep]
        scores, ids = np.append(self.best[q][0], scores), np.append(self.best[q][1], ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.threshold[q] = max(self.threshold[q], scores[order[-1]])

    def reach(self) -> float:
        """Vectors shorter than this can't reach any query's threshold; minus infinity if a query takes every vector."""
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(self.threshold > 0, self.threshold / np.maximum(self.norms, 1e-300), -np.inf)
        return float(least.min(initial=np.inf)) * (1 - 1e-9)

    def visit(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A block whose vectors are in descending length."""
        norms = np.sqrt((vectors**2).sum(1))
        queries = self.queries
        width = max(vectors.shape[1], queries.shape[1])
        vectors, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, queries))
        exact = self.norms.max(initial=0) * norms[0] < EXACT
        slack = 1 + 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.threshold > 0, self.threshold / (self.norms * norms[0] * slack), -1.0)
        lengths, coordinates = [], []
        for q in np.flatnonzero(cosine <= 1):
            (coordinates if cosine[q] >= HIGH_COSINE else lengths).append(q)

        def product(q: np.ndarray | int, rows: np.ndarray | slice) -> np.ndarray:
            self.taken += np.size(q) * len(vectors[rows])
            if exact:
                return queries[q] @ vectors[rows].T
            big = queries[q].astype(object) @ vectors[rows].T.astype(object)
            return np.clip(big.astype(float), -(2.0**63), 2.0**63 - 1024)

        if lengths:
            # Those too short for every query of this kind end the block early.
            needed = np.where(self.threshold[lengths] > 0, self.threshold[lengths] / np.maximum(self.norms[lengths], 1e-300) / slack, 0)
            stop = int(np.searchsorted(-norms, -needed.min(), side="right"))
            for i in range(0, len(lengths), AT_ONCE):
                some = lengths[i : i + AT_ONCE]
                for q, scores in zip(some, product(np.array(some), slice(0, stop)), strict=True):
                    self.offer(q, scores, ids[:stop])
        if coordinates:
            unit = vectors / np.where(norms > 0, norms, 1)[:, None]
            for q in coordinates:
                direction = queries[q] / self.norms[q]
                needed = cosine[q]
                open_ = norms * self.norms[q] * slack >= self.threshold[q]
                for f in np.argsort(-np.abs(direction))[:FOCUS]:
                    middle, half = direction[f] * needed, np.sqrt(max(0.0, (1 - direction[f] ** 2) * (1 - needed**2)))
                    # A cosine of at least ``needed`` keeps the coordinate between these, unless the vector is closer still.
                    low = -1.0 if direction[f] < -needed else middle - half
                    high = 1.0 if direction[f] > needed else middle + half
                    open_ &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
                at = np.flatnonzero(open_)
                if len(at):
                    self.offer(q, product(q, at), ids[at])


def top_k(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block_size: int = 2048, query_block: int = 8192) -> DataFrame:
    """Each query's ``k`` highest integer products: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    All rows but the query's own are candidates.  Vectors that are null, or hold
    a null or non-finite component, take no part; nor do rows without an id.
    Shorter vectors count as padded by zeros.  Where rows repeat a query's id,
    it is asked once, by its smallest vector, and none of them is its candidate.
    """
    clean = rows.select(F.col(key).cast("long").alias("id"), integers(F.col(vector), scale).alias("vector"), is_query.alias("is_query")).where("id IS NOT NULL AND vector IS NOT NULL")
    clean = clean.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).withColumn("uid", F.monotonically_increasing_id())
    clean = materialize(clean, "vectors")
    kind = width(clean)
    asked = clean.where("is_query").groupBy("id").agg(F.min(F.struct("vector", "norm", "uid")).alias("row")).select("id", "row.*")
    candidates = materialize(blocks(clean, block_size, kind), "blocks")
    n = candidates.count()

    def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(row[f"{prefix}ids"].as_buffer(), np.int64)
        return ids, np.frombuffer(row[f"{prefix}vectors"].as_buffer(), kind).reshape(len(ids), -1).astype(float)

    longest = [(bytes(r.ids), bytes(r.vectors)) for r in candidates.orderBy(F.desc("top"), "block").limit(FIRST).collect()]

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries with their thresholds, and the length that a vector must have to reach any."""
        for batch in batches:
            for r in range(batch.num_rows):
                search = Search(*unpacked({c: batch.column(c)[r] for c in batch.schema.names}), k)
                for ids, vectors in longest:
                    ids = np.frombuffer(ids, np.int64)
                    search.visit(ids, np.frombuffer(vectors, kind).reshape(len(ids), -1).astype(float))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(r, 1), batch.column("ids").slice(r, 1), batch.column("vectors").slice(r, 1), pa.array([search.threshold.tobytes()], pa.binary()), pa.array([search.reach()])],
                    ["q", "q_ids", "q_vectors", "q_threshold", "reach"],
                )

    queries = blocks(asked, query_block, kind).select("block", "ids", "vectors")
    queries = materialize(queries.mapInArrow(begun, "q long, q_ids binary, q_vectors binary, q_threshold binary, reach double"), "queries")
    strips = sorted((r.reach, r.q) for r in queries.select("q", "reach").collect()) or [(float("inf"), -1)]  # one small row for each block of queries
    lanes = max(1, -(-n // CELL))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    left = queries.drop("reach").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    within = F.size(F.filter(F.lit([x for x, _ in strips]), lambda x: x <= F.col("top")))
    right = candidates.select("top", "ids", "vectors", lane.alias("lane"), F.explode(F.slice(F.lit([q for _, q in strips]), F.lit(1), within)).alias("q"))

    def met(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        """A cell: one block of queries, and the blocks of vectors that were sent to it, longest first."""
        scores, ids, counts, who = [np.zeros(0)], [np.zeros(0, np.int64)], [], np.zeros(0, np.int64)
        if asked.num_rows and blocks.num_rows:
            row = {c: asked[c][0] for c in asked.column_names}
            search = Search(*unpacked(row, "q_"), k, np.frombuffer(row["q_threshold"].as_buffer()))
            for i in np.argsort(-blocks["top"].to_numpy(), kind="stable").tolist():
                search.visit(*unpacked({c: blocks[c][i] for c in ("ids", "vectors")}))
            who, counts = search.ids, [len(s) for s, _ in search.best]
            scores, ids = [s for s, _ in search.best], [i for _, i in search.best]
        return pa.table({"query_id": np.repeat(who, counts).astype(np.int64), "vec_id": np.concatenate(ids), "score": np.concatenate(scores).astype(np.int64)})

    best = left.groupBy("q", "lane").cogroup(right.groupBy("q", "lane")).applyInArrow(met, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
