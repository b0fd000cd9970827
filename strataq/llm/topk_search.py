"""Exact top-k search by distributed histogram selection.

Every query is scored against every row. Each partition counts its scores in a histogram for each query; the sums
over all partitions tell in which bin each query's k-th score lies, and the next round splits just that bin, until
bins hold one value. Rows at or over the k-th score are then kept, at most k for each query and partition (no row
that ranks lower in its own partition can rank among the first k), and ties go to the smaller id.

Queries come in blocks of about QUERY_BLOCK, so that what is broadcast and what a partition counts is bounded, however
many queries there are; candidates are never collected. Vectors that are null or hold a null or a component that isn't
finite take no part. Only vectors of one length meet. Rows that repeat an id are candidates each for itself, and one
query. With fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.session import ship_package

QUERY_BLOCK = 2048
BINS = 256
#: Candidates scored at once.
ROWS = 1024


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): components as floor(256 * x), of those vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(x) > 0)).where(fine)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v"))


class Block:
    """A block of queries, by vector length: (positions, ids, matrix)."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.groups = {}
        for size in sorted({len(v) for _, v in rows}):
            own = np.array([k for k, (_, v) in enumerate(rows) if len(v) == size])
            self.groups[size] = (own, np.array([rows[k][1] for k in own.tolist()], np.int64))

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions of queries, candidate ids, scores); a query's own row has the least score there is."""
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        for size, (own, queries) in self.groups.items():
            rows = np.flatnonzero(sizes == size)
            small = np.abs(queries).max(initial=0) * float(np.abs(flat).max(initial=0)) * size < 2**53
            q = queries.astype(np.float64) if small else queries
            for i in range(0, len(rows), ROWS):
                part = rows[i : i + ROWS]
                x = flat[starts[part][:, None] + np.arange(size)]
                score = (q @ (x.astype(np.float64) if small else x).T).astype(np.int64)
                score[self.ids[own][:, None] == ids[part][None, :]] = NONE
                yield own, ids[part], score


NONE = -(2**62)


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best rows for each query, by inner product of integer vectors."""
    spark = rows.sparkSession
    ship_package(spark)
    all_rows = vectors(rows, id_col, vector_col)
    asked = vectors(queries, id_col, vector_col).dropDuplicates(["id"])
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = [_block(all_rows, asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), k, id_col) for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _block(rows: DataFrame, asked: DataFrame, k: int, id_col: str) -> DataFrame:
    spark = rows.sparkSession
    own = sorted((r["id"], r["v"]) for r in asked.collect())
    block = Block(own)
    shared = spark.sparkContext.broadcast(block)
    n = len(own)

    # Scores lie within the product of the largest norms.
    norm = rows.select(F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).alias("m")).first()["m"] or 0.0
    bound = int(np.sqrt(norm) * np.sqrt(max([0.0, *(float(sum(c * c for c in v)) for _, v in own)]))) + 2
    low, width = np.full(n, -bound, np.int64), np.full(n, max(1, -(-(2 * bound + 1) // BINS)), np.int64)
    top = low + width * BINS  # scores from here on have been counted
    need = np.full(n, k, np.int64)  # how many are still to be found at or below the bin that is split
    done = np.zeros(n, bool)
    while n and not done.all():
        sent = spark.sparkContext.broadcast((low, top, width, done))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lo, hi, wide, over = sent.value
            total = np.zeros(n * BINS, np.int64)
            for batch in batches:
                for at, _, score in shared.value.scores(batch):
                    part = (score - lo[at][:, None]) // wide[at][:, None]
                    ok = (part >= 0) & (score < hi[at][:, None]) & (score != NONE) & ~over[at][:, None]
                    total += np.bincount((at[:, None] * BINS + part)[ok], minlength=n * BINS)
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(hit // BINS), pa.array(hit % BINS), pa.array(total[hit])], ["q", "bin", "n"])

        bins = rows.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        needed = spark.createDataFrame([(i, int(x)) for i, x in enumerate(need) if not done[i]], "q long, need long")
        above = F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1))
        found = bins.withColumn("above", F.coalesce(above, F.lit(0))).join(F.broadcast(needed), "q").where("above < need and above + n >= need").select("q", "bin", "above").collect()
        hit = {r["q"]: r for r in found}
        for q in np.flatnonzero(~done).tolist():
            r = hit.get(q)
            if r is None:  # fewer candidates than k: all are kept
                low[q], done[q] = NONE + 1, True
                continue
            need[q] -= r["above"]
            low[q] += r["bin"] * width[q]
            top[q] = low[q] + width[q]
            if width[q] == 1:
                done[q] = True
            else:
                width[q] = max(1, -(-width[q] // BINS))
    least = spark.sparkContext.broadcast(low)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
            order = np.lexsort((ids, -score, q))
            q, ids, score = q[order], ids[order], score[order]
            first = np.searchsorted(q, q)
            fine = np.arange(len(q)) - first < k
            return [q[fine], ids[fine], score[fine]]

        for batch in batches:
            for at, ids, score in shared.value.scores(batch):
                a, b = np.nonzero(score >= least.value[at][:, None])
                held = [np.concatenate([x, y]) for x, y in zip(held, (at[a], ids[b], score[a, b]), strict=True)]
                if len(held[0]) > 4 * k * n + 100_000:
                    held = best(*held)
        q, ids, score = best(*held)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value.ids[q] if len(q) else q), pa.array(ids), pa.array(score)], ["query_id", "id", "score"])

    kept = rows.mapInArrow(keep, "query_id long, id long, score long")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
