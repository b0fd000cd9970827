"""Vector code compression: each part of a vector is replaced by the index of the nearest entry of the part's codebook.

Components become integers, x = floor(256 * c), and vectors are cut into PARTS equal consecutive parts (where the length
isn't a multiple of PARTS, the first parts are longer by one). A part's codebook starts as that part of the ENTRIES rows
with the smallest ids. Each round assigns all parts and replaces entries by the floored means of what they got.

The rows become columnar blocks, an int64 array of (dimension, rows) each, in an RDD. treeAggregate goes over them: in a
block, the distances of a part to all its entries accumulate dimension by dimension; np.add.at puts the parts into int64
tensors of sums (dimension, entry) and counts (part, entry), and a reduction tree merges the tensors of tasks, so the
driver sees a few tensors of fixed size. A last pass over the rows themselves writes codes and errors. Integers make
results independent of order. Sums by label are put together in tasks before they are shuffled.

Vectors that are null or hold null or non-finite components are dropped. Rows that repeat an id are rows each for
itself, in the order of their vectors where ids decide; rows without an id come last there. Fewer rows than ENTRIES give
smaller codebooks; the nearest entry is the one with the lower index on ties. Vectors of different lengths are different
spaces, with codebooks of their own; empty vectors have code 00 in all parts. Numbers that no long holds become the
nearest long; where squares outgrow int64, Python's ints are used, and errors that no long holds are null. Null labels
are one label. Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.session import checkpointed, forget, ship_package, small

from ._vectors import complete, floored, greatest, matrices

PARTS, ENTRIES, ROUNDS = 16, 64, 2

#: Of each vector length: entries as (dimension, entry).
Books = dict[int, np.ndarray]


def cuts(size: int, parts: int) -> list[int]:
    """Where parts begin, and the end of the last."""
    return [0, *np.cumsum([size // parts + (p < size % parts) for p in range(parts)]).tolist()]


def nearest(columns: np.ndarray, book: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (part, row) and errors (row) of a columnar block of (dimension, row)."""
    size, rows = columns.shape
    most = 2 * greatest(columns, book)
    kind = np.int64 if most * most * max(1, size) < 2**63 else object
    columns, book = columns.astype(kind, copy=False), book.astype(kind, copy=False)
    codes, error, at = np.zeros((parts, rows), np.int64), np.zeros(rows, kind), cuts(size, parts)
    for p in range(parts):
        far = np.zeros((rows, book.shape[1]), kind)
        for j in range(at[p], at[p + 1]):
            step = columns[j][:, None] - book[j]
            far += step * step
        codes[p] = far.argmin(axis=1)
        error += far[np.arange(rows), codes[p]]
    return codes, error


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own, x in matrices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], ["size", "rows", "data"])


def improved(vectors: DataFrame, books: Books, parts: int) -> Books:
    """Codebooks after one round over all vectors x."""
    blocks = vectors.select("x").mapInArrow(_blocks, "size int, rows int, data binary").rdd
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def count(total: dict, block) -> dict:
        book = shared.value[block["size"]]
        columns = np.frombuffer(block["data"], np.int64).reshape(block["size"], block["rows"])
        codes, _ = nearest(columns, book, parts)
        if block["size"] not in total:
            total[block["size"]] = np.zeros(book.shape, np.int64), np.zeros((parts, book.shape[1]), np.int64)
        sums, counts = total[block["size"]]
        if greatest(columns) >= 2**28:
            sums, columns = sums.astype(object), columns.astype(object)
        at = cuts(block["size"], parts)
        for p in range(parts):
            np.add.at(counts[p], codes[p], 1)
            for j in range(at[p], at[p + 1]):
                np.add.at(sums[j], codes[p], columns[j])
        total[block["size"]] = sums, counts
        return total

    def merge(a: dict, b: dict) -> dict:
        for size, (sums, counts) in b.items():
            a[size] = (a[size][0] + sums, a[size][1] + counts) if size in a else (sums, counts)
        return a

    found = blocks.treeAggregate({}, count, merge)
    shared.unpersist()
    out = {}
    for size, book in books.items():
        sums, counts = found[size]
        part_of = np.repeat(np.arange(parts), np.diff(cuts(size, parts)))
        n = counts[part_of]
        out[size] = np.where(n > 0, sums // np.maximum(n, 1), book)
    return out


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of a table of rows (id, x)."""
    books = {}
    for r in vectors.groupBy(F.size("x").alias("size")).count().collect():
        first = vectors.where(F.size("x") == r["size"]).orderBy(F.asc_nulls_last("id"), "x").select("x").limit(entries).collect()
        books[r["size"]] = np.array([f["x"] for f in first], np.int64).reshape(len(first), r["size"]).T.copy()
    for _ in range(rounds):
        books = improved(vectors, books, parts) if books else books
    return books


def books_digest(book: np.ndarray, parts: int) -> str:
    at = cuts(len(book), parts)
    numbers = (str(int(c)) for p in range(parts) for entry in book[at[p] : at[p + 1]].T for c in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    spark = rows.sparkSession
    ship_package(spark)
    kept = checkpointed(rows.where(complete(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), floored(F.col(vector_col)).alias("x")))
    books = train(kept, parts, entries, rounds)
    shared = spark.sparkContext.broadcast((books, {size: books_digest(book, parts) for size, book in books.items()}))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in matrices(batch.column(2)):
                book, digest = (part[x.shape[1]] for part in shared.value)
                codes, error = nearest(np.ascontiguousarray(x.T), book, parts)
                text = [bytes(c).hex() for c in np.ascontiguousarray(codes.T.astype(np.uint8))]
                errors = [int(e) if e < 2**63 else None for e in error]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(own)) for i in (0, 1)), pa.array(text, pa.string()), pa.array(errors, pa.int64()), pa.array([digest] * len(own), pa.string())], ["id", "label", "code", "error", "digest"])

    schema = T.StructType([*kept.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("digest", T.StringType())])
    coded = checkpointed(kept.mapInArrow(encode, schema))
    forget(kept)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    out = coded.join(small(by_label), F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.col("digest").alias("codebooks_sha256"))


def plain_compress(rows: list[tuple[int, list[int], object]], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[tuple[int, str, int, int, str]]:
    """The same over (id, x, label) of one length, a part at a time; for tests."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    size = len(rows[0][1])
    at = cuts(size, parts)
    split = [[tuple(v[a:b]) for a, b in zip(at, at[1:], strict=False)] for _, v, _ in rows]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]

    def best(p: int, v: tuple) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        got = [[[] for _ in book] for book in books]
        for s in split:
            for p in range(parts):
                got[p][best(p, s[p])[1]].append(s[p])
        books = [[tuple(sum(c) // len(g) for c in zip(*g, strict=True)) if g else e for g, e in zip(got[p], books[p], strict=True)] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [(i, "".join(f"{best(p, s[p])[1]:02x}" for p in range(parts)), sum(best(p, s[p])[0] for p in range(parts)), label) for (i, _, label), s in zip(rows, split, strict=True)]
    return [(i, code, error, sum(e for _, _, e, other in out if other == label), digest) for i, code, error, label in out]
