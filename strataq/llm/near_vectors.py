"""Embedding near-dedup: vectors of one label link when their cosine reaches a threshold.

1. Equal vectors of a label collapse into one class (grouped in tasks first), so copies meet only in sums and minima.
2. Random hyperplanes give each class a signature of some bits in each of several tables. Bits follow the number of
   classes of the largest label (2^bits * BUCKET of them), tables the wanted recall: a pair at the threshold has equal
   signatures in some table with probability RECALL, closer pairs with more. Signatures are written once with the
   vectors.
3. A few tables at a time, classes are shuffled by (label, table, signature). A bucket of more than BLOCK classes is dealt
   in blocks, every two of which meet, so that a task holds two blocks, however many classes share a signature. In a task
   all cosines are computed, in double precision; a pair is counted in the first table only in which it meets.
4. What leaves a task is each class's number of linked vectors, and of the links a forest, linear in its members. The
   components of the forest, found by rounds of joins, are the result's. No pairs are shuffled or sent to the driver.

A pair under the threshold is never linked; one over it is lost with a probability of 1 - RECALL at most. A group of n
near copies that aren't equal costs n * n / 2 cosines, in bounded tasks.

Null labels and vectors that are null, zero or hold null or non-finite components link with nothing: n_links is 0 and the
component their own id. Vectors of different lengths don't link; an empty vector links with nothing. Repeated ids are
vectors like others; rows with a null id are linked and counted too, and a component without any id has a null id. Extra
columns are dropped; an empty table gives an empty result. Labels are known by 64-bit hashes where classes meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.graph import components
from strataq.session import checkpointed, forget, ship_package, small

from ._vectors import complete, matrices

THRESHOLD, RECALL = 0.93, 0.9999
#: Classes of the largest label for each signature, on average; the fewest and most bits of a signature.
BUCKET, LEAST_BITS, MOST_BITS = 64, 4, 30
#: Classes that a task compares at once are two blocks at most.
BLOCK = 256
#: Tables whose shuffles are on disk at the same time.
AT_ONCE = 4
SEED = 20


def plan(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for the number of classes of the largest label."""
    bits = min(MOST_BITS, max(LEAST_BITS, ceil(log2(max(1, classes) / BUCKET))))
    same = (1 - acos(max(-1.0, min(1.0, threshold))) / pi) ** bits
    return bits, 1 if same >= 1 else ceil(log(1 - recall) / log(1 - same))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in double precision, each scaled by a power of two so that no square over- or underflows; their norms."""
    x = x.astype(np.float64)
    _, power = np.frexp(np.abs(x).max(axis=1, initial=0))
    x = np.ldexp(x, -power[:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def _signer(bits: int, tables: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, tables), np.int32)
            for own, x in matrices(batch.column(4)):
                planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
                side = (unit(x)[0] @ planes > 0).reshape(len(own), tables, bits)
                out[own] = (side * (1 << np.arange(bits))).sum(axis=2)
            signs = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, signs], [*batch.schema.names, "signs"])

    return sign


def _bucket_links(threshold: float):
    """Rows (space, t, sign, i, j, node, copies, block, v, signs) in the order of their first five columns; gives (node, root, linked).

    root is the least class that links lead to within the task, linked the number of vectors that its links lead to.
    """

    def links(rows: pa.Table, t: int, cross: bool) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        node, copies, block = (rows.column(c).to_numpy() for c in ("node", "copies", "block"))
        ((_, x),) = matrices(rows.column("v").chunk(0))
        ((_, signs),) = matrices(rows.column("signs").chunk(0))
        x, norm = unit(x)
        near = np.triu((x @ x.T) / norm[:, None] / norm >= threshold, 1)
        if cross:
            near &= block[:, None] != block
        a, b = np.nonzero(near)
        for earlier in range(t):
            fresh = signs[a, earlier] != signs[b, earlier]
            a, b = a[fresh], b[fresh]
        if not len(a):
            return None
        linked = np.bincount(a, weights=copies[b], minlength=len(node)) + np.bincount(b, weights=copies[a], minlength=len(node))
        root = node.copy()
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            if (new == root).all():
                break
            root = new
        out = np.flatnonzero(linked > 0)
        return pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(root[out]), pa.array(linked[out].astype(np.int64))], ["node", "root", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(5)], axis=1)
                bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
                for begin, end in zip(bounds, bounds[1:], strict=False):
                    own = tuple(key[begin].tolist())
                    if held and own != last:
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(batch.slice(begin, end - begin))
                    last = own
            if held:
                yield pa.Table.from_batches(held)

        for rows in groups():
            if rows.num_rows > 1:
                t, i, j = (rows.column(c)[0].as_py() for c in ("t", "i", "j"))
                if (found := links(rows, t, i != j)) is not None:
                    yield found

    return run


def class_links(signed: DataFrame, tables: int, parts: int, threshold: float = THRESHOLD, block: int = BLOCK, at_once: int = AT_ONCE) -> DataFrame:
    """(node, root, linked) of classes (node, copies, least, space, v, signs) that are linked, a row for each task they are in."""
    found = None
    for begin in range(0, tables, at_once):
        some = F.slice("signs", begin + 1, min(at_once, tables - begin))
        met = signed.select("space", F.posexplode(some).alias("p", "sign"), "node", "copies", "v", "signs").withColumn("t", F.col("p") + begin)
        key = ["space", "t", "sign"]
        large = met.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
        many = met.join(small(large), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = many.withColumn("block", F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int"))
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tasks = dealt.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "v", "signs")
        keyed = tasks.repartition(parts, *key, "i", "j").sortWithinPartitions(*key, "i", "j")
        links = checkpointed(keyed.mapInArrow(_bucket_links(threshold), "node long, root long, linked long"))
        found = links if found is None else found.unionByName(links)
    return found


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, **limits: int) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = rows.sparkSession
    ship_package(spark)
    vector = F.col(vector_col)
    if rows.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("v"))
    fit = F.col("label").isNotNull() & complete(F.col("v")) & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    own = base.where(fit)
    grouped = own.groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = checkpointed(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("space", F.xxhash64("label", F.size("v"))))
    largest = classes.groupBy("space").count().agg(F.max("count").alias("n")).first()["n"] or 0
    bits, tables = plan(largest, threshold, recall)
    kind = classes.schema["v"].dataType.simpleString()
    signed = checkpointed(classes.select("node", "copies", "least", "space", "v").mapInArrow(_signer(bits, tables), f"node long, copies long, least long, space long, v {kind}, signs array<int>"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    links = class_links(signed, tables, parts, threshold, **limits)
    forget(signed)
    labels = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    named = classes.select("node", "least", "copies").join(labels, "node", "left").join(linked, "node", "left")
    named = checkpointed(named.select("node", "least", F.coalesce("label", "node").alias("group"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    forget(links)
    forget(labels)
    best = checkpointed(named.groupBy("group").agg(F.min("least").alias("component")))
    of_class = classes.join(named.join(best, "group").select("node", "component", "n_links"), "node")
    of_class = of_class.select(F.xxhash64("label", "v").alias("hash"), F.col("label").alias("own_label"), F.col("v").alias("own_v"), "component", "n_links")
    told = own.withColumn("hash", F.xxhash64("label", "v")).join(of_class, "hash").where((F.col("label") == F.col("own_label")) & (F.col("v") == F.col("own_v"))).select("id", "n_links", "component")
    alone = base.where(~fit).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return told.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def plain_near(rows: list[tuple[int, list[float] | None, object]], threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """id -> (n_links, component_id) by comparing all pairs; for tests."""
    good = [(i, np.array(v, float), label) for i, v, label in rows if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    root, links = {i: i for i, _, _ in rows}, dict.fromkeys((i for i, _, _ in rows), 0)

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (links[i], find(i)) for i, _, _ in rows}
