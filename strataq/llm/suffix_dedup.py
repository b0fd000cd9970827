"""Suffix-array dedup of whole texts, exact at the byte.

A byte is repeated if it lies in a SPAN-byte string that also starts anywhere else. Every such string contains a
GRAM-byte anchor that its own bytes determine: the GRAM with the least hash. So texts are cut into segments, runs of
starts that share an anchor, and equal strings can only meet under one anchor:

1. Each partition finds its segments; equal ones within the partition are all repeated and one stands for them.
   An anchor that very many different segments share (those at a common passage's ends) would bring them all to one
   task: there each string is a segment and an anchor of its own. Such anchors are found beforehand, by counts.
2. Segments meet by anchor. Equal segments are repeated as a whole and need no text. Only where an anchor has
   segments that differ, one of each kind goes on.
3. Their bytes are fetched, and a suffix array of them is made by two-stage sorting (_suffix.py). Starts whose common
   prefix with a neighbour in the array is SPAN bytes or more are repeated.
4. Spans meet their texts again by a key made of id and text.

Equality of whole segments in 1 and 2 is by 64-bit hashes; 3 compares bytes. What is shuffled in 2 is a few bytes for
each anchor (one in about (SPAN - GRAM + 1) / 2 bytes of text) and at most one row for each kind of segment and
partition, so hot passages are combined before they meet. Nothing is collected to the driver but a bitmap of fixed size.

Null or empty texts and texts under SPAN bytes have no repeats and are kept. Repeated rows repeat each other. Ties in
the order don't matter. Extra columns can be kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.session import checkpointed, ship_package

from . import _text as tx
from ._frequent import most_frequent
from ._suffix import common_prefixes, sort_suffixes

SPAN = 200
GRAM = 80
#: Bytes of text whose segments are combined before they are sent.
FLUSH_BYTES = 48 << 20
#: Bytes of segments in one suffix array (more only if a single anchor has more).
ARRAY_BYTES = 8 << 20
BITS = 1 << 23
#: Different segments of an anchor, in a partition's part and in all such parts, from which its strings go apart.
LOCAL_COMMON, COMMON = 4, 256
#: Anchors of a partition's part that are counted, and anchors that all partitions know (8 bytes each).
LOCAL_ANCHORS, ANCHORS = 10_000, 200_000

SEGMENT = np.dtype([("anchor", "u8"), ("hash", "u8"), ("key", "i8"), ("start", "i4"), ("count", "u1"), ("many", "u1")])


def segments(buf: np.ndarray, offsets: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, segment hash, document, first start in the document, number of starts) of a slice's segments.

    Starts under a common anchor (sorted hashes) are segments and anchors of their own.
    """
    n, width = len(buf), SPAN - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    prefix = tx.prefix_hash(buf)
    m = n - GRAM + 1
    at = np.arange(m)
    grams = tx.span_hash(prefix, at, at + GRAM)
    # The least of each window, and of equals the first: hash above, place below.
    shift = np.uint64(max(1, int(m).bit_length()))
    order = (grams >> shift << shift) | at.astype(np.uint64)
    blocks = -(-m // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:m] = order
    shaped = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(shaped, axis=1).reshape(-1)
    backward = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts_n = n - SPAN + 1
    least = np.minimum(backward[:starts_n], forward[width - 1 : width - 1 + starts_n])
    where = (least & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)[:starts_n]
    whole = np.arange(starts_n) + SPAN <= offsets[doc + 1]
    first = whole.copy()
    first[1:] &= (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(first)
    if not len(begin):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    running = np.concatenate([[0], np.cumsum(whole)])
    count = np.diff(np.concatenate([running[begin], [running[-1]]]))
    anchor = grams[where[begin]]
    if common is not None and len(common):
        apart = common[np.minimum(np.searchsorted(common, anchor), len(common) - 1)] == anchor
        n_of = np.where(apart, count, 1)
        begin = np.repeat(begin, n_of) + np.arange(int(n_of.sum())) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        single = np.repeat(apart, n_of)
        anchor, count = np.repeat(anchor, n_of), np.where(single, 1, np.repeat(count, n_of))
        anchor[single] = tx.span_hash(prefix, begin[single], begin[single] + SPAN)
    return anchor, tx.span_hash(prefix, begin, begin + count - 1 + SPAN), doc[begin], begin - offsets[doc[begin]], count


def _common_anchors(batches: Iterator[pa.RecordBatch], local: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, n): anchors with several different segments in this partition."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *held]), axis=0)
        anchor, n = np.unique(pairs[:, 0], return_counts=True)
        often = np.flatnonzero(n >= local)
        often = often[np.argsort(-n[often], kind="stable")[:LOCAL_ANCHORS]]
        return pa.RecordBatch.from_arrays([pa.array(anchor[often].view(np.int64)), pa.array(n[often])], ["anchor", "n"])

    for batch in batches:
        buf, offsets = tx.buffer_of(tx.as_strings(batch.column(0)))
        for a, b in tx.slices(offsets):
            anchor, own, *_ = segments(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            held.append(np.stack([anchor, own], axis=1))
            size += int(offsets[b] - offsets[a])
            if size >= FLUSH_BYTES:
                yield flush()
                held, size = [], 0
    yield flush()


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(F.col(id_col), text).alias("__key"), F.col(id_col).cast("long").alias("__id"), text.alias("__text"), *[F.col(c) for c in keep])


def _find_segments(buckets: int, common):
    """Stage 1: rows (bucket, kind, data): kind 0 are segments by anchor, kind 1 spans that are known to be repeated."""

    def flush(held: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        rows = np.concatenate([np.zeros(0, SEGMENT), *held])
        if not len(rows):
            return
        rows = rows[np.argsort(rows["hash"], kind="stable")]
        edge = np.concatenate([[True], rows["hash"][1:] != rows["hash"][:-1]])
        begin = np.flatnonzero(edge)
        n = np.diff(np.append(begin, len(rows)))
        repeated = rows[np.repeat(n > 1, n)]
        sent = rows[begin]
        sent["many"] = n > 1
        for kind, part, bucket in ((0, sent, (sent["anchor"] % np.uint64(buckets)).astype(np.int64)), (1, repeated, (repeated["key"].view(np.uint64) % np.uint64(buckets)).astype(np.int64))):
            order = np.argsort(bucket, kind="stable")
            part, bucket = part[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
                own = part[a:b]
                yield int(bucket[a]), kind, (own if kind == 0 else own[["key", "start", "count"]].astype(SPANS)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            buf, offsets = tx.buffer_of(tx.as_strings(batch.column(1)))
            for a, b in tx.slices(offsets):
                anchor, own, doc, start, count = segments(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], common.value)
                rows = np.zeros(len(anchor), SEGMENT)
                rows["anchor"], rows["hash"], rows["key"], rows["start"], rows["count"] = anchor, own, keys[a:b][doc], start, count
                held.append(rows)
                size += int(offsets[b] - offsets[a])
                if size >= FLUSH_BYTES:
                    yield _rows(flush(held))
                    held, size = [], 0
        yield _rows(flush(held))

    return run


SPANS = np.dtype([("key", "i8"), ("start", "i4"), ("count", "u1")])


def _rows(found: Iterator[tuple[int, int, bytes]]) -> pa.RecordBatch:
    rows = list(found)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "data"])


FOUND = "key long, start int, count int, anchor long, single boolean"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 2: rows of FOUND: with anchor null a repeated span, else a segment whose bytes are wanted."""
    held = [np.zeros(0, SEGMENT)]
    for batch in batches:
        kinds = batch.column(1).to_numpy(zero_copy_only=False)
        data = batch.column(2)
        known = [np.frombuffer(data[i].as_py(), SPANS) for i in np.flatnonzero(kinds == 1).tolist()]
        if known:
            yield from _spans(np.concatenate(known))
        held += [np.frombuffer(data[i].as_py(), SEGMENT) for i in np.flatnonzero(kinds == 0).tolist()]
    rows = np.concatenate(held)
    rows = rows[np.lexsort((rows["hash"], rows["anchor"]))]
    if not len(rows):
        return
    new_anchor = np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]])
    new_kind = new_anchor | np.concatenate([[True], rows["hash"][1:] != rows["hash"][:-1]])
    begin = np.flatnonzero(new_kind)
    n = np.diff(np.append(begin, len(rows)))
    several = np.repeat(n > 1, n)
    yield from _spans(rows[several & (rows["many"] == 0)])
    group = np.cumsum(new_anchor)[begin]
    kinds_of = np.bincount(group)
    want = begin[kinds_of[group] > 1]
    single = ((n == 1) & (rows["many"][begin] == 0))[kinds_of[group] > 1]
    for i in range(0, len(want), 20_000):
        part = rows[want[i : i + 20_000]]
        yield pa.RecordBatch.from_arrays([pa.array(part["key"]), pa.array(part["start"]), pa.array(part["count"].astype(np.int32)), pa.array(part["anchor"].view(np.int64)), pa.array(single[i : i + 20_000])], ["key", "start", "count", "anchor", "single"])


def _spans(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Repeated starts as rows of FOUND, those of one text that join made one."""
    rows = rows[np.lexsort((rows["start"], rows["key"]))] if len(rows) else rows
    start, stop = rows["start"].astype(np.int64), rows["start"].astype(np.int64) + rows["count"]
    edge = np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (start[1:] != stop[:-1])]) if len(rows) else np.zeros(0, bool)
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(rows))[: len(begin)] - 1
    for i in range(0, len(begin), 20_000):
        a, b = begin[i : i + 20_000], end[i : i + 20_000]
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rows["key"][a]), pa.array(start[a].astype(np.int32)), pa.array((stop[b] - start[a]).astype(np.int32)), none, pa.nulls(len(a), pa.bool_())], ["key", "start", "count", "anchor", "single"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 3a: the bytes of wanted segments, from rows (text, wanted)."""
    for batch in batches:
        buf, offsets = tx.buffer_of(tx.as_strings(batch.column(1)))
        wanted = batch.column(2)
        sizes = wanted.value_lengths().to_numpy(zero_copy_only=False)
        fields = wanted.flatten()
        start = fields.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
        count = fields.field("count").to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        raw = memoryview(buf)
        begin = offsets[row] + start
        data = [bytes(raw[a:b]) for a, b in zip(begin.tolist(), (begin + count - 1 + SPAN).tolist(), strict=True)]
        keys = batch.column(0).to_numpy(zero_copy_only=False)[row]
        yield pa.RecordBatch.from_arrays([pa.array(keys), fields.field("start"), fields.field("count"), fields.field("anchor"), fields.field("single"), pa.array(data, pa.binary())], ["key", "start", "count", "anchor", "single", "data"])


def _sort_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage 3b: suffix arrays of segments in the order of their anchors; repeated starts as rows of FOUND."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        ends = np.cumsum([len(r[5]) for r in rows])
        count = np.array([r[2] for r in rows], np.int64)
        order, key8 = sort_suffixes(text, ends, count, SPAN)
        hit = common_prefixes(order, key8, SPAN) >= SPAN
        both = hit.copy()
        both[:-1] |= hit[1:]
        at = np.sort(order[both])
        seg = np.searchsorted(ends, at, side="right")
        begins = ends - np.array([len(r[5]) for r in rows])
        single = np.array([r[4] for r in rows], bool)
        fine = single[seg]
        at, seg = at[fine], seg[fine]
        out = np.zeros(len(at), SPANS)
        out["key"] = np.array([r[0] for r in rows], np.int64)[seg]
        out["start"] = np.array([r[1] for r in rows], np.int64)[seg] + at - begins[seg]
        out["count"] = 1
        yield from _spans(out)

    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        for row in rows:
            if size >= ARRAY_BYTES and row[3] != held[-1][3]:
                yield from flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    yield from flush(held)


def _known_anchors(texts: DataFrame, least: int) -> np.ndarray:
    """Sorted hashes of anchors with at least that many segments, of at most ANCHORS: the bound rises where there are more."""
    counts = checkpointed(texts.select("__text").mapInArrow(lambda batches: _common_anchors(batches, min(LOCAL_COMMON, least)), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    return most_frequent(counts, "anchor", ANCHORS)[0]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """(key, start, count): runs of starts of repeated SPAN-byte strings, by key of the text."""
    spark = docs.sparkSession
    ship_package(spark)
    keyed = _keyed(docs, id_col, text_col, [])
    texts = keyed.select("__key", "__text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    apart = spark.sparkContext.broadcast(_known_anchors(texts, common))
    met = checkpointed(texts.mapInArrow(_find_segments(8 * parts, apart), "bucket int, kind int, data binary").repartition(parts, "bucket").mapInArrow(_meet, FOUND))
    wanted = met.where("anchor IS NOT NULL")
    bits = wanted.select(F.pmod(F.xxhash64("key"), F.lit(BITS)).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits")).toPandas()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(bitmap)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((shared.value[slot >> 6] >> (slot & 63)) & 1 == 1)).select(["__key", "__text"])

    near = texts.withColumn("slot", F.pmod(F.xxhash64("__key"), F.lit(BITS))).mapInArrow(named, "__key long, __text string")
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "count", "anchor", "single")).alias("wanted"))
    fetched = near.dropDuplicates(["__key"]).join(by_text, near["__key"] == by_text["key"]).select("key", "__text", "wanted")
    cut = fetched.mapInArrow(_cut, FOUND + ", data binary")
    sorted_ = cut.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_sort_segments, FOUND)
    return met.where("anchor IS NULL").select("key", "start", "count").unionByName(sorted_.select("key", "start", "count"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, common: int = COMMON) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every text without its repeated bytes.

    kept_text leaves out the characters of which some bytes are repeated. With keep, those columns follow.
    """
    keep = keep or []
    spans = repeated_spans(docs, id_col, text_col, common)
    by_text = spans.groupBy("key").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    keyed = _keyed(docs, id_col, text_col, keep)
    joined = keyed.join(by_text, keyed["__key"] == by_text["key"], "left").select("__id", "__text", "spans", *keep)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, found = batch.column(1), batch.column(2).to_pylist()
            n_bytes, removed, runs, digests, texts = [], [], [], [], []
            for text, spans in zip(strings, found, strict=True):
                text = text.as_py()
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["start"] + s["count"] - 1 + SPAN) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if merged else raw
                n_bytes.append(len(raw))
                removed.append(len(raw) - len(kept))
                runs.append(len(merged))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append("".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2], strict=True)) if merged else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), *batch.columns[3:]], ["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *batch.schema.names[3:]])

    out = joined.mapInArrow(remove, tx.schema("__id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string", *joined.schema.fields[3:]))
    return out.drop("__id") if id_col in keep else out.withColumnRenamed("__id", id_col)


def plain_dedup(texts: list[str | None], span: int = SPAN) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by counting every string of span bytes; for tests."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for raw in raws:
        for i in range(len(raw) - span + 1):
            seen[raw[i : i + span]] = seen.get(raw[i : i + span], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - span + 1):
            if seen[raw[i : i + span]] > 1:
                gone[i] += 1
                gone[i + span] -= 1
        cover = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~cover])
        runs = int(np.sum(cover & ~np.concatenate([[False], cover[:-1]])))
        out.append((len(raw), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
