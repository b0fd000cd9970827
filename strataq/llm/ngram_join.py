"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A text's set is its distinct shingles of WORDS words. Two sets of n and m shingles are similar if they share
T = ceil(t (n + m) / (1 + t)) of them, so a partner of a set of n occurs in at least ceil(t n) of the n inverted lists of
its shingles. DivideSkip sets the longest ceil(t n) - 1 lists aside: a partner must occur in one of the others, the short
lists. Short lists are merged, with a count of each candidate's occurrences; the long ones are only probed for candidates
by binary search, shortest first, until a candidate has T occurrences or can't reach them.

1. Equal sets collapse into one class each (their fingerprint); copies meet only in sums and minima.
2. Every class sends a row for each of its short lists to the list's bucket. Which lists are short follows one order for
   all classes: shingles that are frequent in some partition last, by frequency, the rest by hash.
3. A list is cut where its members' sizes, in order, are too far apart for any link across. Parts with one member are
   dropped; those that have the same least member are a unit, and so is each very long list. Similar classes are
   together in some unit.
4. Each class's sketch is sent once to each of its units; a large unit is dealt in blocks, and each two blocks meet. Two
   classes are compared in the least of their common units only. A sketch has a bit or two for each shingle: the parity of
   the shingles that fall on it. Two sketches differ in no more bits than their sets do in shingles, so those that
   differ in more than n + m - 2 T bits can't be similar. Classes that no other can be similar to leave here; most are in a
   unit by a common passage or by chance.
5. The shingles of the others are sent to where they have a partner to be tried. There a T-occurrence search finds the
   links: every class asks the inverted lists of what has come.
6. What leaves is each class's number of links, and of the links a forest, linear in the members; components of the
   forest are the result's. No pairs are shuffled, and none are left untried.

The order, the units and the sketches have no effect on results, only on how many candidates there are. A bucket holds
one entry a class for each list, a very long list's entries are dealt over all buckets, and a task of steps 4 and 5 holds
two blocks.

Null or empty texts have an empty set and are linked with nothing; texts under WORDS words have one shingle. Repeated
rows have equal sets, are linked, and so have one component. Rows with a null id get their n_shingles, a null component
and null n_links and take no part otherwise. Extra columns are dropped; an empty table gives an empty result. Shingles
are known by 64-bit hashes, by 48 bits where two classes meet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.graph import components
from strataq.session import checkpointed, forget, ship_package, small

from . import _text as tx
from ._frequent import most_frequent

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
#: Frequent shingles of which all partitions know (16 bytes each).
FREQUENT = 400_000
LOCAL_FREQUENT = 20_000
FLUSH_BYTES = 32 << 20
#: Bits of the bitmap of sets: so many for each, between the least and the most.
BITS_A_SET, BITS, MOST_BITS = 8, 1 << 23, 1 << 28
#: Bits of a sketch at least.
SKETCH = 64

#: A shingle that is this frequent has a list that no single bucket holds.
VERY_LONG = 200_000
#: Classes, and bytes of shingles, in a block of a unit.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: Candidates and lists that are probed at once.
PROBED, STEP = 100_000, 8

POSTING = np.dtype([("shingle", "u8"), ("set", "u8"), ("size", "u4")])


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle) of all distinct shingles, by document and hash; sizes and fingerprints of the sets."""
    n = len(offsets) - 1
    words, _, _, first = tx.words_of(buf, offsets, tx.NON_SPACE)
    count = np.diff(first)
    doc_of = np.repeat(np.arange(n), count)
    grams = tx.ngram_hash(words, WORDS)
    ok = doc_of[: len(grams)] == doc_of[WORDS - 1 :] if len(grams) else np.zeros(0, bool)
    docs, hashes = [doc_of[: len(grams)][ok]], [grams[ok]]
    for k in range(1, WORDS):
        short = np.flatnonzero(count == k)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for i in range(k):
                total += words[first[short] + i] * tx._PLACES[i]
            docs.append(short)
            hashes.append(tx.mix64(total + np.uint64(k)))
    doc, shingle = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])])
        doc, shingle = doc[new], shingle[new]
    sizes = np.bincount(doc, minlength=n)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix64(shingle ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    prints = tx.mix64(running[bounds[1:]] - running[bounds[:-1]] + sizes.astype(np.uint64))
    return doc, shingle, sizes, prints


def need(size: np.ndarray) -> np.ndarray:
    """Shingles that any partner of a set shares with it at least."""
    return -(-size * NUMERATOR // DENOMINATOR)


def sketches(shingle: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parities of each set's shingles on a power of two of bits, as many as it has shingles at least; an empty set has none."""
    width = np.where(sizes > 0, np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)), 0)
    end = np.cumsum(width)
    bit = np.repeat(end - width, sizes) + (shingle & np.repeat(width - 1, sizes).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(bit, minlength=int(end[-1]) if len(end) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [data[a:b] for a, b in zip(((end - width) // 8).tolist(), (end // 8).tolist(), strict=True)]


def close_sketches(data: list[bytes], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of sets whose sizes and sketches let them be similar; they are given in the order of their sizes.

    Similar sets' sketches are as wide or one is twice as wide: it is folded, by which a parity is that of fewer bits.
    """
    width = np.array([len(x) for x in data], np.int64)
    last = np.searchsorted(sizes, sizes * DENOMINATOR // NUMERATOR, side="right")
    for w in np.unique(width).tolist():
        begin, end, most = (int(x) for x in (*np.searchsorted(width, [w, w + 1]), np.searchsorted(width, 2 * w, side="right")))
        bits = np.frombuffer(b"".join(data[begin:end]), np.uint64).reshape(-1, w // 8)
        if most > end:
            wide = np.frombuffer(b"".join(data[end:most]), np.uint64).reshape(-1, 2, w // 8)
            bits = np.concatenate([bits, wide[:, 0] ^ wide[:, 1]])
        for a in range(begin, end):
            b = np.arange(a + 1, last[a])
            if len(b):
                both = sizes[a] + sizes[b]
                differ = np.bitwise_count(bits[a - begin] ^ bits[a + 1 - begin : last[a] - begin]).sum(axis=1, dtype=np.int64)
                b = b[differ <= both - 2 * -(-both * NUMERATOR // (NUMERATOR + DENOMINATOR))]
                if len(b):
                    yield np.full(len(b), a), b


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = tx.buffer_of(tx.as_strings(batch.column(column)))
    for a, b in tx.slices(offsets):
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, size, set, sketch) of documents, and with null size (count, shingle) of frequent shingles of this partition."""
    held, size = [], 0
    names = ["id", "size", "set", "sketch"]

    def frequent(parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))
        begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        n = np.diff(np.append(begin, len(values)))
        often = np.flatnonzero(n > 1)
        often = often[np.argsort(-n[often], kind="stable")[:LOCAL_FREQUENT]]
        return pa.RecordBatch.from_arrays([pa.array(n[often].astype(np.int64)), pa.nulls(len(often), pa.int64()), pa.array(values[begin[often]].view(np.int64)), pa.nulls(len(often), pa.binary())], names)

    for batch in batches:
        for a, b, buf, offsets in _slices(batch, 1):
            _, shingle, sizes, prints = shingle_sets(buf, offsets)
            held.append(shingle)
            size += len(buf)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), pa.array(prints.view(np.int64)), pa.array(sketches(shingle, sizes), pa.binary())], names)
            if size > FLUSH_BYTES:
                yield frequent(held)
                held, size = [], 0
    yield frequent(held)


def posted(rows: np.ndarray) -> bytes:
    """Postings of one bucket by columns, in 16 bytes each: half of a shingle's hash tells lists of a bucket apart.

    Lists that agree in it are taken as one, which can only add candidates. Sizes are written by bytes, as most are 0.
    """
    sizes = np.ascontiguousarray(rows["size"]).view(np.uint8).reshape(-1, 4)
    return (rows["shingle"] >> np.uint64(32)).astype(np.uint32).tobytes() + rows["set"].tobytes() + sizes.T.tobytes()


def read_posted(data: bytes) -> np.ndarray:
    n = len(data) // 16
    rows = np.zeros(n, POSTING)
    rows["shingle"], rows["set"] = np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint64, n, 4 * n)
    rows["size"] = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, 12 * n).reshape(4, n).T).view(np.uint32).reshape(-1)
    return rows


def _short_lists(shared, buckets: int, very_long: int):
    """Rows (bucket, kind, data) of postings: for each class of this partition its short lists, kind 1 those very long."""

    def flush(held: list[np.ndarray], long: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate([np.zeros(0, POSTING), *held])
        kind = np.concatenate([np.zeros(0, bool), *long]).astype(np.int64)
        bucket = (np.where(kind == 1, tx.mix64(rows["shingle"] ^ rows["set"]), rows["shingle"]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((kind, bucket))
        rows, bucket, kind = rows[order], bucket[order], kind[order]
        cuts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])])) if len(rows) else np.zeros(0, np.int64)
        data = [rows[a:b].tobytes() if kind[a] else posted(rows[a:b]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()), pa.array(kind[cuts], pa.int64()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = shared.value
        held, long, size, seen = [], [], 0, set()
        for batch in batches:
            for _, _, buf, offsets in _slices(batch, 0):
                doc, shingle, sizes, prints = shingle_sets(buf, offsets)
                fresh = np.zeros(len(sizes), bool)
                for i, p in enumerate(prints.tolist()):
                    if sizes[i] and p not in seen:
                        seen.add(p)
                        fresh[i] = True
                own = fresh[doc]
                doc, shingle = doc[own], shingle[own]
                key, count = shingle >> np.uint64(1), np.zeros(len(shingle), np.uint64)
                if len(often) and len(shingle):
                    at = np.minimum(np.searchsorted(often, shingle), len(often) - 1)
                    hit = often[at] == shingle
                    count[hit] = counts[at[hit]]
                    key[hit] = np.uint64(1 << 63) | count[hit] << np.uint64(20) | shingle[hit] & np.uint64(0xFFFFF)
                order = np.lexsort((key, doc))
                doc, shingle, count = doc[order], shingle[order], count[order]
                own_sizes = np.where(fresh, sizes, 0)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(own_sizes) - own_sizes, own_sizes)
                short = place <= (sizes - need(sizes))[doc]
                rows = np.zeros(int(short.sum()), POSTING)
                rows["shingle"], rows["set"], rows["size"] = shingle[short], prints[doc[short]], sizes[doc[short]]
                held.append(rows)
                long.append(count[short] >= very_long)
                size += len(buf)
                if size > FLUSH_BYTES:
                    yield flush(held, long)
                    held, long, size = [], [], 0
                    seen.clear()
        yield flush(held, long)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the lists of each bucket, from rows sorted by bucket: rows (set, unit) of the lists with several members."""

    def pairs_of(sets: np.ndarray, units: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((sets, units))
        sets, units = sets[order], units[order]
        if len(sets):
            new = np.concatenate([[True], (sets[1:] != sets[:-1]) | (units[1:] != units[:-1])])
            sets, units = sets[new], units[new]
        for i in range(0, len(sets), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(sets[i : i + 50_000].view(np.int64)), pa.array(units[i : i + 50_000].view(np.int64))], ["set", "unit"])

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.zeros(0, POSTING), *held])
        rows = rows[np.lexsort((rows["set"], rows["size"], rows["shingle"]))]
        if not len(rows):
            return
        same = rows["shingle"][1:] == rows["shingle"][:-1]
        rows = rows[np.concatenate([[True], ~(same & (rows["set"][1:] == rows["set"][:-1]))])]
        far = rows["size"][:-1].astype(np.int64) * DENOMINATOR < rows["size"][1:].astype(np.int64) * NUMERATOR
        begin = np.flatnonzero(np.concatenate([[True], (rows["shingle"][1:] != rows["shingle"][:-1]) | far]))
        n = np.diff(np.append(begin, len(rows)))
        several = np.repeat(n > 1, n)
        yield from pairs_of(rows["set"][several], np.repeat(np.minimum.reduceat(rows["set"], begin), n)[several])

    held, at = [], None
    for batch in batches:
        for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket != at:
                yield from flush(held)
                held, at = [], bucket
            if kind:
                rows = np.frombuffer(data.as_py(), POSTING)
                yield from pairs_of(rows["set"], rows["shingle"])
            else:
                held.append(read_posted(data.as_py()))
    yield from flush(held)


def packed(shingles: np.ndarray) -> bytes:
    """The upper 6 bytes of sorted shingles: enough to tell the shingles of two sets apart."""
    return np.ascontiguousarray(shingles[:, None].view(np.uint8)[:, 2:]).tobytes()


def unpacked(data) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).reshape(-1)


def links_within(sets: list[np.ndarray], may: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a < b, of similar sets, by a T-occurrence search; may says which candidates are wanted here."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, list_of, length = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keys = np.sort(list_of * m + owner)  # all inverted lists, each in the order of its members
    member, begin = keys % m, np.cumsum(length) - length
    order = np.lexsort((length[list_of], owner))  # each set's lists, shortest first
    lists = list_of[order]
    first = np.cumsum(sizes) - sizes
    aside = need(sizes) - 1
    short = np.flatnonzero((np.arange(len(lists)) - first[owner] < (sizes - aside)[owner]) & (length[lists] > 1))
    work = np.cumsum(np.bincount(owner[short], weights=length[lists[short]], minlength=m))
    at = 0
    while at < m:
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 1_000_000, side="right")))
        own = short[(owner[short] >= at) & (owner[short] < end)]
        at = end
        n = length[lists[own]]
        a = np.repeat(owner[own], n)
        b = member[np.repeat(begin[lists[own]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        found, count = np.unique((a * m + b)[b > a], return_counts=True)  # merged: occurrences of each candidate
        a, b = found // m, found % m
        fits = (np.minimum(sizes[a], sizes[b]) * DENOMINATOR >= np.maximum(sizes[a], sizes[b]) * NUMERATOR) & may(a, b)
        a, b, count = a[fits], b[fits], count[fits]
        for i in range(0, len(a), PROBED):
            x, y, have = a[i : i + PROBED], b[i : i + PROBED], count[i : i + PROBED]
            least = -(-(sizes[x] + sizes[y]) * NUMERATOR // (NUMERATOR + DENOMINATOR))
            step = 0
            while len(x):
                done = have >= least
                if done.any():
                    yield x[done], y[done]
                left = aside[x] - step
                go = ~done & (have + left >= least)
                x, y, have, least, left = x[go], y[go], have[go], least[go], left[go]
                if not len(x):
                    break
                width = np.arange(STEP)
                there = width < left[:, None]
                asked = lists[np.where(there, (first[x] + sizes[x] - aside[x] + step)[:, None] + width, 0)] * m + y[:, None]
                hit = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
                have = have + (hit & there).sum(axis=1)
                step += STEP


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[tuple]]]:
    """((unit, i, j), rows of the other columns) of rows sorted by unit, i and j; the last column's values are bytes."""
    held, at = [], None
    for batch in batches:
        key = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        rest = [batch.column(i).to_pylist() for i in range(3, batch.num_columns - 1)]
        for k, row in enumerate(zip(*rest, batch.column(batch.num_columns - 1), strict=True)):
            if key[k] != at:
                if held:
                    yield at, held
                held, at = [], key[k]
            held.append((*row[:-1], row[-1].as_py()))
    if held:
        yield at, held


def _compared_here(at: tuple[int, int, int], block: np.ndarray, units: list[list[int]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of a task's rows are compared in it: members of a common unit that is less than this one are compared there."""
    number: dict[int, int] = {}
    lower = [(k, number.setdefault(u, len(number))) for k, own in enumerate(units) for u in own if u < at[0]]
    bits = np.zeros((len(units), len(number) // 64 + 1), np.uint64)
    for k, n in lower:
        bits[k, n // 64] |= np.uint64(1 << n % 64)

    def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for column in bits.T:
            ok &= (column[a] & column[b]) == 0
        return ok & (block[a] != block[b]) if at[1] != at[2] else ok

    return may


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4, from rows (unit, i, j, set, size, block, copies, units, sketch) sorted by unit, i and j.

    Gives the rows, without size and sketch, that have a partner which they may be similar to.
    """
    columns = ("unit", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("set", pa.int64()), ("block", pa.int32()), ("copies", pa.int64()), ("units", pa.list_(pa.int64()))
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        values = list(zip(*out, strict=True)) or [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, columns, strict=True)], [name for name, _ in columns])

    for at, rows in _tasks(batches):
        if len(rows) < 2:
            continue
        rows.sort(key=lambda r: (r[1], r[0]))
        may = _compared_here(at, np.array([r[2] for r in rows], np.int64), [r[4] for r in rows])
        kept = np.zeros(len(rows), bool)
        for a, b in close_sketches([r[5] for r in rows], np.array([r[1] for r in rows], np.int64)):
            ok = may(a, b)
            kept[a[ok]] = kept[b[ok]] = True
        out.extend((*at, rows[k][0], *rows[k][2:5]) for k in np.flatnonzero(kept).tolist())
        if len(out) > 10_000:
            yield flush()
            out = []
    yield flush()
    tx.trim()


def _unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5, from rows (unit, i, j, set, block, copies, units, data) sorted by unit, i and j: rows (set, root, linked).

    root is the least class that links lead to within the task, linked the number of documents that its links lead to.
    """
    for at, rows in _tasks(batches):
        if len(rows) < 2:
            continue
        rows.sort(key=lambda r: r[0])
        names = np.array([r[0] for r in rows], np.int64)
        block, copies = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        may = _compared_here(at, block, [r[3] for r in rows])
        a, b = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *links_within([unpacked(r[4]) for r in rows], may), strict=True))
        if not len(a):
            continue
        linked = np.bincount(a, weights=copies[b], minlength=len(rows)) + np.bincount(b, weights=copies[a], minlength=len(rows))
        root = np.arange(len(rows))
        while True:
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if (new == root).all():
                break
            root = new
        out = np.flatnonzero(linked > 0)
        yield pa.RecordBatch.from_arrays([pa.array(names[out]), pa.array(names[root[out]]), pa.array(linked[out].astype(np.int64))], ["set", "root", "linked"])
    tx.trim()


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap that has a bit for each set: it lets all of them pass, and few others."""
    size = min(MOST_BITS, max(BITS, 1 << (BITS_A_SET * ids.count()).bit_length()))
    slot = ids.select(F.col("set").bitwiseAND(size - 1).alias("b"))
    bits = slot.groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits")).toPandas()
    bitmap = np.zeros(size // 64, np.int64)
    bitmap[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return bitmap


def _sets_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(set, data): the shingles of each member, made again from one of its texts; and of few others."""
    shared = members.sparkSession.sparkContext.broadcast(_bitmap(members))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, buf, offsets in _slices(batch, 0):
                _, shingle, sizes, prints = shingle_sets(buf, offsets)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                place = (prints & np.uint64(64 * len(shared.value) - 1)).astype(np.int64)
                own = []
                for i in np.flatnonzero((sizes > 0) & ((shared.value[place >> 6] >> (place & 63)) & 1 == 1)).tolist():
                    if (p := int(prints[i])) not in seen:
                        seen.add(p)
                        own.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                if own:
                    data = [packed(shingle[bounds[i] : bounds[i + 1]]) for i in own]
                    yield pa.RecordBatch.from_arrays([pa.array(prints[own].view(np.int64)), pa.array(data, pa.binary())], ["set", "data"])

    return texts.mapInArrow(wanted, "set long, data binary").groupBy("set").agg(F.first("data").alias("data"))


def class_links(texts: DataFrame, often: tuple[np.ndarray, np.ndarray], classes: DataFrame, parts: int, very_long: int = VERY_LONG, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(set, root, linked) of classes (set, size, copies, sketch, ...) that are linked with others, a row for each of their units."""
    shared = texts.sparkSession.sparkContext.broadcast(often)
    postings = texts.mapInArrow(_short_lists(shared, 8 * parts, very_long), "bucket long, kind long, data binary")
    met = checkpointed(postings.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge, "set long, unit long"))
    member = met.distinct().join(classes.select("set", "size"), "set")
    blocks = member.groupBy("unit").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") * 6 / BLOCK_BYTES)).cast("int").alias("blocks"))
    # Only units of several blocks are sent along; they are few, or else counted and joined by a shuffle.
    placed = member.join(small(blocks.where("blocks > 1")), "unit", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).groupBy("set").agg(F.collect_list(F.struct("unit", "blocks")).alias("own"))
    sketched = placed.join(classes.select("set", "size", "copies", "sketch"), "set").select("set", "size", "copies", "sketch", F.col("own.unit").alias("units"), F.explode("own").alias("o"))
    block = F.pmod(F.xxhash64("set", "o.unit"), F.col("o.blocks")).cast("int")
    dealt = sketched.select("set", "size", "copies", "sketch", "units", F.col("o.unit").alias("unit"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("o.blocks") - 1)).alias("other"))
    tasks = dealt.select("unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set", "size", "block", "copies", "units", "sketch")
    keyed = tasks.repartition(parts, "unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    chosen = checkpointed(keyed.mapInArrow(_candidates, "unit long, i int, j int, set long, block int, copies long, units array<long>"))
    forget(met)
    whole = chosen.join(_sets_of(chosen, texts), "set").select(*chosen.columns, "data")
    keyed = whole.repartition(parts, "unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    found = checkpointed(keyed.mapInArrow(_unit_links, "set long, root long, linked long"))
    forget(chosen)
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every document; n_links counts the documents that it is linked with."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = checkpointed(rows.mapInArrow(_signatures, "id long, size long, set long, sketch binary"))
    # Frequent shingles have a null size; documents have one.
    keys, counts = most_frequent(checkpointed(signed.where("size IS NULL").groupBy("set").agg(F.sum("id").alias("n"))), "set", FREQUENT)
    often = keys, np.minimum(counts, (1 << 42) - 1).astype(np.uint64)
    signed = signed.where("size IS NOT NULL")
    texts = rows.where("id IS NOT NULL AND text IS NOT NULL").select("text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    classes = signed.where("size > 0 AND id IS NOT NULL").groupBy("set").agg(F.first("size").alias("size"), F.count("*").alias("copies"), F.min("id").alias("least"), F.first("sketch").alias("sketch"))
    links = class_links(texts, often, classes, parts, **limits)
    labels = components(links.where("set <> root").select(F.col("set").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("set").agg(F.sum("linked").alias("linked"))
    named = classes.join(labels.withColumnRenamed("node", "set"), "set", "left").join(linked, "set", "left").select("set", "least", F.coalesce("label", "set").alias("label"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    best = named.groupBy("label").agg(F.min("least").alias("component"))
    of_set = named.join(best, "label").select(F.col("set").alias("own"), "component", "n_links")
    out = signed.drop("sketch").join(of_set, (signed["set"] == of_set["own"]) & (signed["size"] > 0) & signed["id"].isNotNull(), "left")
    alone = F.when(F.col("id").isNotNull(), 0)
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", alone).alias("n_links"))


def plain_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int]]:
    """id -> (n_shingles, component_id, n_links) by comparing all pairs; for tests."""
    pattern = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = {}
    for doc, text in docs:
        w = pattern.findall(bytes(tx.LOWER[np.frombuffer((text or "").encode(), np.uint8)]))
        sets[doc] = {tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))} if w else set()
    root, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and DENOMINATOR * len(x & y) >= NUMERATOR * len(x | y):
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d), links[d]) for d in ids}
