"""Benchmark decontamination by winnowing.

Texts become words, and words K-grams of 5. Of every WINDOW - K + 1 consecutive K-grams the one with the least hash
is kept as a fingerprint; two texts that share WINDOW words share such a fingerprint, so none is missed. Fingerprints
of documents meet those of the benchmark, and each hit is extended: the windows of 10 words around it are compared as
a whole. Items shorter than a window are one window of their own, for which every run of as many words is a
fingerprint.

The benchmark's fingerprints are sent to executors in blocks of at most BLOCK_BYTES of benchmark text; a larger
benchmark takes more passes over the documents, with what was found kept in a table in the shared folder between two
passes. Documents aren't shuffled.

Null or empty texts have no words and no hits; items without words occur nowhere. Repeated documents are judged each
for itself; items that share an id are one item. Extra columns are dropped; an empty table of documents gives an empty
result, an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataq.session import checkpointed, ship_package

from . import _text as tx

WINDOW = 10
K = 5
BLOCK_BYTES = 16 << 20


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least (then rightmost) of every width consecutive hashes."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, width):
        new = grams[i : i + n] <= best
        best[new] = grams[i : i + n][new]
        at[new] = np.flatnonzero(new) + i
    return np.unique(at)


class Fingerprints:
    """A block of the benchmark: sorted fingerprints, and by window length sorted window hashes with their items."""

    def __init__(self, items: list[tuple[str, str]]):
        windows: dict[int, dict[int, set[str]]] = {}
        prints = []
        for item, text in items:
            raw = (text or "").encode()
            buf = np.frombuffer(raw, np.uint8)
            words = tx.words_of(buf, np.array([0, len(buf)]), tx.ALNUM)[0]
            if not len(words):
                continue
            size = min(len(words), WINDOW)
            if size == WINDOW:
                grams = tx.ngram_hash(words, K)
                prints.append(grams[winnow(grams, WINDOW - K + 1)])
            for h in tx.ngram_hash(words, size).tolist():
                windows.setdefault(size, {}).setdefault(h, set()).add(item)
        self.prints = np.unique(np.concatenate([np.zeros(0, np.uint64), *prints]))
        self.windows = {}
        for size, found in windows.items():
            keys = np.array(sorted(found), np.uint64)
            self.windows[size] = (keys, [sorted(found[h]) for h in keys.tolist()])

    @staticmethod
    def _member(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, index in keys) of those hashes that are keys."""
        if not len(keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        hit = np.flatnonzero(keys[at] == hashes)
        return hit, at[hit]

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window length, first words, windows) of all occurrences in a slice whose documents start at first."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size in self.windows:
            if len(words) < size:
                continue
            starts = np.arange(len(words) - size + 1)
            if size == WINDOW:
                grams = tx.ngram_hash(words, K)
                marks = winnow(grams, WINDOW - K + 1)
                marks = marks[self._member(self.prints, grams[marks])[0]]
                starts = np.unique((marks[:, None] - np.arange(WINDOW - K + 1)).reshape(-1))
                starts = starts[(starts >= 0) & (starts + size <= len(words))]
            starts = starts[doc[starts] == doc[starts + size - 1]]
            if len(starts):
                total = np.zeros(len(starts), np.uint64)
                for i in range(size):
                    total += words[starts + i] * tx._PLACES[i]
                hit, window = self._member(self.windows[size][0], tx.mix64(total + np.uint64(size)))
                if len(hit):
                    yield size, starts[hit], window

    def find(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]], dict[int, set[str]]]:
        """For the documents of a slice: numbers of words, and where there are hits, spans of words and items."""
        words, _, _, first = tx.words_of(buf, offsets, tx.ALNUM)
        cover = np.zeros(len(words) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for size, starts, window in self.hits(words, first):
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + size, -1)
            docs = np.searchsorted(first, starts, side="right") - 1
            names = self.windows[size][1]
            for d, w in set(zip(docs.tolist(), window.tolist(), strict=True)):
                items.setdefault(d, set()).update(names[w])
        spans: dict[int, list[int]] = {}
        if items:
            inside = np.cumsum(cover[:-1]) > 0
            a, b = tx.runs(inside, first)
            docs = np.searchsorted(first, a, side="right") - 1
            for d, x, y in zip(docs.tolist(), (a - first[docs]).tolist(), (b - first[docs]).tolist(), strict=True):
                spans.setdefault(d, []).extend((x, y))
        return np.diff(first), spans, items


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """(id, n_words, n_hit, n_items, spans, items) of every document: spans are pairs of word positions in one array.

    With keep, those columns of docs follow.
    """
    ship_package(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    state = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), F.lit(0).cast("long").alias("__n"), F.array().cast("array<int>").alias("__spans"), F.array().cast("array<string>").alias("__items"), *[F.col(c) for c in keep or ()])
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        shared = docs.sparkSession.sparkContext.broadcast(Fingerprints([(r["item"], r["text"]) for r in own]))
        state = _pass(state, shared, last=b == blocks - 1)
        if b < blocks - 1:
            state = checkpointed(state)
    out = state.select(F.col("__id").alias("id" if keep else id_col), F.col("__n").alias("n_words"), F.col("__hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.col("__spans").alias("spans"), F.col("__items").alias("items"), *[F.col(c) for c in keep or ()])
    return out


def _pass(state: DataFrame, shared, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            strings = tx.as_strings(batch.column(1))
            buf, offsets = tx.buffer_of(strings)
            old_spans, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            words, spans, items = [], [], []
            for a, b in tx.slices(offsets):
                n, s, i = block.find(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words.append(n)
                spans += [_merged((old_spans[a + k] or []) + s.get(k, [])) for k in range(b - a)]
                items += [sorted({*(old_items[a + k] or ()), *i.get(k, ())}) for k in range(b - a)]
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            arrays = [batch.column(0), *([] if last else [batch.column(1)]), pa.array(np.concatenate([np.zeros(0, np.int64), *words])), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), *batch.columns[5:]]
            names = ["__id", *([] if last else ["__text"]), "__n", "__spans", "__items", *batch.schema.names[5:]]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(hit, pa.int64())] if last else [])], [*names, *(["__hit"] if last else [])])

    own = "__id long" + ("" if last else ", __text string") + ", __n long, __spans array<int>, __items array<string>"
    return state.mapInArrow(run, tx.schema(own, *state.schema.fields[5:], *(StructType.fromDDL("__hit long") if last else ())))


def items_digest(items: str = "items"):
    """SHA-256 of the items' ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(items, ","), 256)


def plain_contamination(docs: list[tuple[int, str]], items: list[tuple[str, str]]) -> dict[int, tuple[int, int, int, str]]:
    """The same by comparing every window of every item with every place of every text; for tests."""
    import re

    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(text: str | None) -> list[bytes]:
        return pattern.findall(bytes(tx.LOWER[np.frombuffer((text or "").encode(), np.uint8)]))

    wanted = []
    for item, text in items:
        w = words(text)
        wanted += [(item, w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1)) if w]
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in wanted:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
