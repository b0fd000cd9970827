"""Language ID by bit-sliced Bloom filters of n-grams.

Training counts the 4-byte n-grams of labelled texts for each language and keeps, of each language, those that are
frequent in it and not much rarer than in the language that has them most. All languages share one filter: a slot
holds a bitmask with a bit for each language, and the bitwise AND of an n-gram's slots is the set of all languages
that contain it. A text's n-grams give a popcount for each language; from each, the false positives to be expected
at that language's fill are taken off, and the largest corrected count decides.

score is the winner's share of all corrected counts. Null texts and texts without a letter are `und` with score 0; a
text with letters but no known n-gram gets the language with the most training texts, with score 0. Without training
texts all are `und`. Repeated rows are predicted each for itself, extra columns are dropped, empty tables give empty
results. The classifier is fitted on at most FIT_DOCS texts of each language (those with the lowest hash of their
id), its filter is SLOTS masks for each 64 languages; predictions read every whole text and shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.session import ship_package

from . import _text as tx

FIT_DOCS = 4000
GRAMS = 40_000
SLOTS = 1 << 20
#: An n-gram belongs to a language if it is at least so frequent there as a share of its frequency where it is most frequent.
RELATIVE = 0.2
HASHES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, document of each): 4 bytes of letters and blanks, within one document."""
    low = _PLAIN[buf].astype(np.uint32)
    if len(low) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    out = low[:-3] << 24 | low[1:-2] << 16 | low[2:-1] << 8 | low[3:]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = (doc[:-3] == doc[3:]) & (out & 0x00FFFF00 != 0x00202000)
    return out[ok], doc[:-3][ok]


def slots(gram: np.ndarray) -> np.ndarray:
    """The slots of each n-gram, one row for each hash."""
    return (gram.astype(np.uint64)[None, :] * HASHES[:, None] >> np.uint64(44)).astype(np.int64)


class Filter:
    def __init__(self, languages: list[str], grams_of: list[np.ndarray], fallback: str | None):
        self.languages, self.fallback = languages, fallback
        self.masks = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
        for i, own in enumerate(grams_of):
            self.masks[i // 64, slots(own)] |= np.uint64(1 << i % 64)
        self.false = [float(np.mean(self.masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) ** len(HASHES)) for i in range(len(languages))]

    def contained(self, gram: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that contain each n-gram, one row for each 64 languages."""
        at = slots(gram)
        out = self.masks[:, at[0]]
        for row in at[1:]:
            out &= self.masks[:, row]
        return out

    def predict(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        gram, doc = grams(buf, offsets)
        total = np.bincount(doc, minlength=n).astype(float)
        found = np.zeros((len(self.languages), n))
        if len(gram):
            sets = self.contained(gram)
            bounds = np.searchsorted(doc, np.arange(n + 1))
            for i in range(len(self.languages)):
                running = np.concatenate([[0], np.cumsum(sets[i // 64] >> np.uint64(i % 64) & np.uint64(1), dtype=np.int64)])
                found[i] = running[bounds[1:]] - running[bounds[:-1]]
        false = np.array(self.false)[:, None] if self.languages else np.zeros((0, 1))
        fair = np.clip((found - total * false) / (1 - np.minimum(false, 0.99)), 0, None)
        all_of = fair.sum(axis=0)
        best = fair.argmax(axis=0) if len(self.languages) else np.zeros(n, np.int64)
        score = np.where(all_of > 0, fair.max(axis=0, initial=0) / np.maximum(all_of, 1e-9), 0.0)
        letters = np.concatenate([[0], np.cumsum(_ASCII[buf], dtype=np.int64)])
        has = letters[offsets[1:]] > letters[offsets[:-1]]
        labels = []
        for i in range(n):
            known = has[i] or any(c.isalpha() for c in buf[offsets[i] : offsets[i + 1]].tobytes().decode())
            label = (self.languages[best[i]] if all_of[i] > 0 else self.fallback) if known else None
            labels.append(label or "und")
            if not label:
                score[i] = 0.0
        return labels, score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter:
    """Learns from rows with text and language."""
    spark = docs.sparkSession
    ship_package(spark)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Filter([], [], None)
    # A share of each language by the hash of the id, so that FIT_DOCS are to be expected.
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, FIT_DOCS / counts[lang])))])
    lot = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / float(1 << 20)
    number = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    sample = labelled.where(lot < share[F.col(lang_col)]).select(number[F.col(lang_col)].alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, offsets = tx.buffer_of(tx.as_strings(batch.column(1)))
            for a, b in tx.slices(offsets, 4 << 20):
                gram, doc = grams(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keys, n = np.unique(langs[a:b][doc] << 32 | gram.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n)], ["lang", "gram", "n"])

    seen = sample.mapInArrow(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy("lang"))
    often = seen.withColumn("f", F.col("n") / total).withColumn("most", F.max("f").over(W.partitionBy("gram")))
    kept = often.where((F.col("f") >= RELATIVE * F.col("most")) & (F.col("n") > 1))
    best = kept.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("f"), "gram"))).where(F.col("r") <= GRAMS)
    rows = best.select("lang", "gram").toPandas()
    own = [rows["gram"].to_numpy()[rows["lang"].to_numpy() == i].astype(np.uint32) for i in range(len(languages))]
    return Filter(languages, own, max(languages, key=lambda x: (counts[x], x)))


def predict(docs: DataFrame, filters: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tx.buffer_of(tx.as_strings(batch.column(1)))
            for a, b in tx.slices(offsets):
                labels, score = shared.value.predict(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(labels, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kept = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo by: the fold of a row."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by
