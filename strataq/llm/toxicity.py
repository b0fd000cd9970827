"""Toxicity by a logistic classifier that is regularised with counterfactuals.

Features are hashed words and their beginnings of 4, 5 and 6 bytes (so that inflected and compound forms share
weight), each present or absent. Of all hashed features, those that tell the classes apart best on the labelled texts
are kept, and those of the terms that name groups of people. Counterfactuals come from labelled texts: where one names
a group, the same text with the term swapped for another group's; where none does, the text as it is, the text with a
term put in, and that with the term swapped. The loss has, beside the labels' cross entropy, a penalty on the squared
change of the score (before the sigmoid, which would hide it) between each two of these, so that naming a group alone
carries no weight.

Null or empty texts get the score of a text without features. Repeated rows are scored each for itself; of a document
with several labels the highest counts; rows with null labels take no part. Without labels of both classes every score
is the labels' mean (0 without any). Extra columns are dropped; empty tables give empty results. The classifier is
fitted on at most FIT_ROWS texts of each class (by the hash of their id), which bounds what reaches the driver, with
counterfactuals of SWAP_ROWS of each class; scoring reads every whole text and shuffles nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.session import ship_package

from . import _text as tx

FIT_ROWS = 15_000
SLOTS = 1 << 20
FEATURES = 4096
#: Rows of a class that must have a feature.
SUPPORT = 3
SWAP_WEIGHT = 2.0
SWAP_ROWS = 1000
L2 = 1e-5
STEPS = 800
#: Terms that name groups of people, by group kind; a term is swapped for the next one of its kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives", "foreigners"),
)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of all features, with repeats."""
    low = tx.LOWER[buf]
    starts, ends = tx.runs(tx.ALNUM[low], offsets)
    prefix = tx.prefix_hash(low)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    docs, slots = [doc], [tx.span_hash(prefix, starts, ends)]
    for n in (4, 5, 6):
        long = ends - starts >= n
        docs.append(doc[long])
        slots.append(tx.span_hash(prefix, starts[long], starts[long] + n) ^ np.uint64(n))
    return np.concatenate(docs), (np.concatenate(slots) >> np.uint64(44)).astype(np.int64)


def distinct(doc: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(doc << 20 | slot)
    return keys >> 20, keys & (SLOTS - 1)


def swapped(text: str, terms=IDENTITY_TERMS) -> str | None:
    """The text with each group's term swapped for the next of its kind; None if it names none."""
    if not terms:
        return None
    following = {t: group[(i + 1) % len(group)] for group in terms for i, t in enumerate(group)}

    def other(found: re.Match) -> str:
        new = following[found[0].lower()]
        return new.upper() if found[0].isupper() else new.capitalize() if found[0][0].isupper() else new

    out, n = re.subn(r"(?i)\b(?:" + "|".join(sorted(map(re.escape, following), key=len, reverse=True)) + r")\b", other, text)
    return out if n else None


def term_slots(terms=IDENTITY_TERMS) -> dict[str, np.ndarray]:
    """The features of each term."""
    words = [t for group in terms for t in group]
    buf, offsets = tx.buffer_of(tx.as_strings(pa.array(words, pa.string())))
    doc, slot = distinct(*features(buf, offsets))
    return {w: slot[doc == i] for i, w in enumerate(words)}


class Classifier:
    def __init__(self, weights: np.ndarray, bias: float, pairs: int = 0):
        self.weights, self.bias, self.pairs = weights, bias, pairs

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, slot = features(buf, offsets)
        used = self.weights[slot] != 0
        doc, slot = distinct(doc[used], slot[used])
        total = self.bias + np.bincount(doc, weights=self.weights[slot], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _train(rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, float]:
    """Weights by Adam on the whole sample: importance-weighted cross entropy, L2, and the counterfactual penalty."""

    def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.repeat(np.arange(len(lists)), sizes), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)

    row, col = flat(rows)
    a_row, a_col = flat([a for a, _ in pairs])
    b_row, b_col = flat([b for _, b in pairs])
    w, bias = np.zeros(n), float(np.log((importance @ labels + 1) / (importance @ (1 - labels) + 1)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1):
        p = sigmoid(bias + np.bincount(row, weights=w[col], minlength=len(rows)))
        error = importance * (p - labels) / importance.sum()
        grad = np.append(np.bincount(col, weights=error[row], minlength=n) + L2 * w, error.sum())
        if pairs:
            apart = np.bincount(a_row, weights=w[a_col], minlength=len(pairs)) - np.bincount(b_row, weights=w[b_col], minlength=len(pairs))
            change = 2 * SWAP_WEIGHT * apart / len(pairs)
            grad[:n] += np.bincount(a_col, weights=change[a_row], minlength=n) - np.bincount(b_col, weights=change[b_row], minlength=n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:n], bias - move[n]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", terms=IDENTITY_TERMS) -> Classifier:
    """Learns from the labelled documents given."""
    spark = docs.sparkSession
    ship_package(spark)
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return Classifier(np.zeros(SLOTS, np.float32), -40.0 if not n1 else 40.0)
    share = [min(1.0, FIT_ROWS / n0), min(1.0, FIT_ROWS / n1)]
    lot = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = own.where(lot < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))  # about 2 * FIT_ROWS rows at most
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")
    # One text of each id, so that rows that share an id don't outgrow the sample's bound.
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS), np.int32)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            buf, offsets = tx.buffer_of(tx.as_strings(batch.column(1)))
            for a, b in tx.slices(offsets):
                doc, slot = distinct(*features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                for k in (0, 1):
                    total[k] += np.bincount(slot[y[a:b][doc] == k], minlength=SLOTS).astype(np.int32)
        hit = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[0, hit].astype(np.int64)), pa.array(total[1, hit].astype(np.int64))], ["slot", "n0", "n1"])

    # How far apart the classes' rates of a feature are, in standard errors of their log ratio.
    m0, m1 = n0 * share[0], n1 * share[1]
    ratio = F.log((F.col("n1") + 0.5) / (m1 + 1)) - F.log((F.col("n0") + 0.5) / (m0 + 1))
    z = F.abs(ratio) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    seen = sample.mapInArrow(count, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = seen.where(F.greatest("n0", "n1") >= SUPPORT).withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "slot").limit(FEATURES)
    of_term = term_slots(terms)
    chosen_slots = np.unique(np.concatenate([np.array([r["slot"] for r in best.select("slot").collect()], np.int64), *of_term.values()]))
    place = np.full(SLOTS, -1, np.int32)
    place[chosen_slots] = np.arange(len(chosen_slots))
    shared = spark.sparkContext.broadcast(place)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own_features(texts: list[str]) -> list[list[int]]:
            buf, offsets = tx.buffer_of(tx.as_strings(pa.array(texts, pa.string())))
            doc, slot = features(buf, offsets)
            known = shared.value[slot] >= 0
            doc, slot = distinct(doc[known], slot[known])
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            where = shared.value[slot].tolist()
            return [where[cuts[i] : cuts[i + 1]] for i in range(len(texts))]

        for batch in batches:
            strings = tx.as_strings(batch.column(1))
            _, offsets = tx.buffer_of(strings)
            for a, b in tx.slices(offsets):
                texts = strings.slice(a, b - a).to_pylist()
                others = [swapped(t, terms) for t in texts]
                there = [i for i, t in enumerate(others) if t is not None]
                twins = dict(zip(there, own_features([others[i] for i in there]), strict=True)) if there else {}
                x = own_features(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(x, pa.list_(pa.int32())), pa.array([twins.get(i) for i in range(len(texts))], pa.list_(pa.int32()))], ["y", "x", "twin"])

    found = sample.mapInArrow(rows_of, "y int, x array<int>, twin array<int>").collect()
    y = np.array([r["y"] for r in found], float)
    rows = [np.array(r["x"], np.int64) for r in found]
    twins = [None if r["twin"] is None else np.array(r["twin"], np.int64) for r in found]
    pairs = _counterfactuals(rows, y, twins, {t: place[s] for t, s in of_term.items()}, terms)
    w, bias = _train(rows, y, np.where(y == 1, 1 / share[1], 1 / share[0]), pairs, len(chosen_slots))
    weights = np.zeros(SLOTS, np.float32)
    weights[chosen_slots] = w
    return Classifier(weights, bias, len(pairs))


def _counterfactuals(rows: list[np.ndarray], y: np.ndarray, twins: list, of_term: dict[str, np.ndarray], terms) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of feature lists whose scores should be equal, from SWAP_ROWS texts of each class in the order of a hash."""
    lot = np.array([zlib.crc32(x.tobytes()) for x in rows])
    order = np.argsort(lot, kind="stable")
    own = [i for k in (0, 1) for i in order[y[order] == k][:SWAP_ROWS].tolist()] if terms else []
    turns = [(group, k) for group in terms for k in range(len(group))]
    pairs = []
    for at, i in enumerate(own):
        x = rows[i]
        if twins[i] is not None:
            pairs.append((x, twins[i]))
            continue
        group, k = turns[at % len(turns)]
        one, other = (np.union1d(x, of_term[group[j % len(group)]]) for j in (k, k + 1))
        pairs += [(one, other), (x, one)]
    return pairs


def score(docs: DataFrame, classifier: Classifier, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, score, predicted) of every whole text; with keep, those columns of docs follow."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tx.buffer_of(tx.as_strings(batch.column(1)))
            scores = np.concatenate([np.zeros(0), *(shared.value.score(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tx.slices(offsets))])
            arrays = [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "score", "predicted", *batch.schema.names[2:]])

    extra = [F.col(c) for c in keep or ()]
    kept = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), *extra)
    out = kept.mapInArrow(lambda it: (pa.RecordBatch.from_arrays(b.columns, ["id", "score", "predicted", *b.schema.names[3:]]) for b in run(it)), tx.schema("__id long, score double, predicted int", *kept.schema.fields[2:]))
    return out.withColumnRenamed("__id", "id" if keep else id_col)
