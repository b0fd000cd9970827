"""LM scoring by a Katz backoff model of word bigrams.

Counts up to TRUSTED are Good-Turing discounted, those of 1 too; all bigrams seen in training stay. What discounting frees
goes to words that didn't follow the history, by their unigram share, with a backoff weight that makes each history's
distribution sum to 1 exactly (over known words and one unknown word). A token's probability is found recursively:
its bigram if the table has it, else the history's weight times its unigram.

Tables are partitioned by the hash of the history (or word):

1. Texts become chunks: a sorted vocabulary of word hashes and the tokens as places in it, written to the shared folder.
2. Each chunk sends its distinct words and bigrams with their training counts to their partitions, which add them up
   and answer each chunk with its own entries' totals, in the order asked, so that answers need no keys.
3. Bigrams that stay meet their words' unigrams, then their histories, which gives backoff weights; each chunk gets
   those of its vocabulary.
4. Chunks and answers meet by chunk, and texts are scored.

A frequent word or bigram is one entry for each chunk, however often it occurs. Entries travel packed, one row for each
chunk and bucket that have any, so rows are at most the entries, which are at most the tokens. Nothing but counts of counts reaches the
driver. Words are known by 64-bit hashes, the second of a bigram by 48 bits. Null or empty texts are one end token. Repeated rows are counted and scored
each for itself; extra columns are dropped; an empty table gives an empty result. Without training texts every
probability is that of the unknown word.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.session import checkpointed, forget, ship_package

from . import _text as tx

CHUNK_BYTES = 16 << 20
#: A word in a bigram and a word's bucket are known by these bits.
UPPER = np.uint64(0xFFFFFFFFFFFF0000)
#: Counts over this aren't discounted.
TRUSTED = 5
END = np.uint64(tx.string_hash(b" end"))
START = np.uint64(tx.string_hash(b" start"))
ROW = "kind string, chunk long, bucket long, data binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; bytes of equal weight stand together."""
    import zstandard

    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"") for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, protocol=5))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        dtype = np.dtype(kind)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(-1) if n else np.zeros(0, dtype))
    return out


def _batch(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["kind", "chunk", "bucket", "data"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, from rows (id, text, training)."""
    held, size, number = [], 0, 0

    def flush() -> pa.RecordBatch:
        tokens = np.concatenate([h[0] for h in held])
        vocabulary, place, n = np.unique(np.append(tokens, START), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # small places for frequent words pack best
        rank = np.empty(len(n), np.uint32)
        rank[order] = np.arange(len(n), dtype=np.uint32)
        vocabulary, place = vocabulary[order], rank[place]
        ids = np.concatenate([h[2] for h in held])
        known = np.concatenate([h[3] for h in held])
        return _batch([("C", TaskContext.get().partitionId() << 24 | number, 0, _pack(vocabulary, place[:-1], np.concatenate([h[1] for h in held]), ids, known, np.concatenate([h[4] for h in held])))])

    for batch in batches:
        ids = batch.column(0)
        values, known = ids.fill_null(0).to_numpy(zero_copy_only=False), (~np.asarray(ids.is_null())).astype(np.uint8)
        train = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool).astype(np.uint8)
        buf, offsets = tx.buffer_of(tx.as_strings(batch.column(1)))
        for a, b in tx.slices(offsets):
            words, _, _, first = tx.words_of(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tx.NON_SPACE)
            tokens = np.insert(words, first[1:], END)
            held.append((tokens, np.diff(first) + 1, values[a:b], known[a:b], train[a:b]))
            size += int(offsets[b] - offsets[a])
            if size > CHUNK_BYTES:
                yield flush()
                held, size, number = [], 0, number + 1
    if held:
        yield flush()
    held.clear()
    tx.trim()


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words >> np.uint64(16)).astype(np.int64) % buckets


class Chunk:
    """A chunk, with its distinct bigrams (places of history and word) in the order in which they are sent."""

    def __init__(self, data: bytes, buckets: int):
        self.vocabulary, self.place, self.sizes, self.ids, self.known, self.train = _unpack(data)
        n = len(self.vocabulary)
        self.start = int(np.flatnonzero(self.vocabulary == START)[0])
        self.bucket = bucket_of(self.vocabulary, buckets)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        history = np.empty_like(self.place)
        history[1:] = self.place[:-1]
        history[self.begin[:-1]] = self.start
        pairs, pair_of = np.unique(history.astype(np.int64) * n + self.place, return_inverse=True)
        self.left, self.right, self.pair_of = (pairs // n).astype(np.uint32), (pairs % n).astype(np.uint32), pair_of.astype(np.uint32)
        del pairs, pair_of, history
        self.pair_bucket = self.bucket[self.left]
        self.training = np.repeat(self.train, self.sizes) == 1
        self.words_of, self.pairs_of = self._by(self.bucket), self._by(self.pair_bucket)

    @staticmethod
    def _by(bucket: np.ndarray) -> dict[int, np.ndarray]:
        """The places of each bucket that has any, in order."""
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else order
        return dict(zip(bucket[order[cuts]].tolist(), np.split(order, cuts[1:]), strict=False)) if len(order) else {}

    def word_counts(self) -> np.ndarray:
        """Training counts; that of the start is the number of training texts."""
        out = np.bincount(self.place[self.training], minlength=len(self.vocabulary))
        out[self.start] = int(self.train.sum())
        return out

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.training], minlength=len(self.left))


def _ask(buckets: int):
    """Step 2: words (kind u) and bigrams (kind b) of each chunk to their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                chunk = Chunk(data.as_py(), buckets)
                words, pairs = chunk.word_counts().astype(np.uint32), chunk.pair_counts().astype(np.uint32)
                for b, own in chunk.words_of.items():
                    own = own[np.argsort(chunk.vocabulary[own])]
                    both = chunk.pairs_of.get(b, np.zeros(0, np.int64))
                    left, n = np.unique(chunk.left[both], return_counts=True)
                    yield _batch([
                        ("u", number, b, _pack(chunk.vocabulary[own], words[own])),
                        ("b", number, b, _pack(chunk.vocabulary[left], n.astype(np.uint32), chunk.vocabulary[chunk.right[both]] & UPPER, pairs[both])),
                    ])
                del chunk, words, pairs
                tx.trim()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, int, list[np.ndarray]]]]]:
    """(bucket, its rows) of a partition that is sorted by bucket."""
    held: list = []
    at = None
    for batch in batches:
        for kind, chunk, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if bucket != at and held:
                yield at, held
                held = []
            at = bucket
            held.append((kind, chunk, _unpack(data.as_py())))
    if held:
        yield at, held


def _count(buckets: int):
    """Adds up; answers chunks (U, B), passes vocabularies on (v), and gives tables of words (W) and bigrams (G) and sums (S)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            asked = [(chunk, a) for kind, chunk, a in rows if kind == "u"]
            words, back = np.unique(np.concatenate([a[0] for _, a in asked]), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate([a[1] for _, a in asked]), minlength=len(words)).astype(np.int64)
            at = 0
            for chunk, a in asked:
                n = len(a[0])
                yield _batch([("U", chunk, bucket, _pack(total[back[at : at + n]])), ("v", chunk, bucket, _pack(a[0]))])
                at += n
            pairs = [(chunk, np.repeat(a[0], a[1]), a[2], a[3]) for kind, chunk, a in rows if kind == "b"]
            left, right, n = (np.concatenate([p[i] for p in pairs]) for i in (1, 2, 3))
            order = np.lexsort((right, left))
            edge = np.concatenate([[True], (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])]) if len(order) else np.zeros(0, bool)
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(edge) - 1
            r = np.bincount(group, weights=n).astype(np.int64)
            at = 0
            for chunk, own, _, _ in pairs:
                yield _batch([("B", chunk, bucket, _pack(r[group[at : at + len(own)]].astype(np.uint32)))])
                at += len(own)
            real = words != START
            sums = np.array([total[real].sum(), int((total[real] > 0).sum()), *(int((r == i).sum()) for i in range(1, TRUSTED + 2))], np.int64)
            first = order[edge][r > 0] if len(order) else order
            h, w, often = left[first], right[first], r[r > 0].astype(np.uint32)
            target = bucket_of(w, buckets)
            out = [("S", 0, bucket, _pack(sums)), ("W", 0, bucket, _pack(words, total))]
            for b, own in Chunk._by(target).items():
                histories, n = np.unique(h[own], return_counts=True)  # h is sorted
                out.append(("G", 0, b, _pack(histories, n.astype(np.uint32), total[np.searchsorted(words, histories)], w[own], often[own])))
            yield _batch(out)
            del rows, asked, words, back, total, pairs, left, right, n, order, edge, group, r, first, h, w, often, target, out
            tx.trim()

    return run


class Model:
    """What all need to know: tokens N and words V of the training texts, and discounts by count."""

    def __init__(self, tokens: int, words: int, of_counts: list[int]):
        self.tokens, self.words = tokens, words
        n = [0, *of_counts]
        k = TRUSTED
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
        self.discount = np.ones(k + 1)
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
            self.discount[r] = d if 0 < d <= 1 else (r - 0.5) / r

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.tokens + self.words + 1)

    def discounted(self, r: np.ndarray) -> np.ndarray:
        return r * np.where(r <= TRUSTED, self.discount[np.minimum(r, TRUSTED)], 1.0)

    @staticmethod
    def weights(mass: np.ndarray, shared: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scale of its bigrams, backoff weight) of histories: at least 1 in count + 1 is left to other words."""
        seen = mass / np.maximum(count, 1)
        most = count / (count + 1)
        scale = np.where(seen > most, most / np.maximum(seen, 1e-300), 1.0)
        return scale, (1 - seen * scale) / (1 - shared)


def _mass(shared, buckets: int):
    """Step 3, by word: for each history the discounted counts and unigram shares of its words (kind M), to its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for _, rows in _by_bucket(batches):
            words, total = next((a for kind, _, a in rows if kind == "W"), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            bigrams = [(np.repeat(a[0], a[1]), a[3], a[4], np.repeat(a[2], a[1])) for kind, _, a in rows if kind == "G"]
            if not bigrams:
                continue
            h, w, r, count = (np.concatenate([a[i] for a in bigrams]) for i in range(4))
            share = model.unigram(total[np.searchsorted(words & UPPER, w)])
            histories, first, back = np.unique(h, return_index=True, return_inverse=True)
            mass, shares = np.bincount(back, weights=model.discounted(r)), np.bincount(back, weights=share)
            target = bucket_of(histories, buckets)
            yield _batch([("M", 0, b, _pack(histories[own], mass[own], shares[own], count[first][own])) for b, own in Chunk._by(target).items()])

    return run


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, by history: scale and backoff weight, answered to each chunk (kind A)."""
    for bucket, rows in _by_bucket(batches):
        parts = [a for kind, _, a in rows if kind == "M"]
        if parts:
            h, mass, shares, count = (np.concatenate([a[i] for a in parts]) for i in range(4))
            histories, first, back = np.unique(h, return_index=True, return_inverse=True)
            scale, weight = Model.weights(np.bincount(back, weights=mass), np.bincount(back, weights=shares), count[first])
        for kind, chunk, a in rows:
            if kind == "v":
                own_scale, own_weight = np.ones(len(a[0])), np.ones(len(a[0]))
                if parts:
                    at = np.minimum(np.searchsorted(histories, a[0]), len(histories) - 1)
                    hit = histories[at] == a[0]
                    own_scale[hit], own_weight[hit] = scale[at[hit]], weight[at[hit]]
                yield _batch([("A", chunk, bucket, _pack(own_scale, own_weight))])


SCORES = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shared, buckets: int):
    """Step 4, from partitions sorted by chunk."""

    def one(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        model = shared.value
        chunk = Chunk(next(data for kind, _, data in rows if kind == "C"), buckets)
        count, scale, weight = np.zeros(len(chunk.vocabulary), np.int64), np.ones(len(chunk.vocabulary)), np.ones(len(chunk.vocabulary))
        r = np.zeros(len(chunk.left), np.int64)

        def own(bucket: int) -> np.ndarray:
            places = chunk.words_of[bucket]
            return places[np.argsort(chunk.vocabulary[places])]  # as they were sent

        for kind, bucket, data in rows:
            if kind == "U":
                count[own(bucket)] = _unpack(data)[0]
            elif kind == "A":
                scale[own(bucket)], weight[own(bucket)] = _unpack(data)
            elif kind == "B" and bucket in chunk.pairs_of:
                r[chunk.pairs_of[bucket]] = _unpack(data)[0]
        share = model.unigram(count)
        seen = scale[chunk.left] * model.discounted(r) / np.maximum(count[chunk.left], 1)
        p = np.where(r > 0, seen, weight[chunk.left] * share[chunk.right])
        begin = chunk.begin[:-1]
        base = np.add.reduceat(np.log10(share)[chunk.place], begin)
        score = np.add.reduceat(np.log10(p)[chunk.pair_of], begin)
        known = np.add.reduceat((count > 0)[chunk.place].astype(np.int64), begin)
        return pa.RecordBatch.from_arrays([pa.array(chunk.ids, mask=chunk.known == 0), pa.array(chunk.sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(begin), model.tokens, np.int64)), pa.array(base), pa.array(score)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for kind, number, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if number != at and held:
                    yield one(held)
                    held = []
                at = number
                held.append((kind, bucket, data.as_py()))
        if held:
            yield one(held)
        held.clear()
        tx.trim()

    return run


def score(docs: DataFrame, training: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every text; training is a predicate on docs."""
    spark = docs.sparkSession
    ship_package(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.expr(training), F.lit(False)).alias("training"))
    chunks = checkpointed(rows.mapInArrow(_chunks, ROW))
    counted = checkpointed(chunks.mapInArrow(_ask(parts), ROW).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(_count(parts), ROW), by="kind")
    sums = np.zeros(TRUSTED + 3, np.int64)
    for row in counted.where("kind = 'S'").select("data").toLocalIterator():
        sums += _unpack(bytes(row["data"]))[0]
    model = spark.sparkContext.broadcast(Model(int(sums[0]), int(sums[1]), sums[2:].tolist()))
    mass = counted.where("kind IN ('G', 'W')").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_mass(model, parts), ROW)
    weights = checkpointed(mass.union(counted.where("kind = 'v'")).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_weigh, ROW))
    forget(counted, "kind=G", "kind=W", "kind=v", "kind=S")
    answers = chunks.union(counted.where("kind IN ('U', 'B')")).union(weights)
    found = answers.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_score(model, parts), SCORES)
    return found.withColumnRenamed("id", id_col)


def plain_score(docs: list[tuple[int, str | None]], training: set[int]) -> dict[int, tuple[int, int, int, float, float]]:
    """id -> (n_tokens, n_known, train_tokens, base_score, score) with dictionaries; for tests."""
    import re

    pattern = re.compile(rb"[^\x20\x09-\x0D]+")
    tokens = {d: [*pattern.findall(bytes(tx.LOWER[np.frombuffer((t or "").encode(), np.uint8)])), "end"] for d, t in docs}
    one = Counter(w for d in tokens if d in training for w in tokens[d])
    two = Counter(p for d in tokens if d in training for p in zip(["start", *tokens[d]], tokens[d], strict=False))
    histories = Counter(h for p, n in two.items() for h in [p[0]] for _ in range(n))
    n, v = sum(one.values()), len(one)
    model = Model(n, v, [sum(1 for c in two.values() if c == r) for r in range(1, TRUSTED + 2)])
    uni = lambda w: (one[w] + 1) / (n + v + 1)

    def discounted(r: int) -> float:
        return r * (model.discount[r] if r <= TRUSTED else 1.0)

    kept: dict = {}
    for (h, w), r in two.items():
        kept.setdefault(h, {})[w] = r

    def p(h, w) -> float:
        own = kept.get(h, {})
        seen = sum(discounted(r) for r in own.values()) / max(1, histories[h])
        scale = min(1.0, histories[h] / (histories[h] + 1) / seen) if seen else 1.0
        if w in own:
            return scale * discounted(own[w]) / histories[h]
        return (1 - scale * seen) / (1 - sum(uni(x) for x in own)) * uni(w) if own else uni(w)

    for h in list(kept)[:50]:  # each distribution sums to 1 over known words and the unknown word
        total = sum(p(h, w) for w in one) + p(h, "\x00unknown")
        assert abs(total - 1) < 1e-9, (h, total)
    return {d: (len(t), sum(one[w] > 0 for w in t), n, sum(math.log10(uni(w)) for w in t), sum(math.log10(p(h, w)) for h, w in zip(["start", *t], t, strict=False))) for d, t in tokens.items()}


def fold(doc_id: int, by: int) -> int:
    """crc32 of the id as text, modulo by."""
    return zlib.crc32(str(doc_id).encode()) % by
