"""Vector search: exact cosine top-k, upserts, and the deterministic stub embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.session import ship_package, spread

#: Words whose directions a task keeps (512 bytes each at 64 dimensions), and words of a text that are added at once.
WORDS, PIECE = 100_000, 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; 1 for the zero vector."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine_top_k(rows: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """(rank, id, cosine, score): filters come first, so none of the k is lost to them; ties go to the smaller id."""
    if not any(query):
        return rows.limit(0).select(F.lit(0).alias("rank"), id_col, F.lit(0.0).alias("cosine"), F.lit(0.0).alias("score"))
    q = F.array(*[F.lit(float(x)) for x in query])
    own = rows if where is None else rows.where(where)
    cos = dot(F.col(vector_col), q) / (norm(F.col(vector_col)) * float(np.sqrt(sum(x * x for x in query)) or 1.0))
    best = own.where(F.size(vector_col) == len(query)).select(id_col, F.round(cos, 6).alias("cosine")).orderBy(F.desc("cosine"), id_col).limit(k)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cosine") + 1) / 2)), 6)
    return best.select(F.row_number().over(W.orderBy(F.desc("cosine"), id_col)).alias("rank"), id_col, "cosine", score.alias("score"))


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of the store whose key new hasn't."""
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def missing(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return wanted.join(store.select(key), key, "left_anti")


def centroids(rows: DataFrame, group: str, vector_col: str = "embedding") -> DataFrame:
    """(group, dim, mean, variance, n) for each component of a group's vectors."""
    parts = rows.select(group, F.posexplode(vector_col).alias("dim", "x"))
    return parts.groupBy(group, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.var_pop(F.col("x").cast("double")), 6).alias("variance"), F.count("*").alias("n"))


def stub_embedding(text: str, dim: int = 64, synonyms: dict[str, str] | None = None) -> list[float]:
    """A vector that depends on the text's words only: the sum of one pseudo-random direction a word, of length 1."""
    total = np.zeros(dim)
    for word in re.findall(r"[a-z0-9]+", text.lower()):
        word = (synonyms or {}).get(word, word)
        seed = hashlib.blake2b(word.encode(), digest_size=8).digest()
        direction = np.random.default_rng(int.from_bytes(seed, "big")).standard_normal(dim)
        total += direction / np.linalg.norm(direction)
    length = np.linalg.norm(total)
    return (total / length if length else total).tolist()


def _states(seeds: np.ndarray) -> Iterator[tuple[int, int]]:
    """(state, inc) of np.random.PCG64 for each of the 64-bit seeds, which are hashed together as NumPy's SeedSequence does each."""
    mask, u32 = 0xFFFFFFFF, np.uint32
    zero = np.zeros(len(seeds), u32)
    pool = [(seeds & np.uint64(mask)).astype(u32), (seeds >> np.uint64(32)).astype(u32), zero, zero]
    const = 0x43B0D7E5

    def hashed(value: np.ndarray, const: int, by: int) -> tuple[np.ndarray, int]:
        after = const * by & mask
        value = (value ^ u32(const)) * u32(after)
        return value ^ (value >> u32(16)), after

    for i in range(4):
        pool[i], const = hashed(pool[i], const, 0x931E8875)
    for src in range(4):
        for dst in range(4):
            if src != dst:
                other, const = hashed(pool[src], const, 0x931E8875)
                mixed = pool[dst] * u32(0xCA01F9DD) - other * u32(0x4973F715)
                pool[dst] = mixed ^ (mixed >> u32(16))
    const, words = 0x8B51F9DD, []
    for i in range(8):
        word, const = hashed(pool[i % 4], const, 0x58F38DED)
        words.append(word.astype(np.uint64))
    for a, b, c, d in zip(*[(words[2 * i] | words[2 * i + 1] << np.uint64(32)).tolist() for i in range(4)], strict=True):
        inc = ((c << 64 | d) << 1 | 1) & ((1 << 128) - 1)
        yield ((inc + (a << 64 | b)) * 0x2360ED051FC65DA44385DF649FCCF645 + inc) & ((1 << 128) - 1), inc


def _directions(words: list[str], dim: int) -> np.ndarray:
    """A row for each word: what stub_embedding() adds for it, to the last bit, without a generator for each."""
    seeds = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in words], np.uint64)
    bits = np.random.PCG64(0)
    draw, out = np.random.Generator(bits).standard_normal, np.empty((len(words), dim))
    for row, (state, inc) in zip(out, _states(seeds), strict=True):
        bits.state = {"bit_generator": "PCG64", "state": {"state": state, "inc": inc}, "has_uint32": 0, "uinteger": 0}
        draw(out=row)
        row /= np.sqrt(row.dot(row))
    return out


class _Stub:
    """stub_embedding() of many texts: directions of words are kept, WORDS at a time."""

    def __init__(self, dim: int):
        self.dim, self.place, self.rows = dim, {}, np.empty((0, dim))

    def _placed(self, words: list[str]) -> list[int]:
        """Rows of words; those that aren't known are made, and if they are too many, in place of all others."""
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if new and len(self.place) + len(new) > WORDS:
            new, self.place, self.rows = list(dict.fromkeys(words)), {}, np.empty((0, self.dim))
        if new:
            if len(self.place) + len(new) > len(self.rows):
                more = np.empty((min(max(2 * len(self.rows), 4 * len(new), 1024), max(WORDS, len(new))), self.dim))
                more[: len(self.place)] = self.rows[: len(self.place)]
                self.rows = more
            begin = len(self.place)
            self.rows[begin : begin + len(new)] = _directions(new, self.dim)
            self.place.update(zip(new, range(begin, begin + len(new)), strict=True))
        return [self.place[w] for w in words]

    def each(self, texts: Iterable[str]) -> Iterator[list[float]]:
        """Vectors of texts, the words of several of which are placed at once."""
        held, n = [], 0
        for text in texts:
            held.append(re.findall(r"[a-z0-9]+", text.lower()))
            n += len(held[-1])
            if n >= WORDS // 2:
                yield from self._sums(held)
                held, n = [], 0
        yield from self._sums(held)

    def _sums(self, held: list[list[str]]) -> Iterator[list[float]]:
        if sum(map(len, held)) <= WORDS:
            self._placed([w for words in held for w in words])
        for words in held:
            yield self._sum(words)

    def _sum(self, words: list[str]) -> list[float]:
        total = np.zeros(self.dim)
        for begin in range(0, len(words), PIECE):  # sums are taken in the order of words
            at = self._placed(words[begin : begin + PIECE])
            total = np.add.reduce(np.concatenate([total[None], self.rows[at]]), axis=0)
        length = np.linalg.norm(total)
        return (total / length if length else total).tolist()


def embed(rows: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, embedding) by the stub embedder, in Arrow batches."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stub = _Stub(dim)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": list(stub.each(t or "" for t in batch["text"]))})

    return spread(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInPandas(run, "id long, embedding array<double>").withColumnRenamed("id", id_col)
