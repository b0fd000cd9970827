"""Token counts by prefix dynamic programming.

For each distinct piece of text the dynamic programme over its prefixes gives the exact number of tokens of every
prefix: the one token that may end a prefix is found from the last tokens of the prefixes before it
(BpeModel.last_tokens() states it plainly; Transducer.counts() keeps each step, so that it is worked out once). With the running count at piece borders, the count of every prefix of a document is known
without encoding again. token_counts() returns the last of them for whole texts, prefix_counts() all of them, and
fit_to_budget() cuts texts to a budget by looking up the longest prefix that fits.

Null or empty text: 0 tokens. Special strings of the vocabulary inside a text count as one token each, as the
library's default has it. Extra columns don't matter; repeated rows are counted each for itself; an empty table
gives an empty result. Memory: slices of 1 MB and a dictionary of at most CACHE pieces in each worker; nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataq.session import ship_package

from . import _text as tx
from ._bytebpe import Transducer, cut_at_specials, load_json
from ._pieces import unique_pieces

CACHE = 300_000
LIMIT = 512


class PrefixCounter:
    def __init__(self, path: str):
        self.model, self.splitter, self.special = load_json(path)
        self.automaton = Transducer(self.model)
        self.cache: dict[int, int] = {}

    def piece_counts(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each piece of the buffer."""
        hashes, first, ends, inverse = unique_pieces(buf, starts)
        cache = self.cache
        out = np.array([cache.get(h, -1) for h in hashes.tolist()], np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self.automaton.count_all(buf, first[new], ends[new])
            if len(cache) + len(new) > CACHE:
                cache.clear()
            cache.update(zip(hashes[new].tolist(), out[new].tolist(), strict=True))
        return out[inverse]

    def totals(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each document of a slice."""
        n = len(offsets) - 1
        parts, docs, special = cut_at_specials(buf, offsets, self.special)
        starts = self.splitter.starts(buf, parts)
        if not len(starts):
            return np.zeros(n, np.int64)
        counts = self.piece_counts(buf, starts)
        part = np.searchsorted(parts, starts, side="right") - 1
        counts[special[part] == 1] = 0
        out = np.bincount(docs[part], weights=counts, minlength=n).astype(np.int64)
        return out + np.bincount(docs[special == 1], minlength=n)

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to len(text)."""
        out, total, done = np.zeros(len(text) + 1, np.int64), 0, 0
        buf = np.frombuffer(text.encode(), np.uint8)
        if not len(buf):
            return out
        parts, docs, special = cut_at_specials(buf, np.array([0, len(buf)]), self.special)
        starts = self.splitter.starts(buf, parts).tolist()
        is_special = dict(zip(parts.tolist(), special.tolist(), strict=False))
        raw, count = buf.tobytes(), self.automaton.counts
        ends = [*starts[1:], len(raw)]
        k = 0
        while k < len(starts):
            if is_special.get(starts[k]):
                end = next(e for e in parts.tolist() if e > starts[k])
                body = raw[starts[k] : end].decode()
                inner = self._within(raw[: starts[k]].decode(), body[:-1], total)
                out[done + 1 : done + len(body)] = inner[1:]
                done += len(body)
                total += 1
                out[done] = total
                while k < len(starts) and starts[k] < end:
                    k += 1
                continue
            piece = raw[starts[k] : ends[k]]
            counts = count(piece)
            chars = piece.decode()
            at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in chars])])
            values = np.array([counts[i] for i in at])
            if len(chars) == 3 and chars[0] == "'" and chars[1:].isalpha():  # 're, 've, 'll: cut short, the apostrophe stands apart
                values[2] = count(piece[:1])[-1] + count(piece[1:2])[-1]
            out[done + 1 : done + len(chars) + 1] = total + values[1:]
            if chars[0] == " " and len(chars) > 1 and k and self._blank(raw[starts[k - 1] : starts[k]]) and not is_special.get(starts[k - 1]):
                run = raw[starts[k - 1] : starts[k]]  # cut after this blank, all of the white space is one piece
                out[done + 1] = total - count(run)[-1] + count(run + b" ")[-1]
            elif self._blank(piece) and k and self._blank(raw[starts[k - 1] : starts[k]]) and not is_special.get(starts[k - 1]):
                run = raw[starts[k - 1] : starts[k]]
                base = total - count(run)[-1]
                for i in range(1, len(chars) + 1):
                    whole = count(run + piece[: at[i]])[-1]
                    out[done + i] = base + whole
            done += len(chars)
            total += counts[-1]
            k += 1
        return out

    def _within(self, before: str, body: str, total: int) -> np.ndarray:
        """Counts within the beginning of a special string, which isn't special until it is whole."""
        out = np.empty(len(body) + 1, np.int64)
        for i in range(len(body) + 1):
            joined = np.frombuffer((before + body[:i]).encode(), np.uint8)
            out[i] = self.totals(joined, np.array([0, len(joined)]))[0] if i else total
        return out

    @staticmethod
    def _blank(piece: bytes) -> bool:
        return piece.decode().isspace()


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        for batch in batches:
            buf, offsets = tx.buffer_of(tx.as_strings(batch.column(1)))
            found = [counts.totals(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tx.slices(offsets)]
            tokens = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kept = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return kept.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def prefix_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prefix_tokens): the number of tokens of every prefix, by characters, from 0."""
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                found = counts.prefixes(batch.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([found.tolist()], pa.list_(pa.int64()))], ["id", "prefix_tokens"])

    kept = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return kept.mapInArrow(count, "id long, prefix_tokens array<long>").withColumnRenamed("id", id_col)


def fit_to_budget(docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_tokens): each text cut to its longest prefix of at most budget tokens."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            short, tokens = [], []
            for text in texts:
                found = counts.prefixes(text)
                end = int(np.flatnonzero(found <= budget)[-1])
                short.append(text[:end])
                tokens.append(int(found[end]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.string()), pa.array(tokens, pa.int64())], ["id", "text", "n_tokens"])

    kept = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return kept.mapInArrow(cut, "id long, text string, n_tokens long").withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
