"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding: texts are split into pieces, and the distinct pieces of a slice go through _bytebpe.Transducer, whose
states and compatible pairs are found when inputs need them. Decoding: StreamDecoder turns ids into bytes and
keeps an incomplete UTF-8 sequence back until its remaining bytes come.

Null or empty text: no ids, and the hash of empty input. Special strings are ordinary text. Repeated rows and ties
don't matter, extra columns are dropped, empty tables give empty results. Nothing is shuffled; a worker holds one
slice of about 1 MB, the ids of one document, and at most CACHE pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataq.session import ship_package

from . import _text as tx
from ._bytebpe import Transducer, load_tiktoken, tiktoken_classifier
from ._pieces import Splitter, unique_pieces

CACHE = 120_000
#: Pieces whose ids the decoder gets at once.
STEP = 1024


class StreamDecoder:
    """Ids in, text out. The UTF-8 state is the bytes of a character that isn't complete yet (3 at most)."""

    def __init__(self, token_bytes: dict[int, bytes]):
        self.token_bytes = token_bytes
        self.held = b""

    @staticmethod
    def _incomplete(data: bytes) -> int:
        """Bytes at the end that begin a character but don't complete it."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 1
            if need <= back:
                return 0
            second = data[-back + 1] if back > 1 else None
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
            return back if second is None or low <= second <= high else 0
        return 0

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.token_bytes.__getitem__, ids))
        cut = len(data) - self._incomplete(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Codec:
    def __init__(self, path: str):
        self.model = load_tiktoken(path)
        self.transducer = Transducer(self.model)
        self.splitter = Splitter(tiktoken_classifier(path))
        self.cache: dict[int, tuple[int, ...]] = {}

    def pieces(self, buf: np.ndarray, starts: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
        """Ids of the distinct pieces, and for each piece of the slice which of them it is."""
        hashes, first, ends, inverse = unique_pieces(buf, starts)
        keys = hashes.tolist()
        found = [self.cache.get(h) for h in keys]
        new = np.array([i for i, ids in enumerate(found) if ids is None], np.int64)
        if len(new):
            encoded = self.transducer.encode_all(buf, first[new], ends[new])
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
            for i, ids in zip(new.tolist(), encoded, strict=True):
                found[i] = self.cache[keys[i]] = tuple(ids)
        return found, inverse

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[list[tuple[int, ...]], np.ndarray]]:
        """For each document of the slice: (ids by distinct piece, its pieces)."""
        starts = self.splitter.starts(buf, offsets)
        found, inverse = self.pieces(buf, starts) if len(starts) else ([], np.zeros(0, np.int64))
        bounds = np.searchsorted(starts, offsets)
        for i in range(len(offsets) - 1):
            yield found, inverse[bounds[i] : bounds[i + 1]]

    def encode(self, text: str) -> list[int]:
        buf = np.frombuffer(text.encode(), np.uint8)
        found, own = next(self.documents(buf, np.array([0, len(buf)])))
        return [t for i in own.tolist() for t in found[i]]

    def decode(self, ids: list[int], step: int = 4096) -> str:
        stream = StreamDecoder(self.model.bytes)
        return "".join([*(stream.feed(ids[i : i + step]) for i in range(0, len(ids), step)), stream.finish()])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            buf, offsets = tx.buffer_of(tx.as_strings(batch.column(1)))
            for a, b in tx.slices(offsets):
                ids = [[t for i in mine.tolist() for t in found[i]] for found, mine in own.documents(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kept = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): ids back to text, by the streaming decoder."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kept = encoded.select(encoded[id_col].cast("long").alias("id"), encoded[ids_col].alias("ids"))
    return kept.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col).withColumnRenamed("text", "text")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids, as decimals with commas, and of what they decode to."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            buf, offsets = tx.buffer_of(tx.as_strings(batch.column(1)))
            for a, b in tx.slices(offsets):
                counts, ids_hash, text_hash = [], [], []
                names = sizes = kept = None
                for found, mine in own.documents(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    if found is not kept:
                        kept = found
                        names = [",".join(map(str, ids)) for ids in found]
                        sizes = np.array([len(ids) for ids in found], np.int64)
                    mine_list = mine.tolist()
                    counts.append(int(sizes[mine].sum()) if mine_list else 0)
                    ids_hash.append(hashlib.sha256(",".join([names[i] for i in mine_list]).encode()).hexdigest())
                    stream, digest = StreamDecoder(own.model.bytes), hashlib.sha256()
                    for i in range(0, len(mine_list), STEP):
                        digest.update(stream.feed(t for piece in mine_list[i : i + STEP] for t in found[piece]).encode())
                    digest.update(stream.finish().encode())
                    text_hash.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
