"""Vectorised text primitives on Arrow string buffers.

A batch of documents is one byte buffer with offsets; words, k-grams and hashes are found with array
operations over the whole buffer, never by a loop over characters. Batches are cut into slices of bounded
size first, so a worker's memory doesn't follow the batch. A single document longer than a slice forms a
slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructField, StructType

SLICE_BYTES = 1 << 20
U64 = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None

_BASE = U64(0x9E3779B97F4A7C15 | 5)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, (1 << 20) + 1024)
        up = np.full(size, _BASE, dtype=U64)
        down = np.full(size, _BASE_INV, dtype=U64)
        up[0] = down[0] = U64(1)
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one plain string array, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffer_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large_string array without nulls."""
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = strings.buffers()
    offsets = np.frombuffer(off, np.int64)[strings.offset : strings.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay within the limit, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end
    trim()


def trim() -> None:
    """Gives freed memory back to the system: workers live longer than their tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def schema(own: str, *kept: StructField) -> StructType:
    """The columns that own spells, then those that are kept, whatever their names and types are."""
    return StructType([*StructType.fromDDL(own).fields, *kept])


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words between ASCII white space.
NON_SPACE = ~byte_table([(0x20, 0x20), (0x09, 0x0D)])
#: Words of digits, letters and all that isn't ASCII (after lower-casing).
ALNUM = byte_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True; runs never cross a document's border."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    before[edges] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[edges[edges > 0] - 1] = False
    return starts, np.flatnonzero(mask & ~after) + 1


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the hash of any span."""
    up, _ = powers(len(buf))
    out = np.empty(len(buf) + 1, U64)
    out[0] = 0
    np.cumsum(_VALUES[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, the same for the same bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words_of(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of a slice: (hash, start, end, first word of each document + total)."""
    low = LOWER[buf]
    starts, ends = runs(table[low], offsets)
    hashes = span_hash(prefix_hash(low), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


#: Odd multipliers by the place of a word in an n-gram.
_PLACES = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def ngram_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, one for each start (borders of documents aren't regarded)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.zeros(count, U64)
    for i in range(n):
        total += hashes[i : i + count] * _PLACES[i]
    return mix64(total + U64(n))


def string_hash(text: bytes) -> int:
    buf = np.frombuffer(text, np.uint8)
    return int(span_hash(prefix_hash(buf), np.array([0]), np.array([len(buf)]))[0])
