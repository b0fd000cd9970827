"""What the operators over embeddings share: which vectors take part, and lists of numbers as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def complete(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; never null."""
    return vector.isNotNull() & F.coalesce(F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def floored(vector: Column) -> Column:
    """floor(256 * c) of each component, as long; what no long holds becomes the nearest one."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * 256).cast("long"))


def matrices(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length; no list is null."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, flat[starts[own][:, None] + np.arange(size)]


def greatest(*arrays: np.ndarray) -> int:
    """The largest absolute value, as an int of any size."""
    return max((max(abs(int(a.min())), abs(int(a.max()))) for a in arrays if a.size), default=0)
