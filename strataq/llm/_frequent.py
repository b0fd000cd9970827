"""The most frequent keys of a table of counts, in bounded numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, key: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of (key, n), sorted by key: all from a size on, and at most limit.

    Sizes are eighths of powers of two, so a few hundred rows tell which one keeps the limit.
    """
    size = F.floor(F.log2("n") * 8).alias("size")
    total = 0
    for row in counts.groupBy(size).count().orderBy(F.desc("size")).collect():
        total += row["count"]
        if total > limit:
            counts = counts.where(size > row["size"])
            break
    found = counts.select(key, "n").toPandas()
    keys = found[key].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy(np.int64)[order]
