"""Embedding whitening by principal components.

1. Components become integers, x = floor(256 * c); the fit list holds each distinct x once, so copies weigh nothing. It
   is grouped before it is shuffled (a vector that a third of all rows have leaves each task once) and written.
2. Sums S of each dimension over the n vectors of the list are exact.
3. MLlib's computeSVD works on the distributed rows x - S / n. All components are asked for, as MLlib then takes its
   LAPACK way: vectors to double precision from a matrix of dimension * dimension numbers, summed by treeAggregate.
   Squared singular values over n are the eigenvalues of the covariance.
4. The total variance doesn't come from these, but from the exact deviations (n x - S)^2: their sum over n^3.
5. A pass over all rows projects them. The covariance of the whitened list, centred by its own means, is held against
   the identity; its largest difference is identity_error.

Vectors that are null or hold null or non-finite components are dropped; repeated and null ids are rows like others.
Vectors of different lengths are different spaces: each length is fitted for itself. Numbers that no long holds become
the nearest long. A component without variance (an eigenvalue under 1e-12 of the first) can't be scaled: its whitened is
null and it takes no part in identity_error; explained is null if nothing varies. Fewer dimensions than components give
as many as there are; empty tables and empty vectors give no rows. Extra columns are dropped. deviation is null where no
long holds it (a list of some 10 million vectors and more); deviation_exact, a decimal, has it to 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.session import checkpointed, forget, ship_package

from ._vectors import complete, floored, greatest, matrices

COMPONENTS = 4
#: Eigenvalues under this part of the first are noise of rounding.
NOISE = 1e-12
SPLIT = 10**18


class Space(NamedTuple):
    """What is fitted over the vectors of one length: vectors has a column for each component, values their eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2 for each row; exact, as int64 or as Python's ints."""
        most = self.n * greatest(x) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * max(1, x.shape[1]) < 2**63 else object
        far = x.astype(kind) * self.n - np.array(self.sums, kind)
        return (far * far).sum(axis=1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x.astype(np.float64) - mean) @ self.vectors / np.sqrt(self.values)


def _totals(fit: DataFrame, size: int, count: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """Sums over all vectors of a length of what count gives for a matrix; tasks add up their own first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                part = count(x)
                total = part if total is None else total + part
        if total is not None:
            values = pa.array(total, pa.float64()) if kind == "double" else pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], ["place", "value"])

    own = fit.where(F.size("x") == size).select("x").mapInArrow(add, f"place int, value {kind}")
    return [r["value"] for r in own.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()]


def _exact_sums(x: np.ndarray) -> np.ndarray:
    return x.astype(object).sum(axis=0) if greatest(x) * len(x) >= 2**62 else x.sum(axis=0).astype(object)


def fit_space(fit: DataFrame, n: int, size: int, components: int) -> Space:
    """The principal components of a table of n distinct vectors x of one length."""
    sums = [int(s) for s in _totals(fit, size, _exact_sums, "decimal(38,0)")]
    plain = Space(n, sums, np.zeros((size, 0)), np.zeros(0), [])

    def spread(x: np.ndarray) -> np.ndarray:
        total = int(plain.deviations(x).astype(object).sum())
        return np.array([total // SPLIT, total % SPLIT], object)

    high, low = _totals(fit, size, spread, "decimal(38,0)")
    trace = Fraction(int(high) * SPLIT + int(low), n**3)
    k = min(components, size)
    if not trace:
        return plain._replace(vectors=np.zeros((size, k)), values=np.zeros(k), explained=[None] * k)
    centred = F.zip_with("x", F.array(*[F.lit(s / n) for s in sums]), lambda c, m: c.cast("double") - m)
    rows = MLUtils.convertVectorColumnsFromML(fit.where(F.size("x") == size).select(array_to_vector(centred).alias("v")), "v")
    svd = RowMatrix(rows, n, size).computeSVD(size, computeU=False, rCond=1e-300)
    # MLlib leaves out singular values of zero.
    values = np.pad(svd.s.toArray() ** 2 / n, (0, k))[:k]
    vectors = np.pad(svd.V.toArray(), ((0, 0), (0, k)))[:, :k]
    values = np.where(values > NOISE * values[0], values, 0.0)
    space = plain._replace(vectors=vectors, values=values, explained=[float(Fraction(float(e)) / trace) for e in values])

    live = np.flatnonzero(values > 0)
    own = space._replace(vectors=vectors[:, live], values=values[live])
    means = np.array(_totals(fit, size, lambda x: own.whitened(x).sum(axis=0))) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = own.whitened(x) - means
        return (w.T @ w).ravel()

    covariance = np.array(_totals(fit, size, products)).reshape(len(live), -1) / n
    return space._replace(identity_error=float(np.abs(covariance - np.eye(len(live))).max()))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_exact): a row for each vector and component."""
    ship_package(rows.sparkSession)
    kept = rows.where(complete(F.col(vector_col)) & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("id"), floored(F.col(vector_col)).alias("x"))
    fit = checkpointed(kept.select("x").distinct())
    lengths = fit.groupBy(F.size("x").alias("size")).count().collect()
    spaces = {r["size"]: fit_space(fit, r["count"], r["size"], components) for r in lengths}
    forget(fit)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in matrices(batch.column(1)):
                space = spaces[x.shape[1]]
                k = len(space.values)
                far = pa.array([str(t) for t in space.deviations(x)])
                with np.errstate(divide="ignore", invalid="ignore"):
                    white = space.whitened(x)
                place = np.repeat(np.arange(len(own)), k)
                which = np.tile(np.arange(k), len(own))
                columns = [
                    batch.column(0).take(pa.array(own[place])), pa.array(which + 1, pa.int32()), pa.array(np.full(len(which), space.n, np.int64)), far.take(pa.array(place)),
                    pa.array(white.ravel(), pa.float64(), mask=(space.values == 0)[which]), pa.array([space.explained[i] for i in which], pa.float64()), pa.array(np.full(len(which), space.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "far", "whitened", "explained", "identity_error"])

    found = kept.mapInArrow(project, "id long, component int, n long, far string, whitened double, explained double, identity_error double")
    return found.select(
        F.col("id").alias(id_col), "component", "n", F.expr("try_cast(far AS bigint)").alias("deviation"), "whitened", "explained", "identity_error",
        F.expr("try_cast(far AS decimal(38,0))").alias("deviation_exact"),
    )


def plain_whiten(vectors: list[list[int]], components: int = COMPONENTS) -> tuple[int, list[int], np.ndarray, np.ndarray, float]:
    """(n, deviations, eigenvalues, whitened, trace) of integer vectors of one length; for tests."""
    fit = np.array(sorted({tuple(v) for v in vectors}), float)
    n, sums = len(fit), [sum(int(c) for c in column) for column in fit.T]
    deviations = [sum((n * int(c) - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in vectors]
    centred = fit - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    white = (np.array(vectors, float) - np.array(sums) / n) @ axes[:, order] / np.sqrt(values[order])
    return n, deviations, values[order], white, float(values.sum())
