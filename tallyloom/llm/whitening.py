"""Whitening of embeddings by a covariance from polarisation: variances of dimensions and of their pairwise sums.

Entries become whole numbers x = floor(1024 c) + 100000.  With V(i) the variance of a dimension and V(i+j) that of
the sum of two, the covariance of i and j is (V(i+j) - V(i) - V(j)) / 2; so all that is aggregated over the rows
are squares, and these are exact: x is centred by the whole part of its mean before it is squared, tasks sum
squares of whole numbers, the sums of tasks are added as decimals, and the part of the mean below one is taken
into account in whole numbers too (the sum of (n x - S)^2 is n^2 times that of y^2, less n r^2, where y = x - m,
m = S div n and r = S - n m; for a pair both of x and S are sums of two).  The covariance matrix (one number a
pair of dimensions, whatever the number of rows) goes to the driver for ``eigh``; rows never do.

Defined results: rows whose vector is null or empty, or holds a null, NaN, infinite or not representable entry
(x beyond 2^61) are dropped, and so are vectors whose length is not the commonest (ties: the longest); all
others are the fit list, repeated rows and ids and null ids included.  Directions without variance (an
eigenvalue of no more than 1e-12 of the largest) have no component, so equal vectors, or a single one, give no
rows; an empty table gives none.  Signs: a component's largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
NO_VARIANCE = 1e-12
BLOCK = 4096  # rows that a task takes at once
_LONG = 1 << 62


def whole(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x array<long>) of the rows that remain."""
    c = F.col(column).cast("array<double>")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 51))
    rows = vectors.select(F.col(key).alias("vec_id"), c.alias("c")).filter("size(c) > 0").filter(F.forall("c", fine))
    sizes = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    return rows.filter(F.size("c") == d).select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            if len(part := batch.slice(k, BLOCK)):
                yield part


def _summed(values: np.ndarray) -> list[Decimal]:
    """Exact sums of whole numbers down the columns."""
    most = max(abs(int(values.max())), abs(int(values.min()))) * len(values)
    return [Decimal(int(v)) for v in (values if most < _LONG else values.astype(object)).sum(axis=0)]


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            x = _matrix(part.column("x"))
            total = [Decimal(len(x)), *_summed(x)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["i", "v"])

    found = rows.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()
    held = {r.i: int(r.v) for r in found}
    return held.get(0, 0), [held[k] for k in range(1, len(held))]


def _pairs(d: int) -> list[tuple[int, int]]:
    """(i, i) stands for the dimension itself."""
    return [(i, j) for i in range(d) for j in range(i, d)]


def squares(rows: DataFrame, means: list[int]) -> dict[tuple[int, int], int]:
    """Of each dimension (i, i) and each sum of two (i, j): the sum of squares, centred by whole ``means``."""
    d = len(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            y = _matrix(part.column("x")) - np.array(means, np.int64)
            most = 2 * max(abs(int(y.max())), abs(int(y.min())))
            if most * most * len(y) >= _LONG:
                y = y.astype(object)  # whole numbers of any length
            out: list[Decimal] = []
            for i in range(d):
                both = y[:, i : i + 1] + y[:, i:]
                both[:, 0] = y[:, i]
                out += [Decimal(int(v)) for v in (both * both).sum(axis=0)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out, pa.decimal128(38, 0))], names=["p", "v"])

    found = rows.select("x").mapInArrow(run, "p int, v decimal(38,0)").groupBy("p").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()
    pairs = _pairs(d)
    return {pairs[r.p]: int(r.v) for r in found}


@dataclass(frozen=True)
class Whitener:
    """n, the dimensions' sums and the components: unit eigenvectors (rows), eigenvalues, and the trace."""

    n: int
    totals: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def means(self) -> list[int]:
        return [s // self.n for s in self.totals]

    @property
    def rests(self) -> list[int]:
        return [s % self.n for s in self.totals]

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers, whitened."""
        centred = (x - np.array(self.means, np.int64)).astype(float) - np.array([r / self.n for r in self.rests])
        return centred @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[Decimal]:
        """The sum of (n x - S)^2 over a row's dimensions, exact."""
        y = x - np.array(self.means, np.int64)
        most = self.n * (max(abs(int(y.max())), abs(int(y.min()))) + 1)
        if most * most * x.shape[1] >= _LONG:
            y = y.astype(object)
        t = y * self.n - np.array(self.rests, y.dtype)
        return [Decimal(int(v)) for v in (t * t).sum(axis=1)]


def covariance(n: int, totals: list[int], found: dict[tuple[int, int], int]) -> list[list[Fraction]]:
    """The exact covariance matrix, divisor n, from the sums of squares."""
    d = len(totals)
    rests = [s % n for s in totals]

    def variance(i: int, j: int) -> Fraction:  # of one dimension, or of the sum of two
        r = rests[i] if i == j else rests[i] + rests[j]
        return Fraction(n * n * found[i, j] - n * r * r, n**3)

    own = [variance(i, i) for i in range(d)]
    out = [[own[i] if i == j else Fraction(0) for j in range(d)] for i in range(d)]
    for i in range(d):
        for j in range(i + 1, d):
            out[i][j] = out[j][i] = (variance(i, j) - own[i] - own[j]) / 2
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """From ``rows`` with x, as of :func:`whole`; None where there are none."""
    n, totals = sums(rows)
    if not n:
        return None
    exact = covariance(n, totals, squares(rows, [s // n for s in totals]))
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in row] for row in exact]))
    keep = [k for k in range(len(values) - 1, -1, -1) if values[k] > NO_VARIANCE * max(values[-1], 0.0)][:components]
    chosen = vectors[:, keep].T.reshape(len(keep), len(totals))
    flip = np.sign(chosen[np.arange(len(keep)), np.abs(chosen).argmax(axis=1)])
    return Whitener(n, tuple(totals), chosen * flip[:, None], values[keep], float(sum(exact[k][k] for k in range(len(totals)))))


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """The largest entry of the whitened rows' covariance less the identity."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            w = model.projected(_matrix(part.column("x")))
            yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([w.sum(axis=0), (w.T @ w).ravel()]))], names=["p", "v"])

    found = rows.select("x").mapInArrow(run, "p int, v double").groupBy("p").agg(F.sum("v").alias("v")).collect()
    held = np.array([v for _, v in sorted((r.p, r.v) for r in found)]) / model.n
    mean, square = held[:k], held[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each remaining row and component.

    ``deviation`` is a whole decimal, which holds what a long can't.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = whole(vectors, column, key)
    model = fit(rows, components)
    k = len(model.values) if model else 0
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    error, share = identity_error(rows, model), model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            x, ids = _matrix(part.column("x")), part.column("vec_id")
            each = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(model.deviations(x), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)), deviation.take(pa.array(each)),
                 pa.array(model.projected(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
