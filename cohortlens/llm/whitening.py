"""Embedding whitening by shifted CholeskyQR (operator 11).

The centred rows ``A`` (one vector a row) are never gathered.  A *Gram pass*
sums ``Q'Q`` of the rows ``Q = A inv(R1) inv(R2) ...`` over all tasks, where
every task solves the triangular systems for its own rows; the Cholesky factor
of the sum is the next ``R``.  The first Gram matrix is shifted, which keeps
its factor usable whatever the condition of ``A``; the passes go on until the
rows are orthonormal, two more as a rule.  The product of the factors is then
the R of ``A = QR``, so its singular values and right singular vectors are
those of ``A``: the covariance is never formed and its condition never squared.

Components that no vector spreads along (singular value zero in double
precision) cannot be whitened and are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the fixed-point form of an entry.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Bytes of rows that a task works on at once.
SLICE = 8 << 20
#: The rows count as orthonormal when the entries of G G - G are below this.
ORTHONORMAL, MOST_PASSES = 1e-11, 8


@dataclass(frozen=True)
class Centre:
    """Rows, a whole number near the mean of each dimension, and what the
    sums exceed ``n`` times that number by: ``n x - S`` without large terms."""

    n: int
    near: np.ndarray
    rest: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact: 64-bit integers, or Python's where these could
        overflow."""
        y = x - self.near
        if y.size and self.n * int(np.abs(y).max()) >= 1 << 62:
            return self.n * y.astype(object) - self.rest
        return self.n * y - self.rest


@dataclass(frozen=True)
class Whitening:
    """``centre``, ``axes`` (a column per component), ``spread`` (its standard
    deviation) and ``explained`` (its share of the variance)."""

    centre: Centre
    axes: np.ndarray
    spread: np.ndarray
    explained: np.ndarray

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return ((deviations / self.centre.n).astype(np.float64) @ self.axes) / self.spread


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` of the rows whose vector holds finite numbers only."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) \
        .where(v.isNotNull() & finite)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``(ids, x)``: rows as 64-bit integers, in slices of bounded size."""
    for batch in batches:
        v = batch.column("v")
        width = len(v[0]) if batch.num_rows else 0
        step = max(1, SLICE // (8 * max(1, width)))
        for at in range(0, batch.num_rows, step):
            part = v.slice(at, step)
            flat = np.floor(SCALE * part.flatten().to_numpy(zero_copy_only=False))
            if flat.size and np.abs(flat).max() >= float(1 << 62):
                raise OverflowError("an entry is too large for its 64-bit fixed-point form")
            yield batch.column("id").slice(at, step), flat.astype(np.int64).reshape(len(part), width) + OFFSET


def _summed(rows: DataFrame, dims: int, cells: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``cells(x)`` (a vector) over all slices: one partial vector a
    task, added by cell in Spark."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _slices(batches):
            value = cells(x)
            total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total)], names=["cell", "value"])

    sums = rows.mapInArrow(part, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(dims)
    for row in sums:
        out[row["cell"]] = row["value"]
    return out


def _centre(rows: DataFrame) -> Centre:
    """Counts and exact sums per dimension; fails if vectors differ in length."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _slices(batches):
            n, dims = x.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array((x - OFFSET).sum(axis=0, dtype=np.int64))],
                names=["dim", "n", "sum"])

    odd = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if odd["least"] != odd["most"]:
        raise ValueError(f"the vectors have between {odd['least']} and {odd['most']} entries")
    sums = rows.mapInArrow(part, "dim long, n long, sum long").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).orderBy("dim").collect()
    if not sums:
        return Centre(0, np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = int(sums[0]["n"])
    near = [int(r["sum"]) // n for r in sums]
    return Centre(n, np.array(near, np.int64) + OFFSET, np.array([int(r["sum"]) - n * k for r, k in zip(sums, near)], np.int64))


def _gram(rows: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``Q'Q`` over all rows, ``Q = of(x)`` with ``dims`` columns."""
    upper = np.triu_indices(dims)

    def cells(x: np.ndarray) -> np.ndarray:
        q = of(x)
        return (q.T @ q)[upper]

    out = np.zeros((dims, dims))
    out[upper] = _summed(rows, upper[0].size, cells)
    return np.triu(out) + np.triu(out, 1).T


def _factor(gram: np.ndarray, rows: int, first: bool) -> np.ndarray:
    """The upper Cholesky factor; shifted on the first pass, and later where
    the matrix is singular."""
    dims = len(gram)
    norm = np.linalg.norm(gram, 2)
    shift = 11 * (rows * dims + dims * (dims + 1)) * np.finfo(float).eps / 2 * norm
    for added in ([] if first else [0.0]) + [shift, 1e3 * shift, 1e-9 * norm]:
        try:
            factor = np.linalg.cholesky(gram + added * np.eye(dims)).T
        except np.linalg.LinAlgError:
            continue
        # a factor that rounding alone keeps regular is as good as singular
        if added or np.diag(factor).min() ** 2 > shift:
            return factor
    raise ArithmeticError("no shift makes the Gram matrix positive definite")


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (``id, v``); None if no component has any
    spread.  Matrices of the vectors' length are all that the driver holds."""
    centre = _centre(rows)
    n, dims = centre.n, centre.near.size
    if not n or not dims:
        return None
    factors: list[np.ndarray] = []

    def solved(x: np.ndarray) -> np.ndarray:
        q = (centre.deviations(x) / n).astype(np.float64).T
        for r in factors:
            q = np.linalg.solve(r.T, q)
        return q.T

    whole = np.eye(dims)
    for turn in range(MOST_PASSES):
        gram = _gram(rows, dims, solved)
        if not gram.any():
            return None
        factors = factors + [_factor(gram, n, turn == 0)]
        whole = factors[-1] @ whole
        if turn and np.abs(gram @ gram - gram).max() < ORTHONORMAL:
            break
    else:
        raise ArithmeticError(f"the rows are not orthonormal after {MOST_PASSES} passes")
    _, sigma, axes = np.linalg.svd(whole)
    kept = int((sigma > sigma[0] * dims * 1e-13).sum())
    k = min(components, kept)
    axes = axes[:k].T
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return Whitening(centre, axes, sigma[:k] / np.sqrt(n), sigma[:k] ** 2 / (sigma[:kept] ** 2).sum())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``vectors`` and component: ``vec_id``,
    ``component`` (from 1, by falling variance, at most ``components``), ``n``
    (usable rows), ``deviation`` (sum over the dimensions of ``(n x - S)^2``,
    exact), ``whitened``, ``explained`` and ``identity_error`` (largest entry
    of the whitened rows' covariance minus the identity, measured over all
    rows).

    An entry ``c`` counts as ``x = floor(64 c) + 1000000``.  Rows whose vector
    is NULL or holds a NULL, NaN or infinite entry are left out; a NULL key
    stays NULL and repeated rows count and return each.  An empty table, a
    single vector or vectors that are all equal have no component and give no
    row.  Vectors of unequal length, or entries beyond 2^62, are an error.
    Only the two named columns are read, so others may have any name.
    """
    rows = _usable(vectors, key, vector)
    fit = fit_whitening(rows, components)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, " \
             "identity_error double"
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k, centre = fit.spread.size, fit.centre
    gram = _gram(rows, k, lambda x: fit.project(centre.deviations(x)))
    error = float(np.abs(gram / centre.n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _slices(batches):
            for at in range(0, len(x), 2048):
                part = centre.deviations(x[at:at + 2048])
                m = len(part)
                square = _squares(part)
                of_row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, m).take(of_row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, centre.n)), square.take(of_row), pa.array(fit.project(part).ravel()),
                     pa.array(np.tile(fit.explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def _squares(deviations: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row as decimal(38,0)."""
    kind = pa.decimal128(38, 0)
    if deviations.dtype != object:
        largest = int(np.abs(deviations).max(initial=0))
        if largest * largest * max(1, deviations.shape[1]) < 1 << 62:
            return pa.array((deviations * deviations).sum(axis=1)).cast(kind)
        deviations = deviations.astype(object)
    import decimal

    context = decimal.Context(prec=38)
    return pa.array([context.create_decimal(int(s)) for s in (deviations * deviations).sum(axis=1)], kind)
