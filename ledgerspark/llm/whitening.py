"""Embedding whitening by shifted CholeskyQR.

One pass sums the vectors (whole numbers, so exactly). Then Gram passes over the centred rows: a task solves its rows against
the triangular factors found so far and adds up the Gram matrix of the result; the driver, which only sees d x d matrices,
factors it. The first factorisation is shifted (by 11 (nd + d(d+1)) u times the trace), so it succeeds for any condition of the
rows; each further pass orthogonalises what the one before left. The product of the factors is R of the centred rows, and the SVD of R
gives the components and the eigenvalues e = s^2 / n without squaring the condition. A last pass takes the covariance of the
whitened rows and states how far it is from the identity.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped; of several vector lengths the one that
most rows have counts (the longer of two), the others are dropped; a null vec_id and repeated rows are rows like others;
entries beyond 2**46 / 64 are held there; directions without variance are no components, so equal rows, or a single one, give
no rows, as does an empty table; a deviation beyond 64 bits is null; ties among eigenvalues give any basis of their space;
only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.partials import summed
from ledgerspark.llm.vectors import floored, matrices

SCALE = 64
SHIFT = 1_000_000  # added to each entry; differences do not see it
MOST = float(1 << 46)
PASSES = 3
COMPONENTS = 32
_LONG = (1 << 63) - 1
_UNIT = np.finfo(float).eps / 2


def _rows(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and whole-numbered entries (without SHIFT) of the vectors of ``size``."""
    for places, matrix in matrices(batch.column("embedding")):
        if matrix.shape[1] == size:
            yield places, floored(matrix, SCALE, MOST)


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular matrix, column after column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


@dataclass
class Fit:
    """What whitening needs: ``sums`` are those of the entries without SHIFT, ``components`` has one column for each."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from whole numbers where they fit."""
    if n * MOST < float(1 << 62) or n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0) < 1 << 62:
        return (n * x - np.array(sums, dtype=np.int64)) / n
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole) - np.array([s % n / n for s in sums])


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number and sums of the vectors of the most frequent length."""

    def add(batch: pa.RecordBatch, sums: dict[int, np.ndarray]) -> None:
        for _, matrix in matrices(batch.column("embedding")):
            x = floored(matrix, SCALE, MOST)
            # sums in two halves stay within 64 bits for 2**40 rows
            row = np.r_[len(x), (x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0)]
            size = x.shape[1]
            sums[size] = sums[size] + row if size in sums else row

    found = summed(vectors, add, np.int64)
    if not found:
        return 0, []
    size = max(found, key=lambda s: (found[s][0], s))
    high, low = found[size][1 : size + 1].tolist(), found[size][size + 1 :].tolist()
    return int(found[size][0]), [(h << 24) + x for h, x in zip(high, low)]


def _gram(vectors: DataFrame, n: int, sums: list[int], factors: list[np.ndarray]) -> np.ndarray:
    size = len(sums)

    def add(batch: pa.RecordBatch, total: dict[int, np.ndarray]) -> None:
        for _, x in _rows(batch, size):
            q = _centred(x, n, sums)
            for upper in factors:
                q = solved(q, upper)
            total[0] = total.get(0, 0) + (q.T @ q).ravel()

    return summed(vectors, add, np.float64)[0].reshape(size, size)


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular factor of a Gram matrix, shifted where asked for or where it is singular."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * _UNIT * float(np.trace(gram))
    try:
        return np.linalg.cholesky(gram + (shift if shifted else 0.0) * np.eye(d)).T
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(gram + max(shift, _UNIT) * np.eye(d)).T


def _root(gram: np.ndarray) -> np.ndarray:
    """A matrix whose own Gram matrix is ``gram``, also of a singular one."""
    try:
        return np.linalg.cholesky(gram).T
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(gram)
        return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def fit(vectors: DataFrame, passes: int = PASSES, most: int = COMPONENTS) -> Fit | None:
    """Components and eigenvalues of ``vectors(embedding)``; None where nothing varies."""
    n, sums = _sums(vectors)
    if not n:
        return None
    factors: list[np.ndarray] = []
    for k in range(passes):
        gram = _gram(vectors, n, sums, factors)
        if not np.trace(gram) > 0:
            return None
        if k + 1 < passes:
            factors.append(_factor(gram, n, shifted=not k))
    triangle = _root(gram)
    for upper in reversed(factors):
        triangle = triangle @ upper
    _, values, rows = np.linalg.svd(triangle)
    trace = float((values**2).sum()) / n
    held = min(most, int((values > values[0] * max(n, len(values)) * np.finfo(float).eps).sum()))
    components = rows[:held].T
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(held)])
    return Fit(n, sums, components, values[:held] ** 2 / n, trace)


def identity_error(vectors: DataFrame, fitted: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from a pass over all rows."""
    size, k = len(fitted.sums), len(fitted.eigenvalues)

    def add(batch: pa.RecordBatch, total: dict[int, np.ndarray]) -> None:
        for _, x in _rows(batch, size):
            w = fitted.whitened(x)
            total[0] = total.get(0, 0) + np.r_[w.sum(axis=0), (w.T @ w).ravel()]

    both = summed(vectors, add, np.float64)[0] / fitted.n
    mean = both[:k]
    return float(np.abs(both[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exactly."""
    bound = n * float(np.abs(x).max(initial=0)) + max(map(float, map(abs, sums)))
    if bound * bound * len(sums) < 2.0**62:
        apart = n * x - np.array(sums, dtype=np.int64)
        return pa.array((apart * apart).sum(axis=1))
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v <= _LONG else None for v in exact], pa.int64())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row for each usable row of ``rows(vec_id, embedding)`` and component, with the columns of WHITENED."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    vectors = rows.select("embedding")
    fitted = fit(vectors, most=most)
    if fitted is None or not len(fitted.eigenvalues):
        return rows.sparkSession.createDataFrame([], WHITENED)
    error = identity_error(vectors, fitted)
    size, k = len(fitted.sums), len(fitted.eigenvalues)
    shares = fitted.eigenvalues / fitted.trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in _rows(batch, size):
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(places)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, fitted.n, dtype=np.int64)),
                        _deviations(x, fitted.n, fitted.sums).take(each),
                        pa.array(fitted.whitened(x).ravel()),
                        pa.array(np.tile(shares, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=[c.split()[0] for c in WHITENED.split(", ")],
                )

    return rows.mapInArrow(projected, WHITENED)
