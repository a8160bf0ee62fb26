"""Whitening of embeddings along the leading principal components of a randomised range finder.

Entries become whole numbers first, so sums and deviations are exact. The range finder multiplies the covariance of all
centred rows with a narrow random matrix, some columns wider than what is asked for, and repeats that with the
orthonormal product; every product is one pass over all rows that sums a (dimension x width) matrix. Rayleigh-Ritz
in that basis gives components, whose residuals say whether they are eigenvectors to double precision. A flat
spectrum doesn't get there in few passes: then the basis is expanded to the full dimension, where Rayleigh-Ritz is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.vectors import matrix, sound_vectors

#: Components that are asked for, columns beside them, and power passes before the basis is expanded.
COMPONENTS, OVERSAMPLING, PASSES = 32, 16, 4
#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Beyond this, whole numbers are cut off.
LARGEST = 1 << 62
#: A component with a smaller share of the largest eigenvalue counts as zero and isn't returned.
NEGLIGIBLE = 1e-11

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Moments:
    """Number of rows, and exact sums of the whole numbers by dimension."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once where n * x fits in 64 bits."""
        if self.fits(x):
            return (self.n * x - np.array(self.sums, dtype=np.int64)) / self.n
        return x - np.array([s / self.n for s in self.sums])

    def fits(self, x: np.ndarray) -> bool:
        most = max(int(np.abs(x).max(initial=0)), *(abs(s) // self.n for s in self.sums))
        return most * self.n < 1 << 60

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; null where it doesn't fit in a long."""
        if self.fits(x):
            apart = self.n * x - np.array(self.sums, dtype=np.int64)
            if int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
                return (apart * apart).sum(axis=1).tolist()
        exact = (sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x)
        return [d if d < 1 << 63 else None for d in exact]


@dataclass(frozen=True)
class Whitening:
    """A fitted transform; columns of ``axes`` are unit eigenvectors by falling eigenvalue."""

    moments: Moments
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    expanded: bool

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ self.axes / np.sqrt(self.eigenvalues)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _sums(rows: DataFrame, dim: int, one: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """Sums over all rows of ``one(x)``, a flat array of ``size`` cells for a batch x; each task sends one row a cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = one(whole_numbers(matrix(batch.column(0), dim)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    cells = rows.select("v").mapInArrow(partial, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(size, dtype=np.float64 if kind == "double" else np.int64)
    for batch in cells.toArrow().to_batches():
        out[batch.column("cell").to_numpy()] = batch.column("value").to_numpy()
    return out


def fit_moments(rows: DataFrame, dim: int) -> Moments:
    """Halves of 32 bits are summed apart, so that no sum of up to 2^31 rows a task overflows."""

    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    flat = [int(v) for v in _sums(rows, dim, halves, 1 + 2 * dim, "long")]
    return Moments(flat[0], tuple((high << 32) + low for high, low in zip(flat[1 : 1 + dim], flat[1 + dim :], strict=True)))


def _product(rows: DataFrame, moments: Moments, basis: np.ndarray) -> np.ndarray:
    """Covariance times ``basis``, centred before multiplying, in one pass."""

    def one(x: np.ndarray) -> np.ndarray:
        apart = moments.centred(x)
        return (apart.T @ (apart @ basis)).reshape(-1)

    return _sums(rows, basis.shape[0], one, basis.size).reshape(basis.shape) / moments.n


def _rayleigh_ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residual norms) of the covariance within the span of ``basis``, by falling value."""
    inner = basis.T @ product
    values, turns = np.linalg.eigh((inner + inner.T) / 2)
    values, turns = values[::-1], turns[:, ::-1]
    vectors = basis @ turns
    return values, vectors, np.linalg.norm(product @ turns - vectors * values, axis=0)


def fit_whitening(
    rows: DataFrame, dim: int, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 13
) -> Whitening | None:
    """Leading components of ``rows`` (see ``sound_vectors``); None if no row or no spread.

    Passes go on while the residuals' fall promises double precision within ``passes``; else the full dimension is taken.
    On the driver there are matrices of dimension x width, and of dimension x dimension after expanding: bounded
    by the dimension, never by the rows.
    """
    moments = fit_moments(rows, dim) if dim else Moments(0, ())
    if not moments.n:
        return None
    trace = float(_sums(rows, dim, lambda x: np.array([(moments.centred(x) ** 2).sum()]), 1)[0]) / moments.n
    if not trace > 0:
        return None
    wanted, width = min(components, dim), min(dim, components + oversampling)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))[0]
    exact, before, expanded = width == dim, None, False
    for k in range(passes + 1):
        product = _product(rows, moments, basis)
        values, vectors, residuals = _rayleigh_ritz(basis, product)
        left = residuals[:wanted].max() / max(values[0], np.finfo(float).tiny)
        enough = dim * np.finfo(float).eps
        if exact or left <= enough:
            break
        fall = left / before if before else 0.0
        if k == passes or (k > 1 and (fall >= 1 or left * fall ** (passes - k) > enough)):
            basis, exact, expanded = np.eye(dim), True, True
            values, vectors, residuals = _rayleigh_ritz(basis, _product(rows, moments, basis))
            break
        before = left
        basis = np.linalg.qr(product)[0]
    kept = int((values[:wanted] > NEGLIGIBLE * values[0]).sum())
    return Whitening(moments, np.ascontiguousarray(vectors[:, :kept]), values[:kept].copy(), trace, expanded)


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from one pass over all rows."""
    dim, width = fitted.axes.shape

    def one(x: np.ndarray) -> np.ndarray:
        w = fitted.apply(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])

    flat = _sums(rows, dim, one, width + width * width) / fitted.moments.n
    mean = flat[:width]
    return float(np.abs(flat[width:].reshape(width, width) - np.outer(mean, mean) - np.eye(width)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: see SCHEMA.

    Rows without a sound vector, or of another length than most, are dropped (see ``sound_vectors``); ids may be null or
    repeated, equal rows count each. A table without spread (none, one or only equal vectors) has no
    component and gives no row; a component whose eigenvalue is numerically zero gives none either. ``deviation`` is null
    where it doesn't fit in a long.
    """
    rows, dim = sound_vectors(df, id_col, vec_col)
    fitted = fit_whitening(rows, dim, components)
    if fitted is None:
        return df.sparkSession.createDataFrame([], SCHEMA)
    error, n = identity_error(rows, fitted), fitted.moments.n
    width = len(fitted.eigenvalues)
    explained = fitted.eigenvalues / fitted.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(matrix(batch.column(1), dim))
            at = np.repeat(np.arange(len(x)), width)
            columns = [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), n, dtype=np.int64)),
                pa.array(fitted.moments.deviations(x), pa.int64()).take(pa.array(at)),
                pa.array(fitted.apply(x).reshape(-1)),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(at), error)),
            ]
            yield pa.record_batch(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows.select("id", "v").mapInArrow(run, SCHEMA)
