"""Linear algebra over rows of features, one pass a step: logistic regressions of all splits at once, truncated SVD.

Features are Spark's vectors, or structs like theirs (size, indices, values; dense without indices), or arrays. A pass
sums small matrices: each task adds up its rows in numpy and sends one blob, blobs are added up in a tree, so that
neither the driver nor a task sees more than a few of them at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Up to this dimension steps are Newton's, beyond it those of L-BFGS, with so many pairs kept.
NEWTON_DIM, PAIRS = 300, 10
#: Up to this dimension a truncated SVD takes the whole space at once.
WHOLE_DIM = 512
#: Numbers of sparse rows that are made dense at once.
DENSE_CELLS = 2_000_000


def feature_struct(df: DataFrame, features_col: str) -> Column:
    """Features as a struct (size, indices, values)."""
    kind, col = df.schema[features_col].dataType, F.col(features_col)
    if isinstance(kind, VectorUDT):
        col = F.unwrap_udt(col)
    elif isinstance(kind, ArrayType):
        return F.struct(F.size(col).alias("size"), F.lit(None).cast("array<int>").alias("indices"), col.cast("array<double>").alias("values"))
    return F.struct(*[col[name].alias(name) for name in ("size", "indices", "values")])


class Rows:
    """A batch of features: products with matrices on either side, sparse unless every row is dense."""

    def __init__(self, features: pa.StructArray, dim: int):
        indices, values = features.field("indices"), features.field("values")
        self.n, self.dim = len(features), dim
        flat = values.flatten().to_numpy(zero_copy_only=False)
        self.dense = flat.reshape(self.n, dim) if indices.null_count == self.n else None
        if self.dense is None:
            lengths = np.array(values.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            self.row, self.values = np.repeat(np.arange(self.n), lengths), flat
            at = indices.to_pylist() if indices.null_count else None
            self.at = np.concatenate([np.arange(dim) if a is None else np.array(a, dtype=np.int64) for a in at]) if at else indices.flatten().to_numpy()

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """rows x columns of ``matrix`` (dim x columns)."""
        if self.dense is not None:
            return self.dense @ matrix
        return np.stack([np.bincount(self.row, self.values * c[self.at], self.n) for c in matrix.T], axis=1)

    def back(self, matrix: np.ndarray) -> np.ndarray:
        """dim x columns: the transposed rows times ``matrix`` (rows x columns)."""
        if self.dense is not None:
            return self.dense.T @ matrix
        return np.stack([np.bincount(self.at, self.values * c[self.row], self.dim) for c in matrix.T], axis=1)

    def squared(self) -> np.ndarray:
        """dim x dim: the transposed rows times the rows, of which a few at a time are made dense."""
        if self.dense is not None:
            return self.dense.T @ self.dense
        out, step = np.zeros((self.dim, self.dim)), max(1, DENSE_CELLS // max(self.dim, 1))
        for first in range(0, self.n, step):
            part = slice(*np.searchsorted(self.row, (first, first + step)))
            rows = np.zeros((min(step, self.n - first), self.dim))
            rows[self.row[part] - first, self.at[part]] = self.values[part]
            out += rows.T @ rows
        return out


def tree_sum(df: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``partial`` (flat, of ``size`` numbers) over all batches of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = df.mapInArrow(run, "part binary").rdd.map(lambda r: np.frombuffer(r["part"]))
    return parts.treeAggregate(np.zeros(size), np.add, np.add)


def dimension(df: DataFrame, features_col: str) -> int:
    first = df.select(feature_struct(df, features_col)["size"].alias("d"), feature_struct(df, features_col)["values"].alias("v")).first()
    return 0 if first is None else first["d"] if first["d"] is not None else len(first["v"])


# ---------------------------------------------------------------- logistic regression

Ask = Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray | None], np.ndarray]


def _newton(start: np.ndarray, ridge: np.ndarray, tolerance: float, most: int) -> Ask:
    """Yields points, is sent (loss, gradient, Hessian) there, returns the minimum; halves steps that don't descend."""
    at = start
    loss, slope, bend = yield at
    for _ in range(most):
        if np.linalg.norm(slope) <= tolerance:
            break
        step = -np.linalg.solve(bend + 1e-12 * np.eye(len(at)), slope)
        for halvings in range(40):
            there = at + step * 0.5**halvings
            found = yield there
            if found[0] <= loss + 1e-4 * 0.5**halvings * (slope @ step) or np.linalg.norm(found[1]) <= tolerance:
                break
        else:
            break  # no descent left within the precision of the loss
        at, (loss, slope, bend) = there, found
    return at


def _lbfgs(start: np.ndarray, ridge: np.ndarray, tolerance: float, most: int) -> Ask:
    """The same without a Hessian, from the last steps' changes of the gradient."""
    at, pairs = start, []
    loss, slope, _ = yield at
    for _ in range(most):
        if np.linalg.norm(slope) <= tolerance:
            break
        step, kept = -slope, []
        for s, y in reversed(pairs):
            kept.append((s @ step) / (s @ y))
            step = step - kept[-1] * y
        step = step * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else step / max(1.0, float(np.linalg.norm(step)))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            step = step + (a - (y @ step) / (s @ y)) * s
        down, size = float(slope @ step), 1.0
        for _ in range(40):
            there = at + size * step
            found = yield there
            if found[0] <= loss + 1e-4 * size * down or np.linalg.norm(found[1]) <= tolerance:
                break
            size *= min(0.5, max(0.1, -down * size / (2 * (found[0] - loss - down * size) + 1e-300)))
        else:
            break
        s, y = there - at, found[1] - slope
        if s @ y > 1e-14 * (y @ y):
            pairs = [*pairs[-PAIRS + 1 :], (s, y)]
        at, (loss, slope, _) = there, found
    return at


def fit_splits(rows: DataFrame, splits: int, *, c: float = 1.0, max_iter: int = 1000, features_col: str = "features", label_col: str = "y", weights_col: str = "weights") -> np.ndarray:
    """Weights of ridge-penalised logistic regressions, a row (coefficients, intercept) for each split.

    ``weights_col`` is an array with the row's weight in each split's loss: 0 where it isn't trained on. All splits are
    asked for at once: a pass over the rows gives every split's loss and gradient (and Hessian, in few dimensions) at
    its own point. The loss is summed over weighted rows times ``c``, plus half the squared coefficients. A split
    with rows of one label only always says that label: its intercept is infinite.
    """
    dim = dimension(rows, features_col)
    slim = rows.select(feature_struct(rows, features_col).alias("x"), F.col(label_col).cast("double").alias("y"), F.col(weights_col).cast("array<double>").alias("w"))
    width, newton = dim + 1, dim <= NEWTON_DIM
    labels = tree_sum(slim, lambda b: np.concatenate([_weights(b, splits).T @ _labels(b), _weights(b, splits).T @ (1 - _labels(b))]), 2 * splits)
    ones, zeros = labels[:splits], labels[splits:]
    out = np.zeros((splits, width))
    out[:, -1] = np.where(zeros > 0, np.where(ones > 0, 0.0, -np.inf), np.where(ones > 0, np.inf, 0.0))
    ridge = np.append(np.full(dim, 1.0 / c), 0.0)
    solver = _newton if newton else _lbfgs
    asking = {k: solver(np.zeros(width), ridge, 1e-7 / c, max_iter) for k in range(splits) if ones[k] > 0 and zeros[k] > 0}
    points = {k: next(g) for k, g in asking.items()}
    while points:
        found = _evaluate(slim, splits, points, ridge, newton)
        for k, answer in found.items():
            try:
                points[k] = asking[k].send(answer)
            except StopIteration as end:
                out[k] = end.value
                del points[k]
    return out


def _weights(batch: pa.RecordBatch, splits: int) -> np.ndarray:
    return batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, splits)


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).to_numpy(zero_copy_only=False)


def _evaluate(slim: DataFrame, splits: int, points: dict[int, np.ndarray], ridge: np.ndarray, newton: bool) -> dict[int, tuple]:
    """(loss, gradient, Hessian or None) of each split at its point."""
    order, width = sorted(points), len(ridge)
    size = 1 + width + (width * width if newton else 0)
    sent = slim.sparkSession.sparkContext.broadcast(np.stack([points[k] for k in order], axis=1))

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        at = sent.value
        rows = Rows(batch.column(0), width - 1)
        y, w = _labels(batch)[:, None], _weights(batch, splits)[:, order]
        z = rows.times(at[:-1]) + at[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        loss = (w * (np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z))))).sum(axis=0)
        apart = w * (p - y)
        parts = [loss[None], rows.back(apart), apart.sum(axis=0)[None]]
        if newton:
            full = np.hstack([rows.dense if rows.dense is not None else rows.times(np.eye(width - 1)), np.ones((rows.n, 1))])
            parts.append(np.stack([(full.T @ (full * v[:, None])).reshape(-1) for v in (w * p * (1 - p)).T], axis=1))
        return np.concatenate(parts).T.reshape(-1)

    try:
        total = tree_sum(slim, partial, size * len(order)).reshape(len(order), size)
    finally:
        sent.unpersist()
    out = {}
    for k, row in zip(order, total, strict=True):
        at = points[k]
        bend = row[1 + width :].reshape(width, width) + np.diag(ridge) if newton else None
        out[k] = row[0] + 0.5 * float(ridge @ (at * at)), row[1 : 1 + width] + ridge * at, bend
    return out


def predict_splits(rows: DataFrame, weights: np.ndarray, *, keys: Sequence[str], fold_col: str = "fold", features_col: str = "features", label_col: str = "y") -> DataFrame:
    """(keys, fold, y, yhat): each row by the regression of its own fold."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)
    slim = rows.select(*keys, F.col(fold_col).cast("int").alias("fold"), F.col(label_col).cast("int").alias("y"), feature_struct(rows, features_col).alias("x"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.num_columns - 1
            fold = batch.column(last - 2).to_numpy()
            z = Rows(batch.column(last), own.shape[1] - 1).times(own[:, :-1].T)[np.arange(batch.num_rows), fold] + own[fold, -1]
            names = [*batch.schema.names[:-1], "yhat"]
            yield pa.record_batch([*batch.columns[:-1], pa.array((z > 0).astype(np.int32))], names=names)

    return slim.mapInArrow(run, f"{kinds}, yhat int")


# ---------------------------------------------------------------- truncated SVD


def leading_directions(rows: DataFrame, features_col: str = "features", k: int = 2, *, oversampling: int = 10, passes: int = 7, seed: int = 0, whole: int = WHOLE_DIM) -> tuple[np.ndarray, np.ndarray]:
    """(directions dim x k, singular values) of the uncentred rows.

    A seeded range finder: a narrow random matrix is multiplied with the rows and their transpose, ``passes`` times, with
    an orthonormal basis in between; Rayleigh-Ritz in the last one. In few dimensions the basis is the whole space, and the
    result exact after one pass. A direction's largest loading is positive.
    """
    dim = dimension(rows, features_col)
    slim = rows.select(feature_struct(rows, features_col).alias("x"))
    if dim <= max(whole, k + oversampling):
        product = tree_sum(slim, lambda b: Rows(b.column(0), dim).squared().reshape(-1), dim * dim).reshape(dim, dim)
        values, turns = np.linalg.eigh(product)
        found, passes = turns[:, ::-1][:, :k], 0
    else:
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, k + oversampling)))[0]
    for _ in range(passes):
        sent = slim.sparkSession.sparkContext.broadcast(basis)
        product = tree_sum(slim, lambda b, sent=sent: (lambda r: r.back(r.times(sent.value)))(Rows(b.column(0), dim)).reshape(-1), basis.size).reshape(basis.shape)
        sent.unpersist()
        values, turns = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
        found = basis @ turns[:, ::-1][:, :k]
        basis = np.linalg.qr(product)[0]
    found = found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1.0, 1.0) if dim else found
    return found, np.sqrt(np.maximum(values[::-1][:k], 0))
