"""Embedding whitening (operator 11): pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

An entry c becomes the long x = floor(1024 * c) + 100000. Tasks add up exact integers (sums and products of the entries
less the constant, which no covariance sees); the sum of (n * x - S) (n * x - S)' over all rows is n times the integer
matrix n * P - S S', so centring costs no digit. A factor of this matrix, with the largest pivot first, goes through one-sided
Jacobi rotations as it is: no eigenvalue problem of the matrix itself is solved. The squared norms of the rotated columns
are the eigenvalues, the normalised columns the components, with the relative accuracy that the factor has.

A covariance of dim * dim numbers is all that comes to the driver, whatever the number of rows. The covariance of the
whitened values is measured on them: each task centres its own rows, and the parts are put together by their means.

Rows whose vector is null or holds null, NaN or infinite entries are dropped. Repeated rows and vec_ids count each as a row
of its own; a null vec_id stays null. A component without variance (equal vectors, fewer rows than components) is none: no
row is returned for it. An empty table, or one of equal vectors only, gives an empty result. Vectors of different lengths,
and entries from 2 ** 40 on, are an error. `deviation` is null where it does not fit a long. Other columns of rows are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import schema_of, tidy, written
from keelson.llm.vectors import floored, vectors

SCALE, MOST = 1024, 1 << 50
WHITE_SPARK, WHITE_ARROW = schema_of(vec_id="long", component="int", n="long", deviation="long", whitened="double", explained="double")


def products(z: np.ndarray) -> np.ndarray:
    """z' z in exact integers, as objects."""
    top = int(np.abs(z).max(initial=0))
    if len(z) * top * top < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    return z.T.astype(object) @ z.astype(object)


@tidy
def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, value, dim) of a task: the number of vectors, the sums, then the lower triangle of the products."""
    n, sums, prods = 0, None, None
    for _, z in floored(batches, SCALE, MOST):
        s, p = z.astype(object).sum(axis=0) if np.abs(z).max(initial=0) > 1 << 40 else z.sum(axis=0).astype(object), products(z)
        n, sums, prods = n + len(z), s if sums is None else sums + s, p if prods is None else prods + p
    if n:
        values = [n, *sums, *prods[np.tril_indices(len(sums))]]
        numbers = pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), numbers, pa.array([len(sums)] * len(values), pa.int64())], names=["k", "value", "dim"])


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums and the matrix n * P - S S' of the integers of all whole vectors, exact; 0, [] and [] without any."""
    parts = vectors(rows).mapInArrow(_scatter, "k bigint, value decimal(38,0), dim bigint")
    found = parts.groupBy("k").agg(F.sum("value").cast("string").alias("value"), F.min("dim").alias("low"), F.max("dim").alias("high")).orderBy("k").collect()
    if not found:
        return 0, [], []
    low, high = min(r["low"] for r in found), max(r["high"] for r in found)
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} entries in one table")
    n, *values = (int(r["value"]) for r in found)
    sums, flat = values[:low], values[low:]
    matrix = [[0] * low for _ in range(low)]
    for k, (i, j) in enumerate(zip(*np.tril_indices(low))):
        matrix[i][j] = matrix[j][i] = n * flat[k] - sums[i] * sums[j]
    return n, sums, matrix


def pivoted_factor(matrix: list[list[int]]) -> np.ndarray:
    """L with L L' = matrix, a column for each pivot above rounding: the largest entry left on the diagonal comes first, so
    columns are in the order of their pivots and, with rows in that order too, L is lower triangular."""
    a = np.array(matrix, dtype=object).astype(np.longdouble)
    dim = len(a)
    left, columns = a.diagonal().copy(), []
    least = left * dim * np.finfo(np.longdouble).eps  # what rounding leaves of an entry
    for _ in range(dim):
        p = int(left.argmax())
        if left[p] <= 0:
            break
        column = a[:, p] - sum((c * c[p] for c in columns), np.zeros(dim, np.longdouble))
        column = column / np.sqrt(column[p])
        columns.append(column)
        left = left - column * column
        left[p] = 0
        left[left <= least] = 0
    return np.array(columns, np.longdouble).T.reshape(dim, len(columns))


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms of the columns, falling, and the columns normalised, after rotations that make all pairs orthogonal.

    A sweep goes through all pairs in rounds of pairs that have no column in common, each round at once."""
    a = factor.copy()
    r = a.shape[1]
    if not r:
        return np.zeros(0), np.zeros((len(a), 0))
    size = r + r % 2
    ring = list(range(size))
    tiny = np.finfo(np.longdouble).eps * 8
    for _ in range(sweeps):
        turned = False
        for _ in range(max(1, size - 1)):
            pairs = np.array([(ring[i], ring[size - 1 - i]) for i in range(size // 2) if max(ring[i], ring[size - 1 - i]) < r], int).reshape(-1, 2)
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not len(pairs):
                continue
            x, y = a[:, pairs[:, 0]], a[:, pairs[:, 1]]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            todo = np.abs(xy) > tiny * np.sqrt(xx * yy)
            if not todo.any():
                continue
            turned = True
            t = (yy - xx) / (2 * np.where(todo, xy, 1))
            t = np.where(t < 0, -1, 1) / (np.abs(t) + np.sqrt(1 + t * t))
            c = np.where(todo, 1 / np.sqrt(1 + t * t), 1)
            s = np.where(todo, c * t, 0)
            a[:, pairs[:, 0]], a[:, pairs[:, 1]] = c * x - s * y, s * x + c * y
        if not turned:
            break
    else:
        raise RuntimeError("rotations did not settle")
    squared = (a * a).sum(axis=0)
    order = np.argsort(-squared, kind="stable")
    return squared[order], a[:, order] / np.sqrt(squared[order])


class Whitening:
    """What `fit` learns: n, the sums of the entries less the constant, eigenvalues (of the covariance) and components."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, components: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.components, self.trace = n, sums, values, components, trace
        self.project = components / np.sqrt(values)

    def centred(self, z: np.ndarray) -> np.ndarray:
        """n * x - S of each row: longs where they fit, else objects."""
        top = max([int(np.abs(z).max(initial=0)) * self.n, *map(abs, self.sums)])
        if top < 1 << 61:
            return z * self.n - np.array(self.sums, np.int64)
        return z.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (self.centred(z).astype(np.float64) / self.n) @ self.project

    def deviations(self, z: np.ndarray) -> list[int | None]:
        """The sum of squares of each row's n * x - S; None if it is no long."""
        d = self.centred(z)
        top = int(np.abs(d).max(initial=0))
        if top * top * d.shape[1] >= 1 << 63:
            d = d.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def fit(rows: DataFrame, most: int = 8) -> Whitening | None:
    """The whitening of all whole vectors of rows (vec_id, embedding), with up to `most` components; None if there is none.

    The sign of a component is such that its largest entry is above zero."""
    n, sums, matrix = scatter(rows)
    if not n or not (trace := sum(matrix[i][i] for i in range(len(sums)))):
        return None
    values, components = jacobi(pivoted_factor(matrix))
    values, components = values[:most], components[:, :most]
    top = np.abs(components).argmax(axis=0)
    components = components * np.where(components[top, np.arange(len(values))] < 0, -1, 1)
    square = np.longdouble(n) * np.longdouble(n)
    return Whitening(n, sums, (values / square).astype(np.float64), components.astype(np.float64), float(np.longdouble(trace) / square))


class _Moments:
    """A task's whitened values: row k of -1 their number, of 0.. their means, then the products of what is left when the
    task's own means are taken away."""

    def __init__(self, how: Whitening):
        self.how = how

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, left = 0, 0.0, 0.0
        for _, z in floored(batches, SCALE, MOST, len(self.how.sums)):
            w = self.how.whitened(z)
            here, m = w.mean(axis=0), len(w)
            own = w - here
            off = here - mean
            left = left + own.T @ own + np.multiply.outer(off, off) * (n * m / (n + m))
            mean, n = mean + off * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([list(mean)], pa.list_(pa.float64())), pa.array([list(np.ravel(left))], pa.list_(pa.float64()))], names=["n", "mean", "left"])


def identity_error(rows: DataFrame, how: Whitening) -> float:
    """The largest absolute entry of the whitened values' covariance, centred before multiplying, minus the identity."""
    c = len(how.values)
    parts = written(vectors(rows).mapInArrow(_Moments(how), "n bigint, mean array<double>, left array<double>"), "white-moments")
    at = parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / how.n).alias("m")).collect()
    mean = F.array(*(F.lit(m) for _, m in sorted(map(tuple, at))))
    off = F.zip_with("mean", mean, lambda a, b: a - b)
    each = parts.select("n", off.alias("off"), F.posexplode("left").alias("k", "v"))
    total = each.groupBy("k").agg(F.sum(F.col("v") + F.col("n") * F.expr(f"off[k div {c}]") * F.expr(f"off[k % {c}]")).alias("v")).collect()
    covariance = np.array([v for _, v in sorted(map(tuple, total))]).reshape(c, c) / how.n
    return float(np.abs(covariance - np.eye(c)).max())


class _Whiten:
    def __init__(self, how: Whitening):
        self.how = how

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, c = self.how, len(self.how.values)
        for batch, z in floored(batches, SCALE, MOST, len(how.sums)):
            n = len(z)
            ids, deviation = batch.column(0).take(pa.array(np.repeat(np.arange(n), c))), pa.array(how.deviations(z), pa.int64())
            columns = [ids, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), n)), pa.array(np.full(n * c, how.n)), deviation.take(pa.array(np.repeat(np.arange(n), c))), pa.array(how.whitened(z).ravel()), pa.array(np.tile(how.values / how.trace, n))]
            yield pa.RecordBatch.from_arrays(columns, schema=WHITE_ARROW)


def whiten(rows: DataFrame, most: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each whole vector of rows
    (vec_id, embedding) and each of the first `most` components."""
    how = fit(rows, most)
    if how is None:
        return rows.sparkSession.createDataFrame([], f"{WHITE_SPARK}, identity_error double")
    error = identity_error(rows, how)
    return vectors(rows).mapInArrow(_Whiten(how), WHITE_SPARK).withColumn("identity_error", F.lit(error))
