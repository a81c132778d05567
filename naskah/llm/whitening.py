"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries become integers, x = floor(1024 * c) + 100000, so sums and the scatter around an integer
centre are exact whatever the partitions. Executors add them up per entry; the driver gets one
number per pair of dimensions (the size of a model, not of the data), divides once, factors the
scatter as L * L' with the largest remaining diagonal entry as pivot, and rotates pairs of columns
of L until all are orthogonal. As L * L' never changes, the squared column norms are then its
eigenvalues and the normalised columns its eigenvectors; the scatter itself is never squared or
iterated on. A second pass over the vectors measures the covariance of the whitened values.

Defined results: vectors that are null or hold null or non-finite entries are left out, entries of
2^40 or more in size counting as non-finite. Vectors of different lengths are different tables,
each with its own n, centre and components. Directions whose eigenvalue is not above rounding
error (constant dimensions, a single vector, empty vectors) give no component, so such rows have
fewer than eight or none. Repeated rows and null keys are vectors like any other; other columns
are ignored; an empty table gives no rows. Components of equal eigenvalues are one of many
possible bases, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
LARGEST = 2.0**40
BLOCK_ENTRIES = 1 << 20
SWEEPS = 60
_EPS = np.finfo(float).eps
_EXACT = 2**53  # doubles hold integers up to here
_LONG = 2**62
_DECIMAL = pa.decimal128(38, 0)


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) of the usable vectors of a list column, in blocks of one length."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    base, starts, ends = offsets[0], offsets[:-1], offsets[1:]
    inner = column.values.slice(base, offsets[-1] - base)
    numbers = inner.cast(pa.float64()).to_numpy(zero_copy_only=False)
    usable = np.zeros(len(numbers), bool)
    np.less(np.abs(numbers), LARGEST, out=usable, where=np.isfinite(numbers))
    bad = np.concatenate([[0], np.cumsum(~usable)])
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends - base] == bad[starts - base])
    lengths = ends - starts
    for length in np.unique(lengths[whole]):
        rows = np.flatnonzero(whole & (lengths == length))
        step = max(1, BLOCK_ENTRIES // max(int(length), 1))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            c = numbers[(starts[part] - base)[:, None] + np.arange(length)]
            yield part, np.floor(SCALE * c).astype(np.int64) + SHIFT


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums as Python integers."""
    safe = _largest(x) * max(len(x), 1) < _LONG
    return (x.sum(axis=0) if safe else x.astype(object).sum(axis=0)).astype(object)


def scatter(z: np.ndarray) -> np.ndarray:
    """Exact z' * z as Python integers; matrix products of doubles where their sums are integers below 2^53."""
    square = _largest(z) ** 2
    out = np.zeros((z.shape[1], z.shape[1]), object)
    step = _EXACT // max(square, 1)
    if not step:
        z = z.astype(object)
        return z.T @ z if len(z) else out
    for at in range(0, len(z), step):
        part = z[at : at + step].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower trapezoidal L, order): ``a[order][:, order]`` = L * L' up to pivots below rounding error."""
    d = len(a)
    order, left, l = np.arange(d), a.diagonal().copy(), np.zeros((d, d))
    limit = d * _EPS * left.max(initial=0)
    for k in range(d):
        j = k + int(np.argmax(left[order[k:]]))
        order[[k, j]] = order[[j, k]]
        pivot, rest = order[k], order[k + 1 :]
        if left[pivot] <= limit:
            return l[order][:, :k], order
        l[pivot, k] = np.sqrt(left[pivot])
        l[rest, k] = (a[rest, pivot] - l[rest, :k] @ l[pivot, :k]) / l[pivot, k]
        left[rest] -= l[rest, k] ** 2
    return l[order], order


def one_sided_jacobi(l: np.ndarray) -> np.ndarray:
    """``l`` times rotations, with orthogonal columns. A round of a sweep turns disjoint pairs at once."""
    g, r = l.copy(), l.shape[1]
    m = r + r % 2
    goal = _EPS * max(len(l), 8)
    for _ in range(SWEEPS if r > 1 else 0):
        worst, seats = 0.0, np.arange(m)
        for _ in range(m - 1):
            i, j = seats[: m // 2], seats[: m // 2 - 1 : -1]
            real = (i < r) & (j < r)
            i, j = i[real], j[real]
            x, y = g[:, i], g[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            skew = np.abs(xy) / np.sqrt(xx * yy)
            worst = max(worst, skew.max(initial=0))
            turn = skew > _EPS
            i, j, x, y = i[turn], j[turn], x[:, turn], y[:, turn]
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            tan = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, tan)
            g[:, i], g[:, j] = cos * x - cos * tan * y, cos * tan * x + cos * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= goal:
            break
    return g


class Model(NamedTuple):
    n: int
    centre: np.ndarray  # integers at most one below the mean
    rest: np.ndarray  # n * (mean - centre), integers
    eigenvalues: np.ndarray  # of the covariance, falling
    components: np.ndarray  # columns
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre).astype(float) - (self.rest / self.n).astype(float)
        return z @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        z, n = x - self.centre, self.n
        rest = self.rest.astype(np.int64)
        d, top = max(x.shape[1], 1), _largest(z)
        if d * max((n * top) ** 2, n * n) < _LONG // 4:
            return ((n * z - rest) ** 2).sum(axis=1).tolist()
        z = z.astype(object)
        return ((n * z - rest.astype(object)) ** 2).sum(axis=1).tolist() if x.shape[1] else [0] * len(x)


def solve(n: int, sums: list[int], around: np.ndarray, components: int = COMPONENTS) -> Model:
    """The model from n, the sums and the exact scatter around floor(sums / n)."""
    centre = np.array([s // n for s in sums], object)
    rest = np.array(sums, object) - n * centre
    exact = n * around - np.outer(rest, rest) if len(sums) else np.zeros((0, 0), object)
    a = np.array([[v / n for v in row] for row in exact], float).reshape(len(sums), len(sums))
    l, order = pivoted_cholesky(a)
    g = one_sided_jacobi(l)
    squares = (g * g).sum(axis=0)
    best = np.argsort(-squares, kind="stable")[:components]
    best = best[squares[best] > len(sums) * _EPS * squares.max(initial=0)]
    unit = np.empty((len(sums), len(best)))
    unit[order] = g[:, best] / np.sqrt(squares[best])
    return Model(n, centre.astype(np.int64), rest, squares[best] / n, unit, float(np.trace(a)) / n)


def _partial(frame: DataFrame, take) -> DataFrame:
    """Exact sums over all vectors of the (length, i, j, value) entries that ``take`` makes of each block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                d = x.shape[1]
                sums[d] = sums.get(d, 0) + take(d, x)
                counts[d] = counts.get(d, 0) + len(x)
        for d, total in sums.items():
            i, j = (k.ravel() for k in np.indices(total.shape))
            upper = i <= j if total.shape[0] > 1 else np.ones(len(i), bool)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(int(upper.sum()) + 1, d)), pa.array([*i[upper], -1]), pa.array([*j[upper], -1]),
                pa.array([*map(Decimal, total.ravel()[upper].tolist()), Decimal(counts[d])], _DECIMAL),
            ], ["d", "i", "j", "v"])

    out = frame.mapInArrow(add, "d long, i long, j long, v decimal(38,0)")
    return out.groupBy("d", "i", "j").agg(F.sum("v").alias("v"))


def _matrices(partial: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Per length: number of vectors, and the symmetric matrix (or the one row) of sums."""
    found: dict[int, dict] = {}
    for r in partial.collect():
        found.setdefault(r["d"], {})[r["i"], r["j"]] = int(r["v"])
    out = {}
    for d, entries in found.items():
        n = entries.pop((-1, -1))
        size = 1 + max((i for i, _ in entries), default=0)
        m = np.zeros((size, d), object)
        for (i, j), v in entries.items():
            m[i, j] = v
            if size > 1:
                m[j, i] = v
        out[d] = n, m
    return out


def fit(frame: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model per length of the vectors in the only column of ``frame``."""
    sums = _matrices(_partial(frame, lambda d, x: column_sums(x)[None, :]))
    centres = {d: np.array([s // n for s in m[0]], np.int64) for d, (n, m) in sums.items()}
    around = _matrices(_partial(frame, lambda d, x: scatter(x - centres[d])))
    return {d: solve(n, list(m[0]), around[d][1], components) for d, (n, m) in sums.items()}


def identity_errors(frame: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Per length the largest entry of the whitened vectors' covariance minus the identity."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                y = models[x.shape[1]].project(x)
                y = np.column_stack([np.ones(len(y)), y])  # the first row of the products holds the sums
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + y.T @ y
        for d, total in sums.items():
            i, j = (k.ravel() for k in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(total.ravel())], ["d", "i", "j", "v"])

    errors = {}
    rows = frame.mapInArrow(add, "d long, i long, j long, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect()
    for d, model in models.items():
        k = len(model.eigenvalues)
        m = np.zeros((k + 1, k + 1))
        for r in rows:
            if r["d"] == d:
                m[r["i"], r["j"]] = r["v"] / model.n
        errors[d] = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max(initial=0))
    return errors


def whiten(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, ``component``, ``n``, ``deviation_exact``
    (decimal), ``whitened``, ``explained``, ``identity_error``."""
    only = frame.select(vector)
    models = fit(only, components)
    errors = identity_errors(only, models)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in vectors(batch.column(1)):
                model = models[x.shape[1]]
                k, size = len(model.eigenvalues), len(rows)
                if not k:
                    continue
                each = pa.array(np.repeat(np.arange(size), k))
                # beyond 38 digits there is no exact column type
                exact = [Decimal(v) if v < 10**38 else None for v in model.deviations(x)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, model.n)),
                    pa.array(exact, _DECIMAL).take(each),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(model.eigenvalues / model.trace, size)),
                    pa.array(np.full(size * k, errors[x.shape[1]])),
                ], names)

    names = [key, "component", "n", "deviation_exact", "whitened", "explained", "identity_error"]
    kind = frame.schema[key].dataType.simpleString()
    return frame.select(key, vector).mapInArrow(
        apply, f"`{key}` {kind}, component int, n long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"
    )


def whitened(frame: DataFrame) -> DataFrame:
    """``whiten`` with the deviation as a long (null beyond its range)."""
    deviation = F.expr("try_cast(deviation_exact AS BIGINT)").alias("deviation")
    return whiten(frame).select("vec_id", "component", "n", deviation, "whitened", "explained", "identity_error")
