"""Whitening directions of vectors from the singular values of their centred rows.

Components become whole numbers, so sums are exact and the mean is known before anything is
multiplied.  Tasks centre their rows and reduce them, block after block, to one triangle by
QR; triangles are joined in rounds until one is left.  Its size is the dimension's, not the
rows', and it comes to the driver: Householder reflections make it bidiagonal, the dqds
recurrence gives the singular values with high relative accuracy, and twisted factorisations
at these values give the directions.  The covariance matrix itself is never formed.

Cases: a null vector, and one with null or non-finite entries, has no row; an empty vector
and a shorter one is filled with zeros; directions without variance, as far as rounding can
tell, are no components, so there may be fewer than asked for and none for one distinct
vector or an empty table; null and repeated ids are rows like others; entries beyond 2^52 on
the grid, and deviations beyond 64 bits, raise an ``OverflowError`` in the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.common import staged

GRID, SHIFT = 1024, 100_000
_BLOCK = 2048  # rows reduced at once
_JOINED = 32  # triangles joined by one task
_EPS = np.finfo(float).eps


# --- small dense work, of the dimension's size -------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor ``V``: ``r = U B V'`` by Householder
    reflections from the left and the right in turn."""
    a = r.astype(float).copy()
    n = a.shape[1]
    v = np.eye(n)
    for k in range(n):
        u = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            w = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection takes ``x`` to its first axis; zero if ``x`` is."""
    u = x.copy()
    norm = np.linalg.norm(u)
    if norm == 0:
        return u
    u[0] += math.copysign(norm, u[0])
    return u / np.linalg.norm(u)


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference transform with a shift; also its ``d``."""
    d, to_q, to_e, ds = q[0] - shift, [], [], [q[0] - shift]
    for i in range(len(q) - 1):
        top = d + e[i]
        ratio = q[i + 1] / top
        to_q.append(top)
        to_e.append(e[i] * ratio)
        d = d * ratio - shift
        ds.append(d)
    to_q.append(d)
    return to_q, to_e, ds


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The squared singular values of an upper bidiagonal matrix, largest first.

    A pass without shift gives the diagonal of the inverse, hence a lower bound of the least
    value (one over the trace): shifts by it keep all quantities positive, which is what the
    relative accuracy rests on."""
    scale = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(upper).max(initial=0)))
    if scale == 0:
        return np.zeros(len(diagonal))
    least = (scale * 1e-20) ** 2  # zeros on the diagonal become negligible numbers
    todo = [([max(float(a) ** 2, least) for a in diagonal], [float(b) ** 2 for b in upper], 0.0)]
    found = []
    while todo:
        q, e, moved = todo.pop()
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _EPS**2 * (q[i] + q[i + 1] + moved) or e[i] <= _EPS**2 * q[i + 1]), None)
            if cut is not None:
                if cut == len(e) - 1:  # the last value stands alone
                    found.append(q.pop() + moved)
                    e.pop()
                    continue
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                found.append(q.pop() + moved)
                break
            q, e, ds = _step(q, e, 0.0)
            bound = 1 / sum(1 / d for d in ds) if min(ds) > 0 else 0.0
            for part in (0.999999, 0.9):
                to_q, to_e, ds = _step(q, e, part * bound)
                if min(ds) > 0:
                    q, e, moved = to_q, to_e, moved + part * bound
                    break
    return np.array(sorted(found, reverse=True))


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> tuple[np.ndarray, list[int], callable]:
    """The residuals of all twisted factorisations of ``B'B - value``, the places of the
    smallest ones, and a function from place to eigenvector."""
    n = len(diagonal)
    tiny = np.finfo(float).tiny / _EPS
    d = np.maximum(diagonal**2, tiny)
    l = np.divide(upper, np.where(diagonal[:-1] == 0, math.sqrt(tiny), diagonal[:-1]))
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):  # stationary, from the top
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = d[i] * l[i] / pivot
        s[i + 1] = down[i] * l[i] * s[i] - value
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):  # progressive, from the bottom
        p[i + 1] = p[i + 1] or tiny  # a part of its own may end here
        pivot = d[i] * l[i] * l[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        ratio = d[i] / pivot
        up[i] = l[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = s + value + p

    def vector(k: int) -> np.ndarray:
        z = np.zeros(n)
        z[k] = 1
        for i in range(k - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -up[i] * z[i]
        z /= np.abs(z).max()  # a breakdown makes huge entries
        return z / np.linalg.norm(z)

    return gamma, list(np.argsort(np.abs(gamma), kind="stable")), vector


def _product(diagonal: np.ndarray, upper: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``B'B z``."""
    y = diagonal * z
    y[:-1] += upper * z[1:]
    out = diagonal * y
    out[1:] += upper * y[:-1]
    return out


def directions(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of ``B'B`` as columns.  Where values are close, another place of the
    twist is taken if a vector repeats earlier ones or is none, and the rest is made
    orthogonal."""
    out = np.zeros((len(diagonal), len(values)))
    for j, value in enumerate(values):
        near = [i for i in range(j) if values[i] - value <= 1e-3 * values[i]]
        if len(diagonal) == 1:
            out[0, j] = 1
            continue
        _, places, vector = twisted(diagonal, upper, value)
        best = None
        for k in places:
            z = vector(k)
            for _ in range(2):
                z = z - out[:, near] @ (out[:, near].T @ z)
            norm = float(np.linalg.norm(z))
            if norm > 0.5 and np.abs(_product(diagonal, upper, z) - value * z).max() <= 1e-10 * values[0]:
                best = z / norm
                break
        if best is None:  # no twist gives a new direction: inverse iteration beside the earlier ones
            b = np.diag(diagonal) + np.diag(upper, 1)
            shifted = b.T @ b - (value + 64 * _EPS * values[0]) * np.eye(len(diagonal))
            best = np.cos(np.arange(len(diagonal)) + 1.0)
            for _ in range(4):
                best = best - out[:, near] @ (out[:, near].T @ best)
                best = np.linalg.solve(shifted, best / np.linalg.norm(best))
        for _ in range(2):
            best = best - out[:, near] @ (out[:, near].T @ best)
            best /= np.linalg.norm(best)
        out[:, j] = best
    return out


# --- the work on rows --------------------------------------------------------------------


def _on_grid(values: pa.Array) -> np.ndarray | None:
    if values.null_count:
        return None
    x = values.to_numpy(zero_copy_only=False).astype(float)
    if not np.isfinite(x).all():
        return None
    x = np.floor(GRID * x)
    if np.abs(x).max(initial=0) > 1 << 52:
        raise OverflowError("an entry lies beyond 2^52 on the grid")
    return x.astype(np.int64) + SHIFT


def gridded(df: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of the vectors that take part, ``x`` as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_on_grid(v.values) if v.is_valid else None for v in batch.column("e")]
            keep = pa.array([x is not None for x in found])
            blobs = pa.array([x.astype("<i8").tobytes() for x in found if x is not None], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(keep), blobs], names=["vec_id", "x"])

    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(
        run, "vec_id long, x binary"
    )


def _rows(blobs: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled with zeros on the grid."""
    out = np.full((len(blobs), width), SHIFT, dtype=np.int64)
    for row, blob in zip(out, blobs, strict=True):
        v = np.frombuffer(blob.as_py(), dtype="<i8")
        row[: len(v)] = v
    return out


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen, total = 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for blob in batch.column("x"):
                v = np.frombuffer(blob.as_py(), dtype="<i8")
                if len(v) > len(total):
                    more = len(v) - len(total)
                    seen, total = np.pad(seen, (0, more)), np.pad(total, (0, more))
                seen[: len(v)] += 1
                total[: len(v)] += v
                n += 1
        dims = np.arange(-1, len(total))
        columns = [dims, np.append(n, seen), np.append(0, total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["dim", "n", "total"])

    found = vectors.mapInArrow(run, "dim long, n long, total long").groupBy("dim").agg(F.sum("n"), F.sum("total"))
    rows = sorted(found.collect())  # one for each dimension
    n = rows[0][1] if rows else 0
    return n, [total + (n - seen) * SHIFT for _, seen, total in rows[1:]]


def _triangle(vectors: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The triangle of the QR factorisation of all centred rows."""
    width = len(mean)

    def reduced(parts: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(parts), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                r = reduced([r, _rows(batch.column("x").slice(at, _BLOCK), width) - mean])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes()])], names=["r"])

    def join(key, table):
        blobs = sorted(table.column("r").to_pylist())  # in an order that does not hang on arrival
        r = reduced([np.frombuffer(b, dtype="<f8").reshape(-1, width) for b in blobs])
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "r": [r.astype("<f8").tobytes()]})

    parts = staged(vectors.mapInArrow(run, "r binary").select(F.spark_partition_id().cast("long").alias("k"), "r"), "triangles")
    while parts.select("k").limit(2).count() > 1:
        joined = parts.select(F.floor(F.col("k") / _JOINED).cast("long").alias("k"), "r").groupBy("k").applyInArrow(join, "k long, r binary")
        parts = staged(joined, "triangles")
    row = parts.first()
    return np.frombuffer(row["r"], dtype="<f8").reshape(-1, width)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    axes: np.ndarray  # dimensions x components, each divided by its standard deviation
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sums of ``(n x - S)^2``, exact."""
        top = max((abs(self.n * v - s) for column, s in zip(x.T, self.sums, strict=True) for v in (int(column.min()), int(column.max()))), default=0)
        if top * top * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        out = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        if max(out) >= 1 << 63:
            raise OverflowError("a deviation needs more than 64 bits")
        return out


def fit(vectors: DataFrame, components: int = 8) -> Whitening:
    """Learn from all rows of ``gridded`` vectors."""
    n, sums = _sums(vectors)
    if not n or not sums:
        return Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0))
    r = _triangle(vectors, np.array([s / n for s in sums]))
    diagonal, upper, right = bidiagonal(np.pad(r, ((0, max(0, len(sums) - len(r))), (0, 0))))
    values = dqds(diagonal, upper)  # n times the variances
    # What rounding leaves of directions without variance: entries are known to one part in 2^53.
    noise = n * len(sums) * (4 * _EPS * (float(np.abs(np.array(sums, dtype=float) / n).max()) + math.sqrt(values[0] / n))) ** 2
    kept = values[:components][values[:components] > noise]
    axes = right @ directions(diagonal, upper, kept)
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(kept))]) if len(kept) else np.zeros(0)
    return Whitening(n, sums, axes * signs / np.sqrt(kept / n), kept / values.sum())


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry, without sign, of the whitened rows' covariance less the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    k = model.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = model.apply(_rows(batch.column("x"), len(model.sums)))
            w = np.pad(w, ((0, 0), (0, 1)), constant_values=1)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) ** 2), pa.int64()), pa.array(total.ravel())], names=["cell", "v"])

    rows = vectors.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v")).collect()  # 81 numbers
    total = np.zeros((k + 1) ** 2)
    for cell, v in rows:
        total[cell] = v
    total = total.reshape(k + 1, k + 1) / model.n
    mean = total[:k, k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(df: DataFrame, components: int = 8) -> DataFrame:
    """One row for each vector and component: ``vec_id, component, n, deviation, whitened,
    explained, identity_error``."""
    vectors = staged(gridded(df), "gridded")
    model = fit(vectors, components)
    k = model.axes.shape[1]
    error = identity_error(vectors, model) if k else 0.0
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in (batch.slice(at, _BLOCK) for at in range(0, batch.num_rows if k else 0, _BLOCK)):
                x = _rows(part.column("x"), len(model.sums))
                m = len(x)
                columns = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.repeat(np.int64(model.n), m * k)),
                    pa.array(np.repeat(np.array(model.deviations(x), dtype=np.int64), k)),
                    pa.array(model.apply(x).ravel()),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(np.repeat(error, m * k)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return vectors.mapInArrow(run, _SCHEMA)


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]
