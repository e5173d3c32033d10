"""Whitening of embeddings: compensated covariance and a divide-and-conquer eigen-solve.

The entries of a vector become whole numbers, whose sums are exact. Each task centres
its vectors by the exact mean, held as a double and its remainder, and adds up
their outer products in double-double: products and sums are taken with error-free
transformations (Dekker, Knuth), so each entry of the matrix is a high and a low part.
A task sends one row of the upper triangle a row of its own; these are merged high
and low in the order of the tasks. The matrix, of the size of a vector squared, is
made tridiagonal by reflections, torn into halves, solved by halves and put together
through the secular equation, with equal and decoupled entries set aside and weights
computed anew from the roots (Gu and Eisenstat), which keeps the eigenvectors orthogonal.

Edge cases: rows whose vector is null or empty, or holds null or non-finite entries or
entries of 2**42 or more in size (whose numbers aren't exact in doubles), take no part;
vectors of each length are whitened among themselves; a null id stays null; repeated rows
are vectors of their own; equal eigenvalues give any orthonormal basis of their space; a
component without variance has whitened 0 (so identity_error is 1 there); with fewer
dimensions than components there are as many as dimensions; a deviation that exceeds a
long is null; an empty table gives no rows. Only the two named columns are read, so
other columns may have any name. A task holds a batch of vectors and matrices of
their length squared, the driver one matrix a length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

COMPONENTS = 8
#: Number of an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
LARGEST = 2.0**42
#: Vectors that are multiplied at once.
STEP = 512
EPS = np.finfo(float).eps
Pair = tuple[np.ndarray, np.ndarray]
RESULT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- error-free transformations and double-double numbers (high, low)


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a: np.ndarray) -> Pair:
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    p = a * b
    (ah, al), (bh, bl) = split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def multiplied(a: Pair, b: Pair) -> Pair:
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def summed(a: Pair) -> Pair:
    """The sum over the last axis, by halves."""
    high, low = a
    while (n := high.shape[-1]) > 1:
        half = n // 2
        odd = (high[..., 2 * half :], low[..., 2 * half :])
        high, low = added((high[..., :half], low[..., :half]), (high[..., half : 2 * half], low[..., half : 2 * half]))
        if n % 2:
            high, low = np.concatenate([high, odd[0]], -1), np.concatenate([low, odd[1]], -1)
    return high[..., 0], low[..., 0]


def as_pair(numerator: int, denominator: int) -> tuple[float, float]:
    """A fraction of whole numbers as a double-double."""
    high = numerator / denominator
    a, b = high.as_integer_ratio()
    return high, (numerator * b - a * denominator) / (denominator * b)


# --- vectors of a batch


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, numbers int64) of the usable vectors of a list column, one pair a length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    bad = np.array(flat.is_null()) if flat.null_count else None
    values = np.array(flat.fill_null(np.nan) if flat.null_count else flat, np.float64)
    ends = np.cumsum(lengths)
    with np.errstate(invalid="ignore"):
        wrong = ~(np.abs(values) < LARGEST)
    if bad is not None:
        wrong |= bad
    usable = lengths > 0
    usable[np.searchsorted(ends, np.flatnonzero(wrong), side="right")] = False
    for size in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == size))
        for k in range(0, len(rows), STEP):
            part = rows[k : k + STEP]
            c = values[(ends[part] - size)[:, None] + np.arange(size)]
            yield part, np.floor(c * SCALE).astype(np.int64) + SHIFT


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python integers, for any numbers below 2**53."""
    high, low = x >> 26, x & ((1 << 26) - 1)
    return [(int(a) << 26) + int(b) for a, b in zip(high.sum(0), low.sum(0))]


@dataclass
class Sums:
    """Of all vectors of a length: their count and the exact sum of each dimension."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = [s % self.n for s in self.sums]
        self.mean = np.array([as_pair(r, self.n) for r in self.rest]).T

    def centred(self, x: np.ndarray) -> Pair:
        """x less the mean, as double-doubles."""
        high, low = two_sum((x - self.whole).astype(float), np.broadcast_to(-self.mean[0], x.shape))
        return two_sum(high, low - self.mean[1])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - sum) squared of each vector; null beyond a long."""
        away = x - self.whole
        most = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2**63:
            return ((away * self.n - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        out = [sum((int(a) * self.n - r) ** 2 for a, r in zip(row, self.rest)) for row in away]
        return [v if v < 2**63 else None for v in out]


def _numbers(df: DataFrame, vector: str, *others: str) -> DataFrame:
    return df.select(*others, F.col(vector).cast("array<double>").alias("vector"))


def fit_sums(df: DataFrame, vector: str) -> dict[int, Sums]:
    """Sums per length; a task sends one row a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for rows, x in vectors_of(batch.column(0)):
                n, sums = held.get(x.shape[1], (0, [0] * x.shape[1]))
                held[x.shape[1]] = n + len(rows), [a + b for a, b in zip(sums, exact_sums(x))]
        for size, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["size", "n", "sums"])

    parts = _numbers(df, vector).mapInArrow(run, "size int, n long, sums array<string>")
    by_dimension = parts.select("size", "n", F.posexplode("sums").alias("i", "s")).groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, dict[int, tuple[int, int]]] = {}
    for r in by_dimension.collect():  # a row a dimension
        out.setdefault(r["size"], {})[r["i"]] = (r["n"], int(r["s"]))
    return {size: Sums(rows[0][0], [rows[i][1] for i in range(size)]) for size, rows in out.items()}


def _merged(parts: DataFrame) -> DataFrame:
    """(size, row, high, low): the parts of each row of a matrix added up in the order of their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        held: Pair | None = None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([held[0]], pa.list_(pa.float64())), pa.array([held[1]], pa.list_(pa.float64()))], names=["size", "row", "high", "low"])
        for batch in batches:
            for size, row, high, low in zip(*(batch.column(c) for c in range(4))):
                now, part = (size.as_py(), row.as_py()), (np.array(high.values), np.array(low.values))
                if now == key:
                    held = added(held, part)
                else:
                    if key is not None:
                        yield done()
                    key, held = now, part
        if key is not None:
            yield done()

    dealt = parts.repartition("size", "row").sortWithinPartitions("size", "row", "task")
    return dealt.select("size", "row", "high", "low").mapInArrow(run, "size int, row int, high array<double>, low array<double>")


def _outer_sums(df: DataFrame, values) -> dict[int, Pair]:
    """Per length the double-double sums of outer products of the rows that values(batch) yields as (length, pair)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: dict[int, Pair] = {}
        for batch in batches:
            for size, y in values(batch):
                d = y[0].shape[1]
                if size not in held:
                    held[size] = np.zeros((d, d)), np.zeros((d, d))
                high, low = held[size]
                t = np.ascontiguousarray(y[0].T), np.ascontiguousarray(y[1].T)
                for i in range(d):
                    part = summed(multiplied((t[0][i], t[1][i]), (t[0][i:], t[1][i:])))
                    high[i, i:], low[i, i:] = added((high[i, i:], low[i, i:]), part)
        for size, (high, low) in held.items():
            for i in range(len(high)):
                arrays = [pa.array([size], pa.int32()), pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([high[i, i:]], pa.list_(pa.float64())), pa.array([low[i, i:]], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["size", "row", "task", "high", "low"])
        release_memory()

    rows = _merged(df.mapInArrow(run, "size int, row int, task int, high array<double>, low array<double>"))
    out: dict[int, dict[int, Pair]] = {}
    for r in rows.collect():  # a row a dimension
        out.setdefault(r["size"], {})[r["row"]] = (np.array(r["high"]), np.array(r["low"]))
    whole: dict[int, Pair] = {}
    for size, triangle in out.items():
        d = len(triangle)
        high, low = np.zeros((d, d)), np.zeros((d, d))
        for i, (a, b) in triangle.items():
            high[i, i:] = high[i:, i] = a
            low[i, i:] = low[i:, i] = b
        whole[size] = high, low
    return whole


def covariances(df: DataFrame, vector: str, fits: dict[int, Sums]) -> dict[int, Pair]:
    """Per length the covariance of its numbers, divisor n, as double-doubles."""

    def values(batch: pa.RecordBatch) -> Iterator[tuple[int, Pair]]:
        for _, x in vectors_of(batch.column(0)):
            yield x.shape[1], fits[x.shape[1]].centred(x)

    sums = _outer_sums(_numbers(df, vector), values)
    out = {}
    for size, (high, low) in sums.items():
        n = float(fits[size].n)
        q = high / n
        p, e = two_product(q, np.full_like(q, n))
        out[size] = two_sum(q, ((high - p) - e + low) / n)
    return out


# --- eigenvalues and eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q'; by Householder reflections."""
    a = np.array(a, float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        if scale == 0 or not np.abs(x[1:]).any():
            continue
        v = x / scale
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        beta = 2.0 / (v @ v)
        p = beta * (a[k + 1 :, k + 1 :] @ v)
        w = p - (0.5 * beta * (p @ v)) * v
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= (beta * (v @ x)) * v
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ v, beta * v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z**2 / (d - x)) for ascending d and rho > 0, each as a pole and an offset from it.

    Root i lies between d[i] and the next pole. The offset is found by bisection from the nearer pole, first of its
    exponent and then of its value, so it has full relative precision.
    """
    n = len(d)
    gap = np.append(d[1:] - d[:-1], rho * (z @ z))
    f = lambda base, mu: 1.0 + rho * (z**2 / ((d[None, :] - d[base][:, None]) - mu[:, None])).sum(1)
    at = np.arange(n)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        right = f(at, gap / 2) < 0
        right[-1] = False
        base, sign = np.where(right, at + 1, at), np.where(right, -1.0, 1.0)
        high = np.where(np.arange(n) == n - 1, gap, gap / 2) * (1 + 4 * EPS)
        low = high * 1e-60
        for _ in range(80):
            mid = np.where(high > 4 * low, np.sqrt(high) * np.sqrt(low), (high + low) / 2)
            beyond = f(base, sign * mid) * sign < 0  # the root lies further from the pole
            low, high = np.where(beyond, mid, low), np.where(beyond, high, mid)
            if (high - low <= EPS * low).all():
                break
    return base, sign * (low + high) / 2


def _joined(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors of q (diag(d) + rho z z') q'."""
    if rho < 0:
        values, vectors = _joined(-d, z, -rho, q)
        return -values[::-1], vectors[:, ::-1]
    order = np.argsort(d, kind="stable")
    d, z, q = d[order].copy(), z[order].copy(), q[:, order].copy()
    tolerance = 8 * EPS * max(np.abs(d).max(), rho * (z @ z))
    coupled, last = [], -1
    for j in range(len(d)):  # deflation: entries without weight, and of two equal ones the first is turned out
        if rho * abs(z[j]) * np.sqrt(z @ z) <= tolerance:
            z[j] = 0.0
            continue
        if last >= 0:
            r = np.hypot(z[last], z[j])
            c, s = z[j] / r, z[last] / r
            if abs((d[j] - d[last]) * c * s) <= tolerance:
                a, b = d[last], d[j]
                d[last], d[j] = a * c * c + b * s * s, a * s * s + b * c * c
                z[last], z[j] = 0.0, r
                q[:, last], q[:, j] = q[:, last] * c - q[:, j] * s, q[:, last] * s + q[:, j] * c
                coupled.pop()
        coupled.append(j)
        last = j
    values, vectors = d.copy(), q.copy()
    if coupled:
        part = np.array(coupled)
        part = part[np.argsort(d[part], kind="stable")]
        dk, zk = d[part], z[part]
        base, mu = secular_roots(dk, zk, rho)
        away = (dk[:, None] - dk[base][None, :]) - mu[None, :]  # pole less root
        # The weights for which these roots are exact.
        n = len(part)
        ratio = -away.copy()
        for k in range(n):
            below = np.arange(n) < k
            ratio[k] = np.where(np.arange(n) == k, -away[k], np.nan)
            ratio[k, below] = -away[k, below] / (dk[below] - dk[k])
            ratio[k, k + 1 :] = -away[k, k + 1 :] / (dk[k + 1 :] - dk[k])
        weight = np.sqrt(np.abs(np.prod(ratio, axis=1) / rho)) * np.where(zk < 0, -1.0, 1.0)
        u = weight[:, None] / away
        u /= np.sqrt((u * u).sum(0))
        values[part] = dk[base] + mu
        vectors[:, part] = q[:, part] @ u
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _halves(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and vectors of a tridiagonal matrix: tear, solve both halves, join."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    rho = e[m - 1]
    if rho == 0:
        (a, p), (b, r) = _halves(d[:m], e[: m - 1]), _halves(d[m:], e[m:])
        values, z = np.concatenate([a, b]), None
    else:
        upper, lower = d[:m].copy(), d[m:].copy()
        upper[-1] -= abs(rho)
        lower[0] -= abs(rho)
        (a, p), (b, r) = _halves(upper, e[: m - 1]), _halves(lower, e[m:])
        values, z = np.concatenate([a, b]), np.concatenate([p[-1], np.sign(rho) * r[0]])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = p, r
    if z is None:
        order = np.argsort(values, kind="stable")
        return values[order], q[:, order]
    return _joined(values, z, abs(rho), q)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = np.abs(a).max(initial=0.0)
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / scale)
    e[np.abs(e) <= EPS * (np.abs(d[:-1]) + np.abs(d[1:])) * 1e-3] = 0.0
    values, vectors = _halves(d, e)
    return values[::-1] * scale, (q @ vectors)[:, ::-1]


def refined(v: Pair, values: np.ndarray, vectors: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues and vectors after one step against their residuals, with the matrix and its products in double-double."""
    d, k = len(values), min(first, len(values))
    exact = lambda x: (x, np.zeros(x.shape))
    columns = exact(np.ascontiguousarray(vectors[:, :k].T))
    product = np.empty((k, d)), np.empty((k, d))
    for i in range(d):
        product[0][:, i], product[1][:, i] = summed(multiplied((v[0][i], v[1][i]), columns))
    value, norm = summed(multiplied(product, columns)), summed(multiplied(columns, columns))
    rayleigh = (value[0] + value[1]) / (norm[0] + norm[1])
    scaled = multiplied(columns, exact(np.repeat(rayleigh[:, None], d, 1)))
    residual = added(product, (-scaled[0], -scaled[1]))
    inner = (residual[0] + residual[1]) @ vectors  # of eigenvector j (row) along i
    gap = rayleigh[:, None] - values[None, :]
    far = np.abs(gap) > 1e-9 * max(np.abs(values).max(), np.finfo(float).tiny)
    step = np.where(far, inner, 0.0) / np.where(far, gap, 1.0)
    better = (columns[0] + step @ vectors.T).T
    better /= np.sqrt((better * better).sum(0))
    order = np.argsort(-rayleigh, kind="stable")
    return rayleigh[order], better[:, order]


# --- the operator


@dataclass
class Model:
    """Of a length: sums, components (columns), their eigenvalues and shares of the trace, and the error once measured."""

    sums: Sums
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.sums.centred(x)
        root = np.sqrt(np.where(self.values > 0, self.values, 1.0))
        return np.where(self.values > 0, (high @ self.components + low @ self.components) / root, 0.0)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """A model per length of vectors, each fitted on all its vectors; identity_error is measured on their whitened ones."""
    fits = fit_sums(df, vector)
    models: dict[int, Model] = {}
    for size, v in covariances(df, vector, fits).items():
        values, vectors = refined(v, *eigen(v[0]), components)
        trace = float(summed((np.diag(v[0])[None], np.diag(v[1])[None]))[0][0])
        top = values.copy()
        top[top <= size * EPS * max(top.max(initial=0.0), 0.0)] = 0.0
        models[size] = Model(fits[size], vectors, top, top / trace if trace > 0 else np.zeros(len(top)))

    def values_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Pair]]:
        for _, x in vectors_of(batch.column(0)):
            w = models[x.shape[1]].whitened(x)
            w = np.concatenate([np.ones((len(w), 1)), w], axis=1)  # the first row of the sums holds their means
            yield x.shape[1], (w, np.zeros_like(w))

    for size, (high, low) in (_outer_sums(_numbers(df, vector), values_of) if models else {}).items():
        n = models[size].sums.n
        mean = (high[0, 1:] + low[0, 1:]) / n
        v = (high[1:, 1:] + low[1:, 1:]) / n - np.outer(mean, mean)  # the mean is 0 but for rounding, so nothing cancels
        models[size].error = float(np.abs(v - np.eye(len(v))).max())
    return models


def transform(df: DataFrame, models: dict[int, Model], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """RESULT: a row per usable vector and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in vectors_of(batch.column(1)):
                m = models[x.shape[1]]
                k, n = len(m.values), len(rows)
                repeat = pa.array(np.repeat(rows, k))
                arrays = [
                    batch.column(0).take(repeat),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, m.sums.n, np.int64)),
                    pa.array(m.sums.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(m.whitened(x).ravel()),
                    pa.array(np.tile(m.explained, n)),
                    pa.array(np.full(n * k, m.error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        release_memory()

    return _numbers(df, vector, key).mapInArrow(run, RESULT.format(df.schema[key].dataType.simpleString()))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """transform() with models fitted on df itself."""
    return transform(df, fit(df, vector, components), key, vector)
