"""Whitening of embeddings from a covariance that is accumulated without rounding errors.

Entries become whole numbers ``floor(scale * c) + shift``, so counts and sums are exact. Vectors are centred on the mean as a
pair of doubles (high and low part). Outer products of a block of vectors are made error-free: the centred entries are
split into slices of 21 bits, so that every product of two slices, and its sum over 1024 vectors, is a double exactly; a
block's sums are then added to a pair of doubles by the two-sum transformation. A task returns its high and low parts, which
are merged by two-sums again. The covariance so found has an error far below one rounding of its own entries.

Its eigenvectors come from Householder's tridiagonal form and Cuppen's divide and conquer: the halves' eigenvalues are
joined by the roots of a secular equation, found beside their nearest pole, with close and unlinked ones deflated, and the
vectors are made of the weights that these roots belong to exactly, which keeps them orthogonal.

Scale: a pass returns one array of dimension x dimension twice a task, summed in a second layer before it reaches the driver; the
eigen-solve works on one such matrix. All of that depends on the dimension, not on the number of vectors. Vectors themselves
never leave their tasks and are not shuffled.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those that
haven't the table's most frequent length (of equally frequent ones the greater), as they lie in another space; entries count as
at most 2**40 after scaling; null and repeated ids are kept, each row by itself. A component without variance (eigenvalue below
dimension x 2**-52 of the greatest) has null ``whitened``; if no vector varies, ``explained`` and ``identity_error`` are null too;
a ``deviation`` beyond a long is null. An empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm.shared import table

BLOCK, BITS, SLICES = 1024, 21, 4  # 2 * BITS + log2(BLOCK) bits fit into a double
EPS = 2.0**-52


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def slices(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """The pair's leading bits, in slices of which each is a multiple of one power of two, at most 2**BITS of it."""
    most = np.abs(hi).max(initial=0)
    if most == 0:
        return []
    top, out = int(np.frexp(most)[1]), []
    for t in range(SLICES):
        sigma = 1.5 * 2.0 ** (52 + top - BITS * (t + 1))
        s = (hi + sigma) - sigma
        hi, lo = two_sum(hi - s, lo)
        out.append(s)
    return out


def add_outer(total: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> None:
    """Add a block's outer products to ``total``, its high and low parts."""
    parts = slices(hi, lo)
    for t in range(len(parts)):
        for u in range(t, len(parts) - t):
            product = parts[t].T @ parts[u]  # exact
            for p in (product,) if t == u else (product, product.T):
                total[0], error = two_sum(total[0], p)
                total[1] += error


def add_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s, error = two_sum(a[0], b[0])
    return np.array([s, a[1] + b[1] + error])


def centred(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` less the mean, both parts."""
    hi, lo = two_sum(x, -mean[0])
    return two_sum(hi, lo - mean[1])


def matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def reduced(rows: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], kind=np.float64) -> np.ndarray | None:
    """``of_batch`` of all batches of vectors ``x``, merged in tasks, then in a small second layer, then here."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = of_batch(matrix(b.column("x"), kind))
                total = part if total is None else merge(total, part)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"shape": [list(total.shape)], "data": [total.tobytes()]})

    def array(shape, data) -> np.ndarray:
        return np.frombuffer(data, kind).reshape(shape).copy()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for shape, data in zip(b.column("shape").to_pylist(), b.column("data"), strict=True):
                part = array(shape, data.as_buffer())
                total = part if total is None else merge(total, part)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"shape": [list(total.shape)], "data": [total.tobytes()]})

    kinds = "shape array<long>, data binary"
    total = None
    for r in rows.select("x").mapInArrow(parts, kinds).repartition(8).mapInArrow(merged, kinds).collect():
        part = array(r.shape, bytes(r.data))
        total = part if total is None else merge(total, part)
    return total


def covariance(rows: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """Covariance, with divisor n, of vectors ``x`` about a mean of two parts."""

    def of_batch(x: np.ndarray) -> np.ndarray:
        total = np.zeros((2, x.shape[1], x.shape[1]))
        for at in range(0, len(x), BLOCK):
            add_outer(total, *centred(x[at : at + BLOCK], mean))
        return total

    total = reduced(rows, of_batch, add_pairs)
    v = (total[0] + total[1]) / n
    return (v + v.T) / 2


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and the orthogonal Q with ``a = Q T Q'``, by Householder's reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not np.abs(v[1:]).max() > 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = 2 * (a[k + 1 :, k + 1 :] @ v)
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho sum z^2 / (d - x)`` for rising d, and the matrix of ``d_j - root_i``; bisected beside the nearest pole."""
    k = len(d)
    width = np.append(np.diff(d), rho * (z @ z))
    middle = 1 + rho * (z[:, None] ** 2 / ((d[:, None] - d[None, :]) - width / 2)).sum(0)
    right = (middle < 0) & (np.arange(k) < k - 1)
    origin = np.where(right, np.append(d[1:], d[-1]), d)
    gaps = d[:, None] - origin[None, :]
    low = np.where(right, -width / 2, 0)
    high = np.where(right, 0, np.where(np.arange(k) < k - 1, width / 2, width))
    for _ in range(300):
        at = (low + high) / 2
        if ((at == low) | (at == high)).all():
            break
        above = 1 + rho * (z[:, None] ** 2 / (gaps - at)).sum(0) > 0
        low, high = np.where(above, low, at), np.where(above, at, high)
    at = np.where(right, low, high)
    return origin + at, gaps - at


def joined(w: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and -vectors of ``q (diag(w) + rho z z') q'``, rho at least 0."""
    order = np.argsort(w, kind="stable")
    w, q, z = w[order], q[:, order], z[order]
    least = 8 * EPS * max(np.abs(w).max(), rho * (z @ z))
    kept: list[int] = []
    for i in np.flatnonzero(rho * np.abs(z) * np.linalg.norm(z) > least):
        if kept:
            p = kept[-1]
            r = np.hypot(z[p], z[i])
            c, s = z[i] / r, -z[p] / r
            if abs((w[i] - w[p]) * c * s) <= least:  # a turn takes p out
                z[i], z[p] = r, 0
                q[:, p], q[:, i] = c * q[:, p] + s * q[:, i], c * q[:, i] - s * q[:, p]
                w[p], w[i] = w[p] * c * c + w[i] * s * s, w[p] * s * s + w[i] * c * c
                kept.pop()
        kept.append(int(i))
    if kept:
        d, zk = w[kept], z[kept]
        roots, gaps = secular_roots(d, zk, rho)
        apart = d[None, :] - d[:, None]
        np.fill_diagonal(apart, 1)
        fitting = np.sqrt(np.abs(np.prod(-gaps / apart, axis=1) / rho)) * np.where(zk < 0, -1, 1)
        u = fitting[:, None] / gaps
        q[:, kept] = q[:, kept] @ (u / np.linalg.norm(u, axis=0))
        w[kept] = roots
    order = np.argsort(w, kind="stable")
    return w[order], q[:, order]


def divide(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of a tridiagonal matrix."""
    n = len(d)
    if n == 1:
        return d.copy(), np.eye(1)
    m, rho = n // 2, e[n // 2 - 1]
    one, two = d[:m].copy(), d[m:].copy()
    one[-1] -= abs(rho)
    two[0] -= abs(rho)
    (w1, q1), (w2, q2) = divide(one, e[: m - 1]), divide(two, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    return joined(np.append(w1, w2), q, np.append(q1[-1], np.copysign(1, rho) * q2[0]), abs(rho))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    size = np.abs(a).max()
    if not size > 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / size)
    w, u = divide(d, e)
    return w[::-1] * size, (q @ u)[:, ::-1]


@dataclass
class Whitener:
    n: int
    sums: list[int]
    mean: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened vectors; not a number for components without variance."""
        scale = np.where(self.values > 0, self.values, np.nan)
        hi, lo = centred(x, self.mean)
        return (hi + lo) @ (self.vectors / np.sqrt(scale))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2."""
        most = self.n * np.abs(x - self.mean[0]).max(initial=0)
        if most * most * max(1, x.shape[1]) < 2.0**62 and self.n * np.abs(x).max(initial=0) < 2.0**62:
            return ((self.n * x.astype(np.int64) - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = (sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [e if e < 1 << 63 else None for e in exact]

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows(x, ...)`` with ``deviation`` and ``whitened``, an array of the components."""
        model = self

        @F.arrow_udf("deviation long, whitened array<double>")
        def applied(x: pa.Array) -> pa.Array:
            m = matrix(x, np.float64).reshape(len(x), -1)
            white = model.project(m) if len(x) else np.zeros((0, len(model.values)))
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)  # not a number is null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), flat)
            return pa.StructArray.from_arrays([pa.array(model.deviations(m), pa.int64()), lists], ["deviation", "whitened"])

        return rows.withColumn("__w", applied("x")).select(*rows.columns, "__w.deviation", "__w.whitened")


def whole_numbers(vectors: DataFrame, column: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Usable vectors as whole numbers ``x``, beside ``vec_id``."""
    most = float(1 << 40)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("x")).filter(F.forall("x", finite) & (F.size("x") > 0))
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.filter(F.size("x") == (common.d if common else 0))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(F.greatest(F.least(scale * c, F.lit(most)), F.lit(-most))) + shift).alias("x"))


def fit(rows: DataFrame, components: int = 32) -> Whitener | None:
    """Fit on every vector ``x`` of whole numbers; None without any."""
    s = reduced(rows, lambda x: np.append(len(x), x.sum(0)), np.add, np.int64)
    if s is None:
        return None
    n, sums = int(s[0]), [int(c) for c in s[1:]]
    hi = [c / n for c in sums]
    mean = np.array([hi, [float(Fraction(c, n) - Fraction(h)) for c, h in zip(sums, hi, strict=True)]])
    v = covariance(rows, n, mean)
    values, vectors = eigen(v)
    values = np.where(values > len(v) * EPS * values[0], values, 0)
    return Whitener(n, sums, mean, float(np.trace(v)), values[:components], vectors[:, :components])


def identity_error(white: DataFrame, model: Whitener) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    real = int((model.values > 0).sum())
    if not real:
        return None
    rows = white.select(F.slice("whitened", 1, real).alias("x"))
    sums = reduced(rows, lambda x: np.array([x.sum(0), np.zeros(real)]), add_pairs)
    v = covariance(rows, model.n, np.array([sums.sum(0) / model.n, np.zeros(real)]))
    return float(np.abs(v - np.eye(real)).max())


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    model = fit(rows, 32)
    if model is None:
        out = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in out.split(", ")])
    white = model.transform(rows)
    error = identity_error(white, model)
    share = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double") for e in model.values])
    parts = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return parts.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
