"""Whitening of embeddings: covariance on the executors, leading eigenvectors by tridiagonal methods, projection.

Components of a vector become integers floor(scale * c). The model is fitted on each distinct integer
vector once. Its size and sums are exact. In a second pass every task adds up products of the centred
vectors, x - S/n, made from the exact integers n * x - S; a task's matrix leaves it as rows of its upper half,
which are added by row. The matrix itself, whose size is that of the dimensions squared and not of the data,
comes to the driver: Householder reflections make it tridiagonal, Sturm counts bisect the largest
eigenvalues, inverse iteration gives their vectors, and vectors of close eigenvalues are made orthogonal to
each other again. Mean and components are broadcast (checked to be small), and rows are projected where they are.

Vectors that are null or hold null or non-finite components take no part and have no rows. The dimension
is the most frequent length of the others (ties: the largest); vectors of another length, and empty
ones, take no part either. Components beyond the long range of 64 bits are cut to it. Repeated rows and
ids, and null ids, stay as they are. There are no more components than axes along which the vectors vary, by
more than rounding beside the largest: one distinct vector, like an empty table, gives no rows. Of equal eigenvalues any basis may come out.
Other columns stay in `whiten`; one that has the name of an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import saved

#: Bytes of matrix that the driver takes at most, and rows of a batch that a task centres at a time.
MOST_BYTES = 256 << 20
ROWS = 2048
EPS = np.finfo(float).eps
#: Eigenvalues closer than this part of the largest one share a cluster.
CLOSE = 1e-3
HALF = 1 << 32
#: What a decimal(38, 0) holds; larger deviations are null.
MOST_DEVIATION = 10**38


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to the symmetric a, and the reflections (first row, unit vector)."""
    a, reflections = a.copy(), []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm > 0 and np.abs(x[1:]).any():
            v = x.copy()
            v[0] += norm if x[0] >= 0 else -norm
            v /= np.linalg.norm(v)
            # H a H with H = 1 - 2 v v', as one update of rank two
            p = a[k + 1 :, k + 1 :] @ v
            w = p - (v @ p) * v
            a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = a[k, k + 1] = -norm if x[0] >= 0 else norm
            a[k + 2 :, k] = a[k, k + 2 :] = 0
            reflections.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each number of `at`."""
    tiny = EPS * EPS * max(1.0, float(np.abs(d).max(initial=0)), float(np.abs(e).max(initial=0))) + np.finfo(float).tiny
    q, count = np.ones(len(at)), np.zeros(len(at), np.int64)
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def largest(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bounds are next to each other."""
    n, reach = len(d), np.r_[0.0, np.abs(e)] + np.r_[np.abs(e), 0.0]
    lo, hi = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    pad = EPS * n * max(np.abs(lo).max(), np.abs(hi).max()) + np.finfo(float).tiny
    lo, hi, rank = lo - pad, hi + pad, np.arange(k)
    while True:
        mid = (lo + hi) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            return mid
        # the eigenvalue of rank r lies above mid if fewer than n - r lie below it
        above = below(d, e, mid) < n - rank
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)


def solved(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """Solves (T - shift) y = b by elimination with row exchanges; pivots below `least` count as it."""
    n = len(d)
    u, v, w, y = d - shift, np.r_[e, 0.0], np.zeros(n), b.astype(float).copy()
    for i in range(n - 1):
        if abs(e[i]) > abs(u[i]):  # the row below becomes the pivot row
            m = u[i] / e[i]
            u[i], v[i], w[i], u[i + 1], v[i + 1] = e[i], u[i + 1], v[i + 1], v[i] - m * u[i + 1], -m * v[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - m * y[i + 1]
        else:
            if abs(u[i]) < least:
                u[i] = least
            m = e[i] / u[i]
            u[i + 1] -= m * v[i]
            y[i + 1] -= m * y[i]
    for i in range(n - 1, -1, -1):
        if abs(u[i]) < least:
            u[i] = least
        y[i] = (y[i] - (v[i] * y[i + 1] if i + 1 < n else 0.0) - (w[i] * y[i + 2] if i + 2 < n else 0.0)) / u[i]
    return y


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, a row for each eigenvalue (falling), by inverse iteration."""
    scale = max(float(np.abs(d).max(initial=0)), float(np.abs(e).max(initial=0)), np.finfo(float).tiny)
    rng, out, cluster = np.random.default_rng(0), [], []
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * scale:
            cluster = []
        y = rng.standard_normal(len(d))
        for turn in range(6):
            for z in [*cluster, *cluster]:
                y -= (z @ y) * z
            y /= np.linalg.norm(y)
            if turn < 5:
                y = solved(d, e, float(value) - 4 * EPS * scale * len(cluster), y, EPS * scale)
        cluster = [*cluster, y]
        out.append(y)
    return np.array(out)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows."""
    scale = float(np.abs(a).max(initial=0))
    if scale == 0:
        return np.zeros(0), np.zeros((0, len(a)))
    d, e, reflections = householder(a / scale)
    values = largest(d, e, min(k, len(d)))
    y = vectors(d, e, values)
    for first, v in reversed(reflections):
        y[:, first:] -= 2 * np.outer(y[:, first:] @ v, v)
    return values * scale, y


@dataclass
class Whitening:
    """n, sums: of the fit list. components: rows of unit vectors. values: their eigenvalues. trace: of the covariance."""

    scale: float
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return numerators(x, self.n, self.sums).astype(float) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        z = numerators(x, self.n, self.sums)
        if z.dtype != object and float(np.abs(z).max(initial=0)) ** 2 * max(1, z.shape[1]) >= 2.0**62:
            z = z.astype(object)
        return (z * z).sum(1).tolist()


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they are enough, else in Python's integers."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def pieces(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def integer_rows(df: DataFrame, vec_col: str, scale: float) -> DataFrame:
    """df with `__x`, the integers of its vector, and only rows that take part."""
    v = F.col(f"`{vec_col}`")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    rows = df.where(fine).withColumn("__x", x)
    lengths = rows.groupBy(F.size("__x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1)
    found = lengths.collect()
    return rows.where(F.size("__x") == (found[0]["d"] if found else 0))


def fit(rows: DataFrame, components: int = 4, scale: float = 256.0) -> Whitening | None:
    """The whitening of `integer_rows`; None if there are none."""
    listed = saved(rows.select("__x").distinct(), "distinct-vectors")

    def sums(batches):
        # halves of 32 bits can't overflow below 2 billion rows of a task
        n, high, low = 0, 0, 0
        for batch in pieces(batches):
            x = matrix(batch, "__x")
            n, high, low = n + len(x), high + (x >> np.int64(32)).sum(0), low + (x & np.int64(HALF - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = listed.mapInArrow(sums, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("i").collect()
    if not found:
        return None
    n, total, d = found[0]["n"], [int(r["high"]) * HALF + int(r["low"]) for r in found], len(found)
    if 8 * d * d > MOST_BYTES:
        raise ValueError(f"a covariance of {d} dimensions is larger than {MOST_BYTES >> 20} MB")
    model = Whitening(scale, n, total, np.zeros((0, d)), np.zeros(0), 0.0)

    def products(batches):
        own = np.zeros((d, d))
        for batch in pieces(batches):
            z = model.centred(matrix(batch, "__x"))
            own += z.T @ z
        for i in range(d):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own[i, i:].tobytes()], pa.binary())], names=["i", "half"])

    def added(key, table):
        whole = np.zeros(d - key[0].as_py())
        for half in sorted(table.column("half").to_pylist()):  # in one order, however rows arrive
            whole += np.frombuffer(half)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "half": pa.array([whole.tobytes()], pa.binary())})

    # tasks' rows are met in two steps, so that no task gets those of all others
    dealt = listed.mapInArrow(products, "i int, half binary").withColumn("part", F.pmod(F.xxhash64("half"), F.lit(64)))
    once = dealt.groupBy("i", "part").applyInArrow(added, "i int, half binary")
    v = np.zeros((d, d))
    for r in once.groupBy("i").applyInArrow(added, "i int, half binary").collect():
        v[r["i"], r["i"] :] = v[r["i"] :, r["i"]] = np.frombuffer(r["half"]) / n
    values, axes = leading(v, components)
    model.trace = float(np.trace(v))
    real = values > len(v) * EPS * max(model.trace, 0.0)
    model.values, model.components = values[real], axes[real]
    model.identity_error = identity_error(listed, model)
    return model


def whitened_rows(rows: DataFrame, model: Whitening) -> DataFrame:
    """`__x` of rows replaced by deviation (decimal) and whitened (array)."""
    kept = [c for c in rows.columns if c not in ("__x", "deviation", "whitened")]
    sent = rows.sparkSession.sparkContext.broadcast(model)  # at most a row of the checked matrix for each component

    def body(batches):
        own = sent.value
        for batch in pieces(batches):
            x = matrix(batch, "__x")
            dev = pa.array([Decimal(v) if v < MOST_DEVIATION else None for v in own.deviation(x)], pa.decimal128(38, 0))
            flat = own.project(x)
            made = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, max(1, flat.shape[1]), dtype=np.int32) if flat.size else np.zeros(len(x) + 1, np.int32), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), dev, made], names=[*kept, "deviation", "whitened"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "deviation decimal(38,0)", "whitened array<double>"])
    return rows.select(*[F.col(f"`{c}`") for c in kept], "__x").mapInArrow(body, schema)


def identity_error(listed: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured on all of it."""
    k = len(model.values)
    if not k:
        return 0.0
    w = whitened_rows(listed, model)
    at = [(i, j) for i in range(k) for j in range(i, k)]
    found = w.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in at]).collect()[0]
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, at))


def whiten(df: DataFrame, components: int = 4, vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """df's rows that take part, the vector replaced by deviation and whitened, with n, explained (an array
    with the part of the variance of each component) and identity_error."""
    made = ("n", "explained", "identity_error", "deviation", "whitened")
    rows = integer_rows(df.select(*[F.col(f"`{c}`") for c in df.columns if c == vec_col or c not in made]), vec_col, scale)
    model = fit(rows, components, scale)
    if model is None:  # no row takes part
        model = Whitening(scale, 1, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    out = whitened_rows(rows.drop(vec_col), model)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    return out.withColumns({"n": F.lit(model.n).cast("long"), "explained": explained, "identity_error": F.lit(model.identity_error)})


def by_component(whitened: DataFrame) -> DataFrame:
    """A row for each row and component of `whiten`, from 1 on."""
    rest = [c for c in whitened.columns if c not in ("whitened", "explained", "component")]
    each = whitened.select(*rest, F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "__z"))
    return each.select(*rest, (F.col("component") + 1).alias("component"), F.col("__z.whitened").alias("whitened"), F.col("__z.explained").alias("explained"))
