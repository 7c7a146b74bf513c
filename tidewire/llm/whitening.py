"""Whitening by singular values: blockwise QR, a bidiagonal form, dqds for its values, twisted factorisations for directions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import work_tables
from .topk import quantised, usable

#: Triangles that one task of a reduction reads.
FAN_IN = 16
#: Rows that are factored, or whitened, at once.
ROWS = 4096
EPS = np.finfo(float).eps
#: A number of the upper diagonal is nothing beside values this many times larger.
NOTHING = 10 * EPS
#: Components that a row gets.
COMPONENTS = 4


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


# ---- the bidiagonal form, on one triangle of dim x dim numbers


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper diagonal of B in R = U B V', and V's Householder vectors in turn (V's first column is the first unit vector)."""
    a = np.array(r, dtype=float)
    d = a.shape[1]
    right: list[np.ndarray] = []
    for j in range(d):
        a[j:, j:] -= np.outer(u := _householder(a[j:, j]), 2 * (u @ a[j:, j:]))
        if j < d - 2:
            v = _householder(a[j, j + 1 :])
            a[j:, j + 1 :] -= np.outer(2 * (a[j:, j + 1 :] @ v), v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _householder(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection leaves x its first number only; 0 where there is nothing to do."""
    v = x.copy()
    big = np.abs(v).max(initial=0)
    if len(v) < 2 or not big:
        return np.zeros_like(v)
    v /= big
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def _unreflected(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """V z."""
    z = z.copy()
    for j in range(len(right) - 1, -1, -1):
        z[j + 1 :] -= 2 * right[j] * (right[j] @ z[j + 1 :])
    return z


# ---- dqds


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, int, float, float]:
    """One differential qd transform with a shift: the new q and e; where a number fell below 0 (its place, or -1) and that number; a lower bound of the values left.

    Without a shift the transform's numbers d are the inverse of (BB')'s inverse's diagonal, so
    the inverse of the sum of their inverses is below the least value.
    """
    n = len(q)
    nq, ne = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    inverses = 0.0
    for i in range(n - 1):
        if d < 0:
            return nq, ne, i, d, 0.0
        inverses += 1 / d if d else np.inf
        nq[i] = d + e[i]
        t = q[i + 1] / nq[i] if nq[i] else 1.0
        ne[i] = e[i] * t
        d = d * t - shift
    nq[-1] = d
    inverses += 1 / d if d else np.inf
    return nq, ne, n - 1 if d < 0 else -1, d, 1 / inverses if shift == 0 else 0.0


def _last(q: np.ndarray, e: np.ndarray) -> float:
    """The smaller value of the last two rows."""
    a, b, c = q[-2], e[-1], q[-1]
    s = a + b + c
    root = np.sqrt(max(0.0, (a - c + b) ** 2 + 4 * b * c)) if s else 0.0
    high = (s + root) / 2
    return a * c / high if high else 0.0


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> list[tuple[float, int, int]]:
    """The squared singular values of a bidiagonal matrix, falling, each with the run of rows [from, to) that has it.

    Runs are parted where the upper diagonal is nothing beside the values near it. A shift below
    the least value left is taken from the last rows; one that is too large shows as a negative
    number, and is made smaller, at last to 0. All transforms add positive numbers only, so
    small values are as exact as large ones.
    """
    found: list[tuple[float, int, int]] = []
    big = float(max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0)))
    if not big:
        return [(0.0, i, i + 1) for i in range(len(diagonal))]
    a, b = diagonal / big, upper / big
    parts = np.flatnonzero(np.abs(b) <= NOTHING * np.sqrt(np.abs(a[:-1] * a[1:]))) + 1
    edges = [0, *parts.tolist(), len(a)]
    for lo, hi in zip(edges, edges[1:]):  # noqa: B905
        q, e = np.maximum(a[lo:hi] ** 2, 1e-280), b[lo : hi - 1] ** 2
        found += [(v * big * big, lo, hi) for v in _run_values(q, e)]
    return sorted(found, key=lambda x: (-x[0], x[1]))


def _run_values(q: np.ndarray, e: np.ndarray) -> list[float]:
    out: list[float] = []
    todo = [(q, e, 0.0)]
    while todo:
        q, e, shift = todo.pop()
        bound = 0.0
        while len(q) > 1:
            if e[-1] <= NOTHING**2 * (shift + q[-1]):
                out.append(shift + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            if q[0] < q[-1] / 4:  # the least value belongs at the end
                q, e = _turned(q, e)
            s, bound = max(bound * (1 - 1e-8), _last(q, e) * (1 - 4 * EPS)) if bound or shift else 0.0, 0.0
            nq, ne, bad, d, below = _step(q, e, s)
            if bad == len(q) - 1 and s + d > 0:  # only the last number fell below 0: this is how far
                s = (s + d) * (1 - 4 * EPS)
                nq, ne, bad, d, below = _step(q, e, s)
            if bad >= 0:
                s = 0.0
                nq, ne, bad, d, below = _step(q, e, s)
            bound = below
            q, e, shift = nq, ne, shift + s
            gap = np.flatnonzero(e <= NOTHING**2 * (shift + np.minimum(q[:-1], q[1:])))
            if len(gap):
                cut = int(gap[-1]) + 1
                todo.append((q[:cut], e[: cut - 1], shift))
                q, e = q[cut:], e[cut:]
        if len(q):
            out.append(shift + q[0])
    return out


def _turned(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same values from the other end: rows and columns in reverse, then made upper bidiagonal again by one transform."""
    a, b = np.sqrt(q[::-1]), np.sqrt(e[::-1])
    nq, ne = np.empty_like(q), np.empty_like(e)
    d = a[0] ** 2
    for i in range(len(b)):  # Givens rotations of a lower bidiagonal matrix, in squares
        nq[i] = d + b[i] ** 2
        t = a[i + 1] ** 2 / nq[i] if nq[i] else 1.0
        ne[i] = b[i] ** 2 * t
        d = d * t
    nq[-1] = d
    return np.maximum(nq, 1e-280), ne


# ---- twisted factorisations


def direction(diagonal: np.ndarray, upper: np.ndarray, value: float, nth: int = 0) -> np.ndarray:
    """A unit eigenvector of B'B of a run, for one of its squared singular values.

    B'B - value is factored from the top and from the bottom; at the row where both meet with the
    least rest (with `nth`, the one after that) the equations are solved by products alone.
    """
    n = len(diagonal)
    if n == 1:
        return np.ones(1)
    tiny = np.finfo(float).tiny / EPS
    big = diagonal * diagonal
    low = upper / np.where(diagonal[:-1] == 0, tiny, diagonal[:-1])
    plus, minus = np.empty(n - 1), np.empty(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        x = s[i] + big[i]
        x = x if abs(x) > tiny else tiny
        plus[i] = big[i] * low[i] / x
        s[i + 1] = plus[i] * low[i] * s[i] - value
    p[-1] = big[-1] - value
    for i in range(n - 2, -1, -1):
        x = big[i] * low[i] ** 2 + p[i + 1]
        x = x if abs(x) > tiny else tiny
        t = big[i] / x
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    r = int(np.argsort(np.abs(s + p + value), kind="stable")[nth])
    z = np.zeros(n)
    z[r] = 1
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
        if abs(z[i + 1]) > 1e150:
            z /= abs(z[i + 1])
    return z / np.linalg.norm(z)


def components(r: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of a triangle that are not 0, and their right singular vectors as columns.

    Vectors of values that lie close together are made orthogonal to each other; a vector that
    another one already holds comes from the factorisation's next row.
    """
    a, b, right = bidiagonal(r)
    values = dqds(a, b)
    good = [v for v in values if v[0] > (EPS * len(a)) ** 2 * values[0][0]][:most]
    found: list[np.ndarray] = []
    for value, lo, hi in good:
        for nth in range(hi - lo):
            z = np.zeros(len(a))
            z[lo:hi] = direction(a[lo:hi], b[lo : hi - 1], value, nth)
            for _ in range(2):
                for w in found:
                    z -= w * (w @ z)
            if np.linalg.norm(z) > 0.1:
                break
        found.append(z / np.linalg.norm(z))
    vectors = np.stack([_unreflected(z, right) for z in found], axis=1) if found else np.zeros((len(a), 0))
    return np.array([v[0] for v in good]), vectors


# ---- over the table


@dataclass
class Whitening:
    """What a table's vectors are whitened by: counts and sums of the fit list, directions, their variances."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.vectors / np.sqrt(self.variances)


def _triangle(stack: np.ndarray) -> np.ndarray:
    """R of a QR factorisation, dim x dim."""
    r = np.linalg.qr(stack, mode="r")
    return np.vstack([r, np.zeros((stack.shape[1] - len(r), stack.shape[1]))])


def _reduced(triangles: DataFrame, count: int, dim: int, table) -> np.ndarray:
    """One triangle of many, FAN_IN to a task and round; the driver gets the last one."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for r in _rows(batch, "r"):
                r = r.reshape(dim, dim)
                held = r if held is None else _triangle(np.vstack([held, r]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.ravel()], pa.list_(pa.float64()))], names=["r"])

    while count > 1:
        groups = -(-count // FAN_IN)
        triangles = table(triangles.repartition(groups).mapInArrow(join, "r array<double>"), "whitening-triangles")
        count = triangles.count()
    return np.array(triangles.first()["r"]).reshape(dim, dim)


def fit(fitted: DataFrame, dim: int, table) -> Whitening | None:
    """The whitening of a fit list (x: distinct integer vectors); None if nothing varies in it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in _sliced(batches):
            x = _rows(batch, "x")
            wide = int(np.abs(x).max(initial=0)) * len(x) >= 2**62
            total = [t + int(v) for t, v in zip(total, x.astype(object if wide else np.int64).sum(axis=0), strict=True)]
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array(map(str, [n, *total]), pa.string())], names=["at", "total"])

    got = fitted.mapInArrow(sums, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # dim + 1 rows
    if not got:
        return None
    by_place = {r["at"]: int(r["total"]) for r in got}
    n, total = by_place[-1], [by_place[i] for i in range(dim)]
    if not n:
        return None
    mean = np.array([s / n for s in total])

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, dim))
        for batch in _sliced(batches):
            held = _triangle(np.vstack([held, _rows(batch, "x") - mean]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.ravel()], pa.list_(pa.float64()))], names=["r"])

    triangles = table(fitted.mapInArrow(factor, "r array<double>"), "whitening-triangles")
    r = _reduced(triangles, triangles.count(), dim, table)
    squares, vectors = components(r)
    return Whitening(n, total, vectors, squares / n, float((r * r).sum()) / n)


def _identity_error(fitted: DataFrame, w: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity; blocks are centred for themselves and then joined."""
    k = len(w.variances)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for batch in _sliced(batches):
            y = w.whiten(_rows(batch, "x"))
            m, own = len(y), y.mean(axis=0)
            y = y - own
            step = own - mean
            scatter += y.T @ y + np.outer(step, step) * (n * m / (n + m))
            mean += step * (m / (n + m))
            n += m
        if n:
            values = [n, *(n * mean), *(scatter + n * np.outer(mean, mean)).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], names=["at", "v"])

    # The mean of whitened values is 0 but for rounding, so sums of squares about 0 lose nothing.
    got = {r["at"]: r["v"] for r in fitted.mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    n, mean = got[0], np.array([got[1 + i] for i in range(k)]) / got[0]
    second = np.array([got[1 + k + i] for i in range(k * k)]).reshape(k, k) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum of (n x - S)^2 of each row, exactly: in 64 bits where these hold it, else in Python's integers."""
    most = int(np.abs(x).max(initial=0))
    bound = max((n * most + abs(s) for s in sums), default=0)
    if bound**2 * max(1, len(sums)) < 2**63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_text string"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector's whitened values along the table's first four components.

    Vectors that are null or hold a null or non-finite entry go. Entries become integers,
    floor(256 x); the fit list has each distinct vector once. Its centred rows are factored block by
    block (QR), triangles are joined in a tree, and of the last one the singular values and right
    vectors are the components: a triangle of dim x dim numbers is all that the driver gets.

    Returns vec_id, component (from 1, by falling variance), n (vectors in the fit list), deviation (sum of
    (n x - S)^2, exact; null where 64 bits can't hold it, deviation_text always has it), whitened, explained (share of
    the variance), identity_error. Components without variance are left out: fewer than four if fewer dimensions vary,
    none for a single distinct vector; of equal variances any orthogonal directions stand, the same for
    all rows. Rows that repeat and null ids are whitened like others. Vectors of another length than
    most (of equally many, the longer) can't be whitened with these and give no row; very long ones are bounded by dim x dim
    numbers in a task. No rows give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("vec_id"), quantised(F.col(vector_col)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None or not lengths["dim"]:
        return spark.createDataFrame([], OUT)
    dim = lengths["dim"]
    rows = rows.where(F.size("x") == dim)
    with work_tables(spark) as table:
        fitted = table(rows.select("x").distinct(), "whitening-fit")
        w = fit(fitted, dim, table)
        if w is None or not len(w.variances):
            return spark.createDataFrame([], OUT)
        w.identity_error = _identity_error(fitted, w)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.variances)
        share = w.variances / w.total
        for batch in _sliced(batches):
            x = _rows(batch, "x")
            y, exact = w.whiten(x), _deviations(x, w.n, w.sums)
            m = len(x)
            each = lambda values: [v for v in values for _ in range(k)]  # noqa: B023, E731
            columns = [
                pa.array(each(batch.column(0).to_pylist()), pa.int64()), pa.array(list(range(1, k + 1)) * m, pa.int32()), pa.array([w.n] * (m * k), pa.int64()),
                pa.array(each(v if v < 2**63 else None for v in exact), pa.int64()), pa.array(y.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, w.identity_error)), pa.array(each(map(str, exact)), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(project, OUT)
