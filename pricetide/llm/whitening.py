"""Whitening of embeddings: distributed centred covariance, its leading eigenvectors, broadcast projection.

An entry c of a vector becomes the whole number x = floor(SCALE c) + SHIFT, so sums over any number of rows are exact.

Covariance. A first pass adds up x by dimension, exactly; a second one subtracts the mean, S / n, from every row (n x - S is a
whole number, so the difference is rounded once) and adds up the outer products of what is left. A task adds up its own
rows and gives one row per dimension; those are added up by dimension, and d x d numbers reach the driver.

Eigenvectors, on the driver, from these d x d numbers alone: Householder reflections make the matrix tridiagonal. The number
of negative pivots of T - x I is how many eigenvalues are below x (a Sturm count), and bisection by it gives the leading
ones, all at once. Inverse iteration gives the vector of each; vectors of eigenvalues that are close to each other (a
cluster) are made orthogonal at every step. The reflections are then undone.

Projection. The matrix of at most COMPONENTS x d numbers goes to all tasks. The covariance of the projected rows is measured
in the same two passes, so ``identity_error`` is that of the rows that are returned, not of the formula.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import small_batches
from pricetide.session import stage

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
# Entries beyond this have no x that a long can hold.
MOST_ENTRY = 2.0**62
# Eigenvalues below this share of the largest are rounding, their directions can't be scaled to 1.
LEAST_SHARE = 1e-10
# Eigenvalues closer than this share of the largest are a cluster.
CLUSTER = 1e-3
_LIMB = np.int64((1 << 21) - 1)


@dataclass
class Whitener:
    """What a row needs: n, the exact sums, components (a column each, by falling eigenvalue), eigenvalues, trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``d`` finite entries, and those rows' entries as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right = lengths == d
    flat = column.filter(pa.array(right)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
    finite = np.isfinite(values).all(axis=1)
    if flat.null_count:
        finite &= ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)
    right[np.flatnonzero(right)[~finite]] = False
    return right, values[finite]


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit numbers where they suffice, else Python's."""
    most = max((abs(s) for s in sums), default=0)
    if n * int(np.abs(x).max(initial=0)) + most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if y.dtype == object:
        return [int((row * row).sum()) for row in y]
    most = int(np.abs(y).max(initial=0))
    if most * most * y.shape[1] < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    # y = a 2^42 + b 2^21 + c, each product below 2^42.
    a, b, c = y >> np.int64(42), (y >> np.int64(21)) & _LIMB, y & _LIMB
    parts = [(u * v).sum(axis=1).tolist() for u, v in ((a, a), (a, b), (b, b), (a, c), (b, c), (c, c))]
    return [(aa << 84) + (ab << 64) + ((bb + 2 * ac) << 42) + (bc << 22) + cc for aa, ab, bb, ac, bc, cc in zip(*parts, strict=True)]


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, the one beside it, and the unit vectors of the Householder reflections, of a symmetric matrix."""
    m = np.array(v, float)
    d = len(m)
    mirrors = []
    for k in range(d - 2):
        u = m[k + 1 :, k].copy()
        length = np.linalg.norm(u)
        u[0] += np.copysign(length, u[0])
        size = np.linalg.norm(u)
        u = u / size if size > 0 else u
        mirrors.append(u)
        rest = m[k + 1 :, k + 1 :]
        p = rest @ u
        q = p - (u @ p) * u
        rest -= 2 * (np.outer(u, q) + np.outer(q, u))
        m[k + 1 :, k] -= 2 * u * (u @ m[k + 1 :, k])
    return np.diag(m).copy(), np.diag(m, -1).copy(), mirrors


def below(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each of ``x``."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = a[0] - x
    count = (pivot < 0).astype(np.int64)
    for i in range(1, len(a)):
        pivot = a[i] - x - b[i - 1] ** 2 / np.where(pivot == 0, tiny, pivot)
        count += pivot < 0
    return count


def leading_values(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` greatest eigenvalues, falling, by bisection."""
    reach = np.abs(np.append(b, 0)) + np.abs(np.append(0, b))
    rank = len(a) - 1 - np.arange(k)
    low, high = np.full(k, (a - reach).min()), np.full(k, (a + reach).max())
    for _ in range(120):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        few = below(a, b, middle) <= rank
        low, high = np.where(few, middle, low), np.where(few, high, middle)
    return (low + high) / 2


def _factored(a: np.ndarray, b: np.ndarray, shift: float, least: float):
    """Rows of U (three diagonals), multipliers and swaps of T - shift I with partial pivoting."""
    d = len(a)
    main, right, far = a - shift, np.append(b, 0.0), np.zeros(d)
    factor, swapped = np.zeros(d), np.zeros(d, bool)
    for i in range(d - 1):
        under, beside, next_right = b[i], main[i + 1], right[i + 1]
        if abs(under) > abs(main[i]):
            swapped[i] = True
            factor[i] = main[i] / under
            main[i], main[i + 1] = under, right[i] - factor[i] * beside
            right[i], right[i + 1] = beside, -factor[i] * next_right
            far[i] = next_right
        else:
            factor[i] = under / main[i] if main[i] else 0.0
            main[i + 1] = beside - factor[i] * right[i]
    main[np.abs(main) < least] = least
    return main, right, far, factor, swapped


def _solved(parts, z: np.ndarray) -> np.ndarray:
    main, right, far, factor, swapped = parts
    z, d = z.copy(), len(z)
    for i in range(d - 1):
        if swapped[i]:
            z[i], z[i + 1] = z[i + 1], z[i]
        z[i + 1] -= factor[i] * z[i]
    for i in range(d - 1, -1, -1):
        if i + 1 < d:
            z[i] -= right[i] * z[i + 1]
        if i + 2 < d:
            z[i] -= far[i] * z[i + 2]
        z[i] /= main[i]
        if abs(z[i]) > 1e150:
            z *= 1e-150
    return z


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    The entry of a vector that is largest in size is positive.
    """
    d = len(v)
    k = min(k, d)
    size = float(np.abs(v).max(initial=0))
    if not d or not size:
        return np.zeros(k), np.eye(d)[:, :k]
    a, b, mirrors = tridiagonal(v / size)
    values = leading_values(a, b, k)
    top = float(np.abs(a).max() + 2 * np.abs(b).max(initial=0))
    least = np.finfo(float).eps * top
    random = np.random.default_rng(0)
    found = np.zeros((d, k))
    begin = 0
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * top:
            begin = j
        # Equal eigenvalues get shifts a little apart.
        parts = _factored(a, b, values[j] - (j - begin) * least, least)
        z = random.normal(size=d)
        for _ in range(6):
            z = _solved(parts, z / np.linalg.norm(z))
            z /= np.abs(z).max()
            for _ in range(2):
                z -= found[:, begin:j] @ (found[:, begin:j].T @ z)
        found[:, j] = z / np.linalg.norm(z)
    for i in range(len(mirrors) - 1, -1, -1):
        found[i + 1 :] -= 2 * np.outer(mirrors[i], mirrors[i] @ found[i + 1 :])
    found /= np.linalg.norm(found, axis=0)
    values = np.einsum("ij,ij->j", found, (v / size) @ found) * size
    order = np.argsort(-values, kind="stable")
    values, found = values[order], found[:, order]
    return values, found * np.where(found[np.abs(found).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)


def _added(parts: DataFrame, d: int) -> np.ndarray:
    """Sums by ``i`` of the arrays ``row``: d x d doubles. A task gave one row for each i."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, total = None, np.zeros(d)
        for batch in batches:
            i = batch.column("i")[0].as_py()
            total += batch.column("row").flatten().to_numpy().reshape(-1, d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["i", "row"])

    out = np.zeros((d, d))
    for r in parts.groupBy("i").applyInArrow(add, "i int, row array<double>").toLocalIterator():
        out[r["i"]] = r["row"]
    return out


def _products(rows: DataFrame, column: str, d: int, centre) -> np.ndarray:
    """The sum over rows of the outer product of ``centre`` of a row with itself."""

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            y = centre(batch.column(column).flatten().to_numpy().reshape(-1, d))
            total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    return _added(rows.select(column).mapInArrow(run, "i int, row array<double>"), d)


def _usable(embeddings: DataFrame, d: int) -> DataFrame:
    """vec_id, x of the rows with ``d`` finite entries."""

    def run(batches):
        for batch in batches:
            keep, values = matrix(batch.column("embedding"), d)
            fits = (np.abs(SCALE * values) < MOST_ENTRY).all(axis=1)
            keep[np.flatnonzero(keep)[~fits]] = False
            x = whole_numbers(values[fits])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(keep)), lists], names=["vec_id", "x"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where("embedding is not null").mapInArrow(run, "vec_id long, x array<long>")


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many rows there are and the exact sum of each dimension."""

    def run(batches):
        n, total = 0, [0] * d
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            n += len(x)
            safe = len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0) if safe else x.astype(object).sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([n] * d, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "n", "s"])

    found = rows.select("x").mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums = [0] * d
    for r in found:
        sums[r["i"]] = int(r["s"])
    return (found[0]["n"] if found else 0), sums


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitener:
    """The whitener of all ``rows`` (a column x of ``d`` whole numbers); without a row or a spread it has no component."""
    n, sums = _sums(rows, d)
    if not n:
        return Whitener(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    v = _products(rows, "x", d, lambda x: (from_mean(x, n, sums) / n).astype(float)) / n
    values, vectors = leading((v + v.T) / 2, components)
    keep = values > LEAST_SHARE * max(float(values[0]), 0.0)
    return Whitener(n, sums, vectors[:, keep], values[keep], float(np.trace(v)))


def _projected(rows: DataFrame, model: Whitener, d: int) -> DataFrame:
    """vec_id, deviation, w: exact squared distance from the mean (n-fold), and the whitened components."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        turned = model.components / np.sqrt(model.values)
        for batch in batches:
            y = from_mean(batch.column("x").flatten().to_numpy().reshape(-1, d), model.n, model.sums)
            w = (y / model.n).astype(float) @ turned
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([Decimal(s) for s in squares(y)], pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "w"])

    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), w array<double>")


def _identity_error(rows: DataFrame, n: int, k: int) -> float:
    """The largest entry of the covariance of ``w`` less the identity, measured over all rows."""

    def run(batches):
        total = np.zeros(k)
        for batch in batches:
            total += batch.column("w").flatten().to_numpy().reshape(-1, k).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total)], names=["i", "s"])

    mean = np.zeros(k)
    for r in rows.select("w").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        mean[r["i"]] = r["s"] / n
    return float(np.abs(_products(rows, "w", k, lambda w: w - mean) / n - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows whose vector is null or holds a null or non-finite entry go, and so do those of another length than most (the longer
    of equally frequent ones) and those with an entry of 2^56 or more, which has no x. Null ids and repeated rows are
    rows like others. Components that rounding alone gives (all rows equal, or fewer rows than dimensions) are left out,
    so an empty table, a single row or rows that are all equal give none. Other columns are ignored.
    ``deviation`` is a decimal that holds any sum; ``explained`` is the component's share of the whole variance.
    """
    small_batches(embeddings.sparkSession)
    lengths = embeddings.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 1
    rows = stage(_usable(embeddings, d), "whitening-x")
    model = fit(rows, d, components)
    k = len(model.values)
    projected = stage(_projected(rows, model, d), "whitening-w") if k else _projected(rows.where("false"), model, d)
    error = _identity_error(projected, model.n, k) if k else 0.0
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if k else F.array().cast("array<double>")
    each = projected.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
