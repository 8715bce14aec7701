"""Whitening of embedding vectors: exact integer scatter, pivoted Cholesky, one-sided Jacobi on the factor.

Vectors are scaled to integers, so that counts, sums and the scatter are exact and do not depend on the order in which
tasks are added up. The scatter is taken about the integers nearest to the means, and what is left of the means, less
than a half in each dimension, is settled in exact arithmetic. What reaches the driver has dims * dims entries, however
many rows there are. Left out are null vectors, vectors with null or non-finite entries or with an entry whose scaled
value a double cannot hold exactly, and vectors of another length than the commonest one (of equally common ones the
longest). Where no row is left, or all of them are equal, there is no component and so no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.shared import broadcast_parameter, free_name, staged, tidy

#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Doubles hold every integer up to here.
EXACT = 1 << 53
#: Rows whose products are added at once.
BLOCK = 4096
#: Columns are orthogonal where their cosine is below this.
ORTHOGONAL = 1e-15
MAX_SWEEPS = 60


@dataclass
class Whitening:
    """A fit: n vectors with sums per dimension, components in rows by falling eigenvalue, and the trace of the covariance."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def usable(column: Column) -> Column:
    """Whether a vector can be scaled exactly: not null, and each entry finite and not too large."""
    top = float((EXACT - OFFSET) // SCALE)
    return F.coalesce(column.isNotNull() & F.forall(column, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < top), F.lit(False))), F.lit(False))


def remaining(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that the fit takes, and their number of dimensions (0 where there is no row)."""
    sound = vectors.where(usable(F.col(column)))
    common = sound.groupBy(F.size(column).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    return sound.where(F.size(column) == dims), dims


def scaled(batch: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a batch as whole numbers, one row each."""
    flat = batch.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(batch), dims)
    return np.floor(SCALE * flat).astype(np.int64) + OFFSET


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y without rounding, as Python integers. Blocks are as large as doubles stay exact in."""
    top = int(np.abs(y).max(initial=0))
    rows = min(BLOCK, EXACT // max(1, top * top))
    if rows == 0:
        wide = y.astype(object)
        return wide.T @ wide
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def _sums(rows: DataFrame, column: str, dims: int) -> tuple[int, list[int]]:
    """n and the sum of each dimension, added up by Spark from one short row for each dimension and task."""

    @tidy
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            n, total = n + batch.num_rows, total + scaled(batch.column(0), dims).astype(object).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()), pa.array([str(n), *map(str, total)])], ["at", "total"])

    added = rows.select(column).mapInArrow(part, "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["at"]: int(r["total"]) for r in added}
    return found.get(-1, 0), [found.get(d, 0) for d in range(dims)]


def _scatter(rows: DataFrame, column: str, dims: int, centre: list[int]) -> np.ndarray:
    """Sums of products of entries about integers, exact: one row for each two dimensions and task is shuffled."""
    upper = np.triu_indices(dims)
    middle = np.array(centre, np.int64)

    @tidy
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            total = total + exact_products(scaled(batch.column(0), dims) - middle)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array([str(v) for v in total[upper]])], ["i", "j", "total"])

    added = rows.select(column).mapInArrow(part, "i int, j int, total string").groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = np.zeros((dims, dims), object)
    for r in added:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["total"])
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): a[order][:, order] = L L', L lower triangular with as many columns as a has rank."""
    a, n = a.copy(), len(a)
    order, factor = np.arange(n), np.zeros((n, n))
    least = n * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(n):
        pivot = k + int(np.argmax(a.diagonal()[k:]))
        if a[pivot, pivot] <= least:
            return factor[:, :k], order
        for m in (a, factor):
            m[[k, pivot]] = m[[pivot, k]]
        a[:, [k, pivot]] = a[:, [pivot, k]]
        order[[k, pivot]] = order[[pivot, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint ones, as in a tournament."""
    seats, out = list(range(n + n % 2)), []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(p), max(p)) for p in zip(seats[:half], reversed(seats[half:]), strict=True) if max(p) < n]
        out.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit vectors in columns) of factor factor', by falling eigenvalue: columns are rotated, two and two,
    until all are orthogonal; then their squared norms are the eigenvalues, and they point along the components."""
    g = factor.copy()
    rounds = _rounds(g.shape[1]) if g.shape[1] > 1 else []
    for _ in range(MAX_SWEEPS):
        worst = 0.0
        for left, right in rounds:
            p, q = g[:, left], g[:, right]
            alpha, beta, gamma = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(gamma), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > ORTHOGONAL
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, left], g[:, right] = c * (p - t * q), c * (t * p + q)
        if worst <= ORTHOGONAL:
            break
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], g[:, order] / np.sqrt(values[order])


def components_of(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components in rows) of a covariance, as many as its rank; a component's largest entry is positive."""
    factor, order = pivoted_cholesky(covariance)
    if factor.shape[1] == 0:
        return np.zeros(0), np.zeros((0, len(covariance)))
    values, vectors = one_sided_jacobi(factor)
    out = np.zeros((len(values), len(covariance)))
    out[:, order] = vectors.T
    heads = out[np.arange(len(out)), np.argmax(np.abs(out), axis=1)]
    return values, out * np.where(heads < 0, -1.0, 1.0)[:, None]


def fit(rows: DataFrame, column: str, dims: int) -> Whitening:
    """Learn from all rows (see remaining), in two passes over one column."""
    n, sums = _sums(rows, column, dims) if dims else (0, [])
    if n == 0:
        return Whitening(0, sums, np.zeros(0), np.zeros((0, dims)), 0.0)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    left = np.array([s - n * m for s, m in zip(sums, centre, strict=True)], object)
    exact = n * _scatter(rows, column, dims, centre) - np.outer(left, left)
    covariance = np.array([[float(Fraction(int(v), n * n)) for v in row] for row in exact])
    values, components = components_of(covariance)
    return Whitening(n, sums, values, components, float(Fraction(int(exact.trace()), n * n)))


OUT = [T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]


def whiten(rows: DataFrame, model: Whitening, n_components: int, column: str = "embedding") -> DataFrame:
    """Add n, deviation (the sum over dimensions of (n * x - sum)^2, null where a long cannot hold it) and whitened, the first components of each row.

    Columns of these names are replaced. Row by row, without a shuffle.
    """
    taken = T.StructType([f for f in rows.schema.fields if f.name.lower() not in ("n", "deviation", "whitened")])
    names, schema = taken.fieldNames(), T.StructType([*taken.fields, *OUT])
    vector = free_name(rows, "vector")
    k, n, dims = min(n_components, len(model.eigenvalues)), model.n, model.dims
    centre = np.array([(2 * s + n) // (2 * n) for s in model.sums] if n else [], np.int64)
    left = np.array([s - n * int(m) for s, m in zip(model.sums, centre, strict=True)], object)
    axes = (model.components[:k] / np.sqrt(model.eigenvalues[:k])[:, None]).T
    shared = broadcast_parameter(rows.sparkSession, axes, axes.nbytes)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.array([float(Fraction(int(v), n)) for v in left]) if n else np.zeros(dims)
        for batch in batches:
            y = scaled(batch.column(len(names)), dims) - centre
            white = (y - rest) @ shared.value
            far = float(n) * np.abs(y - rest).max(initial=0.0)
            wide = far * far * dims >= 2.0**62
            gaps = n * y.astype(object) - left if wide else n * y - left.astype(np.int64)
            deviation = [v if v < 1 << 63 else None for v in (gaps * gaps).sum(axis=1)] if wide else (gaps * gaps).sum(axis=1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(white) * k + 1, k) if k else np.zeros(len(white) + 1), pa.int32()), pa.array(white.ravel()))
            columns = [*batch.columns[: len(names)], pa.array(np.full(len(y), n)), pa.array(deviation, pa.int64()), values]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n", "deviation", "whitened"])

    return rows.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{column}`").alias(vector)).mapInArrow(run, schema)


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of whitened rows minus the identity; tasks add up k * (k + 1) numbers each."""
    upper = np.triu_indices(k)

    @tidy
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, k)
            total, products = total + w.sum(axis=0), products + w.T @ w
        at = [*range(k), *(int(i) * k + int(j) + k for i, j in zip(*upper, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate([total, products[upper]]))], ["at", "total"])

    found = {r["at"]: r["total"] / n for r in white.select("whitened").mapInArrow(part, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()}
    return max(abs(found[i * k + j + k] - found[i] * found[j] - (i == j)) for i, j in zip(*(x.tolist() for x in upper), strict=True))


def whitened_rows(vectors: DataFrame, n_components: int, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row for each vector that remains and each component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows that share an id, or are repeated, each stand for themselves.
    """
    rows, dims = remaining(vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{column}`").alias("embedding")), "embedding")
    model = fit(rows, "embedding", dims)
    k = min(n_components, len(model.eigenvalues))
    white = whiten(rows, model, n_components).drop("embedding")
    if k == 0:
        error, explained = 0.0, F.lit(None).cast("double")
    else:
        white = staged(white, "whitened")
        error = identity_error(white, model.n, k)
        explained = F.element_at(F.array(*(F.lit(float(v / model.trace)) for v in model.eigenvalues[:k])), F.col("component"))
    one = F.transform("whitened", lambda w, i: F.struct((i + 1).alias("component"), w.alias("value")))
    parts = white.select("vec_id", "n", "deviation", F.inline(one.cast("array<struct<component:int,value:double>>")))
    return parts.select("vec_id", "component", "n", "deviation", F.col("value").alias("whitened"), explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
