"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Vectors become integers on a grid, and the fit counts each distinct grid vector once. Spark makes the distinct table, the
sums and the scatter: every task adds up its own d x d matrix and sends it row by row, so what is shuffled and what reaches
the driver depend on the dimension alone, never on the number of vectors. The decomposition of one d x d matrix is made on
the driver: the triangular factor is rotated until its columns are orthogonal; their norms give the eigenvalues and the
normalised columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.common import staged, table

SCALE = 256
COMPONENTS = 4
#: Cells of the matrices that a task works on at a time.
BLOCK_CELLS = 1 << 20
#: Partial scatter rows that meet in a group before the last sum.
FAN_IN = 64
#: Remaining diagonal, as a share of the largest one and for each dimension, that ends the factorisation.
RANK_TOLERANCE = 2.0**-52
ROTATION_TOLERANCE = 2.0**-50
MAX_SWEEPS = 60
_LONG = 1 << 63


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite entries; an empty vector is one of them."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def grid(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of every entry, as long; beyond the range of a long it stays at the border."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def grid_rows(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the usable rows of `df`; no other column is read."""
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return rows.where(usable(F.col("v"))).select("vec_id", grid(F.col("v"), scale).alias("x"))


def _padded(x: Column, dimension: int) -> Column:
    """Shorter vectors count as zero in the dimensions they lack."""
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(dimension) - F.size(x), F.lit(0))))


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """The fit list, each x vector once, and its dimension.

    Equal vectors meet in their own task first, so a vector that a third of the rows hold moves once for each task.
    """
    fit = staged(rows.select("x").distinct(), "vectors")
    shortest, longest = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest is not None and shortest < longest:
        fit = staged(fit.select(_padded(F.col("x"), longest).alias("x")).distinct(), "vectors")
    return fit, longest or 0


def _blocks(batches: Iterator[pa.RecordBatch], at: int, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of Arrow batches, each with its vectors as an integer matrix; shorter vectors are filled up with zeros."""
    step = max(1, BLOCK_CELLS // max(1, dimension))
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            lists = part.column(at)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(sizes) and (sizes == dimension).all():
                yield part, flat.reshape(len(sizes), dimension)
            elif len(sizes):
                x = np.zeros((len(sizes), dimension), dtype=np.int64)
                x[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
                yield part, x


def sums_of(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """(n, S): the number of vectors and the exact sum of each dimension."""
    if dimension == 0:
        return fit.count(), []

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for part, x in _blocks(batches, 0, dimension):
            n += part.num_rows
            wide = x if max(abs(int(x.min())), abs(int(x.max()))) < _LONG >> 21 else x.astype(object)
            total = [a + int(b) for a, b in zip(total, wide.sum(axis=0), strict=True)]
        if n:
            columns = [pa.array(range(dimension), pa.int32()), pa.array([n] * dimension, pa.int64()), pa.array(map(str, total), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "total"])

    parts = fit.select("x").mapInArrow(add, "i int, n long, total string")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by_place = {r.i: r for r in found}
    return (found[0].n if found else 0), [int(by_place[i].total) for i in range(dimension)] if found else [0] * dimension


def _means(n: int, sums: list[int]) -> np.ndarray:
    return np.array([float(Fraction(s, n)) for s in sums])


def scatter_of(fit: DataFrame, means: np.ndarray) -> np.ndarray:
    """Sum of (x - mean)(x - mean)' over the fit list: centred first, multiplied in the tasks, added up by matrix row."""
    dimension = len(means)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0, dimension):
            centred = x - means
            total = centred.T @ centred if total is None else total + centred.T @ centred
        if total is not None:
            group = TaskContext.get().partitionId() // FAN_IN
            columns = [pa.array([group] * dimension, pa.int32()), pa.array(range(dimension), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "i", "row"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(dimension)
        for row in rows.column("row").to_pylist():
            total += np.array(row)
        first = rows.slice(0, 1)
        return pa.table({"part": first.column("part"), "i": first.column("i"), "row": pa.array([total], pa.list_(pa.float64()))})

    shape = "part int, i int, row array<double>"
    parts = fit.select("x").mapInArrow(partial, shape).groupBy("part", "i").applyInArrow(add, shape)
    whole = parts.groupBy("i").applyInArrow(add, shape).collect()
    found = np.zeros((dimension, dimension))
    for r in whole:
        found[r.i] = r.row
    return (found + found.T) / 2


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """G with scatter = G G': columns of a lower triangular factor in pivot order, rows back in their own order.

    The largest remaining diagonal is the next pivot; the columns end where it is lost in rounding, which is the rank.
    """
    a = np.array(scatter, dtype=np.float64)
    d = len(a)
    left = np.diag(a).copy()
    g = np.zeros((d, d))
    floor = left.max(initial=0.0) * d * RANK_TOLERANCE
    for k in range(d):
        p = int(np.argmax(left))
        if not left[p] > floor:
            return g[:, :k]
        column = (a[:, p] - g[:, :k] @ g[p, :k]) / np.sqrt(left[p])
        column[left <= 0] = 0.0  # rows that were pivots already
        column[p] = np.sqrt(left[p])
        g[:, k] = column
        left -= column * column
        left[p] = 0.0
        np.maximum(left, 0.0, out=left)
    return g


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): squared column norms and normalised columns of `factor`, once rotations made them orthogonal.

    A round rotates disjoint pairs of columns together; the rounds of a sweep meet every pair once.
    """
    g = np.array(factor, dtype=np.float64)
    r = g.shape[1]
    m = r + r % 2
    ring = np.arange(m)
    for _ in range(MAX_SWEEPS if r > 1 else 0):
        turned = False
        for _ in range(m - 1):
            p, q = ring[: m // 2], ring[m // 2 :][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            todo = np.abs(gamma) > ROTATION_TOLERANCE * np.sqrt(alpha * beta)
            if todo.any():
                turned = True
                zeta = (beta[todo] - alpha[todo]) / (2 * gamma[todo])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                x, y = x[:, todo], y[:, todo]
                g[:, p[todo]], g[:, q[todo]] = c * x - s * y, s * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")
    values, g = values[order], g[:, order]
    keep = values > values.max(initial=0.0) * len(factor) * RANK_TOLERANCE
    values, g = values[keep], g[:, keep]
    return values, g / np.sqrt(values)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: `vectors` has a component in each column, `values` the eigenvalues in falling order."""

    n: int
    sums: list[int]
    means: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        return (x - self.means) @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def _whitened_columns(rows: DataFrame, model: Whitening, k: int) -> DataFrame:
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches, 0, len(model.sums)):
            w = model.project(x, k)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, j]) for j in range(k)], names=[f"w{j}" for j in range(k)])

    return rows.select("x").mapInArrow(project, ", ".join(f"w{j} double" for j in range(k)))


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of grid rows (vec_id, x).

    Repeated vectors count once. Vectors of different lengths are filled up with zeros to the longest. Directions without
    variance are no components: an empty table, or one vector alone, has none.
    """
    fit, dimension = distinct_vectors(rows)
    n, sums = sums_of(fit, dimension)
    empty = Whitening(n, sums, np.zeros(dimension), np.zeros(0), np.zeros((dimension, 0)), 0.0, 0.0)
    if n == 0 or dimension == 0:
        return empty
    means = _means(n, sums)
    scatter = scatter_of(fit, means)
    values, vectors = one_sided_jacobi(pivoted_cholesky(scatter))
    largest = np.argmax(np.abs(vectors), axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(n, sums, means, values / n, vectors, float(np.trace(scatter)) / n, 0.0)
    k = min(components, len(values))
    if k == 0:
        return model
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = _whitened_columns(fit, model, k).agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
    error = max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))
    return Whitening(n, sums, means, model.values, vectors, model.trace, float(error))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum of (n x - S)^2 for every row, in integers that cannot overflow."""
    reach = max(n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0), 1)
    if reach * reach * max(1, len(sums)) < _LONG:
        y = n * x - np.array(sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    wide = n * x.astype(object) - np.array(sums, dtype=object)
    return [int(v) for v in (wide * wide).sum(axis=1)]


def whitened(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, deviation_exact, whitened), one row for each of `rows`.

    whitened has an entry for each of the first components, fewer than asked for where the vectors have fewer directions.
    deviation is the exact sum of (n x - S)^2: as long, null where it does not fit (beyond some millions of vectors), and
    as a decimal of 38 digits. Repeated rows and null ids are rows of their own; other columns are not carried.
    """
    dimension, k = len(model.sums), min(components, len(model.values))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, dimension):
            exact = _deviations(x, model.n, model.sums)
            w = model.project(x, k)
            offsets = pa.array(np.arange(0, len(x) * k + 1, k) if k else np.zeros(len(x) + 1), pa.int32())
            columns = [
                part.column(0),
                pa.array([v if v < _LONG else None for v in exact], pa.int64()),
                pa.array([str(v) for v in exact], pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "digits", "whitened"])

    out = rows.select("vec_id", "x").mapInArrow(apply, "vec_id long, deviation long, digits string, whitened array<double>")
    exact = F.expr("try_cast(digits AS decimal(38,0))").alias("deviation_exact")
    return out.select("vec_id", "deviation", exact, "whitened")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component."""
    rows = grid_rows(table(spark, sf_dir, "embeddings"))
    model = fitted(rows)
    k = min(COMPONENTS, len(model.values))
    share = F.array(*(F.lit(float(v) / model.trace) for v in model.values[:k])).cast("array<double>")
    out = whitened(rows, model).select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
        "deviation_exact",
    )
