"""Whitening of embeddings by the leading principal components, found by spectrum slicing.

Grid values
    Every entry c becomes the integer floor(64 * c) + 1000000 (|64 c| beyond 2**40 counts as 2**40, so that sums stay
    exact). The model is fitted on each distinct integer vector once.

Statistics
    Tasks add up integer sums, then products of the centred vectors; the partial sums meet in Spark by cell, so that only
    one row per dimension, and then one per cell, reaches the driver: dims**2 numbers, at most ``MOST_DIMS`` squared.

Spectrum slicing
    The LDL^T factors of V - s I have as many negative pivots as V has eigenvalues below s (Sylvester). Bisection on
    such counts cuts the spectrum until an interval holds one eigenvalue of known number; inside it Rayleigh quotient
    iteration converges cubically. A run that leaves its interval goes on from a halved one. Eigenvalues too close to be
    told apart form a cluster, whose vectors are iterated at the same shift and made orthogonal to those found before.
    Counts just beside every value found certify its number at the end.

Edge cases: null vectors and vectors with null or non-finite entries are dropped; vectors of another length than the most
frequent one (of equally frequent ones the longer) are dropped too, and so are empty ones; repeated rows keep their rows but
count once in the fit; null ids stay. Components without variance (up to rounding) cannot be whitened and have no rows, so one distinct vector
or an empty table gives an empty result. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT, CLAMP, MOST_DIMS = 64, 1_000_000, 1 << 40, 4096
ALPHA = (1 + 17 ** 0.5) / 8  # growth bound of the symmetric pivoting


# --- spectrum slicing -----------------------------------------------------------------------

def inertia_below(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix below ``shift``: negative pivots of LDL^T with 1x1 and 2x2 pivots."""
    a = matrix - shift * np.eye(len(matrix))
    n, at, below = len(a), 0, 0
    tiny = np.finfo(float).tiny

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while at < n:
        column = np.abs(a[at + 1:, at])
        if at == n - 1 or not column.any():
            below += a[at, at] < 0
            at += 1
            continue
        low = int(column.argmax()) + at + 1
        most = column.max()
        double = False
        if abs(a[at, at]) < ALPHA * most:
            row = np.abs(a[low, at:])
            row[low - at] = 0
            reach = row.max()
            if abs(a[at, at]) * reach >= ALPHA * most * most:
                pass
            elif abs(a[low, low]) >= ALPHA * reach:
                swap(at, low)
            else:
                swap(at + 1, low)
                double = True
        if double:
            d = a[at:at + 2, at:at + 2]
            below += 1 if d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0] < 0 else 2 * int(d[0, 0] + d[1, 1] < 0)
            side = a[at + 2:, at:at + 2].copy()
            a[at + 2:, at + 2:] -= side @ np.linalg.solve(d, side.T)
            at += 2
        else:
            pivot = a[at, at] if a[at, at] != 0 else tiny
            below += pivot < 0
            side = a[at + 1:, at].copy()
            a[at + 1:, at + 1:] -= np.outer(side, side / pivot)
            at += 1
    return int(below)


def _orthogonal(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in found:
            x = x - v * (v @ x)
    return x / np.linalg.norm(x)


def _solve(matrix: np.ndarray, shift: float, x: np.ndarray, size: float) -> np.ndarray:
    eye = np.eye(len(matrix))
    try:
        y = np.linalg.solve(matrix - shift * eye, x)
    except np.linalg.LinAlgError:
        y = np.linalg.solve(matrix - (shift + size * 4e-16) * eye, x)
    return y / np.linalg.norm(y)


def _rayleigh(matrix: np.ndarray, lo: float, hi: float, size: float, found: list[np.ndarray],
              rng: np.random.Generator) -> tuple[float, np.ndarray] | None:
    """Eigenpair of the one eigenvalue in (lo, hi), or None if the iteration left the interval."""
    shift, x = (lo + hi) / 2, _orthogonal(rng.standard_normal(len(matrix)), found)
    for _ in range(2):  # inverse iteration brings the vector near
        x = _orthogonal(_solve(matrix, shift, x, size), found)
    value = x @ matrix @ x
    for _ in range(12):
        if not lo <= value <= hi:
            return None
        if np.linalg.norm(matrix @ x - value * x) <= 1e-15 * size * len(x) ** 0.5:
            break
        x = _orthogonal(_solve(matrix, value, x, size), found)
        value = x @ matrix @ x
    return (value, x) if lo <= value <= hi else None


def leading_components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``most`` largest eigenvalues with variance, by falling value."""
    d = len(matrix)
    matrix = (matrix + matrix.T) / 2
    size = float(np.abs(matrix).sum(axis=1).max(initial=0))  # bounds every eigenvalue
    if size == 0:
        return np.empty(0), np.empty((d, 0))
    floor, narrow = size * d * 1e-15, size * d * 4e-16
    rng = np.random.default_rng(0)
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = d - inertia_below(matrix, shift)
        return counts[shift]

    wanted = min(most, above(floor))
    values, vectors = [], []
    intervals = [(floor, size * 1.0000001)]  # a stack, the highest interval last
    while intervals and len(values) < wanted:
        lo, hi = intervals.pop()
        held = above(lo) - above(hi)
        if not held:
            continue
        pair = _rayleigh(matrix, lo, hi, size, vectors, rng) if held == 1 else None
        if pair:
            values.append(pair[0])
            vectors.append(pair[1])
            continue
        middle = (lo + hi) / 2
        if hi - lo > narrow and lo < middle < hi:
            intervals += [(lo, middle), (middle, hi)]
            continue
        for _ in range(min(held, wanted - len(values))):  # a cluster
            x = _orthogonal(rng.standard_normal(d), vectors)
            for _ in range(3):
                x = _orthogonal(_solve(matrix, middle, x, size), vectors)
            values.append(x @ matrix @ x)
            vectors.append(x)
    order = np.argsort(-np.array(values), kind="stable")
    values, basis = np.array(values)[order], np.array(vectors).T.reshape(d, -1)[:, order]
    room = size * d * 1e-13
    for k, value in enumerate(values):
        if above(value - room) < k + 1 or above(value + room) > k:
            raise ArithmeticError(f"component {k + 1} is not eigenvalue number {k + 1}")
    return values, basis


# --- statistics in Spark --------------------------------------------------------------------

def grid(vector: Column) -> Column:
    """Integer vector of an embedding; null if it takes no part."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(vector, lambda c: (F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(CLAMP))),
                                                               F.lit(-float(CLAMP)))) + SHIFT).cast("bigint"))
    return F.when(good & (F.size(vector) > 0), scaled)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(fit: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all vectors of ``part`` (a vector of ``width`` doubles per batch), added up by cell."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(width), False
        for batch in batches:
            if batch.num_rows:
                any_row = True
                total += part(_matrix(batch.column(0), dims))
        if any_row:
            yield pa.record_batch({"cell": np.arange(width), "v": total})

    rows = fit.select("x").mapInArrow(add, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width)
    out[rows.column("cell").to_numpy()] = rows.column("v").to_numpy()
    return out


class Whitening:
    """Mean and leading components of a set of grid vectors."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.base = np.array([s // n for s in sums], np.int64) if n else np.empty(0, np.int64)
        self.rest = np.array([(s - s // n * n) / n for s in sums]) if n else np.empty(0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, from the exact integer part of the mean and the rest."""
        return (x - self.base) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)**2 per row, exact; None beyond 64 bits."""
        span = x - self.base
        rest = [s - s // self.n * self.n for s in self.sums]
        if len(span) and len(self.sums) * (self.n * (int(np.abs(span).max()) + 1)) ** 2 < 1 << 63:
            off = self.n * span - np.array(rest, np.int64)
            return (off * off).sum(axis=1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest)) for row in span.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    @classmethod
    def fit(cls, fit: DataFrame, dims: int, most: int) -> Whitening:
        """From distinct grid vectors ``x`` of ``dims`` entries."""
        def integer_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, [0] * dims
            for batch in batches:
                x = _matrix(batch.column(0), dims)
                for at in range(0, len(x), 1 << 20):
                    total = [t + s for t, s in zip(total, x[at:at + (1 << 20)].sum(axis=0).tolist())]
                n += len(x)
            if n:
                yield pa.record_batch({"cell": list(range(dims)), "n": [n] * dims, "v": [str(t) for t in total]})

        sums = (fit.select("x").mapInArrow(integer_sums, "cell bigint, n bigint, v string").groupBy("cell")
                .agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect())
        if not sums:
            return cls(0, [], np.empty(0), np.empty((0, 0)), 0.0)
        by_cell = {r.cell: r for r in sums}
        start = cls(by_cell[0].n, [int(by_cell[k].v) for k in range(dims)], np.empty(0), np.empty((dims, 0)), 0.0)
        upper = np.triu_indices(dims)

        def products(x: np.ndarray) -> np.ndarray:
            c = start.centred(x)
            return (c.T @ c)[upper]

        v = np.zeros((dims, dims))
        v[upper] = _summed(fit, dims, products, len(upper[0])) / start.n
        v = v + np.triu(v, 1).T
        values, vectors = leading_components(v, most)
        return cls(start.n, start.sums, values, vectors, float(np.trace(v)))

    def identity_error(self, fit: DataFrame, dims: int) -> float:
        """Largest entry of the covariance of the whitened fit vectors minus the identity, measured on all of them."""
        k = len(self.values)

        def moments(x: np.ndarray) -> np.ndarray:
            w = self.whitened(x)
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        found = _summed(fit, dims, moments, k + k * k) / self.n
        return float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())


OUT = ("id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, "
       "eigenvalue double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, eigenvalue) per kept row and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), grid(F.col(f"`{vector_col}`")).alias("x")).where("x IS NOT NULL")
    length = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if length is None:
        return spark.createDataFrame([], OUT)
    dims = length.dims
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} entries; the covariance of at most {MOST_DIMS} fits the driver")
    rows = rows.where(F.size("x") == dims)
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    model = Whitening.fit(fit, dims, most)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], OUT)
    error = model.identity_error(fit, dims)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column("x"), dims)
                rows_of = np.repeat(np.arange(len(x)), k)
                yield pa.record_batch({
                    "id": part.column("id").take(pa.array(rows_of)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(rows_of), model.n)),
                    "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(rows_of)),
                    "whitened": pa.array(model.whitened(x).ravel()),
                    "explained": pa.array(np.tile(model.values / model.trace, len(x))),
                    "identity_error": pa.array(np.full(len(rows_of), error)),
                    "eigenvalue": pa.array(np.tile(model.values, len(x)))})

    return rows.mapInArrow(emit, OUT)
