"""Nearest neighbours by block matrix join with int8 product tiles.

Grid
    Queries are dealt into blocks of ``query_rows`` and candidates into blocks of ``block_rows`` by a hash of the id;
    each (query block, candidate block) pair is one group. A vector is copied once per block of the other side, so
    the join never makes pairs of single rows, and no group grows with the data.

Tiles
    Inside a group each vector x is quantised to int8, x = s * q + e, with the exact norm of the error e. For a tile
    of queries and candidates one integer matrix product gives s_x * s_y * (q_x . q_y), which is off by at most
    |e_x| |s_y q_y| + |s_x q_x| |e_y| + |e_x| |e_y|. Pairs whose upper bound lies below the k-th largest lower bound
    seen by the query are dropped; the others are recomputed in double precision on the original vectors and merged
    into the query's heap of the k best. The k best of all groups are merged by Spark, cut per task first.

The result is exact (recall 1): bounds only skip pairs that cannot be among the k best.

Edge cases: vectors that are null, empty or zero or hold null or non-finite components take no part, nor do null ids;
vectors of different lengths never meet; repeated rows of an id count once, with the best score, and no row meets its
own id; ties go to the smaller id, also among products beyond the range of doubles, which count as infinite; a query without candidates has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sums of this many int8 products stay exact in single precision (127 * 127 * 1024 < 2**24).
EXACT_RUN = 1024
TILE_QUERIES, TILE_ROWS = 256, 4096


def normalised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two to a largest entry in [0.5, 1), and the exponents; bounds then never overflow."""
    exponent = np.frexp(np.abs(x).max(axis=1))[1]
    return np.ldexp(x, -exponent[:, None]), exponent


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, norm of the approximation and norm of the error of each row of a double matrix."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127, 1.0)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.sqrt((near * near).sum(axis=1)), np.sqrt(((x - near) ** 2).sum(axis=1))


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two int8 tiles (runs of columns that single precision holds exactly)."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_RUN):
        out += a[:, at:at + EXACT_RUN].astype(np.float32) @ b[:, at:at + EXACT_RUN].astype(np.float32).T
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products; the same two rows give the same bits wherever they stand.

    A product or sum beyond the range of doubles counts as the infinity of the whole sum's sign.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.multiply(a, b).sum(axis=1)
        over = np.flatnonzero(~np.isfinite(out))
        if len(over):
            (a, i), (b, j) = normalised(a[over]), normalised(b[over])
            out[over] = np.ldexp(np.multiply(a, b).sum(axis=1), i + j)
    return out


def block_best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate id, score): the k best candidates of each query of one group."""
    most = int(np.unique(c_ids, return_counts=True)[1].max(initial=1))
    need = (k + 1) * most  # repeated ids count once, the own id not at all
    scaled, c_exponent = normalised(c)
    qc, c_scale, c_norm, c_err = quantise(scaled)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q_at in range(0, len(q), TILE_QUERIES):
        rows = q[q_at:q_at + TILE_QUERIES]
        own = q_ids[q_at:q_at + TILE_QUERIES]
        scaled, q_exponent = normalised(rows)
        qq, q_scale, q_norm, q_err = quantise(scaled)
        floor = np.full((len(rows), need), -np.inf)  # the largest lower bounds so far
        heap: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c_at in range(0, len(c), TILE_ROWS):
            part = slice(c_at, c_at + TILE_ROWS)
            mid = tile_product(qq, qc[part]) * q_scale[:, None] * c_scale[None, part]
            off = q_err[:, None] * (c_norm + c_err)[None, part] + q_norm[:, None] * c_err[None, part]
            off = off * (1 + 1e-9) + 1e-12 * (q_norm + q_err)[:, None] * (c_norm + c_err)[None, part]
            # as the scores are rounded: to infinity, and to zero with the least positive number of slack per product
            both, slack = q_exponent[:, None] + c_exponent[None, part], c.shape[1] * 5e-324
            with np.errstate(over="ignore", under="ignore"):
                low, high = np.ldexp(mid - off, both) - slack, np.ldexp(mid + off, both) + slack
            cut = min(need, low.shape[1])
            floor = np.partition(np.concatenate(
                (floor, np.partition(low, low.shape[1] - cut, axis=1)[:, low.shape[1] - cut:]), axis=1), cut, axis=1)[:, cut:]
            i, j = np.nonzero((high >= floor.min(axis=1)[:, None]) & (own[:, None] != c_ids[None, part]))
            for at in range(0, len(i), 1 << 16):
                a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)] + c_at
                heap.append((a, c_ids[b], exact_scores(rows[a], c[b])))
            if sum(len(h[0]) for h in heap) > 4 * k * len(rows) + (1 << 16):
                heap = [merge_best(heap, k)]
        a, ids, scores = merge_best(heap, k)
        out.append((a + q_at, ids, scores))
    return tuple(np.concatenate(x) for x in zip(*out))


def merge_best(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct ids per query of several lists."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    a, ids, scores = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((-scores, ids, a))
    a, ids, scores = a[order], ids[order], scores[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (ids[1:] != ids[:-1])
    a, ids, scores = a[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, a))
    a, ids, scores = a[order], ids[order], scores[order]
    start = np.searchsorted(a, a)
    near = np.arange(len(a)) - start < k
    return a[near], ids[near], scores[near]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    whole = column.combine_chunks()
    flat = whole.flatten() if isinstance(whole, pa.ListArray) else pa.concat_arrays([c.flatten() for c in whole.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, width) of the vectors that take part."""
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
            .where(F.col("id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
            .withColumn("width", F.size("vector")))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
            query_rows: int = 8192, block_rows: int = 16384) -> DataFrame:
    """(query_id, rank, id, score): the k rows of ``vectors`` with the largest inner product for each query row."""
    q, c = usable(queries, id_col, vector_col), usable(vectors, id_col, vector_col)
    q_blocks = max(1, -(-q.count() // query_rows))
    c_blocks = max(8, -(-c.count() // block_rows))
    side = lambda df, blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = q.select("id", "vector", "width", side(q, q_blocks).alias("qb"), every(c_blocks).alias("cb"))
    c = c.select("id", "vector", "width", side(c, c_blocks).alias("cb"), every(q_blocks).alias("qb"))
    keys = ["width", "qb", "cb"]

    def best(key, left: pa.Table, right: pa.Table) -> pa.Table:
        width = key[0].as_py()
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        ids, own = right.column("id").to_numpy(), left.column("id").to_numpy()
        at, found, scores = block_best(own, matrix(left.column("vector"), width), ids,
                                       matrix(right.column("vector"), width), k)
        return pa.table({"query_id": own[at], "id": found, "score": scores})

    parts = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(best, "query_id bigint, id bigint, score double")
    once = parts.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")
