"""Nearest neighbours by a block matrix join on 8-bit vectors with proven error bounds.

Queries are cut into blocks and candidates into strips, both of bounded size; every pair of a block
and a strip is one group. Inside a group each vector is a scale times 8-bit whole numbers plus an error of known
length, so a product of two tiles gives every distance within the sum of two errors. A pair stays
only if its lower bound is not above the k-th smallest upper bound of its query. Pairs that
stay are measured again on the original vectors in double precision, and a heap per query keeps the k best
of the strip. Spark merges the strips. The result is exact, ties included.

Rows sent: candidates times query blocks, queries times strips; rows back: k per query and strip.

Defined results: vectors that are null, empty, all zero or hold a null or a non-finite number take no part;
vectors are compared with those of the same length; repeated candidate ids are different rows, query rows of one id share
one list, and a row is never a neighbour of a query with its own id; fewer candidates than k give fewer rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_BLOCK, STRIP = 4096, 16384
_TILE_ROWS, _TILE_COLUMNS = 512, 2048


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec, dim) of the rows that take part; numbers as doubles."""
    vec = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("id"), vec.alias("vec")).filter(F.col("vec").isNotNull())

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return (rows.filter(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))
            .withColumn("dim", F.size("vec")))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit whole numbers, scale, squared length of the scaled numbers, length of the error."""
    largest = np.abs(x).max(axis=1)
    scale = np.where(largest > 0, largest / 127.0, 1.0)
    small = np.rint(x / scale[:, None])
    kept = small * scale[:, None]
    return small.astype(np.int8), scale, np.einsum("ij,ij->i", kept, kept), np.linalg.norm(x - kept, axis=1)


def _distances(left: np.ndarray, rows: np.ndarray, right: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Distances of given pairs; squares are added in the order of the components."""
    total = np.zeros(len(rows))
    for j in range(left.shape[1]):
        gap = left[rows, j] - right[columns, j]
        total += gap * gap
    return np.sqrt(total)


def nearest_in_strip(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """The k nearest of a strip for each query: rows (query number, id, distance)."""
    q8, qs, qn, qe = _quantised(queries)
    v8, vs, vn, ve = _quantised(vectors)
    exact32 = queries.shape[1] * 127 * 127 < 1 << 24  # then whole numbers stay whole in float32
    kind = np.float32 if exact32 else np.float64
    out: list[tuple[int, int, float]] = []
    for a in range(0, len(queries), _TILE_ROWS):
        b = min(len(queries), a + _TILE_ROWS)
        heaps: list[list] = [[] for _ in range(b - a)]  # the k best so far, worst on top
        limit = np.full(b - a, np.inf)
        left = q8[a:b].astype(kind)
        for c in range(0, len(vectors), _TILE_COLUMNS):
            d = min(len(vectors), c + _TILE_COLUMNS)
            product = (left @ v8[c:d].astype(kind).T).astype(np.float64)
            product *= -2.0 * qs[a:b, None] * vs[None, c:d]
            product += qn[a:b, None]
            product += vn[None, c:d]
            near = np.sqrt(np.maximum(product, 0))
            slack = 1e-7 * (near + np.sqrt(qn[a:b, None]) + np.sqrt(vn[None, c:d])) + qe[a:b, None] + ve[None, c:d]
            own = ids[None, c:d] == query_ids[a:b, None]
            upper = np.where(own, np.inf, near + slack)
            if d - c > k:
                limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1])
            keep = ((near - slack) <= limit[:, None]) & ~own
            rows, columns = np.nonzero(keep)
            exact = _distances(queries, a + rows, vectors, c + columns)
            for r, i, distance in zip(rows.tolist(), ids[c + columns].tolist(), exact.tolist()):
                heap = heaps[r]
                if len(heap) < k:
                    heapq.heappush(heap, (-distance, -i))
                elif (-distance, -i) > heap[0]:
                    heapq.heapreplace(heap, (-distance, -i))
            full = [r for r in range(b - a) if len(heaps[r]) == k]
            limit[full] = np.minimum(limit[full], [-heaps[r][0][0] for r in full])
        out += [(a + r, -i, -distance) for r, heap in enumerate(heaps) for distance, i in heap]
    return out


def nearest_neighbours(queries: DataFrame, base: DataFrame, id_column: str, vector_column: str, k: int = 10,
                       query_block: int = QUERY_BLOCK, strip: int = STRIP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `base` by Euclidean distance, ties to the smaller id."""
    asked, held = usable(queries, id_column, vector_column), usable(base, id_column, vector_column)
    blocks = max(1, -(-asked.count() // query_block))
    strips = max(1, -(-held.count() // strip))

    def dealt(df: DataFrame, is_query: bool) -> DataFrame:
        own, other = (blocks, strips) if is_query else (strips, blocks)
        mine = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        placed = df.withColumn("_own", mine).withColumn("_other", every)
        names = ("_own", "_other") if is_query else ("_other", "_own")
        return placed.select("dim", F.col(names[0]).alias("block"), F.col(names[1]).alias("strip"),
                             F.lit(is_query).alias("asks"), "id", "vec")

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        dim = table.column("dim")[0].as_py()
        flat = table.column("vec").combine_chunks()
        vectors = np.asarray(flat.flatten()).reshape(len(ids), dim)
        found = []
        if asks.any() and not asks.all():
            found = nearest_in_strip(ids[asks], vectors[asks], ids[~asks], vectors[~asks], k)
        at = np.array([f[0] for f in found], dtype=np.int64)
        return pa.table({"query_row": pa.array(at), "query_id": pa.array(ids[asks][at] if len(at) else at),
                         "vec_id": pa.array([f[1] for f in found], pa.int64()),
                         "score": pa.array([f[2] for f in found], pa.float64()), "block": pa.array(
                             [table.column("block")[0].as_py()] * len(found), pa.int32())})

    pairs = dealt(asked, True).unionByName(dealt(held, False))
    found = pairs.groupBy("dim", "block", "strip").applyInArrow(
        search, "query_row long, query_id long, vec_id long, score double, block int")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
