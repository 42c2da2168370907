"""Nearest neighbours over dense vectors: exact block join, inverted cells, sign hashing.

All share one kernel. Query and base rows that may meet are put into cells; a cell larger
than a block is cut into blocks on both sides, so that no task ever holds more than two blocks,
and each pair of blocks sends on only its own best k per query. Ids a query must not get (`skip`)
are left out inside the kernel, so k good ones are found whenever there are so many. Null vectors and
such with null or non-finite numbers take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import doubles, has_bad_value, l2_normalise, nan_to_zero, norm
from ..session import SMALL_BYTES, cut_lineage, fits, parallelism, spread
from .ordering import top_k

SCORE_DIGITS = 6          # scores are rounded before ranking, so that summation order cannot flip a rank
BLOCK_BYTES = 32 * 1024 * 1024
STRIPE_BYTES = 128 * 1024 * 1024  # queries a task holds while the base passes by, at most about
STRIPE_ROWS = 4096        # fewer queries are not worth a stripe
PIECE_ROWS = 1 << 14      # base rows that meet the queries of a stripe at a time
STRIP_CELLS = 4_000_000   # score cells held at a time inside a task
_OUT = "query_id bigint, id bigint, score double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), -1)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def best_per_row(scores: np.ndarray, ids: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of the best k[r] scores of each row r; ties by smaller id."""
    width = scores.shape[1]
    most = min(int(k.max()), width)
    keep = np.isfinite(scores)
    if most < width:
        edge = np.partition(scores, width - most, axis=1)[:, width - most]
        keep &= scores >= edge[:, None]
    rows, cols = np.nonzero(keep)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(scores.shape[0]))
    wanted = np.arange(len(rows)) - starts[rows] < k[rows]
    return rows[wanted], cols[wanted]


def _scored(q: np.ndarray, v: np.ndarray, metric: str, digits: int) -> np.ndarray:
    scores = q @ v.T
    if metric == "l2":  # negative squared distance
        scores = 2 * scores - (q * q).sum(1)[:, None] - (v * v).sum(1)[None, :]
        np.minimum(scores, 0.0, out=scores)
    return np.round(scores, digits) + 0.0


def _scored_pairs(q: np.ndarray, rows: np.ndarray, v: np.ndarray, cols: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """`_scored` of given pairs only."""
    a, b = q[rows], v[cols]
    scores = np.einsum("ij,ij->i", a, b)
    if metric == "l2":
        scores = np.minimum(2 * scores - (q * q).sum(1)[rows] - (v * v).sum(1)[cols], 0.0)
    return np.round(scores, digits) + 0.0


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1.0)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a list column one after another, and the row each belongs to; null is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0)]).astype(np.int64)
    return flat, np.repeat(np.arange(len(sizes)), sizes)


def _left_out(v_ids: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (row, id) pairs as (row, place in `v_ids`), by row; an id may be at several places or none."""
    order = np.argsort(v_ids, kind="stable")
    low, high = (np.searchsorted(v_ids[order], ids, side=s) for s in ("left", "right"))
    n = high - low
    cols = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    rows = np.repeat(rows, n)
    by_row = np.argsort(rows, kind="stable")
    return rows[by_row], cols[by_row]


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`np.nonzero` of a mask with few places set: eight cells are looked at as one number first."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    word, bit = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    at = np.concatenate([words[word] * 8 + bit, whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, mask.shape[1])


class _Screen:
    """Which base rows can be among the best of a query, told from single precision products and a bound of their error."""

    def __init__(self, q: np.ndarray, v: np.ndarray, metric: str, digits: int):
        if metric == "l2":  # the squared size of the query does not change its order
            q, v = np.c_[2 * q, np.ones(len(q))], np.c_[v, -(v * v).sum(1)]
        longest = np.linalg.norm(v, axis=1).max(initial=0.0)
        size = np.linalg.norm(q, axis=1)
        # Twice the error of a product, and what rounding to `digits` can make equal.
        self.slack = 4 * (q.shape[1] + 8) * 2.0 ** -24 * size * longest + 1.01 * 10.0 ** -digits
        self.usable = bool(max(longest, size.max(initial=0.0)) < 1e18)
        if self.usable:
            self.q, self.v = q.astype(np.float32), np.ascontiguousarray(v.astype(np.float32).T)

    def candidates(self, part: slice, most: int, out: tuple[np.ndarray, np.ndarray], floor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, place) of all that can be among the best `most` of the queries in `part`; None if these are too many to be worth it."""
        scores = self.q[part] @ self.v
        n, width = scores.shape
        scores[out] = -np.inf
        slack = self.slack[part]
        looked = min(width, max(most, math.isqrt(10 * most * width)))
        least = np.full(n, -np.inf)
        if floor is not None:
            least = floor
        if floor is None or not np.isfinite(floor).all():
            edge = np.partition(scores[:, :looked], looked - most, axis=1)[:, looked - most]
            least = np.maximum(least, edge)
        limit = least - slack
        limit32 = np.nextafter(limit.astype(np.float32), np.float32(-np.inf))
        rows, cols = _places(scores >= limit32[:, None])
        if len(rows) * 8 > scores.size:
            return None
        kept = scores[rows, cols]
        counts = np.bincount(rows, minlength=n)
        deepest = int(counts.max(initial=0))
        if deepest > most:
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            lined = np.full((n, deepest), -np.inf, np.float32)
            lined[rows, nth] = kept
            edge = np.partition(lined, deepest - most, axis=1)[:, deepest - most]
            good = kept >= (edge - slack)[rows]
            rows, cols, kept = rows[good], cols[good], kept[good]
        good = kept > -np.inf
        return rows[good], cols[good]


def _block_best(q_ids, q, k, v_ids, v, metric, skip_self, digits, skip, barred=None, floor=None):
    """(query ids, base ids, scores, query rows) of the best k per query between two blocks.

    `skip` holds ids and the query rows that must not get them; `barred` the owner of each query row, and owners with
    the base rows these must not get. What scores below `floor`, by query row, may be left out. Where few of many can be
    among the best, these are found in single precision and scored in double precision.
    """
    if metric == "cosine":
        q, v = _unit(q), _unit(v)
    most = min(int(k.max(initial=0)), len(v_ids))
    screen = _Screen(q, v, metric, digits) if 0 < 16 * most < len(v_ids) and len(v_ids) >= 1024 else None
    ids, of = skip
    if skip_self:
        ids, of = np.concatenate([ids, q_ids]), np.concatenate([of, np.arange(len(q_ids))])
    out_rows, out_cols = _left_out(v_ids, ids, of)
    if barred is not None:
        owner, owners, places = barred
        by_owner = np.argsort(owners, kind="stable")
        owners, places = owners[by_owner], places[by_owner]
    strip = max(1, STRIP_CELLS // max(1, len(v_ids)))
    found = [(q_ids[:0], v_ids[:0], np.zeros(0), np.zeros(0, np.int64))]
    for at in range(0, len(q_ids) if most else 0, strip):
        part = slice(at, at + strip)
        n = len(q_ids[part])
        some = slice(*np.searchsorted(out_rows, [at, at + n]))
        out = out_rows[some] - at, out_cols[some]
        if barred is not None:
            low, high = (np.searchsorted(owners, owner[part], side=s) for s in ("left", "right"))
            many = high - low
            more = places[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            out = np.r_[out[0], np.repeat(np.arange(n), many)], np.r_[out[1], more]
        pairs = None
        if screen is not None and screen.usable:
            low = None if floor is None else floor[part] + ((q[part] * q[part]).sum(1) if metric == "l2" else 0.0)
            pairs = screen.candidates(part, most, out, low)
        if pairs is None:
            scores = _scored(q[part], v, metric, digits)
            scores[out] = -np.inf
            rows, cols = best_per_row(scores, v_ids, k[part])
            score = scores[rows, cols]
        else:
            rows, cols = pairs
            score = _scored_pairs(q[part], rows, v, cols, metric, digits)
            ranked = np.lexsort((v_ids[cols], -score, rows))
            rows, cols, score = rows[ranked], cols[ranked], score[ranked]
            starts = np.searchsorted(rows, np.arange(n))
            wanted = (np.arange(len(rows)) - starts[rows] < k[part][rows]) & np.isfinite(score)
            rows, cols, score = rows[wanted], cols[wanted], score[wanted]
        found.append((q_ids[part][rows], v_ids[cols], score, rows + at))
    return [np.concatenate(x) for x in zip(*found)]


def _result(q_ids, v_ids, scores) -> pa.Table:
    return pa.table({"query_id": pa.array(q_ids, pa.int64()), "id": pa.array(v_ids, pa.int64()),
                     "score": pa.array(scores, pa.float64())})


_NOTHING = _result([], [], [])


def _queries(queries: DataFrame, k: int | str, skip: str | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """The query side, written once: its size is checked, it is searched with, and joined to the result."""
    wanted = F.col(k) if isinstance(k, str) else F.lit(k)
    return cut_lineage(_sound(queries).select(F.col("query_id").cast("bigint"), doubles(F.col("vec")).alias("vec"), wanted.cast("int").alias("k"),
                                              (F.col(skip) if skip else F.lit(None)).cast("array<bigint>").alias("skip"), *others))


def _sound(df: DataFrame) -> DataFrame:
    return df.filter(F.col("vec").isNotNull() & ~has_bad_value(F.col("vec")))


def _base(base: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    return _sound(base).select(F.col("id").cast("bigint"), doubles(F.col("vec")).alias("vec"), *others)


def _dimension(df: DataFrame) -> int:
    first = df.select(F.size("vec")).first()
    return first[0] if first else 1


def _against_small(queries: DataFrame, base: DataFrame, metric: str, skip_self: bool, digits: int) -> DataFrame:
    """Queries of proven small size travel as one matrix; the base is scanned in place, unshuffled."""
    rows = queries.toArrow()
    if rows.num_rows == 0:
        return queries.sparkSession.createDataFrame([], _OUT)
    packed = (_numbers(rows["query_id"]), _matrix(rows["vec"]), _numbers(rows["k"]), _lists(rows["skip"]))
    shared = queries.sparkSession.sparkContext.broadcast(packed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, k, skip = shared.value
        order = np.argsort(q_ids, kind="stable")
        limit = k[order]
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data = pa.Table.from_batches([batch])
            new = _block_best(q_ids, q, k, _numbers(data["id"]), _matrix(data["vec"]), metric, skip_self, digits, skip)[:3]
            best = new if best is None else [np.concatenate(x) for x in zip(best, new)]
            ranked = np.lexsort((best[1], -best[2], best[0]))
            best = [x[ranked] for x in best]
            starts = np.searchsorted(best[0], q_ids[order])
            place = np.searchsorted(q_ids[order], best[0])
            keep = np.arange(len(best[0])) - starts[place] < limit[place]
            best = [x[keep] for x in best]
        if best is not None:
            yield from _result(*best).to_batches()

    return base.mapInArrow(scan, _OUT)


def _in_cells(queries: DataFrame, base: DataFrame, metric: str, skip_self: bool, digits: int,
              block_rows: int) -> DataFrame:
    """Best k per query inside the cells both sides name; large cells become several blocks.

    The number of cells is a parameter of the caller, so the table of block counts is small.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias(name))

    owner, barred = (["owner"], ["barred"]) if "owner" in queries.columns else ([], [])
    counts = F.broadcast(blocks(queries, "q_blocks").join(blocks(base, "v_blocks"), "cell"))

    def own(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (queries.join(counts, "cell").withColumn("qb", own("query_id", "q_blocks"))
            .withColumn("vb", every("v_blocks")).select("cell", "qb", "vb", "query_id", "vec", "k", "skip", *owner))
    right = (base.join(counts, "cell").withColumn("vb", own("id", "v_blocks"))
             .withColumn("qb", every("q_blocks")).select("cell", "qb", "vb", "id", "vec", *barred))

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        if q.num_rows == 0 or v.num_rows == 0:
            return _NOTHING
        not_to = (_numbers(q["owner"]), *_lists(v["barred"])) if owner else None
        return _result(*_block_best(_numbers(q["query_id"]), _matrix(q["vec"]), _numbers(q["k"]), _numbers(v["id"]),
                                    _matrix(v["vec"]), metric, skip_self, digits, _lists(q["skip"]), not_to)[:3])

    cell = ["cell", "qb", "vb"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(meet, _OUT)


def _in_stripes(queries: DataFrame, base: DataFrame, metric: str, skip_self: bool, digits: int, stripes: int) -> DataFrame:
    """Best k per query: the task of a stripe holds its queries and meets the base piece by piece.

    A query is sent once, with what it skips; a base row once per stripe. No more leaves a stripe than its result.
    """
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(stripes)).cast("int").alias("stripe"), F.lit(0).alias("side"),
                           F.col("query_id").alias("id"), "vec", "k", "skip")
    given = base.select(F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(1).alias("side"), "id", "vec",
                        F.lit(None).cast("int").alias("k"), F.lit(None).cast("array<bigint>").alias("skip"))
    placed = asked.unionByName(given).repartitionById(stripes, F.col("stripe")).sortWithinPartitions("side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pieces, waiting, stripe = [], [], 0, None
        for batch in batches:
            n = pc.sum(pc.equal(batch["side"], 0)).as_py() or 0
            if n:
                own.append(batch.slice(0, n))
            if n < batch.num_rows and own:  # without queries there is nothing to find
                stripe = stripe or _Queries(pa.Table.from_batches(own), metric, skip_self, digits)
                pieces.append(batch.slice(n))
                waiting += batch.num_rows - n
                if waiting >= PIECE_ROWS:
                    stripe.meet(pa.Table.from_batches(pieces))
                    pieces, waiting = [], 0
        if pieces:
            stripe.meet(pa.Table.from_batches(pieces))
        if stripe is not None:
            yield from _result(*stripe.found()).to_batches(max_chunksize=200_000)

    return placed.mapInArrow(search, _OUT)


class _Queries:
    """The queries of a stripe and the best found so far for each."""

    def __init__(self, rows: pa.Table, metric: str, skip_self: bool, digits: int):
        self.ids, self.k = _numbers(rows["id"]), _numbers(rows["k"]).astype(np.int64)
        self.vec, self.skip = _matrix(rows["vec"]), _lists(rows["skip"])
        self.how = metric, skip_self, digits
        self.floor = np.full(len(self.ids), -np.inf)
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, base: pa.Table) -> None:
        _, ids, score, row = _block_best(self.ids, self.vec, self.k, _numbers(base["id"]), _matrix(base["vec"]), *self.how, self.skip,
                                         floor=self.floor)
        good = score >= self.floor[row]
        row, ids, score = np.r_[self.row, row[good]], np.r_[self.id, ids[good]], np.r_[self.score, score[good]]
        ranked = np.lexsort((ids, -score, row))
        row, ids, score = row[ranked], ids[ranked], score[ranked]
        nth = np.arange(len(row)) - np.searchsorted(row, np.arange(len(self.ids)))[row]
        kept = nth < self.k[row]
        self.row, self.id, self.score, nth = row[kept], ids[kept], score[kept], nth[kept]
        last = nth == self.k[self.row] - 1
        self.floor[self.row[last]] = self.score[last]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[self.row], self.id, self.score


def _ranked(found: DataFrame, queries: DataFrame, k: int | str, metric: str, min_score: float | None) -> DataFrame:
    if min_score is not None:
        found = found.filter(F.col("score") >= min_score)
    limit = k
    if isinstance(k, str):
        found = found.join(queries.select("query_id", F.col("k").alias("_k")), "query_id")
        limit = F.col("_k")
    out = top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], limit)
    if metric == "l2":
        out = out.withColumn("squared_distance", -F.col("score")).withColumn("distance", F.sqrt(-F.col("score")))
        return out.select("query_id", "id", "squared_distance", "distance", "rank")
    return out.select("query_id", "id", "score", "rank")


def nearest(queries: DataFrame, base: DataFrame, k: int | str, metric: str = "cosine", skip_self: bool = False,
            min_score: float | None = None, digits: int = SCORE_DIGITS, block_rows: int | None = None,
            skip: str | None = None) -> DataFrame:
    """Exact best k of `base(id, vec)` for each of `queries(query_id, vec)`.

    `metric`: cosine, dot, or l2 (squared and true distance are returned). `k` is a number or the
    name of an integer column of `queries`. Queries that fit a broadcast are matched without
    shuffling the base; more are cut into stripes, and the base passes by each. `block_rows` forces the block path, with blocks of
    at least so many rows.
    `skip` names an array column of `queries` with ids that query must not get.
    """
    q, v = _queries(queries, k, skip), _base(base)
    row_bytes = 8 * max(1, _dimension(q)) + 16
    if skip or isinstance(k, str):  # what a task keeps per query counts too: its list, and the ids it skips
        mean = q.agg(F.coalesce(F.avg(F.coalesce(F.size("skip"), F.lit(0)) + 3 * F.col("k")), F.lit(0.0))).first()[0]
        row_bytes += 8 * int(mean)
    if block_rows is None and fits(q, row_bytes, SMALL_BYTES // 4):
        return _ranked(_against_small(q, spread(v), metric, skip_self, digits), q, k, metric, min_score)
    rows = max(1024, BLOCK_BYTES // row_bytes)
    if block_rows is None:
        n, v = q.count(), cut_lineage(v)  # a base row is worked out once, then sent to every stripe
        stripes = max(1, -(-n * row_bytes // STRIPE_BYTES), min(4 * parallelism(q.sparkSession), -(-n // STRIPE_ROWS)))
        return _ranked(_in_stripes(q, v, metric, skip_self, digits, stripes), q, k, metric, min_score)
    if block_rows:  # blocks as small as asked for, but no more of them than keep the cores busy: each row is sent once per block of the others
        side = math.ceil(math.sqrt(4 * parallelism(q.sparkSession)))
        rows = max(block_rows, min(rows, -(-max(q.count(), v.count()) // side)))
    found = _in_cells(q.withColumn("cell", F.lit(0)), v.withColumn("cell", F.lit(0)),
                      metric, skip_self, digits, rows)
    return _ranked(found, q, k, metric, min_score)


def train_cells(base: DataFrame, n_cells: int = 100, seed: int = 42, max_iter: int = 20) -> np.ndarray:
    """Centroids (n_cells x dimension) of a k-means over the base vectors."""
    features = base.select(array_to_vector(doubles(F.col("vec"))).alias("features")).persist()
    try:
        model = KMeans(k=n_cells, seed=seed, maxIter=max_iter).fit(features)
    finally:
        features.unpersist()
    return np.vstack(model.clusterCenters())


def _with_cells(df: DataFrame, centroids: np.ndarray, probes: int, schema: str) -> DataFrame:
    """One row per vector and nearest cell, `probes` cells each."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data = pa.Table.from_batches([batch])
            strip = max(1, STRIP_CELLS // len(cells))
            for at in range(0, batch.num_rows, strip):
                part = data.slice(at, strip)
                scores = _scored(_matrix(part["vec"]), cells, "l2", 12)
                rows, cols = best_per_row(scores, np.arange(len(cells)), np.full(part.num_rows, probes))
                out = part.take(pa.array(rows)).append_column("cell", pa.array(cols, pa.int32()))
                yield from out.to_batches()

    return df.mapInArrow(assign, schema)


_Q_SCHEMA = "query_id bigint, vec array<double>, k int, skip array<bigint>, cell int"
_V_SCHEMA = "id bigint, vec array<double>, cell int"


def nearest_in_cells(queries: DataFrame, base: DataFrame, k: int, centroids: np.ndarray, probes: int = 8,
                     metric: str = "cosine", skip_self: bool = False, min_score: float | None = None,
                     digits: int = SCORE_DIGITS, block_rows: int | None = None, skip: str | None = None) -> DataFrame:
    """Approximate best k: each query looks into its `probes` nearest cells only.

    With cosine, vectors are brought to unit length first and so must those the cells were trained on.
    """
    q, v = _queries(queries, k, skip), _base(base)
    if metric == "cosine":
        q, v = (d.withColumn("vec", l2_normalise(F.col("vec"))) for d in (q, v))
    probes = min(probes, len(centroids))
    rows = block_rows or max(1024, BLOCK_BYTES // (8 * centroids.shape[1] + 16))
    lists = cut_lineage(_with_cells(spread(v), centroids, 1, _V_SCHEMA))  # counted, then searched
    found = _in_cells(cut_lineage(_with_cells(q, centroids, probes, _Q_SCHEMA)), lists, metric, skip_self, digits, rows)
    return _ranked(found, q, k, metric, min_score)


def bits_for(n: int, rows: int = 64) -> int:
    """Signs per table so that a cell has about `rows` of n vectors."""
    return min(40, max(1, math.ceil(math.log2(max(2.0, n / rows)))))


def nearest_by_hash(queries: DataFrame, base: DataFrame, k: int, tables: int | None = None, bits: int | None = None, seed: int = 42,
                    metric: str = "cosine", skip_self: bool = False, min_score: float | None = None,
                    digits: int = SCORE_DIGITS, block_rows: int | None = None) -> DataFrame:
    """Approximate best k by sign hashing: vectors meet where all signs of one table agree.

    Unset, `bits` follow the number of vectors, so that cells keep their size, and there are three tables per bit.
    """
    q, v = _queries(queries, k), _base(base)
    bits = bits_for(v.count()) if bits is None else bits
    tables = 3 * bits if tables is None else tables
    dim = _dimension(q)
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    shared = q.sparkSession.sparkContext.broadcast(planes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data = pa.Table.from_batches([batch])
            positive = (_matrix(data["vec"]) @ shared.value > 0).reshape(-1, tables, bits)
            codes = (positive * powers).sum(2) + np.arange(tables) * (1 << bits)
            out = data.take(pa.array(np.repeat(np.arange(batch.num_rows), tables)))
            yield from out.append_column("cell", pa.array(codes.ravel(), pa.int64())).to_batches()

    rows = block_rows or max(1024, BLOCK_BYTES // (8 * dim + 16))
    wide = [s.replace("cell int", "cell bigint") for s in (_Q_SCHEMA, _V_SCHEMA)]
    found = _in_cells(cut_lineage(q.mapInArrow(sign, wide[0])), cut_lineage(spread(v).mapInArrow(sign, wide[1])),
                      metric, skip_self, digits, rows)
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return _ranked(once, q, k, metric, min_score)


def nearest_within(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", skip: str | None = None,
                   digits: int = SCORE_DIGITS, block_rows: int | None = None, barred: bool = False) -> DataFrame:
    """Exact best k among the rows of `base(id, vec, cell)` that share a cell with the query.

    A query (or a base row) may be in several cells, as several rows. With `barred`, queries have an `owner`, a number that
    many may share, and base rows the owners that must not get them, an array `barred`: sent once per base row, not per query.
    """
    q = _queries(queries, k, skip, ("cell", "owner") if barred else ("cell",))
    v = cut_lineage(_base(base, ("cell", "barred") if barred else ("cell",)))
    rows = block_rows or max(1024, BLOCK_BYTES // (8 * max(1, _dimension(q)) + 16))
    found = _in_cells(q, v, metric, False, digits, rows)
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return _ranked(once, q, k, metric, None)


def lookup_vectors(ids: DataFrame, base: DataFrame) -> DataFrame:
    """Stored vectors of the given ids."""
    return ids.select("id").join(base, "id")


def drop_zero_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.filter(norm(F.col("vec")) > 0)


def mend_zero_vectors(vectors: DataFrame, seed: int = 42) -> DataFrame:
    """Zero vectors become small repeatable noise in [1e-6, 1e-5]; the others stay."""
    def noise(x: Column, i: Column) -> Column:
        part = F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1_000_003)) / 1_000_003
        return F.lit(1e-6) + part * 9e-6

    vec = doubles(F.col("vec"))
    return vectors.withColumn("vec", F.when(norm(F.col("vec")) > 0, vec).otherwise(F.transform(vec, noise)))


def add_vectors(base: DataFrame, new: DataFrame, bad: str = "refuse") -> DataFrame:
    """Base plus the new vectors whose id is absent. Empty vectors are refused; those with NaN or null values too, or these become 0 (`bad="zero"`)."""
    if bad == "zero":
        new = new.withColumn("vec", nan_to_zero(doubles(F.col("vec"))))
    good = new.filter((F.size("vec") > 0) & ~has_bad_value(F.col("vec")))
    return base.unionByName(good.join(base, "id", "left_anti").select(*base.columns))


def vector_set_stats(vectors: DataFrame, original_dim: int | None = None) -> DataFrame:
    """Count, dimension, bytes as flat float32, and ratio to a set of dimension `original_dim`."""
    out = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).cast("bigint").alias("dim"))
    size = (F.col("n") * F.col("dim") * 4).alias("bytes")
    ratio = F.col("dim") / F.lit(original_dim) if original_dim else F.lit(1.0)
    return out.select("n", "dim", size, ratio.cast("double").alias("ratio"))


def validate_vectors(vectors: DataFrame) -> DataFrame:
    """One row of violation counts: duplicate and null ids, bad values, norms other than 1."""
    copies = vectors.groupBy("id").agg(F.count("*").alias("_n"))
    duplicates = copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
    off = F.abs(norm(F.col("vec")) - 1) > 1e-3
    return vectors.agg(
        F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("null_ids"),
        F.count_if(has_bad_value(F.col("vec"))).alias("bad_values"), F.count_if(off).alias("not_unit"),
        F.count_if(norm(F.col("vec")) == 0).alias("zero_vectors")).select(
        "n", duplicates.alias("duplicate_ids"), "null_ids", "bad_values", "not_unit", "zero_vectors")


def cells_for(n_rows: int) -> int:
    """A usual number of cells: the square root of the rows."""
    return max(1, int(math.sqrt(n_rows)))
