"""Matrix operators on long-form entries `(id, idx, value)` and on vector rows `(id, vec)`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import doubles, scale, sum_vector
from ..session import SMALL_BYTES, cut_lineage, fits, parallelism

GRAM_COLUMNS = 4096   # up to this width the matrix of column products is summed exactly (128 MB)
SHORT_ROWS = 4        # rows with at most this many products per entry: their column products are summed once, as a sparse matrix
PAIR_COST = 2500      # dense products that take the time of one product of two entries
OVERSAMPLE = 10
TOLERANCE = 1e-7      # of a residual, as a share of the largest value of the product
ENTRY_BYTES = 12      # of a matrix that is sent whole
GUARDS = 24           # directions beyond the wanted ones in a filtered subspace
FILTER_STEPS = 40     # products with a column between two looks at the subspace, at most
_STRIP = 1024


# ---- centring and scaling of long-form matrices -------------------------------------------------

def average_duplicates(ratings: DataFrame, how: str = "avg") -> DataFrame:
    """One row per (user, item): mean, sum, or last rating by time."""
    ways = {"avg": F.avg("rating"), "sum": F.sum("rating"), "last": F.max_by("rating", "ts")}
    return ratings.groupBy("user_id", "item_id").agg(ways[how].alias("rating"))


def mean_centre(ratings: DataFrame, key: str = "user_id") -> DataFrame:
    """Add `centred`: rating less the mean of its user (or item), rated cells only."""
    means = ratings.groupBy(key).agg(F.avg("rating").alias("_mean"))
    return ratings.join(means, key).withColumn("centred", F.col("rating") - F.col("_mean")).drop("_mean")


def user_z_scores(ratings: DataFrame) -> DataFrame:
    """Add `z`: rating standardised by its user's mean and sample deviation (0 or none counts as 1)."""
    stats = ratings.groupBy("user_id").agg(F.avg("rating").alias("mean"), F.stddev_samp("rating").alias("std"))
    std = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return (ratings.join(stats, "user_id").withColumn("z", (F.col("rating") - F.col("mean")) / std)
            .drop("mean", "std"))


def normalise_rows(ratings: DataFrame, how: str = "l2") -> DataFrame:
    """Add `scaled`: rating over the l1 or l2 norm of its user's row."""
    size = F.sum(F.abs("rating")) if how == "l1" else F.sqrt(F.sum(F.col("rating") * F.col("rating")))
    sizes = ratings.groupBy("user_id").agg(size.alias("_size"))
    value = F.when(F.col("_size") > 0, F.col("rating") / F.col("_size")).otherwise(0.0)
    return ratings.join(sizes, "user_id").withColumn("scaled", value).drop("_size")


def standardise_columns(ratings: DataFrame, n_rows: Column) -> tuple[DataFrame, DataFrame]:
    """Zero mean, unit population variance per item over all `n_rows` users, missing cells being 0.

    Returns the filled cells, and per item the value every missing cell takes.
    """
    stats = ratings.groupBy("item_id").agg(
        (F.sum("rating") / n_rows).alias("mean"), (F.sum(F.col("rating") * F.col("rating")) / n_rows).alias("sq"))
    var = F.col("sq") - F.col("mean") * F.col("mean")
    std = F.when(var > 1e-12, F.sqrt(var)).otherwise(1.0)
    stats = stats.select("item_id", "mean", std.alias("std"))
    cells = (ratings.join(stats, "item_id")
             .withColumn("scaled", (F.col("rating") - F.col("mean")) / F.col("std")).drop("mean", "std"))
    return cells, stats.select("item_id", "mean", "std", (-F.col("mean") / F.col("std")).alias("missing_value"))


def pivot_matrix(ratings: DataFrame, items: list) -> DataFrame:
    """Wide user x item table for a short, explicit list of items; missing = 0."""
    return ratings.groupBy("user_id").pivot("item_id", items).agg(F.avg("rating")).na.fill(0)


# ---- truncated SVD --------------------------------------------------------------------------------

def pack_rows(entries: DataFrame) -> DataFrame:
    """`(id, cols, vals)`, one row per matrix row; as long as the matrix is wide at most."""
    cells = entries.groupBy("id").agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"),
                                                              F.col("value").cast("double").alias("value"))).alias("es"))
    return cells.select("id", F.col("es.idx").alias("cols"), F.col("es.value").alias("vals"))


def _csr(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row number of each entry, column, value)."""
    cols, vals = batch.column("cols"), batch.column("vals")
    rows = np.repeat(np.arange(batch.num_rows), cols.value_lengths().to_numpy(zero_copy_only=False))
    return rows, cols.flatten().to_numpy(zero_copy_only=False), vals.flatten().to_numpy(zero_copy_only=False)


def _times(rows, cols, vals, n_rows: int, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    out = np.zeros((n_rows, matrix.shape[1]))
    for at in range(0, len(rows), 200_000):
        part = slice(at, at + 200_000)
        product = vals[part, None] * matrix[cols[part]]
        starts = np.flatnonzero(np.r_[True, np.diff(rows[part]) > 0])
        out[rows[part][starts]] += np.add.reduceat(product, starts, axis=0)
    return out


def _vec_rows(key: str, keys: np.ndarray, matrix: np.ndarray, kind=pa.int32()) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 512):
        part = np.ascontiguousarray(matrix[at:at + 512])
        offsets = np.arange(len(part) + 1, dtype=np.int32) * matrix.shape[1]
        vecs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))
        yield pa.record_batch({key: pa.array(keys[at:at + 512], kind), "vec": vecs})


def _collect_matrix(df: DataFrame, n_rows: int, width: int) -> np.ndarray:
    """Rows `(idx, vec)` of a matrix of checked size on the driver."""
    out = np.zeros((n_rows, width))
    table = df.toArrow()
    if table.num_rows:
        vecs = pa.concat_arrays([c.flatten() for c in table["vec"].chunks]).to_numpy(zero_copy_only=False)
        out[table["idx"].to_numpy()] = vecs.reshape(table.num_rows, width)
    return out


def _sum_rows(partials: DataFrame, width: int) -> DataFrame:
    """Add up `(idx, vec)` rows of equal idx. A task holds its share of a matrix of checked size."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = {}, np.zeros((0, width))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, at = np.unique(batch.column("idx").to_numpy(zero_copy_only=False), return_inverse=True)
            for key in keys.tolist():
                place.setdefault(key, len(place))
            if len(place) > len(total):
                total = np.vstack([total, np.zeros((max(len(place), 2 * len(total)) - len(total), width))])
            where = np.array([place[key] for key in keys.tolist()])
            rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            if len(keys) == batch.num_rows:
                total[where[at]] += rows
            else:
                np.add.at(total, where[at], rows)
        if place:
            yield from _vec_rows("idx", np.fromiter(place, np.int32, len(place)), total[:len(place)])

    return partials.repartition("idx").mapInArrow(add, "idx int, vec array<double>")


def _add_pairs(total: np.ndarray, n: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> None:
    """Add the products of the entries of each row, `n` of them, one by one: for rows of few entries."""
    ends, step = np.cumsum(n * n), 1 << 20
    starts, row = np.cumsum(n) - n, 0
    while row < len(n):
        to = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + step, "right")))
        first, many = starts[row:to], n[row:to]
        each = np.repeat(many, many)  # of each entry: how many its row has
        left = np.repeat(np.arange(first[0], first[0] + many.sum()), each)
        right = np.repeat(np.repeat(first, many) - np.cumsum(each) + each, each) + np.arange(each.sum())
        code, place = np.unique(cols[left].astype(np.int64) * total.shape[1] + cols[right], return_inverse=True)
        total.reshape(-1)[code] += np.bincount(place, vals[left] * vals[right], len(code))
        row = to


def _column_products(packed: DataFrame, n_cols: int) -> np.ndarray:
    """Sum of x xT over all rows: partial sums per partition, added up by matrix row."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_cols, n_cols))
        for batch in batches:
            rows, cols, vals = _csr(batch)
            for at in range(0, batch.num_rows, _STRIP):
                inside = slice(*np.searchsorted(rows, (at, at + _STRIP)))
                n = np.bincount(rows[inside] - at)
                if int((n * n).sum()) * PAIR_COST <= len(n) * n_cols * n_cols:
                    _add_pairs(total, n, cols[inside], vals[inside])
                    continue
                dense = np.zeros((min(_STRIP, batch.num_rows - at), n_cols))
                np.add.at(dense, (rows[inside] - at, cols[inside]), vals[inside])
                total += dense.T @ dense
        used = np.flatnonzero(np.diag(total))
        yield from _vec_rows("idx", used, total[used])

    sums = _sum_rows(packed.mapInArrow(partial, "idx int, vec array<double>"), n_cols)
    return _collect_matrix(sums, n_cols, n_cols)


def _times_transposed(packed: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """XT X M for a small M in one scan of the rows: each partition sums its share of the result."""
    shared = packed.sparkSession.sparkContext.broadcast(matrix)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros(m.shape)
        for batch in batches:
            rows, cols, vals = _csr(batch)
            y = _times(rows, cols, vals, batch.num_rows, m)
            order = np.argsort(cols, kind="stable")
            for at in range(0, len(order), 200_000):
                part = order[at:at + 200_000]
                starts = np.flatnonzero(np.r_[True, np.diff(cols[part]) > 0])
                total[cols[part][starts]] += np.add.reduceat(vals[part, None] * y[rows[part]], starts, axis=0)
        used = np.flatnonzero(np.any(total != 0, axis=1))
        yield from _vec_rows("idx", used, total[used])

    sums = _sum_rows(packed.mapInArrow(partial, "idx int, vec array<double>"), matrix.shape[1])
    try:
        return _collect_matrix(sums, *matrix.shape)
    finally:
        shared.unpersist()


def _sparse_products(packed: DataFrame) -> DataFrame:
    """X'X of rows with few entries as `(id, idx, value)`: it has no more entries than the rows have products."""
    cells = packed.select("cols", "vals", F.posexplode("cols").alias("n", "id"))
    pairs = cells.select("id", F.col("vals")[F.col("n")].alias("x"), F.inline(F.arrays_zip("cols", "vals")))
    return pairs.groupBy("id", F.col("cols").alias("idx")).agg(F.sum(F.col("x") * F.col("vals")).alias("value"))


def _solved_apart(pairs: pa.Table, n_cols: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, values) of the k largest of a symmetric matrix `(id, idx, value)` of few entries: columns that no entries link are solved apart."""
    i, j, x = (pairs[c].to_numpy().astype(kind) for c, kind in (("id", np.int64), ("idx", np.int64), ("value", np.float64)))
    part = np.arange(n_cols)
    while True:
        least = part.copy()
        np.minimum.at(least, i, part[j])
        least = least[least]
        if (least == part).all():
            break
        part = least
    order = np.argsort(part, kind="stable")  # columns by part
    heads = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0, True])
    place = np.empty(n_cols, np.int64)
    place[order] = np.arange(n_cols)
    by_part = np.argsort(place[i], kind="stable")
    i, j, x = place[i][by_part], place[j][by_part], x[by_part]
    edges = np.searchsorted(i, heads)
    alone = np.diff(heads) == 1
    values = np.zeros(n_cols)
    np.add.at(values, i[i == j], x[i == j])  # the value of a part of one column
    turns = {}
    for n in np.flatnonzero(~alone):
        own, cells = slice(heads[n], heads[n + 1]), slice(edges[n], edges[n + 1])
        block = np.zeros((own.stop - own.start,) * 2)
        block[i[cells] - own.start, j[cells] - own.start] = x[cells]
        values[own], turn = np.linalg.eigh((block + block.T) / 2)
        turns[n] = turn[:, -k:]  # ascending: no more than k of a part are wanted
    best = np.argsort(-values, kind="stable")[:k]
    v = np.zeros((n_cols, k))
    of = np.searchsorted(heads, best, "right") - 1
    for c, (n, at) in enumerate(zip(of, best)):
        if alone[n]:
            v[order[at], c] = 1.0
        else:
            v[order[heads[n]:heads[n + 1]], c] = turns[n][:, at - heads[n + 1]]
    return v, values[best]


def _has_short_rows(sizes: DataFrame) -> bool:
    """True when the products of the entries of each row, `n` of them, are together few for each entry."""
    n = F.col("n").cast("double")
    row = sizes.agg(F.sum(n * n).alias("products"), F.sum(n).alias("entries")).first()
    return (row["products"] or 0) <= SHORT_ROWS * (row["entries"] or 0)


def _fixed_signs(v: np.ndarray) -> np.ndarray:
    largest = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return v * np.where(largest < 0, -1.0, 1.0)


def _blocks(n_cols: int, width: int) -> int:
    """Blocks of a basis and its image that are small together, 4 to 16: the more, the fewer passes."""
    return max(4, min(16, SMALL_BYTES // (16 * n_cols * width)))


# Every path but the exact one iterates until each wanted pair has |X'Xv - lv| <= TOLERANCE * l1. For a symmetric product the
# error of a value is then of the order of TOLERANCE squared over its gap, so all paths give the same singular values.

def _new_directions(products: np.ndarray, width: int) -> np.ndarray | None:
    """How to turn [q | r] columns into an orthonormal addition to q: coefficients, or None if r adds nothing.

    `products` is [q | r]'[q | r]; the first `width` columns are q, which is orthonormal.
    """
    across = products[:width, width:]
    left = products[width:, width:] - across.T @ across
    values, turn = np.linalg.eigh((left + left.T) / 2)
    kept = values > 1e-10 * max(1e-300, float(np.trace(products[width:, width:])) / len(left))
    if not kept.any():
        return None
    scaled = turn[:, kept] / np.sqrt(values[kept])
    return np.vstack([-across @ scaled, scaled])


class _LocalBasis:
    """Basis q and image X'Xq as arrays on the driver; each product is one scan of the packed rows."""

    def __init__(self, packed: DataFrame, start: np.ndarray):
        self.packed = packed
        self.q = np.linalg.qr(start)[0]
        self.image = self._product(self.q)

    def _product(self, matrix: np.ndarray) -> np.ndarray:
        return _times_transposed(self.packed, matrix)

    def products(self) -> np.ndarray:
        across = self.q.T @ self.image
        return np.block([[self.q.T @ self.q, across], [across.T, self.image.T @ self.image]])

    def keep(self, turn: np.ndarray) -> None:
        self.q, self.image = self.q @ turn, self.image @ turn

    def extend(self, residual: np.ndarray) -> int:
        """Add the directions [q | image] * residual and their images; how many there are."""
        width = self.q.shape[1]
        more = self.q @ residual[:width] + self.image @ residual[width:]
        for _ in range(2):
            both = np.hstack([self.q, more])
            turn = _new_directions(both.T @ both, width)
            if turn is None:
                return 0
            more = both @ turn
        self.q = np.hstack([self.q, more])
        self.image = np.hstack([self.image, self._product(more)])
        return more.shape[1]


class _ProductBasis(_LocalBasis):
    """The same over the packed rows of X'X itself; a row of it gives its row of the image, so nothing is added up."""

    def _product(self, matrix: np.ndarray) -> np.ndarray:
        shared = self.packed.sparkSession.sparkContext.broadcast(matrix)

        def image(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    y = _times(*_csr(batch), batch.num_rows, shared.value)
                    yield from _vec_rows("idx", batch.column("id").to_numpy(zero_copy_only=False), y)

        try:
            return _collect_matrix(self.packed.mapInArrow(image, "idx int, vec array<double>"), *matrix.shape)
        finally:
            shared.unpersist()


class _SentMatrix:
    """X, small as a whole, sent once to every worker: a task works on columns of its own and has nothing to add up with others."""

    def __init__(self, packed: DataFrame, n_cols: int):
        self.spark, self.n_cols = packed.sparkSession, n_cols
        rows = packed.select("cols", "vals").toArrow()  # of checked size
        many, cols, vals = [], [], []
        for batch in rows.to_batches():
            at, c, v = _csr(batch)
            many.append(np.bincount(at, minlength=batch.num_rows))
            cols.append(c)
            vals.append(v)
        many = np.concatenate([*many, np.zeros(0, np.int64)])
        self.shared = self.spark.sparkContext.broadcast(
            (many[many > 0], np.concatenate([*cols, np.zeros(0, np.int32)]), np.concatenate([*vals, np.zeros(0)])))

    def filtered(self, columns: np.ndarray, locked: np.ndarray, degree: int, cut: float) -> np.ndarray:
        """p(X'X) of the columns, all kept orthogonal to the `locked` ones; p is the Chebyshev polynomial that is small on 0..cut.

        With degree 0 just X'X of the columns, nothing taken out.
        """
        shared, n_cols, sent = self.spark.sparkContext.broadcast((columns, locked)), self.n_cols, self.shared

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, kept = shared.value
            product = None
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    product = product or _products_with(*sent.value, n_cols)
                    if degree == 0:
                        yield from _vec_rows("idx", np.array([i]), product(x[:, i])[None, :])
                        continue

                    def step(v: np.ndarray) -> np.ndarray:  # X'X less half the cut, over half the cut: 0..cut becomes -1..1
                        w = product(v) * (2 / cut) - v
                        return w - kept @ (kept.T @ w)

                    before, now = x[:, i], step(x[:, i])
                    for _ in range(degree - 1):
                        before, now = now, 2 * step(now) - before
                    size = np.linalg.norm(now)
                    yield from _vec_rows("idx", np.array([i]), (now / size if size > 0 else now)[None, :])

        n = columns.shape[1]
        asked = self.spark.range(0, n, numPartitions=min(n, parallelism(self.spark)))
        try:
            return _collect_matrix(asked.mapInArrow(go, "idx int, vec array<double>"), n, n_cols).T
        finally:
            shared.unpersist()


def _products_with(many: np.ndarray, cols: np.ndarray, vals: np.ndarray, n_cols: int) -> Callable[[np.ndarray], np.ndarray]:
    """X'X times a vector, X being given by rows that are not empty, `many` entries each."""
    by_col = np.argsort(cols, kind="stable")
    rows_t, vals_t = np.repeat(np.arange(len(many)), many)[by_col], vals[by_col]
    counts = np.bincount(cols, minlength=n_cols)
    used = np.flatnonzero(counts)
    row_starts, col_starts = np.cumsum(many) - many, (np.cumsum(counts) - counts)[used]

    def product(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n_cols)
        if len(cols):
            y = np.add.reduceat(vals * v[cols], row_starts)
            out[used] = np.add.reduceat(vals_t * y[rows_t], col_starts)
        return out

    return product


def _filtered_svd(packed: DataFrame, n_cols: int, k: int, seed: int, tolerance: float, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Subspace iteration with a Chebyshev filter for a small matrix: (components, singular values) as the other ways give them.

    Each pass brings the open directions and GUARDS more through a polynomial that damps all below the least value in the
    subspace, then solves the small problem there. Wanted pairs whose residual is small enough, here as a share of their own
    value, are locked and filtered no more.
    """
    width = min(k + GUARDS, n_cols)
    matrix = _SentMatrix(packed, n_cols)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_cols, width)))[0]
    none = np.zeros((n_cols, 0))
    try:
        for _ in range(passes):
            image = matrix.filtered(q, none, 0, 0.0)
            inner = q.T @ image
            values, turn = np.linalg.eigh((inner + inner.T) / 2)
            best = np.argsort(values)[::-1]
            values, q, image = values[best], q @ turn[:, best], image @ turn[:, best]
            size = np.linalg.norm(image - q * values, axis=0)
            done = (size <= tolerance * np.maximum(values, 1e-5 * max(values[0], 1e-295))) & (np.arange(width) < k)
            if done[:k].all():
                return _fixed_signs(q[:, :k]), np.sqrt(np.maximum(values[:k], 0))
            cut = max(values[-1], 1e-12 * values[0])
            # so many steps that the largest open value does not outgrow the least by more than 1e6
            top = np.arccosh(max(2 * values[~done][0] / cut - 1, 1 + 1e-12))
            degree = int(min(FILTER_STEPS, max(1, np.arccosh(1e6) / top)))
            q = np.linalg.qr(np.hstack([q[:, done], matrix.filtered(q[:, ~done], q[:, done], degree, cut)]))[0]
    finally:
        matrix.shared.unpersist()
    raise RuntimeError(f"singular vectors did not reach the tolerance {tolerance} in {passes} passes")


class _JoinedBasis:
    """The same as rows `(idx, vec)` with vec = [q | image]; products are joins, and only small matrices reach the driver.

    `squared`, if given, holds the entries of X'X: one join in place of two.
    """

    def __init__(self, entries: DataFrame, width: int, seed: int, squared: DataFrame | None = None):
        self.entries, self.width, self.squared = entries, width, squared

        def noise(j: Column) -> Column:
            return F.pmod(F.xxhash64(F.col("idx"), j, F.lit(seed)), F.lit(1_000_003)) / 1_000_003 - 0.5

        start = cut_lineage(entries.select("idx").distinct().withColumn(
            "vec", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), noise)))
        for _ in range(2):
            turn = _new_directions(_vector_products(start, width), 0)
            start = cut_lineage(_turned(start, turn))
            width = turn.shape[1]
        self.width = width
        self.rows = self._with_images(start, start)

    def _with_images(self, q: DataFrame, more: DataFrame) -> DataFrame:
        """Rows with the columns of q, and of the image of `more` behind them."""
        if self.squared is not None:
            image = _joined_product(self.squared, more, "idx", "id").withColumnRenamed("id", "idx")
        else:
            image = _joined_product(self.entries, _joined_product(self.entries, more, "idx", "id"), "id", "idx")
        return cut_lineage(q.join(image.withColumnRenamed("vec", "_image"), "idx").select("idx", F.concat("vec", "_image").alias("vec")))

    def products(self) -> np.ndarray:
        return _vector_products(self.rows, 2 * self.width)

    def keep(self, turn: np.ndarray) -> None:
        zero = np.zeros_like(turn)
        self.rows = cut_lineage(_turned(self.rows, np.block([[turn, zero], [zero, turn]])))
        self.width = turn.shape[1]

    def extend(self, residual: np.ndarray) -> int:
        w, rows = self.width, self.rows
        only_q = np.vstack([np.eye(w), np.zeros((w, w))])
        both = cut_lineage(_turned(rows, np.hstack([only_q, residual])))  # [q | r]
        for _ in range(2):
            turn = _new_directions(_vector_products(both, w + residual.shape[1]), w)
            if turn is None:
                return 0
            n = turn.shape[1]
            both = cut_lineage(_turned(both, np.hstack([np.vstack([np.eye(w), np.zeros((len(turn) - w, w))]), turn])))
            residual = residual[:, :n]
        tail = both.select("idx", F.slice("vec", w + 1, n).alias("vec"))
        grown = self._with_images(both.select("idx", "vec"), tail)  # [q | r | image of r]
        old = rows.select("idx", F.slice("vec", w + 1, w).alias("_old"))
        self.rows = cut_lineage(grown.join(old, "idx").select("idx", F.concat(
            F.slice("vec", 1, w + n), F.col("_old"), F.slice("vec", w + n + 1, n)).alias("vec")))
        self.width = w + n
        return n


def _block_krylov(basis: _LocalBasis | _JoinedBasis, k: int, width: int, tolerance: float, passes: int, blocks: int = 4) -> np.ndarray:
    """Bring `basis` to the leading k directions (its first columns); their values.

    Each step solves the small problem in the basis, locks the pairs whose residual is small enough, and adds the residuals of the
    others, so a product is spent on open pairs only. A basis of so many `blocks` is cut back to its best quarter.
    """
    kept = width * (blocks // 4)
    for _ in range(passes):
        products = basis.products()
        w = len(products) // 2
        inner, square = products[:w, w:], products[w:, w:]
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        best = np.argsort(values)[::-1]
        values, turn = values[best], turn[:, best]
        top = min(k, w)
        # |image s - l q s|^2 from the products alone
        wanted = turn[:, :top]
        size = np.einsum("ij,ij->j", wanted, square @ wanted) - 2 * values[:top] * np.einsum("ij,ij->j", wanted, inner @ wanted) + values[:top] ** 2
        open_ = np.flatnonzero(np.sqrt(np.maximum(size, 0)) > tolerance * max(values[0], 1e-300))
        if w >= k and len(open_) == 0:
            basis.keep(wanted)
            return values[:k]
        if w >= blocks * width:
            basis.keep(turn[:, :kept])
            turn, values = np.eye(kept), values[:kept]
        guards = np.arange(top, min(top + OVERSAMPLE // 2, len(values)))  # the next pairs help those at the edge
        used = np.concatenate([open_, guards]) if len(open_) else guards
        residual = np.vstack([-turn[:, used] * values[used], turn[:, used]])
        residual = residual / np.maximum(np.sqrt(np.maximum(np.sum(residual ** 2, axis=0), 0)), 1e-300)
        if basis.extend(residual) == 0:  # the basis holds all that the matrix reaches
            products = basis.products()
            w = len(products) // 2
            values, turn = np.linalg.eigh(products[:w, w:] / 2 + products[w:, :w] / 2)
            best = np.argsort(values)[::-1][:k]
            basis.keep(turn[:, best])
            return values[best]
    raise RuntimeError(f"singular vectors did not reach the tolerance {tolerance} in {passes} passes")


def _small_svd(packed: DataFrame, n_cols: int, k: int, seed: int, tolerance: float, passes: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(components n_cols x k, singular values) when a few columns of that height fit the driver."""
    if exact:
        if _has_short_rows(packed.select(F.size("cols").alias("n"))):
            pairs = _sparse_products(packed)
            if fits(pairs, 24):
                v, values = _solved_apart(pairs.toArrow(), n_cols, k)
                return _fixed_signs(v), np.sqrt(np.maximum(values, 0))
        # Each partition sends on a whole matrix, so it should have read at least as much, and no core needs two.
        parts = max(1, min(packed.count() // n_cols, parallelism(packed.sparkSession)))
        values, vectors = np.linalg.eigh(_column_products(packed.coalesce(parts), n_cols))
        best = np.argsort(values)[::-1][:k]
        return _fixed_signs(vectors[:, best]), np.sqrt(np.maximum(values[best], 0))
    width = min(k + OVERSAMPLE, n_cols)
    start = np.random.default_rng(seed).standard_normal((n_cols, width))
    if _has_short_rows(packed.select(F.size("cols").alias("n"))):
        basis = _ProductBasis(cut_lineage(pack_rows(_sparse_products(packed))), start)
    else:
        basis = _LocalBasis(packed, start)
    values = _block_krylov(basis, k, width, tolerance, passes, _blocks(n_cols, width))
    return _fixed_signs(basis.q), np.sqrt(np.maximum(values, 0))


def _turned(vectors: DataFrame, matrix: np.ndarray, key: str = "idx", kind: str = "int") -> DataFrame:
    """Each row vector times a small matrix."""
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ m
                yield from _vec_rows(key, batch.column(key).to_numpy(zero_copy_only=False), rows,
                                     pa.int32() if kind == "int" else pa.int64())

    return vectors.select(key, doubles(F.col("vec")).alias("vec")).mapInArrow(turn, f"{key} {kind}, vec array<double>")


def _vector_products(a: DataFrame, width: int) -> np.ndarray:
    """Sum of v vT over the rows of `(idx, vec)`; width x width."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            total += rows.T @ rows if batch.num_rows else 0
        yield from _vec_rows("idx", np.arange(width), total)

    sums = _sum_rows(a.select("vec").mapInArrow(partial, "idx int, vec array<double>"), width)
    return _collect_matrix(sums, width, width)


def _joined_product(entries: DataFrame, vectors: DataFrame, on: str, to: str) -> DataFrame:
    """Rows of X M (or XT M) by a join: sum of value * vec per `to`, partly summed before the shuffle."""
    return (entries.join(vectors, on).groupBy(to)
            .agg(sum_vector(scale(F.col("vec"), F.col("value"))).alias("vec")))


def _distributed_svd(entries: DataFrame, n_cols: int, k: int, seed: int, tolerance: float, passes: int) -> tuple[DataFrame, np.ndarray]:
    """The same iteration with the basis kept as a table, for matrices too wide for the driver."""
    width = min(k + OVERSAMPLE, n_cols)
    sizes = entries.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"))
    squared = cut_lineage(_sparse_products(pack_rows(entries.filter("id IS NOT NULL")))) if _has_short_rows(sizes) else None
    basis = _JoinedBasis(entries, width, seed, squared)
    values = _block_krylov(basis, k, width, tolerance, passes, _blocks(n_cols, width))
    k = len(values)
    components = cut_lineage(basis.rows.select("idx", F.slice("vec", 1, k).alias("vec")))
    signs = components.select(F.posexplode("vec").alias("j", "x")).groupBy("j").agg(
        F.max_by("x", F.abs("x")).alias("x")).collect()  # k rows
    flip = np.ones(k)
    for row in signs:
        flip[row["j"]] = -1.0 if row["x"] < 0 else 1.0
    return _turned(components, np.diag(flip)), np.sqrt(np.maximum(values, 0))


def _project_packed(packed: DataFrame, components: np.ndarray) -> DataFrame:
    shared = packed.sparkSession.sparkContext.broadcast(components)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = _times(*_csr(batch), batch.num_rows, shared.value)
                yield from _vec_rows("id", batch.column("id").to_numpy(zero_copy_only=False), y, pa.int64())

    return packed.mapInArrow(apply, "id bigint, vec array<double>")


def project(entries: DataFrame, components: DataFrame, n_cols: int, k: int) -> DataFrame:
    """`(id, vec)`: rows times components `(idx, vec)`; the way to apply a fitted SVD to new rows."""
    entries = entries.select(F.col("id").cast("bigint"), F.col("idx").cast("int"), F.col("value").cast("double"))
    if n_cols * k * 8 > SMALL_BYTES:
        return _joined_product(entries, components, "idx", "id")
    return _project_packed(pack_rows(entries), _collect_matrix(components, n_cols, k))


def truncated_svd(entries: DataFrame, n_cols: int, k: int, seed: int = 42, tolerance: float = TOLERANCE, passes: int = 300,
                  path: str | None = None) -> dict[str, DataFrame]:
    """Best rank-k factors of a sparse matrix of `n_cols` columns, `idx` being 0..n_cols-1.

    Tables: rows `(id, vec)` = U * Sigma, components `(idx, vec)` = V, and spectrum `(component,
    singular_value, variance, ratio)`. Four ways to one accuracy: "exact" column products up to GRAM_COLUMNS columns, a filtered
    subspace where matrix and subspace are small and the matrix is "sent" whole, a block Krylov iteration with a "broadcast"
    basis while four blocks of it are small, and the same with the basis in "joined" tables.
    `path` names one; the default goes by width. An iteration that does not reach `tolerance` in `passes` scans raises. The
    largest entry of each component is made positive. The matrix is written once and read by every pass.
    """
    spark = entries.sparkSession
    entries = entries.select(F.col("id").cast("bigint"), F.col("idx").cast("int"), F.col("value").cast("double"))
    k = max(1, min(k, n_cols - 1))
    packed = None
    if path is None:
        path = "exact" if n_cols <= GRAM_COLUMNS else "broadcast" if 4 * n_cols * (k + OVERSAMPLE) * 8 <= SMALL_BYTES else "joined"
        if n_cols > GRAM_COLUMNS and n_cols * (k + GUARDS) * 8 <= SMALL_BYTES:
            packed = cut_lineage(pack_rows(entries))
            n = packed.agg(F.count("*").alias("rows"), F.sum(F.size("cols")).alias("entries"), F.sum(F.size("cols").cast("double") ** 2).alias("products")).first()
            small = (n["entries"] or 0) * ENTRY_BYTES + n["rows"] * 8 <= SMALL_BYTES
            if small and (n["products"] or 0) > SHORT_ROWS * (n["entries"] or 0):
                path = "sent"
    if path != "joined":
        packed = cut_lineage(pack_rows(entries)) if packed is None else packed
        if path == "sent":
            v, sigma = _filtered_svd(packed, n_cols, k, seed, tolerance, passes)
        else:
            v, sigma = _small_svd(packed, n_cols, k, seed, tolerance, passes, path == "exact")
        components = spark.createDataFrame(pa.Table.from_batches(list(_vec_rows("idx", np.arange(n_cols), v))))
        rows = _project_packed(packed, v)
        entries = packed.select("id", F.inline(F.arrays_zip("cols", "vals"))).toDF("id", "idx", "value")
    else:
        entries = cut_lineage(entries)
        components, sigma = _distributed_svd(entries, n_cols, k, seed, tolerance, passes)
        rows = project(entries, components, n_cols, k)
    return {"rows": rows, "components": components, "spectrum": _spectrum(rows, entries, sigma)}


def _spectrum(rows: DataFrame, entries: DataFrame, sigma: np.ndarray) -> DataFrame:
    """Variance of each component over the rows, and its share of the variance of all columns."""
    spark = rows.sparkSession
    n = rows.agg(F.count("*")).scalar()
    per_column = entries.groupBy("idx").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    total = per_column.withColumn("n", n).agg(
        F.sum(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2)))).scalar()
    means = rows.agg(sum_vector(F.col("vec")).alias("s")).withColumn("n", n).select(
        F.posexplode(F.transform("s", lambda x: x / F.col("n"))).alias("component", "mean"), "n")
    values = spark.createDataFrame([(i, float(s)) for i, s in enumerate(sigma)], "component int, singular_value double")
    variance = F.pow("singular_value", F.lit(2)) / F.col("n") - F.pow("mean", F.lit(2))
    return (values.join(means, "component").withColumn("variance", variance).withColumn("_total", total)
            .select("component", "singular_value", "variance", (F.col("variance") / F.col("_total")).alias("ratio")))


# ---- PCA ------------------------------------------------------------------------------------------

PCA_COLUMNS = 1024  # up to this width the covariance is summed exactly (8 MB); beyond, only products with it are


class _CentredBasis(_LocalBasis):
    """The same for dense rows `(id, vec)` less their mean: the product of the centred rows needs no centred copy."""

    def __init__(self, vectors: DataFrame, mean: np.ndarray, n: int, start: np.ndarray):
        self.vectors, self.mean, self.n = vectors, mean, n
        self.q = np.linalg.qr(start)[0]
        self.image = self._product(self.q)

    def _product(self, matrix: np.ndarray) -> np.ndarray:
        return _dense_times_transposed(self.vectors, matrix) - self.n * np.outer(self.mean, self.mean @ matrix)


def _dense_times_transposed(vectors: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """XT X M of dense rows in one scan; each partition sends its sum once."""
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros(m.shape)
        for batch in batches:
            rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(m))
            for at in range(0, len(rows), _STRIP):
                strip = rows[at:at + _STRIP]
                total += strip.T @ (strip @ m)
        yield from _vec_rows("idx", np.arange(len(m)), total)

    sums = _sum_rows(vectors.select("vec").mapInArrow(partial, "idx int, vec array<double>"), matrix.shape[1])
    try:
        return _collect_matrix(sums, *matrix.shape)
    finally:
        shared.unpersist()


def _column_sums(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean of every column, sum of its squared deviations, and the number of rows; partitions merge pairwise."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if len(rows):
                n, mean, square = _merged(n, mean, square, len(rows), rows.mean(axis=0), ((rows - rows.mean(axis=0)) ** 2).sum(axis=0))
        if n:
            yield from _vec_rows("idx", np.array([0]), np.concatenate([[n], mean, square])[None, :])

    n, mean, square = 0, np.zeros(width), np.zeros(width)
    for row in vectors.select("vec").mapInArrow(partial, "idx int, vec array<double>").toLocalIterator():  # one row per partition
        part = np.array(row["vec"])
        n, mean, square = _merged(n, mean, square, int(part[0]), part[1:width + 1], part[width + 1:])
    return mean, square, n


def _merged(n: int, mean: np.ndarray, square: np.ndarray, m: int, other: np.ndarray, more: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    step = other - mean
    return n + m, mean + step * (m / (n + m)), square + more + step ** 2 * (n * m / (n + m))


def pca(vectors: DataFrame, k: int, whiten: bool = False, seed: int = 42, tolerance: float = TOLERANCE, passes: int = 300,
        exact: bool | None = None) -> dict[str, DataFrame]:
    """Principal components of `(id, vec)` rows of any one width; rows are centred first.

    Up to PCA_COLUMNS columns the covariance itself is solved; wider rows go through the block Krylov iteration, one scan a
    step, to the same accuracy (`exact` names the way). Variances are of the sample (n - 1).
    """
    spark = vectors.sparkSession
    vectors = cut_lineage(vectors.select(F.col("id").cast("bigint").alias("id"), doubles(F.col("vec")).alias("vec")))
    first = vectors.select(F.size("vec")).first()
    if first is None:
        raise ValueError("pca needs rows")
    width = first[0]
    mean, square, n = _column_sums(vectors, width)
    k = max(1, min(k, width, n - 1))
    if exact if exact is not None else width <= PCA_COLUMNS:
        scatter = _vector_products(vectors, width) - n * np.outer(mean, mean)
        values, turn = np.linalg.eigh((scatter + scatter.T) / 2)
        best = np.argsort(values)[::-1][:k]
        values, components = values[best], turn[:, best]
    else:
        start = np.random.default_rng(seed).standard_normal((width, min(k + OVERSAMPLE, width)))
        basis = _CentredBasis(vectors, mean, n, start)
        values = _block_krylov(basis, k, start.shape[1], tolerance, passes)
        components = basis.q
    components = _fixed_signs(components)
    variance = np.maximum(values, 0) / max(1, n - 1)
    ratio = variance / max(1e-300, float(square.sum()) / max(1, n - 1))
    factor = components / np.sqrt(np.maximum(variance, 1e-300)) if whiten else components
    # (x - mean) C = x C - mean C, so the centring costs one constant row.
    shift = [float(x) for x in mean @ factor]
    turned = _turned(vectors, factor, "id", "bigint")
    rows = turned.select("id", F.zip_with("vec", F.array(*[F.lit(x) for x in shift]), lambda x, s: x - s).alias("vec"))
    spectrum = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(variance, ratio))],
                                     "component int, variance double, ratio double")
    table = pa.Table.from_batches(list(_vec_rows("idx", np.arange(width), components)))
    return {"rows": rows, "components": spark.createDataFrame(table), "spectrum": spectrum}


# ---- explained variance (the spectrum has one row per component) -----------------------------------

def cumulative_variance(spectrum: DataFrame) -> DataFrame:
    order = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spectrum.select("component", "ratio", F.sum("ratio").over(order).alias("cumulative"))


def components_for(spectrum: DataFrame, shares: list[float]) -> DataFrame:
    """Fewest components whose ratios add up to each share; null when all together do not."""
    cumulative = cumulative_variance(spectrum)
    picks = [F.min(F.when(F.col("cumulative") >= s, F.col("component") + 1)) for s in shares]
    pairs = F.array(*[F.struct(F.lit(float(s)).alias("share"), p.cast("int").alias("components"))
                      for s, p in zip(shares, picks)])
    return cumulative.agg(pairs.alias("x")).select(F.inline("x"))


def elbow(spectrum: DataFrame) -> DataFrame:
    """Component count at the largest second difference, and how many components reach 1 %."""
    order = Window.orderBy("component")
    second = (F.lead("ratio", 1).over(order) - F.col("ratio")) - (F.col("ratio") - F.lag("ratio", 1).over(order))
    bends = spectrum.select("component", "ratio", second.alias("bend"))
    # Bend number i of the list of second differences lies at component i + 1, the (i + 2)nd.
    return bends.agg(F.max_by(F.col("component") + 1, F.struct(F.coalesce("bend", F.lit(float("-inf"))),
                                                              -F.col("component"))).cast("int").alias("elbow"),
                     F.count_if(F.col("ratio") >= 0.01).alias("over_one_percent"))
