"""Similarity of sparse rows (items by their raters, users by their items) and of given user pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, parallelism
from .neighbours import SCORE_DIGITS

BLOCK_IDS = 1 << 17        # ids per block
BLOCK_ENTRIES = 4_000_000  # entries per block
RECORD_ENTRIES = 256       # entries per record of a block: Spark hands a task 10,000 records at a time, so these must be small
MEET_CELLS = 1 << 19       # products a task holds at once; four times as many places for pairs
MEET_ENTRIES = 1 << 20     # entries of a stripe whose products are counted at once
BEST_BYTES = 1 << 27       # what a task keeps as the best of its rows
LONGEST_HISTORY = 1 << 16  # ratings of a user that travel as one row
STRIPE_ENTRIES = 2_000_000 # ratings of the users a task holds for pairs
PAIR_CELLS = 2_000_000     # ratings looked up at once
PAIRS_SENT = 4096          # pairs of a user in one row
_FOUND = "query_id bigint, id bigint, raw double, rank int"
_FIELDS = (("ids", np.int64), ("sizes", np.float64), ("dims", np.int64), ("counts", np.int32), ("at", np.uint32), ("vals", np.float64))
_BLOCK = "own int, part int, " + ", ".join(f"{name} binary" for name, _ in _FIELDS)


def _sizes(metric: str, at: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
    """Per row the norm for cosine (null values do not count), the number of entries for jaccard."""
    if metric == "cosine":
        return np.sqrt(np.bincount(at, np.nan_to_num(vals * vals), n))
    return np.bincount(at, minlength=n).astype(np.float64)


def _packed_block(key: tuple[pa.Scalar, ...], table: pa.Table, metric: str, most: int) -> pa.Table:
    """A block by dimension: its distinct dimensions with entry counts, and per entry the row's place in the block and the value.

    A dimension is stored once for all rows of the block that have it, an id and its size once for all its entries.
    A block of more than `most` entries becomes several records, cut between dimensions.
    """
    own = key[0].as_py()
    ids, at = np.unique(table["id"].to_numpy(), return_inverse=True)
    at = at.astype(np.uint32)
    found = table["dim"].to_numpy()
    order = np.lexsort((at, found))
    dims, counts = np.unique(found, return_counts=True)
    at, vals = at[order], table["val"].to_numpy()[order].astype(np.float64, copy=False)
    del found, order
    sizes = _sizes(metric, at, vals, len(ids))
    ends = np.cumsum(counts)
    out, first = {name: [] for name, _ in _FIELDS}, 0
    while first < len(dims):
        done = ends[first - 1] if first else 0
        to = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
        entries = slice(int(done), int(ends[to - 1]))
        made = {"ids": ids if first == 0 else ids[:0], "sizes": sizes if first == 0 else sizes[:0], "dims": dims[first:to],
                "counts": counts[first:to], "at": at[entries], "vals": vals[entries]}
        for name, kind in _FIELDS:
            if name == "at" and len(ids) <= 1 << 16:
                kind = np.uint16
            out[name].append(made[name].astype(kind).tobytes())
        first = to
    n = len(out["ids"])
    head = {"own": pa.array([own] * n, pa.int32()), "part": pa.array(range(n), pa.int32())}
    return pa.table(head | {name: pa.array(values, pa.binary()) for name, values in out.items()})


def _unpacked(parts: list[dict]) -> dict[str, np.ndarray]:
    """A block of one or several records, its entries by dimension; one record is looked at in place."""
    n_ids = len(parts[0]["ids"]) // 8
    kinds = dict(_FIELDS) | ({"at": np.uint16} if n_ids <= 1 << 16 else {})
    fields = {name: [np.require(np.frombuffer(p[name], kind), requirements="A") for p in parts] for name, kind in kinds.items()}
    return {name: found[0] if len(found) == 1 else np.concatenate(found) for name, found in fields.items()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[dict]]]:
    """(stripe, block, its records) one after another; the records of a block follow each other.

    Records that follow each other in a batch lie behind each other in memory and are taken up as one.
    """
    key, parts = None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        stripe, own = batch["stripe"].to_numpy(), batch["own"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (np.diff(stripe) != 0) | (np.diff(own) != 0), True])
        for a, b in zip(edges[:-1], edges[1:]):
            new = int(stripe[a]), int(own[a])
            if parts and new != key:
                yield *key, parts
                parts = []
            key = new
            parts.append({name: _bytes(batch[name].slice(a, b - a)) for name, _ in _FIELDS})
    if parts:
        yield *key, parts


def _bytes(column: pa.BinaryArray) -> pa.Buffer:
    """The values of a binary column without nulls, one after another."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return data.slice(int(ends[0]), int(ends[-1] - ends[0])) if data is not None else pa.py_buffer(b"")


class _Stripe:
    """The rows of some packed blocks, their entries row by row, and the best k others found so far for each.

    An entry takes 16 bytes; all else that grows with entries or products is held for a few rows at a time.
    """

    def __init__(self, blocks: list[list[dict]], k: int, metric: str, digits: int):
        self.k, self.metric, self.digits = k, metric, digits
        self.ids = np.concatenate([np.frombuffer(parts[0]["ids"], np.int64) for parts in blocks])
        self.sizes = np.concatenate([np.frombuffer(parts[0]["sizes"], np.float64) for parts in blocks])
        self.dims = np.unique(np.concatenate([np.frombuffer(part["dims"], np.int64) for parts in blocks for part in parts]))
        total = sum(len(part["vals"]) // 8 for parts in blocks for part in parts)
        self.rows, self.dim, self.vals = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        first = done = 0
        for parts in blocks:
            block = _unpacked(parts)
            order = np.argsort(block["at"], kind="stable")
            own = slice(done, done + len(order))
            self.rows[own] = block["at"][order]
            self.rows[own] += first
            self.dim[own] = np.repeat(np.searchsorted(self.dims, block["dims"]).astype(np.int32), block["counts"])[order]
            self.vals[own] = block["vals"][order]
            first, done = first + len(block["ids"]), own.stop
        n = len(self.ids)
        self.starts = np.searchsorted(self.rows, np.arange(n + 1, dtype=np.int32))
        self.count = np.zeros(n, np.int64)
        self.edge = np.full(n, -np.inf)  # order of the last of k kept
        self.best_id, self.best_raw = np.zeros((n, k), np.int64), np.zeros((n, k))

    def meet(self, block: dict[str, np.ndarray], own: bool) -> None:
        """All rows of the stripe against all of a block: inner products and common dimensions, the best k kept."""
        place = np.minimum(np.searchsorted(block["dims"], self.dims), len(block["dims"]) - 1)
        counts = np.where(block["dims"][place] == self.dims, block["counts"][place], 0)
        begin = (np.cumsum(block["counts"], dtype=np.int64) - block["counts"])[place]
        row = 0
        while row < len(self.ids):
            to = max(row + 1, int(np.searchsorted(self.starts, self.starts[row] + MEET_ENTRIES, "right")) - 1)
            self._meet_rows(row, to, block, counts, begin, own)
            row = to

    def _meet_rows(self, row: int, end: int, block: dict[str, np.ndarray], counts: np.ndarray, begin: np.ndarray, own: bool) -> None:
        """The rows `row` to `end`; `counts` and `begin` tell, by dimension of the stripe, where its entries are in the block."""
        ids, sizes, at, vals, width = block["ids"], block["sizes"], block["at"], block["vals"], len(block["ids"])
        entries = slice(int(self.starts[row]), int(self.starts[end]))
        rows_of, dim, own_vals = self.rows[entries], self.dim[entries], self.vals[entries]
        many = counts[dim].astype(np.int64)
        ends = np.r_[0, np.cumsum(many)]
        starts, begun = self.starts[row:end + 1] - entries.start, row

        def products(first: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Row, place in the block and product of the entries `first` to `to` with those of their dimensions."""
            n = many[first:to]
            col = np.repeat(begin[dim[first:to]] - ends[first:to], n) + np.arange(ends[first], ends[to])
            return np.repeat(rows_of[first:to], n).astype(np.int64), at[col], np.repeat(own_vals[first:to], n) * vals[col]

        row_ends = ends[starts]
        while row < end:
            to = begun + max(row - begun + 1, int(np.searchsorted(row_ends, row_ends[row - begun] + MEET_CELLS, "right")) - 1)
            first, last = int(starts[row - begun]), int(starts[to - begun])
            total = int(row_ends[to - begun] - row_ends[row - begun])
            if total * 4 >= (to - row) * width and (to - row) * width <= 4 * MEET_CELLS or to == row + 1:
                # A place for each pair; one row with very many products comes strip by strip.
                dots, common = np.zeros((to - row) * width), np.zeros((to - row) * width, np.int64)
                while first < last:
                    part = max(first + 1, min(last, int(np.searchsorted(ends, ends[first] + MEET_CELLS, "right")) - 1))
                    r, c, product = products(first, part)
                    pair = (r - row) * width + c
                    dots += np.bincount(pair, product, len(dots))
                    common += np.bincount(pair, minlength=len(dots))
                    first = part
                pair = np.flatnonzero(common)
                dots, common = dots[pair], common[pair]
            elif total:
                r, c, product = products(first, last)
                pair = (r - row) * width + c
                order = np.argsort(pair, kind="stable")
                pair, product = pair[order], product[order]
                heads = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                dots, common, pair = np.add.reduceat(product, heads), np.diff(np.r_[heads, len(pair)]), pair[heads]
            else:
                pair = np.zeros(0, np.int64)
                dots = common = pair
            rows, cols = np.divmod(pair, max(1, width))
            rows += row
            if own:
                other = self.ids[rows] != ids[cols]
                rows, cols, dots, common = rows[other], cols[other], dots[other], common[other]
            self._keep(rows, ids[cols], _raw(dots, common, self.sizes[rows], sizes[cols], self.metric))
            row = to

    def _keep(self, rows: np.ndarray, ids: np.ndarray, raw: np.ndarray) -> None:
        """Take up new candidates, in order of their rows, that are as good as the last of k kept."""
        order = _order(raw, self.digits)
        good = order >= self.edge[rows]
        rows, ids, raw, order = rows[good], ids[good], raw[good], order[good]
        if not len(rows):
            return
        touched = rows[np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])]
        n = self.count[touched]
        old, nth = np.repeat(touched, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        old_raw = self.best_raw[old, nth]
        rows, ids, raw = np.r_[old, rows], np.r_[self.best_id[old, nth], ids], np.r_[old_raw, raw]
        order = np.r_[_order(old_raw, self.digits), order]
        ranked = np.lexsort((ids, -order, rows))
        rows, ids, raw, order = rows[ranked], ids[ranked], raw[ranked], order[ranked]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = nth < self.k
        rows, ids, raw, order, nth = rows[kept], ids[kept], raw[kept], order[kept], nth[kept]
        self.best_id[rows, nth], self.best_raw[rows, nth] = ids, raw
        self.count[touched] = np.bincount(np.searchsorted(touched, rows), minlength=len(touched))
        last = nth == self.k - 1
        self.edge[rows[last]] = order[last]

    def found(self, batch_rows: int = 200_000) -> Iterator[pa.RecordBatch]:
        """The kept ones, ranked; what has no number comes first, as in Spark's descending order."""
        step = max(1, batch_rows // self.k)
        for at in range(0, len(self.ids), step):
            n = self.count[at:at + step]
            rows = np.repeat(np.arange(at, at + len(n)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids, raw = self.best_id[rows, nth], self.best_raw[rows, nth]
            order = np.where(np.isnan(raw), np.inf, _order(raw, self.digits))
            ranked = np.lexsort((ids, -order, rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.ids[rows]), pa.array(ids[ranked]), pa.array(raw[ranked], from_pandas=False), pa.array((nth + 1).astype(np.int32))],
                names=["query_id", "id", "raw", "rank"])


def _raw(dot: np.ndarray, co: np.ndarray, q_size: np.ndarray, v_size: np.ndarray, metric: str) -> np.ndarray:
    """`size` is the norm for cosine, the number of entries for jaccard."""
    if metric == "cosine":
        product = q_size * v_size
        return np.divide(dot, product, out=np.zeros(len(dot)), where=product > 0)
    return co / (q_size + v_size - co)


def _order(raw: np.ndarray, digits: int) -> np.ndarray:
    """Scores as they are rounded, times a power of ten; what is no number comes last."""
    steps = np.abs(raw) * 10.0 ** digits
    return np.where(np.isnan(raw), -np.inf, np.copysign(np.floor(steps + 0.5), raw) + 0.0)


def similar_rows(entries: DataFrame, row: str, dim: str, value: str, k: int, metric: str = "cosine",
                 min_score: float | None = None, digits: int = SCORE_DIGITS,
                 block_ids: int = BLOCK_IDS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Best k other rows with a common dimension for each row of a sparse matrix.

    `entries(row, dim, value)` holds one entry per cell; `metric` is cosine or jaccard. Rows are cut
    into blocks by hash, each packed by dimension into small records, and blocks into stripes.
    The task of a stripe holds its rows, meets all blocks one after another, and keeps the best k of each row: no pair of
    rows leaves a task but in the result. A block is sent once per stripe; stripes are as many as cores, more only where their
    rows, or the best k of those, would outgrow a task.
    """
    if metric not in ("cosine", "jaccard"):
        raise ValueError(f"unknown metric: {metric}")
    cells = cut_lineage(entries.select(F.col(row).cast("bigint").alias("id"), F.xxhash64(dim).alias("dim"),
                                       F.col(value).cast("double").alias("val")).filter("id IS NOT NULL"))
    rows, total = cells.agg(F.approx_count_distinct("id"), F.count("*")).first()
    stripes = max(1, -(-rows * k * 16 // BEST_BYTES), -(-rows // (8 * block_ids)), -(-total // (2 * block_entries)),
                  min(parallelism(entries.sparkSession), -(-total // 100_000)))
    n_blocks = -(-max(stripes, -(-rows // block_ids), -(-total // block_entries)) // stripes) * stripes

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _packed_block(key, table, metric, min(block_entries, RECORD_ENTRIES))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, stripe = None, [], None
        for name, block, parts in _blocks(batches):
            if name != at:
                if own:
                    yield from _met(own, k, metric, digits).found()
                elif stripe is not None:
                    yield from stripe.found()
                at, own, stripe = name, [], None
            if block % stripes == name:
                own.append(parts)
                continue
            if stripe is None and own:
                stripe, own = _met(own, k, metric, digits), []
            if stripe is not None:  # else no row hashes into the stripe
                stripe.meet(_unpacked(parts), False)
        if own:
            stripe = _met(own, k, metric, digits)
        if stripe is not None:
            yield from stripe.found()

    packed = cells.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy("own").applyInArrow(pack, _BLOCK)
    sent = packed.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    # the stripe's own blocks first
    placed = sent.repartitionById(stripes, F.col("stripe")).sortWithinPartitions(
        "stripe", F.col("own") % stripes != F.col("stripe"), "own", "part")
    found = placed.mapInArrow(search, _FOUND)
    scored = found.select("query_id", "id", F.round("raw", digits).alias("score"), "rank")
    return scored if min_score is None else scored.filter(F.col("score") >= min_score)


def _met(own: list[list[dict]], k: int, metric: str, digits: int) -> _Stripe:
    """The stripe of some packed blocks, which have met each other."""
    stripe = _Stripe(own, k, metric, digits)
    for parts in own:
        stripe.meet(_unpacked(parts), True)
    return stripe


def _joined_statistics(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """`pair_statistics` by joins, for users with very long histories or odd values.

    Of each pair the user with the shorter history is expanded, so that a hot user is looked up by
    (user, item) instead of being multiplied by the number of its pairs.
    """
    lengths = ratings.groupBy("user_id").agg(F.count("*").alias("n"))
    sized = (pairs.select("user_a", "user_b").distinct()
             .join(lengths.select(F.col("user_id").alias("user_a"), F.col("n").alias("n_a")), "user_a")
             .join(lengths.select(F.col("user_id").alias("user_b"), F.col("n").alias("n_b")), "user_b"))
    short_a = F.col("n_a") <= F.col("n_b")
    planned = sized.select("user_a", "user_b", short_a.alias("short_a"),
                           F.when(short_a, F.col("user_a")).otherwise(F.col("user_b")).alias("short"),
                           F.when(short_a, F.col("user_b")).otherwise(F.col("user_a")).alias("long"))
    r_short = ratings.select(F.col("user_id").alias("short"), "item_id", F.col("rating").alias("r_short"))
    r_long = ratings.select(F.col("user_id").alias("long"), "item_id", F.col("rating").alias("r_long"))
    both = planned.join(r_short, "short").join(r_long, ["long", "item_id"])
    a = F.when(F.col("short_a"), F.col("r_short")).otherwise(F.col("r_long"))
    b = F.when(F.col("short_a"), F.col("r_long")).otherwise(F.col("r_short"))
    return both.select("user_a", "user_b", a.alias("a"), b.alias("b")).groupBy("user_a", "user_b").agg(
        F.count("*").alias("common"), F.covar_pop("a", "b").alias("_c"),
        (F.stddev_pop("a") * F.stddev_pop("b")).alias("_s")).select(
        "user_a", "user_b", "common", F.when(F.col("_s") > 1e-9, F.col("_c") / F.col("_s")).alias("correlation"))


def _matched(far: dict[str, np.ndarray], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Statistics of the pairs of a batch: each of its users, whose packed ratings come along, with those of the stripe in `others`."""
    width, items, others = len(far["item_ids"]), batch.column("items"), batch.column("others")
    found, at = items.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), items.value_lengths().to_numpy())
    place = np.minimum(np.searchsorted(far["item_ids"], found), width - 1)
    known = far["item_ids"][place] == found  # items that nobody in the stripe has are left out
    place, rates, sizes = place[known], batch.column("rates").flatten().to_numpy()[known], np.bincount(at[known], minlength=batch.num_rows)
    starts = np.cumsum(sizes) - sizes
    ids, row = others.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), others.value_lengths().to_numpy())
    other = np.minimum(np.searchsorted(far["users"], ids), len(far["users"]) - 1)
    kept = (far["users"][other] == ids) & (sizes[row] > 0)
    ids, row, other = ids[kept], row[kept], other[kept]
    near, ends = batch.column("user").to_numpy()[row], np.cumsum(sizes[row])
    first = 0
    while first < len(row):
        to = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIR_CELLS, "right")))
        many = sizes[row[first:to]]
        pair = np.repeat(np.arange(to - first), many)
        cell = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[row[first:to]], many)
        code = other[first:to][pair] * width + place[cell]
        hit = np.minimum(np.searchsorted(far["codes"], code), len(far["codes"]) - 1)
        same = far["codes"][hit] == code
        pair, a, hit = pair[same], rates[cell[same]], hit[same]
        times = far["counts"][hit]  # over 1 where ratings of a user and an item repeat
        pair, a = np.repeat(pair, times), np.repeat(a, times)
        b = far["rates"][np.repeat(far["firsts"][hit] - np.cumsum(times) + times, times) + np.arange(len(pair))]
        n = np.bincount(pair, minlength=to - first)
        per = np.maximum(n, 1)
        a = a - (np.bincount(pair, a, to - first) / per)[pair]
        b = b - (np.bincount(pair, b, to - first) / per)[pair]
        spread = np.sqrt(np.bincount(pair, a * a, to - first) / per) * np.sqrt(np.bincount(pair, b * b, to - first) / per)
        defined = spread > 1e-9
        value = np.divide(np.bincount(pair, a * b, to - first) / per, spread, out=np.zeros(to - first), where=defined)
        some = n > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(near[first:to][some]), pa.array(ids[first:to][some]), pa.array(n[some]), pa.array(value[some], mask=~defined[some])],
            names=["near", "far", "common", "correlation"])
        first = to


def _stripe_of(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """The packed ratings of a stripe's users, to be looked up by user and item."""
    table = pa.Table.from_batches(parts)
    users, items, rates = table["user"].to_numpy(), pc.list_flatten(table["items"]).to_numpy(), pc.list_flatten(table["rates"]).to_numpy()
    item_ids, place = np.unique(items, return_inverse=True)
    order = np.argsort(users)
    rank = np.empty(len(users), np.int64)
    rank[order] = np.arange(len(users))
    codes = np.repeat(rank, pc.list_value_length(table["items"]).to_numpy()) * len(item_ids) + place
    by_code = np.argsort(codes, kind="stable")
    codes, firsts, counts = np.unique(codes[by_code], return_index=True, return_counts=True)
    return {"users": users[order], "item_ids": item_ids, "codes": codes, "firsts": firsts, "counts": counts, "rates": rates[by_code]}


def pair_statistics(pairs: DataFrame, ratings: DataFrame, longest: int = LONGEST_HISTORY, stripe_entries: int = STRIPE_ENTRIES) -> DataFrame:
    """Common items and their correlation (null when a side is constant) for given distinct `pairs(user_a, user_b)`, read several times.

    The users of the side with fewer ratings are cut into stripes that a task can hold. A user of the other side is sent, with
    its packed ratings and its pairs, once to every stripe it has pairs in, so ratings are not multiplied by pairs.
    Pairs with a user of more than `longest` ratings or with values that are no finite numbers are joined rating by rating.
    """
    pairs = pairs.select("user_a", "user_b").filter("user_a IS NOT NULL AND user_b IS NOT NULL")
    whole = {"tinyint", "smallint", "int", "bigint"}
    if not {dict(pairs.dtypes)["user_a"], dict(pairs.dtypes)["user_b"], dict(ratings.dtypes)["user_id"]} <= whole:
        return _joined_statistics(pairs, ratings)
    sides = [pairs.select(F.col(c).cast("bigint").alias("user"), F.lit(c == "user_a").alias("in_a"), F.lit(c == "user_b").alias("in_b"))
             for c in ("user_a", "user_b")]
    users = sides[0].union(sides[1]).groupBy("user").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    item = F.col("item_id").cast("bigint") if dict(ratings.dtypes)["item_id"] in whole else F.xxhash64("item_id")
    cells = ratings.filter("user_id IS NOT NULL AND item_id IS NOT NULL").select(
        F.col("user_id").cast("bigint").alias("user"), item.alias("item"), F.col("rating").cast("double").alias("rate"))
    # at most `longest` ratings of a user are gathered; null or infinite ones, or NaN, make it odd
    lengths = cells.groupBy("user").agg(F.count("*").alias("n"), F.max(F.coalesce(F.abs("rate"), F.lit(float("inf")))).alias("_most"))
    odd = (F.col("n") > longest) | (F.col("_most") >= float("inf"))
    sized = cut_lineage(users.join(lengths, "user").select("user", "in_a", "in_b", "n", odd.alias("odd")))
    n = F.when(~F.col("odd"), F.col("n")).otherwise(0)
    in_a, in_b, few_a, few_b, strange = sized.agg(
        F.sum(n * F.col("in_a").cast("int")), F.sum(n * F.col("in_b").cast("int")), F.sum((F.col("in_a") & ~F.col("odd")).cast("int")),
        F.sum((F.col("in_b") & ~F.col("odd")).cast("int")), F.max("odd")).first()
    near, far = ("user_a", "user_b") if (in_b or 0) <= (in_a or 0) else ("user_b", "user_a")
    entries, stripe_total = max(in_a or 0, in_b or 0), min(in_a or 0, in_b or 0)
    stripes = max(1, -(-stripe_total // stripe_entries))
    sends = entries * min(stripes, -(-pairs.count() // max(1, (few_a if near == "user_a" else few_b) or 0)))
    parts = max(1, -(-parallelism(pairs.sparkSession) // stripes), -(-sends // (stripes * 2 * stripe_entries)))
    fine = sized.filter("NOT odd").select("user", F.col(f"in_{near[-1]}").alias("is_near"), F.col(f"in_{far[-1]}").alias("is_far"))
    history = F.collect_list(F.struct("item", "rate"))
    packed = cut_lineage(cells.join(fine, "user").groupBy("user", "is_near", "is_far").agg(history.alias("c")).select(
        "user", "is_near", "is_far", F.col("c.item").alias("items"), F.col("c.rate").alias("rates")))
    stripe = F.pmod(F.xxhash64("user"), F.lit(stripes)).cast("int")
    held = packed.filter("is_far").select(stripe.alias("stripe"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"),
                                          "user", "items", "rates", F.lit(None).cast("array<bigint>").alias("others"))
    listed = pairs.select(F.col(near).cast("bigint").alias("near"), F.col(far).cast("bigint").alias("user"))
    listed = listed.groupBy("near", stripe.alias("stripe")).agg(F.sort_array(F.collect_list("user")).alias("all"))
    step = F.lit(PAIRS_SENT)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / step).cast("int")), lambda i: F.slice("all", i * step + 1, step))
    listed = listed.select(F.col("near").alias("user"), "stripe", F.posexplode(cut).alias("nth", "others"))
    sent = packed.filter("is_near").drop("is_near", "is_far").join(listed, "user").select(
        "stripe", F.pmod(F.xxhash64("user", "nth"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "user", "items", "rates", "others")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, stripe = None, [], None
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            kind = batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(kind) != 0), True]) if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                piece = batch.slice(a, b - a)
                if cell[a] != at:
                    at, own, stripe = cell[a], [], None
                if kind[a] == 0:
                    own.append(piece)
                    continue
                if stripe is None and own:
                    stripe, own = _stripe_of(own), []
                if stripe is not None:  # else no user of the stripe has ratings
                    yield from _matched(stripe, piece)

    cell = (F.col("stripe") * parts + F.col("part")).alias("cell")
    placed = held.union(sent).select(cell, "kind", "user", "items", "rates", "others").repartitionById(stripes * parts, F.col("cell"))
    met = placed.sortWithinPartitions("cell", "kind").mapInArrow(meet, "near bigint, far bigint, common bigint, correlation double")
    kinds = dict(pairs.dtypes)
    names = {near: "near", far: "far"}
    out = met.select(*[F.col(names[c]).cast(kinds[c]).alias(c) for c in ("user_a", "user_b")], "common", "correlation")
    if not strange:
        return out
    hot = sized.filter("odd")
    by_a = hot.select(F.col("user").cast(kinds["user_a"]).alias("user_a"), F.lit(True).alias("_hot_a"))
    by_b = hot.select(F.col("user").cast(kinds["user_b"]).alias("user_b"), F.lit(True).alias("_hot_b"))
    rest = pairs.join(by_a, "user_a", "left").join(by_b, "user_b", "left").filter("_hot_a OR _hot_b").select("user_a", "user_b")
    return out.unionByName(_joined_statistics(rest, ratings))


def pearson(pairs: DataFrame, ratings: DataFrame, min_common: int = 3) -> DataFrame:
    """Correlation over common items as 0..100; 0 with fewer than `min_common` or none defined."""
    pairs = cut_lineage(pairs.select("user_a", "user_b").distinct())
    stats = pair_statistics(pairs, ratings)
    known = (F.col("common") >= min_common) & F.col("correlation").isNotNull()
    value = F.least(F.greatest((F.col("correlation") + 1) * 50, F.lit(0.0)), F.lit(100.0))
    return (pairs.join(stats, ["user_a", "user_b"], "left")
            .select("user_a", "user_b", F.coalesce("common", F.lit(0)).alias("common"),
                    F.coalesce(F.when(known, value), F.lit(0.0)).alias("similarity")))
