"""Greedy diversity: walk a ranked list, keep an item if no kept item is too similar.

The walk is sequential by nature, but only among rows that clash with nothing kept so far. It goes in rounds: the first `pool`
rows of every list are walked; for queries that are not full then, all rows left are filtered against the few kept ones,
in parallel, and the first `pool` that remain are walked next. Every round keeps at least one more item of an open query, and
what it sorts or holds per query is `pool` rows and n kept ones, however long the list is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import dot, l2_normalise
from ..session import cut_lineage, fits
from .ordering import top_k

POOL = 500
_DIGITS = 9  # of a cosine that is compared with the threshold, so that the order of a sum does not matter


def _walk(head: DataFrame, extra: str, clashes: Callable) -> DataFrame:
    """Rows kept of `head(query_id, item_id, _place, _room, extra)`, at most `_room` per query; a head has few rows per query."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, kept_ids, kept_extras = None, [], []
        for batch in batches:
            out = []
            queries, items, rooms = (batch.column(c).to_pylist() for c in ("query_id", "item_id", "_room"))
            extras = batch.column(extra)
            for i, (q, item, room) in enumerate(zip(queries, items, rooms)):
                if q != query:
                    query, kept_ids, kept_extras = q, [], []
                if len(kept_ids) >= room:
                    continue
                own = extras[i].values.to_numpy(zero_copy_only=False) if extras[i].is_valid else None
                if not clashes(own, kept_ids, kept_extras):
                    kept_ids.append(item)
                    kept_extras.append(own)
                    out.append(i)
            if out:
                yield batch.select(["query_id", "item_id", extra]).take(pa.array(out))

    kept = head.select("query_id", "item_id", "_place", "_room", extra).repartition("query_id").sortWithinPartitions("query_id", "_place")
    kind = head.schema[extra].dataType.simpleString()
    return kept.mapInArrow(keep, f"query_id bigint, item_id bigint, `{extra}` {kind}")


def _diversify(recs: DataFrame, order: list[Column], extra: str, attach: Callable[[DataFrame], DataFrame],
               n: int, pool: int, clashes: Callable, meets: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """`clashes(own, kept ids, kept extras)` decides in the walk, `meets` says the same of whole columns."""
    recs = cut_lineage(recs)

    def walked(rows: DataFrame, room: Column) -> DataFrame:
        # The cut to `pool` rows per query happens in each partition, before the shuffle.
        head = top_k(rows, ["query_id"], order, pool, "_place").withColumn("_room", room)
        return _walk(head if extra in head.columns else attach(head), extra, clashes)

    kept = cut_lineage(walked(recs, F.lit(n)))
    rest = recs
    for _ in range(n):
        counts = kept.groupBy("query_id").agg(F.count("*").alias("_n"))
        lengths = rest.groupBy("query_id").agg(F.count("*").alias("_len")).filter(F.col("_len") > pool)
        open_ = cut_lineage(lengths.join(counts, "query_id", "left").select("query_id", F.coalesce("_n", F.lit(0)).alias("_n"))
                            .filter(F.col("_n") < n))
        if open_.isEmpty():
            break
        held = kept.groupBy("query_id").agg(F.collect_list(extra).alias("_extras"), F.collect_list("item_id").alias("_ids"))  # at most n
        sets = open_.join(held, "query_id")
        if fits(open_, 1024 * n):
            sets = F.broadcast(sets)
        left = (rest if extra in rest.columns else attach(rest)).drop("_n").join(sets, "query_id")
        left = left.filter(~F.array_contains("_ids", F.col("item_id")) & ~F.coalesce(meets(F.col(extra), F.col("_ids"), F.col("_extras")), F.lit(False)))
        rest = cut_lineage(left.drop("_ids", "_extras"))
        kept = cut_lineage(kept.unionByName(walked(rest, n - F.col("_n"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))  # at most n rows per query
    return kept.select("query_id", "item_id").join(recs, ["query_id", "item_id"]).withColumn("rank", rank).select(*recs.columns, "rank")


def diversify_by_vectors(recs: DataFrame, order: list[Column], vectors: DataFrame, n: int, threshold: float = 0.7,
                         pool: int = POOL) -> DataFrame:
    """No two kept items have a cosine above `threshold`; items without a vector clash with none."""
    unit = vectors.select(F.col("id").alias("item_id"), l2_normalise(F.col("vec")).alias("_vec"))

    def clashes(own, kept_ids, kept_extras) -> bool:
        return own is not None and any(k is not None and round(float(np.dot(own, k)), _DIGITS) > threshold for k in kept_extras)

    def meets(own: Column, ids: Column, extras: Column) -> Column:
        return F.exists(extras, lambda k: F.round(dot(own, k), _DIGITS) > threshold)

    return _diversify(recs, order, "_vec", lambda d: d.join(unit, "item_id", "left"), n, pool, clashes, meets)


def diversify_by_lists(recs: DataFrame, order: list[Column], close: DataFrame, n: int, pool: int = POOL) -> DataFrame:
    """No item is kept that lists a kept one in `close(query_id, id)`, its short list of too similar items."""
    lists = close.groupBy(F.col("query_id").alias("item_id")).agg(F.collect_list("id").alias("_close"))

    def clashes(own, kept_ids, kept_extras) -> bool:
        return own is not None and not set(own.tolist()).isdisjoint(kept_ids)

    def meets(own: Column, ids: Column, extras: Column) -> Column:
        return F.arrays_overlap(own, ids)

    return _diversify(recs, order, "_close", lambda d: d.join(lists, "item_id", "left"), n, pool, clashes, meets)
