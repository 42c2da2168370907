"""Positions, dense ids, top-k and samples that never pull one group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits


def global_positions(df: DataFrame, keys: list[str], name: str = "position",
                     running: dict[str, str] | None = None) -> DataFrame:
    """Add the 0-based position of each row in the total order of `keys`.

    `running` maps a numeric column to the name of its running sum in that order. Rows are
    range-partitioned and sorted locally, so that a hot leading key is spread over many partitions
    as long as all `keys` together are selective. The sorted rows are written once: a range shuffle
    samples its bounds, and a second run could draw others. Only one row per partition is then added
    up and broadcast.
    """
    running = running or {}
    placed = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id()))
    placed = cut_lineage(placed)
    part = F.shiftrightunsigned("_mid", _ROW_BITS).cast("int")
    row = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in running])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition

    def ahead(c: str) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    offsets = sizes.select("_part", ahead("_n").alias("_before"),
                           *[ahead(f"_sum_{c}").alias(f"_before_{c}") for c in running])
    out = (placed.withColumn("_part", part).withColumn("_row", row)
           .join(F.broadcast(offsets), "_part")
           .withColumn(name, (F.col("_before") + F.col("_row")).cast("bigint")))
    inside = Window.partitionBy("_part").orderBy("_row")
    for c, total in running.items():
        out = out.withColumn(total, F.col(f"_before_{c}") + F.sum(c).over(inside))
    return out.drop("_part", "_row", "_before", "_mid", *[f"_before_{c}" for c in running])


def group_ranks(df: DataFrame, group: list[str], order: list[str], rank: str = "rn",
                size: str = "group_size") -> DataFrame:
    """Add the 1-based rank in the group and the group size, without a window over the group."""
    placed = global_positions(df, group + order, "_position")
    starts = placed.groupBy(*group).agg(F.min("_position").alias("_start"), F.count("*").alias(size))
    return (placed.join(starts, group)
            .withColumn(rank, F.col("_position") - F.col("_start") + 1)
            .drop("_position", "_start"))


def dense_ids(df: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """Distinct `keys` with dense sequential ids in key order, beginning at `start`."""
    found = global_positions(df.select(*keys).dropna().distinct(), keys, "_position")
    return found.select(*keys, (F.col("_position") + start).alias(name))


def extend_ids(known: DataFrame, new: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Ids for keys of `new` that `known` lacks, continuing after the largest known id."""
    missing = new.select(*keys).distinct().join(known, keys, "left_anti")
    last = known.agg(F.coalesce(F.max(name), F.lit(0))).scalar()
    fresh = dense_ids(missing, keys, "_id")
    return fresh.select(*keys, (last + 1 + F.col("_id")).alias(name))


def apply_ids(df: DataFrame, mapping: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """Replace `column` by the mapped id; rows without one are dropped."""
    pairs = mapping.select(F.col(key).alias(column), F.col(name).alias("_to"))
    kept = [F.col("_to").alias(name) if c == column else F.col(c) for c in df.columns]
    return df.join(pairs, column).select(*kept)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """First k rows of each group, ranked 1..k; Spark cuts each partition to k before the shuffle."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return numbered.filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key in `order` (which must be total)."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def stable_key(columns: list[str], seed: int) -> Column:
    """A hash to order by; the same on every engine, run and partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows chosen by hash of `keys`; repeatable."""
    return (df.withColumn("_h", stable_key(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h"))
