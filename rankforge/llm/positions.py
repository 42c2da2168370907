"""Row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add `name`: the row's number in its group, without gaps from 0; equal rows get different numbers.

    Rows are numbered inside (group, hash of `order`) chunks and one count per chunk is added up, so
    a group of any size is spread over many tasks. The order is by chunk, then by `order`.
    """
    chunks = 4 * max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy(*group, "_chunk").agg(F.count("*").alias("_n"))
              .select(*group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    return (df.withColumn("_row", F.row_number().over(inside) - 1).join(starts, [*group, "_chunk"])
            .withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_row", "_start", "_chunk"))
