"""Disk of finished steps, and tables that may travel whole."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage, fits


def beside(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df` to be joined with a table that has hot keys: sent whole to every task if it is checked to be small (then no
    key gathers rows), else joined by key, where Spark splits skewed partitions."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def settled(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and let go of the shuffle files it was made from.

    Spark deletes shuffle files once the driver's garbage collector finds their plan unused, which on a driver with
    free memory may be long after; a job of several large steps would hold the files of all of them at once.
    """
    spark = df.sparkSession
    out = cut_lineage(df)
    del df
    let_go(spark)
    return out


def let_go(spark: SparkSession) -> None:
    """Give memory that the driver no longer uses back to the system: its two heaps and Arrow's pools keep what they once had.

    Releasing Arrow's pool over the C library's allocator also returns what NumPy and Python let go of.
    """
    gc.collect()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    spark.sparkContext._jvm.System.gc()


def buckets_for(docs: DataFrame, text: str = "text", bucket_bytes: int = 16 << 20, least: int = 256) -> int:
    """Number of hash buckets so that each gets the tokens of about `bucket_bytes` of text, however large the table."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, -(-int(total) // bucket_bytes))
