"""Sinks. Every table is a directory of part files written by the executors."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

log = logging.getLogger(__name__)


def save_table(df: DataFrame, directory: str, name: str, kind: str = "csv", **options) -> str:
    """Write one table and return its path. Empty frame: ValueError. Unknown kind: CSV."""
    if df.isEmpty():
        raise ValueError(f"nothing to save for {name}")
    if kind not in ("csv", "json", "parquet", "orc"):
        log.warning("unknown file type %s, writing csv", kind)
        kind = "csv"
    path = f"{directory.rstrip('/')}/{name}.{'jsonl' if kind == 'json' else kind}"
    if kind == "csv":
        options.setdefault("header", True)
    df.write.mode("overwrite").options(**options).format(kind).save(path)
    return path


def save_json_arrays(df: DataFrame, path: str, rows: int = 1000) -> None:
    """JSON arrays of at most `rows` neighbouring rows each, one after the other in every part file."""
    numbered = df.select(F.to_json(F.struct(*df.columns)).alias("_row"), F.spark_partition_id().alias("_part"),
                         F.monotonically_increasing_id().alias("_n"))
    arrays = numbered.groupBy("_part", F.floor(F.col("_n") / rows).alias("_array")).agg(F.collect_list("_row").alias("_rows"))
    arrays.select(F.concat(F.lit("["), F.array_join("_rows", ",\n"), F.lit("]"))).write.mode("overwrite").text(path)


def save_many(tables: dict[str, DataFrame], directory: str, kind: str = "csv", **options) -> dict[str, str]:
    return {name: save_table(df, directory, name, kind, **options) for name, df in tables.items()}


def save_item_features(vectors: DataFrame, path: str) -> None:
    """`(id, vec)` rows as Parquet."""
    vectors.write.mode("overwrite").parquet(path)


def save_long_matrix(entries: DataFrame, path: str) -> None:
    """A sparse matrix as `(row, col, value)` Parquet; partitions stand for segments."""
    entries.write.mode("overwrite").parquet(path)


def save_model_tables(model: dict[str, DataFrame], path: str) -> None:
    """The tables of a fitted transformer or factor model, one Parquet directory each."""
    for name, df in model.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_model_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names}
