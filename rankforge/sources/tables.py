"""Logical views `ratings`, `items`, `vectors`, `content_items` over the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per rating event; `l_orderkey, l_linenumber` break ties between equal times."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
        F.col("o_orderdate").alias("ts"),
        "l_orderkey", "l_linenumber")


def ratings_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, item): mean rating and latest time."""
    return ratings(spark, sf_dir).groupBy("user_id", "item_id").agg(
        F.avg("rating").alias("rating"), F.max("ts").alias("ts"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.array("p_type", "p_brand").alias("genres"),
        (F.col("p_retailprice") / 200).alias("vote_average"))


def item_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their genres as one `|`-joined string, the shape of a rating file."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"),
        F.concat_ws("|", "p_type", "p_brand").alias("genres"))


def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("overview"),
        F.col("lang").alias("spoken_languages"), F.col("source").alias("media_type"))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("int").alias("label"))


def event_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as ratings: the event type is the genre, the value the rating."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("genre"), F.col("value").alias("rating"), "ts")
