"""Documents to packed training sequences: toxicity, quality rules, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. Each stage's result is written as Parquet and read again as the next one's input, so a lost
executor or driver costs one stage at most. The classifiers learn from `labels` and the documents the stage is given;
labels of held-out rows are never read. A document that loses all its words to earlier ones stays with an empty text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankforge.llm import ngram_join, packing, quality, substring, toxicity
from rankforge.session import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out("doc_id"))


def _rows(docs: DataFrame) -> DataFrame:
    """The columns that are worked on, and the whole row beside them, so that no name can clash."""
    return docs.select("doc_id", "text", F.struct(*COLUMNS).alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score(_rows(docs), model, carry=["_row"]).filter(F.col("score") < TOXIC).select("_row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, _labels(spark, sf_dir))
    return quality.judge(_rows(docs), model, carry=["_row"]).filter("kept").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, with its smallest doc_id (a null one only where all are null); rows without words all stay."""
    first = ngram_join.survivors(docs.select("doc_id", "text"))
    first = first.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_first"), F.col("wordless").alias("_wordless"))
    keyed = docs.select(*COLUMNS, ngram_join.text_key("text").alias("_key"))
    kept = keyed.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_first")))
    own = kept.withColumn("_own", F.when(F.col("_wordless"), F.monotonically_increasing_id()))
    again = F.row_number().over(Window.partitionBy("doc_id", "_key", "_own").orderBy(F.lit(1)))
    return own.withColumn("_n", again).filter("_n = 1").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = docs.select("doc_id", "text", F.struct("lang", "source", "n_chars").alias("_row"))
    out = substring.remove_repeats(rest, carry=["_row"])
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("_row.n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "_row.lang", "_row.source", size.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("ngram_jaccard_join", drop_near_duplicates),
          ("substring_dedup", drop_repeated_passages), ("packing", pack)]
ORACLE_SQL = None  # trained models and a linear program are not SQL; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
