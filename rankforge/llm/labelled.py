"""Labelled texts for fits on the driver, bounded in rows and in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, each: bool = False, seed: int = 7) -> DataFrame:
    """(doc_id, label, text_key, text): at most `max_rows` labelled documents with at most `max_bytes` of text in all, in hash order.

    Both bounds hold after the join, so a labelled id that many rows share brings no more than they allow; equal rows are one.
    A text that does not fit what is left of the bytes is passed over. `each`: half of the rows and bytes for either label.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").distinct()
    kinds = [(F.col("label") == y, max_rows // 2, max_bytes // 2) for y in (0, 1)] if each else [(F.lit(True), max_rows, max_bytes)]
    by_hash = known.withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    chosen = None
    for of_kind, rows, _ in kinds:
        part = by_hash.filter(of_kind).orderBy("_h", "doc_id", "label").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    keyed = docs.select("doc_id", "text").join(F.broadcast(chosen.drop("_h")), "doc_id").withColumn("text_key", F.xxhash64("text"))
    sizes = keyed.groupBy("doc_id", "label", "text_key").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    picked = []
    for of_kind, rows, left in kinds:
        order = F.xxhash64("doc_id", "text_key", F.lit(seed))
        for r in sizes.filter(of_kind).orderBy(order, "doc_id", "label", "text_key").limit(rows).collect():  # four numbers each
            if r["size"] <= left:
                left -= r["size"]
                picked.append((r["doc_id"], r["label"], r["text_key"]))
    names = ["doc_id", "label", "text_key"]
    wanted = F.broadcast(spark.createDataFrame(picked, keyed.select(*names).schema))
    return keyed.join(wanted, names).groupBy(*names).agg(F.first("text").alias("text"))
