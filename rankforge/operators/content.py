"""Content-based suggestions over item vectors `(id, vec)` and an item map.

`item_map(item_id, ext_id, media_type, spoken_languages, title)`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric, text
from ..functions.vectors import max_vector, mean_vector
from .cleaning import drop_missing, filter_recommendations
from .explore import request_majority
from ..session import cut_lineage
from .features import apply_field_model
from .neighbours import nearest, nearest_within
from .ordering import dense_ids, extend_ids, first_per_key, top_k


def _finish(found: DataFrame, n: int, key: str = "similarity") -> DataFrame:
    return top_k(found, ["query_id"], [F.desc(key), F.asc("item_id")], n)


def _allowed(vectors: DataFrame, item_map: DataFrame, media_type: str | None, languages: list[str] | None,
             strict: bool = False) -> DataFrame:
    """Vectors of the items a request may get; filtered before the search, so lists are short only if items are few."""
    kept = filter_recommendations(vectors.withColumnRenamed("id", "item_id"), item_map, media_type, languages, strict=strict)
    return kept.withColumnRenamed("item_id", "id")


def _similarities(found: DataFrame, n: int) -> DataFrame:
    return _finish(found.select("query_id", F.col("id").alias("item_id"),
                                numeric.similarity(F.col("score"), "cosine").alias("similarity")), n)


def similar_items(queries: DataFrame, vectors: DataFrame, item_map: DataFrame, n: int = 10,
                  media_type: str | None = None, languages: list[str] | None = None) -> DataFrame:
    """Items like one known item each, of the media type and languages wanted: `queries(query_id, item_id)`."""
    asked = queries.join(vectors.select(F.col("id").alias("item_id"), "vec"), "item_id")
    asked = asked.select("query_id", "vec", F.array("item_id").alias("own"))
    return _similarities(nearest(asked, _allowed(vectors, item_map, media_type, languages), n, skip="own"), n)


def similar_to_vectors(queries: DataFrame, vectors: DataFrame, item_map: DataFrame, n: int = 10,
                       media_type: str | None = None, languages: list[str] | None = None,
                       strict: bool = False) -> DataFrame:
    """Items like given feature vectors `(query_id, vec)`, of unknown items or custom metadata.

    `strict` drops items without a language, as discovery does. Nothing is stored.
    """
    return _similarities(nearest(queries, _allowed(vectors, item_map, media_type, languages, strict), n), n)


def similar_to_several(queries: DataFrame, vectors: DataFrame, item_map: DataFrame, n: int = 10,
                       weights: tuple[float, float, float] = (0.5, 0.25, 0.25)) -> DataFrame:
    """Items like several known ones: `queries(query_id, item_id)`.

    Candidates are of the most common media type and of all languages of the inputs (or of no known
    language), less the inputs. The lists of each item, of the mean vector and of the max-pooled vector
    (the best 3n each) are added up with `weights`. Media type and language are the cells of the search.
    """
    known = queries.join(vectors.select(F.col("id").alias("item_id"), "vec"), "item_id")
    # One search for all three kinds: each kind of each query gets its own search id.
    single = known.select("query_id", "vec", F.lit(weights[0]).alias("w"), F.col("item_id").alias("_s"), F.lit(0).alias("_k"))
    pooled = known.groupBy("query_id").agg(mean_vector(F.col("vec")).alias("a"), max_vector(F.col("vec")).alias("m"))
    none = F.lit(0).cast("bigint").alias("_s")
    several = (single.withColumn("vec", F.col("vec").cast("array<double>"))
               .unionByName(pooled.select("query_id", F.col("a").alias("vec"), F.lit(weights[1]).alias("w"), none, F.lit(1).alias("_k")))
               .unionByName(pooled.select("query_id", F.col("m").alias("vec"), F.lit(weights[2]).alias("w"), none, F.lit(2).alias("_k"))))
    keys = ["query_id", "_s", "_k"]
    several = cut_lineage(several.join(dense_ids(several, keys, "_search"), keys))

    def spoken(c: str) -> Column:
        return text.name_list(F.lower(F.col(c)))

    inputs = queries.join(item_map.select("item_id", "media_type", "spoken_languages"), "item_id")
    kind = request_majority(inputs, "media_type").filter(F.col("rank") == 1).select("query_id", F.col("value").alias("_kind"))
    wanted = inputs.select("query_id", F.explode(spoken("spoken_languages")).alias("x")).groupBy(
        "query_id").agg(F.collect_set("x").alias("_wanted"))
    # A language is a cell of its media type; so is no language, and all of them for inputs that name none.
    cells = F.when(F.col("_wanted").isNull(), F.array(F.lit("*"))).otherwise(F.concat(F.col("_wanted"), F.array(F.lit(""))))
    # What a query must not get travels with the items, once for all searches of the query.
    owners = several.groupBy("query_id").agg(F.min("_search").alias("owner"))
    barred = queries.join(owners, "query_id").groupBy(F.col("item_id").alias("id")).agg(F.collect_set("owner").alias("barred"))
    asked = several.join(kind, "query_id").join(wanted, "query_id", "left").join(owners, "query_id")
    asked = asked.withColumn("_lang", F.explode(cells)).select(
        F.col("_search").alias("query_id"), "vec", "owner", F.concat_ws("|", "_kind", "_lang").alias("cell"))
    own = F.concat(F.when(F.size(spoken("spoken_languages")) > 0, F.array_distinct(spoken("spoken_languages"))).otherwise(
        F.array(F.lit(""))), F.array(F.lit("*")))
    base = vectors.join(item_map.select(F.col("item_id").alias("id"), "media_type", F.explode(own).alias("_lang")), "id").join(barred, "id", "left").select(
        "id", "vec", F.concat_ws("|", "media_type", "_lang").alias("cell"), "barred")
    found = nearest_within(asked, base, 3 * n, barred=True)
    labelled = found.select(F.col("query_id").alias("_search"), F.col("id").alias("item_id"),
                            numeric.similarity(F.col("score"), "cosine").alias("s")).join(
        several.select("_search", "query_id", "w"), "_search")
    combined = labelled.groupBy("query_id", "item_id").agg(numeric.steady_round(F.sum(F.col("s") * F.col("w")), 6).alias("similarity"))
    return _finish(combined, n)


def with_percent(found: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Lists `(query_id, id, score)` less the item asked for, ranked, with the score as a percentage."""
    raw = found.select("query_id", F.col("id").alias("item_id"), numeric.similarity(F.col("score"), "cosine").alias("raw_score"))
    others = raw.join(queries, ["query_id", "item_id"], "left_anti")
    return _finish(others.withColumn("similarity", numeric.percent_text(F.col("raw_score"))), n, "raw_score")


def register_items(item_map: DataFrame, new: DataFrame, keys: list[str] = ["ext_id", "media_type"]) -> DataFrame:
    """Map rows of new items that `item_map` lacks, numbered after its largest item_id."""
    fresh = extend_ids(item_map, new, keys, "item_id")
    others = [c for c in item_map.columns if c not in keys and c != "item_id"]
    one = new.groupBy(*keys).agg(*[F.min(c).alias(c) for c in others]) if others else new.select(*keys).distinct()
    return one.join(fresh, keys).select(*item_map.columns)


def add_items(item_map: DataFrame, new: DataFrame, folder: str, batch: int, features: Callable[[DataFrame], DataFrame],
              clean: Callable[[DataFrame], DataFrame] | None = None, keys: list[str] = ["ext_id", "media_type"]) -> dict[str, DataFrame]:
    """Register a batch of items: unknown keys get ids, their cleaned rows and features are written beside the map.

    Tables `map`, `processed` and `features` under `folder` get one partition `batch=N` each, which a second run of
    the batch overwrites. `features` maps cleaned rows with an item_id to features; known items are not touched.
    """
    spark = new.sparkSession
    rows = drop_missing(clean(new) if clean else new, keys)
    others = [F.col(c).asc_nulls_last() for c in rows.columns if c not in keys]
    rows = cut_lineage(first_per_key(rows, keys, others or [F.lit(0).asc()]))
    fresh = cut_lineage(extend_ids(item_map.select(*keys, "item_id"), rows, keys, "item_id"))
    paths = {name: f"{folder.rstrip('/')}/{name}/batch={batch}" for name in ("map", "processed", "features")}
    fresh.write.mode("overwrite").parquet(paths["map"])
    rows.join(fresh, keys).select("item_id", *rows.columns).write.mode("overwrite").parquet(paths["processed"])
    features(spark.read.parquet(paths["processed"])).write.mode("overwrite").parquet(paths["features"])
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def similar_to_unknown(new: DataFrame, model: dict[str, DataFrame], base: DataFrame, n: int, stop_words: list[str] | None = None,
                       min_score: float | None = None, id: str = "item_id", **fields) -> DataFrame:
    """`(query_id, item_id, similarity, rank)` for items that are in no table yet: rows with the text, names and genres of the model.

    They get features under the fitted model and are searched among `base(id, vec)`; nothing is written.
    """
    known = apply_field_model(new, model, stop_words, id, **fields)
    found = nearest(known.select(F.col("id").alias("query_id"), "vec"), base, n, min_score=min_score)
    return found.select("query_id", F.col("id").alias("item_id"), F.col("score").alias("similarity"), "rank")
