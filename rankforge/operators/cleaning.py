"""Row filters, validation and preparation of ratings and item tables."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import nested, numeric, text
from .ordering import dense_ids, first_per_key

log = logging.getLogger(__name__)


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns of `wanted` that exist, in that order; the others are logged."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        log.warning("columns not found: %s", missing)
    return df.select(*[c for c in wanted if c in df.columns])


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows that are null in any of `columns`, or blank where the column is text."""
    kinds = dict(df.dtypes)
    tests = [text.is_blank(F.col(c)) if kinds[c] == "string" else F.col(c).isNull() for c in columns]
    return df.filter(~reduce(lambda a, b: a | b, tests))


def drop_sparse_entities(ratings: DataFrame, min_user: int | None = 10, min_item: int | None = 10) -> DataFrame:
    """Users with >= min_user rows and items with >= min_item rows, both counted on the input."""
    out = ratings
    for key, least in (("user_id", min_user), ("item_id", min_item)):
        if least is not None:
            busy = ratings.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
            out = out.join(busy.select(key), key, "left_semi")
    return out


def recent_rows(df: DataFrame, days: int, column: str = "ts") -> DataFrame:
    """Rows of the last `days` days before the latest row."""
    latest = df.agg(F.max(column)).scalar()
    return df.filter(F.col(column) >= latest - F.expr(f"INTERVAL {days} DAYS"))


def liked(requests: DataFrame, least: float = 3.0) -> DataFrame:
    return requests.filter(F.col("rating").isNull() | (F.col("rating") >= least))


def filter_recommendations(recs: DataFrame, item_map: DataFrame, media_type: str | None = None,
                           languages: list[str] | None = None, excluded: DataFrame | None = None,
                           strict: bool = False) -> DataFrame:
    """Keep rows of one media type that share a language with the request.

    Unset (or the literal 'string') means 'movie' and ['en']. A row without a language passes
    unless `strict`. `excluded` holds item ids to leave out.
    """
    kind = media_type if media_type and media_type != "string" else "movie"
    wanted = [x for x in languages or [] if x and x != "string"] or ["en"]
    spoken = text.name_list(F.lower(F.col("spoken_languages")))
    overlap = F.arrays_overlap(spoken, F.array(*[F.lit(x.lower()) for x in wanted]))
    passes = overlap if strict else overlap | (F.size(spoken) == 0)
    allowed = item_map.filter((F.col("media_type") == kind) & passes)
    out = recs.join(allowed.select("item_id").distinct(), "item_id", "left_semi")
    if excluded is not None:
        out = out.join(excluded.select("item_id"), "item_id", "left_anti")
    return out


def check_requests(requests: DataFrame, ids: str = "item_ids", ratings: str = "ratings", n: str = "n") -> DataFrame:
    """Add `problem`: why a request is refused, null when it is accepted."""
    bad = F.exists(ratings, lambda r: r.isNull() | (r < 0) | (r > 5))
    return requests.withColumn("problem", F.when(F.size(ids) != F.size(ratings), "length")
                               .when(bad, "rating").when(~F.col(n).between(1, 100), "n"))


def map_requests(requests: DataFrame, item_map: DataFrame, external: str = "ext_id") -> DataFrame:
    """External ids of requests to item ids; unknown ids are dropped."""
    return requests.join(item_map.select(external, "item_id"), external).drop(external)


def attach_external(recs: DataFrame, item_map: DataFrame, columns: list[str]) -> DataFrame:
    """Item ids of results back to external ids and titles; unknown ids are dropped."""
    return recs.join(item_map.select("item_id", *columns), "item_id")


def combine_rating_files(ratings: DataFrame, movies: DataFrame, links: DataFrame, key: str = "item_id") -> DataFrame:
    """Ratings with title, genres and external id; rows without a match on either side vanish."""
    return ratings.join(movies, key).join(links, key)


def join_and_drop_right_key(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right, F.col(left_key) == F.col(right_key)).drop(right_key)


def fill_rating_with_mean(ratings: DataFrame) -> DataFrame:
    """Missing rating -> mean of all ratings."""
    mean = ratings.agg(F.avg("rating")).scalar()
    return ratings.withColumn("rating", F.coalesce("rating", mean))


def fill_rating_cascade(ratings: DataFrame) -> DataFrame:
    """Missing rating -> mean of the user, else of the item, else of all."""
    known = ratings.filter(F.col("rating").isNotNull())
    users = known.groupBy("user_id").agg(F.avg("rating").alias("_u"))
    items = known.groupBy("item_id").agg(F.avg("rating").alias("_i"))
    mean = known.agg(F.avg("rating")).scalar()
    return (ratings.join(users, "user_id", "left").join(items, "item_id", "left")
            .withColumn("rating", F.coalesce("rating", "_u", "_i", mean)).drop("_u", "_i"))


def mode_of(df: DataFrame, column: str, default) -> Column:
    """Most frequent value (the smallest when tied) as a scalar; `default` when there is none."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    top = counts.agg(F.min_by(column, F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias(column))
    return F.coalesce(top.scalar(), F.lit(default))


def impute_years(df: DataFrame, column: str = "release_year", default: int = 2000) -> DataFrame:
    """Non-numeric, missing or outside 1900..2025 -> most frequent valid year."""
    year = numeric.to_number(F.col(column), "int")
    valid = df.select(F.when(year.between(1900, 2025), year).alias("_y"))
    return df.withColumn(column, numeric.impute_year(year, mode_of(valid, "_y", default)))


# Columns of a prepared item table, in order (fixed values).
PREPARED = ["ext_id", "media_type", "title", "overview", "spoken_languages", "vote_average", "release_year",
            "genres", "director", "cast", "keywords"]


def prepare_items(raw: DataFrame) -> DataFrame:
    """Raw item documents (nested arrays) -> flat item rows without blanks in overview and genres."""
    flat = raw.select(
        "ext_id", "media_type", "title", "overview",
        nested.joined_names(F.col("spoken_languages"), "iso_639_1").alias("spoken_languages"),
        numeric.to_number(F.col("vote_average")).alias("vote_average"),
        nested.release_year(F.col("release_date")).alias("release_year"),
        nested.joined_names(F.col("genres")).alias("genres"),
        nested.role_names(F.col("credits")).alias("director"),
        nested.role_names(F.col("credits"), ("cast",)).alias("cast"),
        nested.joined_names(F.col("keywords")).alias("keywords"))
    return drop_missing(flat, ["ext_id", "title", "overview", "genres"])


def preprocess_items(prepared: DataFrame) -> DataFrame:
    """Clean text, lists and numbers of prepared items."""
    out = impute_years(drop_missing(prepared, ["ext_id", "title"]))
    return out.select(
        "ext_id", "media_type", "title",
        text.clean_text(F.col("overview")).alias("overview"),
        text.clean_list_field(F.col("spoken_languages")).alias("spoken_languages"),
        numeric.clip_round(F.coalesce(F.col("vote_average"), F.lit(0.0))).alias("vote_average"),
        "release_year",
        text.clean_list_field(F.col("genres")).alias("genres"),
        text.clean_list_field(F.col("director")).alias("director"),
        text.clean_list_field(F.col("cast")).alias("cast"),
        text.keyword_tokens(F.col("keywords")).alias("keywords"))


def number_items(prepared: DataFrame, keys: list[str] = ["ext_id", "media_type"]) -> tuple[DataFrame, DataFrame]:
    """(items with item_id 1..N, item map); one row per key, the first by title."""
    order = [F.col(c).asc_nulls_last() for c in prepared.columns if c not in keys]
    unique = first_per_key(prepared, keys, order)
    numbered = unique.join(dense_ids(unique, keys, "item_id", start=1), keys)
    return numbered, numbered.select(*keys, "title", "spoken_languages", "item_id")
