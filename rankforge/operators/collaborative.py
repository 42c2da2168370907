"""Collaborative methods; each answers a whole table of requests in one job.

`ratings(user_id, item_id, rating[, ts])` holds one row per pair. `requests(query_id, item_id,
rating)` are the ratings a query comes with. Neighbour tables have the shape `nearest` returns:
`(query_id, id, score, rank)`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric
from ..functions.vectors import cosine, mean_vector, scale, sum_vector, zeros
from ..session import cut_lineage, fits, parallelism
from . import factors as mf
from .cleaning import liked
from .diversity import diversify_by_lists, diversify_by_vectors
from .neighbours import nearest
from .ordering import global_positions, top_k

_SALT = 16
_HISTORY = 50_000        # entries of a packed list, about
_ROWS_PER_PART = 50_000  # ratings per partition where the terms of queries are summed up; each brings many
_FIRST_LOOK = 8


def item_stats(ratings: DataFrame) -> DataFrame:
    """Per item: count and mean of ratings, and bias against the global mean."""
    mean = ratings.agg(F.avg("rating")).scalar()
    return ratings.groupBy("item_id").agg(F.count("*").alias("item_count"), F.avg("rating").alias("item_mean")).select(
        "item_id", "item_count", "item_mean", (F.col("item_mean") - mean).alias("item_bias"))


def user_stats(ratings: DataFrame) -> DataFrame:
    """Per user: mean and sample deviation; none or 0 counts as 1."""
    std = F.stddev_samp("rating")
    return ratings.groupBy("user_id").agg(
        F.avg("rating").alias("user_mean"), F.when(std > 0, std).otherwise(1.0).alias("user_std"))


def popularity(ratings: DataFrame) -> DataFrame:
    """0.7 * normalised count + 0.3 * normalised mean per item."""
    stats = ratings.groupBy("item_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"))

    def spread(c: str) -> Column:
        return numeric.min_max(F.col(c), stats.agg(F.min(c)).scalar(), stats.agg(F.max(c)).scalar())

    return stats.select("item_id", "n", "mean", numeric.popularity(spread("n"), spread("mean")).alias("popularity"))


def _without_rated(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    return candidates.join(requests.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")


def _ranked(recs: DataFrame, order: list[Column], n: int) -> DataFrame:
    return top_k(recs, ["query_id"], [*order, F.asc("item_id")], n)


# ---- neighbourhood methods ------------------------------------------------------------------------

def item_based(requests: DataFrame, ratings: DataFrame, neighbours: DataFrame, n: int = 20,
               candidates: int = 100, predict_from: int = 50, min_similarity: float = 0.1,
               diversity: float | None = None) -> DataFrame:
    """Item-based prediction from the rated items among each candidate's nearest items.

    Confidence below 0.4 pulls the prediction to the item mean; no rated neighbour gives the item
    mean with confidence 0. `diversity` drops items closer than that to a better one.
    """
    stats = item_stats(ratings)
    seeds = liked(requests).select("query_id", "item_id", "rating")
    near = cut_lineage(neighbours.filter((F.col("rank") <= candidates) & (F.col("score") >= min_similarity)).select(
        F.col("query_id").alias("of"), F.col("id"), numeric.clip(F.col("score"), 0.0, 1.0).alias("sim"), "rank"))
    # What a seed leads to: the items of its own list are candidates (no `sim`), and those that have it among their nearest,
    # at most `predict_from`, are predicted from it. The two lists travel packed, once per seed.
    leads = near.select(F.col("of").alias("seed"), F.col("id").alias("item_id"), F.lit(None).cast("double").alias("sim")).unionByName(
        near.filter(F.col("rank") <= predict_from).select(F.col("id").alias("seed"), F.col("of").alias("item_id"), "sim"))
    columns = ["item_id", "sim"]
    weight = F.least(F.col("item_count") / 5, F.lit(2.0))
    known = F.col("query_id").isNotNull() & F.col("rating").isNotNull()
    rated = seeds.join(stats, "item_id", "left").select(
        "query_id", F.col("item_id").alias("seed"), (F.col("rating") - F.col("item_mean")).alias("dev"),
        F.when(known, weight).alias("pop"))
    records = rated.join(_packed(leads, "seed", columns), "seed").drop("seed")
    w = F.col("sim") * F.col("pop")
    found = _by_query(records, seeds, columns, 4 * ratings.count()).groupBy("query_id", "item_id").agg(
        F.sum(w * F.col("dev")).alias("wd"), F.sum(F.abs(w)).alias("ws"), F.count(w).alias("k"),
        F.max("_own").alias("_own"), F.max(~F.col("_own") & F.col("sim").isNull()).alias("_lead")).filter("_lead AND NOT _own")
    joined = found.join(_shared(stats.select("item_id", "item_mean"), 16), "item_id", "left")
    conf = F.col("ws") / F.col("k") * F.least(F.col("k") / 5, F.lit(1.0))
    raw = F.col("item_mean") + F.col("wd") / F.col("ws")
    pulled = F.when(conf < 0.4, raw * conf + F.col("item_mean") * (1 - conf)).otherwise(raw)
    has = F.col("ws") > 0
    recs = joined.filter(F.col("item_mean").isNotNull()).select(
        "query_id", "item_id",
        numeric.steady_round(numeric.clip(F.when(has, pulled).otherwise(F.col("item_mean")), 1.0, 5.0), 2).alias("predicted_rating"),
        numeric.steady_round(F.when(has, conf).otherwise(0.0), 3).alias("confidence"))
    order = [F.desc("predicted_rating"), F.desc("confidence")]
    if diversity is None:
        return _ranked(recs, order, n)
    lists = neighbours.filter((F.col("rank") <= 20) & (F.col("score") > diversity))
    return diversify_by_lists(recs, [*order, F.asc("item_id")], lists, n)


def _packed(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`columns` of all rows of a key as arrays, at most about `_HISTORY` long: a longer history takes several rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    group = [key]
    if most > _HISTORY:
        hot = counts.filter(F.col("_n") > _HISTORY).select(key, F.ceil(F.col("_n") / _HISTORY).alias("_parts"))  # few: each has many rows
        rows = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(*columns), F.coalesce("_parts", F.lit(1))))
        group.append("_part")
    lists = rows.groupBy(*group).agg(F.collect_list(F.struct(*columns)).alias("_h"))
    return lists.select(key, *[F.col(f"_h.{c}").alias(c) for c in columns])


def _by_query(records: DataFrame, requests: DataFrame, columns: list[str], n_rows: int) -> DataFrame:
    """The arrays of `records(query_id, ..., columns)` as rows, all of a query in one partition, so that sums by query and
    item need no further shuffle; only whole arrays travel. The items of the requests are there too, marked by `_own`.
    """
    asked = requests.filter("query_id IS NOT NULL AND item_id IS NOT NULL").groupBy("query_id").agg(F.collect_list("item_id").alias("item_id"))
    types = dict(records.dtypes)
    others = [c for c in records.columns if c not in ("query_id", "item_id")]
    own = asked.select("query_id", "item_id", F.lit(True).alias("_own"), *[
        (F.array() if c in columns else F.lit(None)).cast(types[c]).alias(c) for c in others])
    both = records.withColumn("_own", F.lit(False)).unionByName(own)
    parts = max(parallelism(records.sparkSession), n_rows // _ROWS_PER_PART)
    kept = [c for c in both.columns if c not in columns]
    return both.repartition(parts, "query_id").select(*kept, F.inline(F.arrays_zip(*columns)))


def _shared(df: DataFrame, row_bytes: int) -> DataFrame:
    """A table by item or query, written once, and broadcast if it is small: what it is joined to need not move then."""
    df = cut_lineage(df)
    return F.broadcast(df) if fits(df, row_bytes) else df


def _neighbour_sums(requests: DataFrame, near: DataFrame, rated: DataFrame, columns: list[str], *sums: Column) -> DataFrame:
    """`sums` by query and item over the ratings of the neighbours `near(query_id, user_id, sim, ...)`; rated items left out.

    The histories `rated(user_id, item_id, columns)` travel to the queries packed, once per neighbour; the terms do not.
    """
    columns = ["item_id", *columns]
    records = near.join(_packed(rated.select("user_id", *columns), "user_id", columns), "user_id").drop("user_id")
    terms = _by_query(records, requests, columns, rated.count())
    return terms.groupBy("query_id", "item_id").agg(*sums, F.max("_own").alias("_own")).filter("NOT _own").drop("_own")


def _with_means(neighbours: DataFrame, ratings: DataFrame) -> DataFrame:
    means = ratings.groupBy("user_id").agg(F.avg("rating").alias("mean"))
    return neighbours.select("query_id", F.col("id").alias("user_id"), F.col("score").alias("sim")).join(means, "user_id")


def _dev() -> Column:
    return F.col("rating") - F.col("mean")


def active_means(requests: DataFrame) -> DataFrame:
    return requests.groupBy("query_id").agg(F.avg("rating").alias("active_mean"))


def user_based(requests: DataFrame, ratings: DataFrame, neighbours: DataFrame, n: int = 20,
               min_similarity: float = 0.1, n_neighbours: int = 50, candidates: int | None = None,
               diversity: float | None = None, item_vectors: DataFrame | None = None) -> DataFrame:
    """User-based prediction over the items of the nearest users.

    `candidates` keeps only so many per query, by rating, similarity and popularity; unset, all are predicted. Confidence below 0.3 blends the prediction with active mean + item bias.
    """
    stats = _shared(item_stats(ratings), 32)
    near = neighbours.filter((F.col("score") >= min_similarity) & (F.col("rank") <= n_neighbours)).withColumn(
        "score", numeric.clip(F.col("score"), 0.0, 1.0))
    sums = _neighbour_sums(
        requests, _with_means(near, ratings), ratings, ["rating"],
        F.sum(F.col("rating") * F.col("sim")).alias("rs"), F.sum(_dev() * F.col("sim")).alias("ds"),
        F.sum("sim").alias("ss"), F.count("sim").alias("k")).join(stats, "item_id")
    score = numeric.steady_round(F.col("rs") * F.least(F.log(F.col("item_count") + 1), F.lit(3.0)), 6)
    best = sums
    if candidates is not None:
        best = top_k(sums.withColumn("_score", score), ["query_id"], [F.desc("_score"), F.asc("item_id")], candidates, "_r")
    pop = F.least(F.col("item_count") / 10, F.lit(2.0))
    conf = (F.col("ss") * pop / F.col("k") * F.least(F.col("k") / 8, F.lit(1.0))
            * F.least(F.col("item_count") / 20, F.lit(1.0)))
    joined = best.join(_shared(active_means(requests), 16), "query_id").withColumn("_conf", conf)
    raw = F.col("active_mean") + F.col("ds") / F.col("ss")
    base = F.col("active_mean") + F.col("item_bias")
    value = F.when(F.col("ss") <= 0, base).when(F.col("_conf") < 0.3, raw * F.col("_conf") + base * (1 - F.col("_conf"))).otherwise(raw)
    recs = joined.select(
        "query_id", "item_id", numeric.steady_round(numeric.clip(value, 1.0, 5.0), 2).alias("predicted_rating"),
        numeric.steady_round(F.when(F.col("ss") > 0, F.col("_conf")).otherwise(0.0), 3).alias("confidence"))
    order = [F.desc("predicted_rating"), F.desc("confidence")]
    if diversity is None:
        return _ranked(recs, order, n)
    return diversify_by_vectors(recs, [*order, F.asc("item_id")], item_vectors, n, diversity)


def simple_user_based(requests: DataFrame, ratings: DataFrame, neighbours: DataFrame, n: int = 20,
                      min_similarity: float = 0.0, by: str = "similarity") -> DataFrame:
    """Active mean plus the similarity-weighted mean deviation of the neighbours.

    Ranked by the sum of similarities, or by the prediction (`by="prediction"`).
    """
    near = neighbours.filter(F.col("score") >= min_similarity)
    sums = _neighbour_sums(requests, _with_means(near, ratings), ratings, ["rating"],
                           F.sum(_dev() * F.col("sim")).alias("ds"), F.sum("sim").alias("ss")).filter(F.col("ss") > 0)
    value = numeric.clip(F.col("active_mean") + F.col("ds") / F.col("ss"), 1.0, 5.0)
    recs = sums.join(_shared(active_means(requests), 16), "query_id").select(
        "query_id", "item_id", numeric.steady_round("ss", 4).alias("similarity"), numeric.steady_round(value, 2).alias("predicted_rating"))
    first = "similarity" if by == "similarity" else "predicted_rating"
    return _ranked(recs, [F.desc(first)], n)


def bias_user_based(requests: DataFrame, ratings: DataFrame, neighbours: DataFrame, n: int = 20,
                    min_similarity: float = 0.0) -> DataFrame:
    """User-based prediction on ratings less user mean and item bias; ranked by prediction."""
    stats = item_stats(ratings).select("item_id", "item_bias")
    near = neighbours.filter(F.col("score") >= min_similarity)
    rated = ratings.join(stats, "item_id")
    sums = _neighbour_sums(
        requests, _with_means(near, ratings), rated, ["rating", "item_bias"],
        F.sum((_dev() - F.col("item_bias")) * F.col("sim")).alias("ds"), F.sum("sim").alias("ss"),
        F.max("item_bias").alias("item_bias")).filter(F.col("ss") > 0)
    value = F.col("ds") / F.col("ss") + F.col("active_mean") + F.col("item_bias")
    recs = sums.join(_shared(active_means(requests), 16), "query_id").select(
        "query_id", "item_id", numeric.steady_round("ss", 4).alias("similarity"), numeric.steady_round(value, 2).alias("predicted_rating"),
        numeric.steady_round(F.least(F.lit(100.0), F.col("ss") / 10), 4).alias("confidence"))
    return _ranked(recs, [F.desc("predicted_rating")], n)


def decayed_predictions(requests: DataFrame, rated: DataFrame, neighbours: DataFrame, query_stats: DataFrame,
                        as_of: Column, factor: float, min_similarity: float = 0.3) -> DataFrame:
    """`(query_id, item_id, predicted)` from the neighbours' z-scores, weighted by similarity and age.

    `rated(user_id, item_id, z, ts)`; `query_stats(query_id, mean, std)`. Weights that cancel out
    leave no prediction.
    """
    near = neighbours.filter(F.col("score") > min_similarity).select(
        "query_id", F.col("id").alias("user_id"), F.col("score").alias("sim"))
    aged = cut_lineage(rated.select("user_id", "item_id", "z", numeric.time_decay(F.col("ts"), as_of, factor).alias("decay")))
    w = F.col("sim") * F.col("decay")
    sums = _neighbour_sums(requests, near, aged, ["z", "decay"], F.sum(w * F.col("z")).alias("wz"),
                           F.sum(F.abs(w)).alias("ws")).filter(F.col("ws") > 0)
    value = numeric.clip(F.col("wz") / F.col("ws") * F.col("std") + F.col("mean"), 1.0, 5.0)
    return sums.join(query_stats, "query_id").select("query_id", "item_id", value.alias("predicted"))


def predicted_or_mean(pairs: DataFrame, predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """`(query_id, item_id, predicted, source)` of given pairs: the neighbours' prediction, else the item's mean, else the mean of the items' means."""
    means = item_stats(ratings).select("item_id", "item_mean")
    overall = means.agg(F.avg("item_mean")).scalar()
    joined = (pairs.select("query_id", "item_id").distinct().join(predictions.select("query_id", "item_id", "predicted"), ["query_id", "item_id"], "left")
              .join(means, "item_id", "left"))
    source = F.when(F.col("predicted").isNotNull(), "neighbours").when(F.col("item_mean").isNotNull(), "item").otherwise("all")
    return joined.select("query_id", "item_id", F.coalesce("predicted", "item_mean", overall).alias("predicted"), source.alias("source"))


def guest_stats(queries: DataFrame, ratings: DataFrame) -> DataFrame:
    """`(query_id, mean, std)` of guests: the averages over all known users."""
    stats = user_stats(ratings)
    return queries.select("query_id").distinct().select(
        "query_id", stats.agg(F.avg("user_mean")).scalar().alias("mean"),
        stats.agg(F.avg("user_std")).scalar().alias("std"))


def blended(requests: DataFrame, ratings: DataFrame, predictions: DataFrame, n: int = 10,
            weight: float = 0.8) -> DataFrame:
    """Best n of 0.8 * prediction + 0.2 * popularity over all items a query has not rated.

    Items without a prediction count with their mean. Their order is the same for every query, so a
    query with m rated or predicted items needs only the first n + m of that order.
    """
    predictions = cut_lineage(predictions)
    pop = cut_lineage(popularity(ratings).select("item_id", "mean", "popularity"))
    share = 1 - weight
    scored = _without_rated(predictions, requests).join(pop, "item_id").select(
        "query_id", "item_id", numeric.steady_round(weight * F.col("predicted") + share * F.col("popularity"), 6).alias("score"))
    default = pop.select("item_id", numeric.steady_round(weight * F.col("mean") + share * F.col("popularity"), 6).alias("score"))
    ordered = global_positions(default.withColumn("_down", -F.col("score")), ["_down", "item_id"], "_at")
    taken = requests.select("query_id", "item_id").unionByName(predictions.select("query_id", "item_id")).distinct()
    needs = cut_lineage(taken.groupBy("query_id").agg((F.count("*") + n).alias("_need")))
    # Every query asks for the first positions: salt both sides, or those keys would be hot.
    salt = F.pmod(F.xxhash64("query_id"), F.lit(_SALT)).cast("int")
    salted = cut_lineage(ordered.select("_at", "item_id", "score",
                                        F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))).alias("_salt")))

    def free(wanted: DataFrame) -> DataFrame:
        asked = wanted.select("query_id", salt.alias("_salt"),
                              F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_need") - 1)).alias("_at"))
        return asked.join(salted, ["_at", "_salt"]).select("query_id", "item_id", "score").join(
            taken, ["query_id", "item_id"], "left_anti")

    # Most queries find n free items within a few times n positions; the others go on to their whole need.
    few = _FIRST_LOOK * n
    first = cut_lineage(free(needs.withColumn("_need", F.least(F.col("_need"), F.lit(few).cast("bigint")))))
    found = first.groupBy("query_id").agg(F.count("*").alias("_free")).filter(F.col("_free") >= n)
    unfilled = needs.filter(F.col("_need") > few).join(found, "query_id", "left_anti")
    rest = first.join(unfilled, "query_id", "left_anti").unionByName(free(unfilled))
    return _ranked(scored.unionByName(rest), [F.desc("score")], n)


def cold_start(queries: DataFrame, ratings: DataFrame, n: int = 10) -> DataFrame:
    """The n most popular items for each query."""
    best = popularity(ratings).select("item_id", numeric.steady_round("popularity", 6).alias("score")).orderBy(
        F.desc("score"), "item_id").limit(n)
    ranked = best.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("d"), "item_id", "score"))).alias("x"))
    return queries.select("query_id").distinct().withColumn("_x", ranked.scalar()).select(
        "query_id", F.posexplode("_x").alias("_p", "_e")).select(
        "query_id", "_e.item_id", "_e.score", (F.col("_p") + 1).alias("rank"))


# ---- vector methods -------------------------------------------------------------------------------

def query_vectors(requests: DataFrame, vectors: DataFrame, weight: Column | None = None) -> DataFrame:
    """`(query_id, vec, n_seeds, seeds)`: (weighted) mean vector of the known items of each query, and all its items."""
    known = requests.join(vectors.select(F.col("id").alias("item_id"), "vec"), "item_id")
    means = known.groupBy("query_id").agg(
        mean_vector(F.col("vec"), weight).alias("vec"), F.count("*").cast("int").alias("n_seeds"))
    return means.join(_seeds(requests), "query_id")


def _seeds(requests: DataFrame) -> DataFrame:
    return requests.groupBy("query_id").agg(F.collect_set("item_id").alias("seeds"))


def _listed(found: DataFrame, n: int) -> DataFrame:
    return _ranked(found.withColumnRenamed("id", "item_id").drop("rank"), [F.desc("score")], n)


def similar_to_seeds(requests: DataFrame, vectors: DataFrame, n: int = 10, min_similarity: float = 0.1) -> DataFrame:
    """Nearest n items of the mean vector that are not seeds."""
    return _listed(nearest(query_vectors(requests, vectors), vectors, n, min_score=min_similarity, skip="seeds"), n)


def seed_weighted(requests: DataFrame, vectors: DataFrame, n: int = 10, min_similarity: float = 0.1,
                  weighting: str = "softmax", found: DataFrame | None = None) -> DataFrame:
    """Nearest items of the mean vector, with ratings predicted from their cosine to each seed.

    Weights are softmax of the cosines, or the cosines themselves (`linear`; the mean rating when
    they sum to 0). `found` replaces the exact search, for example by one in cells that skips the seeds.
    """
    if found is None:
        found = nearest(query_vectors(requests, vectors), vectors, n, min_score=min_similarity, skip="seeds")
    best = _listed(found, n)
    of_item = vectors.select(F.col("id").alias("item_id"), "vec")
    seeds = requests.join(of_item, "item_id").select("query_id", F.col("vec").alias("seed_vec"), "rating")
    both = best.join(of_item, "item_id").join(seeds, "query_id").withColumn("_cos", cosine(F.col("vec"), F.col("seed_vec")))
    w = F.exp("_cos") if weighting == "softmax" else F.col("_cos")
    sums = both.groupBy("query_id", "item_id", "score", "rank").agg(
        F.sum(w * F.col("rating")).alias("wr"), F.sum(w).alias("ws"), F.avg("rating").alias("mean"))
    value = F.when(F.abs("ws") > 1e-12, F.col("wr") / F.col("ws")).otherwise(F.col("mean"))
    return sums.select("query_id", "item_id", numeric.steady_round(value, 2).alias("predicted_rating"), "score", "rank")


def rating_weighted(requests: DataFrame, vectors: DataFrame, n: int = 10) -> DataFrame:
    """Nearest items of the rating-weighted mean vector, predicted at the mean given rating."""
    best = _listed(nearest(query_vectors(requests, vectors, F.col("rating")), vectors, n, skip="seeds"), n)
    return best.join(active_means(requests), "query_id").select(
        "query_id", "item_id", F.when(F.col("score") != 0, numeric.steady_round("active_mean", 2)).otherwise(0.0).alias("predicted_rating"),
        numeric.steady_round("score", 4).alias("score"), "rank")


def fold_in_users(requests: DataFrame, components: DataFrame, item_vectors: DataFrame, dim: int) -> DataFrame:
    """`(query_id, vec)` of unseen users in the space of a fitted SVD.

    The ratings less the user's own mean are multiplied with the components `(idx, vec)` of the items.
    If no item is known there, the item vectors are averaged with weight |rating - mean| + 0.1; if
    none of those is known either, the mean of all item vectors is taken.
    """
    centred = requests.join(active_means(requests), "query_id").withColumn("_c", F.col("rating") - F.col("active_mean"))
    turned = centred.join(components.select(F.col("idx").cast("bigint").alias("item_id"), "vec"), "item_id")
    first = turned.groupBy("query_id").agg(sum_vector(scale(F.col("vec"), F.col("_c"))).alias("a"))
    weighted = query_vectors(centred, item_vectors, F.abs("_c") + 0.1).select("query_id", F.col("vec").alias("b"))
    overall = item_vectors.agg(mean_vector(F.col("vec"))).scalar()
    return (requests.select("query_id").distinct().join(first, "query_id", "left").join(weighted, "query_id", "left")
            .select("query_id", F.coalesce("a", "b", overall, zeros(dim)).alias("vec")))


# ---- factor models --------------------------------------------------------------------------------

def factor_recommend(requests: DataFrame, model: dict[str, DataFrame], dim: int, n: int = 10) -> DataFrame:
    """Best n unrated items for folded-in users of a factor model, all items scored.

    The item bias rides along as one more dimension, so the search is one by inner product.
    """
    users = cut_lineage(mf.fold_in(requests, model, dim))
    queries = users.join(_seeds(requests), "query_id").select("query_id", F.concat("vec", F.array(F.lit(1.0))).alias("vec"), "seeds")
    base = model["item_factors"].join(model["item_bias"], "item_id").select(
        F.col("item_id").alias("id"), F.concat("vec", F.array("item_bias")).alias("vec"))
    best = _listed(nearest(queries, base, n, metric="dot", skip="seeds"), n)
    total = model["mean"].scalar() + F.col("user_bias") + F.col("score")
    return best.join(users.select("query_id", "user_bias"), "query_id").select(
        "query_id", "item_id", numeric.steady_round(total, 6).alias("score"), "rank")


def factor_similar(requests: DataFrame, model: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """Items with the largest inner product with the mean factors of the seeds, seeds left out."""
    base = model["item_factors"].withColumnRenamed("item_id", "id")
    return _listed(nearest(query_vectors(requests, base), base, n, metric="dot", skip="seeds"), n)


def both_lists(requests: DataFrame, item_lists: DataFrame, user_lists: DataFrame) -> DataFrame:
    """Item-based and user-based lists of each request in one table, with its status."""
    columns = ["query_id", "item_id", "predicted_rating", "confidence", "rank"]
    lists = item_lists.select(*columns, F.lit("item_based").alias("kind")).unionByName(
        user_lists.select(*columns, F.lit("user_based").alias("kind")))
    kinds = lists.groupBy("query_id").agg(F.count_distinct("kind").alias("_kinds"))
    status = F.when(F.col("_kinds") == 2, "success").when(F.col("_kinds") == 1, "partial").otherwise("none")
    asked = requests.select("query_id").distinct().join(kinds, "query_id", "left").select("query_id", status.alias("status"))
    return asked.join(lists, "query_id", "left")
