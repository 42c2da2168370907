"""Exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import cleaning, co_ratings, collaborative, explore, linalg, metrics, ordering, splits
from ..sources import event_ratings, item_titles, items, ratings, ratings_agg, table
from .registry import RATINGS, RATINGS_AGG, query

_DAYPART = """CASE WHEN hour(ts) BETWEEN 5 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'Afternoon'
    WHEN hour(ts) BETWEEN 17 AND 21 THEN 'Evening' ELSE 'Night' END"""


@query("user_activity", f"WITH {RATINGS} SELECT user_id, count(*) AS n, avg(rating) AS mean FROM ratings GROUP BY 1",
       floats=("mean",))
def user_activity(spark, sf):
    return explore.counts_and_means(ratings(spark, sf), "user_id")


@query("top_titles", f"""
WITH {RATINGS}
SELECT p_name AS title, count(*) AS n, avg(rating) AS mean FROM ratings JOIN part ON item_id = p_partkey
GROUP BY 1 ORDER BY n DESC, title LIMIT 10""", floats=("mean",))
def top_titles(spark, sf):
    titled = ratings(spark, sf).join(item_titles(spark, sf).select("item_id", "title"), "item_id")
    return explore.counts_and_means(titled, "title").orderBy(F.desc("n"), "title").limit(10)


@query("distinct_counts", f"""
WITH {RATINGS}
SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT item_id) AS item_id, count(DISTINCT rating) AS rating,
       count(DISTINCT ts) AS ts FROM ratings""")
def distinct_counts(spark, sf):
    return explore.distinct_counts(ratings(spark, sf), ["user_id", "item_id", "rating", "ts"])


@query("null_counts", """
SELECT sum((p_partkey IS NULL)::INT) AS p_partkey, sum((p_name IS NULL)::INT) AS p_name, sum((s_name IS NULL)::INT) AS s_name
FROM customer LEFT JOIN part ON p_partkey = c_custkey + 100 LEFT JOIN supplier ON s_suppkey = c_custkey""",
       ints=("p_partkey", "p_name", "s_name"))
def null_counts(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    joined = (table(spark, sf, "customer").join(part, F.col("c_custkey") + 100 == F.col("p_partkey"), "left")
              .join(suppliers, F.col("c_custkey") == F.col("s_suppkey"), "left"))
    return explore.null_counts(joined, ["p_partkey", "p_name", "s_name"])


_SUMMARY = """SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
  quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM {t}"""


@query("numeric_summary", _SUMMARY.format(c="value", t="events") + " UNION ALL " + _SUMMARY.format(
    c="user_id", t="(SELECT CAST(user_id AS DOUBLE) AS user_id FROM events)"),
       floats=("mean", "std", "min", "q25", "q50", "q75", "max"))
def numeric_summary(spark, sf):
    return explore.numeric_summary(table(spark, sf, "events"), ["value", "user_id"])


@query("value_histogram", """
WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events),
c AS (SELECT CAST(least(floor((value - lo) / w), 19) AS INT) AS bin, count(*) AS n FROM events, b GROUP BY 1)
SELECT CAST(g.bin AS BIGINT) AS bin, lo + g.bin * w AS bin_from, coalesce(n, 0) AS n
FROM b, range(20) g(bin) LEFT JOIN c ON c.bin = g.bin""", floats=("bin_from",), ints=("n",))
def value_histogram(spark, sf):
    return explore.histogram(table(spark, sf, "events"), "value", 20)


@query("rating_counts_histogram", f"""
WITH {RATINGS}, per AS (SELECT user_id, count(*) AS k FROM ratings GROUP BY 1),
b AS (SELECT min(k) AS lo, (max(k) - min(k)) / 50 AS w FROM per),
c AS (SELECT CAST(least(floor((k - lo) / w), 49) AS INT) AS bin, count(*) AS n FROM per, b GROUP BY 1)
SELECT CAST(g.bin AS BIGINT) AS bin, lo + g.bin * w AS bin_from, coalesce(n, 0) AS n
FROM b, range(50) g(bin) LEFT JOIN c ON c.bin = g.bin""", floats=("bin_from",), ints=("n",))
def rating_counts_histogram(spark, sf):
    per = ratings(spark, sf).groupBy("user_id").agg(F.count("*").alias("k"))
    return explore.histogram(per, "k", 50)


@query("genre_stats", f"""
WITH {RATINGS}, g AS (SELECT rating, unnest([p_type, p_brand]) AS genre FROM ratings JOIN part ON item_id = p_partkey)
SELECT genre, count(*) AS n, avg(rating) AS mean FROM g GROUP BY 1""", floats=("mean",))
def genre_stats(spark, sf):
    joined = ratings(spark, sf).join(item_titles(spark, sf), "item_id")
    return explore.per_exploded(joined, text.split_genres(F.col("genres")), "genre")


@query("year_counts", f"WITH {RATINGS} SELECT year(ts) AS year, count(*) AS n FROM ratings GROUP BY 1", ints=("year",))
def year_counts(spark, sf):
    return ratings(spark, sf).groupBy(F.year("ts").alias("year")).agg(F.count("*").alias("n"))


@query("year_month_crosstab", f"""
WITH {RATINGS}
SELECT year(ts) AS year, {', '.join(f'count(*) FILTER (month(ts) = {m}) AS m{m}' for m in range(1, 13))}
FROM ratings GROUP BY 1""", ints=("year",))
def year_month_crosstab(spark, sf):
    dated = ratings(spark, sf).select(F.year("ts").alias("year"), F.concat(F.lit("m"), F.month("ts")).alias("month"))
    return explore.crosstab(dated, "year", "month", [f"m{m}" for m in range(1, 13)])


@query("year_genre_share", f"""
WITH {RATINGS}, g AS (SELECT year(ts) AS year, unnest([p_type, p_brand]) AS genre FROM ratings JOIN part ON item_id = p_partkey),
c AS (SELECT year, genre, count(*) AS n FROM g GROUP BY 1, 2)
SELECT year, genre, n, n / sum(n) OVER (PARTITION BY year) AS share FROM c""", floats=("share",), ints=("year",))
def year_genre_share(spark, sf):
    joined = ratings(spark, sf).join(items(spark, sf), "item_id").select(
        F.year("ts").alias("year"), F.explode("genres").alias("genre"))
    return explore.share_per_row(joined, "year", "genre")


@query("daily_counts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1", times=("day",))
def daily_counts(spark, sf):
    return explore.daily_counts(table(spark, sf, "events"))


_WEEKDAYS = ", ".join(f"({i}, '{d}')" for i, d in enumerate(numeric.WEEKDAY_ORDER))
_PARTS = ", ".join(f"({i}, '{d}')" for i, d in enumerate(numeric.DAYPART_ORDER))


@query("weekday_counts", f"""
WITH c AS (SELECT dayname(ts) AS bucket, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(o.position AS BIGINT) AS position, o.bucket, c.n FROM (VALUES {_WEEKDAYS}) o(position, bucket) LEFT JOIN c ON c.bucket = o.bucket""")
def weekday_counts(spark, sf):
    return explore.counts_in_order(table(spark, sf, "events"), explore.weekday(F.col("ts")), numeric.WEEKDAY_ORDER)


@query("hour_counts", """
WITH c AS (SELECT hour(ts) AS bucket, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(h AS BIGINT) AS position, CAST(h AS BIGINT) AS bucket, n FROM range(24) o(h) LEFT JOIN c ON c.bucket = h""")
def hour_counts(spark, sf):
    return explore.counts_in_order(table(spark, sf, "events"), F.hour("ts"), tuple(range(24)))


@query("daypart_counts", f"""
WITH c AS (SELECT {_DAYPART} AS bucket, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(o.position AS BIGINT) AS position, o.bucket, coalesce(c.n, 0) AS n
FROM (VALUES {_PARTS}) o(position, bucket) LEFT JOIN c ON c.bucket = o.bucket""", ints=("n",))
def daypart_counts(spark, sf):
    return explore.counts_in_order(table(spark, sf, "events"), numeric.daypart(F.hour("ts")), numeric.DAYPART_ORDER,
                                   fill_zero=True)


@query("daypart_genre", f"SELECT {_DAYPART} AS daypart, event_type AS genre, count(*) AS n FROM events GROUP BY 1, 2")
def daypart_genre(spark, sf):
    return explore.daypart_counts(event_ratings(spark, sf), "genre")


@query("daypart_genre_recent", f"""
SELECT {_DAYPART} AS daypart, event_type AS genre, count(*) AS n FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2""")
def daypart_genre_recent(spark, sf):
    return explore.daypart_counts(cleaning.recent_rows(event_ratings(spark, sf), 7), "genre")


@query("average_duplicates", f"WITH {RATINGS_AGG} SELECT user_id, item_id, rating FROM ra", floats=("rating",))
def average_duplicates(spark, sf):
    return linalg.average_duplicates(ratings(spark, sf))


@query("user_means", f"""
WITH {RATINGS_AGG}
SELECT user_id, avg(rating) AS user_mean,
       CASE WHEN stddev_samp(rating) > 0 THEN stddev_samp(rating) ELSE 1.0 END AS user_std FROM ra GROUP BY 1""",
       floats=("user_mean", "user_std"))
def user_means(spark, sf):
    return collaborative.user_stats(ratings_agg(spark, sf))


@query("item_bias", f"""
WITH {RATINGS_AGG}
SELECT item_id, count(*) AS item_count, avg(rating) AS item_mean, avg(rating) - (SELECT avg(rating) FROM ra) AS item_bias
FROM ra GROUP BY 1""", floats=("item_mean", "item_bias"))
def item_bias(spark, sf):
    return collaborative.item_stats(ratings_agg(spark, sf))


@query("matrix_stats", f"""
WITH {RATINGS_AGG}, pi AS (SELECT item_id, count(*) AS n FROM ra GROUP BY 1),
c AS (SELECT (SELECT count(*) FROM customer) AS n_users, (SELECT count(*) FROM part) AS n_items,
      (SELECT count(*) FROM ra) AS nnz, (SELECT count(DISTINCT user_id) FROM ra) AS active_users)
SELECT n_users, n_items, nnz, nnz / (n_users * n_items) AS density, active_users, n_users - active_users AS empty_users,
       n_items - (SELECT count(*) FROM pi) AS empty_items, (SELECT count(*) FROM pi WHERE n BETWEEN 1 AND 5) AS items_1_to_5
FROM c""", floats=("density",), ints=("items_1_to_5",))
def matrix_stats(spark, sf):
    return explore.matrix_stats(ratings(spark, sf), table(spark, sf, "customer"), table(spark, sf, "part"))


@query("most_common_rating", f"""
WITH {RATINGS} SELECT rating FROM ratings GROUP BY 1 ORDER BY count(*) DESC, rating LIMIT 1""", floats=("rating",))
def most_common_rating(spark, sf):
    return spark.range(1).select(cleaning.mode_of(ratings(spark, sf), "rating", 0.0).alias("rating"))


@query("request_majority", """
WITH r AS (SELECT o_custkey AS query_id, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, value) AS rank, value, n FROM r""")
def request_majority(spark, sf):
    requests = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderpriority")
    return explore.request_majority(requests, "o_orderpriority")


@query("top_similar_pairs", f"""
WITH {RATINGS_AGG}, n AS (SELECT item_id, sqrt(sum(rating * rating)) AS s FROM ra GROUP BY 1),
p AS (SELECT a.item_id AS item_a, b.item_id AS item_b, sum(a.rating * b.rating) AS d
      FROM ra a JOIN ra b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT item_a, item_b, round(d / (x.s * y.s), 6) AS score FROM p JOIN n x ON item_a = x.item_id JOIN n y ON item_b = y.item_id
ORDER BY score DESC, item_a, item_b LIMIT 5""", floats=("score",))
def top_similar_pairs(spark, sf):
    # The five best pairs of all are among the five best of either item.
    best = co_ratings.similar_rows(ratings_agg(spark, sf), "item_id", "user_id", "rating", 5)
    pairs = best.select(F.least("query_id", "id").alias("item_a"), F.greatest("query_id", "id").alias("item_b"), "score")
    return pairs.distinct().orderBy(F.desc("score"), "item_a", "item_b").limit(5)


@query("trailing_genre_mean", """
SELECT user_id, event_type AS genre, ts, count(*) OVER w AS n, avg(value) OVER w AS mean_rating FROM events
WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""",
       floats=("mean_rating",), times=("ts",))
def trailing_genre_mean(spark, sf):
    return explore.trailing_mean(event_ratings(spark, sf), 7)


@query("top_items_per_user", f"""
WITH {RATINGS_AGG}
SELECT * FROM (SELECT user_id, item_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rank FROM ra)
WHERE rank <= 5""", floats=("rating",))
def top_items_per_user(spark, sf):
    return ordering.top_k(ratings_agg(spark, sf).drop("ts"), ["user_id"], [F.desc("rating"), F.asc("item_id")], 5)


@query("train_test_overlap", f"""
WITH {RATINGS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, l_orderkey, l_linenumber, item_id, rating) AS rn,
                  count(*) OVER (PARTITION BY user_id) AS n FROM ratings),
marked AS (SELECT *, rn <= CASE WHEN n = 1 THEN 1 ELSE least(greatest(floor(n * 0.8), 1), n - 1) END AS is_train FROM ranked),
a AS (SELECT DISTINCT user_id, item_id FROM marked WHERE is_train),
b AS (SELECT DISTINCT user_id, item_id FROM marked WHERE NOT is_train AND item_id IN (SELECT item_id FROM a))
SELECT coalesce(a.user_id, b.user_id) AS user_id, count(*) FILTER (a.item_id IS NOT NULL AND b.item_id IS NOT NULL) AS "both",
       count(*) FILTER (b.item_id IS NULL) AS only_left, count(*) FILTER (a.item_id IS NULL) AS only_right
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.item_id = b.item_id GROUP BY 1""")
def train_test_overlap(spark, sf):
    train, test = splits.chronological_split(ratings(spark, sf), ["l_orderkey", "l_linenumber", "item_id", "rating"])
    return metrics.overlap_sizes(train, test, "user_id", "item_id")
