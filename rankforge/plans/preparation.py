"""Preparation of ratings and items: filters, joins, ids, splits, text and nested fields."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import nested, numeric, text
from ..operators import cleaning, content, ordering, splits
from ..operators.features import hash_names
from ..session import shared_dir
from ..sources import (content_items, event_ratings, load_json_array, load_many, load_model_tables, load_table, ratings, ratings_agg, save_item_features,
                       save_json_arrays, save_long_matrix, save_many, save_model_tables, save_table, table)
from .registry import RATINGS, RATINGS_AGG, query

TIES = ["l_orderkey", "l_linenumber", "item_id", "rating"]


@query("drop_sparse_entities", f"""
WITH {RATINGS}
SELECT user_id, item_id, rating, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM ratings
WHERE user_id IN (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 30)
  AND item_id IN (SELECT item_id FROM ratings GROUP BY 1 HAVING count(*) >= 30)""", floats=("rating",))
def drop_sparse_entities(spark, sf):
    return cleaning.drop_sparse_entities(ratings(spark, sf), 30, 30).drop("ts")


@query("drop_sparse_users", f"""
WITH {RATINGS}
SELECT user_id, count(*) AS n FROM ratings GROUP BY 1 HAVING count(*) >= 40""")
def drop_sparse_users(spark, sf):
    kept = cleaning.drop_sparse_entities(ratings(spark, sf), 40, None)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"))


@query("dense_user_ids", f"""
WITH {RATINGS}
SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM ratings)""")
def dense_user_ids(spark, sf):
    return ordering.dense_ids(ratings(spark, sf), ["user_id"], "user_idx")


@query("apply_item_ids", f"""
WITH {RATINGS},
ids AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS item_idx FROM (SELECT DISTINCT item_id FROM ratings))
SELECT user_id, item_idx, rating, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber
FROM ratings JOIN ids USING (item_id)""", floats=("rating",))
def apply_item_ids(spark, sf):
    rows = ratings(spark, sf).drop("ts")
    ids = ordering.dense_ids(rows, ["item_id"], "item_idx", start=1)
    return ordering.apply_ids(rows, ids, "item_id", "item_id", "item_idx")


_CHRONO = f"""
WITH {RATINGS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, l_orderkey, l_linenumber, item_id, rating) AS rn,
                  count(*) OVER (PARTITION BY user_id) AS n FROM ratings),
marked AS MATERIALIZED (SELECT *, rn <= CASE WHEN n = 1 THEN 1 ELSE least(greatest(floor(n * 0.8), 1), n - 1) END AS is_train FROM ranked),
known AS (SELECT *, bool_or(is_train) OVER (PARTITION BY user_id) AND bool_or(is_train) OVER (PARTITION BY item_id) AS seen FROM marked)
SELECT user_id, item_id, rating, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, ts FROM known WHERE """


@query("chrono_split_train", _CHRONO + "is_train", floats=("rating",), times=("ts",))
def chrono_split_train(spark, sf):
    return splits.chronological_split(ratings(spark, sf), TIES)[0]


@query("chrono_split_test", _CHRONO + "NOT is_train AND seen",
       floats=("rating",), times=("ts",))
def chrono_split_test(spark, sf):
    return splits.chronological_split(ratings(spark, sf), TIES)[1]


_HASHED = f"""
WITH {RATINGS_AGG},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id
                  ORDER BY md5(concat_ws('|', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR), '42')), item_id) AS rn,
                  count(*) OVER (PARTITION BY user_id) AS n FROM ra),
marked AS (SELECT *, rn <= least(ceil(n * CAST(0.2 AS DOUBLE)), n - 1) AS is_test FROM ranked)
SELECT user_id, item_id, rating FROM marked WHERE """


@query("hash_split_train", _HASHED + "NOT is_test", floats=("rating",))
def hash_split_train(spark, sf):
    return splits.hashed_split(ratings_agg(spark, sf).drop("ts"), ["user_id", "item_id"])[0]


@query("hash_split_test", _HASHED + "is_test", floats=("rating",))
def hash_split_test(spark, sf):
    return splits.hashed_split(ratings_agg(spark, sf).drop("ts"), ["user_id", "item_id"])[1]


@query("sample_users", f"""
WITH {RATINGS}
SELECT user_id FROM (SELECT DISTINCT user_id FROM ratings)
ORDER BY md5(concat_ws('|', CAST(user_id AS VARCHAR), '42')), user_id LIMIT 100""")
def sample_users(spark, sf):
    return ordering.sample_rows(ratings(spark, sf).select("user_id").distinct(), 100, ["user_id"])


@query("recent_events", """
SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def recent_events(spark, sf):
    return cleaning.recent_rows(event_ratings(spark, sf), 7).select("event_id", "user_id")


@query("liked_ratings", f"WITH {RATINGS_AGG} SELECT user_id, item_id, rating FROM ra WHERE rating IS NULL OR rating >= 3",
       floats=("rating",))
def liked_ratings(spark, sf):
    return cleaning.liked(ratings_agg(spark, sf)).drop("ts")


@query("filter_recommendations", """
SELECT doc_id AS item_id, n_chars FROM documents
WHERE source = 'src3' AND lang IN ('en', 'fr') AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def filter_recommendations(spark, sf):
    recs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "n_chars")
    seen = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    return cleaning.filter_recommendations(recs, content_items(spark, sf), "src3", ["en", "FR"], excluded=seen)


@query("check_requests", """
SELECT c_custkey AS query_id,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'length'
            WHEN c_acctbal / 2000 < 0 OR c_acctbal / 2000 > 5 OR c_nationkey / 4 > 5 THEN 'rating'
            WHEN NOT (c_nationkey BETWEEN 1 AND 100) THEN 'n' END AS problem
FROM customer""")
def check_requests(spark, sf):
    requests = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("query_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array("c_custkey")).otherwise(
            F.array("c_custkey", "c_nationkey")).alias("item_ids"),
        F.array(F.col("c_acctbal") / 2000, F.col("c_nationkey") / 4).alias("ratings"),
        F.col("c_nationkey").alias("n"))
    return cleaning.check_requests(requests).select("query_id", "problem")


@query("combine_rating_files", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey AS item_id, p_name AS title, p_type AS genres, c_name AS link
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN customer ON c_custkey = l_partkey""")
def combine_rating_files(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item_id"))
    movies = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"),
                                             F.col("p_type").alias("genres"))
    links = table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("link"))
    return cleaning.combine_rating_files(lines, movies, links, "item_id")


@query("join_drop_right_key", """
SELECT s_suppkey, s_name, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
       ints=("s_nationkey",))
def join_drop_right_key(spark, sf):
    return cleaning.join_and_drop_right_key(
        table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"),
        table(spark, sf, "nation").select("n_nationkey", "n_name"), "s_nationkey", "n_nationkey")


@query("map_requests", """
SELECT c.conv_id AS query_id, d.doc_id AS item_id, d.lang AS title
FROM conversations c JOIN documents d ON d.n_chars = length(c.text)""")
def map_requests(spark, sf):
    # The external id of a document is its length here: some requests match none, some several.
    item_map = table(spark, sf, "documents").select(
        F.col("n_chars").alias("ext_id"), F.col("doc_id").alias("item_id"), F.col("lang").alias("title"))
    requests = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), F.length("text").cast("bigint").alias("ext_id"))
    return cleaning.attach_external(cleaning.map_requests(requests, item_map), item_map, ["title"]).select(
        "query_id", "item_id", "title")


@query("register_new_items", """
WITH known AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS item_id
               FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
fresh AS (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM known))
SELECT doc_id AS ext_id, source AS media_type, (SELECT max(item_id) FROM known) + row_number() OVER (ORDER BY doc_id, source) AS item_id
FROM fresh""")
def register_new_items(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ext_id"), F.col("source").alias("media_type"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("ext_id"))
    known = docs.join(labelled, "ext_id", "left_semi")
    known = known.join(ordering.dense_ids(known, ["ext_id"], "item_id", start=1), "ext_id")
    return content.register_items(known, docs)


@query("first_per_text", "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY text, lang")
def first_per_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return ordering.first_per_key(docs, ["text", "lang"], [F.asc("doc_id")]).select("doc_id", "lang")


@query("keep_and_drop_missing", """
SELECT doc_id, lang, source FROM documents
WHERE doc_id IS NOT NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''""")
def keep_and_drop_missing(spark, sf):
    docs = cleaning.require_columns(table(spark, sf, "documents"), ["doc_id", "text"])
    kept = cleaning.drop_missing(docs, ["doc_id", "text"])
    return cleaning.keep_columns(kept, ["doc_id", "lang", "tagline", "source"])


@query("clean_text", """
SELECT doc_id,
  CASE WHEN text IS NULL OR text = '' THEN 'unknown' ELSE
    trim(regexp_replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g')), '\\s+', ' ', 'g')) END AS cleaned,
  CASE WHEN text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'Unknown' ELSE
    trim(regexp_replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\s,]', '', 'g')), '\\s+', ' ', 'g')) END AS with_commas
FROM documents""")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.clean_text(F.col("text")).alias("cleaned"),
        text.clean_text_keep_commas(F.col("text")).alias("with_commas"))


_LIST = "concat(' ', p_name, ' , ', p_type, ',  ', p_brand, ' ')"
_MIXED = "concat(p_name, ' | ', p_type, ';;', p_brand, ', ')"


@query("clean_lists", f"""
SELECT p_partkey AS item_id,
  concat(lower(p_name), ',', lower(p_type), ',', lower(p_brand)) AS list_field,
  concat(p_name, ' , ', p_type, ',', p_brand) AS multi,
  concat(lower(p_name), ' ', lower(p_type), ' ', lower(p_brand)) AS keywords,
  concat(p_name, '/', p_type) AS first_two, CAST(3 AS BIGINT) AS n_names
FROM part""")
def clean_lists(spark, sf):
    listed, mixed = F.expr(_LIST), F.expr(_MIXED)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), text.clean_list_field(listed).alias("list_field"),
        text.clean_multi_delimiter(mixed).alias("multi"), text.keyword_tokens(listed).alias("keywords"),
        F.array_join(text.first_names(mixed, 2), "/").alias("first_two"),
        F.size(text.name_list(mixed)).alias("n_names"))


@query("json_names", """
SELECT p_partkey AS item_id, concat(p_type, ', ', p_brand) AS names, concat(p_type, ', ', p_brand) AS coerced,
       concat(p_type, ', ', p_brand) AS quoted, p_name AS plain FROM part""")
def json_names(spark, sf):
    raw = """concat('[{"id":1,"name":" ', p_type, '"},{"id":2,"name":"', p_brand, '"},{"id":3}]')"""
    quoted = """concat('[\\'', p_type, '\\', \\'', p_brand, '\\']')"""
    named = """concat('[{"name":"', p_type, '"},"', p_brand, '"]')"""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        nested.joined_names(F.from_json(F.expr(raw), nested.NAMED)).alias("names"),
        nested.coerce_names(F.expr(named)).alias("coerced"), nested.coerce_names(F.expr(quoted)).alias("quoted"),
        nested.coerce_names(F.regexp_replace("p_name", " ", "  ")).alias("plain"))


@query("repair_json", """
SELECT p_partkey AS item_id, CASE WHEN p_size > 40 THEN 0 WHEN p_size > 20 THEN 2 ELSE 1 END AS n,
       CASE WHEN p_size > 40 THEN '' WHEN p_size > 20 THEN concat(p_type, '/', p_brand) ELSE p_type END AS names
FROM part""", ints=("n",))
def repair_json(spark, sf):
    glued = F.expr("""concat("{'name': '", p_type, "'}{'name': '", p_brand, "'}")""")
    good = F.expr("""concat('[{"name": "', p_type, '"}]')""")
    raw = F.when(F.col("p_size") > 40, F.col("p_name")).when(F.col("p_size") > 20, glued).otherwise(good)
    parsed = nested.repair_json_list(raw, "struct<name:string>")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.size(parsed).alias("n"), F.array_join(parsed["name"], "/").alias("names"))


@query("restructure_credits", """
SELECT s_suppkey AS item_id, s_name AS director, concat(n_name, '/', r_name) AS actors,
       concat('https://images/', n_name) AS first_image, CAST(3 AS BIGINT) AS n_credits
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def restructure_credits(spark, sf):
    joined = (table(spark, sf, "supplier")
              .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
              .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    crew = F.expr("""array(named_struct('name', s_name, 'id', s_suppkey, 'job', 'Director', 'profile_path', string(null)),
                           named_struct('name', n_name, 'id', s_suppkey, 'job', 'Editor', 'profile_path', n_name))""")
    cast = F.expr("""array(named_struct('name', n_name, 'id', bigint(n_nationkey), 'character', 'a', 'profile_path', n_name),
                           named_struct('name', r_name, 'id', bigint(r_regionkey), 'character', 'b', 'profile_path', string(null)))""")
    credits = joined.select("s_suppkey", nested.credits_from_crew_and_cast(crew, cast, "https://images/").alias("credits"))
    c = F.col("credits")
    return credits.select(
        F.col("s_suppkey").alias("item_id"), nested.role_names(c).alias("director"),
        F.regexp_replace(nested.role_names(c, ("cast",)), ", ", "/").alias("actors"),
        F.filter(c, lambda x: x["image"].isNotNull())[0]["image"].alias("first_image"), F.size(c).alias("n_credits"))


@query("release_year", """
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE year(o_orderdate) END AS release_year FROM orders""",
       ints=("release_year",))
def release_year(spark, sf):
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    raw = F.expr(f"""CASE WHEN o_orderpriority LIKE '1%' THEN concat({day}, 'T00:00:00Z')
        WHEN o_orderpriority LIKE '2%' THEN concat('{{"$date":"', {day}, 'T00:00:00Z"}}')
        WHEN o_orderpriority LIKE '3%' THEN concat('{{"$date":{{"$numberLong":"', unix_millis(to_timestamp({day})), '"}}}}')
        WHEN o_orderpriority LIKE '4%' THEN 'bad' ELSE {day} END""")
    return table(spark, sf, "orders").select("o_orderkey", nested.release_year(raw).alias("release_year"))


_RAW_YEAR = """CASE WHEN o_orderpriority LIKE '1%' THEN 'unknown' WHEN o_orderpriority LIKE '2%' THEN '1899'
        WHEN o_orderpriority LIKE '3%' THEN NULL ELSE CAST(year(o_orderdate) AS VARCHAR(4)) END"""


@query("impute_years", f"""
WITH raw AS (SELECT o_orderkey, TRY_CAST({_RAW_YEAR} AS INTEGER) AS y FROM orders),
mode AS (SELECT y FROM raw WHERE y BETWEEN 1900 AND 2025 GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)
SELECT o_orderkey, CASE WHEN y BETWEEN 1900 AND 2025 THEN y ELSE coalesce((SELECT y FROM mode), 2000) END AS release_year
FROM raw""", ints=("release_year",))
def impute_years(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", F.expr(_RAW_YEAR).alias("release_year"))
    return cleaning.impute_years(raw)


@query("clip_round", """
SELECT c_custkey, least(greatest(CAST(round_even(CAST(c_acctbal AS DECIMAL(18,3)) / 1000, 1) AS DOUBLE), 0), 10) AS clipped
FROM customer""", floats=("clipped",))
def clip_round(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numeric.clip_round(F.col("c_acctbal") / 1000).alias("clipped"))


_HOLES = """holes AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, o_custkey AS user_id, l_partkey AS item_id,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _holes(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    lines = table(spark, sf, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "user_id", F.col("l_partkey").alias("item_id"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("rating"))


@query("fill_rating_mean", f"""
WITH {_HOLES}
SELECT l_orderkey, l_linenumber, user_id, item_id, coalesce(rating, (SELECT avg(rating) FROM holes)) AS rating FROM holes""",
       floats=("rating",))
def fill_rating_mean(spark, sf):
    return cleaning.fill_rating_with_mean(_holes(spark, sf))


@query("fill_rating_cascade", f"""
WITH {_HOLES},
u AS (SELECT user_id, avg(rating) AS m FROM holes GROUP BY 1), i AS (SELECT item_id, avg(rating) AS m FROM holes GROUP BY 1)
SELECT l_orderkey, l_linenumber, h.user_id, h.item_id,
       coalesce(h.rating, u.m, i.m, (SELECT avg(rating) FROM holes)) AS rating
FROM holes h LEFT JOIN u ON h.user_id = u.user_id LEFT JOIN i ON h.item_id = i.item_id""", floats=("rating",))
def fill_rating_cascade(spark, sf):
    return cleaning.fill_rating_cascade(_holes(spark, sf))


def raw_items(spark, sf):
    """Raw item documents: nested arrays as in the source files, from documents and parts."""
    parts = table(spark, sf, "part")
    n_parts = parts.agg(F.count("*")).scalar()
    docs = table(spark, sf, "documents").withColumn("_part", F.pmod(F.col("doc_id"), n_parts))
    return docs.join(parts, F.col("_part") == F.col("p_partkey")).selectExpr(
        "doc_id AS ext_id", "source AS media_type", "p_name AS title", "text AS overview",
        "array(named_struct('iso_639_1', lang, 'name', upper(lang))) AS spoken_languages",
        "string(p_retailprice / 200) AS vote_average",
        "concat('{\"$date\":\"', 1900 + p_size, '-05-04T00:00:00Z\"}') AS release_date",
        "array(named_struct('id', 1, 'name', p_type), named_struct('id', 2, 'name', p_brand)) AS genres",
        "array(named_struct('type', 'director', 'name', p_brand), named_struct('type', 'cast', 'name', p_name),"
        " named_struct('type', 'other', 'name', 'x'), named_struct('type', 'cast', 'name', string(null))) AS credits",
        "array(named_struct('id', 1, 'name', p_type), named_struct('id', 2, 'name', ' ')) AS keywords")


@query("prepare_items", """
WITH raw AS (SELECT * FROM documents JOIN part ON p_partkey = doc_id % (SELECT count(*) FROM part)),
kept AS (SELECT * FROM raw WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '')
SELECT doc_id AS ext_id, source AS media_type, p_name AS title,
       trim(regexp_replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g')), '\\s+', ' ', 'g')) AS overview,
       lang AS spoken_languages,
       least(CAST(round_even(CAST(p_retailprice AS DECIMAL(18,4)) / 200, 1) AS DOUBLE), 10) AS vote_average,
       CAST(1900 + p_size AS BIGINT) AS release_year, concat(lower(p_type), ',', lower(p_brand)) AS genres,
       lower(p_brand) AS director, lower(p_name) AS "cast", lower(p_type) AS keywords,
       row_number() OVER (ORDER BY doc_id, source) AS item_id
FROM kept""", floats=("vote_average",))
def prepare_items(spark, sf):
    numbered, _ = cleaning.number_items(cleaning.prepare_items(raw_items(spark, sf)))
    ready = cleaning.preprocess_items(numbered)
    return ready.join(numbered.select("ext_id", "media_type", "item_id"), ["ext_id", "media_type"])


@query("wrapped_dates", """SELECT o_orderkey, '{"$date":"' || strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z"}' AS wrapped,
       year(o_orderdate) AS year, CAST(left(strftime(o_orderdate, '%Y-%m-%d'), 4) AS BIGINT) AS prefix FROM orders""", ints=("year", "prefix"))
def wrapped_dates(spark, sf):
    """Dates as restructured records hold them, the year read back from such a record, and from the first four characters."""
    dates = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    text_ = F.to_json(nested.wrapped_date(F.col("d")))
    return dates.select("o_orderkey", text_.alias("wrapped"), nested.release_year(text_).alias("year"), nested.year_prefix(F.col("d")).alias("prefix"))


@query("registered_item_tables", """
WITH d AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id, source) AS item_id FROM documents),
k AS (SELECT max(item_id) FILTER (doc_id % 2 = 0) AS n FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id, source) AS item_id FROM documents WHERE doc_id % 2 = 0)),
n AS (SELECT d.doc_id AS ext_id, d.source AS media_type, k.n + row_number() OVER (ORDER BY d.doc_id, d.source) AS item_id, text
      FROM d JOIN documents USING (doc_id, source), k WHERE d.doc_id % 2 <> 0)
SELECT ext_id, media_type, item_id, trim(regexp_replace(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g')), '\\s+', ' ', 'g')) AS overview,
       CAST('0x' || substr(md5(media_type), 1, 8) AS BIGINT) % 50 AS idx, 1.0::DOUBLE AS value FROM n""", floats=("value",))
def registered_item_tables(spark, sf):
    """Items with even ids are known; all others come as one batch: map, processed and feature tables, read back and joined."""
    shaped = lambda d: d.select(F.col("doc_id").alias("ext_id"), F.col("source").alias("media_type"), text.clean_text(F.col("text")).alias("overview"))
    docs = table(spark, sf, "documents")
    known = ordering.dense_ids(docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("ext_id"), F.col("source").alias("media_type")),
                               ["ext_id", "media_type"], "item_id", start=1)
    folder = f"{shared_dir(spark).rstrip('/')}/items-{uuid.uuid4().hex}"
    names = lambda rows: hash_names(rows, F.array("media_type"), 50, signed=False)
    made = content.add_items(known, docs, folder, 1, names, shaped)
    return made["processed"].join(made["map"], ["ext_id", "media_type", "item_id"]).join(
        made["features"].withColumnRenamed("id", "item_id"), "item_id").select("ext_id", "media_type", "item_id", "overview", "idx", "value")


@query("saved_and_loaded_tables", """SELECT kind, p_partkey, p_name FROM part, (VALUES ('csv'), ('json'), ('orc'), ('parquet'), ('set'), ('features'), ('matrix'), ('model')) k(kind)""")
def saved_and_loaded_tables(spark, sf):
    """A table through every sink and back through its scan."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    folder = f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    found = {kind: load_table(spark, save_table(part, folder, "part", kind), part.schema) for kind in ("csv", "json", "parquet", "orc")}
    save_many({"a": part, "b": part}, f"{folder}/set", "parquet")
    found["set"] = load_many(spark, f"{folder}/set", {"a": "a.parquet", "b": "b.parquet"})["b"]
    save_item_features(part, f"{folder}/features")
    save_long_matrix(part, f"{folder}/matrix")
    save_model_tables({"terms": part}, f"{folder}/model")
    found |= {name: spark.read.parquet(f"{folder}/{name}") for name in ("features", "matrix")}
    found["model"] = load_model_tables(spark, f"{folder}/model", ["terms"])["terms"]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "p_partkey", "p_name") for kind, df in found.items()])


@query("json_arrays_in_parts", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def json_arrays_in_parts(spark, sf):
    """All documents written as JSON arrays and read back by byte ranges."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    folder = f"{shared_dir(spark).rstrip('/')}/arrays-{uuid.uuid4().hex}"
    save_json_arrays(docs, folder)
    return load_json_array(spark, folder, docs.schema, in_parts=True)
