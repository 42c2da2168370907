"""Ranked suggestions: collaborative, content-based and hybrid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collaborative, content, diversity, hybrid, linalg
from ..operators.co_ratings import pearson, similar_rows
from ..operators.neighbours import cells_for, nearest, nearest_in_cells, train_cells

from ..functions import vectors as vx
from ..session import cut_lineage
from ..sources import embedding_vectors, ratings_agg, table
from .fragments import VECTORS, cosine_lists, row_cosine, seed_means, simple_user_lists, top, user_terms, z
from .registry import REGISTRY, RATINGS_AGG, query, steady

_CLIP = "least(greatest({}, 1.0), 5.0)"


def _rows(spark, sf):
    """The ratings, worked out once: they are read as requests, as statistics and as histories."""
    return cut_lineage(ratings_agg(spark, sf))


def _requests(rows):
    return rows.select(F.col("user_id").alias("query_id"), "item_id", "rating")


def _vectors(spark, sf):
    return embedding_vectors(spark, sf).select("id", "vec")


def user_neighbours(rows, k: int = 20):
    return similar_rows(rows, "user_id", "item_id", "rating", k)


@query("simple_user_recommendations", f"WITH {RATINGS_AGG}, {simple_user_lists('ra', 10)} SELECT * FROM c4",
       floats=("similarity", "predicted_rating"))
def simple_user_recommendations(spark, sf):
    return _simple_lists(_rows(spark, sf))


def _simple_lists(rows):
    return collaborative.simple_user_based(_requests(rows), rows, user_neighbours(rows), 10)


_STATS = """st AS (SELECT item_id, count(*) AS item_count, avg(rating) AS item_mean,
       avg(rating) - (SELECT avg(rating) FROM ra) AS item_bias FROM ra GROUP BY 1)"""


_ITEM_BASED = f"""WITH {RATINGS_AGG}, {_STATS},
{row_cosine('nn', 'ra', 'item_id', 'user_id', 100)},
near AS (SELECT query_id AS of, id, least(greatest(score, 0), 1) AS sim, rank FROM nn WHERE score >= 0.1),
seeds AS (SELECT user_id AS query_id, item_id, rating FROM ra WHERE rating >= 3),
found AS (SELECT DISTINCT query_id, id AS item_id FROM seeds JOIN near ON of = item_id),
cand AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = f.query_id AND s.item_id = f.item_id)),
t AS (SELECT s.query_id, of AS item_id, sim * least(item_count / 5, 2.0) AS w, rating - item_mean AS dev
      FROM seeds s JOIN st USING (item_id) JOIN near ON near.id = s.item_id AND near.rank <= 50),
sums AS (SELECT query_id, item_id, sum(w * dev) AS wd, sum(abs(w)) AS ws, count(*) AS k FROM t GROUP BY 1, 2),
p AS (SELECT c.query_id, c.item_id, item_mean, item_mean + wd / ws AS raw, ws / k * least(k / 5, 1.0) AS conf
      FROM cand c JOIN st USING (item_id) LEFT JOIN sums s ON s.query_id = c.query_id AND s.item_id = c.item_id),
r AS (SELECT query_id, item_id, {steady(_CLIP.format('CASE WHEN conf IS NULL THEN item_mean WHEN conf < 0.4 THEN raw * conf + item_mean * (1 - conf) ELSE raw END'), 2)} AS predicted_rating,
      {steady('coalesce(conf, 0)', 3)} AS confidence FROM p)"""


@query("item_based_recommendations", f"""{_ITEM_BASED}
{top('r', 'predicted_rating DESC, confidence DESC', 10)}""", floats=("predicted_rating", "confidence"))
def item_based_recommendations(spark, sf):
    return _item_based(_rows(spark, sf))


def _item_based(rows):
    # Read twice: forward for the candidates, backward for the predictions.
    near = cut_lineage(similar_rows(rows, "item_id", "user_id", "rating", 100))
    return collaborative.item_based(_requests(rows), rows, near, 10)


_USER_BASED = f"""WITH {RATINGS_AGG}, {_STATS},
{row_cosine('nn', 'ra', 'user_id', 'item_id', 50)},
{user_terms('ra', 'nn', 0.1)},
sums AS (SELECT query_id, t.item_id, sum(rating * sim) AS rs, sum(dev * sim) AS ds, sum(sim) AS ss, count(*) AS k FROM terms t GROUP BY 1, 2),
sc AS (SELECT s.*, item_count, item_bias FROM sums s JOIN st USING (item_id)),
p AS (SELECT query_id, item_id, m.mean + ds / ss AS raw, m.mean + item_bias AS base,
      ss * least(item_count / 10, 2.0) / k * least(k / 8, 1.0) * least(item_count / 20, 1.0) AS conf FROM sc JOIN m ON m.user_id = query_id),
r AS (SELECT query_id, item_id, {steady(_CLIP.format('CASE WHEN conf < 0.3 THEN raw * conf + base * (1 - conf) ELSE raw END'), 2)} AS predicted_rating,
      {steady('conf', 3)} AS confidence FROM p)"""


@query("user_based_recommendations", f"""{_USER_BASED}
{top('r', 'predicted_rating DESC, confidence DESC', 10)}""", floats=("predicted_rating", "confidence"))
def user_based_recommendations(spark, sf):
    return _user_based(_rows(spark, sf))


def _user_based(rows):
    return collaborative.user_based(_requests(rows), rows, user_neighbours(rows, 50), 10)


@query("bias_user_recommendations", f"""WITH {RATINGS_AGG}, {_STATS},
{row_cosine('nn', 'ra', 'user_id', 'item_id', 20)},
pr AS (SELECT l.query_id, l.id, count(*) AS common, covar_pop(a.rating, b.rating) AS c, stddev_pop(a.rating) * stddev_pop(b.rating) AS sd
       FROM nn l JOIN ra a ON a.user_id = l.query_id JOIN ra b ON b.user_id = l.id AND a.item_id = b.item_id GROUP BY 1, 2),
pl AS (SELECT query_id, id, round(CASE WHEN common >= 3 AND sd > 1e-9 THEN least(greatest((c / sd + 1) * 50, 0), 100) ELSE 0 END, 6) AS score FROM pr),
{user_terms('ra', 'pl', 1.0)},
sums AS (SELECT query_id, item_id, sum((dev - item_bias) * sim) AS ds, sum(sim) AS ss, any_value(item_bias) AS b
         FROM terms JOIN st USING (item_id) GROUP BY 1, 2 HAVING sum(sim) > 0),
r AS (SELECT query_id, item_id, {steady('ss', 4)} AS similarity, {steady('ds / ss + m.mean + b', 2)} AS predicted_rating,
      {steady('least(100.0, ss / 10)', 4)} AS confidence FROM sums JOIN m ON m.user_id = query_id)
{top('r', 'predicted_rating DESC', 10)}""", floats=("similarity", "predicted_rating", "confidence"))
def bias_user_recommendations(spark, sf):
    rows = _rows(spark, sf)
    near = user_neighbours(rows)
    pairs = near.select(F.col("query_id").alias("user_a"), F.col("id").alias("user_b"))
    scored = pearson(pairs, rows).select(F.col("user_a").alias("query_id"), F.col("user_b").alias("id"),
                                         F.round("similarity", 6).alias("score"))
    return collaborative.bias_user_based(_requests(rows), rows, scored, 10, min_similarity=1.0)


_SEED_LISTS = f"WITH {RATINGS_AGG}, {VECTORS}, {seed_means()}"
_NOT_SEED = "NOT EXISTS (SELECT 1 FROM ra WHERE ra.user_id = query_id AND ra.item_id = id)"


@query("similar_to_seeds", f"""{_SEED_LISTS}, qk AS (SELECT query_id, vec, n_seeds + 10 AS k FROM qv), {cosine_lists('nn', 'qk', 'k')},
r AS (SELECT query_id, id AS item_id, score FROM nn WHERE score >= 0.1 AND {_NOT_SEED})
{top('r', 'score DESC', 10)}""", floats=("score",))
def similar_to_seeds(spark, sf):
    return collaborative.similar_to_seeds(_requests(_rows(spark, sf)), _vectors(spark, sf), 10)


def _weighted_sql(weight: str, value: str) -> str:
    return f"""{_SEED_LISTS}, qk AS (SELECT query_id, vec, n_seeds + 10 AS k FROM qv), {cosine_lists('nn', 'qk', 'k')},
b AS (SELECT query_id, id AS item_id, score FROM nn WHERE score >= 0.1 AND {_NOT_SEED}),
best AS ({top('b', 'score DESC', 10)}),
s AS (SELECT b.query_id, b.item_id, b.score, b.rank, s.rating, list_cosine_similarity(v.vec, s.vec) AS c
      FROM best b JOIN v ON v.id = b.item_id JOIN seeds s ON s.query_id = b.query_id),
w AS (SELECT query_id, item_id, score, rank, sum({weight} * rating) AS wr, sum({weight}) AS ws, avg(rating) AS mean FROM s GROUP BY ALL)
SELECT query_id, item_id, {steady(value, 2)} AS predicted_rating, score, rank FROM w"""


@query("softmax_recommendations", _weighted_sql("exp(c)", "wr / ws"), floats=("predicted_rating", "score"))
def softmax_recommendations(spark, sf):
    return collaborative.seed_weighted(_requests(_rows(spark, sf)), _vectors(spark, sf), 10)


@query("cosine_weighted_recommendations", _weighted_sql("c", "CASE WHEN abs(ws) > 1e-12 THEN wr / ws ELSE mean END"),
       floats=("predicted_rating", "score"))
def cosine_weighted_recommendations(spark, sf):
    return _cosine_weighted(spark, sf, _rows(spark, sf))


def _cosine_weighted(spark, sf, rows):
    return collaborative.seed_weighted(_requests(rows), _vectors(spark, sf), 10, weighting="linear")


@query("cell_search_recommendations")
def cell_search_recommendations(spark, sf):
    base = _vectors(spark, sf)
    cells = train_cells(base.withColumn("vec", vx.l2_normalise(F.col("vec"))), cells_for(base.count()))
    requests = _requests(_rows(spark, sf))
    found = nearest_in_cells(collaborative.query_vectors(requests, base), base, 10, cells, min_score=0.1, skip="seeds")
    return collaborative.seed_weighted(requests, base, 10, weighting="linear", found=found)


@query("rating_weighted_recommendations", f"""WITH {RATINGS_AGG}, {VECTORS}, {seed_means('rating')},
a AS (SELECT user_id AS query_id, avg(rating) AS mean FROM ra GROUP BY 1),
qk AS (SELECT query_id, vec, n_seeds + 10 AS k FROM qv), {cosine_lists('nn', 'qk', 'k')},
b AS (SELECT query_id, id AS item_id, score FROM nn WHERE {_NOT_SEED}), best AS ({top('b', 'score DESC', 10)})
SELECT query_id, item_id, CASE WHEN score <> 0 THEN {steady('mean', 2)} ELSE 0.0 END AS predicted_rating, {steady('score', 4)} AS score, rank
FROM best JOIN a USING (query_id)""", floats=("predicted_rating", "score"))
def rating_weighted_recommendations(spark, sf):
    return collaborative.rating_weighted(_requests(_rows(spark, sf)), _vectors(spark, sf), 10)


_AS_OF, _FACTOR = "1999-01-01 00:00:00", 0.5
_ZRATED = """us AS (SELECT user_id, avg(rating) AS mean, CASE WHEN stddev_samp(rating) > 0 THEN stddev_samp(rating) ELSE 1.0 END AS std FROM ra GROUP BY 1),
zr AS (SELECT ra.user_id, item_id, (rating - mean) / std AS z, exp(-{f} * ((epoch_us(TIMESTAMP '{a}') - epoch_us(ts)) / 1e6) / 31557600) AS decay
       FROM ra JOIN us USING (user_id))""".format(f=_FACTOR, a=_AS_OF)


def _decayed_sql(stats: str) -> str:
    return f"""{row_cosine('nn', 'ra', 'user_id', 'item_id', 20)}, {_ZRATED}, qs AS ({stats}),
t AS (SELECT l.query_id, item_id, z, score * decay AS w FROM nn l JOIN zr ON zr.user_id = l.id WHERE score > 0.05
      AND NOT EXISTS (SELECT 1 FROM ra q WHERE q.user_id = l.query_id AND q.item_id = zr.item_id)),
pred AS (SELECT query_id, item_id, least(greatest(wz / ws * std + mean, 1.0), 5.0) AS predicted
         FROM (SELECT query_id, item_id, sum(w * z) AS wz, sum(abs(w)) AS ws FROM t GROUP BY 1, 2 HAVING sum(abs(w)) > 0)
         JOIN qs USING (query_id))"""


_KNOWN = "SELECT user_id AS query_id, mean, std FROM us"
_GUEST = "SELECT DISTINCT user_id AS query_id, (SELECT avg(mean) FROM us) AS mean, (SELECT avg(std) FROM us) AS std FROM ra"


def _decayed(rows, guest: bool):
    requests = _requests(rows)
    stats = collaborative.guest_stats(requests, rows) if guest else collaborative.user_stats(rows).toDF("query_id", "mean", "std")
    rated = linalg.user_z_scores(rows).select("user_id", "item_id", "z", "ts")
    as_of = F.lit(_AS_OF).cast("timestamp_ntz")
    return collaborative.decayed_predictions(requests, rated, user_neighbours(rows), stats, as_of, _FACTOR, 0.05)


@query("decayed_user_predictions", f"WITH {RATINGS_AGG}, {_decayed_sql(_KNOWN)} SELECT * FROM pred", floats=("predicted",))
def decayed_user_predictions(spark, sf):
    return _decayed(_rows(spark, sf), guest=False)


@query("decayed_pair_predictions", f"""WITH {RATINGS_AGG}, {_decayed_sql(_KNOWN)},
pairs AS (SELECT DISTINCT u.user_id AS query_id, r.item_id FROM (SELECT DISTINCT user_id FROM ra) u JOIN ra r ON r.user_id = u.user_id + 1
          UNION SELECT user_id, -1 FROM ra),
im AS (SELECT item_id, avg(rating) AS m FROM ra GROUP BY 1)
SELECT p.query_id, p.item_id, coalesce(predicted, m, (SELECT avg(m) FROM im)) AS predicted,
       CASE WHEN predicted IS NOT NULL THEN 'neighbours' WHEN m IS NOT NULL THEN 'item' ELSE 'all' END AS source
FROM pairs p LEFT JOIN pred ON pred.query_id = p.query_id AND pred.item_id = p.item_id LEFT JOIN im ON im.item_id = p.item_id""", floats=("predicted",))
def decayed_pair_predictions(spark, sf):
    """The items of the user with the next id, and one that nobody rated: where no neighbour tells, means do."""
    rows = _rows(spark, sf)
    users = rows.select(F.col("user_id").alias("query_id")).distinct()
    pairs = users.join(rows.select((F.col("user_id") - 1).alias("query_id"), "item_id"), "query_id").unionByName(
        users.withColumn("item_id", F.lit(-1).cast("bigint")))
    return collaborative.predicted_or_mean(pairs, _decayed(rows, False), rows)


def _blended_sql(stats: str) -> str:
    return f"""WITH {RATINGS_AGG}, {_decayed_sql(stats)},
s AS (SELECT item_id, count(*) AS n, avg(rating) AS mean FROM ra GROUP BY 1),
pop AS (SELECT item_id, mean, 0.7 * (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ())
        + 0.3 * (mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) AS popularity FROM s),
b AS (SELECT u.user_id AS query_id, p.item_id, {steady('0.8 * coalesce(predicted, mean) + (1 - 0.8) * popularity', 6)} AS score
      FROM (SELECT DISTINCT user_id FROM ra) u CROSS JOIN pop p LEFT JOIN pred ON pred.query_id = u.user_id AND pred.item_id = p.item_id
      WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.user_id = u.user_id AND ra.item_id = p.item_id))
{top('b', 'score DESC', 10)}"""


@query("blended_recommendations", _blended_sql(_KNOWN), floats=("score",))
def blended_recommendations(spark, sf):
    rows = _rows(spark, sf)
    return collaborative.blended(_requests(rows), rows, _decayed(rows, False), 10)


@query("guest_recommendations", _blended_sql(_GUEST), floats=("score",))
def guest_recommendations(spark, sf):
    rows = _rows(spark, sf)
    return collaborative.blended(_requests(rows), rows, _decayed(rows, True), 10)


@query("cold_start_recommendations", f"""WITH {RATINGS_AGG},
s AS (SELECT item_id, count(*) AS n, avg(rating) AS mean FROM ra GROUP BY 1),
p AS (SELECT item_id, {steady('0.7 * (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) + 0.3 * (mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ())', 6)} AS score FROM s),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM p ORDER BY rank LIMIT 10)
SELECT c_custkey AS query_id, item_id, score, rank FROM customer, t""", floats=("score",))
def cold_start_recommendations(spark, sf):
    guests = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"))
    return collaborative.cold_start(guests, ratings_agg(spark, sf), 10)


def _both_sql() -> str:
    lists = " UNION ALL ".join(
        f"SELECT query_id, item_id, predicted_rating, confidence, rank, '{kind}' AS kind FROM ({REGISTRY[name].sql})"
        for name, kind in (("item_based_recommendations", "item_based"), ("user_based_recommendations", "user_based")))
    return f"""WITH both_lists AS ({lists}),
kinds AS (SELECT query_id, count(DISTINCT kind) AS kinds FROM both_lists GROUP BY 1),
asked AS (SELECT DISTINCT o_custkey AS query_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
told AS (SELECT query_id, CASE kinds WHEN 2 THEN 'success' WHEN 1 THEN 'partial' ELSE 'none' END AS status FROM asked LEFT JOIN kinds USING (query_id))
SELECT query_id, status, item_id, predicted_rating, confidence, rank, kind FROM told LEFT JOIN both_lists USING (query_id)"""


@query("both_recommendation_lists", _both_sql())
def both_recommendation_lists(spark, sf):
    rows = _rows(spark, sf)
    return collaborative.both_lists(_requests(rows), _item_based(rows), _user_based(rows))


def _walk_sql(with_: str, source: str, order: str, n: int, unit: str, clash: str, columns: str) -> str:
    """The walk as a recursive query, a place of every list at a time; `unit(item_id, x)` is what kept items are compared by."""
    return f"""WITH RECURSIVE {with_.strip().removeprefix('WITH')},
unit AS ({unit}),
places AS (SELECT l.*, x, row_number() OVER (PARTITION BY query_id ORDER BY {order}, item_id) AS place FROM {source} l LEFT JOIN unit USING (item_id)),
walk AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS ids, CAST([] AS STRUCT(x DOUBLE[])[]) AS kept FROM places
  UNION ALL
  SELECT w.query_id, p.place, CASE WHEN {clash} THEN w.ids ELSE list_append(w.ids, p.item_id) END,
         CASE WHEN {clash} THEN w.kept ELSE list_append(w.kept, {{'x': p.x}}) END
  FROM walk w JOIN places p ON p.query_id = w.query_id AND p.place = w.place + 1 WHERE len(w.ids) < {n}),
ends AS (SELECT query_id, arg_max(ids, place) AS ids FROM walk GROUP BY 1),
chosen AS (SELECT query_id, unnest(ids) AS item_id, generate_subscripts(ids, 1) AS rank FROM ends)
SELECT query_id, item_id, {columns}, rank FROM chosen JOIN {source} USING (query_id, item_id)"""


def _near_vectors(threshold: float) -> str:
    return f"len(list_filter(w.kept, lambda k: round(list_inner_product(k.x, p.x), 9) > {threshold})) > 0"


_UNIT = "SELECT vec_id AS item_id, list_transform(CAST(embedding AS DOUBLE[]), lambda y: y / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS x FROM embeddings"


@query("diverse_recommendations", _walk_sql(f"WITH seeded AS (SELECT * EXCLUDE rank FROM ({REGISTRY['similar_to_seeds'].sql}))", "seeded", "score DESC", 5, _UNIT,
                                            _near_vectors(0.3), "score"), floats=("score",))
def diverse_recommendations(spark, sf):
    found = similar_to_seeds(spark, sf).drop("rank")
    return diversity.diversify_by_vectors(found, [F.desc("score"), F.asc("item_id")], _vectors(spark, sf), 5, 0.3)


@query("diverse_user_recommendations", _walk_sql(_USER_BASED, "r", "predicted_rating DESC, confidence DESC", 10, _UNIT,
                                                 _near_vectors(0.7), "predicted_rating, confidence"), floats=("predicted_rating", "confidence"))
def diverse_user_recommendations(spark, sf):
    """No two items of a list with a cosine above 0.7; the given embeddings stand for item vectors."""
    rows = _rows(spark, sf)
    return collaborative.user_based(_requests(rows), rows, user_neighbours(rows, 50), 10, diversity=0.7, item_vectors=_vectors(spark, sf))


_LISTED = "len(list_intersect(CAST(p.x AS BIGINT[]), w.ids)) > 0"


def _diverse_items(spark, sf, diversity_):
    rows = _rows(spark, sf)
    near = cut_lineage(similar_rows(rows, "item_id", "user_id", "rating", 100))
    return collaborative.item_based(_requests(rows), rows, near, 10, diversity=diversity_)


for _name, _limit in (("diverse_item_recommendations", 0.8), ("very_diverse_item_recommendations", 0.25)):
    query(_name, _walk_sql(_ITEM_BASED, "r", "predicted_rating DESC, confidence DESC", 10,
                           f"SELECT query_id AS item_id, CAST(list(id) AS DOUBLE[]) AS x FROM nn WHERE rank <= 20 AND score > {_limit} GROUP BY 1",
                           _LISTED, "predicted_rating, confidence"), floats=("predicted_rating", "confidence"))(
        lambda spark, sf, limit=_limit: _diverse_items(spark, sf, limit))


# ---- content ----------------------------------------------------------------------------------------

def _item_map(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ext_id"), F.col("source").alias("media_type"),
        F.col("lang").alias("spoken_languages"), F.col("lang").alias("title"))


_SELF = "selfq AS (SELECT id AS query_id, vec FROM v)"
_LIKE = "least(greatest(score, 0), 1)"


@query("similar_documents", f"""WITH {VECTORS}, {_SELF},
allowed AS (SELECT v.* FROM v JOIN documents ON doc_id = id WHERE source = 'src1' AND lang IN ('en', 'fr')), {cosine_lists('nn', 'selfq', 50, True, base='allowed')},
r AS (SELECT query_id, id AS item_id, {_LIKE} AS similarity FROM nn)
{top('r', 'similarity DESC', 50)}""", floats=("similarity",))
def similar_documents(spark, sf):
    queries = _vectors(spark, sf).select(F.col("id").alias("query_id"), F.col("id").alias("item_id"))
    return content.similar_items(queries, _vectors(spark, sf), _item_map(spark, sf), 50, "src1", ["en", "fr"])


@query("discover_by_features", f"""WITH {VECTORS}, q AS (SELECT id AS query_id, list_transform(vec, lambda x: x + 0.05) AS vec FROM v),
allowed AS (SELECT v.* FROM v JOIN documents ON doc_id = id WHERE source = 'src2' AND lang = 'en'), {cosine_lists('nn', 'q', 30, base='allowed')},
r AS (SELECT query_id, id AS item_id, {_LIKE} AS similarity FROM nn)
{top('r', 'similarity DESC', 30)}""", floats=("similarity",))
def discover_by_features(spark, sf):
    wanted = _vectors(spark, sf).select(F.col("id").alias("query_id"), F.transform(vx.doubles(F.col("vec")), lambda x: x + 0.05).alias("vec"))
    return content.similar_to_vectors(wanted, _vectors(spark, sf), _item_map(spark, sf), 30, "src2", strict=True)


@query("multi_seed_content", f"""WITH {VECTORS},
k AS (SELECT label AS query_id, id AS item_id, vec FROM v),
ax AS (SELECT label AS query_id, pos, avg(x) AS a, max(x) AS m FROM e JOIN v USING (id) GROUP BY 1, 2),
several AS (SELECT query_id AS label, item_id AS s, 0.5 AS w, vec FROM k
  UNION ALL SELECT query_id, -1, 0.25, list(a ORDER BY pos) FROM ax GROUP BY 1
  UNION ALL SELECT query_id, -2, 0.25, list(m ORDER BY pos) FROM ax GROUP BY 1),
kinds AS (SELECT label AS query_id, source, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, source) AS r
          FROM v JOIN documents ON doc_id = id GROUP BY label, source),
langs AS (SELECT DISTINCT label AS query_id, lang FROM v JOIN documents ON doc_id = id),
may AS (SELECT kinds.query_id AS label, doc_id AS id, v.vec FROM documents d JOIN v ON v.id = doc_id
      JOIN kinds ON kinds.r = 1 AND kinds.source = d.source JOIN langs ON langs.query_id = kinds.query_id AND langs.lang = d.lang
      WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = kinds.query_id AND k.item_id = doc_id)),
numbered AS (SELECT *, row_number() OVER (ORDER BY label, s) AS query_id FROM several),
{cosine_lists('nn', 'numbered', 60, base='may', only='v.label = q.label')},
c AS (SELECT label AS query_id, id AS item_id, {steady('sum(' + _LIKE + ' * w)', 6)} AS similarity FROM nn JOIN numbered USING (query_id) GROUP BY 1, 2)
SELECT CAST(query_id AS BIGINT) AS query_id, item_id, similarity, rank FROM ({top('c', 'similarity DESC', 20)})""", floats=("similarity",))
def multi_seed_content(spark, sf):
    queries = embedding_vectors(spark, sf).select(F.col("label").alias("query_id"), F.col("id").alias("item_id"))
    return content.similar_to_several(queries, _vectors(spark, sf), _item_map(spark, sf), 20)


@query("percent_lists", f"""WITH {VECTORS}, {_SELF}, {cosine_lists('nn', 'selfq', 11)},
r AS (SELECT query_id, id AS item_id, {_LIKE} AS raw_score FROM nn WHERE query_id <> id)
SELECT query_id, item_id, raw_score, CAST(ROUND(CAST(raw_score * 100 AS DECIMAL(28,9)), 2)::DECIMAL(18,2) AS VARCHAR) || '%' AS similarity, rank
FROM ({top('r', 'raw_score DESC', 10)})""", floats=("raw_score",))
def percent_lists(spark, sf):
    queries = _vectors(spark, sf).select(F.col("id").alias("query_id"), F.col("id").alias("item_id"))
    found = nearest(_vectors(spark, sf).withColumnRenamed("id", "query_id"), _vectors(spark, sf), 11)
    return content.with_percent(found, queries, 10)


# ---- hybrids -----------------------------------------------------------------------------------------

_CONTENT = f"""{_SELF}, {cosine_lists('near', 'selfq', 10, True)},
lists AS (SELECT ra.user_id AS query_id, near.id AS item_id, near.score FROM ra JOIN near ON near.query_id = ra.item_id),
cb AS (SELECT query_id, item_id, max(score) AS score FROM lists GROUP BY 1, 2)"""
_COUNTS = "nr AS (SELECT user_id AS query_id, count(*) AS n_ratings FROM ra GROUP BY 1)"


def _content_lists(spark, sf, rows):
    near = nearest(_vectors(spark, sf).withColumnRenamed("id", "query_id"), _vectors(spark, sf), 10, skip_self=True)
    seeds = rows.select(F.col("user_id").alias("query_id"), "item_id")
    lists = near.select(F.col("query_id").alias("item_id"), F.col("id"), "score")
    return seeds.join(lists, "item_id").select("query_id", F.col("id").alias("item_id"), "score")


def _user_list(rows):
    return _simple_lists(rows).select("query_id", "item_id", F.col("predicted_rating").alias("score"))


def _item_list(spark, sf, rows):
    return _cosine_weighted(spark, sf, rows).select("query_id", "item_id", F.col("predicted_rating").alias("score"))


def _counts(rows):
    return rows.groupBy(F.col("user_id").alias("query_id")).agg(F.count("*").alias("n_ratings"))


_CF = f"{simple_user_lists('ra', 10)}, cf AS (SELECT query_id, item_id, predicted_rating AS score FROM c4)"


@query("content_only", f"""WITH {RATINGS_AGG}, {VECTORS}, {_CONTENT}
{top('cb', 'score DESC', 10)}""", floats=("score",))
def content_only(spark, sf):
    return hybrid.content_only(_content_lists(spark, sf, _rows(spark, sf)), 10)


@query("z_scored_lists", f"WITH {RATINGS_AGG}, {VECTORS}, {_CONTENT}, {z('cb', 'zc')} SELECT * FROM zc", floats=("score",))
def z_scored_lists(spark, sf):
    return hybrid.z_scores(hybrid.best_over_seeds(_content_lists(spark, sf, _rows(spark, sf))))


@query("weighted_hybrid", f"""WITH {RATINGS_AGG}, {VECTORS}, {_CF}, {_CONTENT}, {_COUNTS}, {z('cf', 'za')}, {z('cb', 'zb')},
mix AS (SELECT coalesce(za.query_id, zb.query_id) AS query_id, coalesce(za.item_id, zb.item_id) AS item_id, za.score AS a, zb.score AS b
        FROM za FULL JOIN zb ON za.query_id = zb.query_id AND za.item_id = zb.item_id),
r AS (SELECT query_id, item_id, {steady('least(n_ratings / 10, 1.0) * coalesce(a, 0) + (1 - least(n_ratings / 10, 1.0)) * coalesce(b, 0)', 6)} AS score
      FROM mix JOIN nr USING (query_id))
{top('r', 'score DESC', 10)}""", floats=("score",))
def weighted_hybrid(spark, sf):
    rows = _rows(spark, sf)
    best = hybrid.best_over_seeds(_content_lists(spark, sf, rows))
    return hybrid.weighted_hybrid(_user_list(rows), best, _counts(rows), 10)


@query("weighted_or_content", f"""WITH {RATINGS_AGG}, {VECTORS}, {_CF}, {_CONTENT}, {_COUNTS},
has AS (SELECT DISTINCT query_id FROM cf), cbh AS (SELECT * FROM cb WHERE query_id IN (SELECT query_id FROM has)), {z('cf', 'za')}, {z('cbh', 'zb')},
mix AS (SELECT coalesce(za.query_id, zb.query_id) AS query_id, coalesce(za.item_id, zb.item_id) AS item_id, za.score AS a, zb.score AS b
        FROM za FULL JOIN zb ON za.query_id = zb.query_id AND za.item_id = zb.item_id),
r AS (SELECT query_id, item_id, {steady('least(n_ratings / 10, 1.0) * coalesce(a, 0) + (1 - least(n_ratings / 10, 1.0)) * coalesce(b, 0)', 6)} AS score
      FROM mix JOIN nr USING (query_id)
      UNION ALL SELECT query_id, item_id, {steady('score', 6)} FROM cb WHERE query_id NOT IN (SELECT query_id FROM has))
{top('r', 'score DESC', 10)}""", floats=("score",))
def weighted_or_content(spark, sf):
    rows = _rows(spark, sf)
    return hybrid.weighted_or_content(_user_list(rows), _content_lists(spark, sf, rows), _counts(rows), 10)


@query("switching_hybrid", f"""{_weighted_sql('c', 'CASE WHEN abs(ws) > 1e-12 THEN wr / ws ELSE mean END').replace('SELECT query_id, item_id, CAST', ', il AS (SELECT query_id, item_id, CAST', 1).replace('AS predicted_rating, score, rank FROM w', 'AS score FROM w)')},
{_CF}, {_CONTENT}, {_COUNTS}, {z('il', 'za')}, {z('cf', 'zb')},
mix AS (SELECT coalesce(za.query_id, zb.query_id) AS query_id, coalesce(za.item_id, zb.item_id) AS item_id, za.score AS a, zb.score AS b
        FROM za FULL JOIN zb ON za.query_id = zb.query_id AND za.item_id = zb.item_id),
r AS (SELECT query_id, item_id, {steady('(1 - least(n_ratings / 10, 0.5)) * coalesce(a, 0) + least(n_ratings / 10, 0.5) * coalesce(b, 0)', 6)} AS score
      FROM mix JOIN nr USING (query_id) WHERE query_id IN (SELECT query_id FROM il) AND query_id IN (SELECT query_id FROM cf)
      UNION ALL SELECT query_id, item_id, {steady('score', 6)} FROM za WHERE query_id NOT IN (SELECT query_id FROM cf)
      UNION ALL SELECT query_id, item_id, {steady('score', 6)} FROM cb WHERE query_id NOT IN (SELECT query_id FROM il))
{top('r', 'score DESC', 10)}""", floats=("score",))
def switching_hybrid(spark, sf):
    rows = _rows(spark, sf)
    return hybrid.switching_hybrid(_item_list(spark, sf, rows), _user_list(rows), _content_lists(spark, sf, rows),
                                   _counts(rows), 10)
