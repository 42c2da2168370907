"""Matrix operators and factor models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as vx
from ..operators import collaborative, factors, linalg, ordering
from ..operators.neighbours import nearest
from ..session import cut_lineage
from ..sources import embedding_vectors, ratings_agg, table
from .fragments import VECTORS, top
from .registry import RATINGS_AGG, query, steady


@query("mean_centred", f"""WITH {RATINGS_AGG}
SELECT user_id, item_id, rating, rating - avg(rating) OVER (PARTITION BY user_id) AS centred FROM ra""",
       floats=("rating", "centred"))
def mean_centred(spark, sf):
    return linalg.mean_centre(ratings_agg(spark, sf).drop("ts"))


@query("user_z_scores", f"""WITH {RATINGS_AGG}, s AS (SELECT user_id, avg(rating) AS m, stddev_samp(rating) AS s FROM ra GROUP BY 1)
SELECT user_id, item_id, rating, (rating - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END AS z FROM ra JOIN s USING (user_id)""",
       floats=("rating", "z"))
def user_z_scores(spark, sf):
    return linalg.user_z_scores(ratings_agg(spark, sf).drop("ts"))


@query("normalised_rows", f"""WITH {RATINGS_AGG}
SELECT user_id, item_id, rating, rating / sqrt(sum(rating * rating) OVER (PARTITION BY user_id)) AS scaled FROM ra""",
       floats=("rating", "scaled"))
def normalised_rows(spark, sf):
    return linalg.normalise_rows(ratings_agg(spark, sf).drop("ts"))


_COLUMNS = f"""WITH {RATINGS_AGG}, n AS (SELECT count(*) AS n FROM customer),
s AS (SELECT item_id, sum(rating) / n AS mean, sqrt(sum(rating * rating) / n - pow(sum(rating) / n, 2)) AS std FROM ra, n GROUP BY item_id, n)"""


@query("standardised_cells", _COLUMNS + " SELECT user_id, item_id, rating, (rating - mean) / std AS scaled FROM ra JOIN s USING (item_id)",
       floats=("rating", "scaled"))
def standardised_cells(spark, sf):
    n = table(spark, sf, "customer").agg(F.count("*")).scalar()
    return linalg.standardise_columns(ratings_agg(spark, sf).drop("ts"), n)[0]


@query("standardised_columns", _COLUMNS + " SELECT item_id, mean, std, -mean / std AS missing_value FROM s",
       floats=("mean", "std", "missing_value"))
def standardised_columns(spark, sf):
    n = table(spark, sf, "customer").agg(F.count("*")).scalar()
    return linalg.standardise_columns(ratings_agg(spark, sf).drop("ts"), n)[1]


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pivot_by_label", "SELECT user_id, " + ", ".join(
    f"coalesce(avg(value) FILTER (event_type = '{t}'), 0) AS {t}" for t in _EVENT_TYPES) + " FROM events GROUP BY 1",
    floats=tuple(_EVENT_TYPES))
def pivot_by_label(spark, sf):
    cells = table(spark, sf, "events").select("user_id", F.col("event_type").alias("item_id"), F.col("value").alias("rating"))
    return linalg.pivot_matrix(cells, _EVENT_TYPES)


def _entries(rows: DataFrame, by: str = "user_id") -> tuple[DataFrame, DataFrame, int]:
    """Centred ratings as matrix entries with dense columns, rows being users (or items); the column ids."""
    other = "item_id" if by == "user_id" else "user_id"
    centred = linalg.mean_centre(rows, by)
    ids = cut_lineage(ordering.dense_ids(rows, [other], "idx"))
    entries = centred.join(ids, other).select(F.col(by).alias("id"), "idx", F.col("centred").alias("value"))
    return entries, ids, ids.count()


@query("svd_user_vectors")
def svd_user_vectors(spark, sf):
    entries, _, width = _entries(cut_lineage(ratings_agg(spark, sf)))
    rows = linalg.truncated_svd(entries, width, 16)["rows"]
    return rows.select("id", F.size("vec").alias("dim"), vx.norm(F.col("vec")).alias("size"))


@query("svd_item_vectors")
def svd_item_vectors(spark, sf):
    entries, _, width = _entries(cut_lineage(ratings_agg(spark, sf)), "item_id")
    rows = linalg.truncated_svd(entries, width, 16)["rows"]
    return rows.select("id", F.size("vec").alias("dim"), vx.norm(F.col("vec")).alias("size"))


@query("svd_spectrum")
def svd_spectrum(spark, sf):
    entries, _, width = _entries(cut_lineage(ratings_agg(spark, sf)))
    return linalg.cumulative_variance(linalg.truncated_svd(entries, width, 16)["spectrum"])


# One row per order line with a one for its supplier: the singular values are the roots of the suppliers' line counts.
_LABEL_VALUES = """SELECT component, singular_value FROM (
  SELECT row_number() OVER (ORDER BY n DESC) - 1 AS component, sqrt(n) AS singular_value, count(*) OVER () AS labels
  FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)) WHERE component < least(16, labels - 1)"""


def _label_values(path: str):
    def run(spark, sf):
        lines = table(spark, sf, "lineitem")
        ids = cut_lineage(ordering.dense_ids(lines, ["l_suppkey"], "idx"))
        numbered = cut_lineage(lines.select("l_suppkey", F.monotonically_increasing_id().alias("id")))
        cells = numbered.join(ids, "l_suppkey").select("id", "idx", F.lit(1.0).alias("value"))
        return linalg.truncated_svd(cells, ids.count(), 16, path=path)["spectrum"].select("component", "singular_value")
    return run


for _path in ("exact", "broadcast", "joined"):
    query(f"svd_label_values_{_path}", _LABEL_VALUES, floats=("singular_value",), ints=("component",))(_label_values(_path))


@query("pca_vectors")
def pca_vectors(spark, sf):
    rows = linalg.pca(embedding_vectors(spark, sf).select("id", "vec"), 10, whiten=True)["rows"]
    return rows.select("id", F.size("vec").alias("dim"), vx.norm(F.col("vec")).alias("size"))


# Principal variances from SQL: those of the covariance add up to the total, their squares to the sum of its squared cells.
_COVARIANCE = f"""{VECTORS}, m AS (SELECT pos, avg(x) AS m FROM e GROUP BY 1),
c AS (SELECT id, pos, x - m AS x FROM e JOIN m USING (pos)), n AS (SELECT count(*) AS n FROM v),
s AS (SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) / (any_value(n) - 1) AS s FROM c a JOIN c b ON a.id = b.id, n GROUP BY 1, 2)"""


def _principal(exact: bool):
    def run(spark, sf):
        found = linalg.pca(embedding_vectors(spark, sf).select("id", "vec"), 64, exact=exact)
        v = F.col("variance")
        return found["spectrum"].agg(F.count("*").alias("components"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.sum("ratio").alias("ratio"))
    return run


for _way in (True, False):
    query(f"pca_variances_{'exact' if _way else 'iterated'}", f"""WITH {_COVARIANCE}
SELECT (SELECT count(*) FROM m) AS components, sum(s) FILTER (i = j) AS total, sum(s * s) AS squares, 1.0 AS ratio FROM s""",
          floats=("total", "squares", "ratio"))(_principal(_way))


# The share of each embedding dimension in their total variance, largest first, seen as a spectrum.
_SPECTRUM = f"""{VECTORS}, d AS (SELECT pos, var_pop(x) AS v FROM e GROUP BY 1),
sp AS (SELECT row_number() OVER (ORDER BY v DESC, pos) - 1 AS component, v / (SELECT sum(v) FROM d) AS ratio FROM d),
cu AS (SELECT *, sum(ratio) OVER (ORDER BY component) AS cumulative FROM sp)"""


def _spectrum(spark, sf):
    dims = embedding_vectors(spark, sf).select(F.posexplode(vx.doubles(F.col("vec"))).alias("pos", "x"))
    var = dims.groupBy("pos").agg(F.var_pop("x").alias("v"))
    total = var.agg(F.sum("v")).scalar()
    # One row per dimension.
    ordered = var.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("v")).alias("d"), "pos"))).alias("a"))
    return ordered.select(F.posexplode("a").alias("component", "s")).select(
        "component", (-F.col("s.d") / total).alias("ratio"))


@query("cumulative_variance", f"WITH {_SPECTRUM} SELECT component, ratio, cumulative FROM cu", floats=("ratio", "cumulative"))
def cumulative_variance(spark, sf):
    return linalg.cumulative_variance(_spectrum(spark, sf))


@query("components_for_variance", f"""WITH {_SPECTRUM}
SELECT share, (SELECT min(component) + 1 FROM cu WHERE cumulative >= share) AS components
FROM (VALUES (0.7::DOUBLE), (0.8), (0.9), (0.95), (0.99)) s(share)""", floats=("share",))
def components_for_variance(spark, sf):
    return linalg.components_for(_spectrum(spark, sf), [0.7, 0.8, 0.9, 0.95, 0.99])


@query("variance_elbow", f"""WITH {_SPECTRUM},
b AS (SELECT component, ratio, lead(ratio) OVER w - 2 * ratio + lag(ratio) OVER w AS bend FROM sp WINDOW w AS (ORDER BY component))
SELECT (SELECT component + 1 FROM b WHERE bend IS NOT NULL ORDER BY bend DESC, component LIMIT 1) AS elbow,
       count(*) FILTER (ratio >= 0.01) AS over_one_percent FROM sp""")
def variance_elbow(spark, sf):
    return linalg.elbow(_spectrum(spark, sf))


# ---- factor models: the given embeddings stand for fitted factors ---------------------------------

_REG = 0.02
_BIAS = f"""g AS (SELECT avg(rating) AS mu FROM ra),
bi AS (SELECT item_id, sum(rating - mu) / (count(*) + {_REG}) AS item_bias FROM ra, g GROUP BY 1),
bu AS (SELECT user_id, sum(rating - mu - item_bias) / (count(*) + {_REG}) AS user_bias FROM ra JOIN bi USING (item_id), g GROUP BY 1)"""


@query("regularised_biases", f"""WITH {RATINGS_AGG}, {_BIAS}
SELECT 'item' AS kind, item_id AS id, item_bias AS bias FROM bi UNION ALL SELECT 'user', user_id, user_bias FROM bu""",
       floats=("bias",))
def regularised_biases(spark, sf):
    found = factors.biases(ratings_agg(spark, sf), _REG)
    return found["item_bias"].select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("item_bias").alias("bias")).unionByName(
        found["user_bias"].select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("user_bias").alias("bias")))


def given_model(spark, sf, rows: DataFrame) -> dict[str, DataFrame]:
    model = {name: cut_lineage(df) for name, df in factors.biases(rows, _REG).items()}
    vec = vx.doubles(F.col("vec"))
    base = embedding_vectors(spark, sf)
    model["user_factors"] = base.select(F.col("id").alias("user_id"), vec.alias("vec"))
    model["item_factors"] = base.select(F.col("id").alias("item_id"), vec.alias("vec"))
    return model


@query("factor_predictions", f"""WITH {RATINGS_AGG}, {_BIAS}, {VECTORS}
SELECT user_id, item_id, mu + coalesce(user_bias, 0) + coalesce(item_bias, 0) + coalesce(list_inner_product(p.vec, q.vec), 0) AS prediction
FROM ra LEFT JOIN bu USING (user_id) LEFT JOIN bi USING (item_id) LEFT JOIN v p ON p.id = user_id LEFT JOIN v q ON q.id = item_id, g""",
       floats=("prediction",))
def factor_predictions(spark, sf):
    rows = cut_lineage(ratings_agg(spark, sf))
    return factors.predict(rows.select("user_id", "item_id"), given_model(spark, sf, rows))


_FOLD = f"""{_BIAS}, {VECTORS},
k AS (SELECT user_id AS query_id, item_id, rating - mu - item_bias AS d, vec FROM ra JOIN bi USING (item_id) JOIN v ON v.id = item_id, g),
ub AS (SELECT query_id, avg(d) AS user_bias FROM k GROUP BY 1),
px AS (SELECT k.query_id, pos, avg(x * (d - user_bias)) AS x FROM k JOIN ub USING (query_id) JOIN e ON e.id = k.item_id GROUP BY 1, 2),
p AS (SELECT query_id, list(x ORDER BY pos) AS vec FROM px GROUP BY 1)"""


@query("folded_in_users", f"WITH {RATINGS_AGG}, {_FOLD} SELECT query_id, pos - 1 AS pos, x, user_bias FROM px JOIN ub USING (query_id)",
       floats=("x", "user_bias"), ints=("pos",))
def folded_in_users(spark, sf):
    rows = cut_lineage(ratings_agg(spark, sf))
    folded = factors.fold_in(_requests(rows), given_model(spark, sf, rows), 64)
    return folded.select("query_id", F.posexplode("vec").alias("pos", "x"), "user_bias")


def _requests(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").alias("query_id"), "item_id", "rating")


@query("factor_recommendations", f"""WITH {RATINGS_AGG}, {_FOLD},
s AS (SELECT query_id, v.id AS item_id, round(list_inner_product(p.vec, v.vec) + item_bias, 6) AS s FROM p, v JOIN bi ON bi.item_id = v.id
      WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.user_id = p.query_id AND ra.item_id = v.id)),
t AS ({top('s', 's DESC', 10)})
SELECT query_id, item_id, {steady('mu + user_bias + s', 6)} AS score, rank FROM t JOIN ub USING (query_id), g""",
       floats=("score",))
def factor_recommendations(spark, sf):
    rows = cut_lineage(ratings_agg(spark, sf))
    return collaborative.factor_recommend(_requests(rows), given_model(spark, sf, rows), 64, 10)


@query("factor_similar_items", f"""WITH {RATINGS_AGG}, {VECTORS},
qx AS (SELECT user_id AS query_id, pos, avg(x) AS x FROM ra JOIN e ON e.id = ra.item_id GROUP BY 1, 2),
q AS (SELECT query_id, list(x ORDER BY pos) AS vec FROM qx GROUP BY 1),
s AS (SELECT query_id, v.id AS item_id, round(list_inner_product(q.vec, v.vec), 6) AS score FROM q, v
      WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.user_id = q.query_id AND ra.item_id = v.id))
{top('s', 'score DESC', 10)}""", floats=("score",))
def factor_similar_items(spark, sf):
    rows = cut_lineage(ratings_agg(spark, sf))
    return collaborative.factor_similar(_requests(rows), given_model(spark, sf, rows), 10)


@query("als_history")
def als_history(spark, sf):
    return factors.factorise(ratings_agg(spark, sf), rank=10, reg=0.1, iterations=(3, 6))["history"]


@query("als_recommendations")
def als_recommendations(spark, sf):
    rows = cut_lineage(ratings_agg(spark, sf))
    model = factors.factorise(rows, rank=10, reg=0.1, iterations=(5,))
    return collaborative.factor_recommend(_requests(rows), model, 10, 10)


@query("svd_user_recommendations")
def svd_user_recommendations(spark, sf):
    """The live user-based flow: SVD of centred ratings, fold-in, nearest users, prediction, diversity."""
    rows = cut_lineage(ratings_agg(spark, sf))
    entries, ids, width = _entries(rows)
    svd = linalg.truncated_svd(entries, width, 16)
    components = cut_lineage(svd["components"].join(ids, "idx").select("item_id", "vec"))
    item_vectors = components.select(F.col("item_id").alias("id"), "vec")
    requests = _requests(rows)
    folded = collaborative.fold_in_users(requests, components.select(F.col("item_id").alias("idx"), "vec"), item_vectors, 16)
    near = nearest(folded, svd["rows"], 100, skip_self=True, min_score=0.1)
    return collaborative.user_based(requests, rows, near, n=10, diversity=0.7, item_vectors=item_vectors)
