"""SQL pieces that several queries share."""

from __future__ import annotations

from .registry import steady

# Embeddings as double vectors, and one row per dimension.
VECTORS = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
e AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM v)"""


def cosine_lists(name: str, queries: str, k: int | str, skip_self: bool = False, metric: str = "cosine", base: str = "v",
                 only: str = "") -> str:
    """`name(query_id, id, score, rank)`: best k of `base` for each row of `queries(query_id, vec[, k])`; `only` is a condition on q and v."""
    score = {"cosine": "list_cosine_similarity(q.vec, v.vec)", "dot": "list_inner_product(q.vec, v.vec)",
             "l2": "-pow(list_distance(q.vec, v.vec), 2)"}[metric]
    limit = f"q_{k}" if isinstance(k, str) else k
    extra = f", q.{k} AS q_{k}" if isinstance(k, str) else ""
    where = " AND ".join(["q.query_id <> v.id"] * skip_self + [only] * bool(only))
    where = f"WHERE {where}" if where else ""
    return f"""{name}_all AS (SELECT q.query_id, v.id, round({score}, 6) AS score{extra} FROM {queries} q, {base} v {where}),
{name} AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
           FROM {name}_all) WHERE rank <= {limit})"""


def row_cosine(name: str, source: str, row: str, dim: str, k: int) -> str:
    """`name(query_id, id, score, rank)`: best k other rows of a sparse matrix by cosine."""
    return f"""{name}_s AS (SELECT {row} AS id, sqrt(sum(rating * rating)) AS s FROM {source} GROUP BY 1),
{name}_p AS (SELECT a.{row} AS query_id, b.{row} AS id, sum(a.rating * b.rating) AS d FROM {source} a JOIN {source} b
             ON a.{dim} = b.{dim} AND a.{row} <> b.{row} GROUP BY 1, 2),
{name}_c AS (SELECT query_id, p.id, round(d / (x.s * y.s), 6) AS score FROM {name}_p p
             JOIN {name}_s x ON p.query_id = x.id JOIN {name}_s y ON p.id = y.id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_c) WHERE rank <= {k})"""


def user_terms(source: str, lists: str, min_score: float) -> str:
    """`m(user_id, mean)` and `terms(query_id, item_id, rating, dev, sim)`, rated items left out."""
    return f"""m AS (SELECT user_id, avg(rating) AS mean FROM {source} GROUP BY 1),
terms AS (SELECT l.query_id, r.item_id, r.rating, r.rating - m.mean AS dev, l.score AS sim
          FROM {lists} l JOIN {source} r ON r.user_id = l.id JOIN m ON m.user_id = l.id
          WHERE l.score >= {min_score}
            AND NOT EXISTS (SELECT 1 FROM {source} q WHERE q.user_id = l.query_id AND q.item_id = r.item_id))"""


def top(source: str, order: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, item_id) AS rank
FROM {source}) WHERE rank <= {n}"""


def simple_user_lists(source: str, n: int, min_score: float = 0.0, k: int = 20) -> str:
    """`c4(query_id, item_id, similarity, predicted_rating, rank)`."""
    return f"""{row_cosine('un', source, 'user_id', 'item_id', k)},
{user_terms(source, 'un', min_score)},
c4_sums AS (SELECT query_id, item_id, sum(dev * sim) AS ds, sum(sim) AS ss FROM terms GROUP BY 1, 2 HAVING sum(sim) > 0),
c4_all AS (SELECT query_id, item_id, {steady('ss', 4)} AS similarity,
           {steady('least(greatest(m.mean + ds / ss, 1.0), 5.0)', 2)} AS predicted_rating
           FROM c4_sums JOIN m ON m.user_id = query_id),
c4 AS ({top('c4_all', 'similarity DESC', n)})"""


def seed_means(weight: str = "1.0") -> str:
    """`qv(query_id, vec, n_seeds)`: weighted mean vector of each user's rated items that have one."""
    return f"""seeds AS (SELECT user_id AS query_id, item_id, rating, vec FROM ra JOIN v ON v.id = ra.item_id),
qx AS (SELECT user_id AS query_id, pos, sum(x * {weight}) / sum({weight}) AS x, count(*) AS n_seeds
       FROM ra JOIN e ON e.id = ra.item_id GROUP BY 1, 2),
qv AS (SELECT query_id, list(x ORDER BY pos) AS vec, any_value(n_seeds) AS n_seeds FROM qx GROUP BY 1)"""


def z(source: str, name: str) -> str:
    return f"""{name} AS (SELECT query_id, item_id, CASE WHEN stddev_pop(score) OVER w > 1e-12
        THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END AS score
        FROM {source} WINDOW w AS (PARTITION BY query_id))"""
