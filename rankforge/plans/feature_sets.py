"""Text and label features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vectors as vx
from ..operators import content, features, linalg
from ..session import cut_lineage
from ..sources import content_items, embedding_vectors, items, table
from .registry import query

# Words left out of the text features (fixed values).
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "that", "for", "on", "it", "as", "with", "der", "die", "und", "le", "la", "de", "et", "les"]
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tfidf_sql(bigrams: bool, min_df: int, max_df: float, max_features: int) -> str:
    grams = """UNION ALL SELECT id, w || ' ' || nxt FROM (SELECT id, w, lead(w) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM words)
        WHERE nxt IS NOT NULL""" if bigrams else ""
    return f"""
WITH raw AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1) AS ws FROM documents),
words AS (SELECT id, w, pos FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM raw) WHERE w NOT IN ({_STOPS})),
terms AS (SELECT id, w AS term FROM words {grams}),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1),
kept AS (SELECT term, df FROM df, n WHERE df >= {min_df} AND df <= {max_df} * n ORDER BY total DESC, term LIMIT {max_features}),
vocab AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx, ln((1 + n) / (1 + df)) + 1 AS idf FROM kept, n),
w AS (SELECT id, idx, term, tf * idf AS w FROM tf JOIN vocab USING (term))
SELECT id, idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS value FROM w"""


@query("tfidf_overview", _tfidf_sql(True, 3, 0.9, 2000), floats=("value",))
def tfidf_overview(spark, sf):
    docs = content_items(spark, sf)
    return features.fit_apply_tfidf(docs, "overview", 2000, 3, 0.9, STOP_WORDS)[1]


@query("tfidf_words", _tfidf_sql(False, 2, 1.0, 500), floats=("value",))
def tfidf_words(spark, sf):
    docs = content_items(spark, sf)
    vocabulary = features.fit_tfidf(docs, "overview", 500, 2, 1.0, STOP_WORDS, bigrams=False)
    return features.apply_tfidf(docs, "overview", vocabulary, STOP_WORDS, bigrams=False)


@query("genre_binarise", """
WITH l AS (SELECT p_partkey AS id, unnest([p_type, p_brand]) AS label FROM part),
c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM l))
SELECT DISTINCT id, idx, label, 1.0::DOUBLE AS value FROM l JOIN c USING (label)""", floats=("value",))
def genre_binarise(spark, sf):
    docs = items(spark, sf)
    return features.binarise(docs, F.col("genres"), features.fit_labels(docs, F.col("genres")))


@query("genre_one_hot", """
WITH l AS (SELECT p_partkey AS id, 0 AS pos, p_type AS label FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part),
c AS (SELECT pos, label, row_number() OVER (ORDER BY pos, label) - 1 AS idx FROM (SELECT DISTINCT pos, label FROM l))
SELECT id, idx, pos, label, 1.0::DOUBLE AS value FROM l JOIN c USING (pos, label)""", floats=("value",), ints=("pos",))
def genre_one_hot(spark, sf):
    docs = items(spark, sf)
    return features.one_hot_positional(docs, F.col("genres"), features.fit_positional(docs, F.col("genres")))


_NAMES = "concat(p_name, ',', p_type, ';', p_brand)"


@query("hashed_names", """
WITH l AS (SELECT p_partkey AS id, unnest([p_name, p_type, p_brand]) AS name FROM part),
h AS (SELECT id, CAST('0x' || substr(md5(name), 1, 8) AS BIGINT) % 100 AS idx,
             CASE WHEN CAST('0x' || substr(md5(name), 9, 1) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM l)
SELECT id, idx, sum(s) AS value FROM h GROUP BY 1, 2 HAVING sum(s) <> 0""", floats=("value",))
def hashed_names(spark, sf):
    return features.hash_names(table(spark, sf, "part"), text.name_list(F.expr(_NAMES)), 100, id="p_partkey")


@query("hashed_names_unsigned", """
WITH l AS (SELECT p_partkey AS id, unnest([p_name, p_type, p_brand]) AS name FROM part)
SELECT id, CAST('0x' || substr(md5(name), 1, 8) AS BIGINT) % 500 AS idx, CAST(count(*) AS DOUBLE) AS value FROM l GROUP BY 1, 2""",
       floats=("value",))
def hashed_names_unsigned(spark, sf):
    return features.hash_names(table(spark, sf, "part"), text.name_list(F.expr(_NAMES)), 500, signed=False, id="p_partkey")


# A table of word vectors: the n-th brand has the n-th embedding.
_WORDS = "words AS (SELECT 'Brand#' || vec_id AS word, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


@query("mean_word_vectors", f"""
WITH {_WORDS}, l AS (SELECT p_partkey AS id, unnest([p_type, p_brand, 'Brand#' || p_size]) AS word FROM part),
x AS (SELECT l.id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM l JOIN words USING (word))
SELECT id, pos, avg(x) AS x FROM x GROUP BY 1, 2""", floats=("x",))
def mean_word_vectors(spark, sf):
    words = table(spark, sf, "embeddings").select(
        F.concat(F.lit("Brand#"), F.col("vec_id")).alias("word"), F.col("embedding").alias("vec"))
    labels = F.array("p_type", "p_brand", F.concat(F.lit("Brand#"), F.col("p_size")))
    means = features.mean_word_vectors(table(spark, sf, "part"), labels, words, 64, id="p_partkey")
    return means.select("id", F.posexplode("vec").alias("pos", "x"))


@query("document_embeddings", """
SELECT d.doc_id AS id, coalesce(list_sum(CAST(embedding AS DOUBLE[])), 0.0) AS total, embedding IS NOT NULL AS found
FROM documents d LEFT JOIN embeddings ON vec_id = doc_id""", floats=("total",))
def document_embeddings(spark, sf):
    attached = features.attach_embeddings(content_items(spark, sf), "overview", embedding_vectors(spark, sf), 64)
    return attached.select("id", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x).alias("total"),
                           (vx.norm(F.col("vec")) > 0).alias("found"))


@query("weighted_concat", """
SELECT vec_id AS id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS x FROM (
  SELECT vec_id, list_concat(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 0.6), [label * 0.4]) AS w FROM embeddings)""",
       floats=("x",))
def weighted_concat(spark, sf):
    vec = vx.weighted_concat([F.col("vec"), F.array(F.col("label").cast("double"))], [0.6, 0.4])
    return embedding_vectors(spark, sf).select("id", F.posexplode(vec).alias("pos", "x"))


@query("stacked_blocks", """
WITH l AS (SELECT p_partkey AS id, unnest([p_type, p_brand]) AS label FROM part),
c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM l)),
h AS (SELECT p_partkey AS id, CAST('0x' || substr(md5(p_name), 1, 8) AS BIGINT) % 100 AS idx FROM part)
SELECT id, idx, 0.7 AS value FROM l JOIN c USING (label)
UNION ALL SELECT id, idx + 40, 0.3 FROM h""", floats=("value",))
def stacked_blocks(spark, sf):
    docs = items(spark, sf)
    genres = features.binarise(docs, F.col("genres"), features.fit_labels(docs, F.col("genres")))
    names = features.hash_names(docs, F.array("title"), 100, signed=False)
    return features.stack_blocks([(genres, 40, 0.7), (names, 100, 0.3)])


def _fields(spark, sf):
    """Documents with the text, genres and names the feature pipelines read."""
    parts = table(spark, sf, "part")
    docs = table(spark, sf, "documents").withColumn("_p", F.pmod(F.col("doc_id"), parts.agg(F.count("*")).scalar()))
    return docs.join(parts, F.col("_p") == F.col("p_partkey")).select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("overview"), F.array("p_type", "p_brand").alias("genres"),
        F.array("p_brand", F.concat(F.lit("Size "), F.col("p_size"))).alias("cast"), F.array("p_type").alias("director"),
        F.concat_ws(" ", "p_name", "p_type").alias("keywords"))


_JOINED = """docs AS (SELECT doc_id AS id, text AS overview, p_name || ' ' || p_type AS keywords, [p_brand, 'Size ' || p_size] AS cast_, [p_type] AS director, [p_type, p_brand] AS genres
FROM documents JOIN part ON p_partkey = ((doc_id % (SELECT count(*) FROM part)) + (SELECT count(*) FROM part)) % (SELECT count(*) FROM part))"""


def _has_terms(name: str, column: str, bigrams: bool, min_df: int, max_df: float, max_features: int) -> str:
    """`name(id)`: documents with a term of the vocabulary of `column`."""
    inner = _tfidf_sql(bigrams, min_df, max_df, max_features).replace("SELECT doc_id AS id,", "SELECT id,").replace("lower(text)", f"lower({column})")
    inner = inner.replace("FROM documents)", "FROM docs)").replace("SELECT count(*) AS n FROM documents", "SELECT count(*) AS n FROM docs")
    return f"{name} AS (SELECT DISTINCT id FROM ({inner}))"


# Smaller than the model's own sizes, so that the queries stay quick; the weights are the model's.
_LIGHT = (features.TextField("overview", 2000, 3, 0.9, True, 50, 0.40), features.TextField("keywords", 500, 2, 0.95, True, 20, 0.10),
          features.NameField("cast", 20, 100, 0.10), features.NameField("director", 3, 50, 0.05))


def _block_sizes(rows, blocks: list[tuple[str, int]]):
    """(id, field, size): the length of each field's block of the vectors."""
    out, at = [], 1
    for name, width in blocks:
        out.append(F.struct(F.lit(name).alias("field"), vx.norm(F.slice("vec", at, width)).alias("size")))
        at += width
    return rows.select("id", F.inline(F.array(*out)))


def _sizes_sql() -> str:
    """Every block is of unit length before the weights, unless the item has nothing in it; the whole is of unit length."""
    fields = [("overview", 0.40, "id IN (SELECT id FROM o)"), ("keywords", 0.10, "id IN (SELECT id FROM k)"), ("cast", 0.10, "true"),
              ("director", 0.05, "true"), ("genres", 0.35, "true")]
    cases = " UNION ALL ".join(f"SELECT id, '{f}' AS field, CASE WHEN {has} THEN {w} ELSE 0 END AS w FROM docs" for f, w, has in fields)
    return f"""WITH {_JOINED}, {_has_terms('o', 'overview', True, 3, 0.9, 2000)}, {_has_terms('k', 'keywords', True, 2, 0.95, 500)},
f AS ({cases}) SELECT id, field, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS size FROM f"""


@query("text_item_features", _sizes_sql(), floats=("size",))
def text_item_features(spark, sf):
    """Each field reduced on its own, brought to unit length, weighted and concatenated: the length of every block."""
    model, rows = features.fit_field_model(_fields(spark, sf), STOP_WORDS, fields=_LIGHT)
    return _block_sizes(rows, features.block_widths(model, _LIGHT))


@query("new_item_features")
def new_item_features(spark, sf):
    """A model fitted on labelled documents, applied to all others."""
    docs = _fields(spark, sf)
    seen = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    model, _ = features.fit_field_model(docs.join(seen, "item_id", "left_semi"), STOP_WORDS, fields=_LIGHT)
    new = features.apply_field_model(docs.join(seen, "item_id", "left_anti"), model, STOP_WORDS, fields=_LIGHT)
    return _block_sizes(new, features.block_widths(model, _LIGHT))


# Labels reduced to as many components as there are labels are only turned, so their cosines are those of the labels.
_NAMES_ONLY = (features.NameField("cast", 20, 200, 0.5), features.NameField("director", 3, 200, 0.3))


@query("unknown_item_lists", f"""WITH {_JOINED},
l AS (SELECT id, 'cast' AS f, 0.5 AS w, unnest(cast_) AS x FROM docs UNION ALL SELECT id, 'director', 0.3, unnest(director) FROM docs
      UNION ALL SELECT id, 'genres', 0.2, unnest(genres) FROM docs),
u AS (SELECT id, f, w, x, w / sqrt(count(*) OVER (PARTITION BY id, f)) AS v FROM l),
b AS (SELECT * FROM u WHERE id IN (SELECT doc_id FROM labels)), known AS (SELECT DISTINCT f, x FROM b),
q AS (SELECT id, f, w, x, w / sqrt(count(*) OVER (PARTITION BY id, f)) AS v FROM l JOIN known USING (f, x) WHERE id NOT IN (SELECT doc_id FROM labels)),
n AS (SELECT id, sqrt(sum(v * v)) AS n FROM (SELECT * FROM q UNION ALL SELECT * FROM b) GROUP BY 1),
s AS (SELECT q.id AS query_id, b.id AS item_id, round(sum(q.v * b.v) / (any_value(nq.n) * any_value(nb.n)), 6) AS similarity
      FROM q JOIN b ON q.f = b.f AND q.x = b.x JOIN n nq ON nq.id = q.id JOIN n nb ON nb.id = b.id GROUP BY 1, 2)
SELECT query_id, item_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM s) WHERE rank <= 5""",
       floats=("similarity",), ints=("rank",))
def unknown_item_lists(spark, sf):
    """Items nobody has seen: cleaned, given features under the fitted model, and searched among the items that are known."""
    docs = _fields(spark, sf)
    seen = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    model, base = features.fit_field_model(docs.join(seen, "item_id", "left_semi"), fields=_NAMES_ONLY, genre_weight=0.2)
    found = content.similar_to_unknown(docs.join(seen, "item_id", "left_anti"), model, base, 5, fields=_NAMES_ONLY, genre_weight=0.2)
    return found.select("query_id", "item_id", "similarity", "rank")


# Fields of the sparse stack (fixed values): vocabulary size, smallest document count, bigrams, weight.
_STACK = {"overview": (1000, 3, True, 0.50), "keywords": (1000, 3, True, 0.04), "cast": (1000, 2, False, 0.04), "director": (200, 2, False, 0.02)}


def _sparse_stack(spark, sf):
    """(entries, total width, starts of the blocks): TF-IDF of four fields and the genre labels, weighted side by side."""
    docs = _fields(spark, sf).withColumn("cast", F.concat_ws(" ", "cast")).withColumn("director", F.concat_ws(" ", "director"))
    blocks, starts, at = [], {}, 0
    for name, (terms, least, bigrams, weight) in _STACK.items():
        _, entries = features.fit_apply_tfidf(docs, name, terms, least, 1.0, STOP_WORDS, bigrams)
        blocks.append((entries, terms, weight))
        starts[name], at = at, at + terms
    labels = cut_lineage(features.fit_labels(docs, F.col("genres")))
    n_labels = labels.count()
    blocks.append((features.binarise(docs, F.col("genres"), labels), n_labels, 0.40))
    return features.stack_blocks(blocks), at + n_labels, starts | {"genres": at}


@query("sparse_item_fields", f"""WITH {_JOINED.replace('AS cast_', 'AS cast_list').replace('AS director', 'AS director_list')},
docs2 AS (SELECT id, overview, keywords, array_to_string(cast_list, ' ') AS cast_, array_to_string(director_list, ' ') AS director, genres FROM docs),
{', '.join(_has_terms(t, c, b, m, 1.0, n).replace('FROM docs)', 'FROM docs2)') for t, c, b, m, n in (
    ('o', 'overview', True, 3, 1000), ('k', 'keywords', True, 3, 1000), ('c', 'cast_', False, 2, 1000), ('d', 'director', False, 2, 200)))}
SELECT id, 'overview' AS field, 0.50 AS size FROM o UNION ALL SELECT id, 'keywords', 0.04 FROM k UNION ALL SELECT id, 'cast', 0.04 FROM c
UNION ALL SELECT id, 'director', 0.02 FROM d UNION ALL SELECT id, 'genres', 0.40 * sqrt(len(list_distinct(genres))) FROM docs""", floats=("size",))
def sparse_item_fields(spark, sf):
    """The weighted sparse stack before it is reduced: the length of every field of every item."""
    entries, _, starts = _sparse_stack(spark, sf)
    field = F.lit(None).cast("string")
    for name, start in sorted(starts.items(), key=lambda x: x[1]):
        field = F.when(F.col("idx") >= start, F.lit(name)).otherwise(field)
    return entries.groupBy("id", field.alias("field")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))


@query("sparse_item_features")
def sparse_item_features(spark, sf):
    """All fields stacked as one weighted sparse matrix, then one truncated SVD."""
    entries, width, _ = _sparse_stack(spark, sf)
    return _checked(linalg.truncated_svd(entries, width, 50)["rows"], 5)


@query("hashed_item_features")
def hashed_item_features(spark, sf):
    """Reduced text next to hashed names of cast and directors, then principal components of all."""
    docs = _fields(spark, sf)
    _, entries = features.fit_apply_tfidf(docs, "overview", 500, 2, 0.9, STOP_WORDS, bigrams=False)
    rows = docs.select(F.col("item_id").alias("id")).join(linalg.truncated_svd(entries, 500, 50)["rows"].withColumnRenamed("vec", "overview"), "id", "left")
    for name, buckets in (("cast", 100), ("director", 50)):
        hashed = features.dense_rows(features.hash_names(docs, F.col(name), buckets), buckets)
        rows = rows.join(hashed.withColumnRenamed("vec", name), "id", "left")
    blocks = [F.coalesce(F.col(c), vx.zeros(n)) for c, n in (("overview", 50), ("cast", 100), ("director", 50))]
    return _checked(linalg.pca(rows.select("id", vx.weighted_concat(blocks, [0.6, 0.3, 0.1]).alias("vec")), 20)["rows"], 3)


def _checked(rows, blocks: int):
    """Vectors summed up in a way that does not depend on the sign or order of components."""
    return rows.select("id", F.size("vec").alias("dim"), vx.norm(F.col("vec")).alias("size"), F.lit(blocks).alias("blocks"))
