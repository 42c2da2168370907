"""Text and label features in long form: `(id, idx, value)` entries of a sparse matrix."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.vectors import doubles, l2_normalise, mean_vector, weighted_concat, zeros
from ..session import cut_lineage, fits, parallelism
from .linalg import project, truncated_svd
from .ordering import dense_ids

TERM_BYTES = 120  # of a vocabulary row; a small vocabulary is broadcast, a larger one joined by term
SALTS = 16
PART_BYTES = 16 * 1024 * 1024  # of text a task counts the terms of: its table of (document, term) stays in memory


def term_counts(docs: DataFrame, column: str, stop_words: list[str] | None = None, bigrams: bool = True,
                id: str = "item_id", only: DataFrame | None = None) -> DataFrame:
    """`(id, term, tf)`: words of two or more characters, and pairs of neighbours once the stop words are out.

    The texts are dealt out by id and counted where they lie, so no term is sent. `only`, a vocabulary small enough to
    broadcast, drops all other terms before they are counted.
    """
    rows = _by_id(docs.select(F.col(id).cast("bigint").alias("id"), F.col(column).alias("_text")))
    rows = rows.select("id", tx.words(F.col("_text"), stop_words).alias("word"))
    if bigrams:
        pairs = rows.withColumn("next", F.slice("word", 2, F.greatest(F.size("word"), F.lit(1)))).select(
            "id", F.inline(F.arrays_zip("word", "next")))
        terms = pairs.select("id", F.explode(F.array("word", F.concat("word", F.lit(" "), "next"))).alias("term"))
        terms = terms.filter(F.col("term").isNotNull())
    else:
        terms = rows.select("id", F.explode("word").alias("term"))
    if only is not None:
        terms = terms.join(F.broadcast(only.select("term")), "term", "left_semi")
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def _by_id(rows: DataFrame) -> DataFrame:
    """`(id, _text)` with all rows of an id in one partition, and as many partitions as the texts need."""
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = -(-size // PART_BYTES)
    return rows.repartition(parts, "id") if parts > parallelism(rows.sparkSession) else rows.repartition("id")


def fit_vocabulary(counts: DataFrame, n_docs: Column, max_features: int, min_df: int = 1,
                   max_df: float = 1.0) -> DataFrame:
    """`(term, idx, df, idf)`: the terms of highest corpus count, indexed in alphabetical order.

    Terms in fewer than `min_df` documents or in more than the share `max_df` are left out first;
    idf = ln((1 + N) / (1 + df)) + 1.
    """
    if max_features < 1:
        raise ValueError("max_features must be positive")
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    fit = stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    kept = fit.orderBy(F.desc("n"), "term").limit(max_features)
    kept = cut_lineage(kept.select("term", "df"))
    placed = dense_ids(kept, ["term"], "idx").join(kept, "term")
    return placed.select("term", F.col("idx").cast("int").alias("idx"), "df", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_entries(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """`(id, idx, term, value)`: tf * idf, each document scaled to unit length.

    A vocabulary that does not fit a broadcast is joined by term. A term is then as hot as its document count, so both sides
    are salted: a usual term's rows go to many tasks, and the vocabulary, which has a row per term, is sent to each.
    """
    if fits(vocabulary, TERM_BYTES):
        met = counts.join(F.broadcast(vocabulary), "term")
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
        copies = vocabulary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = counts.withColumn("_salt", salt).join(copies, ["term", "_salt"])
    weighted = met.select(
        "id", F.struct("idx", "term", (F.col("tf") * F.col("idf")).alias("w")).alias("e"))
    # A document has at most as many entries as the vocabulary has terms.
    rows = weighted.groupBy("id").agg(
        F.collect_list("e").alias("es"), F.sqrt(F.sum(F.col("e.w") * F.col("e.w"))).alias("size"))
    return rows.select("id", "size", F.explode("es").alias("e")).select(
        "id", "e.idx", "e.term", (F.col("e.w") / F.col("size")).alias("value"))


def fit_tfidf(docs: DataFrame, column: str, max_features: int, min_df: int = 1, max_df: float = 1.0,
              stop_words: list[str] | None = None, bigrams: bool = True, id: str = "item_id") -> DataFrame:
    """Vocabulary of a text column."""
    n_docs = docs.agg(F.count("*")).scalar()
    return fit_vocabulary(term_counts(docs, column, stop_words, bigrams, id), n_docs, max_features, min_df, max_df)


def apply_tfidf(docs: DataFrame, column: str, vocabulary: DataFrame, stop_words: list[str] | None = None,
                bigrams: bool = True, id: str = "item_id") -> DataFrame:
    """Entries of a text column under a fitted vocabulary."""
    only = vocabulary if fits(vocabulary, TERM_BYTES) else None
    return tfidf_entries(term_counts(docs, column, stop_words, bigrams, id, only), vocabulary)


def fit_apply_tfidf(docs: DataFrame, column: str, max_features: int, min_df: int = 1, max_df: float = 1.0,
                    stop_words: list[str] | None = None, bigrams: bool = True,
                    id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(vocabulary, entries) of the same documents; the texts are read twice, as their terms would take far more room."""
    vocabulary = cut_lineage(fit_tfidf(docs, column, max_features, min_df, max_df, stop_words, bigrams, id))
    return vocabulary, apply_tfidf(docs, column, vocabulary, stop_words, bigrams, id)


def fit_labels(docs: DataFrame, labels: Column) -> DataFrame:
    """`(label, idx)` of all labels of an array column, in sorted order."""
    return dense_ids(docs.select(F.explode(labels).alias("label")), ["label"], "idx")


def binarise(docs: DataFrame, labels: Column, classes: DataFrame, id: str = "item_id") -> DataFrame:
    """1.0 per label of a document; labels that were not seen when fitting are ignored."""
    found = docs.select(F.col(id).alias("id"), F.explode(F.array_distinct(labels)).alias("label"))
    return found.join(classes, "label").select("id", "idx", "label", F.lit(1.0).alias("value"))


def fit_positional(docs: DataFrame, labels: Column) -> DataFrame:
    """`(pos, label, idx)` of the values seen at each list position."""
    return dense_ids(docs.select(F.posexplode(labels).alias("pos", "label")), ["pos", "label"], "idx")


def one_hot_positional(docs: DataFrame, labels: Column, classes: DataFrame, id: str = "item_id") -> DataFrame:
    found = docs.select(F.col(id).alias("id"), F.posexplode(labels).alias("pos", "label"))
    return found.join(classes, ["pos", "label"]).select("id", "idx", "pos", "label", F.lit(1.0).alias("value"))


def hash_names(docs: DataFrame, names: Column, n_buckets: int, signed: bool = True, id: str = "item_id") -> DataFrame:
    """Sum of +-1 (or 1) per hash bucket of the names; buckets that cancel out are dropped."""
    digest = F.md5("name")
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n_buckets
    odd = F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2
    unit = F.when(odd == 0, 1.0).otherwise(-1.0) if signed else F.lit(1.0)
    each = docs.select(F.col(id).alias("id"), F.explode(names).alias("name"))
    return (each.groupBy("id", bucket.cast("int").alias("idx")).agg(F.sum(unit).alias("value"))
            .filter(F.col("value") != 0))


def mean_word_vectors(docs: DataFrame, words: Column, table: DataFrame, dim: int, id: str = "item_id") -> DataFrame:
    """`(id, vec)`: mean of the vectors of the words found in `table(word, vec)`; zeros when none is."""
    each = docs.select(F.col(id).alias("id"), F.explode(words).alias("word"))
    means = each.join(table, "word").groupBy("id").agg(mean_vector(F.col("vec")).alias("vec"))
    return docs.select(F.col(id).alias("id")).join(means, "id", "left").select(
        "id", F.coalesce("vec", zeros(dim)).alias("vec"))


def attach_embeddings(docs: DataFrame, column: str, table: DataFrame, dim: int, id: str = "item_id") -> DataFrame:
    """`(id, vec)` of precomputed document vectors; zeros for blank text or no vector."""
    keyed = docs.select(F.col(id).alias("id"), F.col(column).alias("_text"))
    found = keyed.join(table.select("id", "vec"), "id", "left")
    usable = F.col("vec").isNotNull() & ~tx.is_blank(F.col("_text"))
    return found.select("id", F.when(usable, doubles(F.col("vec"))).otherwise(zeros(dim)).alias("vec"))


def stack_blocks(blocks: list[tuple[DataFrame, int, float]]) -> DataFrame:
    """Weighted concatenation of sparse blocks `(entries, width, weight)`; weights sum to 1."""
    if abs(sum(w for _, _, w in blocks) - 1.0) > 1e-6:
        raise ValueError("weights must sum to 1")
    parts, offset = [], 0
    for entries, width, weight in blocks:
        parts.append(entries.select("id", (F.col("idx") + offset).cast("int").alias("idx"),
                                    (F.col("value") * weight).alias("value")))
        offset += width
    return reduce(DataFrame.unionByName, parts)


def dense_rows(entries: DataFrame, width: int, ids: DataFrame | None = None) -> DataFrame:
    """Entries as `(id, vec)` with zeros filled in; `ids(id)` adds rows without entries."""
    cells = entries.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    rows = cells.select("id", vec.alias("vec"))
    if ids is None:
        return rows
    return ids.select("id").join(rows, "id", "left").select("id", F.coalesce("vec", zeros(width)).alias("vec"))


@dataclass(frozen=True)
class TextField:
    """Words of a text column: vocabulary size, document counts kept, bigrams; reduced to `width` components."""
    name: str
    terms: int
    least: int
    most: float
    bigrams: bool
    width: int
    weight: float


@dataclass(frozen=True)
class NameField:
    """The first `names` entries of a list column as labels; reduced to `width` components."""
    name: str
    names: int
    width: int
    weight: float


# The item feature model (fixed values); genres are labels that are not reduced.
FIELDS = (TextField("overview", 5000, 3, 0.9, True, 100, 0.40), TextField("keywords", 1000, 2, 0.95, True, 50, 0.10),
          NameField("cast", 20, 100, 0.10), NameField("director", 3, 50, 0.05))
GENRE_WEIGHT = 0.35


def _first_names(field: NameField) -> Column:
    names = F.transform(F.coalesce(F.col(field.name), F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.slice(F.filter(names, lambda x: x != ""), 1, field.names)


def _field_entries(docs: DataFrame, field: TextField | NameField, table: DataFrame, stop_words: list[str] | None, id: str) -> DataFrame:
    if isinstance(field, TextField):
        return apply_tfidf(docs, field.name, table, stop_words, field.bigrams, id)
    return binarise(docs, _first_names(field), table, id)


def fit_field_model(docs: DataFrame, stop_words: list[str] | None = None, seed: int = 42, id: str = "item_id",
                    fields: tuple[TextField | NameField, ...] = FIELDS, genre_weight: float = GENRE_WEIGHT) -> tuple[dict[str, DataFrame], DataFrame]:
    """(model, `(id, vec)` of the documents it is fitted on).

    Each field is reduced on its own: words by TF-IDF, names by labels, then the leading singular vectors. The model holds terms or
    labels and components per field, and the genre labels. These tables are all it takes to give new items their
    features, and can be saved as Parquet. Rows stay sparse until they are reduced, so a field may have any number of labels.
    """
    model, reduced = {"genres": cut_lineage(fit_labels(docs, F.col("genres")))}, {}
    for field in fields:
        if isinstance(field, TextField):
            table, entries = fit_apply_tfidf(docs, field.name, field.terms, field.least, field.most, stop_words, field.bigrams, id)
        else:
            table = cut_lineage(fit_labels(docs, _first_names(field)))
            entries = _field_entries(docs, field, table, stop_words, id)
        n = table.count()  # a small corpus has fewer terms than the field may hold
        svd = truncated_svd(entries, n + 1, min(field.width, max(1, n)), seed)
        model[f"{field.name}_terms"] = table
        model[f"{field.name}_components"] = svd["components"]
        reduced[field.name] = svd["rows"]
    return model, _joined_fields(docs, model, reduced, id, fields, genre_weight)


def apply_field_model(docs: DataFrame, model: dict[str, DataFrame], stop_words: list[str] | None = None, id: str = "item_id",
                      fields: tuple[TextField | NameField, ...] = FIELDS, genre_weight: float = GENRE_WEIGHT) -> DataFrame:
    """`(id, vec)` of new documents under a fitted model."""
    reduced = {}
    for field in fields:
        table, components = model[f"{field.name}_terms"], model[f"{field.name}_components"]
        entries = _field_entries(docs, field, table, stop_words, id)
        reduced[field.name] = project(entries, components, table.count() + 1, _width(components))
    return _joined_fields(docs, model, reduced, id, fields, genre_weight)


def _width(components: DataFrame) -> int:
    first = components.select(F.size("vec")).first()
    return first[0] if first else 1


def block_widths(model: dict[str, DataFrame], fields: tuple[TextField | NameField, ...] = FIELDS) -> list[tuple[str, int]]:
    """The blocks of a feature vector in their order."""
    return [(f.name, _width(model[f"{f.name}_components"])) for f in fields] + [("genres", model["genres"].count())]


def _joined_fields(docs: DataFrame, model: dict[str, DataFrame], reduced: dict[str, DataFrame], id: str,
                   fields: tuple[TextField | NameField, ...], genre_weight: float) -> DataFrame:
    """Reduced fields and genres, each of unit length, weighted, concatenated, of unit length again."""
    rows = docs.select(F.col(id).cast("bigint").alias("id"))
    widths, blocks = dict(block_widths(model, fields)), []
    for field in fields:
        rows = rows.join(reduced[field.name].withColumnRenamed("vec", field.name), "id", "left")
        blocks.append(l2_normalise(F.coalesce(F.col(field.name), zeros(widths[field.name]))))
    genres = dense_rows(binarise(docs, F.col("genres"), model["genres"], id), widths["genres"])
    rows = rows.join(genres.withColumnRenamed("vec", "genres"), "id", "left")
    blocks.append(l2_normalise(F.coalesce(F.col("genres"), zeros(widths["genres"]))))
    return rows.select("id", l2_normalise(weighted_concat(blocks, [*[f.weight for f in fields], genre_weight])).alias("vec"))
