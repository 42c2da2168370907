"""Cleaning of text and delimited lists (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN = "unknown"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Delete punctuation, lower, collapse white space; null or empty gives 'unknown'."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")
    return F.when(c.isNull() | (c == ""), UNKNOWN).otherwise(squeeze(F.lower(kept)))


def clean_text_keep_commas(c: Column) -> Column:
    """As `clean_text` with commas kept; blank gives 'Unknown'."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}_\s,]", "")
    return F.when(is_blank(c), "Unknown").otherwise(squeeze(F.lower(kept)))


def clean_list_field(c: Column) -> Column:
    """' Drama , Crime' -> 'drama,crime'; blank gives 'unknown'."""
    return F.when(is_blank(c), UNKNOWN).otherwise(F.regexp_replace(F.lower(strip(c)), r"\s*,\s*", ","))


def clean_multi_delimiter(c: Column) -> Column:
    """`|` and `;` become commas, empty places vanish, ends are stripped; blank gives 'Unknown'."""
    commas = F.regexp_replace(F.translate(c, "|;", ",,"), r",(\s*,)+", ",")
    return F.when(is_blank(c), "Unknown").otherwise(F.regexp_replace(commas, r"^[,\s]+|[,\s]+$", ""))


def keyword_tokens(c: Column) -> Column:
    """'Space Opera, Aliens' -> 'space opera aliens'; blank gives 'unknown'."""
    parts = F.filter(F.transform(F.split(F.lower(c), ","), strip), lambda x: x != "")
    return F.when(is_blank(c), UNKNOWN).otherwise(F.array_join(parts, " "))


def name_list(c: Column) -> Column:
    """Names of a list delimited by `,` `;` or `|`, blanks dropped, as an array."""
    parts = F.split(F.translate(F.coalesce(c, F.lit("")), ";|", ",,"), ",")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def first_names(c: Column, n: int) -> Column:
    return F.slice(name_list(c), 1, n)


def split_genres(c: Column) -> Column:
    return F.split(c, r"\|")


def tokens(c: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def words(c: Column, stop_words: list[str] | None = None) -> Column:
    """Tokens without the stop words."""
    found = tokens(c)
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found

