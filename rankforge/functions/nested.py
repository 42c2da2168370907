"""JSON and nested-array expressions for raw item documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import squeeze, strip

CREW_ROLES = ("director", "creator")
NAMED = "array<struct<id:bigint,name:string,iso_639_1:string>>"


def joined_names(c: Column, field: str = "name") -> Column:
    """Names of an array of structs joined by ', '; null array gives ''."""
    names = F.filter(F.transform(c, lambda x: F.trim(x[field])), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def role_names(credits: Column, roles: tuple[str, ...] = CREW_ROLES) -> Column:
    """Names in `credits` whose type is one of `roles`; missing names are left out."""
    def wanted(x: Column) -> Column:
        return x["type"].isin(*roles) & x["name"].isNotNull() & (F.trim(x["name"]) != "")
    return F.array_join(F.transform(F.filter(credits, wanted), lambda x: F.trim(x["name"])), ", ")


def coerce_names(c: Column) -> Column:
    """`["a"]`, `[{"name":"a"}]`, single-quoted lists or plain text -> 'a, b'."""
    parsed = F.from_json(c, "array<string>")
    flat = F.transform(parsed, lambda x: squeeze(F.coalesce(
        F.get_json_object(x, "$.name"), F.get_json_object(x, "$.iso_639_1"), x)))
    joined = F.array_join(F.filter(flat, lambda x: x.isNotNull() & (x != "")), ", ")
    text = F.when(strip(c).startswith("["), "").otherwise(squeeze(c))
    return F.coalesce(joined, text, F.lit(""))


def repair_json_list(c: Column, element: str) -> Column:
    """Parse a JSON list; on failure mend quotes and glued objects; on failure again, empty list.

    `element` is the DDL type of one element.
    """
    kind = f"array<{element}>"
    mended = F.regexp_replace(F.regexp_replace(F.translate(c, "'", '"'), r"\}\s*\{", "},{"), r"\]\s*\[", "],[")
    wrapped = F.when(strip(mended).startswith("["), mended).otherwise(F.concat(F.lit("["), mended, F.lit("]")))

    def parse(text: Column) -> Column:
        found = F.from_json(text, kind, {"mode": "PERMISSIVE"})
        return F.when(F.exists(found, lambda x: x.isNull()), None).otherwise(found)

    strict = F.when(strip(c).startswith("["), parse(c))
    return F.coalesce(strict, parse(wrapped), F.from_json(F.lit("[]"), kind))


def credits_from_crew_and_cast(crew: Column, cast: Column, image_prefix: str) -> Column:
    """One credits array: crew with job 'Director' as type director, then the cast as type cast."""
    def entry(x: Column, kind: str, character: Column) -> Column:
        image = F.when(x["profile_path"].isNotNull(), F.concat(F.lit(image_prefix), x["profile_path"]))
        return F.struct(F.lit(kind).alias("type"), x["name"].alias("name"), x["id"].alias("id"),
                        character.alias("character"), image.alias("image"))

    nothing = F.lit(None).cast("string")
    directors = F.transform(F.filter(crew, lambda x: x["job"] == "Director"), lambda x: entry(x, "director", nothing))
    actors = F.transform(cast, lambda x: entry(x, "cast", x["character"]))
    return F.concat(directors, actors)


def wrapped_date(c: Column) -> Column:
    """'2001-05-04' -> struct that renders as {"$date": "2001-05-04T00:00:00Z"}."""
    return F.when(c.isNotNull(), F.struct(F.concat(c, F.lit("T00:00:00Z")).alias("$date")))


def release_year(c: Column) -> Column:
    """Year of an ISO string, `{"$date": iso}` or `{"$date": {"$numberLong": ms}}`; else null."""
    def iso_year(text: Column) -> Column:
        return F.year(F.try_to_date(F.substring_index(text, "T", 1), "yyyy-MM-dd"))

    wrapped = F.get_json_object(c, "$['$date']")
    millis = F.get_json_object(c, "$['$date']['$numberLong']").try_cast("bigint")
    days = F.floor(millis / F.lit(86400000)).cast("int")
    return F.coalesce(iso_year(c), iso_year(wrapped), F.year(F.date_add(F.lit("1970-01-01").cast("date"), days)))


def year_prefix(c: Column) -> Column:
    """First four characters as a number, else null."""
    return F.substring(c, 1, 4).try_cast("int")
