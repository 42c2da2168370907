"""Chat formatting by grammar round trip, in DataFrame functions only.

The grammar of a formatted conversation is

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

where role and text hold neither mark, and a role holds no line break. The parser is deterministic:
it splits at the start mark, takes the role up to the first line break and the text up to the end
mark, then undoes escapes. A conversation is first rendered as it is and parsed again. If the parsed
turns differ from the source, the turns that do not survive on their own are escaped, and if that
is not enough all of them, which always parses back to the source: an escaped text holds no "<|".

Escapes: a backslash goes between "<" and the backslashes and bar that follow it ("<|" to "<\\|",
"<\\|" to "<\\\\|"), so that undoing removes exactly one. A line break in a role becomes "<|nl|>".

Defined results: null role or text is the empty string; rows of one conversation are ordered by
(turn, role, text), so equal turns and repeated rows all stay; a null turn comes first; a null
conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
A conversation is one value of the result and so must fit Spark's 2 GB limit for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
_TAIL = END + "\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(BREAK))


def _plain_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(BREAK), F.lit("\n")))


def _rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(_TAIL))


def parsed_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation as array<struct<role, text>>; null where it breaks the grammar."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.filter(parts, lambda part, i: i > 0)

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        body = F.substring(part, line + 1, F.length(part) - line - len(_TAIL))
        fits = (line > 0) & F.endswith(part, F.lit(_TAIL)) & (F.length(part) >= line + len(_TAIL))
        return F.when(fits & ~F.contains(body, F.lit(END)), F.struct(
            _plain_role(F.substring(part, F.lit(1), line - 1)).alias("role"), unescaped(body).alias("text")))

    read = F.transform(turns, turn)
    whole = (F.element_at(parts, 1) == "") & ~F.exists(read, lambda t: t.isNull())
    return F.when(whole, read)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (parsed back from it), level (0 nothing
    escaped, 1 the conflicting turns, 2 all turns) and round_trips (the parsed turns equal the source)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    gathered = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("_rows"))
    source = gathered.select("conv_id", F.transform(
        "_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("_source"))

    def rendered(how) -> Column:
        return F.array_join(F.transform("_source", how), "")

    def raw(t: Column) -> Column:
        return _rendered_turn(t["role"], t["text"])

    def safe(t: Column) -> Column:
        return _rendered_turn(_escaped_role(t["role"]), escaped(t["text"]))

    def guarded(t: Column) -> Column:
        alone = parsed_turns(raw(t))
        return F.when(F.coalesce(alone == F.array(t), F.lit(False)), raw(t)).otherwise(safe(t))

    def same(column: str) -> Column:
        return F.coalesce(parsed_turns(F.col(column)) == F.col("_source"), F.lit(False))

    first = source.withColumn("_raw", rendered(raw)).withColumn("_raw_ok", same("_raw"))
    second = (first.withColumn("_guarded", F.when(~F.col("_raw_ok"), rendered(guarded)))
              .withColumn("_guarded_ok", F.when(~F.col("_raw_ok"), same("_guarded"))))
    formatted = (F.when(F.col("_raw_ok"), F.col("_raw")).when(F.col("_guarded_ok"), F.col("_guarded"))
                 .otherwise(rendered(safe)))
    level = F.when(F.col("_raw_ok"), 0).when(F.col("_guarded_ok"), 1).otherwise(2)
    out = second.select("conv_id", "_source", formatted.alias("formatted"), level.alias("level"))
    out = out.withColumn("turns", parsed_turns(F.col("formatted")))
    return out.select("conv_id", "formatted", "turns", "level",
                      F.coalesce(F.col("turns") == F.col("_source"), F.lit(False)).alias("round_trips"))


def loss_text(turns: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """Text under the loss mask: the unescaped texts of the trained roles, in order."""
    trained = F.filter(turns, lambda t: t["role"].isin(*roles))
    return F.array_join(F.transform(trained, lambda t: t["text"]), "")


def loss_spans(formatted: DataFrame, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The mask as rows (conv_id, turn, start, length): code points of `formatted`, start from 0."""
    parts = formatted.select("conv_id", F.posexplode(F.split("formatted", r"<\|im_start\|>", -1)).alias("turn", "_part"))
    size = F.length("_part") + F.when(F.col("turn") > 0, len(START)).otherwise(0)
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    line = F.instr("_part", "\n")
    placed = parts.withColumn("_from", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return (placed.filter("turn > 0")
            .filter(_plain_role(F.substring("_part", F.lit(1), line - 1)).isin(*roles))
            .select("conv_id", (F.col("turn") - 1).alias("turn"),
                    (F.col("_from") + len(START) + line).cast("long").alias("start"),
                    (F.length("_part") - line - len(_TAIL)).cast("long").alias("length")))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digest columns read back from the formatted text."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("_loss", loss_text(F.col("turns"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "level", "round_trips")
