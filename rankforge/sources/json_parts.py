"""One large JSON array read by many tasks.

Spark's text source cuts a file into byte ranges at any separator; with `}` as the separator every row is a piece that
ends where an object may end. Whether it does depends on what came before: on being inside a string, and on the
depth of open objects. Each range is first summed up for both cases (begun inside a string or not), the sums of a file
are chained, one row per range, and with its start known a range gives out its whole objects. Only an object that
lies across ranges is put together from its fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fits

ESCAPE = re.compile(rb"\\.", re.DOTALL)
LINE_ENDS = bytes.maketrans(b"\r\n", b"  ")  # never inside a string of valid JSON
SUMMARY = "file string, at bigint, quotes bigint, out_change bigint, out_least bigint, in_change bigint, in_least bigint"
RUN_BYTES = 1 << 20  # of text worked on at a time: the marks of a text take dozens of times its room
STATE = "file string, at bigint, inside boolean, depth bigint, owner bigint"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, n, piece): the rows of every byte range in order of `n`, without the `}` that ended them."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                       F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("piece"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int, bytes]]:
    """Neighbouring rows of one byte range, with the first one's place, as one text in which each row is ended by its `}`.

    A text ends with the row that brings it to RUN_BYTES, so a run of a range may go on in the next.
    """
    files, ats, pieces = batch.column("file"), batch.column("at").to_numpy(), batch.column("piece")
    sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
    first, size = 0, 0
    for i in range(1, len(pieces) + 1):
        size += int(sizes[i - 1]) + 1
        if i == len(pieces) or size >= RUN_BYTES or ats[i] != ats[first] or files[i] != files[first]:
            yield first, files[first].as_py(), int(ats[first]), b"}".join(pieces[first:i].to_pylist()) + b"}"
            first, size = i, 0


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(+1 or -1 per brace and 0 elsewhere, 1 where an odd number of quotes lies before, number of quotes)."""
    plain = np.frombuffer(ESCAPE.sub(b"__", text) if b"\\" in text else text, np.uint8)
    quotes = np.cumsum(plain == 34)
    return (plain == 123).astype(np.int64) - (plain == 125), quotes & 1, int(quotes[-1])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per byte range and for both starts: how the depth changes, and its least value on the way."""
    names = [part.split()[0] for part in SUMMARY.split(", ")]
    key, quotes, change, least = None, 0, [0, 0], [0, 0]

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(names, (*key, quotes, change[0], least[0], change[1], least[1])))])

    for batch in batches:
        for _, file, at, text in _runs(batch):
            if key != (file, at):
                if key is not None:
                    yield row()
                key, quotes, change, least = (file, at), 0, [0, 0], [0, 0]
            step, odd, more = _marks(text)
            for start in (0, 1):  # outside or inside a string where the range begins
                depth = change[start] + np.cumsum(np.where(odd == (quotes + start) % 2, step, 0))
                change[start], least[start] = int(depth[-1]), min(least[start], int(depth.min()))
            quotes += more
    if key is not None:
        yield row()


def _chained(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state each range of one file begins in; `owner` is the range in which the object open there began."""
    inside, depth, owner, out = 0, 0, None, []
    ranges = ranges.sort_values("at")
    for r in ranges.itertuples(index=False):
        out.append((r.file, r.at, bool(inside), depth, owner if depth else None))
        change, least = (r.in_change, r.in_least) if inside else (r.out_change, r.out_least)
        if depth + least <= 0:
            owner = r.at
        inside, depth = (inside + r.quotes) % 2, depth + change
    if inside or depth not in (0, -1):  # the last piece is ended by the end of the file as a rule, not by a brace
        raise ValueError(f"not an array of JSON objects: {ranges['file'].iloc[0]}")
    return pd.DataFrame(out, columns=["file", "at", "inside", "depth", "owner"]).astype({"owner": "Int64"})


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole objects (`owner` null), and fragments of those that lie across ranges (`owner`: where they began)."""
    key, inside, depth, owner, held = None, 0, 0, None, []

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                                          names=["file", "owner", "at", "value"])

    for batch in batches:
        for first, file, at, text in _runs(batch):
            found = []
            if key != (file, at):
                if held:
                    found.append((key[0], key[1] if owner is None else owner, key[1], b"".join(held)))
                key, held = (file, at), []
                inside, depth, owner = (batch.column(c)[first].as_py() for c in ("inside", "depth", "owner"))
            step, odd, more = _marks(text)
            step = np.where(odd == inside, step, 0)
            where = np.flatnonzero(step)
            level = depth + np.cumsum(step[where])
            opened = where[(step[where] == 1) & (level == 1)]
            closed = where[(step[where] == -1) & (level == 0)] + 1
            text = text.translate(LINE_ENDS)
            if depth > 0:
                opened = np.concatenate([[0], opened])
            for a, b in zip(opened, closed):
                found.append((file, owner, at, b"".join(held) + text[a:b]))
                held, owner = [], None
            if len(opened) > len(closed):
                held.append(text[opened[-1]:])
            inside, depth = (inside + more) % 2, int(level[-1]) if len(level) else depth
            if found:
                yield rows(found)
    if held:
        yield rows([(key[0], key[1] if owner is None else owner, key[1], b"".join(held))])


def json_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """`(value string)`: the text of every object in the JSON arrays at `path`, line ends made blanks.

    Valid UTF-8 JSON with double-quoted strings; elements that are no objects are passed over; an empty array or file
    has no rows; several arrays in one file are read one after the other. Unbalanced text: ValueError in the job.
    """
    pieces = _pieces(spark, path)
    summed = pieces.select("file", "at", "piece").mapInArrow(_summaries, SUMMARY)
    states = summed.groupBy("file").applyInPandas(_chained, STATE)
    if fits(summed, 200):
        begun = pieces.join(F.broadcast(states), ["file", "at"])
    else:
        begun = pieces.join(states, ["file", "at"]).repartition("file", "at").sortWithinPartitions("file", "at", "n")
    found = begun.select("file", "at", "piece", "inside", "depth", "owner").mapInArrow(
        _objects, "file string, owner bigint, at bigint, value binary")
    whole = found.filter("owner IS NULL").select("value")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: F.hex(p["value"]))
    across = found.filter("owner IS NOT NULL").groupBy("file", "owner").agg(F.unhex(F.array_join(parts, "")).alias("value"))
    return whole.unionByName(across.select("value")).select(F.decode("value", "UTF-8").alias("value"))
