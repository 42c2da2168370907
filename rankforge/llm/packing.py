"""Packing token sequences as a cutting-stock problem, by column generation.

A document's ids are followed by one end id and cut into full sequences and a rest. Full pieces are
sequences of their own. Rests are counted by length class (a class covers `UNIT` lengths and is
worked with as its longest), and the counts, a bounded table, go to the driver. There a linear program
over patterns (how many pieces of each class share a sequence) is solved: a simplex basis gives class
prices, a knapsack dynamic program finds the pattern of the largest price, and that pattern
enters the basis until none is worth more than a sequence or the proven gap is small. Pattern counts are
rounded down; what they leave over is filled in largest first. Pieces are then ranked in their class,
and a rank says which copy of which pattern a piece goes to.

Defined results: a null or empty text is the end id alone; repeated rows (also of one doc_id) are
packed each on their own; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from . import bpe
from .positions import numbered

LENGTH, UNIT = 1024, 4


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full pieces and the rest of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_text(path))

    def run(batches):
        vocab = bpe.shared_vocabulary(shared)
        end = np.array([end_id])
        for batch in batches:
            at = 0
            for group in bpe.text_groups(batch.column(1)):
                owner, start, size, crc, tokens = [], [], [], [], []
                for i, ids in enumerate(bpe.encode_texts(vocab, group)):
                    raw, n = memoryview(np.concatenate((ids, end)).astype("<u4").tobytes()), len(ids) + 1
                    for s in range(0, n, length):
                        e = min(n, s + length)
                        owner.append(at + i)
                        start.append(s)
                        size.append(e - s)
                        crc.append(zlib.crc32(raw[4 * s:4 * e]))
                        tokens.append(n)
                at += len(group)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, size, crc, tokens)]],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


@dataclass
class Pattern:
    """`copies` sequences, each with `uses[i]` pieces of class i."""
    uses: np.ndarray
    copies: int


class _Knapsack:
    """Dynamic program over room: the best of w is the best of u and of w - u, for every u.

    Each round doubles the number of pieces a pattern may hold, and it ends when a round adds nothing.
    """

    def __init__(self, sizes: np.ndarray, room: int):
        self.sizes, self.room = sizes, room
        w, u = np.arange(room + 1)[:, None], np.arange(room // 2 + 1)[None, :]
        self.rest = np.where(u <= w, w - u, 0)
        self.outside = u > w
        self.fits = np.searchsorted(sizes, np.arange(room + 1), side="right")

    def best(self, prices: np.ndarray) -> tuple[float, np.ndarray]:
        top = np.concatenate(([0], np.maximum.accumulate(prices)))
        value, cuts = top[self.fits], []
        while True:
            sums = value[None, :self.room // 2 + 1] + value[self.rest]
            sums[self.outside] = -1
            cut = sums.argmax(axis=1)
            better = sums[np.arange(self.room + 1), cut]
            gained = better > value + 1e-12
            if not gained.any():
                break
            cuts.append(np.where(gained, cut, 0))
            value = np.where(gained, better, value)
        rooms = [self.room]
        for cut in reversed(cuts):
            rooms = [part for w in rooms for part in ((int(cut[w]), w - int(cut[w])) if cut[w] else (w,))]
        uses = np.zeros(len(self.sizes), dtype=np.int64)
        for w in rooms:
            fit = int(self.fits[w])
            if fit and prices[:fit].max() > 0:
                uses[int(np.argmax(prices[:fit]))] += 1
        return float(value[self.room]), uses


def _first_basis(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A pattern per class, led by that class and filled with smaller ones, largest first, while they last."""
    m, left = len(sizes), counts.astype(float)
    basis, amount = [np.zeros(0)] * m, np.zeros(m)
    for i in range(m - 1, -1, -1):
        uses, space = np.zeros(m, dtype=np.int64), room
        x = left[i]
        uses[i] = 1
        if x > 0 and i > 0:
            space -= int(sizes[i])
            for j in range(min(i, int(np.searchsorted(sizes, space, side="right"))) - 1, -1, -1):
                fill = min(space // int(sizes[j]), int(left[j] // x))
                if fill > 0:
                    uses[j] = fill
                    space -= fill * int(sizes[j])
        if uses.sum() == 1:
            uses[i] = room // int(sizes[i])
            x = left[i] / uses[i]
        left -= x * uses
        left = np.maximum(left, 0)
        basis[i], amount[i] = uses, x
    return basis, amount


def cutting_patterns(sizes: np.ndarray, counts: np.ndarray, room: int, gap: float = 1e-3) -> list[Pattern]:
    """Patterns that use every class exactly `counts` times. `sizes` ascend and are at most `room`.

    The linear program ends at the optimum, or once the value is within `gap` of the bound that the
    best price proves.
    """
    m = len(sizes)
    if m == 0:
        return []
    basis, amount = _first_basis(sizes, counts, room)
    inverse = np.linalg.inv(np.array(basis, dtype=float).T)
    knapsack = _Knapsack(sizes, room)
    for _ in range(60 * m):
        prices = np.maximum(inverse.sum(axis=0), 0)
        value, uses = knapsack.best(prices)
        if value <= 1 + max(gap, 1e-9):
            break
        step = inverse @ uses
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, amount / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        basis[out] = uses
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    left, patterns = counts.astype(np.int64).copy(), []
    for uses, x in sorted(zip(basis, amount), key=lambda p: -p[1]):
        used = uses > 0
        copies = min(int(np.floor(x + 1e-6)), int((left[used] // uses[used]).min()))
        if copies > 0:
            patterns.append(Pattern(uses.astype(np.int64), copies))
            left -= copies * uses
    while left.any():  # the rounding left less than a sequence for each pattern
        uses, space = np.zeros(m, dtype=np.int64), room
        for i in range(m - 1, -1, -1):
            uses[i] = min(int(left[i]), space // int(sizes[i]))
            space -= int(uses[i] * sizes[i])
        used = uses > 0
        copies = int((left[used] // uses[used]).min())
        patterns.append(Pattern(uses, copies))
        left -= copies * uses
    return patterns


def pack(pieces: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Add sequence_id and offset to pieces of at most `length` tokens."""
    spark = pieces.sparkSession
    rest = F.col("length") < length
    kind = F.when(rest, F.ceil(F.col("length") / unit)).otherwise(0).cast("int")
    ranked = numbered(pieces.withColumn("_class", kind), ["_class"], ["doc_id", "start", "ids_crc32"], "_rank")
    counts = {r[0]: r[1] for r in pieces.groupBy(kind.alias("c")).count().collect()}  # a row per class
    full = counts.pop(0, 0)
    sizes = np.array(sorted(counts), dtype=np.int64)
    patterns = cutting_patterns(sizes, np.array([counts[s] for s in sizes.tolist()], dtype=np.int64), length // unit)
    slots, begin, base = [(0, 0, full, 1, 0)], dict.fromkeys(sizes.tolist(), 0), full
    for pattern in patterns:
        for i in np.flatnonzero(pattern.uses):
            size, uses = int(sizes[i]), int(pattern.uses[i])
            slots.append((size, begin[size], begin[size] + uses * pattern.copies, uses, base))
            begin[size] += uses * pattern.copies
        base += pattern.copies
    table = spark.createDataFrame(slots, "_class int, _from long, _to long, _uses long, _base long")
    placed = ranked.join(F.broadcast(table), "_class").filter("_rank >= _from AND _rank < _to")  # bounded by classes and patterns
    placed = placed.withColumn("sequence_id", (F.col("_base") + F.expr("(_rank - _from) DIV _uses")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank")
    return (placed.withColumn("offset", (F.sum("length").over(inside) - F.col("length")).cast("long"))
            .drop("_class", "_rank", "_from", "_to", "_uses", "_base"))


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(cut_lineage(token_pieces(docs, path, length)), length)
