"""Spelling variants: words one edit apart, grouped under the far more usual word.

1. Arrow slices give the words of the texts; a word whose checksum with its document's id is divisible by 31 loses one letter. Counts are
   added up per batch, then in Spark.
2. Every word has one byte a letter here (the letters are below U+0100), so words of one length form a matrix and the hash of any edit is a
   sum and a product away from the word's own. A word's neighbourhood is what one deletion or one replacement by a larger letter
   makes of it; insertions and other replacements are these, seen from the other word.
3. Bloom filters of the vocabulary, blocked by 64-bit words, are built per length (long words share one) and cut into parts of bounded size.
   As many as fit `FILTER_BYTES` are broadcast at once; a larger vocabulary takes further passes. Edits that no filter knows end there.
4. Only positives are written out and joined to the vocabulary by the word itself, which removes what a filter let through wrongly.
5. Near words are added up per word; forms are followed by pointer doubling (a form is ten times as usual, so chains are short).

Defined results: a null text has no words; a null doc_id counts as the empty string in the checksum; repeated rows count each; words need not be
found in more than one document; ties go to the smallest word in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .kernels import Slice, folded, gathered, mixed, power_tables, runs, slices
from .resources import settled

LEAST_LETTERS, LEAST_COUNT, FACTOR, DAMAGE = 7, 2, 10, 31
FILTER_BYTES, PART_WORDS, LONG, KEY_BITS = 48 << 20, 1 << 22, 40, 24
_CELLS = 1 << 20  # letters of a matrix that are worked on at once
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
_TWO_BITS = np.array([1 << (i & 63) | 1 << (i >> 6) for i in range(4096)], dtype=np.uint64)


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch, carried on from the checksums `before`; all stretches at once, byte by byte."""
    order = np.argsort(-lengths, kind="stable")
    at, rest = starts[order], lengths[order]
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    open_ = len(order)
    for step in range(int(rest[0]) if len(rest) else 0):
        open_ = int(np.searchsorted(-rest[:open_], -step, side="left"))  # those longer than `step`
        now = state[:open_]
        state[:open_] = _CRC[(now ^ data[at[:open_] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _words(piece: Slice, prefixes: list[bytes]) -> pa.Array:
    """Words of at least seven letters after the damage, in any order, repeated as they occur."""
    piece = folded(piece)
    data, n = piece.data, len(piece.data)
    follows = (data & 0xC0) == 0x80
    member = _LETTER[data] | (data == 0xC3)
    member[1:] |= follows[1:] & (data[:-1] == 0xC3)
    starts, ends, edges = runs(piece, member)
    letters = np.append(0, np.cumsum(~follows))
    sizes = letters[ends] - letters[starts]
    doc = np.repeat(np.arange(piece.texts), np.diff(edges))
    long = sizes >= LEAST_LETTERS
    starts, lengths, sizes, doc = starts[long], (ends - starts)[long], sizes[long], doc[long]
    known = np.array([zlib.crc32(p) for p in prefixes], dtype=np.uint32)
    sums = checksums(data, starts, lengths, known[doc])
    hit = sums % DAMAGE == 0
    whole = np.flatnonzero(~hit)
    at = np.append(0, np.cumsum(lengths[whole]))
    kept = pa.StringArray.from_buffers(len(whole), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(gathered(data, starts[whole], lengths[whole]).tobytes()))
    damaged = np.flatnonzero(hit & (sizes > LEAST_LETTERS))
    rest = []
    for a, size, cut in zip(starts[damaged], lengths[damaged], (sums[damaged] % sizes[damaged]).tolist()):
        word = data[a:a + size].tobytes().decode()
        rest.append(word[:cut] + word[cut + 1:])
    return pa.concat_arrays([kept, pa.array(rest, pa.string())])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that occur at least twice."""
    def run(batches):
        for batch in batches:
            ids = ["" if i is None else str(i) for i in batch.column(0).to_pylist()]
            found, held = [], 0
            for piece in slices(batch.column(1)):
                found.append(_words(piece, [f"{i}:".encode() for i in ids[piece.first:piece.first + piece.texts]]))
                held += len(found[-1])
                if held > 1 << 21:
                    yield _counted(found)
                    found, held = [], 0
            if held:
                yield _counted(found)

    def _counted(found: list[pa.Array]) -> pa.RecordBatch:
        counts = pa.chunked_array(found).value_counts()
        return pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts").cast(pa.int64())], names=["word", "n"])

    said = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return said.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def by_length(words: pa.Array):
    """Per length: which words, and the matrix of their letters, one byte each. Matrices of bounded size."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if len(words) else np.zeros(0, np.uint8)
    lead = raw == 0xC3
    letters = np.where((raw & 0xC0) == 0x80, raw | 0x40, raw)[~lead]
    at = (at - at[0]) - np.append(0, np.cumsum(lead))[at - at[0]]
    sizes = np.diff(at)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(sizes[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        size = int(sizes[order[a]])
        step = max(1, _CELLS // size)
        for first in range(a, b, step):
            mine = order[first:min(b, first + step)]
            yield size, mine, letters[at[mine][:, None] + np.arange(size)]


def hashes(matrix: np.ndarray) -> np.ndarray:
    """Sum of letters times powers, modulo 2**64: changes with one letter by one product."""
    up, _ = power_tables(matrix.shape[1] + 1)
    return (matrix.astype(np.uint64) * up[:matrix.shape[1]]).sum(axis=1, dtype=np.uint64)


def keys_of(sums: np.ndarray, size: int) -> np.ndarray:
    return mixed(sums + np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(parts)).astype(np.int64)


def block_and_bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit block of each key and its four bits there."""
    block = ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return block, _TWO_BITS[keys & np.uint64(4095)] | _TWO_BITS[(keys >> np.uint64(12)) & np.uint64(4095)]


def filters(vocab: DataFrame, parts: dict[int, int]) -> DataFrame:
    """(shard, part, bits, letters): the filter of each shard's part and the letters that occur in it."""
    def run(batches):
        for batch in batches:
            rows: dict[tuple[int, int], list] = {}
            for size, _, matrix in by_length(batch.column(0)):
                keys, shard = keys_of(hashes(matrix), size), min(size, LONG)
                part = part_of(keys, parts[shard])
                for p in np.unique(part):
                    seen = np.bincount(matrix[part == p].ravel(), minlength=256) > 0
                    rows.setdefault((shard, int(p)), []).append((keys[part == p].tobytes(), seen))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in rows], pa.int32()), pa.array([k[1] for k in rows], pa.int32()),
                     pa.array([b"".join(x[0] for x in v) for v in rows.values()], pa.binary()),
                     pa.array([np.packbits(np.any([x[1] for x in v], axis=0)).tobytes() for v in rows.values()], pa.binary())],
                    names=["shard", "part", "keys", "letters"])

    def build(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
        blocks = len(keys) * KEY_BITS // 64 + 1
        bits = np.zeros(blocks, dtype=np.uint64)
        np.bitwise_or.at(bits, *block_and_bits(keys, blocks))
        letters = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["letters"].to_pylist()], axis=0)
        return pa.table({"shard": table["shard"][:1], "part": table["part"][:1], "bits": pa.array([bits.tobytes()], pa.binary()),
                         "letters": pa.array([letters.tobytes()], pa.binary())})

    sent = vocab.select("word").mapInArrow(run, "shard int, part int, keys binary, letters binary")
    return sent.groupBy("shard", "part").applyInArrow(build, "shard int, part int, bits binary, letters binary")


def _passes(found: dict[tuple[int, int], int]) -> list[list[tuple[int, int]]]:
    """Filters in groups that may be broadcast together."""
    out, held = [], FILTER_BYTES + 1
    for key in sorted(found):
        if held + found[key] > FILTER_BYTES:
            out.append([])
            held = 0
        out[-1].append(key)
        held += found[key]
    return out


class _Known:
    """The filters of a pass."""

    def __init__(self, rows: list[tuple], parts: dict[int, int]):
        self.bits = {(s, p): np.frombuffer(bits, np.uint64) for s, p, bits, _ in rows}
        self.letters = {}
        for s, _, _, letters in rows:
            self.letters[s] = self.letters.get(s, np.zeros(256, bool)) | (np.unpackbits(np.frombuffer(letters, np.uint8)) > 0)
        self.parts = parts

    def positives(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Places of `sums` that a filter of this pass lets through."""
        shard = min(size, LONG)
        parts = self.parts[shard]
        keys = keys_of(sums, size)
        if parts == 1:
            return self._inside(keys, (shard, 0))
        part = part_of(keys, parts)
        out = [np.zeros(0, np.int64)]
        for p in range(parts):
            if (shard, p) in self.bits:
                mine = np.flatnonzero(part == p)
                out.append(mine[self._inside(keys[mine], (shard, p))])
        return np.concatenate(out)

    def _inside(self, keys: np.ndarray, name: tuple[int, int]) -> np.ndarray:
        bits = self.bits[name]
        block, wanted = block_and_bits(keys, len(bits))
        return np.flatnonzero(bits[block] & wanted == wanted)


def edits(size: int, matrix: np.ndarray, known: _Known):
    """(row of the matrix, letters of the edit) for deletions and replacements by a larger letter that a filter lets through."""
    n = len(matrix)
    up, down = power_tables(size + 1)
    wide = matrix.astype(np.uint64) * up[:size]
    total = wide.sum(axis=1, dtype=np.uint64)
    if size > LEAST_LETTERS and min(size - 1, LONG) in known.letters:
        upto = np.cumsum(wide, axis=1, dtype=np.uint64)
        sums = (upto - wide) + (total[:, None] - upto) * down[1]
        first = np.ones(matrix.shape, dtype=bool)  # of a run of equal letters
        first[:, 1:] = matrix[:, 1:] != matrix[:, :-1]
        row, at = np.nonzero(first)
        hit = known.positives(sums[row, at], size - 1)
        row, at = row[hit], at[hit]
        if len(row):
            keep = np.ones((len(row), size), dtype=bool)
            keep[np.arange(len(row)), at] = False
            yield row, matrix[row][keep].reshape(len(row), size - 1)
    if min(size, LONG) in known.letters:
        flat = matrix.ravel()
        order = np.argsort(flat, kind="stable")
        letter = flat[order]
        row, at = order // size, order % size
        power = up[at]
        rest = total[row] - wide.ravel()[order]
        for new in np.flatnonzero(known.letters[min(size, LONG)]).tolist():
            end = int(np.searchsorted(letter, new))  # places with a smaller letter
            if not end:
                continue
            hit = known.positives(rest[:end] + np.uint64(new) * power[:end], size)
            if len(hit):
                out = matrix[row[hit]]
                out[np.arange(len(hit)), at[hit]] = new
                yield row[hit], out


def _spelt(letters: np.ndarray) -> list[str]:
    size, text = letters.shape[1], letters.tobytes().decode("latin-1")
    return [text[i:i + size] for i in range(0, len(text), size)]


def _probed(vocab: DataFrame, known) -> DataFrame:
    """(word, n, edit) for the edits that a filter lets through."""
    def run(batches):
        table = _Known(*known.value)
        for batch in batches:
            words, counts = batch.column(0), batch.column(1)
            for size, mine, matrix in by_length(words):
                for row, letters in edits(size, matrix, table):
                    at = pa.array(mine[row])
                    yield pa.RecordBatch.from_arrays([words.take(at), counts.take(at), pa.array(_spelt(letters), pa.string())], names=["word", "n", "edit"])

    return vocab.select("word", "n").mapInArrow(run, "word string, n long, edit string")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of near words once. `vocab` is a written table."""
    spark = vocab.sparkSession
    lengths = {r["shard"]: r["n"] for r in vocab.groupBy(F.least(F.char_length("word"), F.lit(LONG)).alias("shard")).agg(F.count("*").alias("n")).collect()}
    parts = {shard: -(-n // PART_WORDS) for shard, n in lengths.items()}
    made = cut_lineage(filters(vocab, parts))
    sizes = {(r["shard"], r["part"]): r["size"] for r in made.select("shard", "part", F.octet_length("bits").alias("size")).collect()}
    other = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    out = []
    for group in _passes(sizes):
        rows = made.filter(F.struct("shard", "part").isin([F.struct(F.lit(s), F.lit(p)) for s, p in group])).collect()
        known = spark.sparkContext.broadcast(([tuple(r) for r in rows], parts))
        hits = _probed(vocab, known)
        out.append(settled(hits.join(other, hits["edit"] == other["near"]).select("word", "n", "near", "near_n")))
        known.unpersist()
    pairs = out[0] if out else spark.createDataFrame([], "word string, n long, near string, near_n long")
    for more in out[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _roots(links: DataFrame, max_steps: int = 64) -> DataFrame:
    """(word, root) of every word with a form, by pointer doubling."""
    now = cut_lineage(links.select("word", F.col("form").alias("root")))
    for _ in range(max_steps):
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = cut_lineage(now.join(ahead, F.col("root") == F.col("_at"), "left")
                            .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return now
        gc.collect()
    raise RuntimeError("forms did not settle")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least seven letters that occurs twice."""
    vocab = settled(vocabulary(docs))
    pairs = near_pairs(vocab)
    sides = F.array(F.struct("word", F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")).alias("to")),
                    F.struct(F.col("near").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")).alias("to")))
    both = pairs.select(F.explode(sides).alias("_s")).select("_s.word", "_s.to")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("to").alias("best"))
    enough = -F.col("best.less") >= FACTOR * F.col("n")
    rows = settled(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
