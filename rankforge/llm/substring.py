"""Substring dedup by fixed-block anchors.

Words are compared as they are. A reference block is `WIDTH / 2` words at a multiple of that in its document, so
every window of `WIDTH` words holds a whole block. The steps:

1. Every document's blocks are indexed and every rolling run of a block's length probes the index: block and
   probe hashes meet in hash buckets, packed as arrays. A hash is a hit if a block has it and it occurs twice.
2. Hits go back to their documents and are extended: each window around a hit is hashed whole, and windows
   meet in buckets again. The first occurrence of a window, by (doc_id, start), stays; all others mark
   their words. Adjacent marked windows join up to the maximal exact repeats.
3. Marked words are removed.

Neighbouring doc_ids (`SPAN` of them) travel as one chunk, and a hash is sent once per chunk however often the
chunk holds it; so a frequent line or a large group of copies costs one entry per chunk, and no pairs are ever formed. Blocks
are compared by 46 bits of a hash (a false hit only causes one more window to be looked at), windows by 64 bits.

Defined results: a null text has no words; texts under `WIDTH` words lose nothing; repeated rows and different rows of one doc_id are
ordered by text, equal ones one after another; a null doc_id comes before all others; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .kernels import slices, window_hashes, windows_inside, word_hashes, words
from .resources import settled

WIDTH, SPAN, BUCKETS = 20, 128, 256
_FIRST_ID = -(1 << 63)
_CHUNK = f"CAST(floor(coalesce(_id, {_FIRST_ID}) / {SPAN}) AS LONG)"


def by_bucket(bucket: np.ndarray, buckets: int):
    """Order that groups entries by bucket, and the edges of the buckets."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _keys(hashes: np.ndarray) -> np.ndarray:
    """The 46 bits blocks are compared by."""
    return hashes >> np.uint64(18)


def _distinct(chunk: np.ndarray, key: np.ndarray, flag: np.ndarray):
    """One entry per (chunk, key): chunk, key, any flag, and whether there are several."""
    order = np.lexsort((key, chunk))
    chunk, key, flag = chunk[order], key[order], flag[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])
    at = np.flatnonzero(new)
    if len(at) == 0:
        return chunk, key, flag, flag
    return chunk[at], key[at], np.logical_or.reduceat(flag, at), np.diff(np.append(at, len(key))) > 1


_PACKED = "bucket int, chunks binary, counts binary, keys binary, flags binary"


def _packed_rows(chunk, key, flags, bits: int) -> pa.RecordBatch:
    """A row per bucket (the leading bits of the `bits`-bit keys); entries in it ordered by chunk."""
    bucket = (key >> np.uint64(bits - 8)).astype(np.int64)
    order, edges = by_bucket(bucket, BUCKETS)
    chunk, key, flags = chunk[order], key[order], flags[order]
    rows = []
    for b in range(BUCKETS):
        lo, hi = int(edges[b]), int(edges[b + 1])
        if lo < hi:
            own = chunk[lo:hi]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            counts = np.diff(np.append(first, hi - lo)).astype(np.uint32)
            low = key[lo:hi]
            if bits == 46:  # 32 bits apart, 6 more beside the two flags
                keys, more = low.astype(np.uint32), ((low >> np.uint64(32)) & np.uint64(63)).astype(np.uint8) << 2 | flags[lo:hi]
            else:
                keys, more = low, flags[lo:hi]
            rows.append((b, own[first].tobytes(), counts.tobytes(), keys.tobytes(), more.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                       *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)]],
                                      names=["bucket", "chunks", "counts", "keys", "flags"])


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype=kind)


def _unpacked(table: pa.Table, bits: int):
    chunk = np.repeat(_joined(table, "chunks", np.int64), _joined(table, "counts", np.uint32))
    more = _joined(table, "flags", np.uint8)
    if bits == 46:
        bucket = np.uint64(table.column("bucket")[0].as_py())
        low = _joined(table, "keys", np.uint32).astype(np.uint64)
        return chunk, low | (more >> 2).astype(np.uint64) << np.uint64(32) | bucket << np.uint64(38), more & 3
    return chunk, _joined(table, "keys", np.uint64), more


def _sent_back(chunk: np.ndarray, key: np.ndarray, flags: np.ndarray) -> pa.Table:
    """A row per chunk."""
    order = np.argsort(chunk, kind="stable")
    chunk, key, flags = chunk[order], key[order], flags[order]
    first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(chunk))
    return pa.table({"chunk": pa.array(chunk[first], pa.int64()),
                     "keys": pa.array([key[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                     "flags": pa.array([flags[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())})


_BACK = "chunk long, keys binary, flags binary"


def _probes(docs: DataFrame, width: int) -> DataFrame:
    """Blocks and probes of all documents, a hash once per chunk and slice; flag 1: a block has it, flag 2: several."""
    half = width // 2

    def run(batches):
        for batch in batches:
            chunks = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in slices(batch.column(1)):
                starts, ends, edges = words(piece)
                hashes = window_hashes(word_hashes(piece, starts, ends), half)
                at = np.flatnonzero(windows_inside(edges, half, len(starts)) & _long_enough(edges, width, len(hashes)))
                if len(at) == 0:
                    continue
                owner = np.searchsorted(edges, at, side="right") - 1
                block = (at - edges[owner]) % half == 0
                chunk, key, block, several = _distinct(chunks[piece.first + owner], _keys(hashes[at]), block)
                yield _packed_rows(chunk, key, block.astype(np.uint8) | several.astype(np.uint8) << 1, 46)

    return docs.selectExpr(f"{_CHUNK} AS chunk", "_text").mapInArrow(run, _PACKED)


def _long_enough(edges: np.ndarray, width: int, n: int) -> np.ndarray:
    return np.repeat(np.diff(edges) >= width, np.diff(edges))[:n]


def _hits(probes: DataFrame) -> DataFrame:
    def meet(table: pa.Table) -> pa.Table:
        chunk, key, flags = _unpacked(table, 46)
        order = np.argsort(key, kind="stable")
        chunk, key, flags = chunk[order], key[order], flags[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        any_flag = np.bitwise_or.reduceat(flags, first)
        hit = np.repeat(((any_flag & 1) > 0) & ((size > 1) | ((any_flag & 2) > 0)), size)
        return _sent_back(chunk[hit], key[hit], flags[hit])

    return probes.groupBy("bucket").applyInArrow(meet, _BACK)


def _texts(table: pa.Table):
    """Rows of a chunk in order of (doc_id, text): ids, texts and the order itself."""
    ids = table.column("_id").to_pylist()
    texts = [t or "" for t in table.column("_text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], order


def _windows(docs: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """Hashes of the windows around hits, once per chunk; flag 2: the chunk has several."""
    half = width // 2

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.sort(_joined(right, "keys", np.uint64))
        out = []
        if left.num_rows and len(found):
            chunk = left.column("chunk")[0].as_py()
            keys = []
            for piece in slices(pa.array(_texts(left)[1], pa.string())):
                starts, ends, edges = words(piece)
                single = word_hashes(piece, starts, ends)
                short = _keys(window_hashes(single, half))
                place = np.minimum(np.searchsorted(found, short), len(found) - 1)
                near = np.concatenate(([0], np.cumsum(found[place] == short)))
                whole = window_hashes(single, width)
                at = np.flatnonzero(windows_inside(edges, width, len(single)))
                keys.append(whole[at[near[at + width - half + 1] > near[at]]])
            key, times = np.unique(np.concatenate(keys), return_counts=True)
            if len(key):
                out.append(_packed_rows(np.full(len(key), chunk, np.int64), key, (times > 1).astype(np.uint8) << 1, 64))
        if not out:
            return pa.table({"bucket": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("chunks", "counts", "keys", "flags")}})
        return pa.Table.from_batches(out)

    return docs.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, _PACKED)


def _repeats(windows: DataFrame) -> DataFrame:
    """Windows that a chunk has to remove; flag 1: its first occurrence stays, as it is the first of all."""
    def meet(table: pa.Table) -> pa.Table:
        chunk, key, flags = _unpacked(table, 64)
        order = np.lexsort((chunk, key))
        chunk, key, flags = chunk[order], key[order], flags[order]
        first = np.append(True, key[1:] != key[:-1])
        kept = ~first | ((flags & 2) > 0)
        return _sent_back(chunk[kept], key[kept], first[kept].astype(np.uint8))

    return windows.groupBy("bucket").applyInArrow(meet, _BACK)


def marked(piece, found: np.ndarray, stays: np.ndarray, width: int, seen: set):
    """Which words of a slice are removed. `seen`: staying windows met earlier in the chunk."""
    starts, ends, edges = words(piece)
    removed = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(found):
        whole = window_hashes(word_hashes(piece, starts, ends), width)
        at = np.flatnonzero(windows_inside(edges, width, len(starts)))
        place = np.minimum(np.searchsorted(found, whole[at]), len(found) - 1)
        hit = found[place] == whole[at]
        at, place = at[hit], place[hit]
        staying = np.flatnonzero(stays[place])
        keep = []
        for j in staying.tolist():  # the first occurrence of each is left alone
            if place[j] not in seen:
                seen.add(place[j])
                keep.append(j)
        at = np.delete(at, keep)
        np.add.at(removed, at, 1)
        np.add.at(removed, np.minimum(at + width, len(starts)), -1)
    return starts, ends, edges, np.cumsum(removed)[:len(starts)] > 0


def _cleaned(docs: DataFrame, repeats: DataFrame, width: int, digests: bool, carry: list[str]) -> DataFrame:
    last = "kept_sha256 string" if digests else "kept_text string, removed array<struct<start:long,length:long>>"
    made = T.StructType([*T.StructType.fromDDL(f"_id long, n_words long, n_removed long, {last}").fields, *[docs.schema[c] for c in carry]])

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        found, stays = _joined(right, "keys", np.uint64), _joined(right, "flags", np.uint8)
        order = np.argsort(found)
        found, stays, seen = found[order], stays[order], set()
        ids, texts, placed = _texts(left) if left.num_rows else ([], [], [])
        counts, gone, kept, spans = [], [], [], []
        for piece in slices(pa.array(texts, pa.string())):
            starts, ends, edges, removed = marked(piece, found, stays, width, seen)
            raw = piece.data.tobytes()
            for i in range(piece.texts):
                a, b = int(edges[i]), int(edges[i + 1])
                mine = removed[a:b]
                n = int(mine.sum())
                if n == 0:
                    left_over = b" ".join(raw[piece.bounds[i]:piece.bounds[i + 1]].split())
                else:
                    left_over = b" ".join([raw[s:e] for s, e, r in zip(starts[a:b].tolist(), ends[a:b].tolist(), mine.tolist()) if not r])
                counts.append(b - a)
                gone.append(n)
                if digests:
                    kept.append(hashlib.sha256(left_over).hexdigest())
                else:
                    kept.append(texts[piece.first + i] if n == 0 else left_over.decode())
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0]))))
                    spans.append([{"start": s, "length": e - s} for s, e in zip(turn[::2].tolist(), turn[1::2].tolist())])
        out = {"_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
        others = {c: left.column(c).take(pa.array(placed, pa.int64())) for c in carry}
        if digests:
            return pa.table(out | {"kept_sha256": pa.array(kept, pa.string())} | others)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.table(out | {"kept_text": pa.array(kept, pa.string()), "removed": pa.array(spans, kind)} | others)

    return docs.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(clean, made)


def remove_repeats(docs: DataFrame, width: int = WIDTH, digests: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and kept_text with the removed spans (in words), or the digest of the kept words.

    kept_text is the text itself where nothing is removed, else the kept words joined by blanks. `carry`: other columns
    to keep, as they are.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *(carry or []))
    hits = settled(_hits(_probes(source, width)))
    chunked = source.withColumn("chunk", F.expr(_CHUNK))
    out = _cleaned(chunked, _repeats(_windows(chunked, hits, width)), width, digests, carry or [])
    return out.withColumnRenamed("_id", "doc_id")
