"""Divergence of sources: how far the term shares of the sources of a language are from each other and from the language.

1. A slice of texts is an Arrow buffer. A pointer is kept to every word start, and the pointers are sorted by what they point to:
   a multikey quicksort that takes eight bytes at a time, where only runs of equal keys go on to the next eight bytes. An equal run is
   a term; the documents and groups of its pointers give its counts. Terms go to hash buckets ("shards"), their bytes packed as one buffer.
2. A bucket sorts pointers into the buffers it got in the same way; its equal runs give document frequency per language, and the counts
   per source of the terms that enough documents hold. Rarer terms go no further.
3. Shares are whole numbers (billionths of smoothed counts) made with exact integer or decimal division. Differences of all pairs of
   sources are summed in blocks: (language, chunk of terms, two blocks of sources) is one group.

Terms are runs of letters A-Z, a-z and of all characters outside ASCII, with A-Z in lower case.

Defined results: null text, lang and source are empty strings; a group without terms has its smoothed shares, and all shares are equal in a
language without kept terms (value 0); repeated rows are documents of their own; ids play no part; a language of one source has no pairs;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .kernels import Slice, folded, gathered, runs, slices, word_hashes
from .resources import beside, buckets_for, settled

MIN_DOCS, SMOOTHING, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50
SLICE, CHUNK_TERMS, BLOCK_SOURCES = 2 << 20, 4096, 128
_NARROW = 9_000_000_000  # counts below this times UNIT are 64-bit numbers
_MEMBER = np.zeros(256, dtype=bool)
_MEMBER[65:91] = _MEMBER[97:123] = _MEMBER[128:] = True
_LEADING = np.array([0] + [(~0 << (64 - 8 * k)) & (1 << 64) - 1 for k in range(1, 9)], dtype=np.uint64)
_PACKED = "bucket int, langs array<string>, sources array<string>, letters binary, lengths binary, entries binary, groups binary, counts binary, docs binary"
_KEPT = "lang string, term string, sources array<string>, counts array<long>, n long"


def pointer_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their bytes, and per place in that order whether a new run of equal words begins.

    No word holds a zero byte, so the zeros after a word's end sort a word before its longer ones.
    """
    n = len(starts)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype=">u8", buffer=padded, strides=(1,))

    def keys(pointers: np.ndarray, depth: int) -> np.ndarray:
        rest = np.clip(lengths[pointers] - depth, 0, 8)
        at = np.where(rest > 0, starts[pointers] + depth, 0)
        return eight[at].astype(np.uint64) & _LEADING[rest]

    first = keys(np.arange(n), 0)
    order = np.argsort(first)
    new = np.ones(n, dtype=bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    places, depth = np.arange(n), 8  # places whose runs may still fall apart
    while len(places):
        begins = np.flatnonzero(new[places])
        sizes = np.diff(np.append(begins, len(places)))
        longer = np.logical_or.reduceat(lengths[order[places]] > depth, begins)
        open_ = (sizes > 1) & longer
        if not open_.any():
            break
        run = np.repeat(np.arange(len(begins)), sizes)
        chosen = open_[run]
        places, run = places[chosen], run[chosen]
        key = keys(order[places], depth)
        sorted_ = np.lexsort((key, run))
        order[places] = order[places][sorted_]
        key = key[sorted_]
        new[places[1:]] |= (run[1:] == run[:-1]) & (key[1:] != key[:-1])
        depth += 8
    return order, new


def _slice_terms(piece: Slice, group: np.ndarray):
    """Terms of a slice: (representative start, length, hash) each, and entries (term, group, count, docs) by term."""
    piece = folded(piece)
    starts, ends, edges = runs(piece, _MEMBER[piece.data])
    if not len(starts):
        return None
    order, new = pointer_sort(piece.data, starts, ends - starts)
    term = np.empty(len(starts), dtype=np.int64)
    term[order] = np.cumsum(new) - 1
    head = order[new]
    ranked = np.argsort(group, kind="stable")  # documents of one group lie side by side
    rank = np.empty(piece.texts, dtype=np.int64)
    rank[ranked] = np.arange(piece.texts)
    pairs = np.sort(term * piece.texts + np.repeat(rank, np.diff(edges)))
    own = np.ones(len(pairs), dtype=bool)
    own[1:] = pairs[1:] != pairs[:-1]
    at, which = pairs // piece.texts, group[ranked[pairs % piece.texts]]
    begins = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (which[1:] != which[:-1])))
    return (piece.data, starts[head], ends[head] - starts[head], word_hashes(piece, starts[head], ends[head]),
            at[begins], which[begins], np.diff(np.append(begins, len(pairs))), np.add.reduceat(own.astype(np.int64), begins))


def _sent_terms(docs: DataFrame, buckets: int) -> DataFrame:
    """A row per (slice, bucket): the terms' bytes and, by term, the groups that hold it with counts and documents."""
    def run(batches):
        for batch in batches:
            text, lang, source = (batch.column(i).fill_null("") for i in range(3))
            lang, source = lang.dictionary_encode(), source.dictionary_encode()
            a, b = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lang, source))
            pair, group = np.unique(a * max(1, len(source.dictionary)) + b, return_inverse=True)
            lang_of, source_of = pair // max(1, len(source.dictionary)), pair % max(1, len(source.dictionary))
            for piece in slices(text, SLICE):
                found = _slice_terms(piece, group[piece.first:piece.first + piece.texts])
                if found is None:
                    continue
                data, starts, lengths, hashes, term, which, counts, held = found
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1]))
                entries = np.bincount(term, minlength=len(starts))
                first = np.cumsum(entries) - entries
                rows = []
                for i, j in zip(cuts, np.append(cuts[1:], len(by))):
                    mine = by[i:j]
                    at = np.repeat(first[mine] - (np.cumsum(entries[mine]) - entries[mine]), entries[mine]) + np.arange(int(entries[mine].sum()))
                    used, local = np.unique(which[at], return_inverse=True)
                    rows.append((int(bucket[mine[0]]), lang.dictionary.take(pa.array(lang_of[used])).to_pylist(),
                                 source.dictionary.take(pa.array(source_of[used])).to_pylist(),
                                 gathered(data, starts[mine], lengths[mine]).tobytes(),
                                 *[x.astype(np.uint32).tobytes() for x in (lengths[mine], entries[mine], local, counts[at], held[at])]))
                names = [c.split()[0] for c in _PACKED.split(", ")]
                kinds = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.mapInArrow(run, _PACKED)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).astype(np.int64)


def _kept_terms(sent: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, sources, counts, n) of the terms that at least `min_docs` documents of the language hold."""
    def meet(table: pa.Table) -> pa.Table:
        letters = np.frombuffer(b"".join(table["letters"].to_pylist()), np.uint8)
        lengths, entries = _numbers(table["lengths"]), _numbers(table["entries"])
        starts = np.cumsum(lengths) - lengths
        order, new = pointer_sort(letters, starts, lengths)
        run = np.empty(len(starts), dtype=np.int64)
        run[order] = np.cumsum(new) - 1
        head = order[new]
        # group numbers of a row become numbers of the whole bucket
        langs = pc.list_flatten(table["langs"]).combine_chunks().dictionary_encode()
        sources = pc.list_flatten(table["sources"]).combine_chunks().dictionary_encode()
        lang_at, source_at = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
        per_row = pc.list_value_length(table["langs"]).to_numpy()
        offset = np.cumsum(per_row) - per_row
        sizes = np.array([len(x) // 4 for x in table["groups"].to_pylist()], dtype=np.int64)
        group = _numbers(table["groups"]) + np.repeat(offset, sizes)
        term, lang, source = np.repeat(run, entries), lang_at[group], source_at[group]
        by = np.lexsort((source, lang, term))
        term, lang, source = term[by], lang[by], source[by]
        counts, held = _numbers(table["counts"])[by], _numbers(table["docs"])[by]
        split = np.append(True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]))
        begins = np.flatnonzero(split)
        kept = np.add.reduceat(held, begins) >= min_docs
        chosen = kept[np.cumsum(split) - 1]
        term, lang, source, counts = term[chosen], lang[chosen], source[chosen], counts[chosen]
        if not len(term):
            return pa.table({c: pa.array([], k) for c, k in zip(("lang", "term", "sources", "counts", "n"), (
                pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64()))})
        new_term = np.append(True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]))
        cell = np.flatnonzero(new_term | np.append(True, source[1:] != source[:-1]))
        counts = np.add.reduceat(counts, cell)
        source, first = source[cell], np.flatnonzero(new_term[cell])
        offsets = pa.array(np.append(first, len(cell)), pa.int32())
        heads = cell[first]
        named = gathered(letters, starts[head[term[heads]]], lengths[head[term[heads]]]).tobytes()
        ends = np.append(0, np.cumsum(lengths[head[term[heads]]]))
        words = pa.StringArray.from_buffers(len(heads), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(named))
        return pa.table({"lang": langs.dictionary.take(pa.array(lang[heads])), "term": words,
                         "sources": pa.ListArray.from_arrays(offsets, sources.dictionary.take(pa.array(source))),
                         "counts": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                         "n": pa.array(np.add.reduceat(counts, first), pa.int64())})

    return sent.groupBy("bucket").applyInArrow(meet, _KEPT)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 5) / (total + 5 * terms)), exact for any counts; null without terms."""
    whole = F.nullif(total + F.lit(SMOOTHING) * terms, F.lit(0).cast("long"))
    narrow = F.lit(UNIT) * (F.least(count, F.lit(_NARROW)) + SMOOTHING)
    wide = F.lit(UNIT).cast("decimal(20,0)") * (count + SMOOTHING).cast("decimal(18,0)")
    exact = F.when(count < _NARROW, F.call_function("div", narrow, whole)).otherwise(F.call_function("div", wide, whole.cast("decimal(38,0)")))
    return F.when(terms > 0, exact + 1)


def _pair_sums(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, a, b, delta), a < b: per pair of sources, what the terms that either holds add to V * |base a - base b|.

    `cells` (lang, chunk, term_id, place, p); `sources` (lang, place, base, chunks, blocks). Every source sends its base
    to every chunk, since a pair's difference also counts where only one of them has the term.
    """
    told = sources.select("lang", "blocks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(-1).cast("long").alias("term_id"),
                          "place", F.col("base").alias("p"))
    both = cells.unionByName(told).withColumn("_block", F.floor(F.col("place") / BLOCK_SOURCES).cast("int"))
    both = both.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = both.select("lang", "chunk", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "term_id", "place", "p")

    def differ(table: pa.Table) -> pa.Table:
        term, place, p = (table[c].to_numpy() for c in ("term_id", "place", "p"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        places, row = np.unique(place, return_inverse=True)
        is_base = term < 0
        base = np.zeros(len(places), dtype=np.int64)
        base[row[is_base]] = p[is_base]
        terms, column = np.unique(term[~is_base], return_inverse=True)
        shares = np.repeat(base[:, None], len(terms), axis=1)
        shares[row[~is_base], column] = p[~is_base]
        block = places // BLOCK_SOURCES
        right = np.flatnonzero(block == j)
        out = []
        for a in np.flatnonzero(block == i):
            later = right[right > a]
            out.append((np.full(len(later), places[a]), places[later],
                        np.abs(shares[later] - shares[a]).sum(axis=1) - len(terms) * np.abs(base[later] - base[a])))
        a, b, delta = (np.concatenate([x[k] for x in out]) for k in range(3))
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()),
                         "delta": pa.array(delta, pa.int64())})

    parts = both.groupBy("lang", "chunk", "i", "j").applyInArrow(differ, "lang string, a int, b int, delta long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("delta").alias("delta"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by summed difference ("pair"), over-represented terms ("term")."""
    texts = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    kept = settled(_kept_terms(_sent_terms(texts, buckets_for(texts)), min_docs)).withColumn("term_id", F.monotonically_increasing_id())
    cells = kept.select("lang", "term", "term_id", "n", F.explode(F.arrays_zip("sources", "counts")).alias("_c")).select(
        "lang", "term", "term_id", "n", F.col("_c.sources").alias("source"), F.col("_c.counts").alias("count"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    zero = F.lit(0).cast("long")
    groups = (texts.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")]))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = settled(groups.select(
        "*", (F.row_number().over(by_source) - 1).alias("place"), _share(zero, F.col("total"), F.col("terms")).alias("base"),
        F.ceil(F.col("terms") / CHUNK_TERMS).cast("int").alias("chunks"),
        F.ceil(F.count("*").over(Window.partitionBy("lang")) / BLOCK_SOURCES).cast("int").alias("blocks")))
    placed = cells.join(beside(groups, 200), ["lang", "source"]).select(
        "lang", "source", "term", "term_id", "place", "blocks", F.pmod(F.xxhash64("term_id"), F.col("chunks")).cast("int").alias("chunk"),
        _share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("n"), F.col("lang_total"), F.col("terms")).alias("q"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = placed.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    sums = _pair_sums(placed.select("lang", "blocks", "chunk", "term_id", "place", "p"), groups.filter("terms > 0").select("lang", "place", "base", "chunks", "blocks"))
    left, right = (groups.select("lang", F.col("source").alias(s), F.col("place").alias(k), F.col("base").alias(f"_base_{k}"), *more)
                   for s, k, more in (("source", "a", ["terms"]), ("item", "b", [])))
    pairs = left.join(right, "lang").filter("a <> b")  # every pair is asked for
    pairs = pairs.withColumn("_low", F.least("a", "b")).withColumn("_high", F.greatest("a", "b"))
    sums = sums.select("lang", F.col("a").alias("_low"), F.col("b").alias("_high"), "delta")
    value = F.coalesce(F.col("terms") * F.abs(F.col("_base_a") - F.col("_base_b")), zero) + F.coalesce("delta", zero)
    pairs = pairs.join(sums, ["lang", "_low", "_high"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(over)
