"""N-gram Jaccard join with several global token orders.

A document is the set of its distinct shingles (five words, A-Z folded; fewer words: the whole sequence).
Two link when 100 * |intersection| >= 75 * |union|. Under any one order of all tokens, two such sets share a token among
the first n - ceil(0.75 n) + 1 of each, and that holds for every order at once. The orders put rare tokens first (by the power of two of
their document count) and break ties by different hashes.

1. One pass over the texts sends token hashes to hash buckets, packed as arrays; a bucket finds tokens that two or more
   documents hold, and sends those back with their counts. Tokens held once come first in every order, so a
   document with enough of them shares no prefix token with any other and drops out.
2. Equal sets are one class from here on.
3. Prefix tokens of the first order tie documents together (each to the smallest of the token, so as many ties as tokens); the
   components of these ties are clusters: no pair outside a cluster can link.
4. A cluster is cut into blocks of bounded size, and each pair of blocks is one group. In it, pairs must share prefix tokens under
   the first order and the second and the third, and what is left is verified by counting whole intersections. No
   pairs are sent: a group returns for each document its smallest linked document and the number of its links.
5. Components of the links are the result.

Tokens are compared by 48 to 64 bits of their hash, more for larger tables, in the counts as in the verification.

Defined results: a document without words or text is linked with nothing and is its own component; every row is a document of its own,
also when ids or whole rows repeat (the component is told by the smallest doc_id); a null doc_id is larger than all others;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .kernels import folded, mixed, slices, window_hashes, windows_inside, word_hashes, words
from .resources import beside, buckets_for, settled
from .substring import by_bucket

WORDS, PERCENT, ORDERS = 5, 75, 3
BLOCK_DOCS, BLOCK_TOKENS = 1024, 1 << 20
_ROW_BITS = 33
_DENSE = 64  # tokens of more documents than this in a block are counted by a matrix product
_HEAD = np.dtype([("id", np.int64), ("known", np.int64), ("n", np.int64), ("text", np.int64), ("digest", "V16")])
_SENT = "bucket int, slice long, keys binary, owners binary, heads binary"


def shingle_sets(piece, width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit token hashes of each text of a slice."""
    piece = folded(piece)
    starts, ends, edges = words(piece)
    single = word_hashes(piece, starts, ends)
    whole = window_hashes(single, width)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a:b - width + 1]))
        elif b > a:  # a sequence of its own kind: its length is part of the hash
            x = np.array([b - a], dtype=np.uint64)
            for h in single[a:b]:
                x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h)
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def text_key(text: str) -> Column:
    """With the doc_id it tells a row from all rows of other texts."""
    return F.xxhash64(text)


def _sent_tokens(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Per slice of texts: a row per bucket with (token, owner), and one row (heads) about its documents.

    A bucket is the leading `bits` of a token, and 40 more are sent.

    A document's node is its Spark partition and its place in it: a scan that is run again gives the same.
    """
    def run(batches):
        node = TaskContext.get().partitionId() << _ROW_BITS
        for batch in batches:
            ids = batch.column(0)
            for piece in slices(batch.column(1)):
                sets = shingle_sets(piece, width)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                heads = np.zeros(len(sets), dtype=_HEAD)
                mine = ids.slice(piece.first, piece.texts)
                heads["id"], heads["known"] = mine.fill_null(0).to_numpy(zero_copy_only=False), mine.is_valid().to_numpy(zero_copy_only=False)
                heads["n"], heads["text"] = sizes, batch.column(2).slice(piece.first, piece.texts).to_numpy(zero_copy_only=False)
                heads["digest"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                tokens = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets)), sizes).astype(np.uint16)
                order, edges = by_bucket((tokens >> np.uint64(64 - bits)).astype(np.int64), 1 << bits)
                tokens, owner = tokens[order], owner[order]
                low, more = (tokens >> np.uint64(32 - bits)).astype(np.uint32), ((tokens >> np.uint64(24 - bits)) & np.uint64(255)).astype(np.uint8)
                used = np.flatnonzero(np.diff(edges))
                cut = [(edges[b], edges[b + 1]) for b in used]
                columns = [[*used.tolist(), int(node % (1 << bits))],
                           [low[a:b].tobytes() + more[a:b].tobytes() for a, b in cut] + [None],
                           [owner[a:b].tobytes() for a, b in cut] + [None], [None] * len(cut) + [heads.tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array([node] * len(columns[0]), pa.int64()),
                     *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["bucket", "slice", "keys", "owners", "heads"])
                node += piece.texts

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key("text")).mapInArrow(run, _SENT)


def _shared_tokens(sent: DataFrame) -> DataFrame:
    """Rows per slice: tokens that two or more documents hold, with owner and power of two of the count."""
    def meet(table: pa.Table) -> pa.Table:
        heads = table.filter(table.column("heads").is_valid())
        rest = table.filter(table.column("heads").is_null())
        slice_of = rest.column("slice").to_numpy()
        raw, owners = rest.column("keys").to_pylist(), rest.column("owners").to_pylist()
        counts = np.array([len(o) // 2 for o in owners], dtype=np.int64)
        low = np.frombuffer(b"".join([k[:4 * n] for k, n in zip(raw, counts.tolist())]), np.uint32).astype(np.uint64)
        more = np.frombuffer(b"".join([k[4 * n:] for k, n in zip(raw, counts.tolist())]), np.uint8)
        bucket = np.uint64(table.column("bucket")[0].as_py())
        # the leading bits of the token: those of the bucket, 32, and 8 more
        key = bucket << np.uint64(40) | low << np.uint64(8) | more
        owner, at = np.frombuffer(b"".join(owners), np.uint16), np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        power = np.empty(len(key), dtype=np.uint8)
        power[order] = np.repeat(np.floor(np.log2(np.maximum(size, 1))).astype(np.uint8), size)
        kept = np.flatnonzero(power > 0)  # in the order they came, so by row
        edges = np.searchsorted(at[kept], np.arange(len(counts) + 1))
        parts = [(s, kept[a:b]) for s, a, b in zip(slice_of.tolist(), edges[:-1], edges[1:]) if b > a]
        return pa.table({
            "slice": pa.array([p[0] for p in parts] + heads.column("slice").to_pylist(), pa.int64()),
            "keys": pa.array([key[p[1]].tobytes() for p in parts] + [None] * heads.num_rows, pa.binary()),
            "owners": pa.array([owner[p[1]].tobytes() for p in parts] + [None] * heads.num_rows, pa.binary()),
            "powers": pa.array([power[p[1]].tobytes() for p in parts] + [None] * heads.num_rows, pa.binary()),
            "heads": pa.array([None] * len(parts) + heads.column("heads").to_pylist(), pa.binary())})

    return sent.groupBy("bucket").applyInArrow(meet, "slice long, keys binary, owners binary, powers binary, heads binary")


def prefix_size(n: np.ndarray | int, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def _documents(shared: DataFrame, percent: int) -> DataFrame:
    """A row per document: node, doc_id, n, text_key, digest, and its shared tokens with powers if it may link at all."""
    def gather(table: pa.Table) -> pa.Table:
        rows = table.filter(table.column("heads").is_null())
        heads = np.frombuffer(b"".join(table.column("heads").drop_null().to_pylist()), dtype=_HEAD)
        key = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint64)
        owner = np.frombuffer(b"".join(rows.column("owners").to_pylist()), np.uint16)
        power = np.frombuffer(b"".join(rows.column("powers").to_pylist()), np.uint8)
        order = np.argsort(owner, kind="stable")
        key, power = key[order], power[order]
        edges = np.searchsorted(owner[order], np.arange(len(heads) + 1))
        n, known = heads["n"], np.diff(edges)
        may = (known > 0) & (n - known < prefix_size(n, percent))
        first = table.column("slice")[0].as_py()
        return pa.table({
            "node": pa.array(first + np.arange(len(heads)), pa.int64()),
            "doc_id": pa.array(heads["id"], pa.int64(), mask=heads["known"] == 0), "n": pa.array(n, pa.int64()),
            "text_key": pa.array(heads["text"], pa.int64()), "digest": pa.array([d.tobytes() for d in heads["digest"]], pa.binary()),
            "keys": pa.array([key[a:b].tobytes() if m else None for m, a, b in zip(may, edges[:-1], edges[1:])], pa.binary()),
            "powers": pa.array([power[a:b].tobytes() if m else None for m, a, b in zip(may, edges[:-1], edges[1:])], pa.binary())})

    return shared.groupBy("slice").applyInArrow(
        gather, "node long, doc_id long, n long, text_key long, digest binary, keys binary, powers binary")


def prefixes(key: np.ndarray, power: np.ndarray, n: int, order: int, percent: int = PERCENT) -> np.ndarray:
    """Shared tokens in the prefix under one global order. Tokens held once, which come first, take up places."""
    tie = mixed(key + np.uint64(order * 0x9E3779B97F4A7C15 % (1 << 64)))
    ranked = np.lexsort((tie, power))
    return key[ranked[:int(prefix_size(n, percent)) - (n - len(key))]]


def _ties(records: DataFrame, percent: int) -> DataFrame:
    """(a, b): each document with a prefix token of the first order and the token's smallest document."""
    def run(batches):
        for batch in batches:
            nodes, tokens = [], []
            for node, n, key, power in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                mine = prefixes(np.frombuffer(key, np.uint64), np.frombuffer(power, np.uint8), n, 0, percent)
                nodes.append(np.full(len(mine), node))
                tokens.append(mine.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens), pa.int64()), pa.array(np.concatenate(nodes), pa.int64())],
                                             names=["token", "node"])

    posted = records.select("node", "n", "keys", "powers").mapInArrow(run, "token long, node long")
    least = posted.groupBy("token").agg(F.min("node").alias("a"), F.count("*").alias("_n")).filter("_n > 1")
    return posted.join(least, "token").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def shared_counts(left: tuple, right: tuple, rows: int, columns: int) -> np.ndarray:
    """Number of common tokens of every left and right document; sides are (tokens, documents)."""
    out = np.zeros((rows, columns), dtype=np.float32)
    common = np.intersect1d(left[0], right[0])
    if len(common) == 0:
        return out

    def placed(side):
        at = np.minimum(np.searchsorted(common, side[0]), len(common) - 1)
        hit = common[at] == side[0]
        at, doc = at[hit], side[1][hit]
        order = np.argsort(at, kind="stable")
        at, doc = at[order], doc[order]
        return at, doc, np.searchsorted(at, np.arange(len(common) + 1))

    (lt, ld, le), (rt, rd, re_) = placed(left), placed(right)
    size_l, size_r = np.diff(le), np.diff(re_)
    dense = np.flatnonzero(size_l * size_r > _DENSE * _DENSE)
    step = max(1, (1 << 22) // max(rows, columns))
    number = np.full(len(common), -1)
    for at in range(0, len(dense), step):
        part = dense[at:at + step]
        number[:] = -1
        number[part] = np.arange(len(part))
        a, b = np.zeros((rows, len(part)), np.float32), np.zeros((columns, len(part)), np.float32)
        for matrix, t, d in ((a, lt, ld), (b, rt, rd)):
            used = number[t] >= 0
            matrix[d[used], number[t[used]]] = 1
        out += a @ b.T
    sparse = np.flatnonzero((size_l * size_r <= _DENSE * _DENSE))
    pairs = np.cumsum(size_l[sparse] * size_r[sparse])
    at = 0
    while at < len(sparse):
        end = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + (1 << 21))))
        part = sparse[at:end]
        times = size_r[part]
        # every left entry of a token meets every right entry of it
        left_at = np.repeat(le[part], size_l[part]) + _within(size_l[part])
        many = np.repeat(times, size_l[part])
        right_at = np.repeat(np.repeat(re_[part], size_l[part]), many) + _within(many)
        cells = np.repeat(ld[left_at], many) * columns + rd[right_at]
        out += np.bincount(cells, minlength=rows * columns).reshape(rows, columns).astype(np.float32)
        at = end
    return out


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def linked_pairs(left: list, right: list, same: bool, percent: int = PERCENT, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all links between two blocks; a document is (n, tokens, powers). `same`: only row < column."""
    n_l, n_r = np.array([d[0] for d in left]), np.array([d[0] for d in right])
    smaller, larger = np.minimum(n_l[:, None], n_r[None, :]), np.maximum(n_l[:, None], n_r[None, :])
    open_ = 100 * smaller >= percent * larger
    if same:
        open_ = np.triu(open_, 1)

    def entries(docs, cut):
        tokens = [cut(d) for d in docs]
        return np.concatenate(tokens), np.repeat(np.arange(len(docs)), [len(t) for t in tokens])

    for order in range(orders):  # each order's filter, one after another
        cut = lambda d, order=order: prefixes(d[1], d[2], d[0], order, percent)
        a = entries(left, cut)
        open_ &= shared_counts(a, a if same else entries(right, cut), len(left), len(right)) > 0
        if not open_.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    common = shared_counts(entries([left[i] for i in rows], lambda d: d[1]), entries([right[i] for i in columns], lambda d: d[1]),
                           len(rows), len(columns)).astype(np.int64)
    union = n_l[rows][:, None] + n_r[columns][None, :] - common
    i, j = np.nonzero((100 * common >= percent * union) & open_[np.ix_(rows, columns)])
    return rows[i], columns[j]


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _links(records: DataFrame, clusters: DataFrame, percent: int, orders: int) -> DataFrame:
    """(node, root, links) for every document of a pair of blocks: smallest document linked there, documents linked."""
    held = records.join(clusters, "node")
    sizes = held.groupBy("cluster").agg(F.count("*").alias("_docs"), F.sum(F.length("powers")).alias("_tokens"))
    sizes = beside(sizes.select("cluster", F.greatest(F.ceil(F.col("_docs") / BLOCK_DOCS), F.ceil(F.col("_tokens") / BLOCK_TOKENS)).cast("int").alias("_blocks")), 48)
    cut = held.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    paired = cut.select("cluster", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"),
                        "block", "node", "n", "copies", "keys", "powers")

    def verify(table: pa.Table) -> pa.Table:
        block, node = table.column("block").to_numpy(), table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        docs = [(n, np.frombuffer(k, np.uint64), np.frombuffer(p, np.uint8)) for n, k, p in zip(
            *[table.column(c).to_pylist() for c in ("n", "keys", "powers")])]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = left[:0], right[:0]
        if len(left) and len(right) and len(docs) > 1:
            a, b = linked_pairs([docs[x] for x in left], [docs[x] for x in right], i == j, percent, orders)
            a, b = left[a], right[b]
        weight = np.bincount(a, weights=copies[b], minlength=len(docs)) + np.bincount(b, weights=copies[a], minlength=len(docs))
        root = _smallest(len(docs), a, b)
        some = weight > 0
        return pa.table({"node": pa.array(node[some], pa.int64()), "root": pa.array(node[root][some], pa.int64()),
                         "links": pa.array(weight[some].astype(np.int64), pa.int64())})

    # the join deals rows by cluster, which would do for the groups: without a shuffle of their own all pairs of a cluster ran in one task
    return paired.repartition("cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(verify, "node long, root long, links long")


def _judged(docs: DataFrame, width: int, percent: int, orders: int) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, n_links, and `stays` for one row of each component."""
    bits = min(24, (buckets_for(docs) - 1).bit_length())
    rows = settled(_documents(_shared_tokens(_sent_tokens(docs, width, bits)), percent))
    classes = settled(rows.filter("n > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("first"), F.count("*").alias("copies"))
        .select("digest", F.col("first.node").alias("node"), F.col("first.doc_id").alias("rep_id"), "copies"))
    records = settled(rows.filter("keys IS NOT NULL").select("node", "n", "keys", "powers").join(classes.select("node", "copies"), "node"))
    clusters = connected_components(_ties(records, percent)).withColumnRenamed("component", "cluster")
    links = settled(_links(records, clusters, percent, orders))
    reached = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(
        F.min("rep_id").alias("component_id"), F.min(F.struct(F.col("rep_id").isNull().alias("last"), "rep_id", "node")).alias("_first"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    told = (named.join(ids, "component").join(counted, "node", "left")
            .select("digest", "component_id", F.col("_first.node").alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    with_words = (rows.filter("n > 0").select("node", "doc_id", "text_key", "n", "digest").join(told, "digest")
                  .select("doc_id", "text_key", F.col("n").alias("n_shingles"), (F.col("node") == F.col("first")).alias("stays"), "component_id",
                          F.col("n_links").cast("long").alias("n_links")))
    wordless = rows.filter("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.lit(True).alias("stays"),
                                           F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(wordless)


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (documents it links with, copies included)."""
    return _judged(docs, width, percent, orders).select("doc_id", "n_shingles", "component_id", "n_links")


def survivors(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """(doc_id, text_key, wordless): the row with the smallest doc_id of each component, and all rows without words."""
    out = _judged(docs, width, percent, orders).filter("stays")
    return out.select("doc_id", "text_key", (F.col("n_shingles") == 0).alias("wordless")).distinct()
