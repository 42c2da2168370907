"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each distinct word of a batch becomes a row of a matrix. A complete binary tree over its adjacent
pairs holds rank * width + position, so the root is the leftmost lowest-rank merge. A merge changes
at most three leaves, and each change climbs the logarithm of the width. All rows of one width class
take their next merge together until no row has a mergeable pair left. A worker keeps a bounded table of
the words it met lately with their ids, so that usual words are merged once and not once a batch.

The vocabulary file (tokenizers JSON, BPE on bytes, with or without word ends) is read once on the
driver and broadcast: its size does not depend on the data. With word ends, texts are normalised (NFC,
lower case) and cut into letter runs, single digits and runs of other signs, white space left out;
without, white space is kept and one blank belongs to the run after it. Both know the seven English
contractions. Marks of special tokens inside a text are tokens of their own and split it before all
else, as in the library.

Defined results: null text is the empty text; no words give no ids, the hash of nothing and an empty
decoded text; texts are taken whole, whatever their length; repeated rows and other columns stay as
they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import mixed, power_tables

_NONE = np.int64(1) << 62
_CELLS = 1 << 19  # matrix cells that are worked on at once
_LETTERS = 1 << 21  # characters of text whose words are gathered at once, or one longer text
_KNOWN_WORDS, _KNOWN_BYTES = 150_000, 48  # words of a generation of a worker's table, and bytes of a word that is kept
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
# White_Space of the Unicode standard (fixed values).
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 letters for themselves, then from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class WordTable:
    """Ids of words met before, found by the words themselves. Two generations of bounded size: what is not met again goes."""

    def __init__(self, words: int = _KNOWN_WORDS, longest: int = _KNOWN_BYTES):
        self.words, self.longest = words, longest
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def find(self, words: list[bytes]) -> list[bytes | None]:
        young, old = self.young, self.old
        found = [young.get(w) for w in words]
        if old:
            for i, ids in enumerate(found):
                if ids is None and (ids := old.get(words[i])) is not None:
                    found[i] = ids
                    self.put(words[i], ids)
        return found

    def put(self, word: bytes, ids: bytes) -> None:
        if len(word) <= self.longest:
            if len(self.young) >= self.words:
                self.old, self.young = self.young, {}
            self.young[word] = ids


class Vocabulary:
    """Ids, merge ranks and pattern of a tokenizers JSON file, and the words that this process has encoded lately."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.table = WordTable()
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        self.size = len(self.names)
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs[vocab[a] * self.size + vocab[b]] = (rank, vocab[a + b])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys], dtype=np.int64)
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        joined = [n + b" " for n in self.names]  # decoded tokens are joined by blanks
        self.said = np.frombuffer(b"".join(joined), dtype=np.uint8)
        self.said_size = np.fromiter(map(len, joined), np.int64, len(joined))
        self.said_at = np.cumsum(self.said_size) - self.said_size

    def pair_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges, or -1."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), at, -1)


def _merged_rows(vocab: Vocabulary, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all rows to the end. symbols: rows x width (a power of two), -1 beyond counts.

    Returns the symbols and a mask of those still alive.
    """
    n, width = symbols.shape
    rows = np.arange(n)
    alive = np.arange(width)[None, :] < counts[:, None]
    after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()  # next living symbol
    before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
    after[after >= counts[:, None]] = width
    tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
    which = np.full((n, width), -1, dtype=np.int64)  # merge of the pair that starts here
    if width > 1:
        found = vocab.pair_at(symbols[:, :-1], symbols[:, 1:])
        which[:, :-1] = found
        leaf = np.where(found >= 0, vocab.ranks[found] * width + np.arange(width - 1), _NONE)
        tree[:, width:2 * width - 1] = leaf
    level = width
    while level > 1:
        half = level // 2
        np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2], out=tree[:, half:level])
        level = half

    def put(r: np.ndarray, position: np.ndarray, pair: np.ndarray) -> None:
        which[r, position] = pair
        node = width + position
        tree[r, node] = np.where(pair >= 0, vocab.ranks[pair] * width + position, _NONE)
        node = node >> 1
        while node[0] >= 1:  # all leaves are on one level, so all climbs have the same length
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            node = node >> 1

    active = rows[tree[:, 1] < _NONE] if width > 1 else rows[:0]
    while len(active):
        left = tree[active, 1] % width
        right = after[active, left]
        symbols[active, left] = vocab.merged[which[active, left]]
        alive[active, right] = False
        beyond = after[active, right]
        after[active, left] = beyond
        more = beyond < width
        before[active[more], beyond[more]] = left[more]
        put(active, right, np.full(len(active), -1))
        follows = np.where(more, symbols[active, np.minimum(beyond, width - 1)], -1)
        put(active, left, vocab.pair_at(symbols[active, left], follows))
        previous = before[active, left]
        some = previous >= 0
        if some.any():
            r, p = active[some], previous[some]
            put(r, p, vocab.pair_at(symbols[r, p], symbols[r, left[some]]))
        active = active[tree[active, 1] < _NONE]
    return symbols, alive


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i] + sizes[i]] for all i, one after another."""
    first = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))]


def encode_words(vocab: Vocabulary, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words raw[starts:starts + sizes], one after another, and how many each has."""
    widths = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    made, lengths = [], np.zeros(len(sizes), dtype=np.int64)
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        step = max(1, _CELLS // int(width))
        for at in range(0, len(chosen), step):
            part = chosen[at:at + step]
            counts = sizes[part]
            letters = gathered(raw, starts[part], counts)
            symbols = np.full((len(part), int(width)), -1, dtype=np.int64)
            symbols[np.arange(width)[None, :] < counts[:, None]] = vocab.inner[letters]
            symbols[np.arange(len(part)), counts - 1] = vocab.final[letters[np.cumsum(counts) - 1]]
            symbols, alive = _merged_rows(vocab, symbols, counts)
            lengths[part] = alive.sum(axis=1)
            made.append((part, symbols[alive]))
    ends = np.cumsum(lengths)
    ids = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    for part, found in made:
        own = lengths[part]
        ids[np.repeat((ends - lengths)[part] - (np.cumsum(own) - own), own) + np.arange(len(found))] = found
    return ids, lengths


def encode_known(vocab: Vocabulary, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `encode_words`; words of the worker's table are not merged again."""
    whole = raw.tobytes()
    words = [whole[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist())]
    found = vocab.table.find(words)
    new = [i for i, ids in enumerate(found) if ids is None]
    if new:
        ids, counts = encode_words(vocab, raw, starts[new], sizes[new])
        flat, ends = ids.astype(np.uint32).tobytes(), (4 * np.cumsum(counts)).tolist()
        for i, a, b in zip(new, [0, *ends], ends):
            found[i] = flat[a:b]
            vocab.table.put(words[i], found[i])
    return np.frombuffer(b"".join(found), np.uint32).astype(np.int64), np.fromiter((len(x) // 4 for x in found), np.int64, len(found))


_kinds: list[np.ndarray] = []


def _letter_kinds() -> np.ndarray:
    """Kind of every code point."""
    if not _kinds:
        by_category = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter((by_category.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)),
                            np.uint8, sys.maxunicode + 1)
        table[_WHITE] = _SPACE
        _kinds.append(table)
    return _kinds[0]


def cut_words(codes: np.ndarray, edges: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts (code points of text i: edges[i]:edges[i + 1])."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _letter_kinds()[codes]
    first = np.zeros(n + 1, dtype=bool)  # a text begins here
    first[edges] = True
    run = first[:n].copy()  # a run begins here
    run[1:] |= kind[1:] != kind[:-1]
    begin = run.copy()
    if spaces:
        # the last of several white spaces before a run stands alone, a blank goes with the run
        last_white = np.zeros(n, dtype=bool)
        last_white[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]
        begin |= last_white
        joined = np.flatnonzero(last_white & (codes == 32)) + 1
        begin[joined] = False
    else:
        begin |= kind == _NUMBER
    quotes = np.flatnonzero((codes == 39) & begin)
    if len(quotes):
        ends = edges[np.searchsorted(edges, quotes, side="right")]  # of the text each is in
        def at(step: int) -> np.ndarray:
            return np.where(quotes + step < ends, codes[np.minimum(quotes + step, n - 1)], 0)
        a, b = at(1), at(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((one, 1), (two & ~one, 2)):
            where = quotes[hit]
            begin[where + 1] = False
            after = where + 1 + size
            inside = after < ends[hit]
            begin[after[inside]] = True
    starts = np.flatnonzero(begin)
    stops = np.append(starts[1:], n)
    if not spaces:
        kept = kind[starts] != _SPACE
        starts, stops = starts[kept], stops[kept]
    return starts, stops


def _utf8(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of code points, and the byte offset of each (one more at the end)."""
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.concatenate(([0], np.cumsum(size)))
    return np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8), at


def _normal(text: str) -> str:
    """NFC, then lower case letter by letter: a final sigma is no exception."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def encode_plain(vocab: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and edges: ids of text i are edges[i]:edges[i + 1]. No special tokens."""
    if vocab.suffix:
        texts = [_normal(t) for t in texts]
    edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    starts, stops = cut_words(codes, edges, not vocab.suffix)
    owner = np.searchsorted(starts, edges)  # words of text i: owner[i]:owner[i + 1]
    if not len(starts):
        return np.zeros(0, np.int64), owner
    raw, at = _utf8(codes)
    starts, sizes = at[starts], at[stops] - at[starts]
    up, down = power_tables(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)])))
    keys = mixed((total[starts + sizes] - total[starts]) * down[starts] + sizes.astype(np.uint64))
    _, sample, which = np.unique(keys, return_index=True, return_inverse=True)
    ids, counts = encode_known(vocab, raw, starts[sample], sizes[sample])
    lengths = counts[which]
    flat = gathered(ids, (np.cumsum(counts) - counts)[which], lengths)
    return flat, np.concatenate(([0], np.cumsum(lengths)))[owner]


def encode_texts(vocab: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, special tokens in it included."""
    if not (vocab.marks and any(vocab.marks.search(t) for t in texts if "<" in t)):
        flat, edges = encode_plain(vocab, texts)
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]
    pieces, plan = [], []  # plan: per text the numbers of its pieces, and special ids as negative numbers less one
    for text in texts:
        mine, at = [], 0
        for m in vocab.marks.finditer(text):
            mine += [len(pieces), -1 - vocab.special[m.group()]]
            pieces.append(text[at:m.start()])
            at = m.end()
        mine.append(len(pieces))
        pieces.append(text[at:])
        plan.append(mine)
    flat, edges = encode_plain(vocab, pieces)
    return [np.concatenate([flat[edges[p]:edges[p + 1]] if p >= 0 else np.array([-1 - p]) for p in mine]) for mine in plan]


def decoded(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """Token strings joined by blanks, special tokens included: the file names no decoder."""
    return gathered(vocab.said, vocab.said_at[ids], vocab.said_size[ids])[:-1].tobytes()


_loaded: dict[int, Vocabulary] = {}


def shared_vocabulary(shared) -> Vocabulary:
    """The vocabulary of a broadcast file text, built once per Python worker."""
    key = hash(shared.value)
    if key not in _loaded:
        _loaded[key] = Vocabulary(shared.value)
    return _loaded[key]


def read_text(path: str) -> str:
    """The driver reads the file; executors get its text."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def text_groups(column: pa.Array, limit: int = _LETTERS) -> Iterator[list[str]]:
    """Runs of texts of about `limit` characters; null is empty."""
    group, size = [], 0
    for value in column:
        text = value.as_py() or ""
        group.append(text)
        size += len(text)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
           digests: bool = False) -> DataFrame:
    """Token ids (array<int>) and decoded text of each document, or only their digests."""
    shared = docs.sparkSession.sparkContext.broadcast(read_text(path))
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    names = [id_column, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def run(batches):
        vocab = shared_vocabulary(shared)
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(1)):
                found = encode_texts(vocab, group)
                left = [ids.astype("<u4").tobytes() for ids in found]
                right = [decoded(vocab, ids) for ids in found]
                columns = [pa.array([len(ids) for ids in found], pa.int64())]
                if digests:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (left, right)]
                else:
                    columns += [pa.array([ids.astype(np.int32) for ids in found], pa.list_(pa.int32())),
                                pa.array([x.decode() for x in right], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), *columns], names=names)
                at += len(group)

    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {id_type}, {kind}")
