"""Spelling variants and source divergence against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import divergence, spelling
from rankforge.llm.queries import QUERIES, SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for w in RUN.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for words in holes.values():
        for w in words:
            near[w] |= words - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variants(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_of_documents(spark, sf, documents):
    want = brute_variants(documents)
    assert variants(QUERIES["op11_spelling_variants"](spark, sf)) == want
    assert any(r[1] for r in want) and max(r[4] for r in want) > 3


def test_variants_of_odd_rows(odd, nothing, odd_rows):
    assert variants(spelling.spelling_variants(odd)) == brute_variants(odd_rows)
    assert spelling.spelling_variants(nothing).count() == 0


@pytest.fixture
def chains(spark):
    """Forms of forms, ties, double letters, long words and letters outside ASCII."""
    words = ["abcdefgh"] * 5000 + ["abcdefgx"] * 400 + ["abcdefyx"] * 30 + ["abcdeeyx"] * 2 + ["aabcdefgh"] * 3 + ["bcdefgh"] * 2
    words += ["zzzzzzz"] * 2 + ["zzzzzzzz"] * 2 + ["zzzzzzzzz"] * 40 + ["ÀÉîõüñç"] * 30 + ["ÀÉîõüñÿ"] * 2 + ["ÀÉîõü×÷"] * 2 + ["éÉîõüñç"] * 30
    long = "ab" * 60
    words += [long] * 50 + [long[:50] + long[51:]] * 2 + [long[:70] + "ÿ" + long[71:]] * 3 + ["q" * 2_000] * 2 + ["q" * 1_999] * 2
    rng = np.random.default_rng(5)
    rows = [(i, w, 1) for i, w in enumerate(rng.permutation(np.array(words, dtype=object)))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(7)


@pytest.mark.parametrize("part_words, filter_bytes", [(1 << 22, 48 << 20), (2, 64), (1, 1)])
def test_chains_with_filters_of_any_size(chains, monkeypatch, part_words, filter_bytes):
    """Parts and passes do not change the result."""
    monkeypatch.setattr(spelling, "PART_WORDS", part_words)
    monkeypatch.setattr(spelling, "FILTER_BYTES", filter_bytes)
    rows, df = chains
    got = variants(spelling.spelling_variants(df))
    assert got == brute_variants([r[:2] for r in rows])
    assert [r[2] for r in got if r[0] == "abcdeeyx"] == ["abcdefgh"]


def test_checksums():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, size)) for size in (0, 1, 5, 5, 40)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    got = spelling.checksums(data, np.cumsum(sizes) - sizes, sizes, np.array([zlib.crc32(b"%d:" % i) for i in range(5)], np.uint32))
    assert got.tolist() == [zlib.crc32(b"%d:" % i + t) for i, t in enumerate(texts)]


def test_filters_hold_all_their_keys():
    keys = np.random.default_rng(2).integers(0, 1 << 64, 5000, dtype=np.uint64)
    block, bits = spelling.block_and_bits(keys, 1900)
    table = np.zeros(1900, np.uint64)
    np.bitwise_or.at(table, block, bits)
    assert (table[block] & bits == bits).all()
    others = np.random.default_rng(3).integers(0, 1 << 64, 20000, dtype=np.uint64)
    block, bits = spelling.block_and_bits(others, 1900)
    assert (table[block] & bits == bits).mean() < 0.01


def brute_divergence(rows, min_docs=30, top=50):
    """rows: (text, lang, source)."""
    held, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang, own in sources.items():
        kept = sorted(t for t, k in held[lang].items() if k >= min_docs)
        total = {s: sum(count[lang, s][t] for t in kept) for s in own}
        whole = {t: sum(count[lang, s][t] for s in own) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept} for s in own}
        for s in own:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s],
                     "term": [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def divergences(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_of_documents(spark, con, sf):
    want = sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({SQL['op13_source_divergence']})").fetchall())
    assert divergences(QUERIES["op13_source_divergence"](spark, sf)) == want
    assert want == brute_divergence(con.execute("SELECT text, lang, source FROM documents").fetchall())


@pytest.fixture
def mixed_rows(odd_rows):
    rng = np.random.default_rng(4)
    words = [f"w{'abcdefghij'[i % 10] * (i + 1)}" for i in range(25)] + ["Éa", "ß", "日本", "abcdefgh", "abcdefghi", "abcdefghijklmnopq", "ABCDEFGH"]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words, rng.integers(0, 40), p=np.r_[[0.02] * 25, [0.5 / 7] * 7]))
        rows.append((text, ["en", "de", None, ""][i % 4], f"s{rng.integers(0, 9)}" if i % 3 else None))
    return rows + [(t, "en", "odd") for _, t in odd_rows] + [(None, "xx", "a"), ("one two", "xx", "b"), ("lone", "yy", "only")]


@pytest.mark.parametrize("block, chunk, slice_", [(128, 4096, 4 << 20), (3, 5, 300), (1, 1, 40)])
def test_divergence_in_small_blocks(spark, monkeypatch, mixed_rows, block, chunk, slice_):
    for name, value in (("BLOCK_SOURCES", block), ("CHUNK_TERMS", chunk), ("SLICE", slice_)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in mixed_rows], "text string, lang string, source string, n int, term string, place int").repartition(5)
    assert divergences(divergence.source_divergence(docs)) == brute_divergence(mixed_rows)
    assert divergences(divergence.source_divergence(docs, 5, 3)) == brute_divergence(mixed_rows, 5, 3)


def test_divergence_of_nothing(spark, nothing):
    empty = nothing.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    assert divergence.source_divergence(empty).count() == 0


def test_pointer_sort():
    rng = np.random.default_rng(6)
    words = [bytes(rng.integers(97, 99, size)) for size in rng.integers(1, 30, 2000)] + [b"a" * 5000] * 2 + [b"a" * 4999]
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    order, new = divergence.pointer_sort(data, np.cumsum(sizes) - sizes, sizes)
    assert [words[i] for i in order] == sorted(words) and int(new.sum()) == len(set(words))


def test_shares_are_exact_for_large_counts(spark):
    big = 12_345_678_901_234
    row = spark.range(1).select(divergence._share(F.lit(big), F.lit(10 * big), F.lit(7).cast("long")).alias("p"),
                                divergence._share(F.lit(3).cast("long"), F.lit(11).cast("long"), F.lit(0).cast("long")).alias("none")).first()
    assert row["p"] == 1 + 10**9 * (big + 5) // (10 * big + 35) and row["none"] is None
