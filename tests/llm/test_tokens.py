"""BPE against the tokenizers library, and packing."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from rankforge.llm import bpe, packing
from rankforge.llm.queries import QUERIES

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
LIBRARY = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
OWN = {f: bpe.Vocabulary(bpe.read_text(public_tokenizers.path(f))) for f in FILES}
ODD = ["", "  ", "a", "İstanbul ΣΟΦΟΣ Σ", "it's they'LL 'S x1234y '", "a<|endoftext|>b <|startoftext|>", "\x1c a\x1db \x85c​d",
       "é ñ é<|endoftext|>́x", "😀😀 中文字 ", "x" * 3000, "don't'tt ''s 's's'story", "ß ẞ ǅ", " 　zz", "a  b\n\nc \n d\t\te   ",
       "\n", "  'll we're  've \"'m'", " \n x", "'", "<|endoftext|>"]


def agree(name, texts):
    for text, want, got in zip(texts, LIBRARY[name].encode_batch(texts, add_special_tokens=False), bpe.encode_texts(OWN[name], texts)):
        assert got.tolist() == want.ids, text
        if name.startswith("word"):
            assert bpe.decoded(OWN[name], got).decode() == LIBRARY[name].decode(want.ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
def test_odd_texts(name):
    agree(name, ODD)
    for text in ODD:
        agree(name, [text])


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from(" \n\t'stredmvl19.,éßΣ🙂"), st.characters(blacklist_categories=["Cs", "Cn", "Co"])), max_size=25), max_size=6))
def test_any_text(name, texts):
    agree(name, texts)


def test_documents_by_the_library(spark, sf, documents):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op10_bpe"](spark, sf).collect()}
    library = LIBRARY["word_bpe_49k.json"]
    for (doc_id, text), e in zip(documents, library.encode_batch([t or "" for _, t in documents], add_special_tokens=False)):
        decoded = library.decode(e.ids, skip_special_tokens=False)
        assert got.pop(doc_id) == (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert not got


def test_encode_odd_rows_and_empty_table(odd, nothing, odd_rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = bpe.encode(odd, path).collect()
    want = [LIBRARY["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids for _, t in odd_rows]
    assert sorted((r["ids"] for r in got)) == sorted(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert bpe.encode(nothing, path).count() == 0


def check_packing(rows, texts, length=1024):
    ids = {}
    for i, e in enumerate(LIBRARY["byte_bpe_50k.json"].encode_batch([t or "" for t in texts], add_special_tokens=False)):
        ids[i] = np.array(e.ids + [0], "<u4")
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at <= length
    return ids, sum(length - sum(s for _, s in p) for p in held.values()) / (length * max(1, len(held)))


def test_packed_documents(spark, sf, documents):
    rows = QUERIES["op9_packing"](spark, sf).collect()
    ids, padding = check_packing(rows, [t for _, t in documents])
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, (doc_id, _) in enumerate(documents):
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    assert padding < 0.02


def test_pack_odd_rows_and_empty_table(odd, nothing, odd_rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(odd, path).collect()
    ids, _ = check_packing(rows, [t for _, t in odd_rows])
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert packing.pack_documents(nothing, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_use_every_piece(counts):
    sizes = np.array(sorted(counts), dtype=np.int64)
    wanted = np.array([counts[s] for s in sizes.tolist()], dtype=np.int64)
    patterns = packing.cutting_patterns(sizes, wanted, 64)
    total = sum((p.copies * p.uses for p in patterns), np.zeros(len(sizes), dtype=np.int64))
    assert (total == wanted).all() and all(p.uses @ sizes <= 64 for p in patterns)
    if len(sizes):
        first_fit, room = 0, []
        for s in np.repeat(sizes, wanted)[::-1].tolist():
            k = next((i for i, r in enumerate(room) if r >= s), None)
            if k is None:
                room.append(64 - s)
            else:
                room[k] -= s
        first_fit = len(room)
        assert sum(p.copies for p in patterns) <= 1.03 * first_fit + len(sizes)


def test_word_table_is_bounded_and_gives_the_same_ids(documents):
    from rankforge.llm import bpe
    vocab = bpe.Vocabulary(bpe.read_text(public_tokenizers.path("byte_bpe_50k.json")))
    texts = [t or "" for _, t in documents[:30]] + ["x" * 300, "word " * 50, ""]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for words in (150_000, 40):
        vocab.table = bpe.WordTable(words)
        for _ in range(2):  # the second time from what is known
            assert [ids.tolist() for ids in bpe.encode_texts(vocab, texts)] == want
        assert max(len(vocab.table.young), len(vocab.table.old)) <= words
        assert all(len(w) <= 48 for w in vocab.table.young)
