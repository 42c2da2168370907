"""Sharding over virtual slots and chat formatting."""

import hashlib
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rankforge.llm import chat, sharding
from rankforge.llm.queries import CONFLICT, QUERIES, SQL


def check_shards(rows, shards=16):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for mine in by.values():
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    return [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]


def test_shards_of_documents(spark, sf, documents):
    rows = QUERIES["op1_sharding"](spark, sf).collect()
    assert len(rows) == len(documents)
    loads = check_shards(rows)
    assert max(loads) <= 1.02 * min(loads)
    texts = dict(documents)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    of_text = {}
    for r in rows:
        of_text.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())


def test_a_group_of_a_third_of_all_rows_is_split(spark):
    rows = [(i, "copy " * 30) for i in range(1000)] + [(1000 + i, f"text {i} " * 20) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_documents(docs, 16).collect()
    loads = check_shards(found)
    assert len(found) == 3000 and max(loads) <= 1.05 * min(loads)
    others = {}
    for r in found:
        if r["doc_id"] >= 1000:
            others.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in others.values())


def test_odd_rows_and_empty_table(odd, nothing, odd_rows):
    found = sharding.shard_documents(odd, 4).collect()
    assert len(found) == len(odd_rows)
    check_shards(found, 4)
    assert Counter(r["size"] for r in found) == Counter(len((t or "").encode()) + 1 for _, t in odd_rows)
    assert sharding.shard_documents(nothing, 4).count() == 0


def test_versions_of_the_map(spark, tmp_path):
    sizes = {s: 10 + s for s in range(64)}
    first = sharding.initial_map(sizes, 4)
    sharding.save_map(spark, str(tmp_path), 1, first, sizes)
    grown = sizes | {3: 400}
    second = sharding.rebalanced(first, grown, 4)
    sharding.save_map(spark, str(tmp_path), 2, second, grown)
    moved = [s for s in first if first[s] != second[s]]
    assert 0 < len(moved) < 32
    assert {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path), 1).collect()} == first
    assert {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, str(tmp_path), 2).collect()} == second
    with pytest.raises(Exception):
        sharding.save_map(spark, str(tmp_path), 2, second, grown)


def test_a_stored_map_is_kept_or_edited(spark, tmp_path):
    """Runs on a growing table: the map is taken up again, and few rows change their shard."""
    folder = str(tmp_path / "map")

    def run(n, heavy=0):
        rows = [(i, f"text {i} " + "x" * (i * 37 % 300)) for i in range(n)] + [(10**6 + i, "y" * 900 + str(i)) for i in range(heavy)]
        found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, folder).collect()
        loads = check_shards(found, 8)
        assert len(found) == len(rows) and max(loads) <= 1.02 * min(loads)
        return {r["doc_id"]: r["shard"] for r in found}, {r["map_version"] for r in found}

    first, version = run(6000)
    assert version == {2}
    again, version = run(6000)
    assert version == {2} and again == first  # nothing new: the map is kept
    grown, version = run(7000, heavy=300)
    assert version == {3}
    assert sum(grown[i] != shard for i, shard in first.items()) < 0.25 * len(first)
    assert sharding.latest_map(spark, folder)[0] == 3
    assert {r["shard"] for r in sharding.load_map(spark, folder, 1).collect()} == set(range(8))  # earlier versions stay


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.format_conversations(df)


def test_conversations_agree_with_sql(spark, con, sf):
    got = QUERIES["op3_chat_formatting"](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL['op3_chat_formatting']})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_the_conflicting_conversation(spark):
    rows = [(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)]
    r = formatted(spark, rows).first()
    assert r["round_trips"] and r["level"] == 1
    assert [tuple(t) for t in r["turns"]] == [("user", CONFLICT), ("assistant", CONFLICT)]
    assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == 2


PARTS = st.lists(st.sampled_from(["<", "|", "\\", ">", "im_start", "im_end", "<|im_start|>", "<|im_end|>", "<|nl|>", "\n", "a", "é😀",
                                  "assistant", "<\\|"]), max_size=8).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(PARTS, PARTS), min_size=1, max_size=4), min_size=40, max_size=60))
def test_any_text_round_trips(spark, conversations):
    rows = [(i, k, role, text) for i, turns in enumerate(conversations) for k, (role, text) in enumerate(turns)]
    for r in formatted(spark, rows).collect():
        assert r["round_trips"]
        assert [tuple(t) for t in r["turns"]] == conversations[r["conv_id"]]


def test_loss_spans_cover_the_loss_text(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "é <|im_end|> q"), (1, 2, "assistant", "a<|im_start|>é😀"), (1, 3, "assistant", None), (2, 0, "user", "u")]
    done = formatted(spark, rows)
    text = done.filter("conv_id = 1").first()["formatted"]
    spans = chat.loss_spans(done).orderBy("start").collect()
    assert [s["turn"] for s in spans] == [2, 3] and all(s["conv_id"] == 1 for s in spans)
    inside = [text[s["start"]:s["start"] + s["length"]] for s in spans]
    assert inside == ["a<\\|im_start|>é😀", ""]


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", "x" * 200_000)]
    df = spark.createDataFrame([r + (1, 2) for r in rows], "conv_id long, turn long, role string, text string, level int, turns int")
    found = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    said = "\n\nuser\na\nuser\na\nuser\nb\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and found[1]["loss_chars"] == 0
    assert found[None]["loss_chars"] == 200_000
    assert chat.format_conversations(df.filter(F.lit(False))).count() == 0
