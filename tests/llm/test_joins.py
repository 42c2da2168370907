"""N-gram Jaccard join and block matrix neighbour search against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest

from rankforge.llm import ann_blocks, components, ngram_join
from rankforge.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """Multiset of (doc_id, set size, component, links)."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return sorted(map(str, ((rows[i][0], len(sets[i]), least.get(find(i)), links[i]) for i in range(len(rows)))))


def found(df):
    return sorted(map(str, (tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "n_links").collect())))


def test_documents(spark, sf, documents):
    assert found(QUERIES["op2_ngram_jaccard"](spark, sf)) == brute(documents)


def test_odd_rows_and_empty_table(odd, nothing, odd_rows):
    assert found(ngram_join.near_duplicates(odd)) == brute(odd_rows)
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_edited_copies_in_small_blocks(spark, monkeypatch):
    """A group of near copies around the threshold, cut into many pairs of blocks."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.choice(120, rng.integers(0, 8), replace=False):
            w[at] = f"e{rng.integers(0, 6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{i}x{k}" for k in range(100)) + " " + " ".join(base[:30])) for i in range(30)]
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(ngram_join.near_duplicates(docs)) == brute(rows)


@pytest.mark.parametrize("dense", [0, 2, 64])
def test_shared_counts(monkeypatch, dense):
    monkeypatch.setattr(ngram_join, "_DENSE", dense)
    rng = np.random.default_rng(1)
    sides = []
    for n in (7, 5):
        sets = [np.unique(rng.integers(0, 30, 12)).astype(np.uint64) for _ in range(n)]
        sides.append((np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets]), sets))
    got = ngram_join.shared_counts(sides[0][:2], sides[1][:2], 7, 5)
    assert (got == [[len(np.intersect1d(a, b)) for b in sides[1][2]] for a in sides[0][2]]).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}


def test_neighbours_agree_with_sql(spark, con, sf):
    got = QUERIES["op4_nearest_neighbours"](spark, sf).collect()
    want = con.execute(SQL["op4_nearest_neighbours"]).fetchall()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_neighbours_in_many_blocks_with_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(300, 6)), 1))]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] + [1.0] * 5),
             (305, [float("inf")] + [1.0] * 5), (306, [1.0, 2.0]), (307, rows[4][1]), (308, rows[4][1]), (308, rows[5][1]),
             (309, [x * 1e6 for x in rows[4][1]])]
    base = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, block int")
    got = ann_blocks.nearest_neighbours(base.filter("vec_id % 20 = 4 OR vec_id > 299"), base, "vec_id", "embedding", 7, 8, 32).collect()
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 6]
    seen = {}
    for i, q in good:
        if i % 20 == 4 or i > 299:
            seen.setdefault(i, []).append(q)
    for i, qs in seen.items():
        if len(qs) > 1:
            continue  # two rows of one query id share its list
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(qs[0], v)))), k) for k, v in good if k != i)[:7]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i)
        assert [(m[1], round(m[2], 9)) for m in mine] == [(k, round(d, 9)) for d, k in near]
    assert not {300, 301, 302, 303, 304, 305, 306} & {r["query_id"] for r in got}
    assert ann_blocks.nearest_neighbours(base.limit(0), base.limit(0), "vec_id", "embedding").count() == 0


def test_blocks_of_one_cluster_fill_many_partitions(spark, monkeypatch):
    """Pairs of blocks of a hot cluster are dealt over tasks, however the clusters were."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 4)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} tail{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = ngram_join._documents(ngram_join._shared_tokens(ngram_join._sent_tokens(docs, 5, 8)), 75)
    records = held.filter("keys IS NOT NULL").selectExpr("node", "n", "keys", "powers", "1L AS copies").cache()
    clusters = records.selectExpr("node", "0L AS cluster")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = ngram_join._links(records, clusters, 75, 3)
        sizes = links.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        records.unpersist()
    assert sum(s > 0 for s in sizes) >= 6 and max(sizes) < 0.4 * sum(sizes)


def test_many_tiny_texts_and_wide_buckets(spark, monkeypatch):
    """More texts in a slice than 16 bits count, and more buckets than a small table needs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "0")
    monkeypatch.setattr(ngram_join, "buckets_for", lambda docs: 4096)
    try:
        docs = spark.range(70_000).coalesce(1).selectExpr("id AS doc_id", "IF(id IN (1000, 66000), 'the same words again and again', 'u' || id) AS text")
        got = ngram_join.near_duplicates(docs).filter("doc_id <> component_id OR n_links > 0").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got) == [(1000, 1000, 1), (66000, 1000, 1)]
