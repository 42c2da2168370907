"""Attention over passages: inputs and margins against plain versions, gradients, held-out accuracy and the fit's bounds."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import labelled, passages
from rankforge.llm.kernels import slices
from rankforge.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_inputs(text):
    """Inputs of every passage of one text, one by one."""
    raw = (text or "").encode()
    found = list(WORD.finditer(raw))
    parts = [found[i:i + passages.WORDS] for i in range(0, len(found), passages.WORDS)] or [[]]
    starts = [0] + [p[0].start() for p in parts[1:]] + [len(raw)]
    seen, runs, out, k = set(), set(), [], 0
    words = [m.group() for m in found]
    for part, a, b in zip(parts, starts, starts[1:]):
        cells = np.zeros(1 << passages.BUCKET_BITS)
        for i in range(a, b):
            if i + 3 <= len(raw):
                packed = int.from_bytes(raw[i:i + 3], "big")
                cells[(packed * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - passages.BUCKET_BITS)] += 1
        own = raw[a:b]
        size, n = max(1, len(own)), len(part)
        shares = [math.log1p(n) / 4, sum(len(m.group()) for m in part) / max(1, n) / 10]
        shares += [sum(lo <= c < hi for c in own) / size for lo, hi in ((65, 91), (48, 58), (128, 256))]
        shares.append(sum(c in b"#*$%&|<>!?@^~=+_{}[]\\/" for c in own) / size)
        old = old_runs = 0
        for m in part:
            old += words[k] in seen
            seen.add(words[k])
            if k + 3 <= len(words):
                old_runs += tuple(words[k:k + 3]) in runs
                runs.add(tuple(words[k:k + 3]))
            k += 1
        out.append(np.concatenate([np.sqrt(cells / max(1, cells.sum())), shares + [old / max(1, n), old_runs / max(1, n)]]))
    return np.array(out)


def test_inputs(documents, odd_rows):
    import pyarrow as pa
    texts = [t for _, t in documents[:40]] + [t for i, t in odd_rows if i not in (9, 10)]
    texts += ["a b a b a b a b", "The END 12 é", " ".join(f"v{i % 50}" for i in range(200)), " ".join("w" * (i % 5 + 1) for i in range(128))]
    for limit in (1 << 20, 500):
        at = 0
        for piece in slices(pa.array(texts, pa.string()), limit):
            x, edges = passages.inputs(piece)
            for i in range(piece.texts):
                assert np.allclose(x[edges[i]:edges[i + 1]], plain_inputs(texts[at]), atol=1e-6), texts[at]
                at += 1
        assert at == len(texts)


@pytest.fixture
def small():
    rng = np.random.default_rng(1)
    edges = np.array([0, 1, 4, 9])
    x = rng.normal(size=(9, 6))
    layers = {"encode": rng.normal(size=(6, 5)), "encode0": rng.normal(size=5), "tanh": rng.normal(size=(5, 4)), "gate": rng.normal(size=(5, 4)),
              "attend": rng.normal(size=4), "unit": rng.normal(size=5), "unit0": np.array([0.3])}
    return layers, x, edges


def test_forward_and_gradients(small):
    layers, x, edges = small
    y, cost = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        total = 0.0
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            h = np.tanh(x[a:b] @ layers["encode"] + layers["encode0"])
            s = (np.tanh(h @ layers["tanh"]) / (1 + np.exp(-h @ layers["gate"]))) @ layers["attend"]
            w = np.exp(s) / np.exp(s).sum()
            margin = (w @ h) @ layers["unit"] + layers["unit0"][0]
            total += cost[i] * (np.log1p(np.exp(-margin)) if y[i] else np.log1p(np.exp(margin)))
        return total

    f = passages.forward(layers, x, edges)
    assert np.allclose(np.add.reduceat(f["weight"], edges[:-1]), 1)
    found = passages.gradients(layers, x, edges, y, cost)
    for name, value in layers.items():
        for at in np.ndindex(value.shape):
            kept, step = value[at], 1e-6
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert abs((up - down) / (2 * step) - found[name][at]) < 1e-5, name


def test_one_bad_passage_is_attended(spark):
    """Labels of whole documents alone: the one passage that decides gets the attention, wherever it stands."""
    rng = np.random.default_rng(9)
    rows, labels, where = [], [], {}
    for i in range(400):
        parts = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"], 64)) for _ in range(6)]
        bad = i % 3 == 0
        if bad:
            where[i] = int(rng.integers(0, 6))
            parts[where[i]] = " ".join(rng.choice(["xq#", "zz%", "kk$"], 64))
        rows.append((i, " ".join(parts)))
        labels.append((i, 0 if bad else 1))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in passages.score(docs, passages.fit(docs, known.filter("doc_id < 300"))).collect()}
    late = [i for i in range(300, 400)]
    assert np.mean([(got[i]["score"] >= 0.5) == (i % 3 > 0) for i in late]) >= 0.98
    assert np.mean([got[i]["attended"] == where[i] for i in late if i in where]) >= 0.9


def test_held_out_documents(spark, con):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op12_quality_classifier"](spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert len(bad) > 5 and (good[:, None] > bad[None, :]).mean() > 0.95
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.97


def test_odd_rows_and_models_without_a_network(spark, odd, nothing, odd_rows):
    labels = spark.createDataFrame([(6, 1), (7, 1), (9, None)], "doc_id long, quality int")
    assert {r["score"] for r in passages.score(odd, passages.fit(odd, labels)).collect()} == {1.0}
    assert {r["score"] for r in passages.score(odd, passages.fit(odd, labels.limit(0))).collect()} == {0.5}
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["good", "fine"] if i % 2 else ["##", "%%"], 30))) for i in range(60)], "doc_id long, text string")
    model = passages.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")))
    got = passages.score(odd, model)
    assert got.count() == len(odd_rows) and got.filter("score BETWEEN 0 AND 1").count() == len(odd_rows)
    assert passages.score(nothing, model).count() == 0
    assert passages.fit(nothing, labels).known == 0.5


def test_bounds_hold_after_the_join(spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(8, "x" * 1000), (9, "short"), (9, "short"), (10, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 1), (9, 0), (9, None), (10, 0), (None, 1)], "doc_id long, quality int")
    got = labelled.labelled_rows(docs, labels, "quality", 10, 500)
    rows = got.collect()
    assert len(rows) <= 10 and sum(len(r["text"] or "") for r in rows) <= 500
    few = labelled.labelled_rows(docs.filter("doc_id <> 7"), labels, "quality", 10, 5000).collect()
    assert sorted((r["doc_id"], r["label"], len(r["text"] or "")) for r in few) == [(8, 0, 1000), (9, 0, 5), (9, 1, 5), (10, 0, 0)]
    each = labelled.labelled_rows(docs, labels, "quality", 4, 5000, each=True).collect()
    assert sorted(r["label"] for r in each) == [0, 0, 1, 1]
