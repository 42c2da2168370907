"""Substring dedup, quality rules, toxicity, URL filters and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from rankforge.llm import kernels, quality, substring, toxicity, url_graph
from rankforge.llm.queries import QUERIES, URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_repeats(rows, width=20):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            window = tuple(w[k:k + width])
            if window in seen:
                gone[k:k + width] = [True] * width
            seen.add(window)
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(doc_id), len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def cleaned(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_repeats_of_documents(spark, sf, documents):
    assert cleaned(QUERIES["op6_substring_dedup"](spark, sf)) == without_repeats(documents)


def test_repeats_of_odd_rows(odd, nothing, odd_rows):
    assert cleaned(substring.remove_repeats(odd, digests=True)) == without_repeats(odd_rows)
    assert substring.remove_repeats(nothing).count() == 0


def test_repeats_at_every_offset(spark):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        a, n = int(rng.integers(0, 150)), int(rng.integers(15, 50))
        own = [f"d{i}x{k}" for k in range(int(rng.integers(0, 25)))]
        rows.append((int(rng.integers(0, 1000)), " ".join(own + base[a:a + n] + own[::-1])))
    rows += [(5, "la " * 100), (600, "la " * 30 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert cleaned(substring.remove_repeats(docs, digests=True)) == without_repeats(rows)
    for r in substring.remove_repeats(docs).collect():
        w = WORD.findall(next(t for i, t in rows if i == r["doc_id"])) if [i for i, _ in rows].count(r["doc_id"]) == 1 else None
        if w and r["n_removed"]:
            gone = {k for s in r["removed"] for k in range(s["start"], s["start"] + s["length"])}
            assert r["kept_text"] == " ".join(x for k, x in enumerate(w) if k not in gone)


WORDLESS = [None, "", " \t\n "]


def test_windows_after_texts_without_words():
    assert kernels.windows_inside(np.array([0, 0, 30]), 20, 30).tolist() == [True] * 11
    assert kernels.windows_inside(np.array([0, 0, 2, 2, 5, 5]), 3, 5).tolist() == [False, False, True]


def test_repeats_after_texts_without_words(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, t) for i, t in enumerate(WORDLESS)] + [(10, passage + " first"), (11, "own " + passage), (300, None), (301, passage), (302, passage + " last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert cleaned(substring.remove_repeats(docs, digests=True)) == without_repeats(rows)


def base_counts(text):
    w = WORD.findall(text or "")
    triples = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if triples[tuple(w[k:k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def counted(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())


def expected(rows):
    out = []
    for doc_id, text in rows:
        c = base_counts(text)
        out.append(str((doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])))
    return sorted(out)


def test_quality_of_documents(spark, sf, documents, con):
    df = QUERIES["op7_quality_rules"](spark, sf).cache()
    assert counted(df) == expected(documents)
    labels = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = [r for r in df.collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([r["kept"] == bool(labels[r["doc_id"]]) for r in rows]) > 0.85
    assert not any(r["kept"] for r in df.collect() if r["base_failed"])


def test_quality_of_odd_rows(spark, odd, nothing, odd_rows):
    lines = [(20, "a\nb\n a\na\n\n\nb"), (21, "\n\n"), (22, "#*$%&|<> é é"), (23, "a b c a b c a b")]
    model = quality.no_model()
    assert counted(quality.judge(odd, model)) == expected(odd_rows)
    assert counted(quality.judge(spark.createDataFrame(lines, "doc_id long, text string"), model)) == expected(lines)
    assert quality.judge(nothing, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(odd, labels).a == 0


def test_quality_after_texts_without_words(spark):
    rows = [(i, t) for i, t in enumerate(WORDLESS)] + [(10, "la le lu x la le lu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(docs, quality.no_model()).collect()} == {0: 0, 1: 0, 2: 0, 10: 6}


def test_toxicity_of_documents(spark, sf, con):
    rows = QUERIES["op5_toxicity"](spark, sf).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def invented(rng, n, toxic):
    clean = ["river", "stone", "window", "paper", "quiet", "garden", "market", "letter", "summer", "bridge", "yellow", "captain", "harbour"]
    bad = ["wretchole", "grubnik", "slugface"]
    out = []
    for _ in range(n):
        w = [clean[k] + str(rng.choice(["", "s", "ed", "ing"])) for k in rng.integers(0, len(clean), 60)]
        if toxic:
            for at in rng.integers(0, 60, 3):
                w[at] = bad[rng.integers(0, 3)]
        out.append(" ".join(w))
    return out


def test_gapped_insults_are_caught_and_clean_texts_left():
    rng = np.random.default_rng(0)
    texts = [(1, t) for t in invented(rng, 60, True)] + [(0, t) for t in invented(rng, 200, False)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    model = toxicity.train([(y, sorted({p for u in toxicity.units(t) for p in toxicity.plain(u)})) for y, t in texts], landmarks=40)

    def score(text):
        us = sorted({p for u in toxicity.units(text) for p in toxicity.plain(u)})
        values = toxicity.margins(model, us).tolist() if us else []
        return float(toxicity.probability(model, np.array([toxicity.evidence(values, model.intercept)]))[0])

    clean = invented(rng, 40, False)
    assert max(map(score, clean)) < 0.5
    assert score("") < 0.5
    for hidden in ("g.r.u.b.n.i.k slu-gface wretch0le", "grxubnik slugxface wretchhole", "g r u b n i k and s l u g f a c e"):
        assert score(clean[0] + " " + hidden) > 0.5, hidden


def test_the_folded_weights_are_the_kernel_machine():
    words = ["abcdef", "abxcdef", "qqqq", "fedcba", "aXbXc".lower(), "éèê"]
    codes = toxicity.coded(words)
    kernel = toxicity.gram(codes, codes)

    def slow(s, t):
        def all_of(u):
            out = Counter()
            for i in range(len(u)):
                for j in range(i + 1, len(u)):
                    for k in range(j + 1, len(u)):
                        out[u[i], u[j], u[k]] += toxicity.DECAY ** (k - i - 2)
            return out
        a, b = all_of(s), all_of(t)
        return sum(v * b[x] for x, v in a.items())

    for i, a in enumerate(words):
        for j, b in enumerate(words):
            want = slow([c for c in codes[i] if c], [c for c in codes[j] if c])
            assert abs(kernel[i, j] - want) < 1e-5 * max(1, want)
    # a machine on the landmarks is one weight per triple, over whole units
    triples = np.zeros(toxicity._KINDS ** 3)
    for rows, t, weight in toxicity.features(codes[:3]):
        np.add.at(triples, t, np.array([0.5, -2.0, 1.0])[rows] * weight)
    got = toxicity.margins(toxicity.Model(triples, 0.25), words)
    assert np.allclose(got, kernel[:, :3] @ [0.5, -2.0, 1.0] + 0.25, rtol=1e-4)


def test_inserted_letters_in_held_out_texts():
    """Insults of texts that the fit never saw, with letters put in: the machine still finds them, and leaves clean texts alone."""
    pd = pytest.importorskip("pandas")
    sf = "/root/testdata/sf0.1"
    rows = pd.read_parquet(f"{sf}/labels.parquet").merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]])
    known, rest = rows[~held], rows[held]
    fit = pd.concat([known[known["toxic"] == 1], known[known["toxic"] == 0].sample(2000, random_state=1)]).sample(frac=1, random_state=2)

    def bag(text):
        return sorted({p for u in toxicity.units(text or "") for p in toxicity.plain(u)})

    model = toxicity.train([(int(y), bag(t)) for y, t in zip(fit["toxic"], fit["text"])], prior=float(known["toxic"].mean()))

    def flagged(texts):
        bags = [bag(t) for t in texts]
        every = sorted({u for b in bags for u in b})
        value = dict(zip(every, toxicity.margins(model, every)))
        inputs = np.array([toxicity.evidence([value[u] for u in b], model.intercept) for b in bags])
        return toxicity.probability(model, inputs) >= 0.5, value

    toxic, (clean, _) = rest[rest["toxic"] == 1]["text"].tolist(), flagged(rest[rest["toxic"] == 0]["text"])
    hit, value = flagged(toxic)
    assert hit.mean() >= 0.9 and clean.mean() <= 0.01
    rng = np.random.default_rng(0)

    def one(w):
        at = int(rng.integers(1, max(2, len(w))))
        return w[:at] + chr(97 + int(rng.integers(0, 26))) + w[at:]

    def between(w):
        return "".join(c + chr(97 + int(rng.integers(0, 26))) for c in w[:-1]) + w[-1:]

    for change in (one, between):
        texts = ["".join(change(w) if w.strip() and any(value.get(p, -9) > 0 for p in toxicity.plain(w.lower())) else w for w in re.split(r"(\s+)", t))
                 for t, h in zip(toxic, hit) if h]
        assert flagged(texts)[0].mean() >= 0.9, change.__name__


def test_toxicity_of_odd_rows(spark, odd, nothing, odd_rows):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(invented(np.random.default_rng(1), 80, True) + invented(np.random.default_rng(2), 200, False))],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(280)] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, landmarks=40)
    got = toxicity.score(odd, model).collect()
    assert Counter(str(r["doc_id"]) for r in got) == Counter(str(i) for i, _ in odd_rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.score(odd, None).filter("score = 0").count() == len(odd_rows)


def longest_rule(host, path):
    fit = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def test_rules_of_pages(spark, sf, con):
    urls = dict(con.execute("SELECT page_id, url FROM pages").fetchall())
    rows = QUERIES["op8_url_filters"](spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    by_host = {}
    for r in rows:
        host, path = split(urls[r["page_id"]])
        rule, verdict = longest_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule:
            assert r["verdict"] == verdict
        else:
            by_host.setdefault(host, set()).add(r["verdict"])
    assert all(len(v) == 1 and v <= {"allow", "block"} for v in by_host.values())


def test_trust_and_distrust_travel(spark):
    link = '<a href="http://{}/x">x</a>'.format
    rows = [(1, "http://good.com/", link("near.org") + link("near.org")), (2, "http://near.org/a", ""), (3, "http://bad.net/es/x", ""),
            (4, "http://fan.org/", link("bad.net")), (5, "http://alone.org/", None), (6, None, None), (7, "no scheme", "x"),
            (8, "HTTP://Sub.Bad.NET?x#y", link("bad.net")), (8, "HTTP://Sub.Bad.NET?x#y", link("bad.net")), (9, "http://fan.org/fr/", "<A CLASS=b HREF='//bad.net'>")]
    pages = spark.createDataFrame([r + ("x", 1.0) for r in rows], "page_id long, url string, html string, host string, trust double")
    got = {r["page_id"]: r for r in url_graph.judge(pages, URL_RULES).collect()}
    assert url_graph.judge(pages, URL_RULES).count() == len(rows)
    assert {i: got[i]["verdict"] for i in got} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block"}
    assert (got[8]["host"], got[8]["path"], got[6]["host"], got[7]["path"]) == ("sub.bad.net", "", "", "")
    assert url_graph.judge(pages.limit(0), URL_RULES).count() == 0


def test_domains_without_pages_join_their_hosts(spark):
    rows = [(1, "http://a.b.farm.net/es/x", ""), (2, "http://c.farm.net/", ""), (3, "http://u.x@d.farm.net:80/", "<a href='//e.far.org/'>"),
            (4, "http://10.0.0.1/", ""), (5, "http://net.org/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = url_graph.host_edges(url_graph.ruled(pages, URL_RULES))
    up = [("a.b.farm.net", "b.farm.net"), ("b.farm.net", "farm.net"), ("c.farm.net", "farm.net"), ("u.x@d.farm.net:80", "d.farm.net"),
          ("d.farm.net", "farm.net"), ("farm.net", "net"), ("e.far.org", "far.org"), ("far.org", "org"), ("net.org", "org")]
    got = {(r["src"], r["dst"]): r["weight"] for r in edges.collect()}
    assert set(got) == {*up, *[(b, a) for a, b in up], ("u.x@d.farm.net:80", "e.far.org")}
    assert got["farm.net", "c.farm.net"] == 1 / 4 and got["u.x@d.farm.net:80", "d.farm.net"] == 1 / 2
    assert url_graph.edge_counts(edges) == {"links": 1, "domains": 2 * len(up)}
    judged = {r["page_id"]: r for r in url_graph.judge(pages, URL_RULES).collect()}
    assert [judged[i]["verdict"] for i in range(1, 6)] == ["block", "block", "block", "allow", "allow"]  # c has no seed of its own
    assert judged[2]["distrust"] > 0 and judged[4]["distrust"] == judged[5]["distrust"] == 0


def test_a_small_graph_is_ranked_as_a_large_one(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcd"], "host string")
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("b", "a", 1.0), ("x", "d", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    few, many = (dict(map(tuple, url_graph.personalised_rank(nodes, edges, seeds, tolerance=0.05, small=size).collect())) for size in (1 << 20, 0))
    assert few.keys() == many.keys() and all(abs(few[h] - many[h]) < 1e-12 for h in few)


def test_ranks_go_on_to_the_tolerance(spark):
    n, d = 60, 0.85  # a path, and a circle of two, in which the mass goes on moving
    nodes = spark.createDataFrame([(str(i),) for i in range(n)], "host string")
    edges = spark.createDataFrame([(str(i), str(i + 1), 1.0) for i in range(n - 1)] + [("59", "58", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("0", 0.5), ("58", 0.5)], "host string, seed double")
    m = np.zeros((n, n))
    for i in range(n - 1):
        m[i + 1, i] = 1
    m[58, 59] = 1
    seed = np.zeros(n)
    seed[[0, 58]] = 0.5
    want = np.linalg.solve(np.eye(n) - d * m, (1 - d) * seed)
    got = {int(r["host"]): r["rank"] for r in url_graph.personalised_rank(nodes, edges, seeds).collect()}
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-5, rtol=0) and got[50] > 0
    with pytest.raises(RuntimeError):  # seeds beyond 1 move further than the bound allows
        url_graph.personalised_rank(nodes, edges, seeds.withColumn("seed", seeds["seed"] * 1e9))


def test_rank_is_the_solution_of_its_equation(spark):
    rng = np.random.default_rng(0)
    n, d = 12, 0.85
    weights = {(a, b): 1.0 for a, b in rng.integers(0, n, (40, 2)).tolist() if a != b}
    out = Counter()
    for (a, _), w in weights.items():
        out[a] += w
    m = np.zeros((n, n))
    for (a, b), w in weights.items():
        m[b, a] = w / out[a]
    seed = np.zeros(n)
    seed[[1, 4]] = 0.5
    want = np.linalg.solve(np.eye(n) - d * m, (1 - d) * seed)
    nodes = spark.createDataFrame([(str(i),) for i in range(n)], "host string")
    edges = spark.createDataFrame([(str(a), str(b), w / out[a]) for (a, b), w in weights.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("1", 0.5), ("4", 0.5)], "host string, seed double")
    got = {int(r["host"]): r["rank"] for r in url_graph.personalised_rank(nodes, edges, seeds, tolerance=1e-5).collect()}
    assert np.allclose([got[i] for i in range(n)], want, atol=2e-4)


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_pipeline_stages(spark, sf, staged, documents):
    before = dict(documents)
    for df in staged[:-1]:
        assert df.columns == corpus_pipeline.COLUMNS
        now = {r["doc_id"]: r["text"] for r in df.collect()}
        assert set(now) <= set(before) and len(now) == df.count()
        before = now
    kept = {r["doc_id"]: r["text"] for r in staged[2].collect()}
    left = {r["doc_id"]: r for r in staged[3].collect()}
    for doc_id, _, n_removed, digest in without_repeats(list(kept.items())):
        r = left[int(doc_id)]
        assert hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest() == digest
        assert n_removed or r["text"] == kept[int(doc_id)]
    assert {r["doc_id"] for r in staged[4].collect()} == set(left)


def test_pipeline_takes_odd_rows(spark, sf, odd_rows):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in odd_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).count()
        stage(spark, docs.limit(0), sf).count()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert Counter(r["doc_id"] for r in kept.collect())[5] == 0  # row 4 is the smallest of that group
    assert kept.filter("doc_id = 9").count() == 1 and kept.filter("doc_id = 10").count() == 0


def test_one_row_of_each_component_stays(spark, sf):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(None, a), (None, a + " more"), (None, b), (7, b + " more"), (8, "text of " + c), (8, c), (6, c + " end"), (8, "d e f g h i"),
            (8, "d e f g h i"), (None, "no copy of any other text"), (None, None), (None, None), (9, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    want = [(7, b + " more"), (6, c + " end"), (8, "d e f g h i"), (None, "no copy of any other text"), (None, None), (None, None), (9, " ")]
    rest = Counter(kept) - Counter(want)
    assert not Counter(want) - Counter(kept)
    assert len(kept) == len(want) + 1 and set(rest) <= {(None, a), (None, a + " more")}


def test_quality_features_come_to_the_driver_in_few_bytes(spark):
    """A bucket in two bytes and a count in as few as it takes; places and shares are those of each kind of feature."""
    text = "one two three two " * 200 + "zz"
    docs = spark.createDataFrame([(1, "q", 1), (2, "", 0)], "doc_id long, text string, label int").withColumn(
        "text", F.when(F.col("doc_id") == 1, F.lit(text)).otherwise(F.col("text")))
    table = quality._hashed_rows(docs, "label").toArrow().sort_by("doc_id")
    raw = [[np.frombuffer(x, np.uint8) for x in table[c].to_pylist()] for c in ("sizes", "buckets", "times")]
    piece = next(iter(kernels.slices(pa.array([text]))))
    cells, shares = quality._cells(*[r[0] for r in raw])
    want = [np.unique(v, return_counts=True) for v, _ in quality.features(piece)]
    assert cells.tolist() == [int(b) + (kind << quality.BITS) for kind, (v, _) in enumerate(want) for b in v]
    assert shares.tolist() == [float(np.float32(x / n.sum())) for _, n in want for x in n]
    assert sum(len(r[0]) for r in raw) <= 4 * len(cells) + 4 * quality.KINDS
    assert [len(x) for x in quality._cells(*[r[1] for r in raw])] == [0, 0]
