"""Hot keys, block sizes and partition counts must not change a result."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankforge import session
from rankforge.functions import numeric
from rankforge.operators import co_ratings, collaborative, content, diversity, explore, linalg, metrics, neighbours, ordering, splits
from rankforge.sources import embedding_vectors, ratings_agg


def skewed(spark, n=3000):
    """User 0 holds a third of the rows."""
    return spark.range(n, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40 + 1).alias("user_id"),
        (F.col("id") % 101).alias("item_id"), (F.col("id") % 5 + 1).cast("double").alias("rating"),
        F.timestamp_seconds((F.col("id") * 7919) % 1000).alias("ts"), F.col("id").alias("row"))


def test_hot_user_is_ranked_like_a_window(spark):
    rows = skewed(spark)
    got = ordering.group_ranks(rows, ["user_id"], ["ts", "row"]).select("row", "rn", "group_size")
    pdf = rows.toPandas().sort_values(["user_id", "ts", "row"])
    pdf["rn"] = pdf.groupby("user_id").cumcount() + 1
    want = dict(zip(pdf.row, pdf.rn))
    assert {r["row"]: r["rn"] for r in got.collect()} == want


def test_positions_are_spread_over_partitions(spark):
    placed = skewed(spark).repartitionByRange(8, "user_id", "ts", "row")
    sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 3 * 3000 / 8


def test_split_clamps_and_is_stable(spark):
    rows = spark.createDataFrame(
        [(u, i, 3.0, 100, i) for u, n in ((1, 1), (2, 2), (3, 5), (4, 10)) for i in range(n)],
        "user_id long, item_id long, rating double, ts long, row long")
    train, test = splits.chronological_split(rows, ["row"])
    assert {r["user_id"]: r["count"] for r in train.groupBy("user_id").count().collect()} == {1: 1, 2: 1, 3: 4, 4: 8}
    known = {r[0] for r in train.select("item_id").distinct().collect()}
    assert all(r["item_id"] in known for r in test.collect())
    again, _ = splits.chronological_split(rows.repartition(7), ["row"])
    assert train.exceptAll(again).count() == 0


def test_dense_ids_continue(spark):
    known = spark.createDataFrame([("a", "m", 1), ("b", "m", 5)], "ext_id string, media_type string, item_id long")
    new = spark.createDataFrame([("a", "m"), ("a", "t"), ("c", "m"), ("c", "m")], "ext_id string, media_type string")
    got = ordering.extend_ids(known, new, ["ext_id", "media_type"], "item_id").collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("a", "t"): 6, ("c", "m"): 7}


def test_quantiles_equal_numpy(spark, sf):
    values = skewed(spark).withColumn("x", F.sqrt("row") * 1.5)
    got = {r["share"]: r["value"] for r in explore.exact_quantiles(values, "x", [0.1, 0.5, 0.99]).collect()}
    want = np.quantile(np.sqrt(np.arange(3000)) * 1.5, [0.1, 0.5, 0.99])
    assert np.allclose([got[s] for s in (0.1, 0.5, 0.99)], want)


@pytest.mark.parametrize("metric", ["cosine", "jaccard"])
def test_hot_rows_are_cut_without_changing_the_result(spark, metric):
    rows = skewed(spark).groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))
    whole = co_ratings.similar_rows(rows, "user_id", "item_id", "rating", 7, metric)
    cut = co_ratings.similar_rows(rows, "user_id", "item_id", "rating", 7, metric, block_ids=10, block_entries=150)
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0
    pdf = rows.toPandas().pivot(index="user_id", columns="item_id", values="rating").fillna(0)
    m = pdf.to_numpy()
    if metric == "cosine":
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        scores = m @ m.T
    else:
        b = (m > 0).astype(float)
        scores = (b @ b.T) / (b.sum(1)[:, None] + b.sum(1)[None, :] - b @ b.T)
    ids = pdf.index.to_numpy()
    got = {(r["query_id"], r["rank"]): r["score"] for r in whole.collect()}
    for i, u in enumerate(ids):
        others = np.sort(np.round(np.delete(scores[i], i), 6))[::-1][:7]
        assert np.allclose([got[(u, r)] for r in range(1, 8)], others, atol=2e-6)


def test_blocks_and_broadcast_agree(spark, sf):
    base = embedding_vectors(spark, sf).select("id", "vec")
    queries = base.withColumnRenamed("id", "query_id")
    for metric in ("cosine", "dot", "l2"):
        a = neighbours.nearest(queries, base, 5, metric, skip_self=True)
        b = neighbours.nearest(queries, base.repartition(5), 5, metric, skip_self=True, block_rows=90)
        assert a.exceptAll(b).count() == 0 and b.count() == 2500


def test_approximate_search_recall(spark, sf):
    base = embedding_vectors(spark, sf).select("id", "vec")
    queries = base.withColumnRenamed("id", "query_id")
    exact = neighbours.nearest(queries, base, 10, skip_self=True)
    cells = neighbours.train_cells(base, 16)
    full = neighbours.nearest_in_cells(queries, base, 10, cells, probes=16, skip_self=True, block_rows=40)
    assert full.exceptAll(exact).count() == 0
    some = neighbours.nearest_in_cells(queries, base, 10, cells, probes=8, skip_self=True)
    hashed = neighbours.nearest_by_hash(queries, base, 10, tables=12, bits=4, skip_self=True, block_rows=64)
    for found in (some, hashed):
        assert metrics.neighbour_quality(found, exact, 10).first()["recall"] > 0.6


def test_svd_against_numpy(spark, sf):
    centred = linalg.mean_centre(ratings_agg(spark, sf))
    ids = ordering.dense_ids(centred, ["item_id"], "idx")
    entries = centred.join(ids, "item_id").select(F.col("user_id").alias("id"), "idx", F.col("centred").alias("value"))
    pdf = entries.toPandas()
    users = {u: i for i, u in enumerate(sorted(pdf.id.unique()))}
    m = np.zeros((len(users), 200))
    m[pdf.id.map(users), pdf.idx] = pdf.value
    want = np.linalg.svd(m, compute_uv=False)
    exact = linalg.truncated_svd(entries, 200, 8)
    sigma = [r["singular_value"] for r in exact["spectrum"].orderBy("component").collect()]
    assert np.allclose(sigma, want[:8])
    v = np.stack([np.array(r["vec"]) for r in exact["components"].orderBy("idx").collect()])
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-8)
    rows = {r["id"]: np.array(r["vec"]) for r in exact["rows"].collect()}
    assert all(np.allclose(m[i] @ v, rows[u]) for u, i in users.items())
    for path in ("broadcast", "joined"):  # one accuracy, whatever the width
        other = linalg.truncated_svd(entries, 200, 8, path=path)
        sigma = [r["singular_value"] for r in other["spectrum"].orderBy("component").collect()]
        assert np.allclose(sigma, want[:8], rtol=1e-9)
        v = np.stack([np.array(r["vec"]) for r in other["components"].orderBy("idx").collect()])
        assert np.allclose(v.T @ v, np.eye(8), atol=1e-8)
        assert np.linalg.norm(m.T @ (m @ v) - v * want[:8] ** 2, axis=0).max() < 1e-6 * want[0] ** 2


@pytest.mark.parametrize("path", ["exact", "broadcast", "joined"])
def test_svd_of_tied_values(spark, path):
    """One-hot rows: values are roots of counts, many of them equal, also at the cut."""
    counts = [7] * 5 + [6] * 30 + [5] * 40 + [3] * 10 + [1] * 15
    cells = spark.createDataFrame([(i, j, 1.0) for i, j in enumerate(np.repeat(np.arange(100), counts).tolist())], "id long, idx int, value double")
    got = [r["singular_value"] for r in linalg.truncated_svd(cells, 100, 12, path=path)["spectrum"].orderBy("component").collect()]
    assert np.allclose(got, np.sqrt(counts[:12]), atol=1e-10)


def test_svd_says_when_it_has_not_converged(spark):
    rng = np.random.default_rng(8)
    cells = spark.createDataFrame([(i, j, float(rng.normal())) for i in range(60) for j in range(40)], "id long, idx int, value double")
    with pytest.raises(RuntimeError):
        linalg.truncated_svd(cells, 40, 3, passes=1, path="broadcast")


@pytest.mark.parametrize("path", ["exact", "broadcast", "joined"])
def test_svd_of_a_matrix_of_low_rank(spark, path):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 30))
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(50) for j in range(30)], "id long, idx int, value double")
    found = linalg.truncated_svd(cells, 30, 5, path=path)
    got = [r["singular_value"] for r in found["spectrum"].orderBy("component").collect()]
    assert np.allclose(got[:2], np.linalg.svd(m, compute_uv=False)[:2]) and all(x < 1e-4 for x in got[2:])


def test_wide_svd_iterates(spark, sf, monkeypatch):
    monkeypatch.setattr(linalg, "GRAM_COLUMNS", 10)
    cells = ratings_agg(spark, sf).select(F.col("user_id").alias("id"), F.col("item_id").cast("int").alias("idx"), F.col("rating").alias("value"))
    m = np.zeros((200, 200))
    pdf = cells.toPandas()
    m[pdf.id, pdf.idx] = pdf.value
    got = linalg.truncated_svd(cells, 200, 2)["spectrum"].orderBy("component").collect()
    assert abs(got[0]["singular_value"] - np.linalg.svd(m, compute_uv=False)[0]) < 1e-8


@pytest.mark.parametrize("width, exact", [(40, True), (40, False), (8192, False)])
def test_pca_against_numpy(spark, width, exact):
    """Also wider than a covariance would fit; the mean is far from zero."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(120, 6)) @ (rng.normal(size=(6, width)) * np.array([9, 7, 5, 3, 2, 1])[:, None]) + rng.normal(size=(120, width)) / 10 + 100
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, vec array<double>").repartition(5)
    found = linalg.pca(rows, 5, exact=exact)
    c = m - m.mean(axis=0)
    want = np.linalg.svd(c, compute_uv=False) ** 2 / 119
    spectrum = found["spectrum"].orderBy("component").collect()
    assert np.allclose([r["variance"] for r in spectrum], want[:5], rtol=1e-9)
    assert np.allclose([r["ratio"] for r in spectrum], want[:5] / want.sum(), rtol=1e-9)
    v = np.stack([np.array(r["vec"]) for r in found["components"].orderBy("idx").collect()])
    got = {r["id"]: np.array(r["vec"]) for r in found["rows"].collect()}
    assert np.allclose(np.stack([got[i] for i in range(120)]), c @ v, atol=1e-6)
    if exact is False and width == 40:
        full = linalg.pca(rows, 5, whiten=True, exact=True)["rows"].collect()
        assert np.allclose(np.cov(np.stack([r["vec"] for r in full]).T), np.eye(5), atol=1e-8)


def test_diversity_walk(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(60)]
    table = spark.createDataFrame(vectors, "id long, vec array<double>")
    recs = spark.createDataFrame([(q, i, float((i * 7 + q) % 60)) for q in range(3) for i in range(60)],
                                 "query_id long, item_id long, score double")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors}
    for pool in (500, 10, 1):  # short pools leave queries for which several rounds are needed
        got = diversity.diversify_by_vectors(recs, [F.desc("score"), F.asc("item_id")], table, 8, 0.5, pool)
        lists = {}
        for r in got.orderBy("query_id", "rank").collect():
            lists.setdefault(r["query_id"], []).append(r["item_id"])
        for q in range(3):
            kept = []
            for i in sorted(range(60), key=lambda i: (-((i * 7 + q) % 60), i)):
                if len(kept) < 8 and all(unit[i] @ unit[k] <= 0.5 for k in kept):
                    kept.append(i)
            assert lists[q] == kept


def test_diversity_by_lists_in_rounds(spark):
    """An item that lists a kept one is left out; items without a vector or list clash with none."""
    rng = np.random.default_rng(3)
    close = {i: sorted(int(x) for x in rng.choice(80, 25, replace=False)) for i in range(0, 80, 2)}
    lists = spark.createDataFrame([(i, j) for i, js in close.items() for j in js], "query_id long, id long")
    recs = spark.createDataFrame([(q, i, float((i * 11 + q * 7) % 80)) for q in range(4) for i in range(80 if q else 3)],
                                 "query_id long, item_id long, score double")
    for pool in (500, 4, 1):
        got = {}
        for r in diversity.diversify_by_lists(recs, [F.desc("score"), F.asc("item_id")], lists, 9, pool).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["item_id"])
        for q in range(4):
            kept = []
            for i in sorted(range(80 if q else 3), key=lambda i: (-((i * 11 + q * 7) % 80), i)):
                if len(kept) < 9 and not set(close.get(i, [])) & set(kept):
                    kept.append(i)
            assert got[q] == kept


def test_trailing_mean_includes_both_ends(spark):
    rows = [(1, "a", f"2024-01-{d:02d} 10:00:00", float(d)) for d in (1, 2, 8, 9)]
    events = spark.createDataFrame(rows, "user_id long, genre string, ts string, rating double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    for bucket in (60, 3600, 86400):
        got = explore.trailing_mean(events, 7, bucket).orderBy("ts").collect()
        assert [r["n"] for r in got] == [1, 2, 3, 3]
        assert [round(r["mean_rating"], 6) for r in got] == [1.0, 1.5, round(11 / 3, 6), round(19 / 3, 6)]


def test_skipped_ids_do_not_shorten_lists(spark, sf):
    """120 seeds: ten others are still found, in place and in blocks, exact and within cells."""
    base = embedding_vectors(spark, sf).select("id", "vec")
    requests = base.filter("id < 120").select(F.lit(1).cast("bigint").alias("query_id"), F.col("id").alias("item_id"), F.lit(4.0).alias("rating"))
    near = collaborative.similar_to_seeds(requests, base, 10, min_similarity=-1.0).collect()
    assert len(near) == 10 and all(r["item_id"] >= 120 for r in near)
    means = collaborative.query_vectors(requests, base)
    one = neighbours.nearest(means, base, 10, skip="seeds")
    blocks = neighbours.nearest(means, base, 10, skip="seeds", block_rows=60)
    cells = neighbours.nearest_within(means.withColumn("cell", F.lit("a")), base.withColumn("cell", F.lit("a")), 10, skip="seeds")
    assert one.count() == 10 and one.exceptAll(blocks).count() == 0 and one.exceptAll(cells).count() == 0


def test_bad_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, None]), (5, [0.5, 0.5])]
    base = spark.createDataFrame(rows, "id long, vec array<double>")
    got = neighbours.nearest(base.withColumnRenamed("id", "query_id"), base, 3, skip_self=True).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(1, 5), (5, 1)]


def test_hashed_split_keeps_every_row(spark):
    rows = [(1, 1, 5.0), (2, 1, 3.0), (2, 2, 4.0)] + [(3, i, 1.0) for i in range(10)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    train, test = splits.hashed_split(ratings, ["user_id", "item_id"])
    assert train.unionByName(test).exceptAll(ratings).count() == 0 and train.count() + test.count() == len(rows)
    assert {r["user_id"] for r in test.collect()} == {2, 3} and train.filter("user_id = 1").count() == 1


def test_micros_do_not_depend_on_the_session_zone(spark):
    times = spark.createDataFrame([("2024-03-31 02:30:00.123456",), ("1969-12-31 23:59:59.5",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    want = [r[0] for r in times.select(numeric.micros(F.col("t"))).collect()]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert [r[0] for r in times.select(numeric.micros(F.col("t"))).collect()] == want == [1711852200123456, -500000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_similar_rows_leave_their_stripe_only_as_the_result(spark, monkeypatch):
    rows = skewed(spark).groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))
    whole = co_ratings.similar_rows(rows, "user_id", "item_id", "rating", 7)
    monkeypatch.setattr(co_ratings, "BEST_BYTES", 2_000)
    striped = co_ratings.similar_rows(rows, "user_id", "item_id", "rating", 7)
    plan = _plan(striped)
    assert "Window" not in plan and plan.count("MapInArrow") == 1  # nothing is ranked, so nothing sent, after the search
    assert whole.exceptAll(striped).count() == 0 and striped.exceptAll(whole).count() == 0


def test_neighbour_terms_are_summed_where_they_are_unpacked(spark, monkeypatch):
    rows = skewed(spark).groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))
    rows = session.cut_lineage(rows)
    near = session.cut_lineage(co_ratings.similar_rows(rows, "user_id", "item_id", "rating", 5))
    requests = rows.withColumnRenamed("user_id", "query_id")
    means = rows.groupBy("user_id").agg(F.avg("rating").alias("mean"))
    sums = [F.sum("sim").alias("ss"), F.sum("rating").alias("rs"), F.count("sim").alias("k")]
    got = collaborative._neighbour_sums(requests, collaborative._with_means(near, rows), rows, ["rating"], *sums)
    plan = _plan(got)
    assert plan.index("HashAggregate") < plan.index("inline") and "Exchange" not in plan[:plan.index("inline")]
    terms = near.select("query_id", F.col("id").alias("user_id"), F.col("score").alias("sim")).join(means, "user_id").join(rows, "user_id")
    want = terms.join(requests.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti").groupBy("query_id", "item_id").agg(*sums)
    monkeypatch.setattr(collaborative, "_HISTORY", 3)
    cut = collaborative._neighbour_sums(requests, collaborative._with_means(near, rows), rows, ["rating"], *sums)

    def read(df):
        return {(r["query_id"], r["item_id"]): (round(r["ss"], 6), round(r["rs"], 6), r["k"]) for r in df.collect()}

    assert read(got) == read(want) == read(cut) and read(want)


def test_small_blocks_do_not_multiply_the_copies(spark, sf, monkeypatch):
    base = embedding_vectors(spark, sf).select("id", "vec")
    sent, in_cells = [], neighbours._in_cells
    monkeypatch.setattr(neighbours, "_in_cells", lambda *a: sent.append(a[-1]) or in_cells(*a))
    monkeypatch.setattr(neighbours, "parallelism", lambda _: 4)
    queries = base.withColumnRenamed("id", "query_id")
    blocks = neighbours.nearest(queries, base, 5, "dot", skip_self=True, block_rows=2)
    assert sent == [125]  # 500 rows go to 4 x 4 tasks, not to 250 x 250
    whole = neighbours.nearest(queries, base, 5, "dot", skip_self=True)
    assert whole.exceptAll(blocks).count() == 0 and blocks.count() == 2500


def test_lists_to_evaluate_are_worked_out_once(spark, sf):
    from rankforge.plans import scoring
    for df in scoring._evaluated(spark, sf):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" in plan and not any(step in plan for step in ("Join", "Aggregate", "Window"))


def test_sums_of_neighbours_stay_where_they_are(spark):
    rows = session.cut_lineage(skewed(spark).groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating")))
    near = session.cut_lineage(co_ratings.similar_rows(rows, "user_id", "item_id", "rating", 5))
    requests = rows.withColumnRenamed("user_id", "query_id")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for lists in (collaborative.simple_user_based(requests, rows, near, 5), collaborative.user_based(requests, rows, near, 5)):
            plan = _plan(lists)
            before = plan[:plan.index("inline")]  # what comes after the terms are unpacked
            assert not any("Exchange" in line and "hashpartitioning" in line for line in before.splitlines() if "Broadcast" not in line)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("kind", ["random", "whole", "huge", "few"])
def test_screened_blocks_equal_brute_force(metric, kind, monkeypatch):
    rng = np.random.default_rng(3)
    q, v = rng.standard_normal((30, 8)), rng.standard_normal((3000, 8))
    if kind == "whole":  # many equal scores
        q, v = np.round(q), np.round(v)
    if kind == "huge":   # beyond single precision
        q, v = q * 1e30, v * 1e25
    if kind == "few":    # far from the origin: single precision tells little apart
        q, v = q * 1e-3 + 1e3, v * 1e-3 + 1e3
    q_ids, v_ids, k = np.arange(30) * 7, rng.permutation(4000)[:3000], rng.integers(0, 12, 30)
    v_ids[5] = v_ids[6]
    skip = (np.repeat(v_ids[:60], 2), np.sort(rng.integers(0, 30, 120)))
    owner, barred = np.arange(30) % 3, (rng.integers(0, 4, 500), rng.integers(0, 3000, 500))
    cells, scored = [], neighbours._scored
    monkeypatch.setattr(neighbours, "_scored", lambda a, b, *c: cells.append(len(a) * len(b)) or scored(a, b, *c))
    monkeypatch.setattr(neighbours, "STRIP_CELLS", 21_000)
    got = neighbours._block_best(q_ids, q, k, v_ids, v, metric, True, 6, skip, (owner, *barred))
    assert kind != "random" or not cells  # no score of all pairs in double precision
    a, b = (neighbours._unit(q), neighbours._unit(v)) if metric == "cosine" else (q, v)
    scores = scored(a, b, metric, 6)
    for i, r in zip(*skip):
        scores[r, v_ids == i] = -np.inf
    for o, c in zip(*barred):
        scores[owner == o, c] = -np.inf
    scores[q_ids[:, None] == v_ids[None, :]] = -np.inf
    for r in range(30):
        order = np.lexsort((v_ids, -scores[r]))[:k[r]]
        mine = got[3] == r
        assert list(got[1][mine]) == list(v_ids[order]) and np.allclose(got[2][mine], scores[r, order], rtol=1e-12, atol=1.1e-6)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_stripes_and_broadcast_agree(spark, sf, monkeypatch, metric):
    base = embedding_vectors(spark, sf).select("id", "vec")
    base = base.unionByName(base.withColumn("id", F.col("id") + 1000))  # every score twice
    queries = base.select(F.col("id").alias("query_id"), F.reverse("vec").alias("vec"), (F.col("id") % 7).alias("k"),
                          F.array(F.col("id"), F.col("id") + 1).alias("seeds"))
    whole = neighbours.nearest(queries, base, "k", metric, skip_self=True, skip="seeds").collect()
    monkeypatch.setattr(neighbours, "fits", lambda *a: False)
    monkeypatch.setattr(neighbours, "_in_cells", None)  # no query is sent to several blocks
    monkeypatch.setattr(neighbours, "STRIPE_ROWS", 100)
    monkeypatch.setattr(neighbours, "PIECE_ROWS", 64)
    striped = neighbours.nearest(queries, base, "k", metric, skip_self=True, skip="seeds").collect()
    assert sorted(striped) == sorted(whole) and len(whole) > 2000
    assert neighbours.nearest(queries.filter("k > 9"), base, 3).count() == 0


def test_what_several_seeds_must_not_get_is_sent_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(60)], "id long, vec array<double>")
    items = spark.createDataFrame([(i, i, "film", "en", f"t{i}") for i in range(60)],
                                  "item_id long, ext_id long, media_type string, spoken_languages string, title string")
    queries = spark.createDataFrame([(f"q{i % 2}", i) for i in range(40)] + [("q0", 1), (None, 3), ("q1", None)], "query_id string, item_id long")
    sent, within = [], neighbours.nearest_within
    monkeypatch.setattr(content, "nearest_within", lambda q, v, *a, **b: sent.append((q, v)) or within(q, v, *a, **b))
    got = content.similar_to_several(queries, vectors, items, 40).collect()
    lists = {q: {r["item_id"] for r in got if r["query_id"] == q} for q in ("q0", "q1")}
    assert lists["q0"] == set(range(1, 60, 2)) - {1} | set(range(40, 60)) and lists["q1"] == set(range(0, 40, 2)) | set(range(40, 60))
    asked, base = sent[0]
    assert [c for c, kind in asked.dtypes if kind.startswith("array")] == ["vec"]
    assert base.filter("cell LIKE '%|en'").agg(F.sum(F.size("barred"))).first()[0] == 41


@pytest.mark.parametrize("path", ["broadcast", "joined"])
def test_svd_of_short_rows_reads_them_once(spark, path, monkeypatch):
    """Rows of few entries, some twice, signed: an iteration goes over the sparse matrix of column products, not over the rows."""
    rng = np.random.default_rng(11)
    m, cells = np.zeros((400, 60)), []
    for i in range(400):
        for j in rng.integers(0, 60, 1 + i % 3).tolist():
            cells.append((i, j, float(rng.normal())))
            m[i, j] += cells[-1][2]

    def again(*_):
        raise AssertionError("the rows were read again")

    monkeypatch.setattr(linalg, "_times_transposed", again)
    product = linalg._joined_product
    monkeypatch.setattr(linalg, "_joined_product", lambda entries, vectors, on, to: again() if on == "id" else product(entries, vectors, on, to))
    found = linalg.truncated_svd(spark.createDataFrame(cells, "id long, idx int, value double"), 60, 6, path=path)
    got = [r["singular_value"] for r in found["spectrum"].orderBy("component").collect()]
    assert np.allclose(got, np.linalg.svd(m, compute_uv=False)[:6])
    rows = {r["id"]: np.array(r["vec"]) for r in found["rows"].collect()}
    v = np.stack([np.array(r["vec"]) for r in found["components"].orderBy("idx").collect()])
    assert all(np.allclose(m[i] @ v, rows[i]) for i in range(400))


def test_few_partitions_send_column_products(spark):
    """A partition sends a whole matrix, so there are no more of them than cores."""
    entries = spark.range(4000).select("id", (F.col("id") % 3).cast("int").alias("idx"), F.lit(1.0).alias("value")).repartition(40)
    found = linalg.truncated_svd(entries, 3, 2, path="exact")["spectrum"].orderBy("component").collect()
    assert np.allclose([r["singular_value"] ** 2 for r in found], [1334, 1333])


def test_stacked_fields_take_one_scan():
    """The width of the sparse item features: an iteration over all rows took dozens of scans."""
    assert linalg.GRAM_COLUMNS >= 3400


def test_pair_statistics_send_histories_not_matches(spark):
    """Same rows as rating by rating, with stripes of few users, repeats, nulls, odd values and long histories; no join on items."""
    rows = spark.range(4000).select(
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).alias("user_id"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(60)).alias("item_id"),
        (1 + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5))).cast("double").alias("rating"))
    rows = rows.union(spark.createDataFrame([(41, 1, None), (41, 2, 2.0), (41, 3, 5.0), (42, 1, float("nan")), (42, 2, 1.0), (43, 1, 3.0), (43, 2, 3.0),
                                             (None, 1, 2.0), (3, None, 1.0)], "user_id long, item_id long, rating double"))
    pairs = spark.range(46).toDF("user_a").crossJoin(spark.range(20).toDF("user_b"))
    pairs = pairs.union(spark.createDataFrame([(None, 1), (1, None)], "user_a long, user_b long"))

    def listed(df):
        return sorted((r["user_a"], r["user_b"], r["common"], None if r["correlation"] is None else "nan" if r["correlation"] != r["correlation"] else round(r["correlation"], 9) + 0.0)
                      for r in df.collect())

    want = listed(co_ratings._joined_statistics(pairs, rows))
    assert len(want) > 500
    turned = pairs.select(F.col("user_b").alias("user_a"), F.col("user_a").alias("user_b"))
    assert listed(co_ratings.pair_statistics(pairs, rows, 100, 1000)) == want
    assert listed(co_ratings.pair_statistics(turned, rows, stripe_entries=1000)) == listed(co_ratings._joined_statistics(turned, rows))
    fine = rows.filter("user_id < 40 AND item_id IS NOT NULL")
    assert "item_id" not in "".join(x for x in co_ratings.pair_statistics(pairs, fine)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)


def test_rows_meet_a_block_in_bounded_memory():
    """What a task holds beside entries and results must not follow the products of a block (hundreds of MB here before)."""
    rng = np.random.default_rng(3)
    dims = np.concatenate([rng.choice(2500, 50, replace=False) for _ in range(4000)])
    cells = pa.table({"id": np.repeat(np.arange(4000), 50), "dim": dims, "val": rng.integers(1, 6, 200_000).astype(float)})
    parts = co_ratings._packed_block((pa.scalar(0),), cells, "cosine", 1 << 22).to_batches()
    packed = [{name: batch[name][i].as_buffer() for name, _ in co_ratings._FIELDS} for batch in parts for i in range(batch.num_rows)]
    tracemalloc.start()
    try:
        stripe = co_ratings._met([packed], 20, "cosine", 6)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6 and (stripe.count == 20).all()
    dense = np.zeros((4000, 2500))
    dense[cells["id"].to_numpy(), dims] = cells["val"].to_numpy()
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    scores = dense @ dense.T
    np.fill_diagonal(scores, -1)
    assert np.allclose(np.sort(stripe.best_raw, axis=1), np.sort(scores, axis=1)[:, -20:], atol=1e-6)


@pytest.mark.parametrize("kind", ["flat", "steep", "low rank"])
def test_small_wide_svd_is_filtered(spark, kind, monkeypatch):
    """A wide matrix that is small as a whole is sent, and no pass goes over its rows; also with a leading value far above the others."""
    monkeypatch.setattr(linalg, "GRAM_COLUMNS", 20)

    def again(*_):
        raise AssertionError("an iteration went over the rows")

    for name in ("_times_transposed", "_distributed_svd"):
        monkeypatch.setattr(linalg, name, again)
    rng = np.random.default_rng(5)
    m = np.where(rng.random((150, 90)) < 0.3, rng.normal(size=(150, 90)), 0.0)
    m[:, 7] = 0
    if kind == "steep":
        m += 300 * np.outer(rng.normal(size=150), rng.normal(size=90))
    elif kind == "low rank":
        m = rng.normal(size=(150, 8)) @ rng.normal(size=(8, 90))
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "id long, idx int, value double")
    found = linalg.truncated_svd(cells, 90, 6)
    want = np.linalg.svd(m, compute_uv=False)
    got = [r["singular_value"] for r in found["spectrum"].orderBy("component").collect()]
    assert np.allclose(got, want[:6], rtol=1e-9)
    v = np.stack([np.array(r["vec"]) for r in found["components"].orderBy("idx").collect()])
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-8)
    assert np.linalg.norm(m.T @ (m @ v) - v * want[:6] ** 2, axis=0).max() < 1e-6 * want[0] ** 2
    rows = {r["id"]: np.array(r["vec"]) for r in found["rows"].collect()}
    assert all(np.allclose(m[i] @ v, rows[i]) for i in range(150))
    with pytest.raises(RuntimeError):
        linalg.truncated_svd(cells, 90, 6, passes=1)


def test_exact_svd_of_short_rows_builds_no_dense_products(spark, monkeypatch):
    """Columns in parts that no row links, some empty; a matrix of column products as wide as the columns took minutes."""
    def dense(*_):
        raise AssertionError("dense products")

    rng = np.random.default_rng(12)
    m = np.zeros((300, 50))
    for i in range(300):
        m[i, rng.choice(5, 2) + 5 * rng.integers(0, 9)] = rng.normal(size=2)
    cells = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    frame = spark.createDataFrame(cells, "id long, idx int, value double")
    with monkeypatch.context() as patch:
        patch.setattr(linalg, "_column_products", dense)
        found = linalg.truncated_svd(frame, 50, 8, path="exact")
        got = [r["singular_value"] for r in found["spectrum"].orderBy("component").collect()]
    v = np.stack([np.array(r["vec"]) for r in found["components"].orderBy("idx").collect()])
    assert np.allclose(got, np.linalg.svd(m, compute_uv=False)[:8]) and np.allclose(v.T @ v, np.eye(8))
    assert np.allclose(m.T @ (m @ v), v * np.array(got) ** 2)
    monkeypatch.setattr(linalg, "SMALL_BYTES", 0)  # also where the products are too many to be brought to the driver
    monkeypatch.setattr(linalg, "fits", lambda *_: False)
    again = linalg.truncated_svd(frame, 50, 8, path="exact")["spectrum"].orderBy("component").collect()
    assert np.allclose([r["singular_value"] for r in again], got)


def test_blocks_travel_in_small_records(spark, monkeypatch):
    """A task gets 10,000 records at a time: one record a block made that a whole table. Cut anywhere, in batches of any length, they give the same."""
    rows = session.cut_lineage(skewed(spark).groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating")))
    whole = sorted(co_ratings.similar_rows(rows, "user_id", "item_id", "rating", 7).collect())
    assert co_ratings.RECORD_ENTRIES <= 1024
    monkeypatch.setattr(co_ratings, "RECORD_ENTRIES", 3)
    monkeypatch.setattr(co_ratings, "MEET_ENTRIES", 50)
    monkeypatch.setattr(co_ratings, "MEET_CELLS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        cut = sorted(co_ratings.similar_rows(rows, "user_id", "item_id", "rating", 7, block_ids=10, block_entries=150).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == whole
