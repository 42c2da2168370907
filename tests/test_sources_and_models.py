"""Sources, sinks, saved models, factor models and streaming."""

import json
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankforge import sources
from rankforge.functions.text import clean_text
from rankforge.operators import cleaning, collaborative, factors, features, hybrid, metrics
from rankforge.plans import scoring
from rankforge.sources import ratings_agg, table
from rankforge.streaming import register_stream


def test_round_trips(spark, sf, tmp_path):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    schema = "p_partkey long, p_name string"
    for kind in ("csv", "json", "parquet", "orc", "xlsx"):
        path = sources.save_table(part, str(tmp_path), f"part_{kind}", kind)
        back = sources.load_table(spark, path, schema)
        assert back.exceptAll(part).count() == 0 and back.count() == part.count()
    with pytest.raises(ValueError):
        sources.save_table(part.filter("false"), str(tmp_path), "none")
    with pytest.raises(ValueError):
        sources.load_table(spark, str(tmp_path / "x.feather"))
    with pytest.raises(FileNotFoundError):
        sources.load_table(spark, str(tmp_path / "missing.parquet"))


def test_json_array_and_sets(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps([{"id": 1, "genres": [{"id": 1, "name": "Drama"}]}, {"id": 2}]))
    found = sources.load_many(spark, str(tmp_path), {"items": "items.json"})["items"]
    assert found.count() == 2
    paths = sources.save_many({"a": found, "b": found}, str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(paths["b"]).count() == 2


ODD = ["}", "{", '"', "\\", "\\\\}", "\n", "é😀", "[", "]", '{"a": 1}', "", "word " * 90, '}{"\\' * 150]


@pytest.mark.parametrize("size", ["300", "128m"])
@pytest.mark.parametrize("layout", [{}, {"indent": 2, "ensure_ascii": False}])
def test_json_array_in_parts(spark, tmp_path, size, layout):
    """Objects and strings that lie across byte ranges, braces and quotes inside strings, nested objects."""
    rows = [{"id": i, "text": ODD[i % len(ODD)] + ODD[i * 5 % len(ODD)], "more": {"names": [{"n": ODD[i * 3 % len(ODD)]}] * (i % 3)}} for i in range(60)]
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(rows, **layout), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        elements = sources.json_array_elements(spark, str(path))
        assert sorted((json.loads(r["value"]) for r in elements.collect()), key=lambda r: r["id"]) == rows
        if size == "300":
            assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
            return
        one = sources.load_json_array(spark, str(path))
        for schema in (one.schema, None):
            many = sources.load_json_array(spark, str(path), schema, in_parts=True)
            assert many.schema == one.schema and sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_json_array_in_parts_of_odd_files(spark, tmp_path):
    texts = {"none": "", "empty": "[]", "two": '[{"a": 1}]\n[{"a": 2}, 3, null]', "mark": '\ufeff[{"a": 1}]', "bare": '{"a": 1}', "open": '[{"a": 1}, {"a": "}]'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    found = {name: sorted(r["a"] for r in sources.load_json_array(spark, str(tmp_path / f"{name}.json"), "a int", in_parts=True).collect())
             for name in texts if name != "open"}
    assert found == {"none": [], "empty": [], "two": [1, 2], "mark": [1], "bare": [1]}
    with pytest.raises(Exception, match="not an array of JSON objects"):
        sources.load_json_array(spark, str(tmp_path / "open.json"), "a int", in_parts=True).collect()


def test_feature_model_survives_saving(spark, sf, tmp_path):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("overview"), F.array("lang", "source").alias("genres"),
        F.concat_ws(" ", "lang", "source").alias("keywords"), F.array("source", "lang").alias("cast"), F.array("source").alias("director"))
    model, rows = features.fit_field_model(docs, ["the"])
    sources.save_model_tables(model, str(tmp_path / "model"))
    loaded = sources.load_model_tables(spark, str(tmp_path / "model"), list(model))
    again = features.apply_field_model(docs, loaded, ["the"])
    off = rows.withColumnRenamed("vec", "a").join(again, "id").select(
        F.array_max(F.transform(F.arrays_zip("a", "vec"), lambda x: F.abs(x["a"] - x["vec"]))).alias("d"))
    assert off.count() == docs.count() and off.agg(F.max("d")).first()[0] < 1e-9


def test_factor_model(spark, sf, tmp_path):
    rows = ratings_agg(spark, sf)
    model = factors.factorise(rows, rank=8, reg=0.1, iterations=(2, 4))
    history = model.pop("history").collect()
    assert history and all(h["train_rmse"] < 1.5 for h in history)
    sources.save_model_tables(model, str(tmp_path / "mf"))
    loaded = sources.load_model_tables(spark, str(tmp_path / "mf"), list(model))
    a = metrics.prediction_errors(factors.predict(rows, model), default=3.0).first()["rmse"]
    b = metrics.prediction_errors(factors.predict(rows, loaded), default=3.0).first()["rmse"]
    assert abs(a - b) < 1e-9 and a < 1.5


def test_hybrid_switch(spark):
    schema = "query_id long, item_id long, score double"
    item = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0), (2, 10, 3.0)], schema)
    user = spark.createDataFrame([(1, 11, 5.0), (1, 12, 3.0)], schema)
    content = spark.createDataFrame([(3, 20, 0.5), (3, 20, 0.9), (1, 21, 0.9)], schema)
    counts = spark.createDataFrame([(1, 4), (2, 0), (3, 0)], "query_id long, n_ratings long")
    got = {(r["query_id"], r["item_id"]): r["score"] for r in hybrid.switching_hybrid(item, user, content, counts).collect()}
    assert got == {(1, 10): 0.6, (1, 11): -0.2, (1, 12): -0.4, (2, 10): 0.0, (3, 20): 0.9}


def test_known_ranking_metrics(spark):
    recs = spark.createDataFrame([(1, i, r) for r, i in enumerate((7, 8, 9), 1)], "user_id long, item_id long, rank int")
    truth = spark.createDataFrame([(1, 8, 4.0), (1, 5, 2.0), (2, 7, 1.0)], "user_id long, item_id long, rating double")
    rows = {r["user_id"]: r for r in metrics.ranking_metrics(recs, truth, 2).collect()}
    assert rows[1]["precision"] == 0.5 and rows[1]["recall"] == 0.5 and rows[1]["f1"] == 0.5 and rows[1]["hit_rate"] == 1
    assert abs(rows[1]["ndcg"] - (4 / 1.584962500721156) / (4 + 2 / 1.584962500721156)) < 1e-9
    assert rows[2]["ndcg"] == 0.0
    summary = metrics.summarise_metrics(metrics.ranking_metrics(recs, truth, 2), recs).first()
    assert summary["users"] == 2 and summary["success_rate"] == 0.5


def test_requests_are_checked(spark):
    rows = [([1, 2], [3.0], 5), ([1], [6.0], 5), ([1], [5.0], 0), ([1], [0.0], 100)]
    df = spark.createDataFrame(rows, "item_ids array<long>, ratings array<double>, n int")
    assert [r["problem"] for r in cleaning.check_requests(df).collect()] == ["length", "rating", "n", None]


def test_cold_and_guest(spark, sf):
    rows = ratings_agg(spark, sf)
    cold = collaborative.cold_start(spark.range(3).withColumnRenamed("id", "query_id"), rows, 4)
    assert cold.count() == 12 and cold.select("item_id").distinct().count() == 4


def test_stream_equals_batch(spark, tmp_path):
    schema = "ext_id long, media_type string, text string"
    first = [(i, "m", f"Text, {i}") for i in range(5)]
    second = [(i, "m", f"Text, {i}") for i in range(3, 9)]
    shape = lambda b: b.select("ext_id", "media_type", clean_text(F.col("text")).alias("overview"))

    def run(name, batches):
        folder = tmp_path / name
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            arrivals = spark.readStream.schema(schema).parquet(str(folder / "in"))
            register_stream(arrivals, str(folder / "items"), str(folder / "progress"), ["ext_id", "media_type"], shape).awaitTermination()
        return spark.read.parquet(str(folder / "items")).select("ext_id", "media_type", "item_id", "overview")

    stream, batch = run("two", [first, second]), run("one", [first + second])
    assert sorted(stream.collect()) == sorted(batch.collect()) and stream.count() == 9
    before = sorted(stream.collect())
    # Nothing new has arrived: another run of the same job changes nothing.
    arrivals = spark.readStream.schema(schema).parquet(str(tmp_path / "two" / "in"))
    register_stream(arrivals, str(tmp_path / "two" / "items"), str(tmp_path / "two" / "progress"),
                    ["ext_id", "media_type"], shape).awaitTermination()
    after = spark.read.parquet(str(tmp_path / "two" / "items")).select("ext_id", "media_type", "item_id", "overview")
    assert sorted(after.collect()) == before


def test_batch_that_runs_twice_leaves_one_copy(spark, tmp_path):
    schema = "ext_id long, media_type string, overview string"
    spark.createDataFrame([(i, "m", "x") for i in range(4)], schema).write.parquet(str(tmp_path / "in"))

    def run():
        arrivals = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        # A new progress folder makes the same batch number run again.
        register_stream(arrivals, str(tmp_path / "items"), str(tmp_path / f"progress{len(seen)}"),
                        ["ext_id", "media_type"]).awaitTermination()
        seen.append(sorted(spark.read.parquet(str(tmp_path / "items")).select("ext_id", "item_id").collect()))

    seen = []
    run()
    run()
    assert seen[0] == seen[1] and len(seen[0]) == 4


SHAPE = "ext_id long, media_type string, overview string"


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def _register(spark, folder, **more):
    arrivals = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    return register_stream(arrivals, str(folder / "items"), str(folder / "progress"), ["ext_id", "media_type"], **more)


def _held(spark, folder):
    return sorted(tuple(r) for r in spark.read.parquet(str(folder / "items")).select("ext_id", "media_type", "item_id", "overview").collect())


def test_batches_never_read_the_item_table(spark, tmp_path):
    """Seen keys live in the stream's state and the last id in its ledger: with the table gone both still hold."""
    for k in range(3):
        _arrive(spark, tmp_path, [(i, "m", f"text {i} of batch {k}") for i in range(2 * k, 2 * k + 4)])
        _register(spark, tmp_path).awaitTermination()
    assert [(r[0], r[2]) for r in _held(spark, tmp_path)] == [(i, i + 1) for i in range(8)]
    for path in (tmp_path / "items").glob("batch_id=*"):
        path.rename(tmp_path / f"gone-{path.name}")
    _arrive(spark, tmp_path, [(7, "m", "again"), (8, "m", "new"), (8, "m", None), (8, "m", "later"), (None, "m", "no key"), (9, None, "no kind")])
    _register(spark, tmp_path).awaitTermination()
    assert _held(spark, tmp_path) == [(8, "m", 9, "later")]  # the smallest row of the key, nulls last


def test_failed_batch_is_replayed_with_the_same_ids(spark, tmp_path):
    from pyspark.errors import StreamingQueryException
    _arrive(spark, tmp_path, [(i, "m", "x") for i in range(5)])
    _register(spark, tmp_path).awaitTermination()
    _arrive(spark, tmp_path, [(i, "m", "y") for i in range(3, 9)])

    def broken(new):
        raise ValueError("no features")

    with pytest.raises(StreamingQueryException):
        _register(spark, tmp_path, features=broken, vectors_path=str(tmp_path / "vec")).awaitTermination()
    names = lambda new: features.hash_names(new, F.array("overview"), 10, signed=False)
    _register(spark, tmp_path, features=names, vectors_path=str(tmp_path / "vec")).awaitTermination()
    assert [(r[0], r[2], r[3]) for r in _held(spark, tmp_path)] == [(i, i + 1, "x" if i < 5 else "y") for i in range(9)]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "vec")).collect()) == [6, 7, 8, 9]


def test_large_vocabulary_is_joined_by_term(spark, monkeypatch):
    """50,000 terms, one of them in every document: the same entries as with a broadcast vocabulary."""
    docs = spark.range(1000).select(F.col("id").alias("item_id"), F.concat(
        F.lit("everywhere "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.concat(F.lit("w"), (F.col("id") % 500) * 100 + k)), " ")).alias("text"))
    vocabulary, small = features.fit_apply_tfidf(docs, "text", 60_000, bigrams=False)
    vocabulary, small = vocabulary.cache(), small.cache()
    assert vocabulary.count() == 50_001
    monkeypatch.setattr(features, "fits", lambda df, size: False)
    counts = features.term_counts(docs, "text", bigrams=False)
    large = features.tfidf_entries(counts, vocabulary)
    assert "_salt" in large._jdf.queryExecution().toString()
    rounded = [df.select("id", "idx", "term", F.round("value", 9).alias("v")) for df in (small, large)]
    assert rounded[0].count() == 101_000 and rounded[0].exceptAll(rounded[1]).count() == 0
    assert vocabulary.filter("term = 'everywhere'").first()["df"] == 1000
    vocabulary.unpersist()
    small.unpersist()


def test_json_ranges_are_worked_on_in_small_runs(monkeypatch):
    """A batch of many rows is not marked up as one text; the objects are the same, also across the cuts."""
    from rankforge.sources import json_parts as jp
    text = json.dumps([{"id": i, "text": ODD[i % len(ODD)] + ODD[i * 5 % len(ODD)]} for i in range(300)]).encode()
    pieces = text.split(b"}")
    n = len(pieces)

    def batch(more):
        return pa.RecordBatch.from_pydict({"file": ["f"] * n, "at": [0] * n, "piece": pa.array(pieces, pa.binary()), **more})

    def found(run_bytes):
        monkeypatch.setattr(jp, "RUN_BYTES", run_bytes)
        sizes = [len(t) for _, _, _, t in jp._runs(batch({}))]
        out = jp._objects(iter([batch({"inside": [False] * n, "depth": [0] * n, "owner": pa.array([None] * n, pa.int64())})]))
        rows = [r for b in out for r in b.to_pylist()]
        return sizes, [r.to_pylist() for r in jp._summaries(iter([batch({})]))], [(r["owner"], json.loads(r["value"])) for r in rows]

    whole, parts = found(1 << 30), found(200)
    assert len(whole[0]) == 1 and max(parts[0]) <= 200 + max(map(len, pieces)) + 1 and len(parts[0]) > 20
    assert whole[1:] == parts[1:] and len(whole[2]) == 300 and sum(parts[0]) == len(text) + 1


def test_terms_are_counted_where_the_texts_lie(spark, monkeypatch):
    """No (id, term) row is sent or written; texts of one id, or of none, still count together, in as many partitions as they need."""
    rows = [(i % 7 if i % 5 else None, f"alpha beta word{i % 4} alpha" if i % 6 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "item_id long, text string")
    want = {}
    for key, text in rows:
        words = (text or "").split()
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            want[key, term] = want.get((key, term), 0) + 1
    monkeypatch.setattr(features, "PART_BYTES", 64)
    counts = features.term_counts(docs, "text")
    assert {(r["id"], r["term"]): r["tf"] for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().sparkPlan().toString() + counts._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "term#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert docs.count() and features._by_id(docs.select(F.col("item_id").alias("id"), F.col("text").alias("_text"))).rdd.getNumPartitions() > 8
    few = spark.createDataFrame([("alpha",), ("beta word1",)], "term string")
    assert {(r["id"], r["term"]): r["tf"] for r in features.term_counts(docs, "text", only=few).collect()} == {
        k: v for k, v in want.items() if k[1] in ("alpha", "beta word1")}
    vocabulary, entries = features.fit_apply_tfidf(docs, "text", 5)
    assert {(r["id"], r["term"]) for r in entries.collect()} == {k for k in want if k[1] in {r["term"] for r in vocabulary.collect()}}


def test_streams_read_a_folder_of_files_like_one_file(spark, tmp_path):
    """A large table is a folder of files: a stream that looks for one file of the table's name finds nothing in it."""
    docs = spark.createDataFrame([(i, f"Text, {i}!", "en", f"src{i % 3}", 8) for i in range(30)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/many/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "part").glob("part-*.parquet")), tmp_path / "one" / "documents.parquet")
    for run in (scoring.register_items_stream, scoring.register_stream_features):
        many, one = (sorted(run(spark, f"{tmp_path}/{d}").collect()) for d in ("many", "one"))
        assert many == one and len(many) == 30
    assert sorted(r["item_id"] for r in scoring.register_items_stream(spark, f"{tmp_path}/many/").collect()) == list(range(1, 31))
