"""Hand-made rows for parsing, cleaning and number rules."""

from pyspark.sql import functions as F

from rankforge.functions import nested, numeric, text, vectors as vx
from rankforge.operators import cleaning, features


def column(spark, rows, kind, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_clean_text(spark):
    rows = [None, "", "  ", "Hé, wörld!\t\tFoo_1", "A-b  c"]
    assert column(spark, rows, "string", text.clean_text) == ["unknown", "unknown", "", "hé wörld foo_1", "ab c"]
    assert column(spark, ["a, B!", " "], "string", text.clean_text_keep_commas) == ["a, b", "Unknown"]


def test_list_fields(spark):
    assert column(spark, [" Drama ,  Crime", None, " "], "string", text.clean_list_field) == ["drama,crime", "unknown", "unknown"]
    assert column(spark, ["A|B;;C, ,", ", x"], "string", text.clean_multi_delimiter) == ["A,B,C", "x"]
    names = ";".join(f"n{i}" for i in range(25)) + "|  ,"
    assert column(spark, [names], "string", lambda c: F.size(text.first_names(c, 20))) == [20]
    assert column(spark, [None], "string", lambda c: F.size(text.name_list(c))) == [0]


def test_json(spark):
    rows = ['["a","b"]', '[{"name":" a "}]', "['a','b']", "", None, "plain   text", '[{"iso_639_1":"en"}]', "[]"]
    assert column(spark, rows, "string", nested.coerce_names) == ["a, b", "a", "a, b", "", "", "plain text", "en", ""]
    rows = ['{"a":1}{"a":2}', "[{'a': 3}]", "free text", '[{"a":4}][{"a":5}]']
    parsed = column(spark, rows, "string", lambda c: nested.repair_json_list(c, "struct<a:int>")["a"])
    assert parsed[0] == [1, 2] and parsed[1] == [3] and parsed[2] == []


def test_release_year(spark):
    rows = ["2001-05-04T00:00:00Z", '{"$date":"1999-01-02T00:00:00Z"}', '{"$date":{"$numberLong":"-86400000"}}', "bad", None]
    assert column(spark, rows, "string", nested.release_year) == [2001, 1999, 1969, None, None]


def test_roles(spark):
    rows = [[("director", "A"), ("creator", "B"), ("cast", "C"), ("other", "D"), ("director", None), ("cast", " ")]]
    kind = "array<struct<type:string,name:string>>"
    assert column(spark, rows, kind, nested.role_names) == ["A, B"]
    assert column(spark, rows, kind, lambda c: nested.role_names(c, ("cast",))) == ["C"]


def test_years_take_the_smallest_mode(spark):
    rows = [("1899",), ("2026",), ("unknown",), ("",), (None,), ("2001",), ("2001",), ("1999",), ("1999",)]
    df = spark.createDataFrame(rows, "release_year string")
    assert [r[0] for r in cleaning.impute_years(df).collect()] == [1999] * 5 + [2001, 2001, 1999, 1999]
    empty = spark.createDataFrame([("x",)], "release_year string")
    assert cleaning.impute_years(empty).first()[0] == 2000


def test_numbers(spark):
    assert column(spark, [10.26, -1.0, 7.25], "double", numeric.clip_round) == [10.0, 0.0, 7.2]
    assert column(spark, [2.675, 2.6749999999999998], "double", lambda c: numeric.steady_round(c, 2)) == [2.68, 2.68]
    parts = column(spark, [4, 5, 11, 12, 17, 21, 22], "int", numeric.daypart)
    assert parts == ["Night", "Morning", "Morning", "Afternoon", "Evening", "Evening", "Night"]
    assert column(spark, [1.0], "double", lambda c: numeric.z_score(c, F.lit(1.0), F.lit(0.0))) == [0.0]


def test_vectors(spark):
    rows = [[3.0, 4.0], [0.0, 0.0]]
    assert column(spark, rows, "array<double>", lambda c: vx.l2_normalise(c)) == [[0.6, 0.8], [0.0, 0.0]]
    assert column(spark, [[1.0, float("nan")], [1.0, 2.0]], "array<double>", vx.has_bad_value) == [True, False]


def test_bigrams_skip_stop_words(spark):
    docs = spark.createDataFrame([(1, "the Cat and the hat a"), (2, "")], "item_id long, t string")
    terms = {r["term"]: r["tf"] for r in features.term_counts(docs, "t", ["the", "and"]).collect()}
    assert terms == {"cat": 1, "hat": 1, "cat hat": 1}


def test_filter_recommendations_strict(spark):
    recs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_id long")
    rows = [(1, "movie", "en,fr"), (2, "movie", ""), (3, "tv", "en"), (4, "movie", "de")]
    items = spark.createDataFrame(rows, "item_id long, media_type string, spoken_languages string")
    loose = cleaning.filter_recommendations(recs, items, "string", ["string"])
    assert sorted(r[0] for r in loose.collect()) == [1, 2]
    strict = cleaning.filter_recommendations(recs, items, None, ["EN"], strict=True)
    assert [r[0] for r in strict.collect()] == [1]
