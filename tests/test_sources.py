"""Readers and writers."""

from gradeloom.operators.reports import parse_ultrasound
from gradeloom.operators.tfidf import fit_tfidf
from gradeloom.sources import artefacts, corpus, tables


def test_report_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.b+c%20 CASE-AB1-7.txt").write_text("IMPRESSION: normal\n\nmore")
    (tmp_path / "deep" / "er" / "two.txt").write_text("  \n ")
    (tmp_path / "deep" / "skip.md").write_text("no")
    files = corpus.read_report_files(spark, str(tmp_path))
    rows = {r["report_id"]: r["report_text"] for r in files.collect()}
    assert rows == {"a.b+c%20 CASE-AB1-7": "IMPRESSION: normal\n\nmore", "two": "  \n "}
    parsed = parse_ultrasound(files).collect()
    assert [(r["case_id"], r["severity_grade"]) for r in parsed] == [("CASE-AB1-7", "Normal")]


def test_report_table(spark):
    df = spark.createDataFrame([(7, "x")], "n int, body string")
    assert tuple(corpus.read_report_table(df, "n", "body").first()) == ("7", "x")


def test_csv_round_trip_of_multiline_text(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi",\nnow', ["x", "y"], 1.5), ("b", None, [], None)],
                               "id string, t string, k array<string>, d double")
    path = f"{tmp_path}/t"
    assert tables.write_table(df, path, "csv")
    back = tables.read_table(spark, path, "csv")
    rows = {r["id"]: tuple(r)[1:] for r in back.collect()}
    assert rows["a"] == ('say "hi",\nnow', "x,y", 1.5)
    assert rows["b"][0] is None and rows["b"][2] is None
    typed = tables.read_table(spark, path, "csv", "id string, t string, k string, d double")
    assert typed.schema["d"].dataType.typeName() == "double"


def test_missing_and_empty_tables(spark, tmp_path):
    assert tables.read_table(spark, f"{tmp_path}/none") is None
    assert tables.read_table(spark, f"{tmp_path}/none", "csv") is None
    assert tables.write_table(None, f"{tmp_path}/x") is False
    assert tables.write_table(spark.range(0), f"{tmp_path}/x") is False
    assert tables.read_table(spark, f"{tmp_path}/x") is None


def test_splits_are_pruned_by_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    labels = spark.createDataFrame([("a", 0)], "label string, label_encoded int")
    tables.write_splits(df, labels, str(tmp_path))
    test = tables.read_split(spark, str(tmp_path), "test")
    assert [r["id"] for r in test.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()


def test_features_stay_sparse_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red wall"), (2, "red wall sky"), (3, "blue")], "id int, t string")
    model = fit_tfidf(docs, "t", max_df=1.0)
    artefacts.save_tfidf(spark, model, f"{tmp_path}/m")
    loaded = artefacts.load_tfidf(spark, f"{tmp_path}/m")
    assert loaded == model
    tables.write_features(loaded.transform(docs, "t"), str(tmp_path))
    back = tables.read_features(spark, str(tmp_path))
    assert {type(r["tfidf"]).__name__ for r in back.collect()} == {"SparseVector"}
    assert tables.read_features(spark, f"{tmp_path}/none") is None


def test_evaluation_files(spark, tmp_path):
    df = spark.createDataFrame([("Random Forest", 0.5)], "method string, accuracy double")
    tables.write_evaluation(df, df, str(tmp_path))
    assert (tmp_path / "results" / "name=random_forest").is_dir()
    assert spark.read.option("header", True).csv(f"{tmp_path}/comparison").count() == 1


def test_balanced_scan(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/p")
    assert tables.balanced(spark.read.parquet(f"{tmp_path}/p")).rdd.getNumPartitions() == 8
