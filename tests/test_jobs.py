"""End-to-end jobs on derived reports."""

from checks import queries as Q
from gradeloom.plans.comparing import run_comparison
from gradeloom.plans.extraction import run_extraction
from gradeloom.plans.settings import Settings
from gradeloom.plans.training import run_full
from gradeloom.sources import artefacts
from tests.conftest import SF

SMALL = Settings(max_features=60, rounds=2, trees=5, forest_depth=5, max_iter=5,
                 models=("logistic_regression", "random_forest", "svm"))


def test_extract_train_compare(spark, tmp_path):
    folder = str(tmp_path)
    merged = run_extraction(spark, Q.ultrasound_raw(spark, SF), Q.operative_raw(spark, SF), folder)
    assert merged.count() == 1099
    result = run_full(spark, merged, folder, SMALL).collect()
    assert len(result) == 1
    assert result[0]["method"] == "Best Model"
    # 1099 rows: ceil(0.15 * 1099) of them are the test set.
    assert result[0]["sample_size"] == 165
    predictions = spark.read.parquet(f"{folder}/final/predictions").collect()
    hits = sum(r["label"] == r["prediction"] for r in predictions)
    assert len(predictions) == 165 and abs(hits / 165 - result[0]["accuracy"]) < 1e-6
    report = spark.read.parquet(f"{folder}/final/class_report").collect()
    assert sum(r["support"] for r in report) == 165
    vote = artefacts.load_model(spark, f"{folder}/models/ensemble")
    assert set(vote.members) == set(SMALL.models)
    assert artefacts.best_model(spark, f"{folder}/models") in {*SMALL.models, "ensemble"}
    # The label is a rule over the text, so a model must beat the largest class (29 %).
    assert result[0]["accuracy"] > 0.6
    answers = Q.answers(spark, SF).select("report_id", "response")
    rows = {r["Method"]: r for r in run_comparison(
        spark, folder, gold=Q.gold(spark, SF), responses=answers, model="random_forest", settings=SMALL).collect()}
    assert set(rows) == {"Random Forest", "Manual Extraction", "Responder"}
    assert rows["Responder"]["Sample Size"] == 103
    assert rows["Manual Extraction"]["AUC-ROC"] == "N/A"
    only = run_comparison(spark, folder, model="ensemble", settings=SMALL).collect()
    assert [r["Method"] for r in only] == ["Ensemble"]
    assert run_comparison(spark, folder, settings=SMALL).count() == 1


def test_extraction_without_operative_reports(spark, tmp_path):
    none = Q.operative_raw(spark, SF).filter("1 = 0")
    assert run_extraction(spark, Q.ultrasound_raw(spark, SF), none, str(tmp_path)) is None
