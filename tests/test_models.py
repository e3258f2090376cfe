"""Classifiers on a small separable problem."""

import random

import pytest
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gradeloom.operators import models
from gradeloom.sources import artefacts


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(240):
        y = i % 3
        data.append((f"r{i}", float(y), [(2.0 if y == c else 0.0) + rng.random() for c in range(3)] + [rng.random()]))
    df = spark.createDataFrame(data, "id string, label double, a array<double>").coalesce(2)
    return df.select("id", "label", array_to_vector("a").alias("features")).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    every = models.make_estimators(rows.count(), rounds=3, trees=5, forest_depth=4, max_iter=15)
    assert tuple(every) == models.MODEL_NAMES
    return models.fit_models(every, rows)


def test_every_model_learns_and_gives_probabilities(rows, fitted):
    scored = models.soft_vote(models.score_all(fitted, rows), list(fitted)).cache()
    scores = {r["method"]: r["accuracy"] for r in
              models.validation_scores(scored, [*fitted, "ensemble"]).collect()}
    assert set(scores) == {*models.MODEL_NAMES, "ensemble"}
    assert all(a > 0.9 for a in scores.values()), scores
    for name in [*fitted, "ensemble"]:
        total = F.aggregate(f"{name}_probability", F.lit(0.0), lambda a, x: a + x)
        low, high, width = scored.select(total.alias("t"), F.size(f"{name}_probability").alias("w")).agg(
            F.min("t"), F.max("t"), F.max("w")).first()
        assert abs(low - 1) < 1e-9 and abs(high - 1) < 1e-9 and width == 3
    # The vote is the mean of the members.
    row = scored.first()
    mean = [sum(row[f"{n}_probability"][c] for n in fitted) / len(fitted) for c in range(3)]
    assert row["ensemble_probability"] == pytest.approx(mean)


def test_fits_repeat_by_seed(rows, fitted):
    again = models.fit_models(
        {"random_forest": models.make_estimators(rows.count(), trees=5, forest_depth=4)["random_forest"]}, rows)
    a = fitted["random_forest"].transform(rows).select("id", "random_forest_probability").orderBy("id").collect()
    b = again["random_forest"].transform(rows).select("id", "random_forest_probability").orderBy("id").collect()
    assert a == b


def test_save_and_load(spark, rows, fitted, tmp_path):
    for name in ("random_forest", "svm"):
        artefacts.save_model(spark, fitted[name], f"{tmp_path}/{name}")
        loaded = artefacts.load_model(spark, f"{tmp_path}/{name}")
        column = f"{name}_probability"
        a = fitted[name].transform(rows).select("id", column).orderBy("id").collect()
        b = loaded.transform(rows).select("id", column).orderBy("id").collect()
        assert [r[column] for r in a] == [pytest.approx(r[column]) for r in b]


def test_multinomial_option(rows):
    one = models.make_estimators(rows.count(), max_iter=10, multinomial=True)["logistic_regression"]
    scored = models.fit_model("logistic_regression", one, rows).transform(rows)
    assert models.validation_scores(scored, ["logistic_regression"]).first()["accuracy"] > 0.9


def test_first_of_equals_wins(spark):
    scores = spark.createDataFrame([("b", 0.5, 1), ("a", 0.5, 0), ("c", 0.0, 2)], "method string, accuracy double, fit_order int")
    assert models.select_best(scores) == "a"
    zeros = spark.createDataFrame([("b", 0.0, 1), ("a", 0.0, 0)], "method string, accuracy double, fit_order int")
    assert models.select_best(zeros) == "a"


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>")
    assert df.select(models.argmax("p")).first()[0] == 1.0


def test_drawn_settings():
    grid = {"a": [1, 2, 3], "b": [1, 2, 3, 4]}
    drawn = models.draw_settings(grid, 10)
    assert len(drawn) == 10 and drawn == models.draw_settings(grid, 10)
    assert len({tuple(d.items()) for d in drawn}) == 10
    assert len(models.draw_settings({"a": [1, 2]}, 10)) == 2


def test_tuning(rows):
    every = models.make_estimators(rows.count(), trees=3, forest_depth=3, max_iter=5)
    best, setting, score = models.tune(every["random_forest"], {"maxDepth": [1, 3]}, rows, ["id"], n_iter=2, folds=2)
    assert setting["maxDepth"] == 3 and score > 0.9
    best, setting, score = models.tune(every["logistic_regression"], {"maxIter": [5]}, rows, ["id"], folds=2)
    assert isinstance(best, OneVsRestModel) and setting == {"maxIter": 5} and score > 0.9


def test_far_out_margins_give_equal_shares(spark):
    row = spark.range(1).select(models._normalised(F.array(*[models._sigmoid(F.lit(float(m))) for m in (-800, -900, -1000)])).alias("p")).first()
    assert row.p == pytest.approx([1 / 3] * 3)
