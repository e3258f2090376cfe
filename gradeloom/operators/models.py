"""Classifiers, class probabilities, tuning, soft voting and model choice on Spark ML.

Every classifier sees one table with ``features`` (vector) and ``label`` (class
index, double). A fitted model adds ``<name>_probability`` (array of class
probabilities) and ``<name>_prediction`` to each row, so models combine within the
row and predictions need no join.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, OneVsRestModel, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.split import stratified_folds

# Training parameters of the five classifiers.
LOGISTIC = {"C": 1.0, "max_iter": 1000}
FOREST = {"n_estimators": 100, "max_depth": 20}
SVM = {"C": 1.0}
BOOSTED = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1}
LEAFY = {"n_estimators": 100, "max_leaves": 31, "learning_rate": 0.1}
SEED = 42

# Upper bound for the linear SVM solver.
SVM_ITERATIONS = 100

MODEL_NAMES = ("logistic_regression", "random_forest", "svm", "gradient_boosting",
               "leaf_boosting")


def _one_vs_rest(base: Estimator) -> OneVsRest:
    return OneVsRest(classifier=base, featuresCol="features", labelCol="label",
                     predictionCol="ovr_prediction")


def make_estimators(n_rows: int, *, rounds: int | None = None, trees: int | None = None,
                    forest_depth: int | None = None, max_iter: int | None = None, seed: int = SEED,
                    multinomial: bool = False) -> dict[str, Estimator]:
    """The five classifiers by name, in fitting order.

    The penalty weight C of a summed loss over n rows is 1 / (C n) for the mean loss
    that Spark minimises.
    """
    logistic = LogisticRegression(featuresCol="features", labelCol="label",
                                  regParam=1.0 / (LOGISTIC["C"] * n_rows), standardization=False,
                                  maxIter=max_iter or LOGISTIC["max_iter"])
    if multinomial:
        logistic = logistic.copy()
        logistic.setFamily("multinomial").setPredictionCol("ovr_prediction")
    boosted = dict(featuresCol="features", labelCol="label", seed=seed)
    return {
        "logistic_regression": logistic if multinomial else _one_vs_rest(logistic),
        "random_forest": RandomForestClassifier(
            featuresCol="features", labelCol="label",
            predictionCol="ovr_prediction", numTrees=trees or FOREST["n_estimators"],
            maxDepth=forest_depth or FOREST["max_depth"], featureSubsetStrategy="sqrt", seed=seed,
            cacheNodeIds=False, maxMemoryInMB=512),
        "svm": _one_vs_rest(LinearSVC(featuresCol="features", labelCol="label",
                                      regParam=1.0 / (SVM["C"] * n_rows), standardization=False,
                                      maxIter=max_iter or SVM_ITERATIONS)),
        "gradient_boosting": _one_vs_rest(GBTClassifier(
            maxIter=rounds or BOOSTED["n_estimators"], maxDepth=BOOSTED["max_depth"],
            stepSize=BOOSTED["learning_rate"], **boosted)),
        # A full tree of depth 5 has 32 leaves.
        "leaf_boosting": _one_vs_rest(GBTClassifier(
            maxIter=rounds or LEAFY["n_estimators"], maxDepth=(LEAFY["max_leaves"]).bit_length(),
            stepSize=LEAFY["learning_rate"], **boosted)),
    }


def argmax(scores: Column | str) -> Column:
    """Index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


def _normalised(scores: Column) -> Column:
    """Shares of the sum; equal ones where every score has come out as zero."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.transform(scores, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(scores)))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


@dataclass
class FittedModel:
    """A fitted classifier and how its raw scores become probabilities.

    ``sigmoids`` holds (slope, offset) per class for one-vs-rest models; it is None
    for models with probabilities of their own.
    """

    name: str
    model: Model
    sigmoids: list[tuple[float, float]] | None = None
    info: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        prob, pred = f"{self.name}_probability", f"{self.name}_prediction"
        scored = self.model.transform(df)
        if self.sigmoids is None:
            out = scored.withColumn(prob, vector_to_array("probability"))
        else:
            raw = vector_to_array("rawPrediction")
            squashed = F.array(*[_sigmoid(raw[i] * a + b) for i, (a, b) in enumerate(self.sigmoids)])
            out = scored.withColumn("_squashed", squashed).withColumn(prob, _normalised(F.col("_squashed")))
        return (out.withColumn(pred, F.col("ovr_prediction"))
                .drop("rawPrediction", "probability", "ovr_prediction", "_squashed"))


def _fit_margin_sigmoids(model: OneVsRestModel, train: DataFrame, n_classes: int) -> list[tuple[float, float]]:
    """A logistic curve on the margin of each class, for models without probabilities."""
    margins = model.transform(train).select("label", vector_to_array("rawPrediction").alias("raw"))
    curves = []
    for i in range(n_classes):
        one = margins.select((F.col("label") == i).cast("double").alias("label"),
                             array_to_vector(F.array(F.col("raw")[i])).alias("features"))
        fitted = LogisticRegression(featuresCol="features", labelCol="label", maxIter=50).fit(one)
        curves.append((float(fitted.coefficients[0]), float(fitted.intercept)))
    return curves


def fit_model(name: str, estimator: Estimator, train: DataFrame) -> FittedModel:
    model = estimator.fit(train)
    if not isinstance(model, OneVsRestModel):
        return FittedModel(name, model)
    n_classes = len(model.models)
    base = estimator.getClassifier()
    if isinstance(base, LinearSVC):
        return FittedModel(name, model, _fit_margin_sigmoids(model, train, n_classes))
    # The raw score is the log-odds for logistic regression and half of it for boosting.
    slope = 2.0 if isinstance(base, GBTClassifier) else 1.0
    return FittedModel(name, model, [(slope, 0.0)] * n_classes)


def fit_models(estimators: Mapping[str, Estimator], train: DataFrame) -> dict[str, FittedModel]:
    """Fit each classifier once, over one cached copy of the training rows."""
    cached = train.select("features", "label").cache()
    try:
        return {name: fit_model(name, estimator, cached) for name, estimator in estimators.items()}
    finally:
        cached.unpersist()


def score_all(models: Mapping[str, FittedModel], df: DataFrame) -> DataFrame:
    for model in models.values():
        df = model.transform(df)
    return df


def soft_vote(df: DataFrame, names: Sequence[str], out: str = "ensemble") -> DataFrame:
    """Mean of the class probabilities of fitted models already scored in ``df``."""
    total = F.col(f"{names[0]}_probability")
    for name in names[1:]:
        total = F.zip_with(total, F.col(f"{name}_probability"), lambda a, b: a + b)
    mean = F.transform(total, lambda x: x / F.lit(float(len(names))))
    return (df.withColumn(f"{out}_probability", mean)
            .withColumn(f"{out}_prediction", argmax(f"{out}_probability")))


@dataclass
class SoftVote:
    """The vote of fitted models, used like one of them."""

    members: dict[str, FittedModel]
    name: str = "ensemble"

    def transform(self, df: DataFrame) -> DataFrame:
        return soft_vote(score_all(self.members, df), list(self.members), self.name)


def validation_scores(df: DataFrame, names: Sequence[str], truth: str = "label") -> DataFrame:
    """(method, accuracy, fit_order): accuracies of all scored models in one pass."""
    wide = df.agg(*[F.avg((F.col(truth) == F.col(f"{n}_prediction")).cast("double")).alias(n) for n in names])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("method"), F.col(n).alias("accuracy"), F.lit(i).alias("fit_order"))
        for i, n in enumerate(names)])))


def draw_settings(grid: Mapping[str, Sequence], n: int = 10, seed: int = SEED) -> list[dict]:
    """``n`` different settings of the grid (all of them if there are fewer)."""
    names = sorted(grid)
    every = [dict(zip(names, values)) for values in product(*[grid[k] for k in names])]
    return every if len(every) <= n else random.Random(seed).sample(every, n)


def tune(estimator: Estimator, grid: Mapping[str, Sequence], train: DataFrame, key: Sequence[str], *,
         n_iter: int = 10, folds: int = 3, seed: int = SEED, parallelism: int = 4):
    """Random search by cross-validated accuracy. Returns (best model, best setting, best score).

    Grid names are parameters of the classifier, or of the base classifier of a
    one-vs-rest estimator. Folds are stratified by label.
    """
    inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    settings = draw_settings(grid, n_iter, seed)
    if isinstance(estimator, OneVsRest):
        candidates = []
        for setting in settings:
            base = inner.copy({inner.getParam(k): v for k, v in setting.items()})
            candidates.append({estimator.getParam("classifier"): base})
    else:
        candidates = [{inner.getParam(k): v for k, v in setting.items()} for setting in settings]
    folded = stratified_folds(train, "label", key, folds, seed=seed, out="fold").withColumn(
        "fold", F.col("fold").cast("int")).select("features", "label", "fold").cache()
    try:
        search = CrossValidator(
            estimator=estimator, estimatorParamMaps=candidates, numFolds=folds, foldCol="fold",
            parallelism=parallelism, seed=seed,
            evaluator=MulticlassClassificationEvaluator(
                labelCol="label", predictionCol="ovr_prediction", metricName="accuracy"))
        fitted = search.fit(folded)
    finally:
        folded.unpersist()
    best = max(range(len(settings)), key=lambda i: fitted.avgMetrics[i])
    return fitted.bestModel, settings[best], fitted.avgMetrics[best]


def select_best(scores: DataFrame) -> str:
    """Name of the most accurate model; the first fitted one among equals."""
    return scores.orderBy(F.col("accuracy").desc(), "fit_order").first()["method"]
