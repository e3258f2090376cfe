"""Fitted artefacts: TF-IDF terms, vocabularies and models, saved and loaded."""

from __future__ import annotations

from pyspark.ml.classification import (LogisticRegressionModel, OneVsRestModel,
                                       RandomForestClassificationModel)
from pyspark.sql import SparkSession

from gradeloom.operators.models import FittedModel, SoftVote
from gradeloom.operators.tfidf import TfidfModel

KINDS = {c.__name__: c for c in (OneVsRestModel, RandomForestClassificationModel, LogisticRegressionModel)}


def save_tfidf(spark: SparkSession, model: TfidfModel, path: str) -> None:
    model.vocabulary(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
    settings = [(list(model.ngram_range), list(model.stop_words))]
    (spark.createDataFrame(settings, "ngram_range array<int>, stop_words array<string>")
     .write.mode("overwrite").parquet(f"{path}/settings"))


def load_tfidf(spark: SparkSession, path: str) -> TfidfModel:
    settings = spark.read.parquet(f"{path}/settings").first()
    vocabulary = spark.read.parquet(f"{path}/vocabulary").orderBy("idx").collect()
    return TfidfModel(tuple(tuple(r) for r in vocabulary), tuple(settings["ngram_range"]),
                      tuple(settings["stop_words"]))


def save_model(spark: SparkSession, fitted: FittedModel, path: str) -> None:
    fitted.model.write().overwrite().save(f"{path}/model")
    sigmoids = None if fitted.sigmoids is None else [[a, b] for a, b in fitted.sigmoids]
    (spark.createDataFrame([(fitted.name, type(fitted.model).__name__, sigmoids)],
                           "name string, kind string, sigmoids array<array<double>>")
     .write.mode("overwrite").parquet(f"{path}/about"))


def save_models(spark: SparkSession, fitted: dict[str, FittedModel], best: str, folder: str) -> None:
    """Every model, their vote (by the names of its members), and the name of the best."""
    for name, model in fitted.items():
        save_model(spark, model, f"{folder}/{name}")
    (spark.createDataFrame([("ensemble", "SoftVote", list(fitted))], "name string, kind string, members array<string>")
     .write.mode("overwrite").parquet(f"{folder}/ensemble/about"))
    spark.createDataFrame([(best,)], "name string").write.mode("overwrite").parquet(f"{folder}/best")


def best_model(spark: SparkSession, folder: str) -> str:
    """Name of the model that training has chosen."""
    return spark.read.parquet(f"{folder}/best").first()["name"]


def load_model(spark: SparkSession, path: str) -> FittedModel | SoftVote:
    about = spark.read.parquet(f"{path}/about").first()
    if about["kind"] == "SoftVote":
        folder = path.rstrip("/").rpartition("/")[0]
        return SoftVote({name: load_model(spark, f"{folder}/{name}") for name in about["members"]})
    model = KINDS[about["kind"]].load(f"{path}/model")
    sigmoids = None if about["sigmoids"] is None else [tuple(s) for s in about["sigmoids"]]
    return FittedModel(about["name"], model, sigmoids)
