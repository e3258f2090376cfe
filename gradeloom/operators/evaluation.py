"""Evaluation of models, annotators and responders, and the comparison of methods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators import metrics
from gradeloom.operators.sizes import small_table
from gradeloom.operators.split import random_sample

RESULT_COLUMNS = ("method", "accuracy", "precision", "recall", "f1_score", "auc", "kappa", "sample_size")


def _result(summary: DataFrame, method: str, auc: DataFrame | None = None) -> DataFrame:
    area = F.lit(None).cast("double") if auc is None else auc.scalar()
    return summary.select(F.lit(method).alias("method"), "accuracy", "precision", "recall", "f1_score",
                          area.alias("auc"), "kappa", "sample_size")


def evaluate_predictions(df: DataFrame, truth: str, predicted: str, method: str,
                         probability: str | None = None) -> DataFrame:
    """One result row; with class probabilities (an array) also the AUC."""
    auc = None if probability is None else metrics.auc_ovr(df, truth, probability)
    return _result(metrics.summary(metrics.confusion_matrix(df, truth, predicted)), method, auc)


def evaluate_annotator(df: DataFrame, method: str = "Manual Extraction", *,
                       gold: str = "surgeon_adjudicated_grade",
                       annotated: str = "manually_extracted_grade",
                       labelled_only: bool = False) -> DataFrame:
    """Result row for a human annotator, plus ``unseen_rows``.

    Grades that no gold label ever uses count as errors; ``unseen_rows`` says how
    many rows have one.
    """
    return annotator_result(metrics.confusion_matrix(df, gold, annotated, labelled_only=labelled_only), method)


def annotator_result(matrix: DataFrame, method: str = "Manual Extraction") -> DataFrame:
    """The same from counted pairs (truth, predicted, n)."""
    never_gold = F.when(F.col("support") == 0, F.col("n_predicted")).otherwise(F.lit(0))
    unseen = metrics.class_counts(matrix).agg(F.sum(never_gold).alias("n"))
    return _result(metrics.summary(matrix), method).withColumn("unseen_rows", unseen.scalar())


def evaluate_responder(responses: DataFrame, truth: DataFrame, label: str, method: str, *,
                       row_id: str = "report_id", sample_size: int | None = None,
                       seed: int = 42) -> DataFrame:
    """Result row for stored free-text answers (row_id, response), on a sample of the truth."""
    rows, answers = truth.select(row_id, label), responses.select(row_id, "response")
    if sample_size is not None:
        rows = random_sample(rows, sample_size, [row_id], seed=seed)
        local = small_table(rows)
        if local is not None:
            # Only the answers of the sample are needed, so the others are not shuffled.
            rows, answers = local, answers.join(F.broadcast(local.select(row_id)), row_id, "left_semi")
    paired = rows.join(answers, row_id, "left")
    graded = paired.withColumn("_grade", X.response_grade("response"))
    return evaluate_predictions(graded, label, "_grade", method)


def union_results(results: Sequence[DataFrame | None]) -> DataFrame:
    """Result rows of the methods that were evaluated; absent ones are skipped."""
    present = [r for r in results if r is not None]
    if not present:
        raise ValueError("no method was evaluated")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def comparison_table(results: Sequence[DataFrame | None]) -> DataFrame:
    """The printed comparison: four decimals, N/A where a method has no value."""
    def shown(name: str) -> Column:
        return (F.when(F.col(name).isNull(), F.lit("N/A"))
                .otherwise(F.format_string("%.4f", F.col(name))))

    return union_results(results).select(
        F.col("method").alias("Method"),
        *[shown(c).alias(t) for c, t in (("accuracy", "Accuracy"), ("precision", "Precision"),
                                         ("recall", "Recall"), ("f1_score", "F1-Score"),
                                         ("auc", "AUC-ROC"), ("kappa", "Kappa"))],
        F.col("sample_size").alias("Sample Size"))


def best_method(results: DataFrame, order: str = "fit_order") -> DataFrame:
    """The most accurate row; among equals the one that was fitted first."""
    return results.orderBy(F.col("accuracy").desc(), order).limit(1)
