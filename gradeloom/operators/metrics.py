"""Classification metrics from one pass over (true, predicted) pairs.

Only ``confusion_matrix`` and ``score_counts`` read the data; everything else works
on their small, pre-aggregated results. Missing labels are compared as a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.ranking import running_total


def pair_predictions(truth: DataFrame, predictions: DataFrame, row_id: str) -> DataFrame:
    """Truth and prediction of each row, paired by key. Without a prediction it is NULL, and counts as an error."""
    return truth.join(predictions, row_id, "left")


def confusion_matrix(df: DataFrame, truth: str, predicted: str, *, labelled_only: bool = False) -> DataFrame:
    """(truth, predicted, n) of the pairs that occur.

    ``labelled_only`` leaves out rows without a label on either side. They go after
    the aggregation, so that labels which are extracted on the fly are not computed
    twice, once for a filter below it.
    """
    pairs = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
    if not labelled_only:
        return pairs.agg(F.count(F.lit(1)).alias("n"))
    both = F.col(truth).isNotNull() & F.col(predicted).isNotNull()
    return pairs.agg(F.count_if(both).alias("n")).filter(F.col("n") > 0)


def confusion_wide(matrix: DataFrame, classes: list) -> DataFrame:
    """The matrix with one column per predicted class, zeros filled in."""
    return matrix.groupBy("truth").pivot("predicted", classes).agg(F.sum("n")).fillna(0)


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def class_counts(matrix: DataFrame) -> DataFrame:
    """(label, support, predicted, hits) per class of either side, in one pass over the matrix."""
    hit = F.when(F.col("truth").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    sides = matrix.select(F.inline(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"),
                 none.alias("n_predicted"), hit.cast("long").alias("hits")),
        F.struct(F.col("predicted").alias("label"), none.alias("support"),
                 F.col("n").alias("n_predicted"), none.alias("hits")))))
    return sides.groupBy("label").agg(F.sum("support").alias("support"),
                                      F.sum("n_predicted").alias("n_predicted"),
                                      F.sum("hits").alias("hits"))


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1_score, support); 0 where a denominator is 0."""
    c = class_counts(matrix)
    hits = F.col("hits").cast("double")
    return c.select("label",
                    _ratio(hits, F.col("n_predicted")).alias("precision"),
                    _ratio(hits, F.col("support")).alias("recall"),
                    _ratio(2 * hits, F.col("n_predicted") + F.col("support")).alias("f1_score"),
                    "support")


def macro_average(report: DataFrame) -> DataFrame:
    return report.agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1_score")],
                      F.sum("support").alias("support"))


def summary(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, support-weighted precision, recall and F1, kappa, sample size.

    All of them are sums over the class table, so the pairs are read once.
    """
    c = class_counts(matrix)
    n = F.sum("support")
    hits, support = F.col("hits").cast("double"), F.col("support")

    def weighted(metric: Column) -> Column:
        return F.sum(metric * support) / n

    agreed = F.sum(hits) / n
    by_chance = F.sum(support.cast("double") * F.col("n_predicted")) / (n.cast("double") * n)
    totals = c.agg(
        agreed.alias("accuracy"),
        weighted(_ratio(hits, F.col("n_predicted"))).alias("precision"),
        weighted(_ratio(hits, support)).alias("recall"),
        weighted(_ratio(2 * hits, F.col("n_predicted") + support)).alias("f1_score"),
        by_chance.alias("_chance"), n.alias("sample_size"))
    kappa = F.when(F.col("_chance") < 1.0, (F.col("accuracy") - F.col("_chance")) / (1.0 - F.col("_chance")))
    return totals.select("accuracy", "precision", "recall", "f1_score", kappa.alias("kappa"), "sample_size")


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg(F.col(truth).eqNullSafe(F.col(predicted)).cast("double")).alias("accuracy"))


# ---------------------------------------------------------------------------
# One-vs-rest AUC
# ---------------------------------------------------------------------------


def score_counts(df: DataFrame, truth: str, scores: str) -> DataFrame:
    """(cls, score, pos, neg, off) per distinct score of each class.

    ``truth`` is the class index into the array ``scores``. Equal scores combine
    map-side, so a score that many rows share is one row per task in the shuffle.
    """
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    # Scores that do not add up to 1 are no probabilities, and have no AUC here.
    off = (F.abs(total - 1.0) > F.lit(1e-8) + F.lit(1e-5) * F.abs(total)).cast("int")
    # The outer form: the plain one would score the rows twice, to test for no scores first.
    cells = (df.select(F.col(truth).alias("_y"), off.alias("off"),
                       F.posexplode_outer(scores).alias("cls", "score"))
             .filter(F.col("cls").isNotNull()))
    is_pos = F.coalesce(F.col("_y") == F.col("cls"), F.lit(False)).cast("long")
    return cells.groupBy("cls", "score").agg(F.sum(is_pos).alias("pos"),
                                             F.sum(1 - is_pos).alias("neg"),
                                             F.max("off").alias("off"))


def auc_by_class(counts: DataFrame, **options) -> DataFrame:
    """(cls, auc, positives, off): exact area with half credit for ties.

    A positive at a score beats every negative below it and half of those at it,
    so the area is a sum over distinct scores. Sums are whole numbers, hence exact.
    """
    ranked = running_total(counts, "cls", "score", "neg", "below", **options)
    exact = lambda c: c.cast("decimal(19,0)")
    twice_wins = F.sum(exact(F.col("pos")) * exact(2 * F.col("below") + F.col("neg")))
    p, n = F.sum("pos"), F.sum("neg")
    area = F.when((p > 0) & (n > 0),
                  twice_wins.cast("double") / (F.lit(2.0) * p.cast("double") * n.cast("double")))
    return ranked.groupBy("cls").agg(area.alias("auc"), p.alias("positives"), F.max("off").alias("off"))


def auc_weighted(by_class: DataFrame) -> DataFrame:
    """One row: prevalence-weighted AUC; NULL for two classes or fewer, or if a class lacks either side."""
    undefined = (F.count(F.lit(1)) <= 2) | (F.count("auc") < F.count(F.lit(1))) | (F.max("off") > 0)
    value = F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")
    return by_class.agg(F.when(~undefined, value).alias("auc"))


def auc_ovr(df: DataFrame, truth: str, scores: str, **options) -> DataFrame:
    return auc_weighted(auc_by_class(score_counts(df, truth, scores), **options))
