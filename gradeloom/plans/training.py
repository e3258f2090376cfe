"""Full job: merged cases to prepared splits, features, fitted models and their evaluation.

Stages hand over stored tables. Feature rows carry their key, label and split, so
nothing is paired by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import evaluation, labels, matrix, metrics, models, split, text_prep, tfidf, vocabulary
from gradeloom.plans.settings import Settings
from gradeloom.sources import artefacts, tables


def prepare(spark: SparkSession, merged: DataFrame, folder: str, settings: Settings = Settings(),
            dictionary: DataFrame | None = None) -> DataFrame:
    """Prepared rows with their split, and the label map, stored and read back.

    ``dictionary`` (form, lemma) gives the lemmas of the token mode ``content``.

    The texts are cleaned once: the split's passes over hashes read the stored table.
    """
    mapping = labels.label_map(merged, settings.label)
    rows = text_prep.prepare_dataset(merged, settings.text, settings.label, mapping,
                                     mode=settings.token_mode, stop_words=settings.stop_words,
                                     row_id=settings.row_key, dictionary=dictionary)
    rows.write.mode("overwrite").parquet(f"{folder}/unsplit")
    placed = split.stratified_split(spark.read.parquet(f"{folder}/unsplit"), "label_encoded",
                                    settings.row_key, test_size=settings.test_size,
                                    val_size=settings.val_size, seed=settings.seed)
    tables.write_splits(placed, mapping, folder)
    return tables.read_split(spark, folder)


def featurize(rows: DataFrame, model: tfidf.TfidfModel, keyword_vocab: DataFrame,
              settings: Settings = Settings()) -> DataFrame:
    """Key, label, split and the stacked features of prepared rows, without a shuffle."""
    df = model.transform(rows, "processed_text", "tfidf")
    df = vocabulary.indicator_vectors(df, "medical_keywords", keyword_vocab, "keyword_flags")
    df = text_prep.text_statistics(df, "processed_text")
    df = matrix.combine_features(df, ["tfidf", "keyword_flags", "num_chars", "num_words", "avg_word_length"])
    return df.select(*settings.row_key, F.col(settings.label).alias("grade"),
                     F.col("label_encoded").cast("double").alias("label"), "split", "features")


def build_features(spark: SparkSession, rows: DataFrame, folder: str,
                   settings: Settings = Settings()) -> DataFrame:
    """Fit terms and keywords on the training rows, then store the features of all rows."""
    train = rows.filter(F.col("split") == "train")
    model = tfidf.fit_tfidf(train, "processed_text", max_features=settings.max_features,
                            ngram_range=settings.ngram_range, stop_words=settings.stop_words)
    artefacts.save_tfidf(spark, model, f"{folder}/tfidf")
    keywords = vocabulary.keyword_vocabulary(train, "medical_keywords")
    keywords.write.mode("overwrite").parquet(f"{folder}/keyword_vocab")
    vocab = spark.read.parquet(f"{folder}/keyword_vocab")
    tables.write_features(featurize(rows, model, vocab, settings), folder)
    return tables.read_features(spark, folder)


def train_models(spark: SparkSession, features: DataFrame, folder: str,
                 settings: Settings = Settings()) -> tuple[dict[str, models.FittedModel], str]:
    """Fit every model once, choose the best on the validation rows, and store all of them.

    Without validation rows the first model is kept. Returns (models, name of the best);
    the soft vote of all models takes part in the choice as ``ensemble``.
    """
    train = features.filter(F.col("split") == "train")
    every = models.make_estimators(train.count(), rounds=settings.rounds, trees=settings.trees,
                                   forest_depth=settings.forest_depth, max_iter=settings.max_iter,
                                   seed=settings.seed)
    fitted = models.fit_models({n: every[n] for n in settings.models}, train)
    val = features.filter(F.col("split") == "val")
    voted = models.soft_vote(models.score_all(fitted, val), list(fitted))
    scores = models.validation_scores(voted, [*fitted, "ensemble"])
    scores.write.mode("overwrite").parquet(f"{folder}/validation_scores")
    best = models.select_best(spark.read.parquet(f"{folder}/validation_scores"))
    artefacts.save_models(spark, fitted, best, f"{folder}/models")
    return fitted, best


def evaluate_best(features: DataFrame, fitted: dict[str, models.FittedModel], best: str, folder: str) -> DataFrame:
    """Result row of the best model on the test rows. Its predictions and class report are stored beside it.

    The rows are scored once: all numbers come from the stored predictions.
    """
    spark = features.sparkSession
    chosen = models.SoftVote(fitted) if best == "ensemble" else fitted[best]
    scored = chosen.transform(features.filter(F.col("split") == "test"))
    (scored.select(*[c for c in features.columns if c != "features"], F.col(f"{best}_prediction").alias("prediction"),
                   F.col(f"{best}_probability").alias("probability"))
     .write.mode("overwrite").parquet(f"{folder}/predictions"))
    stored = spark.read.parquet(f"{folder}/predictions")
    matrix = metrics.confusion_matrix(stored, "label", "prediction")
    metrics.class_report(matrix).write.mode("overwrite").parquet(f"{folder}/class_report")
    return evaluation.evaluate_predictions(stored, "label", "prediction", "Best Model", probability="probability")


def run_full(spark: SparkSession, merged: DataFrame, folder: str,
             settings: Settings = Settings(), dictionary: DataFrame | None = None) -> DataFrame:
    """All stages over the merged cases; returns the result row of the best model."""
    rows = prepare(spark, merged, folder, settings, dictionary)
    features = build_features(spark, rows, folder, settings)
    fitted, best = train_models(spark, features, folder, settings)
    result = evaluate_best(features, fitted, best, f"{folder}/final")
    tables.write_evaluation(result, evaluation.comparison_table([result]), f"{folder}/final")
    return spark.read.json(f"{folder}/final/results")
