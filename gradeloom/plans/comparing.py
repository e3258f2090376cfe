"""Chained evaluation: a stored model, a human annotator and stored responder answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import evaluation
from gradeloom.plans.settings import Settings
from gradeloom.plans.training import featurize
from gradeloom.sources import artefacts, tables


def run_comparison(spark: SparkSession, folder: str, *, gold: DataFrame | None = None,
                   responses: DataFrame | None = None, model: str | None = None,
                   responder: str = "Responder", settings: Settings = Settings()) -> DataFrame:
    """Evaluate the methods that have data, store rows and comparison, return the comparison.

    Without ``model`` the stored best one is used. Test features are built again from the stored texts and the fitted terms.
    ``gold`` has surgeon_adjudicated_grade and manually_extracted_grade; ``responses``
    has (report_id, response) with the ultrasound report id.
    """
    test = tables.read_split(spark, folder, "test")
    terms = artefacts.load_tfidf(spark, f"{folder}/tfidf")
    keywords = spark.read.parquet(f"{folder}/keyword_vocab")
    model = model or artefacts.best_model(spark, f"{folder}/models")
    fitted = artefacts.load_model(spark, f"{folder}/models/{model}")
    scored = fitted.transform(featurize(test, terms, keywords, settings))
    results = [evaluation.evaluate_predictions(
        scored, "label", f"{fitted.name}_prediction", model.replace("_", " ").title(),
        probability=f"{fitted.name}_probability")]
    results.append(None if gold is None else evaluation.evaluate_annotator(gold, labelled_only=True).drop("unseen_rows"))
    if responses is None:
        results.append(None)
    else:
        # One truth per report: a report that joined several operations appears once.
        truth = test.select(F.col("report_id_us").alias("report_id"), settings.label).distinct()
        results.append(evaluation.evaluate_responder(
            responses, truth, settings.label, responder, sample_size=settings.responder_sample,
            seed=settings.seed))
    # One row per method; fixed on disk so that the comparison does not evaluate again.
    evaluation.union_results(results).write.mode("overwrite").parquet(f"{folder}/chained/rows")
    rows = spark.read.parquet(f"{folder}/chained/rows")
    tables.write_evaluation(rows, evaluation.comparison_table([rows]), f"{folder}/chained")
    return evaluation.comparison_table([rows])
