"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.derived import OPERATIVE_SQL, ULTRASOUND_SQL
from gradeloom.functions import text as X
from gradeloom.operators import (boosting, cases, evaluation, labels, matrix, metrics, models, onehot, reports,
                                 split, text_prep, tfidf, vocabulary)
from gradeloom.operators.sizes import cut_lineage
from gradeloom.sources.tables import balanced

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))


def ultrasound_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ULTRASOUND_SQL.replace("from orders", "from {orders}"), orders=_orders(spark, sf_dir))


def operative_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The same rows as the text's join to its two constants, without a join.
    twice = _orders(spark, sf_dir).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    sql = OPERATIVE_SQL.replace("from orders cross join (select 0 as v union all select 1 as v) d", "from {twice}")
    return spark.sql(sql, twice=twice)


def ultrasound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.parse_ultrasound(ultrasound_raw(spark, sf_dir))


def operative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.parse_operative(operative_raw(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def merged(spark: SparkSession, sf_dir: str, null_keys: str = "match", **options) -> DataFrame:
    # Each side is read for the hot keys and for the join: its parsed columns are kept, so that each report is parsed once.
    us = cut_lineage(ultrasound(spark, sf_dir).select("report_id", "case_id", "severity_grade", "findings"))
    op = cut_lineage(operative(spark, sf_dir).select("report_id", "case_id", "severity_grade", "operative_findings"))
    return cases.merge_cases(us, op, null_keys=null_keys, **options)


def _grade_counts(spark: SparkSession, sf_dir: str, labelled_only: bool = False, us: DataFrame | None = None) -> DataFrame:
    """Pairs of grades over all report pairs, counted without making the pairs; ``us`` are parsed ultrasound reports."""
    us = (ultrasound(spark, sf_dir) if us is None else us).select("case_id", F.col("severity_grade").alias("severity_grade_us"))
    op = operative(spark, sf_dir).select("case_id", F.col("severity_grade").alias("severity_grade_or"))
    return cases.pair_counts(us, op, "case_id", "severity_grade_us", "severity_grade_or", null_keys="match",
                             labelled_only=labelled_only)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_prep.prepare_texts(ultrasound(spark, sf_dir), "report_text")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- extraction ------------------------------------------------------------


def us_report_fields(spark, sf_dir):
    return ultrasound(spark, sf_dir).drop("report_text", "extraction_timestamp")


def or_report_fields(spark, sf_dir):
    return operative(spark, sf_dir).drop("report_text", "extraction_timestamp")


def _merged_columns(df: DataFrame) -> DataFrame:
    return df.select("report_id_us", "report_id_or", "case_id", "severity_grade_us", "severity_grade_or",
                     "report_type_us", "report_type_or", "findings", "operative_findings")


def merged_cases(spark, sf_dir):
    return _merged_columns(merged(spark, sf_dir))


def merged_cases_drop_null(spark, sf_dir):
    return _merged_columns(merged(spark, sf_dir, null_keys="drop"))


def grade_pairs(spark, sf_dir):
    return _grade_counts(spark, sf_dir)


def extraction_counts(spark, sf_dir):
    text = (F.when(F.col("doc_id") % 7 == 0, F.lit(None))
            .when(F.col("doc_id") % 7 == 1, F.lit(" \n ")).otherwise(F.col("text")))
    return reports.extraction_counts(documents(spark, sf_dir).select(text.alias("report_text")))


# --- labels, responses, text -----------------------------------------------


def grade_distribution(spark, sf_dir):
    return labels.label_distribution(ultrasound(spark, sf_dir), "severity_grade")


def label_map(spark, sf_dir):
    return labels.label_map(ultrasound(spark, sf_dir), "severity_grade")


def answers(spark, sf_dir, us=None):
    us = ultrasound(spark, sf_dir) if us is None else us
    number = F.regexp_extract("report_id", "([0-9]+)$", 1).cast("long") % 9
    fixed = ("Not complicated", " no signs of appendicitis ", "mild", "rupture", "complicated", None)
    response = F.col("impression")
    for i, phrase in enumerate(fixed):
        response = F.when(number == i, F.lit(phrase)).otherwise(response)
    return us.select("report_id", "severity_grade", response.alias("response"))


def response_grade(spark, sf_dir):
    spoken = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("report_id"), F.col("text").alias("response"))
    both = answers(spark, sf_dir).select("report_id", "response").unionByName(spoken)
    return both.select("report_id", X.response_grade("response").alias("grade"))


def clean_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.clean("text").alias("cleaned_text"))


def tokens(spark, sf_dir):
    split_up = documents(spark, sf_dir).select("doc_id", X.words("text").alias("w"))
    return split_up.select("doc_id", F.array_join("w", "|").alias("tokens"), F.size("w").alias("n"))


def token_filter(spark, sf_dir):
    return text_prep.normalize_tokens(clean_text(spark, sf_dir), "cleaned_text", "processed_text",
                                      mode="content").select("doc_id", "processed_text")


def token_lemma(spark, sf_dir):
    cleaned = clean_text(spark, sf_dir)
    forms = (cleaned.select(F.explode(X.words("cleaned_text")).alias("form")).distinct()
             .filter(F.col("form").endswith("s") & (F.char_length("form") > 3)))
    # Written once: the texts are cleaned for it once, however often the dictionary is read.
    dictionary = cut_lineage(forms.select("form", F.left("form", F.char_length("form") - 1).alias("lemma")))
    return text_prep.normalize_tokens(cleaned, "cleaned_text", "processed_text", mode="content",
                                      dictionary=dictionary, row_id=["doc_id"]).select("doc_id", "processed_text")


def keyword_tags(spark, sf_dir):
    return prepared(spark, sf_dir).select("report_id", F.array_join("medical_keywords", ",").alias("medical_keywords"))


def prepared_dataset(spark, sf_dir):
    us = ultrasound(spark, sf_dir)
    mapping = labels.label_map(us, "severity_grade")
    return (text_prep.prepare_dataset(us, "report_text", "severity_grade", mapping)
            .select("report_id", "severity_grade", "cleaned_text", "processed_text",
                    F.array_join("medical_keywords", ",").alias("medical_keywords"), "label_encoded"))


def stratified_split(spark, sf_dir):
    return split.stratified_split(documents(spark, sf_dir).select("doc_id", "lang"), "lang", ["doc_id"])


def split_sizes(spark, sf_dir):
    us = ultrasound(spark, sf_dir).select("report_id", "severity_grade")
    return split.split_sizes(split.stratified_split(us, "severity_grade", ["report_id"]))


def random_sample(spark, sf_dir):
    return split.random_sample(documents(spark, sf_dir).select("doc_id"), 103, ["doc_id"])


# --- features --------------------------------------------------------------


def tfidf_vocab(spark, sf_dir):
    return rounded(tfidf.tfidf_vocabulary(documents(spark, sf_dir), "text"), "idf")


def tfidf_features(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return rounded(tfidf.fit_tfidf(docs, "text").transform_long(docs, "text", "doc_id"), "tfidf")


def tfidf_transform_test(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = tfidf.fit_tfidf(docs.filter("lang <> 'fr'"), "text", max_features=1000)
    return rounded(model.transform_long(docs.filter("lang = 'fr'"), "text", "doc_id"), "tfidf")


def keyword_vocab(spark, sf_dir):
    return vocabulary.keyword_vocabulary(prepared(spark, sf_dir), "medical_keywords")


def keyword_features(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    vocab = vocabulary.keyword_vocabulary(rows, "medical_keywords")
    return (vocabulary.keyword_matrix(rows, "medical_keywords", vocab, "report_id")
            .withColumn("features", F.array_join(F.col("features").cast("array<string>"), ",")))


def _keyword_strings(spark, sf_dir):
    last = F.right("report_id", F.lit(1))
    joined = F.array_join(X.keywords("report_text"), ", ")
    text = (F.when(last == "7", F.lit(None)).when(last == "3", F.lit(" fluid, ,normal,"))
            .when(joined != "", joined))
    return ultrasound(spark, sf_dir).select("report_id", text.alias("keywords"))


def keyword_vocab_text(spark, sf_dir):
    return vocabulary.keyword_vocabulary(_keyword_strings(spark, sf_dir), "keywords")


def keyword_features_text(spark, sf_dir):
    rows = _keyword_strings(spark, sf_dir)
    return vocabulary.indicators(rows, "keywords", vocabulary.keyword_vocabulary(rows, "keywords"), "report_id")


def _entities(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.term_tokens("text", stop_words=()).alias("entities"))


def entity_vocab(spark, sf_dir):
    return vocabulary.entity_vocabulary(_entities(spark, sf_dir), "entities")


def entity_features(spark, sf_dir):
    rows = _entities(spark, sf_dir)
    return vocabulary.indicators(rows, "entities", vocabulary.entity_vocabulary(rows, "entities"), "doc_id")


def text_statistics(spark, sf_dir):
    stats = text_prep.text_statistics(documents(spark, sf_dir), "text")
    return rounded(stats.drop("text", "lang"), "avg_word_length")


CATEGORICAL = ["p_brand", "p_type", "p_name"]


def onehot_features(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", *CATEGORICAL)
    known = onehot.category_table(part.filter("p_partkey % 5 <> 0"), CATEGORICAL)
    return onehot.onehot_long(part, CATEGORICAL, known, "p_partkey")


def onehot_vectors(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", *CATEGORICAL)
    model = onehot.fit_onehot(part.filter("p_partkey % 5 <> 0"), CATEGORICAL)
    out = onehot.onehot_vectors(model, part, CATEGORICAL)
    return out.select("p_partkey", *[F.get(F.unwrap_udt(f"{c}_onehot")["indices"], 0).alias(f"{c}_position")
                                     for c in CATEGORICAL])


# --- metrics and evaluation ------------------------------------------------


def gold(spark, sf_dir):
    """Two grades per case; some are missing."""
    return merged(spark, sf_dir).select(
        F.concat("report_id_us", F.lit("/"), "report_id_or").alias("report_id"),
        F.col("severity_grade_or").alias("surgeon_adjudicated_grade"),
        F.col("severity_grade_us").alias("manually_extracted_grade"))


def gold_matrix(spark, sf_dir, us=None):
    return _grade_counts(spark, sf_dir, labelled_only=True, us=us).select(
        F.col("severity_grade_or").alias("truth"), F.col("severity_grade_us").alias("predicted"), "n")


def confusion_matrix(spark, sf_dir):
    return gold_matrix(spark, sf_dir)


def class_report(spark, sf_dir):
    return rounded(metrics.class_report(gold_matrix(spark, sf_dir)), "precision", "recall", "f1_score")


def macro_avg(spark, sf_dir):
    report = metrics.class_report(gold_matrix(spark, sf_dir))
    return rounded(metrics.macro_average(report), "precision", "recall", "f1_score")


def weighted_metrics(spark, sf_dir):
    return rounded(metrics.summary(gold_matrix(spark, sf_dir)).drop("kappa"),
                   "accuracy", "precision", "recall", "f1_score")


def cohen_kappa(spark, sf_dir):
    return rounded(metrics.summary(gold_matrix(spark, sf_dir)).select("kappa"), "kappa")


def class_scores(spark, sf_dir):
    i = F.col("doc_id")

    def weight(mul: int, mod: int, cls: int) -> Column:
        return 1 + (i * mul) % mod + F.when(i % 3 == cls, 3).otherwise(0)

    raw = table(spark, sf_dir, "documents").select(
        "doc_id", (i % 3).cast("int").alias("y"),
        F.array(weight(7, 11, 0), weight(5, 13, 1), weight(3, 17, 2)).alias("w"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    return (raw.withColumn("scores", F.transform("w", lambda x: x.cast("double") / total))
            .select("doc_id", "y", "scores", models.argmax("scores").cast("int").alias("predicted")))


def auc_ovr(spark, sf_dir):
    return rounded(metrics.auc_ovr(class_scores(spark, sf_dir), "y", "scores"), "auc")


RESULT_NUMBERS = ("accuracy", "precision", "recall", "f1_score", "auc", "kappa")


def _annotator(spark, sf_dir, us=None):
    return evaluation.annotator_result(gold_matrix(spark, sf_dir, us))


def annotator_eval(spark, sf_dir):
    return rounded(_annotator(spark, sf_dir), *RESULT_NUMBERS)


def _responder(spark, sf_dir, us=None):
    rows = answers(spark, sf_dir, us)
    truth = rows.filter("severity_grade is not null")
    return evaluation.evaluate_responder(rows, truth, "severity_grade", "Responder", sample_size=103)


def responder_eval(spark, sf_dir):
    return rounded(_responder(spark, sf_dir), *RESULT_NUMBERS)


def _results(spark, sf_dir):
    scored = class_scores(spark, sf_dir)
    # Two methods read the ultrasound reports, the responder's sample and answers one after the other: parsed once.
    us = cut_lineage(ultrasound(spark, sf_dir).select("report_id", "case_id", "severity_grade", "impression"))
    return [evaluation.evaluate_predictions(scored, "y", "predicted", "Scores", probability="scores"),
            _annotator(spark, sf_dir, us).drop("unseen_rows"), None, _responder(spark, sf_dir, us)]


def comparison_table(spark, sf_dir):
    return evaluation.comparison_table(_results(spark, sf_dir))


def best_method(spark, sf_dir):
    present = [r for r in _results(spark, sf_dir) if r is not None]
    ordered = [r.withColumn("fit_order", F.lit(i)) for i, r in enumerate(present)]
    return rounded(evaluation.best_method(evaluation.union_results(ordered)), "accuracy").select("method", "accuracy")


# --- matrices and models (no SQL equivalent) -------------------------------


def _quality_features(spark, sf_dir, max_features=100):
    """Labelled documents with features, label and split."""
    truth = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = documents(spark, sf_dir).join(truth, "doc_id")
    rows = split.stratified_split(rows, "label", ["doc_id"])
    model = tfidf.fit_tfidf(rows.filter("split = 'train'"), "text", max_features=max_features, ngram_range=(1, 1))
    stats = text_prep.text_statistics(model.transform(rows, "text"), "text")
    return (matrix.combine_features(stats, ["tfidf", "num_chars", "num_words", "avg_word_length"])
            .select("doc_id", "label", "split", "features"))


def svd_features(spark, sf_dir):
    docs = documents(spark, sf_dir)
    vectors = tfidf.fit_tfidf(docs, "text", max_features=200).transform(docs, "text")
    reduced, _, _ = matrix.reduce_dimensionality(vectors.select("doc_id", "tfidf"), "tfidf", 10)
    return reduced.select("doc_id", "reduced")


def _model_query(*names: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _quality_features(spark, sf_dir)
        train = rows.filter("split = 'train'")
        chosen = models.make_estimators(train.count(), rounds=5, trees=20, forest_depth=8, max_iter=20)
        fitted = models.fit_models({n: chosen[n] for n in names}, train)
        scored = models.score_all(fitted, rows.filter("split <> 'train'"))
        kept = [f"{n}_prediction" for n in names] + [f"{n}_probability" for n in names]
        return scored.select("doc_id", "label", *kept)
    return run


def model_vote(spark, sf_dir):
    scored = _model_query("logistic_regression", "random_forest", "svm")(spark, sf_dir)
    return models.soft_vote(scored, ["logistic_regression", "random_forest", "svm"])


def model_tuned(spark, sf_dir):
    rows = _quality_features(spark, sf_dir)
    train, rest = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    forest = models.make_estimators(train.count(), trees=10, forest_depth=4)["random_forest"]
    best, _, _ = models.tune(forest, {"maxDepth": [2, 4], "minInstancesPerNode": [1, 5]}, train, ["doc_id"], n_iter=3)
    return best.transform(rest).select("doc_id", "label", F.col("ovr_prediction").alias("prediction"))


def _grade_features(spark, sf_dir):
    """Ultrasound reports with their encoded grade, split, and TF-IDF of 1-2 grams (3,000 terms) fitted on train."""
    us = ultrasound(spark, sf_dir)
    prepared = text_prep.prepare_dataset(us, "report_text", "severity_grade", labels.label_map(us, "severity_grade"))
    rows = split.stratified_split(prepared, "severity_grade", ["report_id"])
    model = tfidf.fit_tfidf(rows.filter("split = 'train'"), "processed_text", max_features=3000, ngram_range=(1, 2))
    return model.transform(rows, "processed_text").select(
        "report_id", F.col("label_encoded").cast("double").alias("label"), "split", F.col("tfidf").alias("features"))


def _boosted(name: str, params: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Rows of the test split scored, whether every row's probabilities sum to 1, whether it beats the
        majority class of training."""
        rows = cut_lineage(_grade_features(spark, sf_dir))  # read for counts, cut points, training and scoring
        train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
        model = boosting.fit_boosted(train, params=params)
        scored = model.transform(test, ["report_id", "label"])
        top = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()
        scored = scored.withColumn("_common", F.lit(top.label if top else None).cast("double"))
        return scored.agg(
            F.lit(name).alias("model"), F.count("*").alias("n_scored"),
            F.coalesce(F.bool_and(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9),
                       F.lit(True)).alias("sums_to_one"),
            (F.avg((F.col("prediction") == F.col("label")).cast("double"))
             > F.avg((F.col("_common") == F.col("label")).cast("double"))).alias("beats_majority"))
    run.__name__ = f"model_{name}"
    return run


def queries() -> dict[str, Query]:
    plain = [us_report_fields, or_report_fields, merged_cases, merged_cases_drop_null, grade_pairs,
             extraction_counts, grade_distribution, label_map, response_grade, clean_text, tokens,
             token_filter, token_lemma, keyword_tags, prepared_dataset, stratified_split, split_sizes,
             random_sample, tfidf_vocab, tfidf_features, tfidf_transform_test, keyword_vocab,
             keyword_features, keyword_vocab_text, keyword_features_text, entity_vocab, entity_features,
             text_statistics, onehot_features, onehot_vectors, confusion_matrix, class_report, macro_avg,
             weighted_metrics, cohen_kappa, auc_ovr, annotator_eval, responder_eval, comparison_table,
             best_method, svd_features, model_vote, model_tuned]
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out["model_logreg"] = _model_query("logistic_regression")
    out["model_forest"] = _model_query("random_forest")
    out["model_svm"] = _model_query("svm")
    out["model_gbt"] = _model_query("gradient_boosting")
    out["model_gbt_leafy"] = _model_query("leaf_boosting")
    out["model_softmax_boosting"] = _boosted("softmax_boosting", boosting.SOFTMAX)
    out["model_leafwise_boosting"] = _boosted("leafwise_boosting", boosting.LEAFWISE)
    return out
