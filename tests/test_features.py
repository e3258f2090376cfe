"""TF-IDF, vocabularies, one-hot, stacking and SVD."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import queries as Q
from gradeloom.operators import matrix, onehot, text_prep, tfidf, vocabulary
from tests.conftest import SF

DOCS = ["red wall red", "red wall thick", "wall blue", "the red", "red blue sky", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, text string")


def test_tfidf_by_hand(spark, docs):
    model = tfidf.fit_tfidf(docs, "text", max_features=4)
    # red cf 5 df 4, wall 3/3, blue 2/2, "red wall" 2/2; "thick", "sky" and the rest are too rare.
    assert model.terms == ["blue", "red", "red wall", "wall"]
    idf = {t: math.log(7 / (df + 1)) + 1 for t, df in (("blue", 2), ("red", 4), ("red wall", 2), ("wall", 3))}
    for term, _, _, _, value in model.rows:
        assert value == pytest.approx(idf[term])
    got = {(r["id"], r["term"]): r["tfidf"] for r in model.transform_long(docs, "text", "id").collect()}
    first = {"red": 2 * idf["red"], "wall": idf["wall"], "red wall": idf["red wall"]}
    norm = math.sqrt(sum(v * v for v in first.values()))
    for term, v in first.items():
        assert got[0, term] == pytest.approx(v / norm)
    assert not [k for k in got if k[0] == 5]
    vectors = {r["id"]: r["v"] for r in model.transform(docs, "text").select("id", vector_to_array("tfidf").alias("v")).collect()}
    assert vectors[5] == [0.0] * 4 and vectors[3] == [0.0, 1.0, 0.0, 0.0]


def test_tfidf_frequency_cuts_and_ties(spark, docs):
    # "red" is in 4 of 6 documents.
    assert "red" not in tfidf.fit_tfidf(docs, "text", max_df=0.6).terms
    assert tfidf.fit_tfidf(docs, "text", max_features=3).terms == ["blue", "red", "wall"]
    assert "sky" in tfidf.fit_tfidf(docs, "text", min_df=1).terms


@pytest.mark.parametrize("k", [5, 60, 5000])
@pytest.mark.parametrize("n", [2, 3])
def test_narrowed_ngrams_change_nothing(spark, k, n):
    """The kept terms are those of counting every n-gram."""
    docs = Q.documents(spark, SF).filter("lang = 'en'").limit(60)
    docs = spark.createDataFrame(docs.toArrow())
    def fit(words):
        return {tuple(r) for r in tfidf.tfidf_vocabulary(docs, "text", max_features=k, ngram_range=(1, n), min_df=1,
                                                         frequent_words=words).collect()}
    everything = fit(1)
    assert fit(10_000) == everything and len(everything) == min(k, len(everything))


def test_tfidf_transform_needs_no_shuffle(spark, docs):
    model = tfidf.fit_tfidf(docs, "text")
    plan = model.transform(docs, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_entity_vocabulary(spark):
    df = spark.createDataFrame([(1, ["b", "a", "a"]), (2, ["a", "c", "c"]), (3, None), (4, ["c"])], "id int, e array<string>")
    vocab = vocabulary.entity_vocabulary(df, "e", min_freq=3)
    assert {tuple(r) for r in vocab.collect()} == {("a", 3, 0), ("c", 3, 1)}
    for limit in (100_000, 0):
        got = {tuple(r) for r in vocabulary.indicators(df, "e", vocab, "id", small_rows=limit).collect()}
        assert got == {(1, 0, "a"), (2, 0, "a"), (2, 1, "c"), (4, 1, "c")}


def test_keyword_vocabulary_rules(spark):
    text = spark.createDataFrame([(1, "b, a,,b"), (2, None)], "id int, k string")
    vocab = vocabulary.keyword_vocabulary(text, "k")
    assert [r["term"] for r in vocab.orderBy("idx").collect()] == ["", "a", "b"]
    got = {r["id"]: r["features"] for r in vocabulary.keyword_matrix(text, "k", vocab, "id").collect()}
    assert got == {1: [0, 1, 1], 2: [0, 0, 0]}
    lists = spark.createDataFrame([(1, ["fluid"]), (2, []), (3, None)], "id int, k array<string>")
    vocab = vocabulary.keyword_vocabulary(lists, "k")
    vectors = vocabulary.indicator_vectors(lists, "k", vocab, "v").select(vector_to_array("v")).collect()
    assert [r[0] for r in vectors] == [[1.0], [0.0], [0.0]]


def test_onehot_seen_missing_and_unseen(spark):
    train = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, "b", "x")], "id int, c string, d string")
    test = spark.createDataFrame([(4, "a", None), (5, "new", "x"), (6, None, "y")], "id int, c string, d string")
    table = onehot.category_table(train, ["c", "d"])
    assert {tuple(r) for r in table.collect()} == {("c", "a", 0), ("c", "b", 1), ("d", "x", 0), ("d", None, 1)}
    got = {tuple(r) for r in onehot.onehot_long(test, ["c", "d"], table, "id").select("id", "feature", "position").collect()}
    assert got == {(4, "c", 0), (4, "d", 1), (5, "d", 0)}
    model = onehot.fit_onehot(train, ["c", "d"])
    rows = onehot.onehot_vectors(model, test, ["c", "d"])
    vectors = rows.select("id", vector_to_array("c_onehot").alias("c"), vector_to_array("d_onehot").alias("d")).collect()
    assert {r["id"]: (r["c"], r["d"]) for r in vectors} == {
        4: ([1.0, 0.0], [0.0, 1.0]), 5: ([0.0, 0.0], [1.0, 0.0]), 6: ([0.0, 0.0], [0.0, 0.0])}


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(0)
    dense = rng.normal(size=(40, 8)) * (rng.random((40, 8)) < 0.5)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(dense)], "id int, a array<double>")
    from pyspark.ml.functions import array_to_vector
    vectors = df.select("id", array_to_vector("a").alias("v"))
    reduced, s, _ = matrix.reduce_dimensionality(vectors, "v", 3)
    u, want, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(s, want[:3])
    got = np.array([r["reduced"] for r in reduced.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(dense @ vt[:3].T))


def test_svd_of_wide_rows(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    monkeypatch.setattr(matrix, "GRAM_WIDTH", 1)
    dense = np.random.default_rng(1).normal(size=(30, 6))
    df = spark.createDataFrame([(row.tolist(),) for row in dense], "a array<double>").select(array_to_vector("a").alias("v"))
    s, v = matrix.truncated_svd(df, "v", 2)
    assert np.allclose(s, np.linalg.svd(dense)[1][:2]) and v.shape == (6, 2)


def test_stack_stays_sparse(spark, docs):
    model = tfidf.fit_tfidf(docs, "text")
    df = model.transform(docs, "text").withColumn("n", F.lit(1.0))
    kinds = Counter(type(r["features"]).__name__ for r in matrix.combine_features(df, ["tfidf", "n"]).collect())
    assert "SparseVector" in kinds


def test_lemma_paths_agree_on_repeated_forms_without_a_key(spark):
    df = spark.createDataFrame([(["felines", "x"],), ([],), (["felines", "x"],)], "t array<string>")
    table = spark.createDataFrame([("felines", "feline"), ("felines", "cat"), (None, "z"), ("x", None)], "form string, lemma string")
    for limit in (1000, 0):
        got = [r.o for r in text_prep.lemmatize(df, "t", table, "o", small_rows=limit).collect()]
        assert sorted(got) == [[], ["cat", "x"], ["cat", "x"]]


def test_wide_keyword_vocabulary(spark):
    rows = spark.range(50).selectExpr("cast(id as string) as id", "array(concat('k', id), concat('k', id + 4000)) as k")
    vocab = spark.range(5000).selectExpr("concat('k', id) as term", "id as idx")
    for r in vocabulary.keyword_matrix(rows, "k", vocab, "id").collect():
        assert [i for i, v in enumerate(r.features) if v] == [int(r.id), int(r.id) + 4000]
