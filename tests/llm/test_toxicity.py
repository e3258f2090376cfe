import numpy as np
import pytest

from gradeloom.llm import queries, toxicity as T
from gradeloom.llm import words as W
from tests.conftest import SF

DOCS = "doc_id long, text string, score string"


def test_words_and_subwords_against_plain_python():
    cp, at = W.codes(["Ab-cä 1", "", "x"])
    starts, ends = W.runs(W.alphanumeric(cp))
    assert ["".join(map(chr, cp[a:b])) for a, b in zip(starts, ends)] == ["Ab", "cä", "1", "x"]
    cp, _ = W.codes(["abc de"])
    starts, ends = W.runs(W.alphanumeric(cp))
    bucket, owner = T.word_subwords(cp, starts, ends)

    def hashed(t):
        c, _ = W.codes([t])
        return int(W.run_hashes(c, np.array([0]), np.array([len(c)]))[0] % T.BUCKETS)

    want = sorted((hashed(g), i) for i, w in enumerate(("abc", "de"))
                  for g in [w] + [f" {w} "[j:j + n] for n in T.NGRAMS for j in range(len(w) + 3 - n)])
    assert sorted(zip(bucket.tolist(), owner.tolist())) == want


@pytest.fixture(scope="module")
def trained(spark):
    words = ["alpha", "river", "stone", "green", "table", "house", "cloud", "paper"]
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(300):
        text = " ".join(rng.choice(words, 40)) + (" morons worthless" if i % 3 == 0 else "")
        rows.append((i, text, None))
        labels.append((i, i % 3 == 0))
    return T.fit_toxicity(spark.createDataFrame(rows, DOCS),
                          spark.createDataFrame([(i, int(y)) for i, y in labels] + [(None, 1), (5, None), (10**6, 1)],
                                                "doc_id long, toxic int"))


def test_misspelt_words_share_vectors(trained):
    base = "alpha river stone green table house cloud paper " * 5
    clean, seen, misspelt = T.text_scores(trained, [base, base + "morons worthless", base + "moronz worthles"])
    assert clean < 0.3 < misspelt <= seen


def test_defined_results(spark, trained):
    rows = [(1, None, "a"), (2, "", "b"), (3, "!!", "c"), (None, "morons worthless", "d"), (4, "worthless " * 60_000, "e")]
    out = {r.doc_id: r.score for r in T.score_toxicity(spark.createDataFrame(rows, DOCS), trained).collect()}
    assert out[1] == out[2] == out[3] and all(0 <= s <= 1 for s in out.values()) and out[4] > out[1]
    empty = spark.createDataFrame([], DOCS)
    assert T.score_toxicity(empty, trained).collect() == []
    assert T.fit_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert T.score_toxicity(spark.createDataFrame(rows, DOCS), None).first().score == 0.0


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, SF.replace("0.001", "0.1")).collect()}
    labels = spark.read.parquet(SF.replace("0.001", "0.1") + "/labels.parquet").collect()
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels if r.doc_id in got and got[r.doc_id].held_out]
    assert np.mean([p for y, p in held if y]) > 0.65 and np.mean([p for y, p in held if not y]) < 0.03


def test_drop_toxic_keeps_a_callers_score(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", "text", F.lit("mine").alias("score"), F.lit(1).alias("_toxicity"))
    kept = T.drop_toxic(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept.schema == docs.schema
    rows = kept.collect()
    assert rows and {(r.score, r._toxicity) for r in rows} == {("mine", 1)}
    assert len(rows) <= docs.count()


def test_training_makes_no_copy_of_the_sample(monkeypatch):
    import tracemalloc
    monkeypatch.setattr(T, "EPOCHS", 1)
    monkeypatch.setattr(T, "LEAST_STEPS", 1)
    rng = np.random.default_rng(1)
    rows, each = 6000, 2500
    ids, share = rng.integers(0, T.BUCKETS, rows * each, np.int32), rng.random(rows * each, np.float32)
    tracemalloc.start()
    try:
        T.fit_arrays(np.arange(rows) % 2, np.arange(rows + 1) * each, ids, share, 0.5)
        assert tracemalloc.get_traced_memory()[1] < 8 * rows * each
    finally:
        tracemalloc.stop()
