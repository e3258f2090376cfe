"""Metrics against published values and brute force."""

import random
from collections import Counter

import pytest

from checks import queries
from gradeloom.operators import evaluation, metrics
from tests.conftest import SF

# (true, predicted): rows, of the published run of 315 test rows.
PUBLISHED = {(0, 0): 3, (1, 1): 48, (2, 2): 19, (3, 3): 243, (3, 1): 1, (3, 2): 1}


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [pair for pair, n in PUBLISHED.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "y int, p int")
    return metrics.confusion_matrix(df, "y", "p")


def test_published_summary(matrix):
    row = metrics.summary(matrix).first()
    assert row["accuracy"] == pytest.approx(0.9936507936507937, abs=1e-15)
    assert row["precision"] == pytest.approx(0.9938743116294136, abs=1e-15)
    assert row["recall"] == pytest.approx(0.9936507936507937, abs=1e-15)
    assert row["f1_score"] == pytest.approx(0.9936948469566351, abs=1e-15)
    assert row["sample_size"] == 315


def test_published_classes(matrix):
    rows = {r["label"]: r for r in metrics.class_report(matrix).collect()}
    assert rows[1]["precision"] == pytest.approx(0.9795918367346939)
    assert rows[2]["precision"] == pytest.approx(0.95)
    assert rows[2]["f1_score"] == pytest.approx(0.9743589743589743)
    assert rows[3]["recall"] == pytest.approx(0.9918367346938776)
    assert [rows[i]["support"] for i in range(4)] == [3, 48, 19, 245]
    macro = metrics.macro_average(metrics.class_report(matrix)).first()
    assert macro["precision"] == pytest.approx(0.9823979591836735)
    assert macro["recall"] == pytest.approx(0.9979591836734694)
    assert macro["f1_score"] == pytest.approx(0.9899878338381803)


def test_wide_matrix(matrix):
    rows = {r["truth"]: tuple(r)[1:] for r in metrics.confusion_wide(matrix, [0, 1, 2, 3]).collect()}
    assert rows == {0: (3, 0, 0, 0), 1: (0, 48, 0, 0), 2: (0, 0, 19, 0), 3: (0, 1, 1, 243)}


def test_zero_division_and_kappa(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "c"), (None, None)], "y string, p string")
    report = {r["label"]: tuple(r)[1:] for r in metrics.class_report(metrics.confusion_matrix(df, "y", "p")).collect()}
    assert report["a"] == (0.0, 0.0, 0.0, 2) and report["b"] == (0.0, 0.0, 0.0, 0)
    assert report[None] == (1.0, 1.0, 1.0, 1)
    row = metrics.summary(metrics.confusion_matrix(df, "y", "p")).first()
    # Agreement 2/4; by chance (2*0 + 0*2 + 1*1 + 1*1) / 16.
    assert row["kappa"] == pytest.approx((0.5 - 0.125) / 0.875)
    assert metrics.accuracy(df, "y", "p").first()[0] == 0.5


def brute_auc(rows, k):
    total = weight = 0
    for c in range(k):
        pos = [s[c] for y, s in rows if y == c]
        neg = [s[c] for y, s in rows if y != c]
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        total += wins / (len(pos) * len(neg)) * len(pos)
        weight += len(pos)
    return total / weight


@pytest.mark.parametrize("small_rows", [100_000, 0])
def test_auc_against_all_pairs(spark, small_rows):
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        w = [rng.randrange(1, 8) for _ in range(3)]
        rows.append((rng.randrange(3), [x / sum(w) for x in w]))
    df = spark.createDataFrame(rows, "y int, s array<double>")
    assert metrics.auc_ovr(df, "y", "s", small_rows=small_rows).first()[0] == pytest.approx(brute_auc(rows, 3), abs=1e-12)


@pytest.mark.parametrize("rows", [
    [(0, [0.5, 0.5]), (1, [0.1, 0.9])],                                             # two classes
    [(0, [0.5, 0.3, 0.2]), (1, [0.1, 0.8, 0.1])],                                   # a class without rows
    [(0, [0.5, 0.3, 0.3]), (1, [0.1, 0.8, 0.1]), (2, [0.2, 0.2, 0.6])],             # no probabilities
])
def test_undefined_auc(spark, rows):
    df = spark.createDataFrame(rows, "y int, s array<double>")
    assert metrics.auc_ovr(df, "y", "s").first()[0] is None


def test_annotator_with_unseen_grades(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "z"), ("b", "b"), ("a", "z")],
                               "surgeon_adjudicated_grade string, manually_extracted_grade string")
    row = evaluation.evaluate_annotator(df).first()
    assert (row["method"], row["accuracy"], row["unseen_rows"], row["auc"]) == ("Manual Extraction", 0.5, 2, None)


def test_responder_on_stored_answers(spark):
    truth = spark.createDataFrame([("r1", "Normal"), ("r2", "Perforated"), ("r3", "Gangrenous")], "report_id string, g string")
    answers = spark.createDataFrame([("r1", "normal"), ("r2", "ruptured"), ("r9", "mild")], "report_id string, response string")
    row = evaluation.evaluate_responder(answers, truth, "g", "Responder").first()
    assert (row["accuracy"], row["sample_size"]) == (pytest.approx(2 / 3), 3)
    assert evaluation.evaluate_responder(answers, truth, "g", "R", sample_size=2).first()["sample_size"] == 2


def test_comparison_and_best(spark):
    one = spark.createDataFrame([("A", 0.99365, 0.99387, 0.9937, 0.99369, 0.99984, None, 315, 0)],
                                "method string, accuracy double, precision double, recall double, f1_score double, "
                                "auc double, kappa double, sample_size long, fit_order int")
    two = spark.createDataFrame([("B", 0.99365, 0.5, 1)], "method string, accuracy double, precision double, fit_order int")
    rows = evaluation.comparison_table([one, None, two]).collect()
    assert tuple(rows[0]) == ("A", "0.9937", "0.9939", "0.9937", "0.9937", "0.9998", "N/A", 315)
    assert tuple(rows[1])[:4] == ("B", "0.9937", "0.5000", "N/A")
    assert evaluation.best_method(evaluation.union_results([two, one])).first()["method"] == "A"
    with pytest.raises(ValueError):
        evaluation.union_results([None])


def test_pairing_by_key(spark):
    y = spark.createDataFrame([(1, "a"), (2, "b"), (4, "b")], "report_id int, y string")
    p = spark.createDataFrame([(2, "b"), (1, "c"), (3, "a")], "report_id int, p string")
    got = Counter((r["y"], r["p"]) for r in metrics.pair_predictions(y, p, "report_id").collect())
    assert got == {("a", "c"): 1, ("b", "b"): 1, ("b", None): 1}


def test_methods_that_read_the_reports_share_one_parse(spark, monkeypatch):
    parsed = []
    parse = queries.ultrasound
    monkeypatch.setattr(queries, "ultrasound", lambda *a: parsed.append(1) or parse(*a))
    assert queries.comparison_table(spark, SF).count() == 3
    assert len(parsed) == 1
