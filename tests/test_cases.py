"""The case join: null rules, duplicates and hot keys."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks import queries as Q
from gradeloom.operators.cases import hot_keys, merge_cases, skew_safe_inner_join
from tests.conftest import SF


def sides(spark):
    left = [(f"u{i}", None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i}", i) for i in range(120)]
    right = [(f"o{i}", None if i % 4 == 0 else "hot" if i % 4 < 3 else f"k{i}", i) for i in range(60)]
    schema = "report_id string, case_id string, n int"
    return left, right, spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


@pytest.mark.parametrize("null_keys", ["match", "drop"])
@pytest.mark.parametrize("hot_rows", [None, 1_000_000, 7])
def test_all_pairs_whatever_the_split(spark, null_keys, hot_rows):
    left, right, l, r = sides(spark)
    want = Counter((a[0], b[0]) for a in left for b in right
                   if a[1] == b[1] and (null_keys == "match" or a[1] is not None))
    joined = merge_cases(l, r, null_keys=null_keys, hot_rows=hot_rows)
    got = Counter((row["report_id_us"], row["report_id_or"]) for row in joined.collect())
    assert got == want


def test_hot_keys_get_slices_on_both_sides(spark):
    _, _, l, r = sides(spark)
    rows = {h["hot_key"]: (h["l_slices"], h["r_slices"]) for h in hot_keys(l, r, "case_id", 10).collect()}
    assert rows == {None: (4, 2), "hot": (4, 3)}


def test_columns_and_suffixes(spark):
    _, _, l, r = sides(spark)
    assert merge_cases(l, r).columns == ["report_id_us", "case_id", "n_us", "report_type_us",
                                         "report_id_or", "n_or", "report_type_or"]


def test_unknown_null_rule(spark):
    _, _, l, r = sides(spark)
    with pytest.raises(ValueError):
        skew_safe_inner_join(l, r, "case_id", null_keys="maybe")


def test_whole_table_counts(spark):
    assert Q.merged(spark, SF).count() == 1101
    assert Q.merged(spark, SF, null_keys="drop").count() == 1099
    assert Q.merged(spark, SF, hot_rows=2).count() == 1101


def test_pair_counts_labelled_only(spark):
    from gradeloom.operators import cases as C
    left = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), ("b", "x")], "k string, u string")
    right = spark.createDataFrame([("a", "p"), ("a", None), (None, "q"), ("b", "p")], "k string, o string")
    every = {(r.u, r.o): r.n for r in C.pair_counts(left, right, "k", "u", "o", null_keys="match").collect()}
    only = {(r.u, r.o): r.n for r in C.pair_counts(left, right, "k", "u", "o", null_keys="match",
                                                  labelled_only=True).collect()}
    assert only == {k: v for k, v in every.items() if None not in k} == {("x", "p"): 2, ("y", "q"): 1}


def test_no_task_makes_all_pairs_of_a_frequent_key(spark):
    """5,000 x 4,000 reports of one case, and of none, are spread over a grid by default."""
    def side(n, name):
        return spark.range(n).select(F.concat(F.lit(name), "id").alias("report_id"), F.when(F.col("id") % 2 == 0, "c").alias("case_id"))

    left, right = side(10_000, "u"), side(8_000, "o")
    hot = {r.hot_key: (r.l_slices, r.r_slices) for r in hot_keys(left, right, "case_id").collect()}
    assert hot == {"c": (5, 4), None: (5, 4)}
    out = merge_cases(left, right, null_keys="match")
    per_task = out.groupBy(F.spark_partition_id().alias("p"), "case_id").count()
    assert out.count() == 2 * 5_000 * 4_000
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in fixed}
    try:
        for name, value in fixed.items():
            spark.conf.set(name, value)
        counts = [r["count"] for r in per_task.collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert max(counts) < 5_000 * 4_000 / 2
