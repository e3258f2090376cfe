"""Exact ranks, splits, folds and samples; the distributed paths against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import ranking, split
from gradeloom.operators.labels import encode_labels, label_distribution, label_map
from gradeloom.operators.lookup import lookup_join
from gradeloom.operators.sizes import broadcast_if_small, small_table


@pytest.mark.parametrize("small_rows", [100_000, 0])
def test_sorted_index(spark, small_rows):
    terms = [f"t{i:03d}" for i in range(500)] + [None]
    random.Random(1).shuffle(terms)
    df = spark.createDataFrame([(t,) for t in terms], "term string").repartition(7)
    got = {r["term"]: r["idx"] for r in ranking.sorted_index(df, "term", small_rows=small_rows).collect()}
    want = {t: i for i, t in enumerate(sorted(t for t in terms if t))}
    want[None] = 500
    assert got == want


@pytest.mark.parametrize("small_rows", [100_000, 0])
def test_running_total(spark, small_rows):
    rng = random.Random(2)
    # Group "a" holds most rows, so it spans several ranges.
    rows = [("a", i, rng.randrange(5)) for i in range(900)] + [("b", i, rng.randrange(5)) for i in range(30)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "g string, o int, v long")
    got = {(r["g"], r["o"]): r["t"] for r in ranking.running_total(df, "g", "o", "v", "t", small_rows).collect()}
    want, seen = {}, {}
    for g, o, v in rows:
        want[g, o] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + v
    assert got == want


def labelled(spark, sizes):
    rows = [(f"{label}-{i}", label) for label, n in sizes.items() for i in range(n)]
    random.Random(3).shuffle(rows)
    return rows, spark.createDataFrame(rows, "id string, label string").repartition(5)


def quotas(counts, total):
    n = sum(counts.values())
    out = {k: total * c // n for k, c in counts.items()}
    short = total - sum(out.values())
    order = sorted(counts, key=lambda k: (-(total * counts[k] % n), k is None, k or ""))
    for k in order[:short]:
        out[k] += 1
    return out


def test_split_takes_exact_quotas_in_hash_order(spark):
    sizes = {"x": 701, "y": 97, "z": 11, None: 30, "single": 1}
    rows, df = labelled(spark, sizes)
    got = {r["id"]: r["split"] for r in split.stratified_split(df, "label", ["id"]).collect()}
    usable = {k: c for k, c in sizes.items() if c >= 2}
    n = sum(usable.values())
    test = quotas(usable, math.ceil(0.15 * n))
    rest = {k: usable[k] - test[k] for k in usable}
    val = quotas(rest, math.ceil(0.15 / (1 - 0.15) * (n - sum(test.values()))))
    for label, n in sizes.items():
        ids = sorted((i for i, l in rows if l == label),
                     key=lambda i: (hashlib.md5(f"{i}42".encode()).hexdigest(), i))
        t, v = test.get(label, 0), val.get(label, 0)
        assert [got[i] for i in ids] == ["test"] * t + ["val"] * v + ["train"] * (n - t - v), label


def test_split_totals_of_the_published_run(spark):
    # 2,100 rows give 315 / 315 / 1,470.
    _, df = labelled(spark, {"a": 20, "b": 320, "c": 127, "d": 1633})
    sizes = {r["split"]: r["n"] for r in split.split_sizes(split.stratified_split(df, "label", ["id"])).collect()}
    assert sizes == {"test": 315, "val": 315, "train": 1470}


def test_folds_are_level(spark):
    _, df = labelled(spark, {"a": 100, "b": 31})
    counts = split.stratified_folds(df, "label", ["id"], 3).groupBy("label", "fold").count().collect()
    for label, n in (("a", 100), ("b", 31)):
        sizes = sorted(r["count"] for r in counts if r["label"] == label)
        assert sum(sizes) == n and sizes[-1] - sizes[0] <= 1 and len(sizes) == 3


@pytest.mark.parametrize("k", [0, 1, 37, 200, 500])
def test_sample_paths_agree(spark, k):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"))
    top = {r["id"] for r in split.random_sample(df, k, ["id"]).collect()}
    cut = {r["id"] for r in split.random_sample(df, k, ["id"], sort_limit=-1).collect()}
    assert top == cut and len(top) == min(k, 200)


@pytest.mark.parametrize("k", [1, 15, 40, 199])
def test_sample_of_repeated_keys_is_exact(spark, k):
    df = spark.range(200).selectExpr("cast(id % 20 as string) as id")
    for limit in (1000, -1):
        assert split.random_sample(df, k, ["id"], sort_limit=limit).count() == k


def test_label_map_puts_missing_last(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "g string")
    mapping = label_map(df, "g")
    assert {tuple(r) for r in mapping.collect()} == {("a", 0), ("b", 1), (None, 2)}
    other = spark.createDataFrame([("a",), (None,), ("new",)], "g string")
    assert {tuple(r) for r in encode_labels(other, "g", mapping).collect()} == {("a", 0), (None, 2), ("new", None)}
    assert {tuple(r) for r in label_distribution(df, "g").collect()} == {("a", 1), ("b", 2)}


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_lookup_paths_agree(spark, how, null_safe):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(90)], "id int, k string")
    table = spark.createDataFrame([("hot", 1), (None, 2), ("k6", 3)], "key string, v int")
    def run(limit):
        return sorted(map(tuple, lookup_join(df, table, {"k": "key"}, how, spread_by=["id"], null_safe=null_safe,
                                             small_rows=limit).select("id", "v").collect()), key=str)
    assert run(100_000) == run(0)


def test_small_tables_are_checked(spark):
    df = spark.range(50)
    assert small_table(df, 49) is None
    assert small_table(df, 50).count() == 50
    assert "broadcast" not in broadcast_if_small(df, 10)._jdf.queryExecution().analyzed().toString().lower()
