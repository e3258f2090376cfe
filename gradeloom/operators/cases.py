"""Inner join of the two report families on the case id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.reports import tag_family
from gradeloom.operators.sizes import broadcast_if_small

# A key is hot from this many rows on, so a table has at most rows / HOT_ROWS of them. A cell of a hot key's grid makes
# about HOT_ROWS * HOT_ROWS pairs, which is what bounds a task: rows of a key grow with the table, their pairs with its square.
HOT_ROWS = 1_000


def _heavy_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= hot_rows))


def hot_keys(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys that are hot on either side, with the number of slices for each side.

    Reads only the key column of both sides and combines map-side.
    """
    l_counts = _heavy_keys(left, key, hot_rows).select(
        F.col(key).alias("hot_key"), F.col("n").alias("l_n"), F.lit(0).cast("long").alias("r_n"))
    r_counts = _heavy_keys(right, key, hot_rows).select(
        F.col(key).alias("hot_key"), F.lit(0).cast("long").alias("l_n"), F.col("n").alias("r_n"))

    def slices(n: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / F.lit(hot_rows))).cast("int")

    return (l_counts.unionByName(r_counts).groupBy("hot_key")
            .agg(F.max("l_n").alias("l_n"), F.max("r_n").alias("r_n"))
            .select("hot_key", slices(F.col("l_n")).alias("l_slices"),
                    slices(F.col("r_n")).alias("r_slices")))


def _sliced(df: DataFrame, key: str, hot: DataFrame, own: str, other: str,
            own_slice: str, other_slice: str, row_id: str) -> DataFrame:
    """Place each row in one own slice and copy it to every slice of the other side."""
    marked = df.join(hot, F.col(key).eqNullSafe(F.col("hot_key")), "left")
    slice_of_row = F.pmod(F.xxhash64(row_id), F.coalesce(F.col(own), F.lit(1))).cast("int")
    copies = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
    return (marked.withColumn(own_slice, slice_of_row)
            .withColumn(other_slice, F.explode(copies))
            .drop("hot_key", "l_slices", "r_slices"))


def skew_safe_inner_join(left: DataFrame, right: DataFrame, key: str, *, null_keys: str = "match",
                         row_id: str = "report_id", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Inner equi-join whose hot keys are spread over a grid of tasks.

    A hot key with L and R rows becomes a grid of slices of about ``hot_rows`` rows
    a side, so no task holds the whole group; other keys stay in one slice. The
    result has every pair, whatever the skew. ``null_keys='match'`` joins missing
    keys to each other, ``'drop'`` leaves them out.
    """
    if null_keys not in ("match", "drop"):
        raise ValueError("null_keys must be 'match' or 'drop'")
    if null_keys == "drop":
        left, right = left.filter(F.col(key).isNotNull()), right.filter(F.col(key).isNotNull())
    if hot_rows is None:
        condition_cols = []
    else:
        hot = broadcast_if_small(hot_keys(left, right, key, hot_rows))
        left = _sliced(left, key, hot, "l_slices", "r_slices", "_i", "_j", row_id)
        right = _sliced(right, key, hot, "r_slices", "l_slices", "_j", "_i", row_id)
        condition_cols = ["_i", "_j"]
    r_names = {c: f"_r_{c}" for c in [key, *condition_cols]}
    right = right.withColumnsRenamed(r_names)
    match = (F.col(key) == F.col(f"_r_{key}") if null_keys == "drop"
             else F.col(key).eqNullSafe(F.col(f"_r_{key}")))
    for c in condition_cols:
        match = match & (F.col(c) == F.col(f"_r_{c}"))
    return left.join(right, match, "inner").drop(*r_names.values(), *condition_cols)


def pair_counts(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str, *,
                null_keys: str = "drop", labelled_only: bool = False) -> DataFrame:
    """(left_value, right_value, n): how many pairs of the join have each pair of values, without making the pairs.

    Each side is counted by key and value first, so a key adds at most one row for each pair of values.
    ``labelled_only`` leaves out pairs with a null value. It filters the summed counts, not the rows: a filter on the
    values would be pushed into both inputs and parse every report once for it and once for the value.
    """
    if null_keys not in ("match", "drop"):
        raise ValueError("null_keys must be 'match' or 'drop'")
    l = left.groupBy(F.col(key).alias("_l"), left_value).agg(F.count(F.lit(1)).alias("_ln"))
    r = right.groupBy(F.col(key).alias("_r"), right_value).agg(F.count(F.lit(1)).alias("_rn"))
    same = F.col("_l").eqNullSafe(F.col("_r")) if null_keys == "match" else F.col("_l") == F.col("_r")
    pairs = F.col("_ln") * F.col("_rn")
    if not labelled_only:
        return l.join(r, same).groupBy(left_value, right_value).agg(F.sum(pairs).alias("n"))
    both = F.col(left_value).isNotNull() & F.col(right_value).isNotNull()
    return (l.join(r, same).groupBy(left_value, right_value).agg(F.sum(F.when(both, pairs)).alias("n"))
            .where(F.col("n").isNotNull()))


def merge_cases(ultrasound: DataFrame, operative: DataFrame, *, null_keys: str = "drop",
                hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row per (ultrasound, operative) report pair of a case; shared names get a suffix.

    Reports without a case id are left out; ``null_keys='match'`` joins all of them to each other.
    """
    us, op = tag_family(ultrasound, "ultrasound"), tag_family(operative, "operative")
    shared = [c for c in us.columns if c in op.columns and c != "case_id"]
    row_id = "_row_id"
    us = us.withColumn(row_id, F.col("report_id")).withColumnsRenamed({c: f"{c}_us" for c in shared})
    op = op.withColumn(row_id, F.col("report_id")).withColumnsRenamed({c: f"{c}_or" for c in shared})
    return skew_safe_inner_join(us, op, "case_id", null_keys=null_keys, row_id=row_id,
                                hot_rows=hot_rows).drop(row_id)
