"""Exact positions over data-sized tables, without one task seeing a whole group.

Two building blocks:

* ``running_total`` and ``sorted_index``: range-partition, sort each range, and shift
  each range by the totals of the ranges before it.
* ``hash_thresholds`` and ``hash_segment``: cut every stratum at exact ranks of a hash
  order. A histogram of hash prefixes finds the one prefix that holds each cut, only
  the rows of that prefix are ranked, and the cut value is then compared row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.sizes import SMALL_ROWS, broadcast_if_small, cut_lineage, small_table


def _ranged(df: DataFrame, sort_cols: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned and sorted, with its range number, fixed on disk."""
    cols = [F.col(c) for c in sort_cols]
    placed = (df.repartitionByRange(*cols).sortWithinPartitions(*cols)
              .withColumn("_row", F.monotonically_increasing_id())
              .withColumn("_range", F.shiftright("_row", 33).cast("int")))
    return cut_lineage(placed)


def _local_or_ranged(df: DataFrame, sort_cols: Sequence[str],
                     small_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """``df`` as a local table, or in ranges if it is too large; ``df`` is computed once."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        local = small_table(kept, small_rows)
        return (local, None) if local is not None else (None, _ranged(kept, sort_cols))
    finally:
        kept.unpersist()


def running_total(df: DataFrame, group: str, order: str, value: str, out: str,
                  small_rows: int = SMALL_ROWS) -> DataFrame:
    """Sum of ``value`` over the rows of the group that sort before the row.

    ``order`` is unique within a group.
    """
    local, ranged = _local_or_ranged(df, [group, order], small_rows)
    if local is not None:
        w = (Window.partitionBy(group).orderBy(order)
             .rowsBetween(Window.unboundedPreceding, -1))
        return local.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (ranged.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
              .select(F.col(group).alias("_g"), F.col("_range").alias("_r"),
                      F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift")))
    inside = (Window.partitionBy("_range", group).orderBy("_row")
              .rowsBetween(Window.unboundedPreceding, -1))
    # One row per (range, group): no more than the ranges plus the groups.
    return (ranged.join(broadcast_if_small(shifts),
                        F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
            .withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_shift"))
            .drop("_row", "_range", "_g", "_r", "_shift"))


def sorted_index(distinct: DataFrame, key: str, out: str = "idx",
                 small_rows: int = SMALL_ROWS) -> DataFrame:
    """0, 1, 2, ... in the order of the distinct column ``key``; a NULL comes last."""
    flagged = distinct.withColumn("_missing", F.col(key).isNull())
    local, ranged = _local_or_ranged(flagged, ["_missing", key], small_rows)
    if local is not None:
        # At most small_rows rows, so one ordered window is enough.
        w = Window.orderBy("_missing", key)
        return local.withColumn(out, (F.row_number().over(w) - 1).cast("long")).drop("_missing")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so this window is as small as the number of partitions.
    shifts = (ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
              .select(F.col("_range").alias("_r"),
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
    inside = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.join(broadcast_if_small(shifts), F.col("_range") == F.col("_r"))
            .withColumn(out, inside + F.col("_shift"))
            .drop("_missing", "_row", "_range", "_r", "_shift"))


# ---------------------------------------------------------------------------
# Hash order
# ---------------------------------------------------------------------------

PREFIX = 4  # hex digits: 65,536 prefixes per stratum


def row_key(columns: Sequence[str]) -> Column:
    """One string that identifies a row."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws("\x1f", *parts)


def row_hash(columns: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat(row_key(columns), F.lit(str(seed))))


def hash_thresholds(df: DataFrame, key: Sequence[str], stratum: Column, cuts: DataFrame,
                    seed: int) -> DataFrame:
    """(stratum, thresholds): for each cut the (hash, key) of the row at that rank.

    ``cuts`` holds (stratum, cut, upto): the cut lies behind row ``upto`` of the
    stratum in hash order. ``upto`` 0 lies before the first row.
    """
    hashed = df.select(stratum.alias("s"), row_hash(key, seed).alias("h"), row_key(key).alias("k"))
    hashed = hashed.withColumn("p", F.substring("h", 1, PREFIX))
    upto_here = Window.partitionBy("s").orderBy("p")
    histogram = (hashed.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("cum", F.sum("n").over(upto_here)))
    targets = broadcast_if_small(cuts.select(F.col("stratum").alias("t_s"), "cut", "upto"))
    bounds = (histogram.join(targets, F.col("s").eqNullSafe(F.col("t_s")))
              .filter((F.col("cum") - F.col("n") < F.col("upto")) & (F.col("upto") <= F.col("cum")))
              .select(F.col("s").alias("b_s"), F.col("p").alias("b_p"), "cut",
                      (F.col("upto") - F.col("cum") + F.col("n")).alias("rank")))
    in_bounds = hashed.join(broadcast_if_small(bounds),
                            F.col("s").eqNullSafe(F.col("b_s")) & (F.col("p") == F.col("b_p")))
    by_hash = Window.partitionBy("s", "cut").orderBy("h", "k")
    found = (in_bounds.withColumn("rn", F.row_number().over(by_hash))
             .filter(F.col("rn") == F.col("rank"))
             .select(F.col("s").alias("f_s"), F.col("cut").alias("f_cut"), "h", "k"))
    lowest = F.struct(F.lit("").alias("h"), F.lit("").alias("k"))
    return (targets.join(found, F.col("t_s").eqNullSafe(F.col("f_s")) & (F.col("cut") == F.col("f_cut")), "left")
            .groupBy(F.col("t_s").alias("stratum"))
            .agg(F.collect_list(F.when(F.col("h").isNull(), lowest)
                                .otherwise(F.struct("h", "k"))).alias("thresholds")))


def hash_segment(df: DataFrame, key: Sequence[str], stratum: Column, cuts: DataFrame, seed: int,
                 out: str) -> DataFrame:
    """``df`` with the number of cuts before each row: 0 up to the first cut, and so on.

    The rows themselves are not shuffled: each compares its own hash with the
    thresholds of its stratum.
    """
    thresholds = broadcast_if_small(hash_thresholds(df, key, stratum, cuts, seed))
    me = F.struct(row_hash(key, seed).alias("h"), row_key(key).alias("k"))
    marked = df.withColumns({"_s": stratum, "_me": me})
    t = thresholds.select(F.col("stratum").alias("_t"), "thresholds")
    passed = F.size(F.filter("thresholds", lambda x: x < F.col("_me")))
    return (marked.join(t, F.col("_s").eqNullSafe(F.col("_t")), "left")
            .withColumn(out, F.coalesce(passed, F.lit(0)))
            .drop("_s", "_me", "_t", "thresholds"))
