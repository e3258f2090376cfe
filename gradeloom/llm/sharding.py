"""Shards by a hierarchical weighted hash tree, in Spark SQL expressions alone.

Law ``key``: a row's shard follows from its doc_id and the tree of shards alone. The tree has three levels, regions,
racks and shards; shard ``i`` sits in rack ``i // SHARDS_PER_RACK`` and that rack in region
``rack // RACKS_PER_REGION``. Every shard draws ``-ln(u) / weight`` with ``u`` uniform from ``xxhash64(doc_id, i)``
(an exponential race); a rack's draw is the least draw of its shards, a region's the least of its racks, and the row
descends region, rack, shard, always to the least draw. A subtree's draw is the least of its leaves, not a draw of
its own: with independent draws per level (straw buckets) a row that moves into a grown rack could land on any of its
shards; with this one a grown weight only lowers the draws inside its own subtree, so rows move only into the shard
that grew or was added, never between old shards.

Fixed values of the query: 24 shards, 2 regions of 3 racks of 4 shards, equal weights.

Defined cases: a null text has size 8 and ``text_crc32`` 0 (the CRC of no bytes); Spark's hash skips a null doc_id,
so its draws come from the shard numbers alone and all null ids share one shard; repeated rows get their own slots;
an empty table gives no rows; other columns of ``docs`` are left out, whatever their names.
``slot`` numbers a shard's rows from 0 without gaps, ordered by (doc_id, size, text_crc32); rows equal in all three
are interchangeable in the result. The order is made by a range-partitioned sort whose last key is a row stamp, so
one hot doc_id spreads over many tasks; per (task, shard) counts, summed in order, give each task its first slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.storage import scratch, stored

SHARDS, REGIONS, RACKS_PER_REGION, SHARDS_PER_RACK = 24, 2, 3, 4
LAW = "key"
_ROW_BYTES = 8


def draws(doc_id: Column, n: int, weights: list[float] | None = None) -> Column:
    """Array of the n shards' draws for a doc_id: ``-ln(u) / w``, u from the 53 high bits of xxhash64(doc_id, i)."""
    weights = weights or [1.0] * n
    w = F.array(*[F.lit(float(x)) for x in weights])
    u = lambda i: (F.shiftrightunsigned(F.xxhash64(doc_id, i.cast("long")), 11).cast("double") + 0.5) / float(1 << 53)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: -F.log(u(i)) / F.element_at(w, i + 1))


def _argmin(values: Column) -> Column:
    """0-based position of the least value (the first of equal ones)."""
    return F.array_position(values, F.array_min(values)).cast("int") - 1


def descend(d: Column, n: int) -> Column:
    """Shard reached by descending region, rack and shard, each by the least draw of its subtree."""
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    n_racks = -(-n // SHARDS_PER_RACK)
    n_regions = -(-n_racks // RACKS_PER_REGION)

    def least(lo: int, hi: int) -> Column:  # least draw of shards lo .. hi - 1
        return F.array_min(F.slice(d, lo + 1, min(hi, n) - lo))

    region = _argmin(F.array(*[least(g * per_region, (g + 1) * per_region) for g in range(n_regions)]))
    # racks of the chosen region; a missing rack of the last region draws +inf
    rack_of = lambda g, k: (least((g * RACKS_PER_REGION + k) * SHARDS_PER_RACK, (g * RACKS_PER_REGION + k + 1) * SHARDS_PER_RACK)
                            if (g * RACKS_PER_REGION + k) < n_racks else F.lit(float("inf")))
    rack_draws = F.array(*[
        F.coalesce(*[F.when(region == g, rack_of(g, k)) for g in range(n_regions)], F.lit(float("inf")))
        for k in range(RACKS_PER_REGION)])
    rack = region * RACKS_PER_REGION + _argmin(rack_draws)
    shard_draws = F.array(*[
        F.when(rack * SHARDS_PER_RACK + s < n, F.element_at(d, rack * SHARDS_PER_RACK + s + 1)).otherwise(float("inf"))
        for s in range(SHARDS_PER_RACK)])
    return rack * SHARDS_PER_RACK + _argmin(shard_draws)


def assign(docs: DataFrame, n: int = SHARDS, weights: list[float] | None = None, grow: bool = True) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard with one more, of weight 1)."""
    d = F.col("_draws")  # a clashing column of that name in ``docs`` is dropped by the first select
    grown = draws(F.col("doc_id"), n + 1, (weights or [1.0] * n) + [1.0]) if grow else None
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + _ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("_draws", draws(F.col("doc_id"), n, weights))
    rows = rows.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), descend(d, n).alias("shard"),
        (descend(grown, n + 1) if grow else F.lit(None)).cast("int").alias("grown_shard"))
    return with_slots(rows)


def with_slots(rows: DataFrame) -> DataFrame:
    """``slot``: rank within the shard from 0, by a range-partitioned sort, without a window over a whole shard."""
    order = ["shard", "doc_id", "size", "text_crc32", "_stamp"]
    with scratch(rows.sparkSession) as keep:
        # written once: both uses below must see the same tasks, and the documents are read once
        spread = stored(rows.withColumn("_stamp", F.monotonically_increasing_id())
                        .repartitionByRange(*order).sortWithinPartitions(*order)
                        .withColumn("_at", F.monotonically_increasing_id()))
        part = F.shiftright("_at", 33)
        counts = spread.groupBy("shard", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
        before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("shard", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        # at most (tasks + shards) rows: a range-sorted task holds a run of shards
        out = spread.withColumn("_part", part).join(F.broadcast(starts), ["shard", "_part"])
        return keep(out.select("doc_id", "size", "text_crc32", "law", "shard",
                               (F.col("_start") + F.col("_at") - F.col("_first")).alias("slot"), "grown_shard"))
