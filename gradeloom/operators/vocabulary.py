"""Entity and keyword vocabularies, and indicator features from them."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators.lookup import lookup_join
from gradeloom.operators.ranking import sorted_index
from gradeloom.operators.sizes import SMALL_ROWS


def _items(df: DataFrame, items: Column | str, out: str) -> DataFrame:
    """One row per item. The outer form with a filter after it reads the items once;
    the plain form also tests their number before, which computes them a second time."""
    return df.withColumn(out, F.explode_outer(items)).filter(F.col(out).isNotNull())


def entity_vocabulary(df: DataFrame, entities: str, min_freq: int = 5) -> DataFrame:
    """(term, freq, idx): entities that occur ``min_freq`` times or more, index without gaps."""
    counts = (_items(df.select(entities), entities, "term").groupBy("term")
              .agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= min_freq))
    return sorted_index(counts, "term")


def _keyword_list(df: DataFrame, keywords: str, *, keep_empty: bool) -> Column:
    """The keyword column as an array, from an array or a comma-separated string."""
    if df.schema[keywords].dataType.typeName() == "string":
        return X.keyword_items(keywords, keep_empty=keep_empty)
    return F.col(keywords)


def keyword_vocabulary(df: DataFrame, keywords: str) -> DataFrame:
    """(term, idx): the distinct keywords in sorted order. Missing rows do not count.

    Comma-separated strings keep their empty items here, unlike in the features.
    """
    items = _items(df.select(keywords), _keyword_list(df, keywords, keep_empty=True), "term")
    return sorted_index(items.select("term").distinct(), "term")


def indicators(df: DataFrame, items: str, vocabulary: DataFrame, row_id: str,
               small_rows: int = SMALL_ROWS) -> DataFrame:
    """(row_id, idx, term): the vocabulary terms present in each row, once each.

    Repeats go within the row before anything is exploded. A vocabulary too large
    to broadcast is joined in slices (see ``lookup_join``).
    """
    listed = F.array_distinct(_keyword_list(df, items, keep_empty=False))
    present = _items(df.select(row_id, items), listed, "_item").drop(items)
    table = vocabulary.select(F.col("term").alias("_term"), F.col("term"), "idx")
    return (lookup_join(present, table, {"_item": "_term"}, spread_by=[row_id], small_rows=small_rows)
            .select(row_id, "idx", "term"))


def indicator_vectors(df: DataFrame, items: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """``df`` with a sparse 0/1 vector over the vocabulary; rows are not shuffled."""
    # The model needs its terms on the driver, as every vector column needs a width.
    terms = [r["term"] for r in vocabulary.select("term", "idx").orderBy("idx").toLocalIterator()]
    listed = df.withColumn("_items", F.coalesce(_keyword_list(df, items, keep_empty=False),
                                                F.array().cast("array<string>")))
    if not terms:
        raise ValueError("empty vocabulary")
    model = CountVectorizerModel.from_vocabulary(terms, inputCol="_items", outputCol=out)
    return model.setBinary(True).transform(listed).drop("_items")


def keyword_matrix(df: DataFrame, keywords: str, vocabulary: DataFrame, row_id: str) -> DataFrame:
    """(row_id, features): a dense 0/1 array in vocabulary order; rows that repeat ``row_id`` are one.

    The expression doesn't grow with the vocabulary: each row's indexes are looked up, put together again, and
    tested for every position.
    """
    found = (indicators(df, keywords, vocabulary, row_id).groupBy(F.col(row_id).alias("_id"))
             .agg(F.collect_set("idx").alias("_idx")))
    width = vocabulary.count()
    rows = df.select(row_id).distinct().join(found, F.col(row_id).eqNullSafe(F.col("_id")), "left")
    have = F.coalesce("_idx", F.array().cast("array<bigint>"))
    if not width:
        return rows.select(row_id, F.array().cast("array<int>").alias("features"))
    # A map answers each position at once, however many indexes a row has.
    flags = F.map_from_arrays(have, F.array_repeat(F.lit(1), F.size(have)))
    return rows.withColumn("_flags", flags).select(row_id, F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")),
        lambda i: F.coalesce(F.element_at(F.col("_flags"), i), F.lit(0))).alias("features"))
