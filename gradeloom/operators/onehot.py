"""One-hot features for categorical columns, fitted on the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.lookup import lookup_join
from gradeloom.operators.ranking import sorted_index

# Stands for a missing value that was seen in training; sorts after every other string.
MISSING = "\U0010ffff"


def category_table(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, category, position): the categories of each column in sorted order.

    A missing value seen in training is a category of its own, the last one.
    """
    tables = []
    for column in columns:
        distinct = train.select(F.col(column).cast("string").alias("category")).distinct()
        tables.append(sorted_index(distinct, "category", "position")
                      .select(F.lit(column).alias("feature"), "category", "position"))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def onehot_long(df: DataFrame, columns: Sequence[str], categories: DataFrame, row_id: str) -> DataFrame:
    """(row_id, feature, category, position) of the set indicators; unseen values set none."""
    cells = df.select(row_id, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("_value")) for c in columns])))
    table = categories.select(F.col("feature").alias("_feature"), F.col("category").alias("_category"),
                              "category", "position")
    return (lookup_join(cells, table, {"feature": "_feature", "_value": "_category"},
                        null_safe=True, spread_by=[row_id])
            .select(row_id, "feature", "category", "position"))


def _with_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns})


def fit_onehot(train: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """Vector form: one sparse ``<column>_onehot`` per column, as wide as the training categories."""
    indexer = StringIndexer(inputCols=[f"_{c}" for c in columns], outputCols=[f"_{c}_idx" for c in columns],
                            stringOrderType="alphabetAsc", handleInvalid="keep")
    encoder = OneHotEncoder(inputCols=[f"_{c}_idx" for c in columns],
                            outputCols=[f"{c}_onehot" for c in columns],
                            dropLast=True, handleInvalid="error")
    return Pipeline(stages=[indexer, encoder]).fit(_with_missing(train, columns))


def onehot_vectors(model: PipelineModel, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = model.transform(_with_missing(df, columns))
    return out.drop(*[f"_{c}" for c in columns], *[f"_{c}_idx" for c in columns])
