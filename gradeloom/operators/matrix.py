"""Feature assembly and truncated SVD."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM_WIDTH = 5_000


def combine_features(df: DataFrame, parts: Sequence[str], out: str = "features") -> DataFrame:
    """Side-by-side stack of vector and number columns; sparse stays sparse."""
    return VectorAssembler(inputCols=list(parts), outputCol=out, handleInvalid="error").transform(df)


def truncated_svd(df: DataFrame, features: str, k: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors (features x k) of the uncentred rows.

    Up to GRAM_WIDTH features one distributed pass sums the Gram matrix, whose size
    depends on the features alone, and its eigenvectors are the right vectors. Wider
    rows go through the iterative solver, which reads them many times, so from cache.
    Signs are free.
    """
    vectors = MLUtils.convertVectorColumnsFromML(df.select(features), features)
    rows = RowMatrix(vectors)
    if rows.numCols() <= GRAM_WIDTH:
        gram = rows.computeGramianMatrix().toArray()
        values, v = np.linalg.eigh(gram)
        order = np.argsort(values)[::-1][:k]
        return np.sqrt(np.clip(values[order], 0.0, None)), v[:, order]
    cached = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        svd = RowMatrix(cached).computeSVD(k, computeU=False)
        return svd.s.toArray(), svd.V.toArray()
    finally:
        cached.unpersist()


def reduce_rows(df: DataFrame, features: str, right_vectors: np.ndarray, out: str = "reduced") -> DataFrame:
    """``df`` with its rows projected on the right vectors; rows are not shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(right_vectors))

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        v = shared.value
        for batch in batches:
            out_rows = []
            for kind, indices, values in zip(batch["type"], batch["indices"], batch["values"]):
                out_rows.append((values @ v[indices]) if kind == 0 else (values @ v))
            yield pd.Series(out_rows)

    return df.withColumn(out, project(F.unwrap_udt(features)))


def reduce_dimensionality(df: DataFrame, features: str, k: int = 100,
                          out: str = "reduced") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    s, v = truncated_svd(df, features, k)
    return reduce_rows(df, features, v, out), s, v
