"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return f"{top.rstrip('/')}/gradeloom-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, limit: str = "2m") -> Iterator[None]:
    """Arrow batches of few bytes while a job starts: rows here carry whole texts and sets."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove the tables that are stored within, when it ends. It gives a function that writes the result, which stays.

    The files of a result stay until the folder is cleaned (or the scratch around it ends), as a lazy plan reads them.
    """
    own: list[str] = []
    _scopes.append(own)

    def keep(df: DataFrame) -> DataFrame:
        _scopes.pop()  # scopes are nested, so the last one is this one
        try:
            return stored(df)
        finally:
            _scopes.append(own)

    try:
        yield keep
    finally:
        _scopes.pop()
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: lineage ends there, and a lost executor loses nothing."""
    path = shared_folder(df.sparkSession)
    if _scopes:
        _scopes[-1].append(path)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
