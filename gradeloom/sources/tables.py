"""Table readers and writers: Parquet between stages, CSV and JSON at the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType | str | None = None) -> DataFrame | None:
    """A stored table, or None when nothing is stored there.

    CSV has a header and quoted multi-line fields. Without a schema its types are
    inferred, which reads the file once more.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(**CSV)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def balanced(scan: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are task slots.

    Text work is bound by processor time, and a file with few row groups would keep
    most slots idle. Large scans have partitions enough and pass unchanged.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= slots else scan.repartition(slots)


def write_table(df: DataFrame | None, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> bool:
    """Write ``df`` and say whether there was anything to write.

    CSV holds no arrays, so there they become comma-separated strings.
    """
    if df is None or df.isEmpty():
        return False
    if fmt == "csv":
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
        df = df.withColumns({a: F.array_join(a, ",") for a in arrays}) if arrays else df
        writer = df.write.mode("overwrite").options(header=True, quote='"', escape='"')
    else:
        writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    return True


def write_splits(df: DataFrame, labels: DataFrame, folder: str) -> None:
    """The prepared rows as one table partitioned by split, and the label map."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/prepared")
    labels.write.mode("overwrite").parquet(f"{folder}/label_map")


def read_split(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """All prepared rows, or one split; only the files of that split are read."""
    df = spark.read.parquet(f"{folder}/prepared")
    return df if split is None else df.filter(F.col("split") == split)


def write_features(df: DataFrame, folder: str, name: str = "features") -> None:
    """Feature vectors as Parquet; sparse vectors stay sparse."""
    writer = df.write.mode("overwrite")
    if "split" in df.columns:
        writer = writer.partitionBy("split")
    writer.parquet(f"{folder}/{name}")


def read_features(spark: SparkSession, folder: str, name: str = "features") -> DataFrame | None:
    return read_table(spark, f"{folder}/{name}")


def write_evaluation(results: DataFrame, comparison: DataFrame, folder: str) -> None:
    """Result rows as JSON by method, and the comparison as CSV with a header."""
    slug = F.lower(F.replace(F.col("method"), F.lit(" "), F.lit("_")))
    (results.withColumn("name", slug).write.mode("overwrite").partitionBy("name")
     .json(f"{folder}/results"))
    # A handful of rows, one per method.
    comparison.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/comparison")
