"""Report corpora: folders of text files, or tables with an id and a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_report_files(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(report_id, report_text), one row per file below ``folder``; the id is the file stem."""
    files = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
             .text(folder, wholetext=True))
    # File names come percent-encoded, with plus signs as they are.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", F.lit(""))
    return files.select(stem.alias("report_id"), F.col("value").alias("report_text"))


def read_report_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same two columns from any table, the form for very many reports."""
    return df.select(F.col(id_col).cast("string").alias("report_id"),
                     F.col(text_col).alias("report_text"))
