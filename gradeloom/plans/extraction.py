"""Extraction job: two report corpora to parsed tables and merged cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators.cases import merge_cases
from gradeloom.operators.reports import parse_operative, parse_ultrasound
from gradeloom.sources.tables import read_table, write_table


def run_extraction(spark: SparkSession, ultrasound: DataFrame, operative: DataFrame, folder: str, *,
                   null_keys: str = "drop") -> DataFrame | None:
    """Parse both corpora, store them, and store and return the merged cases.

    ``ultrasound`` and ``operative`` are (report_id, report_text). The join reads the
    stored tables, so each report is parsed once however often its columns are read.
    Returns None when one family has no usable report.
    """
    have_us = write_table(parse_ultrasound(ultrasound), f"{folder}/us_reports")
    have_or = write_table(parse_operative(operative), f"{folder}/or_reports")
    if not (have_us and have_or):
        return None
    merged = merge_cases(read_table(spark, f"{folder}/us_reports"),
                         read_table(spark, f"{folder}/or_reports"), null_keys=null_keys)
    if not write_table(merged, f"{folder}/merged_data"):
        return None
    return read_table(spark, f"{folder}/merged_data")
