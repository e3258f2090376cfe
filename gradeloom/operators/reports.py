"""Report parsing: whole report tables to typed fields, in one map-only pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import patterns as P
from gradeloom.functions import text as X


def usable_reports(reports: DataFrame) -> DataFrame:
    """(report_id, report_text) with trimmed text; reports without text are dropped."""
    return (reports.select("report_id", X.strip("report_text").alias("report_text"))
            .filter(F.col("report_text") != ""))


def extraction_counts(reports: DataFrame) -> DataFrame:
    """How many reports there are and how many of them hold text."""
    has_text = F.coalesce(X.strip("report_text") != "", F.lit(False))
    return reports.agg(F.count(F.lit(1)).alias("total_reports"),
                       F.count_if(has_text).alias("successful_reports"))


# The parsers project in stages: a section is cut out once and its flags, numbers
# and grade read the finished column. Catalyst keeps such stages apart when merging
# them would repeat an expensive expression.


def parse_ultrasound(reports: DataFrame) -> DataFrame:
    sections = usable_reports(reports).select(
        "report_id",
        "report_text",
        F.current_timestamp().alias("extraction_timestamp"),
        X.case_id("report_text", "report_id").alias("case_id"),
        X.exam_date("report_text").alias("exam_date"),
        X.section("report_text", "CLINICAL INFORMATION", P.STOP_AT_PARAGRAPH_OR_HEADING)
         .alias("clinical_information"),
        X.section("report_text", "FINDINGS", P.STOP_AT_IMPRESSION).alias("findings"),
        X.section("report_text", "IMPRESSION", P.STOP_AT_PARAGRAPH).alias("impression"),
    )
    lowered = sections.withColumns({"_findings": F.lower("findings"),
                                    "_impression": F.lower("impression")})
    return lowered.select(
        "report_id", "report_text", "extraction_timestamp", "case_id", "exam_date",
        "clinical_information", "findings",
        X.number_of("findings", P.APPENDIX_MM).alias("appendix_diameter_mm"),
        X.number_of("findings", P.WALL_MM).alias("wall_thickness_mm"),
        *[X.contains_any("_findings", t).alias(n) for n, t in P.ULTRASOUND_FLAGS.items()],
        "impression",
        X.report_grade("_impression").alias("severity_grade"),
    )


def parse_operative(reports: DataFrame) -> DataFrame:
    stop = P.STOP_AT_PARAGRAPH_OR_HEADING
    sections = usable_reports(reports).select(
        "report_id",
        "report_text",
        F.current_timestamp().alias("extraction_timestamp"),
        X.case_id("report_text", "report_id").alias("case_id"),
        X.first_match("report_text", P.OPERATION_DATE, ignore_case=True).alias("operation_date"),
        X.section("report_text", "Surgeon", P.STOP_AT_LINE_END, multiline=False).alias("surgeon"),
        X.section("report_text", "Pre-operative diagnosis", stop).alias("preop_diagnosis"),
        X.section("report_text", "Post-operative diagnosis", stop).alias("postop_diagnosis"),
        X.section("report_text", "operative findings", stop).alias("operative_findings"),
    )
    lowered = sections.withColumns({"_postop": F.lower("postop_diagnosis"),
                                    "_findings": F.lower("operative_findings")})
    return lowered.select(
        "report_id", "report_text", "extraction_timestamp", "case_id", "operation_date",
        "surgeon", "preop_diagnosis", "postop_diagnosis",
        X.report_grade("_postop").alias("severity_grade"),
        "operative_findings",
        *[X.contains_any("_findings", t).alias(n) for n, t in P.OPERATIVE_FLAGS.items()],
    )


def tag_family(reports: DataFrame, family: str) -> DataFrame:
    return reports.withColumn("report_type", F.lit(family))
