"""Parsing and cleaning are stateless, so they run on a stream as they stand."""

from gradeloom.functions import text as X
from gradeloom.operators.reports import parse_ultrasound


def test_parse_a_stream_of_reports(spark, tmp_path):
    reports = [("CASE-AB1-7", "FINDINGS: Free fluid.\n\nIMPRESSION: normal"), ("r2", " ")]
    spark.createDataFrame(reports, "report_id string, report_text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("report_id string, report_text string").parquet(f"{tmp_path}/in")
    parsed = parse_ultrasound(stream).withColumn("cleaned_text", X.clean("report_text"))
    query = (parsed.writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    query.awaitTermination(60)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r["case_id"], r["severity_grade"], r["has_free_fluid"], r["cleaned_text"]) for r in rows] == [
        ("CASE-AB1-7", "Normal", True, "findings free fluid impression normal")]
