"""Times, reasons and best results by hand."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import texts


def test_relative_times(spark):
    now = datetime(2024, 3, 10, 12)
    cases = {0: "Just now", 59: "Just now", 60: "1 minute ago", 3599: "59 minutes ago", 3600: "1 hour ago", 86399: "23 hours ago", 86400: "Yesterday", 2 * 86400 - 1: "Yesterday", 2 * 86400: "2 days ago", 7 * 86400: "March 3, 2024"}
    df = spark.createDataFrame([(s, now - timedelta(seconds=s)) for s in cases], "s long, t timestamp")
    assert {r["s"]: r["x"] for r in df.select("s", texts.relative_time(F.col("t"), F.lit("2024-03-10 12:00:00").cast("timestamp")).alias("x")).collect()} == cases


def test_timestamps(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z", True), ("2024-01-02", False), ("Tuesday", False), ("", False), (None, False)], "t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", texts.is_timestamp(F.col("t")).alias("got")).collect())


def test_reasons(spark):
    kinds = "level string, jurisdiction string, entity_status string, legal_form string, days int, city string, country string"
    rows = [("ultimate_parent", "US", "ACTIVE", "XTIQ", 30, "Rome", None), ("subsidiary", "DE", "INACTIVE", "5WWO", 1200, None, None), (None,) * 7]
    got = [(r["short"], r["full"]) for r in texts.reasoning(spark.createDataFrame(rows, kinds).coalesce(1)).collect()]
    assert got[0][0] == "ULTIMATE PARENT - Top decision-maker | PRIMARY JURISDICTION (US) | ACTIVE STATUS | HQ: Rome, "
    assert got[0][1].startswith("ULTIMATE PARENT - This is the top-level") and got[0][1].endswith("[Score factors: +40% for ultimate parent status, +10% for active status, +5% for corporate form, +5% for recent data]")
    assert got[1][0] == "SUBSIDIARY - Requires parent approval | SECONDARY JURISDICTION (DE)" and "OUTDATED - Last updated 3 years ago" in got[1][1]
    assert got[2] == ("", "INDEPENDENT ENTITY - No parent/subsidiary relationships found")


def test_best_results(spark):
    kinds = "results array<struct<method:string,company_name:string,confidence:double>>"
    rows = [([("html_title", "T", 70.0), ("footer_copyright", "F", 70.0), ("meta_property", None, 99.0)],), ([("domain_parse", "D", 30.0)],), ([("structured_data", "S", 95.0)],), ([("html_title", None, 80.0)],), ([],)]
    got = [tuple(r["b"]) for r in spark.createDataFrame(rows, kinds).coalesce(1).select(texts.best_result(F.col("results")).alias("b")).collect()]
    none = (None, "none", 0.0, "Failed - No Extraction", "failed")
    assert got == [("F", "footer_copyright", 70.0, "Success", "success"), ("D", "domain_parse", 30.0, "Incomplete - Low Priority", "success"), ("S", "structured_data", 95.0, "Success - High Confidence", "success"), none, none]
