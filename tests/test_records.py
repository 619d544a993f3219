"""Cells of the CSV, classifications and fallbacks by hand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import records


def test_cells(spark):
    row = [('say "hi"', 0.0, 85.0, 85.5, None, 0, 3, None, datetime(2024, 1, 2, 3, 4, 5, 678000), None)]
    df = spark.createDataFrame(row, "domain string, confidence_score double, final_confidence double, x double, status string, retry_count int, level2_candidates_count int, gleif_candidate_count int, created_at timestamp, processed_at timestamp")
    kinds = dict(df.dtypes)
    assert list(df.select(*[records.cell(c, kinds[c]).alias(c) for c in df.columns]).first()) == ['"say ""hi"""', '""', '"85"', '"85.5"', '""', '"0"', '"3"', '"0"', '"2024-01-02T03:04:05.678Z"', '""']


def test_header_and_presets():
    assert len(records.CSV_HEADER) == 25 and len(records.DEFAULT_FIELDS) == 12 and len(records.COMPREHENSIVE_FIELDS) == 23
    assert set(records.COMPREHENSIVE_FIELDS) <= set(records.RECORD_FIELDS)


def test_classes(spark):
    kinds = "extraction_method string, confidence_score double, final_confidence double, primary_lei_code string, entity_category string, jurisdiction string, company_name string, status string, failure_category string, technical_details string"
    cases = [
        (("domain_mapping", 95.0, None, None, None, None, "A", "success", None, None), ("Fortune500", "Good-Target", "Open")),
        (("html_title", 10.0, None, None, "Corporation", "DE", None, "success", None, None), ("Enterprise", "Research-Required", "Open")),
        (("html_title", 10.0, 90.0, "L", None, None, None, "success", None, None), ("Enterprise", "Ready", "Open")),
        (("html_title", 90.0, 0.0, "L", None, None, None, "success", "bot page", None), ("Enterprise", "Ready", "Bot-Detection")),
        (("html_title", 72.0, None, None, None, None, None, "failed", "unreachable", "bot"), ("Mid-Market", "Skip", "Bot-Detection")),
        (("html_title", 55.0, None, None, None, None, "A", "failed", "Protected - Manual Review", None), ("SMB", "Protected", "Protected")),
        (("html_title", None, None, None, None, None, None, "pending", "protected cloudflare", None), ("Unknown", "Research-Required", "Cloudflare")),
    ]
    df = spark.createDataFrame([c[0] for c in cases], kinds).coalesce(1)
    got = df.select(F.expr(records.PRIORITY), F.expr(records.READINESS), F.expr(records.ACCESS)).collect()
    assert [tuple(r) for r in got] == [c[1] for c in cases]


def test_claim_fallbacks(spark):
    page = lambda i, h1: (i, "crawlee_dump", f"d{i}.com", f"<title>T{i}</title><h1>{h1}</h1>")
    dumps = spark.createDataFrame([page(1, "one"), page(2, "two"), page(3, "<b>three</b> x"), page(4, ""), page(5, "five")], "dump_id long, source_type string, domain string, html string")
    processed = spark.createDataFrame([("crawlee_dump", 1, 10, 1, "old"), ("crawlee_dump", 1, 11, 2, "new"), ("crawlee_dump", 1, 12, 3, ""), ("crawlee_dump", 1, 13, 4, None), ("scrapy_crawl", 2, 14, 9, "other kind"), ("crawlee_dump", 2, 15, 1, "")], "source_type string, source_id long, result_id long, created_seq long, entity_name string")
    cleaned = spark.createDataFrame([("crawlee_dump", 1, 1, "unused"), ("crawlee_dump", 2, 2, "earlier"), ("crawlee_dump", 2, 3, "latest"), ("crawlee_dump", 5, 4, "named"), ("crawlee_dump", 5, 5, None)], "source_type string, source_id long, result_id long, entity_name string")
    got = {r["dump_id"]: (r["title"], r["entity_name"], r["origin"]) for r in records.claim_inputs(dumps, processed, cleaned).collect()}
    assert got == {1: ("T1", "new", "processing"), 2: ("T2", "latest", "cleaning"), 3: ("T3", "three  x", "page"), 4: ("T4", None, "none"), 5: ("T5", None, "cleaning")}
