"""Captured answers: what is pushed, what is read, and what lookups say."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import lookups
from tessera.plans.register import QUERIES, SQL
from tessera.sources import captures
from tests.compare import assert_same
from tests.conftest import SF

A, B, C, X = (c * 20 for c in "ABCX")
GOOD = json.dumps({"data": {"attributes": {"lei": A, "entity": {"legalName": {"name": "Alpha"}, "status": "ACTIVE", "legalAddress": {"country": "DE"}}}}})
ROWS = [
    (A, "2024-01-02", 200, "application/json", GOOD),
    (A, "2024-01-01", 404, "application/json", "{}"),
    (B, "2024-01-01", 200, "text/html", "<html>"),
    (C, "2024-01-01", 200, "application/json", "no json"),
    ("D" * 20, "2024-01-01", 404, None, None),
    ("E" * 20, "2024-01-01", 429, "", ""),
    (None, "2024-01-01", 200, "application/json", GOOD),
]


def _written(spark, path, rows=ROWS):
    return captures.write_captures(spark.createDataFrame(rows, captures.SCHEMA), f"file://{path}/captures")


def test_lookups(spark, tmp_path):
    found = captures.read_captures(spark, _written(spark, tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(ROWS, key=repr)
    asked = spark.createDataFrame([(x,) for x in (A, A.lower(), B, C, "D" * 20, "E" * 20, X, "A" * 19, None)], "asked string")
    got = {r["asked"]: (r["legal_name"], r["country"], (r["error"] or "").removeprefix(lookups.PREFIX)) for r in lookups.look_up(asked, found).collect()}
    assert got.pop(A) == got.pop(A.lower()) == ("Alpha", "DE", "")
    assert {k: v[2] for k, v in got.items()} == {
        B: "GLEIF API returned HTML error page (status: 200)", C: lookups.BAD_SHAPE, "D" * 20: lookups.ABSENT, "E" * 20: "LEI search failed with status: 429", X: lookups.NOT_CAPTURED, "A" * 19: lookups.BAD_LENGTH, None: lookups.BAD_LENGTH,
    }
    assert {v[:2] for v in got.values()} == {(lookups.NOT_FOUND, lookups.NO_PART)}


def test_one_code_reads_one_partition(spark, tmp_path):
    rows = [(f"{i:020d}", "2024-01-01", 200, "application/json", "{}") for i in range(500)]
    found = captures.read_captures(spark, _written(spark, tmp_path, rows))
    assert found.rdd.getNumPartitions() == captures.BUCKETS
    one = found.filter(F.col("lei_code") == rows[7][0]).filter("status = 200")
    assert one.rdd.getNumPartitions() == 1
    assert [r["lei_code"] for r in one.collect()] == [rows[7][0]]
    assert "status" in one._jdf.queryExecution().executedPlan().toString()  # what the source does not take stays in the plan
    some = found.filter(F.col("lei_code").isin(rows[1][0], rows[2][0], "none"))
    assert some.rdd.getNumPartitions() <= 3 and some.count() == 2
    assert found.filter((F.col("lei_code") == rows[1][0]) & (F.col("lei_code") == rows[2][0])).count() == 0


def test_nothing_captured(spark, tmp_path):
    found = captures.read_captures(spark, _written(spark, tmp_path, []))
    assert found.count() == 0
    assert found.filter(F.col("lei_code") == A).count() == 0


def test_queries(spark, duck):
    for name in ("S9_S21_captured_codes", "S21_captured_code"):
        assert_same(QUERIES[name](spark, SF), duck, SQL[name])
