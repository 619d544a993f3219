"""Lookups of single codes in captured answers of the registry."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rounds import new_folder
from tessera.operators.entities import RECORD
from tessera.plans.register import query
from tessera.sources.captures import read_captures, write_captures
from tessera.sources.logical import DOMAINS, ENTITIES

D, E = DOMAINS.sql, ENTITIES.sql
#: What a lookup without a record says.
NOT_FOUND, NO_PART = "LEI not found", "Not found"
BAD_LENGTH = "Invalid LEI code length - must be 20 characters"
HTML_PAGE = "GLEIF API returned HTML error page (status: %d)"
BAD_SHAPE = "Invalid GLEIF API response structure for LEI search"
ABSENT = "LEI code not found in GLEIF registry"
FAILED = "LEI search failed with status: %d"
PREFIX = "GLEIF LEI Search Error: "
#: Of a code that was asked for but never captured.
NOT_CAPTURED = "no answer was captured"


def newest(captures: DataFrame) -> DataFrame:
    """The latest answer for each code; of those of one time the one with the highest status."""
    latest = F.max(F.struct("captured_at", "status", "content_type", "body")).alias("a")
    return captures.filter("lei_code IS NOT NULL").groupBy("lei_code").agg(latest).select("lei_code", "a.*")


def outcomes(captures: DataFrame) -> DataFrame:
    """``lei_code, legal_name, entity_status, country, error``: an HTML page is an error whatever its status; a good answer without data is one of a wrong shape; others are named by their status. A body that is no JSON has no data. Where an answer is an error the
    other columns are null."""
    r = captures.withColumn("data", F.from_json("body", f"data struct<{RECORD}>")["data"])
    error = (
        F.when(F.coalesce("content_type", F.lit("")).contains("text/html"), F.format_string(HTML_PAGE, "status"))
        .when((F.col("status") == 200) & F.col("data").isNull(), BAD_SHAPE)
        .when(F.col("status") == 404, ABSENT)
        .when(F.coalesce("status", F.lit(0)) != 200, F.format_string(FAILED, "status"))
    )
    good = lambda path: F.when(F.col("error").isNull(), F.col(f"data.attributes.entity.{path}"))
    rows = r.withColumn("error", error)
    return rows.select("lei_code", good("legalName.name").alias("legal_name"), good("status").alias("entity_status"), good("legalAddress.country").alias("country"), "error")


def look_up(asked: DataFrame, captures: DataFrame) -> DataFrame:
    """``asked, legal_name, entity_status, country, error`` for each asked code, in whatever case it is asked. A code of a wrong length is an error by itself; the other columns say that
    nothing was found."""
    found = outcomes(newest(captures))
    joined = asked.select("asked", F.upper("asked").alias("code")).join(found, F.when(F.length("asked") == 20, F.col("code")) == F.col("lei_code"), "left")
    error = F.when(F.coalesce(F.length("asked"), F.lit(0)) != 20, BAD_LENGTH).when(F.col("lei_code").isNull(), NOT_CAPTURED).otherwise(F.col("error"))
    part = lambda name, default: F.when(F.col("said").isNull(), F.coalesce(name, F.lit(""))).otherwise(default).alias(name)
    rows = joined.withColumn("said", error)
    return rows.select("asked", part("legal_name", NOT_FOUND), part("entity_status", NO_PART), part("country", NO_PART), F.concat(F.lit(PREFIX), "said").alias("error"))


def captured(spark: SparkSession, sf: str) -> DataFrame:
    """Answers for all entities as a crawl of the registry keeps them: records, missing codes, error pages, refusals, answers without data, and earlier answers that later ones replace."""
    c = F.col
    entity = F.struct(F.struct(c("legal_name").alias("name")).alias("legalName"), c("entity_status").alias("status"), F.struct(c("jurisdiction").alias("country")).alias("legalAddress"))
    record = F.struct(F.struct(F.struct(c("lei_code").alias("lei"), entity.alias("entity")).alias("attributes")).alias("data"))
    n = c("n")
    status = F.when(n % 11 == 0, 404).when(n % 13 == 0, 503).when(n % 19 == 0, 429).otherwise(200).cast("int")
    kind = F.when((n % 13 == 0) & (n % 11 != 0), "text/html; charset=utf-8").otherwise("application/vnd.api+json")
    body = F.when(status == 200, F.when(n % 17 == 0, "{}").otherwise(F.to_json(record))).otherwise("<html></html>")
    rows = ENTITIES.read(spark, sf)
    later = rows.select("lei_code", F.lit("2024-02-01T00:00:00Z").alias("captured_at"), status.alias("status"), kind.alias("content_type"), body.alias("body"))
    earlier = rows.filter("n % 5 = 0").select("lei_code", F.lit("2024-01-01T00:00:00Z").alias("captured_at"), F.lit(404).alias("status"), F.lit("application/json").alias("content_type"), F.lit("{}").alias("body"))
    return later.union(earlier)


ASKED = "CASE WHEN id % 48 = 0 THEN substr(primary_lei_code, 1, 19) WHEN id % 40 = 0 THEN lower(primary_lei_code) ELSE primary_lei_code END"
SAID = f"""CASE WHEN length(asked) <> 20 THEN '{BAD_LENGTH}' WHEN lei_code IS NULL THEN '{NOT_CAPTURED}' WHEN n % 11 = 0 THEN '{ABSENT}' WHEN n % 13 = 0 THEN '{HTML_PAGE % 503}'
    WHEN n % 19 = 0 THEN '{FAILED % 429}' WHEN n % 17 = 0 THEN '{BAD_SHAPE}' END"""
ROWS = f"SELECT asked, CASE WHEN said IS NULL THEN legal_name ELSE '{NOT_FOUND}' END AS legal_name, CASE WHEN said IS NULL THEN entity_status ELSE '{NO_PART}' END AS entity_status, CASE WHEN said IS NULL THEN jurisdiction ELSE '{NO_PART}' END AS country, concat('{PREFIX}', said) AS error_text, said"


def _sql(asked: str) -> str:
    return f"SELECT asked, legal_name, entity_status, country, CASE WHEN said IS NOT NULL THEN error_text END AS error FROM ({ROWS} FROM (SELECT *, {SAID} AS said FROM ({asked}) a LEFT JOIN {E} e ON length(asked) = 20 AND lei_code = upper(asked)) x) y"


@query("S9_S21_captured_codes", _sql(f"SELECT DISTINCT {ASKED} AS asked FROM {D} d WHERE primary_lei_code IS NOT NULL"))
def captured_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every code that a domain names, looked up in the captured answers."""
    path = write_captures(captured(spark, sf), new_folder(spark, "captures"))
    asked = DOMAINS.read(spark, sf).filter("primary_lei_code IS NOT NULL").selectExpr(f"{ASKED} AS asked").distinct()
    return look_up(asked, read_captures(spark, path))


@query("S21_captured_code", _sql("SELECT upper(substr(md5('7'), 1, 20)) AS asked"))
def captured_code(spark: SparkSession, sf: str) -> DataFrame:
    """One code: the filter reaches the source, which reads the code's bucket alone."""
    path = write_captures(captured(spark, sf), new_folder(spark, "captures"))
    asked = ENTITIES.read(spark, sf).filter("n = 7").select(F.col("lei_code").alias("asked")).distinct()
    code = hashlib.md5(b"7").hexdigest()[:20].upper()
    return look_up(asked, read_captures(spark, path).filter(F.col("lei_code") == code))
