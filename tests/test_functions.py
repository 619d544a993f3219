"""Hand-computed values at the edges of formulas and thresholds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import compat, names
from tessera.operators import claims, scoring


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("x, expected", [(2.5, 3), (-2.5, -2), (0.49, 0)])
def test_round(spark, x, expected):
    assert value(spark, compat.js_round(F.lit(x))) == expected


def test_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert df.agg(compat.upper_median("x").alias("m")).collect()[0]["m"] == 3.0


def test_confidence(spark):
    score = lambda method, suffix, words: value(spark, scoring.extraction_confidence(F.lit(method), F.lit(suffix), F.lit(False), F.lit(words)))
    assert score("footer_copyright", True, 2) == 100
    assert score("domain_parse", False, 1) == 0


def test_names(spark):
    score = lambda a, b: value(spark, scoring.name_score_v1(F.lit(a), F.lit(b)))
    assert score("Apple Inc.", "apple inc.") == 100
    assert score("Acme Steel Group", "Acme Iron Works") == 27
    assert score("Acme", "") == 0
    assert abs(value(spark, names.similarity(F.lit("kitten"), F.lit("sitting"))) - (1 - 3 / 7)) < 1e-12


def test_tld(spark):
    assert value(spark, scoring.tld_score_v1(F.lit("x.de"), F.lit("DE"))) == 100
    assert value(spark, scoring.tld_score_v1(F.lit("x.com"), F.lit("US"))) == 85
    assert value(spark, scoring.tld_score_v1(F.lit("x.fr"), F.lit("DE"))) == 10


def test_claims(spark):
    normal = lambda x: value(spark, claims.normal_confidence(F.lit(x).cast("double")))
    assert (normal(85), normal(0.4), normal(None)) == (0.85, 0.4, 0.5)
    assert [value(spark, claims.grade(F.lit(x))) for x in (0.9, 0.89, 0.6, 0.59)] == ["A+", "A", "B", "C"]


def test_durations(spark):
    assert [value(spark, scoring.duration(F.lit(float(ms)))) for ms in (59_400, 61_000, 3_660_000)] == ["59s", "1m 1s", "1h 1m"]


def test_domains(spark):
    assert value(spark, names.domain_hash(F.lit(" GM.com\n"))) == value(spark, F.md5(F.lit("gm.com").cast("binary")))
    assert [value(spark, names.is_domain(F.lit(x))) for x in ("a.com", "a.co.uk", "a.b.c.com", "no domain", "-a.com")] == [True, True, False, False, False]
    assert value(spark, names.company_of_domain(F.lit("acme-steel.com"))) == "Acme Steel"
    assert value(spark, names.has_suffix(F.lit("Acme Inc."))) and not value(spark, names.has_suffix(F.lit("Incredible Things")))
