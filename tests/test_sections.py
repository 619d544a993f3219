"""Names in sections about companies and in legal sections, by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sections
from tessera.plans.register import QUERIES, SQL
from tests.compare import assert_same
from tests.conftest import SF

CASES = [
    ("At last: we are Acme Tools Inc. 9 offices", "Acme Tools Inc.", None),
    ("Acme Tools GmbH is 9 years old", "Acme Tools GmbH", None),
    ("In 1990 Jo founded Nord & Sohn KG, 9 km north", "Nord & Sohn KG", None),
    ("these terms form a contract with Acme Tools LLC: 1", None, "Acme Tools LLC"),
    ("© 2024 by 7 Acme Limited: all", None, "Acme Limited"),
    ("Acme Limited: it owns this site", None, "Acme Limited"),
    ("about " + "long " * 30 + "Inc", None, None),
    ("", None, None),
    (None, None, None),
]


def test_names(spark):
    df = spark.createDataFrame(CASES, "text string, about string, legal string")
    got = df.select("text", sections.about_name(F.col("text")), sections.legal_name(F.col("text"))).collect()
    assert [tuple(r) for r in got] == CASES


def test_sentences(spark):
    df = spark.createDataFrame([("It rains. Acme Steel Works! More text follows here, and it is no name at all.",), ("one",), (None,)], "text string")
    assert [r[0] for r in df.select(sections.sentence_name(F.col("text"))).collect()] == ["It rains", "one", None]


def test_long_text(spark):
    """A long text without any mark of an end is searched once by each pattern."""
    df = spark.range(1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    assert df.select(sections.about_name(F.col("text")), sections.legal_name(F.col("text"))).collect()[0][:] == (None, None)


def test_query(spark, duck):
    assert_same(QUERIES["X55_names_in_text"](spark, SF), duck, SQL["X55_names_in_text"])
