"""Repairs of answers by hand."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import answers

CASES = [
    ('{"a": 1}', "as it is", {"a": 1}),
    ('words ```json\n{"a": "x, ]"}\n``` more', "as it is", {"a": "x, ]"}),
    ('```\n[1, 2]\n```', "as it is", [1, 2]),
    ('so {"a": {"b": [1, 2, ], "c": "keep ,} and \\" ,]",},} then', "commas", {"a": {"b": [1, 2], "c": 'keep ,} and " ,]'}}),
    ("{“a”: „x”}", "quotes", {"a": "x"}),
    ('{"rankedEntities": [{"rank": 1}, {"rank": 2}, {"ra', "closed", {"rankedEntities": [{"rank": 1}, {"rank": 2}], "overallReasoning": "Analysis completed"}),
    ('{"rankedEntities": [{"rank": 1}], "overallReasoning": "cut', "closed", {"rankedEntities": [{"rank": 1}], "overallReasoning": "Analysis completed"}),
    ('{"rankedEntities": [{"rank": 1}], "overallReasoning": "cut {x}', None, None),
    ('here: {"a": 1} and {"b": 2}', None, None),
    ('{"a": 1} }', None, None),
    ("no json", None, None),
    ("", None, None),
    (None, None, None),
]


def test_repairs(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, text string")
    got = df.select("id", answers.repaired(F.col("text")).alias("x")).select("id", "x.how", F.to_json("x.answer").alias("j")).orderBy("id").collect()
    assert [(r["how"], r["j"] and json.loads(r["j"])) for r in got] == [(c[1], c[2]) for c in CASES]


def test_long_strings(spark):
    """A string of any length is one piece to the repair of commas."""
    text = '{"a": "' + "x, ]" * 50_000 + '", }'
    got = spark.createDataFrame([(text,)], "text string").select(answers.repaired(F.col("text")).alias("x")).select("x.how", F.length(F.try_variant_get("x.answer", "$.a", "string")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("commas", 200_000)]


def test_a_step_only_where_those_before_failed(spark):
    """The parser stands once a step, not twice for each of all steps."""
    plan = spark.createDataFrame([("{}",)], "text string").select(answers.repaired(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= len(answers.STEPS)
