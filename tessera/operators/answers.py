"""Answers of language models: the JSON in them found, repaired where it can be, and read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.evidence import quoted
from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES

C = CANDIDATES.sql

# A fenced block, the outermost braces, and what closes an answer that broke off within its entities.
FENCED, BRACES = r"```(?:json)?\s*([\s\S]*?)```", r"\{[\s\S]*\}"
LIST_KEY, LAST_KEY, CLOSING = '"rankedEntities"', '"overallReasoning"', '], "overallReasoning": "Analysis completed" }'
#: A string as a whole, or a comma before what closes; strings are kept, so commas within them stay.
TRAILING = r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])'
#: The same for the JVM, whose stack would hold a frame for each character of a string.
TRAILING_JVM = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|,(\s*[}\]])'
STEPS = ["as it is", "commas", "quotes", "closed"]


def body(text: Column) -> Column:
    """The fenced block, else the outermost braces, else all."""
    return F.when(text.rlike(FENCED), F.trim(F.regexp_extract(text, FENCED, 1))).otherwise(F.coalesce(F.nullif(F.regexp_extract(text, BRACES, 0), F.lit("")), text))


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, TRAILING_JVM, "$1$2")


def closed(text: Column) -> Column:
    """An answer with its list but not its last key, cut behind the last whole entity and closed."""
    last = F.regexp_extract(text, r"^([\s\S]*\})", 1)
    return F.when(text.contains(LIST_KEY) & ~text.contains(LAST_KEY) & (last != ""), F.concat(last, F.lit(CLOSING)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def parsed(text: Column, how: str) -> Column:
    """``how, answer`` of JSON that parses, else null."""
    # the parser stops behind a value; within brackets whatever follows it is an error or a second element
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.nullif(F.trim(text), F.lit("")), F.lit("]"))), "$", "array<variant>")
    return bound(alone, lambda a: F.when((F.size(a) == 1) & F.get(a, 0).isNotNull(), F.struct(F.lit(how).alias("how"), F.get(a, 0).alias("answer"))))


def repaired(text: Column) -> Column:
    """``how, answer``: the first repair after which the JSON parses, and the answer as VARIANT; nulls where none helps. A repair is made only where those before it failed."""
    last = lambda straight: F.coalesce(parsed(straight, STEPS[2]), parsed(closed(straight), STEPS[3]))
    later = lambda plain: bound(without_trailing_commas(F.translate(plain, "“”„", '"""')), last)
    return bound(body(text), lambda plain: F.coalesce(parsed(plain, STEPS[0]), parsed(without_trailing_commas(plain), STEPS[1]), later(plain)))


_ENTITY = """concat('{"claimNumber": ', cast(rn as string), ', "entityName": "', legal_name, '", "leiCode": "', lei_code, '", "rank": ', cast(rn as string), '}')"""
#: An answer in six shapes: whole; fenced; with a brace in the words after it; with trailing commas; broken off; with typographic quotes.
_SHAPES = [
    """concat('{"rankedEntities": [', list, '], "overallReasoning": "best, of {3}"}')""",
    """concat('Sure.\n```json\n{"rankedEntities": [', list, '], "overallReasoning": "a, ] b"}\n```\nSources: [1]')""",
    """concat('Here it is: {"rankedEntities": [', list, '], "overallReasoning": "x"} hope it helps :-}')""",
    """concat('{"rankedEntities": [', list, ', ], "overallReasoning": "one, ] two,}",}')""",
    """concat('{"rankedEntities": [', list, ', {"claimNumber": 9, "entityNa')""",
    """replace(concat('{"rankedEntities": [', list, ',], "overallReasoning": "y"}'), '"', '”')""",
]
SHAPED = "CASE domain_id % 6 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES)) + " END"
ORDER = "weighted_score DESC, lei_code, tie1, tie2, tie3"


def _sql() -> str:
    b = f"CASE WHEN regexp_matches(t, {quoted(FENCED)}) THEN trim(regexp_extract(t, {quoted(FENCED)}, 1), ' ') ELSE coalesce(nullif(regexp_extract(t, {quoted(BRACES)}), ''), t) END"
    commas = lambda x: f"regexp_replace({x}, {quoted(TRAILING)}, '\\1\\2', 'g')"
    straight = commas("translate(b, '“”„', '\"\"\"')")
    last = "regexp_extract(s, '^([\\s\\S]*\\})', 1)"
    fine = lambda x: f"(json_valid({x}) AND {commas(x)} = {x})"  # noqa: E731  this parser lets commas pass before what closes
    return f"""WITH a AS (SELECT domain_id, {SHAPED} AS t FROM (SELECT domain_id, string_agg({_ENTITY}, ', ' ORDER BY rn) AS list FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY {ORDER}) AS rn FROM {C} c) r WHERE rn <= 3 GROUP BY domain_id) l),
      b AS (SELECT domain_id, {b} AS b FROM a), s AS (SELECT *, {commas('b')} AS c, {straight} AS s FROM b),
      z AS (SELECT *, CASE WHEN contains(s, '{LIST_KEY}') AND NOT contains(s, '{LAST_KEY}') AND {last} <> '' THEN concat({last}, '{CLOSING}') END AS z FROM s),
      j AS (SELECT domain_id, CASE WHEN {fine('b')} THEN 0 WHEN {fine('c')} THEN 1 WHEN {fine('s')} THEN 2 WHEN {fine('z')} THEN 3 END AS i, CASE WHEN {fine('b')} THEN b WHEN {fine('c')} THEN c WHEN {fine('s')} THEN s WHEN {fine('z')} THEN z END AS j FROM z)
      SELECT domain_id, [{', '.join(map(quoted, STEPS))}][i + 1] AS how, json_array_length(j, '$.rankedEntities')::INT AS entities, json_extract_string(j, '$.rankedEntities[0].entityName') AS best, json_extract_string(j, '$.overallReasoning') AS reasoning FROM j"""


@query("X48_repaired_answers", _sql())
def repaired_answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer about each domain's three best candidates, found and repaired. Of the six shapes one cannot be mended: its braces end behind the answer."""
    w = Window.partitionBy("domain_id").orderBy(F.desc("weighted_score"), "lei_code", "tie1", "tie2", "tie3")
    top = CANDIDATES.read(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    lists = top.groupBy("domain_id").agg(F.array_sort(F.collect_list(F.struct("rn", F.expr(_ENTITY).alias("e")))).alias("l"))
    texts = lists.select("domain_id", F.array_join(F.transform("l", lambda x: x["e"]), ", ").alias("list")).select("domain_id", F.expr(SHAPED).alias("text"))
    rows = texts.select("domain_id", bound(F.col("text"), repaired).alias("x"))
    get = lambda path, kind: F.try_variant_get("x.answer", path, kind)
    entities = F.when(F.col("x.how").isNotNull(), F.size(get("$.rankedEntities", "array<variant>")))
    return rows.select("domain_id", F.col("x.how").alias("how"), entities.alias("entities"), get("$.rankedEntities[0].entityName", "string").alias("best"), get("$.overallReasoning", "string").alias("reasoning"))
