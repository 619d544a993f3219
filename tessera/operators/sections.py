"""Company names in running text: what sections about a company and legal sections say, and sentences that are names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators.evidence import quoted
from tessera.operators.footers import cleaned, cleaned_sql
from tessera.operators.ladders import VALID_SQL, flat, flat_sql
from tessera.plans.register import query
from tessera.sources.logical import DUMPS

P = DUMPS.sql

# Endings of names in such sections, with dots as dots (the original lost their escapes, so that any character stood for one), and the patterns with the group that holds the name.
ENDINGS = (
    r"Inc\.?|Incorporated|Corp\.?|Corporation|Company|Ltd\.?|Limited|LLC|L\.L\.C\.|P\.C\.|PC|PLLC|P\.L\.L\.C\.|LP|L\.P\.|LLP|L\.L\.P\.|LLLP|L\.L\.L\.P\.|Co-op|Cooperative|Trust|Association|plc"
    r"|GmbH|AG|UG|KG|OHG|GbR|e\.K\.|eG|SE|Stiftung|e\.V\.|gGmbH|gAG|SARL|SA|SAS|SNC|SCS|SCA|EURL|SC|SCOP|GIE|SEM|Fondation"
    r"|S\.A\.|S\.A\.\s*de\s*C\.V\.|S\.\s*de\s*R\.L\.|S\.\s*de\s*R\.L\.\s*de\s*C\.V\.|S\.\s*en\s*C\.|S\.\s*en\s*C\.\s*por\s*A\.|S\.C\.|A\.C\.|I\.A\.P\.|S\.A\.P\.I\.|S\.A\.P\.I\.\s*de\s*C\.V\.|Pvt\.?\s*Ltd\.?|Private\s*Limited"
)
NAME = rf"([A-Z][a-zA-Z\s&.,'-]+(?:{ENDINGS}))"
ABOUT = [(rf"(?i)(?:we are|about)\s+{NAME}", 1), (rf"(?i)^{NAME}\s+(?:is|was|provides|offers|specializes)", 1), (rf"(?i)(?:founded|established|created)\s+{NAME}", 1)]
LEGAL = [(rf"(?i)(?:this agreement|these terms).*?(?:between you and|with)\s+{NAME}", 1), (rf"(?i)(?:copyright|©|all rights reserved).*?(\d{{4}}).*?{NAME}", 2), (rf"(?i)^{NAME}.*?(?:owns|operates|maintains)", 1)]
#: Words without which a pattern finds nothing: texts that lack them are not searched.
NEEDED = {LEGAL[0][0]: r"(?i)this agreement|these terms", LEGAL[1][0]: r"(?i)copyright|©|all rights reserved", LEGAL[2][0]: r"(?i)owns|operates|maintains"}
SENTENCE = "[.!?]+"


def _named(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """The name of the first pattern that finds one of 4 to 79 characters, else null."""

    def one(pattern: str, group: int) -> Column:
        found = F.trim(F.regexp_extract(text, pattern, group))
        searched = F.when(text.rlike(NEEDED[pattern]), found) if pattern in NEEDED else found
        return F.transform(F.array(searched), lambda x: F.when(F.length(x).between(4, 79), x))[0]

    return F.coalesce(*[one(p, g) for p, g in patterns])


def about_name(text: Column) -> Column:
    """The company that a text about it names; null where there is none, or no text."""
    return _named(text, ABOUT)


def legal_name(text: Column) -> Column:
    """The company that terms, a copyright line or an owner's statement names; null where there is none, or no text."""
    return _named(text, LEGAL)


def sentence_name(text: Column) -> Column:
    """The first sentence of two to five words that is a valid name, else the text cleaned as a name is."""
    words = lambda s: F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")
    short = F.transform(F.filter(F.split(text, SENTENCE), lambda s: F.size(words(s)).between(2, 5)), lambda s: F.array_join(words(s), " "))
    return F.coalesce(F.get(F.filter(short, names.is_valid_name), 0), cleaned(text))


def _page_text(html: Column) -> Column:
    return F.trim(flat(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")))


def _named_sql(patterns: list[tuple[str, int]]) -> str:
    found = [f"trim(regexp_extract(t, {quoted(p)}, {g}))" for p, g in patterns]
    return "coalesce(" + ", ".join(f"CASE WHEN length({x}) BETWEEN 4 AND 79 THEN {x} END" for x in found) + ")"


_TEXT_SQL = "trim(" + flat_sql("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')") + ")"
_VALID = re.sub(r"\bname\b", "n", VALID_SQL)


@query(
    "X55_names_in_text",
    f"""WITH b AS (SELECT dump_id, {_TEXT_SQL} AS t FROM {P} p),
      s AS (SELECT dump_id, unnest(range(len(x))) AS i, unnest(x) AS n FROM (SELECT dump_id, list_transform(regexp_split_to_array(t, '{SENTENCE}'), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g'))) AS x FROM b) y),
      v AS (SELECT dump_id, arg_min(n, i) AS n FROM s WHERE len(string_split(n, ' ')) BETWEEN 2 AND 5 AND ({_VALID}) GROUP BY dump_id)
      SELECT b.dump_id, {_named_sql(ABOUT)} AS about_name, {_named_sql(LEGAL)} AS legal_name, coalesce(v.n, {cleaned_sql('t')}) AS text_name FROM b LEFT JOIN v ON b.dump_id = v.dump_id""",
)
def names_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """What the whole text of each page says by the three rules."""
    rows = DUMPS.read(spark, sf).select("dump_id", _page_text(F.col("html")).alias("text"))
    found = F.transform(F.array("text"), lambda t: F.struct(about_name(t).alias("about_name"), legal_name(t).alias("legal_name"), sentence_name(t).alias("text_name")))
    return rows.select("dump_id", F.element_at(found, 1).alias("x")).select("dump_id", "x.*")
