"""The footer ladder: expected names and domain stems before the legal endings of a site's jurisdiction; endings suggested for names that lack one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators.evidence import quoted
from tessera.operators.ladders import EXPECTED_SQL, FOOTER, FOOTER_NAMED, STEMS_SQL, VALID_SQL, classed, flat, flat_sql, sql_pattern
from tessera.plans.register import query
from tessera.sources.logical import DOMAINS, DUMPS

D, P = DOMAINS.sql, DUMPS.sql

# Legal endings by jurisdiction, in their order, and the top-level domains of each (for a shared one the last jurisdiction counts).
ENDINGS = {
    "us": ["Inc.", "Incorporated", "Corp.", "Corporation", "Company", "Co.", "LLC", "L.L.C.", "Limited", "P.C.", "PC", "PLLC", "P.L.L.C.", "LP", "L.P.", "LLP", "L.L.P.", "LLLP", "L.L.L.P.", "Co-op", "Cooperative", "Trust", "Holdings", "Group"],
    "canada": ["Inc.", "Incorporated", "Ltd.", "Limited", "Corp.", "Corporation", "LP", "L.P.", "LLP", "L.L.P.", "Ltée", "Limitée", "Inc.", "Incorporée", "P.C.", "Co-op", "Cooperative", "Trust", "Society"],
    "germany": ["GmbH", "UG", "AG", "SE", "KG", "OHG", "GbR", "GmbH & Co. KG", "e.V.", "gGmbH", "Stiftung", "gAG", "eG", "e.K."],
    "france": ["SA", "SE", "SARL", "EURL", "SAS", "SNC", "SCS", "SCA", "SC", "SCOP", "Fondation", "Association", "GIE", "SEM"],
    "mexico": ["S.A.", "S.A. de C.V.", "S. de R.L.", "S. de R.L. de C.V.", "S. en C.", "S. en C. por A.", "S.C.", "A.C.", "I.A.P.", "S.A.P.I.", "S.A.P.I. de C.V."],
    "brazil": ["Ltda.", "Limitada", "SLU", "S.A.", "SCA", "MEI", "Cooperativa", "Coop", "Fundação", "Associação", "OSC"],
    "ireland": ["Ltd", "Limited", "DAC", "PLC", "Public Limited Company", "CLG", "UC", "ULC", "LP", "Society", "Trust", "Cooperative"],
    "italy": ["S.p.A.", "S.r.l.", "S.r.l.s.", "S.n.c.", "S.a.s.", "S.a.p.a.", "Soc. Coop.", "Società Cooperativa", "Fondazione", "Associazione", "Trust"],
    "taiwan": ["Co., Ltd.", "Ltd.", "Corporation", "Corp.", "Inc.", "LP", "LLP", "Branch", "Taiwan Branch", "Foundation", "Association", "Cooperative"],
    "russia": ["OOO", "ООО", "AO", "АО", "PAO", "ПАО", "IP", "ИП", "ANO", "АНО", "TNV", "PT", "PK", "Kooperativ", "Fond"],
    "srilanka": ["Pvt Ltd", "(Private) Limited", "Private Limited", "PLC", "Public Limited Company", "Ltd", "Limited", "Trust", "Society", "Cooperative", "Co-op"],
    "singapore": ["Pte Ltd", "Private Limited", "Ltd", "Limited", "LLP", "LP", "Society", "Co-operative", "Co-op", "Trust", "Charitable Trust"],
    "cz": ["s.r.o.", "spol. s r.o.", "společnost s ručením omezeným", "a.s.", "akciová společnost", "v.o.s.", "veřejná obchodní společnost", "k.s.", "komanditní společnost", "družstvo", "nadace", "nadační fond", "svěřenský fond", "trust", "spolek", "ústav"],
}
JURISDICTION_OF = {".com": "us", ".org": "us", ".net": "us", ".us": "us", ".ca": "canada", ".de": "germany", ".fr": "france", ".mx": "mexico", ".br": "brazil", ".ie": "ireland", ".it": "italy", ".tw": "taiwan", ".ru": "russia", ".lk": "srilanka", ".sg": "singapore", ".cz": "cz"}
# Country hints of top-level domains, the jurisdiction of a country, and what shows that a name has an ending.
HINTS = {"de": "DE", "fr": "FR", "uk": "GB", "it": "IT", "es": "ES", "nl": "NL", "ch": "CH", "at": "AT"}
JURISDICTION_OF_COUNTRY = {"US": "us", "CA": "canada", "DE": "germany", "FR": "france", "MX": "mexico", "BR": "brazil", "IE": "ireland", "IT": "italy", "TW": "taiwan", "RU": "russia", "LK": "srilanka", "SG": "singapore", "CZ": "cz"}
HAS_ENDING = [r"(?i)\b(?:Inc|Corp|LLC|Ltd|GmbH|AG|SA|SAS|SpA|BV|NV|Pty|PLC|SE)\b\.?$", r"(?i)\b(?:Limited|Corporation|Company|Incorporated)\b\.?$"]
# What cleaning a name takes away, in order, with the replacement.
CLEANING = [
    (r"\s*[-|–]\s*.*$", ""), (r"\s*\|\s*.*$", ""), (r"\s*:.*$", ""), (r"(?i)^\s*Welcome to\s*", ""), (r"(?i)^\s*Home\s*[-|]\s*", ""),
    (r"(?i)\s*,\s*(the\s+)?(world|global|leading|trusted|premier|top|best)\s+.*", ""), (r"(?i)\s*-\s*(the\s+)?(world|global|leading|trusted|premier|top|best)\s+.*", ""), (r"(?i)\s+(home\s+page|homepage)$", ""),
    (r"(?i)(searchopen|go back|follow link|read icon|previous|pause|play|next|country selector)", ""), (r"\s+", " "),
]
#: Characters at the end of a page that are read with its footer, the least footer, and the endings that expected names are tried with first.
BOTTOM, LEAST_FOOTER, TRIED_FIRST = 2000, 50, 10
EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"  # an ASCII word border


def cleaned(name: Column) -> Column:
    for pattern, to in CLEANING:
        name = F.regexp_replace(name, pattern, to)
    return F.trim(name)


def cleaned_sql(name: str) -> str:
    for pattern, to in CLEANING:
        name = f"regexp_replace({name}, {quoted(pattern)}, '{to}', 'g')"
    return f"trim({name})"


def endings_of(domain: Column) -> Column:
    """The endings of a domain's jurisdiction, else the American ones."""
    lists = {tld: F.array(*map(F.lit, ENDINGS[j])) for tld, j in JURISDICTION_OF.items()}
    found = F.when(F.lit(False), lists[".com"])
    for tld, endings in lists.items():
        found = found.when(F.lower(domain).endswith(tld), endings)
    return found.otherwise(lists[".us"])


def stems(domain: Column) -> Column:
    label = F.element_at(F.split(domain, r"\."), 1)
    parts = F.filter(F.split(label, "[-_0-9]+"), lambda x: (F.length(x) > 2) & ~F.lower(x).isin(names.COMMON_STEMS))
    return F.filter(F.concat(F.array(label), parts), lambda x: x != "")


def pages_text(html: Column) -> tuple[Column, Column]:
    """A page's footer, and footer and bottom together."""
    footer = F.concat_ws(" ", *[flat(F.regexp_extract(html, p, 1)) for p in (FOOTER, FOOTER_NAMED, classed("copyright"))])
    body = flat(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "))
    return footer, F.concat(footer, F.lit(" "), F.when(F.length(body) > BOTTOM, F.right(body, F.lit(BOTTOM))).otherwise(body))


def footer_ladder(domain: Column, footer: Column, text: Column) -> Column:
    """``name, confidence``: 98 an expected name before an ending, 95 a stem before one with up to two words between, 85 a word that holds a stem with words between, 75 two to four capitalised words before an ending; nulls
    where none is found or the footer is short. Names, stems and endings stand for themselves, whatever characters they hold. Only endings and stems that the text holds are tried."""
    literal = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    held = lambda xs: F.filter(xs, lambda x: F.lower(text).contains(F.lower(x)))
    take = lambda *parts: F.regexp_substr(text, F.concat(F.lit(f"(?iu){EDGE}"), *parts, F.lit(EDGE)))
    fine = lambda x: names.is_valid_name(x) & ~names.is_slogan(x)
    entry = lambda name, score: F.struct(name.alias("name"), F.lit(score).alias("confidence"))
    expected, all_endings = held(names.expected_names(domain)), endings_of(domain)
    endings = held(all_endings)

    def each(left: Column, right: Column, make) -> Column:
        return F.flatten(F.transform(left, lambda a: F.flatten(F.transform(right, lambda b: make(a, b)))))

    named = lambda gap, clean: lambda a, b: F.array(entry(clean(take(literal(a), F.lit(gap), literal(b))), 98))
    first = each(expected, held(F.slice(all_endings, 1, TRIED_FIRST)), lambda a, b: F.concat(*[named(gap, cleaned)(a, b) for gap in (r"\s+", r"\s*", r"[,\s]*")]))
    second = each(expected, endings, named(r"\s*", F.trim))

    def of_stem(a: Column, b: Column) -> Column:
        exact = cleaned(take(literal(a), F.lit(r"(?:[\s][A-Z][\w&-]*){0,2}\s+"), literal(b)))
        fuzzy = cleaned(take(F.lit(r"\w*"), literal(a), F.lit(rf"\w*[\s\w]*?{EDGE}"), literal(b)))
        two = lambda x: F.size(F.split(x, " ")) >= 2
        # each name is a variable, so the many patterns of validity do not search the text again
        checked = F.array(F.struct(exact.alias("name"), F.lit(95).alias("confidence")), F.struct(fuzzy.alias("name"), F.lit(85).alias("confidence")))
        return F.filter(checked, lambda x: x["name"].isNotNull() & ((x["confidence"] == 85) | two(x["name"])) & fine(x["name"]))

    third = each(held(stems(domain)), endings, of_stem)
    all_of = lambda b: F.regexp_extract_all(text, F.concat(F.lit(rf"(?iu){EDGE}((?:[A-Z][\w&-]*\s+){{1,3}}[A-Z][\w&-]*\s+"), literal(b), F.lit(rf"){EDGE}")), F.lit(1))
    ending_words = F.filter(endings, lambda b: F.rlike(text, F.concat(F.lit(r"(?iu)\s"), literal(b), F.lit(EDGE))))
    fourth = F.flatten(F.transform(ending_words, lambda b: F.transform(F.filter(F.transform(all_of(b), cleaned), lambda x: (F.size(F.split(x, " ")) >= 2) & fine(x)), lambda x: entry(x, 75))))
    best = lambda found: F.get(F.filter(found, lambda x: x["name"].isNotNull()), 0)
    return F.when(F.length(footer) >= LEAST_FOOTER, F.coalesce(*[best(x) for x in (first, second, third, fourth)]))


def _footer_sql() -> str:
    lists = " ".join(f"WHEN ends_with(lower(domain), '{t}') THEN {ENDINGS[j]!r}" for t, j in JURISDICTION_OF.items())
    footer = "concat_ws(' ', " + ", ".join(flat_sql(f"regexp_extract(html, {quoted(p)}, 1)") for p in (FOOTER, FOOTER_NAMED, classed("copyright"))) + ")"
    body = flat_sql("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')")
    held = lambda xs: f"list_filter({xs}, lambda x: contains(lower(t), lower(x)))"
    take = lambda *parts: f"nullif(regexp_extract(t, concat('(?i)\\b', {', '.join(parts)}, '\\b')), '')"
    esc = lambda x: f"regexp_escape({x})"
    each = lambda xs, ys, make: f"flatten(list_transform({xs}, lambda a: flatten(list_transform({ys}, lambda b: {make}))))"
    entry = lambda name, score: f"{{'name': {name}, 'confidence': {score}}}"
    first = each("expected", held(f"endings[1:{TRIED_FIRST}]"), "[" + ", ".join(entry(cleaned_sql(take(esc("a"), f"'{gap}'", esc("b"))), 98) for gap in (r"\s+", r"\s*", r"[,\s]*")) + "]")
    second = each("expected", held("endings"), "[" + entry("trim(" + take(esc("a"), r"'\s*'", esc("b")) + ")", 98) + "]")
    exact, fuzzy = cleaned_sql(take(esc("a"), "'(?:[\\s][A-Z][\\w&-]*){0,2}\\s+'", esc("b"))), cleaned_sql(take("'\\w*'", esc("a"), "'\\w*[\\s\\w]*?\\b'", esc("b")))
    third = each("stems", held("endings"), f"[{{'name': {exact}, 'confidence': 95}}, {{'name': {fuzzy}, 'confidence': 85}}]")
    fourth = f"flatten(list_transform({held('endings')}, lambda b: list_transform(list_transform(regexp_extract_all(t, concat('(?i)\\b((?:[A-Z][\\w&-]*\\s+){{1,3}}[A-Z][\\w&-]*\\s+', regexp_escape(b), ')\\b'), 1), lambda x: {cleaned_sql('x')}), lambda x: {{'name': x, 'confidence': 75}})))"  # noqa: E501
    valid = re.sub(r"\bname\b", "n", VALID_SQL)
    slogan = " OR ".join(f"regexp_matches(trim(n), {sql_pattern(p)})" for p in names.SLOGANS)
    return f"""WITH b AS (SELECT dump_id, domain, {footer} AS f, {body} AS body FROM {P} p),
      c AS (SELECT dump_id, domain, f, concat(f, ' ', CASE WHEN length(body) > {BOTTOM} THEN right(body, {BOTTOM}) ELSE body END) AS t, CASE {lists} ELSE {ENDINGS['us']!r} END AS endings, {STEMS_SQL} AS stems FROM b),
      d AS (SELECT dump_id, f, t, endings, {held('stems')} AS stems, list_filter(list_filter(e, lambda x, i: list_position(e, x) = i), lambda x: contains(lower(t), lower(x))) AS expected FROM (SELECT *, {EXPECTED_SQL} AS e FROM c) c2),
      g AS (SELECT dump_id, 0 AS tier, unnest({first}) AS x FROM d WHERE length(f) >= {LEAST_FOOTER} UNION ALL SELECT dump_id, 1, unnest({second}) FROM d WHERE length(f) >= {LEAST_FOOTER}
        UNION ALL SELECT dump_id, 2, unnest({third}) FROM d WHERE length(f) >= {LEAST_FOOTER} UNION ALL SELECT dump_id, 3, unnest({fourth}) FROM d WHERE length(f) >= {LEAST_FOOTER}),
      k AS (SELECT dump_id, tier, row_number() OVER (PARTITION BY dump_id, tier) AS at_, x['name'] AS n, x['confidence'] AS confidence FROM g),
      v AS (SELECT dump_id, tier, at_, n, confidence FROM k WHERE n IS NOT NULL AND (confidence = 98 OR (({valid}) AND NOT ({slogan}) AND (confidence = 85 OR len(string_split(n, ' ')) >= 2)))),
      w AS (SELECT dump_id, arg_min(n, {{'t': tier, 'a': at_}}) AS name, arg_min(confidence, {{'t': tier, 'a': at_}}) AS confidence FROM v GROUP BY dump_id)
      SELECT p.dump_id, w.name, coalesce(w.confidence, 0)::INT AS confidence FROM {P} p LEFT JOIN w ON p.dump_id = w.dump_id"""


@query("X54_footer_entities", _footer_sql())
def footer_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The ladder over all pages and hosts."""
    footer, text = pages_text(F.col("html"))
    rows = DUMPS.read(spark, sf).select("dump_id", "domain", footer.alias("footer"), text.alias("text"))
    # a variable of a lambda is evaluated once, a column that the plan folds into the ladder for each pattern
    once = F.transform(F.array(F.struct("domain", "footer", "text")), lambda r: footer_ladder(r["domain"], r["footer"], r["text"]))
    found = rows.select("dump_id", F.element_at(once, 1).alias("x"))
    return found.select("dump_id", F.col("x.name").alias("name"), F.coalesce(F.col("x.confidence"), F.lit(0)).alias("confidence"))


def suggestions(name: Column, country: Column, most: int = 3) -> Column:
    """``entity, confidence, reasoning`` for a name without an ending: the first endings of the country's jurisdiction."""
    lists = F.create_map(*[x for c, j in JURISDICTION_OF_COUNTRY.items() for x in (F.lit(c), F.array(*map(F.lit, ENDINGS[j][:most])))])
    ended = F.lit(False)
    for pattern in HAS_ENDING:
        ended = ended | F.trim(name).rlike(pattern.replace(r"\b", EDGE))
    entry = lambda s, i: F.struct(F.concat(F.trim(name), F.lit(" "), s).alias("entity"), F.when(i == 0, "medium").otherwise("low").alias("confidence"), F.concat(s, F.when(i == 0, " is most common").otherwise(" is common")).alias("reasoning"))
    return F.when(~ended, F.transform(lists[country], entry))


_SUGGESTED = " UNION ALL ".join(f"SELECT '{c}' AS country, '{e}' AS ending, {i} AS i" for c, j in JURISDICTION_OF_COUNTRY.items() for i, e in enumerate(ENDINGS[j][:3]))


@query(
    "X6_X64_suggested_endings",
    f"""SELECT id, concat(trim(company_name), ' ', s.ending) AS entity, CASE WHEN s.i = 0 THEN 'medium' ELSE 'low' END AS confidence, concat(s.ending, CASE WHEN s.i = 0 THEN ' is most common' ELSE ' is common' END) AS reasoning, s.i::INT AS place
      FROM (SELECT id, company_name, CASE list_extract(string_split(domain, '.'), -1) {' '.join(f"WHEN '{t}' THEN '{c}'" for t, c in HINTS.items())} END AS country FROM {D} d WHERE company_name IS NOT NULL) n JOIN ({_SUGGESTED}) s ON n.country = s.country
      WHERE NOT ({' OR '.join(f"regexp_matches(trim(company_name), {quoted(p)})" for p in HAS_ENDING)})""",
)
def suggested_endings(spark: SparkSession, sf: str) -> DataFrame:
    """Three endings for each company name without one, by its domain's country. The original looked the country's code up among jurisdiction names, which found two of them; here the code leads to its jurisdiction."""
    hint = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])[names.top_level(F.col("domain"))]
    rows = DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select("id", suggestions(F.col("company_name"), hint).alias("s"))
    return rows.select("id", F.posexplode("s").alias("place", "x")).select("id", "x.entity", "x.confidence", "x.reasoning", "place")
