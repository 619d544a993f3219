"""Ladders that name a page's company, the contacts a page gives, and the validity of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators.evidence import TEXT_SQL, quoted, tagless
from tessera.operators.extraction import DECODE_SQL, decoded
from tessera.operators.scoring import TLD_SQL, any_in, contains_any, listed
from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, DUMPS, ENTITIES

D, C, E, P = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql, DUMPS.sql

JSON_LD = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
FOOTER = r"(?is)<footer[^>]*>(.*?)</footer>"
FOOTER_NAMED = r'(?is)<[a-z]+[^>]*(?:id|class)="[^"]*footer[^"]*"[^>]*>(.*?)</'
TITLE, HEADING = r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>"
NAV = r"(?is)<(?:nav|header)[^>]*>(.*?)</(?:nav|header)>"
LOGO = r'(?is)class="[^"]*(?:logo|brand)[^"]*"[^>]*>(?:\s|<a[^>]*>)*<img[^>]*\salt="([^"]*)"'


def flat(html: Column) -> Column:
    """Text of a piece of HTML, white space collapsed."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, r"<[^>]*>", " ")), r"\s+", " "))


def flat_sql(html: str) -> str:
    return f"trim(regexp_replace({DECODE_SQL(f"regexp_replace({html}, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'))"


def taken(html: Column, pattern: str) -> Column:
    """The trimmed first group, null if empty or absent."""
    return F.nullif(flat(F.regexp_extract(html, pattern, 1)), F.lit(""))


def taken_sql(pattern: str, html: str = "html") -> str:
    return f"nullif({flat_sql(f'regexp_extract({html}, {quoted(pattern)}, 1)')}, '')"


def meta(kind: str, name: str) -> tuple[str, str]:
    """A meta tag's content, whichever attribute comes first."""
    return rf'(?i)<meta[^>]*{kind}="{name}"[^>]*content="([^"]*)"', rf'(?i)<meta[^>]*content="([^"]*)"[^>]*{kind}="{name}"'


def either(html: Column, patterns: tuple[str, str]) -> Column:
    return F.coalesce(*[taken(html, p) for p in patterns])


def either_sql(patterns: tuple[str, str]) -> str:
    return f"coalesce({', '.join(taken_sql(p) for p in patterns)})"


def classed(name: str, attribute: str = "class") -> str:
    return rf'(?is)<[a-z0-9]+[^>]*\s{attribute}="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</'


def organisation(html: Column, kinds: list[str]) -> Column:
    """The name in the first JSON-LD block of one of the kinds."""
    blocks = F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))
    right = F.filter(blocks, lambda b: F.get_json_object(b, "$['@type']").isin(kinds) & F.get_json_object(b, "$.name").isNotNull())
    return F.nullif(F.get_json_object(F.get(right, 0), "$.name"), F.lit(""))


def organisation_sql(kinds: list[str]) -> str:
    return f"""nullif(json_extract_string(list_extract(list_filter(regexp_extract_all(html, {quoted(JSON_LD)}, 1), lambda b: CASE WHEN json_valid(b) THEN coalesce(json_extract_string(b, '$."@type"') IN ({listed(kinds)}) AND json_extract_string(b, '$.name') IS NOT NULL, false) ELSE false END), 1), '$.name'), '')"""


def before(html: Column, pattern: str, cut: str) -> Column:
    return F.nullif(F.trim(F.split(taken(html, pattern), cut)[0]), F.lit(""))


def before_sql(pattern: str, cut: str) -> str:
    return f"nullif(trim(list_extract(regexp_split_to_array({taken_sql(pattern)}, '{cut}'), 1)), '')"


def sized(value: Column, low: int, high: int) -> Column:
    return F.when(F.length(value).between(low, high), value)


def sized_sql(value: str, low: int, high: int) -> str:
    return f"CASE WHEN length({value}) BETWEEN {low} AND {high} THEN {value} END"


# Methods, in the order they are tried, with their confidence.
META = {"og:site_name": ("property", 90), "application-name": ("name", 85), "author": ("name", 80), "og:title": ("property", 75)}
HEADERS = {"h1": (HEADING, 65), ".logo": (classed("logo"), 75), "#logo": (classed("logo", "id"), 75), ".brand": (classed("brand"), 70), ".company-name": (classed("company-name"), 80), "[itemProp=name]": (classed("name", "itemprop"), 85)}
SITE_COPYRIGHT = r"©\s*(?:\d{4}\s*)?([^.\n]+)"
BROWSER_COPYRIGHT = r"(?i)©\s*\d{4}\s*([^.,|]+?)(?:\.|,|All|$)"
GREETING = r"(?i)welcome|home|hello"
ORGANISATION, ORGANISATIONS = ["Organization"], ["Organization", "Corporation", "Company"]

Rung = tuple[str, Column, int]


def climb(rungs: list[Rung]) -> tuple[Column, Column, Column]:
    """Name, method and confidence of the first rung with a result; null, null and 0 without any."""
    method, confidence = F.lit(None).cast("string"), F.lit(0)
    for name, value, worth in reversed(rungs):
        method, confidence = F.when(value.isNotNull(), name).otherwise(method), F.when(value.isNotNull(), worth).otherwise(confidence)
    return F.coalesce(*[v for _, v, _ in rungs]), method, confidence.cast("long")


def site_ladder(html: Column) -> list[Rung]:
    """JSON-LD, meta tags, title, header elements, footer."""
    title = before(html, TITLE, r"[|\-–—]")
    footer = F.coalesce(taken(html, FOOTER), taken(html, FOOTER_NAMED))
    return [
        ("json-ld_organization", organisation(html, ORGANISATION), 95),
        *[(f"meta_{n}", either(html, meta(k, n)), worth) for n, (k, worth) in META.items()],
        ("title_tag", F.when(taken(html, TITLE) != "Example Domain", title), 70),
        *[(f"header_{n}", sized(taken(html, p), 3, 99), worth) for n, (p, worth) in HEADERS.items()],
        ("footer_copyright", F.nullif(F.trim(F.regexp_extract(footer, SITE_COPYRIGHT, 1)), F.lit("")), 60),
    ]


def browser_ladder(html: Column) -> list[Rung]:
    """JSON-LD, meta property, footer copyright, logo, heading, title."""
    logo = taken(F.regexp_extract(html, NAV, 1), LOGO)
    heading, title = taken(html, HEADING), before(html, TITLE, "[-|–]")
    return [
        ("structured_data", organisation(html, ORGANISATIONS), 95),
        ("meta_property", F.coalesce(either(html, meta("property", "og:site_name")), either(html, meta("name", "application-name"))), 85),
        ("footer_copyright", F.nullif(F.trim(F.regexp_extract(taken(html, FOOTER), BROWSER_COPYRIGHT, 1)), F.lit("")), 75),
        ("logo_alt_text", F.when(~F.lower(logo).contains("logo"), logo), 70),
        ("h1_text", F.when(F.length(heading).between(3, 49) & ~heading.rlike(GREETING), heading), 65),
        ("page_title", F.when(F.length(title) > 2, title), 60),
    ]


def static_ladder(html: Column) -> list[Rung]:
    """Meta property, title, heading."""
    return [
        ("meta_property", F.coalesce(either(html, meta("property", "og:site_name")), either(html, meta("name", "application-name"))), 85),
        ("html_title", before(html, TITLE, r"[|\-–—]"), 70),
        ("header_analysis", taken(html, HEADING), 65),
    ]


SITE_META = f"coalesce({either_sql(meta('property', 'og:site_name'))}, {either_sql(meta('name', 'application-name'))})"
SITE_SQL = [
    ("json-ld_organization", organisation_sql(ORGANISATION), 95),
    *[(f"meta_{n}", either_sql(meta(k, n)), worth) for n, (k, worth) in META.items()],
    ("title_tag", f"CASE WHEN {taken_sql(TITLE)} <> 'Example Domain' THEN {before_sql(TITLE, '[|\\-–—]')} END", 70),
    *[(f"header_{n}", sized_sql(taken_sql(p), 3, 99), worth) for n, (p, worth) in HEADERS.items()],
    ("footer_copyright", f"nullif(trim(regexp_extract(coalesce({taken_sql(FOOTER)}, {taken_sql(FOOTER_NAMED)}), {quoted(SITE_COPYRIGHT)}, 1)), '')", 60),
]
BROWSER_SQL = [
    ("structured_data", organisation_sql(ORGANISATIONS), 95),
    ("meta_property", SITE_META, 85),
    ("footer_copyright", f"nullif(trim(regexp_extract({taken_sql(FOOTER)}, {quoted(BROWSER_COPYRIGHT)}, 1)), '')", 75),
    ("logo_alt_text", f"CASE WHEN NOT contains(lower({taken_sql(LOGO, f'regexp_extract(html, {quoted(NAV)}, 1)')}), 'logo') THEN {taken_sql(LOGO, f'regexp_extract(html, {quoted(NAV)}, 1)')} END", 70),
    ("h1_text", f"CASE WHEN length({taken_sql(HEADING)}) BETWEEN 3 AND 49 AND NOT regexp_matches({taken_sql(HEADING)}, '{GREETING}') THEN {taken_sql(HEADING)} END", 65),
    ("page_title", f"CASE WHEN length({before_sql(TITLE, '[-|–]')}) > 2 THEN {before_sql(TITLE, '[-|–]')} END", 60),
]
STATIC_SQL = [("meta_property", SITE_META, 85), ("html_title", before_sql(TITLE, "[|\\-–—]"), 70), ("header_analysis", taken_sql(HEADING), 65)]


def climb_sql(rungs: list[tuple[str, str, int]]) -> str:
    inner = ", ".join(f"{sql} AS r{i}" for i, (_, sql, _) in enumerate(rungs))
    some = range(len(rungs))
    return f"""SELECT dump_id, coalesce({', '.join(f'r{i}' for i in some)}) AS name, CASE {' '.join(f"WHEN r{i} IS NOT NULL THEN '{rungs[i][0]}'" for i in some)} END AS method,
      CASE {' '.join(f'WHEN r{i} IS NOT NULL THEN {rungs[i][2]}' for i in some)} ELSE 0 END AS confidence FROM (SELECT dump_id, {inner} FROM {P} p) x"""


def climbed(spark: SparkSession, sf: str, ladder) -> DataFrame:
    rungs = ladder(F.col("html"))
    rows = DUMPS.read(spark, sf).select("dump_id", *[v.alias(f"r{i}") for i, (_, v, _) in enumerate(rungs)])
    name, method, confidence = climb([(n, F.col(f"r{i}"), w) for i, (n, _, w) in enumerate(rungs)])
    return rows.select("dump_id", name.alias("name"), method.alias("method"), confidence.alias("confidence"))


@query("X40_site_ladder", climb_sql(SITE_SQL))
def site_names(spark: SparkSession, sf: str) -> DataFrame:
    return climbed(spark, sf, site_ladder)


@query("X82_browser_ladder", climb_sql(BROWSER_SQL))
def browser_names(spark: SparkSession, sf: str) -> DataFrame:
    return climbed(spark, sf, browser_ladder)


@query("X82_static_ladder", climb_sql(STATIC_SQL))
def static_names(spark: SparkSession, sf: str) -> DataFrame:
    return climbed(spark, sf, static_ladder)


# Patterns and words of contacts.
CONTACT_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
US_PHONE = r"\+?1?\s*\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
STREET = r"(?i)\d+\s+\w+\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd)"
CURRENCY_SIGNS = ["$", "€", "£", "¥"]
COUNTRIES = ["United States", "USA", "UK", "United Kingdom", "Canada", "Germany", "France", "Japan", "China", "India"]
SOCIAL = ["facebook.com", "twitter.com", "linkedin.com", "instagram.com", "youtube.com"]
LINK = r'(?is)<a[^>]*\shref="([^"]*)"[^>]*>(.*?)</a>'
COMPANY_NO, VAT = r"(?i)Company No\.?\s*:?\s*([A-Z0-9-]+)", r"(?i)VAT\s*:?\s*([A-Z0-9-]+)"
LINKED = ["about", "terms", "privacy", "contact"]


def some(values: Column, most: int) -> Column:
    """The first distinct ones, in order, as one string."""
    return F.array_join(F.slice(F.array_distinct(values), 1, most), "; ")


def some_sql(values: str, most: int) -> str:
    return f"array_to_string(list_slice(list_filter({values}, lambda x, i: list_position({values}, x) = i), 1, {most}), '; ')"


def contacts(text: Column, html: Column) -> dict[str, Column]:
    links = F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(LINK), F.lit(2)).alias("label"))
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = lambda words: F.array_join(F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words])), "; ")

    def linked(word: str) -> Column:
        return F.get(F.filter(links, lambda x: x["href"].contains(word) | F.lower(flat(x["label"])).contains(word)), 0)["href"]

    return {
        "emails": some(every(CONTACT_EMAIL), 10),
        "phones": some(every(US_PHONE), 10),
        "addresses": some(every(STREET), 5),
        "currencies": held(CURRENCY_SIGNS),
        "countries": held(COUNTRIES),
        "social": F.array_join(F.slice(F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: contains_any(x, SOCIAL)), 1, 10), "; "),
        **{f"{w}_link": linked(w) for w in LINKED},
        "company_no": F.nullif(F.regexp_extract(text, COMPANY_NO, 1), F.lit("")),
        "vat": F.nullif(F.regexp_extract(text, VAT, 1), F.lit("")),
    }


CONTACTS_SQL = f"""SELECT dump_id, {some_sql('emails_', 10)} AS emails, {some_sql('phones_', 10)} AS phones, {some_sql('addresses_', 5)} AS addresses,
  array_to_string(list_filter([{', '.join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for w in CURRENCY_SIGNS)}], lambda x: x IS NOT NULL), '; ') AS currencies,
  array_to_string(list_filter([{', '.join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for w in COUNTRIES)}], lambda x: x IS NOT NULL), '; ') AS countries,
  array_to_string(list_slice(list_filter(hrefs, lambda x: {any_in(SOCIAL, 'x')}), 1, 10), '; ') AS social,
  {', '.join(f"list_extract(list_filter(hrefs, lambda x, i: contains(x, '{w}') OR contains(lower({flat_sql('list_extract(labels, i)')}), '{w}')), 1) AS {w}_link" for w in LINKED)},
  nullif(regexp_extract(t, {quoted(COMPANY_NO)}, 1), '') AS company_no, nullif(regexp_extract(t, {quoted(VAT)}, 1), '') AS vat
  FROM (SELECT dump_id, t, regexp_extract_all(t, {quoted(CONTACT_EMAIL)}) AS emails_, regexp_extract_all(t, {quoted(US_PHONE)}) AS phones_, regexp_extract_all(t, {quoted(STREET)}) AS addresses_,
    regexp_extract_all(html, {quoted(LINK)}, 1) AS hrefs, regexp_extract_all(html, {quoted(LINK)}, 2) AS labels FROM (SELECT dump_id, html, {TEXT_SQL} AS t FROM {P} p) q) r"""


@query("X84_contact_harvest", CONTACTS_SQL)
def contact_harvest(spark: SparkSession, sf: str) -> DataFrame:
    """E-mails, phones, addresses, currencies, countries, social and legal links, and registry numbers of each page."""
    rows = DUMPS.read(spark, sf).select("dump_id", "html", tagless(F.col("html")).alias("t"))
    return rows.select("dump_id", *[c.alias(n) for n, c in contacts(F.col("t"), F.col("html")).items()])


NAME_TABLE = f"(SELECT cast(id AS VARCHAR) AS k, company_name AS name FROM {D} d WHERE company_name IS NOT NULL UNION ALL SELECT lei_code AS k, legal_name AS name FROM {E} e UNION ALL SELECT concat('p', cast(dump_id AS VARCHAR)) AS k, {flat_sql(f'regexp_extract(html, {quoted(TITLE)}, 1)')} AS name FROM {P} p)"


def all_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of domains and entities, and titles of pages."""
    domains = DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select(F.col("id").cast("string").alias("k"), F.col("company_name").alias("name"))
    entities = ENTITIES.read(spark, sf).select(F.col("lei_code").alias("k"), F.col("legal_name").alias("name"))
    titles = DUMPS.read(spark, sf).select(F.concat(F.lit("p"), F.col("dump_id").cast("string")).alias("k"), flat(F.regexp_extract("html", TITLE, 1)).alias("name"))
    return domains.unionAll(entities).unionAll(titles)


def sql_pattern(pattern: str) -> str:
    return quoted("(?i)" + pattern)


REJECTED_SQL = " OR ".join(f"regexp_matches(trim(name), {sql_pattern(p)})" for p in names.REJECTED)
VALID_SQL = f"CASE WHEN length(name) < 5 OR length(name) > 100 THEN false WHEN regexp_matches(name, {sql_pattern(names.TECH_WORDS)}) THEN true ELSE NOT ({REJECTED_SQL}) END"


@query("X13_name_validity", f"SELECT k, name, {VALID_SQL} AS valid FROM {NAME_TABLE} n")
def name_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Length, then words of technology, which pass, then the patterns that no name has."""
    return all_names(spark, sf).select("k", "name", names.is_valid_name(F.col("name")).alias("valid"))


@query("X14_marketing", f"SELECT k, {' OR '.join(f'regexp_matches(trim(name), {sql_pattern(p)})' for p in names.SLOGANS)} AS slogan, {any_in(names.MARKETING, 'lower(name)')} AS marketing FROM {NAME_TABLE} n")
def marketing(spark: SparkSession, sf: str) -> DataFrame:
    """The two lists of marketing phrases."""
    return all_names(spark, sf).select("k", names.is_slogan(F.col("name")).alias("slogan"), names.is_marketing(F.col("name")).alias("marketing"))


ENDS_SQL = f"list_extract(regexp_split_to_array(lower(regexp_replace(trim(name), '[.,]', '', 'g')), '\\s+'), -1) IN ({listed(names.LEGAL_SUFFIXES)})"
REASON_SQL = f"""CASE WHEN length(name) < 3 THEN 'Too short' WHEN length(name) > 100 THEN 'Too long' {' '.join(f"WHEN contains(lower(name), '{p}') THEN 'Contains blacklisted pattern: {p}'" for p in names.BLACKLIST)}
  WHEN NOT ({ENDS_SQL}) AND NOT ({any_in(names.INSTITUTIONS, 'lower(name)')}) THEN 'Missing required legal suffix for corporate entity' END"""


@query("X17_validation_reason", f"SELECT k, {REASON_SQL} IS NULL AS valid, {REASON_SQL} AS reason FROM {NAME_TABLE} n")
def validation_reason(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that a name breaks; institutions need no legal ending."""
    reason = names.validation_reason(F.col("name"))
    return all_names(spark, sf).select("k", reason.isNull().alias("valid"), reason.alias("reason"))


ISSUES_SQL = f"""array_to_string(list_filter([CASE WHEN length(name) < 2 THEN 'Name too short' END, CASE WHEN length(name) > 200 THEN 'Name too long' END,
  {', '.join(f"CASE WHEN contains(lower(name), {quoted(p)}) THEN {quoted(f'Contains marketing phrase: {chr(34)}{p}{chr(34)}')} END" for p in names.CLAIMS)},
  CASE WHEN NOT ({' OR '.join(f"ends_with(lower(name), '{a}{s}{b}')" for s in names.ENDINGS for a in (' ', ', ') for b in ('', '.'))}) AND NOT contains(lower(name), ' ') THEN 'Missing legal suffix (Inc., LLC, Ltd., etc.)' END], lambda x: x IS NOT NULL), '; ')"""


@query("X75_name_issues", f"SELECT k, {ISSUES_SQL} AS issues FROM {NAME_TABLE} n")
def name_issues(spark: SparkSession, sf: str) -> DataFrame:
    """All issues of a name, in the order of the rules."""
    return all_names(spark, sf).select("k", F.array_join(names.name_issues(F.col("name")), "; ").alias("issues"))


STEMS_SQL = f"list_filter(list_concat([list_extract(string_split(domain, '.'), 1)], list_filter(regexp_split_to_array(list_extract(string_split(domain, '.'), 1), '[-_0-9]+'), lambda x: length(x) > 2 AND lower(x) NOT IN ({listed(names.COMMON_STEMS)}))), lambda x: x <> '')"
CAP_SQL = lambda x: f"concat(upper(substr({x}, 1, 1)), lower(substr({x}, 2)))"
EXPECTED_SQL = f"""flatten(list_transform(stems, lambda s: list_filter([CASE WHEN contains(s, '-') THEN array_to_string(list_transform(string_split(s, '-'), lambda p: {CAP_SQL('p')}), ' ') END,
  CASE WHEN contains(s, '_') THEN array_to_string(list_transform(string_split(s, '_'), lambda p: {CAP_SQL('p')}), ' ') END, {CAP_SQL('s')}], lambda x: x IS NOT NULL)))"""


@query("X9_expected_names", f"SELECT id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), '; ') AS expected FROM (SELECT id, {EXPECTED_SQL} AS e FROM (SELECT id, {STEMS_SQL} AS stems FROM {D} d) s) x")
def expected_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that a domain's stems lead one to expect."""
    return DOMAINS.read(spark, sf).select("id", F.array_join(names.expected_names(F.col("domain")), "; ").alias("expected"))


# The candidate score of the fourth kind.
V4_WEIGHTS = {"tld": 0.30, "name": 0.30, "type": 0.25, "status": 0.15}
V4_COMMONWEALTH = ["CA", "GB", "AU"]
V4_TLD = {"uk": "GB", "de": "DE", "fr": "FR", "jp": "JP", "au": "AU", "ca": "CA", "ch": "CH", "at": "AT"}
COMMERCIAL, CHARITABLE = ["inc", "corp"], ["stiftung", "foundation"]
COMMERCIAL_NAME = ["inc.", "corp"]


def score_v4(domain: Column, name: Column, legal_name: Column, legal_form: Column, jurisdiction: Column, entity: Column, registration: Column) -> dict[str, Column]:
    tld, legal, form = names.top_level(domain), F.lower(legal_name), F.lower(legal_form)
    country = F.create_map(*[F.lit(x) for kv in V4_TLD.items() for x in kv])[tld]
    on_com = domain.endswith(".com")
    scores = {
        "tld": F.when(tld == "com", F.when(jurisdiction == "US", 95).when(jurisdiction.isin(V4_COMMONWEALTH), 60).otherwise(15)).when(country == jurisdiction, 90).otherwise(30),
        "name": F.when(legal.startswith(F.lower(name)), 95).when(legal.contains(F.lower(name)), 80).when(F.lower(name).contains(F.split(legal, " ")[0]), 60).otherwise(30),
        "type": F.when(on_com & (contains_any(form, COMMERCIAL) | contains_any(legal, COMMERCIAL_NAME)), 90).when(on_com & (contains_any(form, CHARITABLE) | contains_any(legal, CHARITABLE)), 25).otherwise(60),
        "status": F.when((entity == "ACTIVE") & (registration == "LAPSED"), 70).when((entity == "ACTIVE") & (registration == "ISSUED"), 95).when(entity == "INACTIVE", 20).otherwise(50),
    }
    return scores


V4_SQL = f"""SELECT domain_id, lei_code, tie1, tie3, tld, name, type, status, cast(floor(tld * 0.30::DOUBLE + name * 0.30::DOUBLE + type * 0.25::DOUBLE + status * 0.15::DOUBLE + 0.5) AS BIGINT) AS total,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN domain LIKE '%.com' AND jurisdiction = 'US' THEN '.com domain favors US entity (+95 TLD score)' END,
    CASE WHEN type >= 80 THEN 'Commercial entity preferred for business domain' WHEN type <= 30 THEN 'Foundation penalized on commercial domain' END,
    CASE WHEN registration_status = 'LAPSED' AND entity_status = 'ACTIVE' THEN 'LAPSED registration acceptable for ACTIVE entity' END, CASE WHEN name >= 80 THEN 'Strong name match with extracted term' END], lambda x: x IS NOT NULL), '; '), ''), 'Standard scoring applied') AS reason
  FROM (SELECT c.domain_id, c.lei_code, c.tie1, c.tie3, d.domain, c.jurisdiction, c.registration_status, c.entity_status,
    CASE WHEN {TLD_SQL} = 'com' THEN CASE WHEN c.jurisdiction = 'US' THEN 95 WHEN c.jurisdiction IN ({listed(V4_COMMONWEALTH)}) THEN 60 ELSE 15 END
      WHEN CASE {TLD_SQL} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V4_TLD.items())} END = c.jurisdiction THEN 90 ELSE 30 END AS tld,
    CASE WHEN starts_with(lower(c.legal_name), lower(d.company_name)) THEN 95 WHEN contains(lower(c.legal_name), lower(d.company_name)) THEN 80 WHEN contains(lower(d.company_name), list_extract(string_split(lower(c.legal_name), ' '), 1)) THEN 60 ELSE 30 END AS name,
    CASE WHEN d.domain LIKE '%.com' AND ({any_in(COMMERCIAL, 'lower(c.legal_form)')} OR {any_in(COMMERCIAL_NAME, 'lower(c.legal_name)')}) THEN 90 WHEN d.domain LIKE '%.com' AND ({any_in(CHARITABLE, 'lower(c.legal_form)')} OR {any_in(CHARITABLE, 'lower(c.legal_name)')}) THEN 25 ELSE 60 END AS type,
    CASE WHEN c.entity_status = 'ACTIVE' AND c.registration_status = 'LAPSED' THEN 70 WHEN c.entity_status = 'ACTIVE' AND c.registration_status = 'ISSUED' THEN 95 WHEN c.entity_status = 'INACTIVE' THEN 20 ELSE 50 END AS status
    FROM {C} c JOIN {D} d ON c.domain_id = d.id WHERE d.company_name IS NOT NULL) s"""


@query("X87_candidate_score_v4", V4_SQL)
def scores_v4(spark: SparkSession, sf: str) -> DataFrame:
    """Domain, name, type and status of each candidate by the fourth score, their weighted total and its reasons."""
    domains = DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select(F.col("id").alias("domain_id"), "domain", "company_name")
    c = F.col
    rows = CANDIDATES.read(spark, sf).join(domains, "domain_id")
    parts = score_v4(c("domain"), c("company_name"), c("legal_name"), c("legal_form"), c("jurisdiction"), c("entity_status"), c("registration_status"))
    rows = rows.select("domain_id", "lei_code", "tie1", "tie3", "domain", "jurisdiction", "registration_status", "entity_status", *[x.alias(n) for n, x in parts.items()])
    total = F.floor(sum((c(n) * F.lit(w) for n, w in V4_WEIGHTS.items()), F.lit(0.0)) + 0.5)
    said = F.array_compact(
        F.array(
            F.when(c("domain").endswith(".com") & (c("jurisdiction") == "US"), ".com domain favors US entity (+95 TLD score)"),
            F.when(c("type") >= 80, "Commercial entity preferred for business domain").when(c("type") <= 30, "Foundation penalized on commercial domain"),
            F.when((c("registration_status") == "LAPSED") & (c("entity_status") == "ACTIVE"), "LAPSED registration acceptable for ACTIVE entity"),
            F.when(c("name") >= 80, "Strong name match with extracted term"),
        )
    )
    reason = F.when(F.size(said) > 0, F.array_join(said, "; ")).otherwise("Standard scoring applied")
    return rows.select("domain_id", "lei_code", "tie1", "tie3", *parts, total.alias("total"), reason.alias("reason"))
