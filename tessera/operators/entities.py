"""Entities that a page names, with the evidence for each, and registry records in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.evidence import TEXT_SQL, quoted, tagless
from tessera.operators.ladders import FOOTER, FOOTER_NAMED, JSON_LD, TITLE, classed, either, either_sql, flat, flat_sql, meta
from tessera.operators.metadata import CORPORATE, title_entity, title_entity_sql
from tessera.plans.register import query
from tessera.sources.logical import DUMPS, ENTITIES

P, E = DUMPS.sql, ENTITIES.sql
# Phrases that no entity holds, the pattern of copyright lines, confidence by source, and what a source adds to the page's confidence.
PHRASES = ["leading provider", "best in class", "your partner", "trusted source", "comprehensive solutions"]
COPYRIGHT = r"(?i)(?:©|Copyright|All rights reserved?)\s+(?:by\s+)?([A-Z][A-Za-z0-9\s&.,'-]+?)(?:\.|,|\s+All|\s+Rights|\s+\d{4}|$)"
SOURCES = {"page_title": 0.7, "og:site_name": 0.85, "copyright": 0.75, "json-ld_organization": 0.95, "json-ld_local_business": 0.9, "json-ld_brand": 0.85, "json-ld_publisher": 0.8}
ADDS = {"page_title": 0.1, "copyright": 0.15, "json-ld_organization": 0.3, "json-ld_publisher": 0.15}
OTHERS_ADD, BASE, SUFFIX_ADDS, MOST = 0.05, 0.5, 0.2, 0.95


def cleaned(name: Column) -> Column:
    """White space and punctuation at the end removed; null unless of 3 to 100 characters without marketing phrases."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"[.,;!?]+$", "")
    return F.when(F.length(bare).between(3, 100) & ~F.greatest(*[F.lower(bare).contains(p) for p in PHRASES]), bare)


def cleaned_sql(name: str) -> str:
    bare = f"regexp_replace(trim(regexp_replace({name}, '\\s+', ' ', 'g')), '[.,;!?]+$', '')"
    return f"CASE WHEN length({bare}) BETWEEN 3 AND 100 AND NOT ({' OR '.join(f"contains(lower({bare}), '{p}')" for p in PHRASES)}) THEN {bare} END"


def ends_corporate(name: Column) -> Column:
    return F.greatest(*[F.lower(name).endswith(s + d) for s in CORPORATE for d in ("", ".")])


ENDS = lambda x: "(" + " OR ".join(f"ends_with(lower({x}), '{s}{d}')" for s in CORPORATE for d in ("", ".")) + ")"


def suffixed(name: Column) -> Column:
    return F.when(~ends_corporate(name) & name.rlike("^[A-Z0-9]"), F.concat(name, F.lit(" Inc."))).otherwise(name)


def suffixed_sql(name: str) -> str:
    return f"CASE WHEN NOT {ENDS(name)} AND regexp_matches({name}, '^[A-Z0-9]') THEN concat({name}, ' Inc.') ELSE {name} END"


def items(html: Column) -> Column:
    """The objects of all JSON-LD blocks: of arrays and graphs their members."""
    blocks = F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))
    graph = lambda b: F.get_json_object(b, "$['@graph']")
    many = lambda b: F.from_json(b, "array<string>")
    return F.flatten(F.transform(blocks, lambda b: F.coalesce(F.when(F.trim(b).startswith("["), many(b)).when(graph(b).isNotNull(), many(graph(b))).otherwise(F.array(b)), F.array().cast("array<string>"))))


ITEMS_SQL = f"""flatten(list_transform(list_filter(regexp_extract_all(html, {quoted(JSON_LD)}, 1), lambda b: json_valid(b)), lambda b: CASE WHEN json_type(b) = 'ARRAY' THEN json_extract(b, '$[*]') WHEN json_extract(b, '$."@graph"') IS NOT NULL THEN json_extract(b, '$."@graph"[*]') ELSE [b::JSON] END))"""


def evidence(html: Column, text: Column) -> Column:
    """``array<struct<name, source, confidence>>``, in the order found: title, site name, copyright lines, then the objects of structured data."""
    one = lambda name, source: F.struct(name.alias("name"), F.lit(source).alias("source"), F.lit(SOURCES[source]).alias("confidence"))
    is_a = lambda x, kind: F.coalesce(F.get_json_object(x, "$['@type']").rlike(rf'(?:^|"){kind}(?:"|$)'), F.lit(False))
    brand = lambda x: F.coalesce(F.get_json_object(x, "$.brand.name"), F.when(~F.get_json_object(x, "$.brand").startswith("{"), F.get_json_object(x, "$.brand")))
    structured = F.flatten(
        F.transform(
            items(html),
            lambda x: F.array(
                one(F.when(is_a(x, "Organization"), suffixed(cleaned(F.get_json_object(x, "$.name")))), "json-ld_organization"),
                one(F.when(is_a(x, "LocalBusiness"), suffixed(cleaned(F.get_json_object(x, "$.name")))), "json-ld_local_business"),
                one(suffixed(cleaned(brand(x))), "json-ld_brand"),
                one(cleaned(F.get_json_object(x, "$.publisher.name")), "json-ld_publisher"),
            ),
        )
    )
    lines = F.transform(F.regexp_extract_all(text, F.lit(COPYRIGHT), F.lit(1)), cleaned)
    copyright_ = F.transform(F.filter(lines, lambda x: ~x.rlike("^[0-9]+$")), lambda x: one(x, "copyright"))
    first = F.array(one(title_entity(flat(F.regexp_extract(html, TITLE, 1))), "page_title"), one(cleaned(either(html, meta("property", "og:site_name"))), "og:site_name"))
    return F.filter(F.concat(first, copyright_, structured), lambda x: x["name"].isNotNull())


def _one_sql(name: str, source: str) -> str:
    return f"{{'name': {name}, 'source': '{source}', 'confidence': {SOURCES[source]}::DOUBLE}}"


def _is_sql(kind: str) -> str:
    return f"""coalesce(regexp_matches(json_extract_string(x, '$."@type"'), '(?:^|"){kind}(?:"|$)'), false)"""


NAME_SQL, BRAND_SQL = "json_extract_string(x, '$.name')", "coalesce(json_extract_string(x, '$.brand.name'), CASE WHEN json_type(x, '$.brand') = 'VARCHAR' THEN json_extract_string(x, '$.brand') END)"
EVIDENCE_SQL = f"""list_filter(list_concat([{_one_sql(title_entity_sql(flat_sql(f'regexp_extract(html, {quoted(TITLE)}, 1)')), 'page_title')}, {_one_sql(cleaned_sql(either_sql(meta('property', 'og:site_name'))), 'og:site_name')}],
  list_transform(list_filter(list_transform(regexp_extract_all(t, {quoted(COPYRIGHT)}, 1), lambda x: {cleaned_sql('x')}), lambda x: NOT regexp_matches(x, '^[0-9]+$')), lambda x: {_one_sql('x', 'copyright')}),
  flatten(list_transform({ITEMS_SQL}, lambda x: [{_one_sql(f"CASE WHEN {_is_sql('Organization')} THEN {suffixed_sql(cleaned_sql(NAME_SQL))} END", 'json-ld_organization')}, {_one_sql(f"CASE WHEN {_is_sql('LocalBusiness')} THEN {suffixed_sql(cleaned_sql(NAME_SQL))} END", 'json-ld_local_business')},
    {_one_sql(suffixed_sql(cleaned_sql(BRAND_SQL)), 'json-ld_brand')}, {_one_sql(cleaned_sql("json_extract_string(x, '$.publisher.name')"), 'json-ld_publisher')}]))), lambda x: x.name IS NOT NULL)"""


def primary(names: Column) -> Column:
    """The longest name with a corporate ending; else one of at most 50 characters, without blanks, the shortest; of equal ones the first."""
    placed = F.transform(names, lambda x, i: F.struct(x.alias("name"), i.alias("at")))
    ended = F.transform(F.filter(placed, lambda x: ends_corporate(x["name"])), lambda x: F.struct((-F.length(x["name"])).alias("k"), x["at"].alias("at"), x["name"].alias("name")))
    concise = F.transform(placed, lambda x: F.struct((F.length(x["name"]) > 50).alias("long"), x["name"].contains(" ").alias("spaced"), F.length(x["name"]).alias("n"), x["at"].alias("at"), x["name"].alias("name")))
    return F.coalesce(F.array_min(ended)["name"], F.array_min(concise)["name"])


PRIMARY_SQL = f"""coalesce(list_extract(list_sort(list_transform(list_filter(placed, lambda x: {ENDS('x.name')}), lambda x: {{'k': -length(x.name), 'at': x.pos, 'name': x.name}})), 1).name,
  list_extract(list_sort(list_transform(placed, lambda x: {{'long': length(x.name) > 50, 'spaced': contains(x.name, ' '), 'n': length(x.name), 'at': x.pos, 'name': x.name}})), 1).name)"""
ADDS_SQL = f"CASE s {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in ADDS.items())} ELSE {OTHERS_ADD}::DOUBLE END"
#: A page's copyright lines are one source, each object of structured data one of its own.
FOUND_SQL = f"""SELECT dump_id, {PRIMARY_SQL} AS primary_entity, array_to_string(list_transform(placed, lambda x: x.name), '; ') AS entities, array_to_string(list_transform(e, lambda x: concat(x.source, '=', x.name)), '; ') AS evidence,
  CASE WHEN len(placed) = 0 THEN 0.0::DOUBLE ELSE least({MOST}::DOUBLE, {BASE}::DOUBLE + coalesce(list_sum(list_transform(list_concat(list_filter(list_transform(e, lambda x: x.source), lambda x: x <> 'copyright'), CASE WHEN list_contains(list_transform(e, lambda x: x.source), 'copyright') THEN ['copyright'] ELSE [] END), lambda s: {ADDS_SQL})), 0)
    + CASE WHEN {ENDS(PRIMARY_SQL)} THEN {SUFFIX_ADDS}::DOUBLE ELSE 0.0::DOUBLE END) END AS confidence
  FROM (SELECT dump_id, e, list_transform(list_filter(list_transform(e, lambda x, i: {{'name': x.name, 'pos': i}}), lambda x: list_position(list_transform(e, lambda y: lower(trim(y.name))), lower(trim(x.name))) = x.pos), lambda x: x) AS placed
    FROM (SELECT dump_id, {EVIDENCE_SQL} AS e FROM (SELECT dump_id, html, {TEXT_SQL} AS t FROM {P} p) q) r) u"""


def page_entities(found: Column) -> dict[str, Column]:
    low = F.transform(found, lambda x: F.lower(F.trim(x["name"])))
    distinct = F.transform(F.filter(F.transform(found, lambda x, i: F.struct(x["name"].alias("name"), (i + 1).cast("long").alias("at"))), lambda x: F.array_position(low, F.lower(F.trim(x["name"]))) == x["at"]), lambda x: x["name"])
    best = primary(distinct)
    kinds = F.transform(found, lambda x: x["source"])
    sources = F.concat(F.filter(kinds, lambda s: s != "copyright"), F.when(F.array_contains(kinds, "copyright"), F.array(F.lit("copyright"))).otherwise(F.array().cast("array<string>")))
    worth = lambda s: F.coalesce(*[F.when(s == k, F.lit(v)) for k, v in ADDS.items()], F.lit(OTHERS_ADD))
    total = F.lit(BASE) + F.aggregate(sources, F.lit(0.0), lambda acc, s: acc + worth(s)) + F.when(ends_corporate(best), SUFFIX_ADDS).otherwise(0.0)
    return {
        "primary_entity": best,
        "entities": F.array_join(distinct, "; "),
        "evidence": F.array_join(F.transform(found, lambda x: F.concat_ws("=", x["source"], x["name"])), "; "),
        "confidence": F.when(F.size(distinct) == 0, 0.0).otherwise(F.least(F.lit(MOST), total)),
    }


@query("X42_entity_evidence", FOUND_SQL)
def entity_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The entities of each page, the primary one, the evidence for each and the confidence."""
    rows = DUMPS.read(spark, sf).select("dump_id", evidence(F.col("html"), tagless(F.col("html"))).alias("e"))
    return rows.select("dump_id", *[c.alias(n) for n, c in page_entities(F.col("e")).items()])


# The footer ladder of the smoke test.
FORMS = r"(?:Inc\.?|Corp\.?|Corporation|Ltd\.?|Limited|LLC|Company|Co\.?|Group|Holdings|AG|GmbH|SA|SAS|SARL|Ltda\.?|S\.A\.?|Pte\.?\s*Ltd\.?|Pvt\.?\s*Ltd\.?)"
SHORT_FORMS = r"(?:Inc\.?|Corp\.?|Corporation|Ltd\.?|Limited|LLC|Company|Co\.?)"
NAMED = r"([A-Z][\w\s&,.'-]+?"
FOOTER_PATTERNS = [rf"(?i)©\s*\d{{4}}[^A-Za-z]*{NAMED}{FORMS})", rf"(?i)copyright\s*©?\s*\d{{4}}[^A-Za-z]*{NAMED}{FORMS})", rf"(?i)\d{{4}}[^A-Za-z]*{NAMED}{FORMS})", rf"(?i){NAMED}{FORMS})[^A-Za-z]*all\s*rights\s*reserved"]
LEGAL_PATTERNS = [rf"(?i)(?:operated|owned|managed)\s+by\s+{NAMED}{SHORT_FORMS})", rf"(?i)a\s+(?:subsidiary|division|brand)\s+of\s+{NAMED}{SHORT_FORMS})"]
NO_NAMES = ["javascript", "loading", "menu", "button"]
LEGAL_PARTS = [FOOTER, FOOTER_NAMED, classed("copyright"), classed("legal")]


def footer_name(name: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.trim(name), r"^\s*-\s*", ""), r"(?i)\s*all rights reserved.*$", "")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*\.\s*$", ""), r"\s*,\s*$", ""))
    return F.when(F.length(name).between(3, 80) & ~F.greatest(*[F.lower(name).contains(w) for w in NO_NAMES]), name)


def footer_name_sql(name: str) -> str:
    name = f"regexp_replace(regexp_replace(trim({name}), '^\\s*-\\s*', ''), '(?i)\\s*all rights reserved.*$', '')"
    name = f"trim(regexp_replace(regexp_replace({name}, '\\s*\\.\\s*$', ''), '\\s*,\\s*$', ''))"
    return f"CASE WHEN length({name}) BETWEEN 3 AND 80 AND NOT ({' OR '.join(f"contains(lower({name}), '{w}')" for w in NO_NAMES)}) THEN {name} END"


def footer_ladder(html: Column) -> tuple[Column, Column, Column]:
    """Name, method and confidence: the first valid name of the footer patterns in order (85), then who operates or owns the site (75). The footer is what such elements hold; where they stand on
    the screen cannot be told from a capture."""
    text = F.concat_ws(" ", *[flat(F.regexp_extract(html, p, 1)) for p in LEGAL_PARTS])
    valid = lambda p: F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), footer_name), lambda x: x.isNotNull()), 0)
    name = F.coalesce(*[valid(p) for p in FOOTER_PATTERNS])
    owners = [F.trim(F.regexp_extract(text, p, 1)) for p in LEGAL_PATTERNS]
    legal = F.coalesce(*[F.when(F.length(o).between(3, 60), o) for o in owners])
    method = F.when(name.isNotNull(), "puppeteer_footer_copyright").when(legal.isNotNull(), "puppeteer_legal_disclaimer").otherwise("puppeteer_failed")
    return F.coalesce(name, legal), method, F.when(name.isNotNull(), 85).when(legal.isNotNull(), 75).otherwise(0)


FOOTER_TEXT_SQL = f"concat_ws(' ', {', '.join(flat_sql(f'regexp_extract(html, {quoted(p)}, 1)') for p in LEGAL_PARTS)})"
VALID_SQL = ", ".join(f"list_extract(list_filter(list_transform(regexp_extract_all(t, {quoted(p)}, 1), lambda x: {footer_name_sql('x')}), lambda x: x IS NOT NULL), 1)" for p in FOOTER_PATTERNS)
OWNER_SQL = ", ".join(f"CASE WHEN length(trim(regexp_extract(t, {quoted(p)}, 1))) BETWEEN 3 AND 60 THEN trim(regexp_extract(t, {quoted(p)}, 1)) END" for p in LEGAL_PATTERNS)


@query(
    "X85_footer_ladder",
    f"""SELECT dump_id, coalesce(n, l) AS name, CASE WHEN n IS NOT NULL THEN 'puppeteer_footer_copyright' WHEN l IS NOT NULL THEN 'puppeteer_legal_disclaimer' ELSE 'puppeteer_failed' END AS method,
        CASE WHEN n IS NOT NULL THEN 85 WHEN l IS NOT NULL THEN 75 ELSE 0 END AS confidence FROM (SELECT dump_id, coalesce({VALID_SQL}) AS n, coalesce({OWNER_SQL}) AS l FROM (SELECT dump_id, {FOOTER_TEXT_SQL} AS t FROM {P} p) q) r""",
)
def footer_names(spark: SparkSession, sf: str) -> DataFrame:
    name, method, confidence = footer_ladder(F.col("html"))
    return DUMPS.read(spark, sf).select("dump_id", name.alias("name"), method.alias("method"), confidence.alias("confidence"))


ADDRESS = "struct<country:string,region:string,city:string,addressLines:array<string>,postalCode:string,language:string>"
ENTITY = f"struct<legalName:struct<name:string>,status:string,category:string,subCategory:string,legalForm:struct<id:string,name:string>,legalAddress:{ADDRESS},headquartersAddress:{ADDRESS},otherEntityNames:array<struct<name:string,type:string>>,associatedBIC:array<string>>"
REGISTRATION = "struct<status:string,initialRegistrationDate:string,nextRenewalDate:string,managingLOU:string>"
RECORD = f"attributes struct<lei:string,entity:{ENTITY},registration:{REGISTRATION},lastUpdateDate:string,successorEntity:struct<lei:string>>"


def full_record(raw: DataFrame) -> DataFrame:
    """Registry answers (column ``json``) as flat rows: names, status, both addresses, form, registration, BICs, successor. What a record lacks is an empty string, its status UNKNOWN and its
    category GENERAL; a record without an entity gives no row."""
    a = raw.select(F.from_json("json", RECORD).alias("r")).select("r.attributes.*").filter("entity IS NOT NULL")
    text = lambda path, default="": F.coalesce(F.col(path), F.lit(default))

    def address(name: str, prefix: str) -> list[Column]:
        lines = F.coalesce(F.array_join(f"entity.{name}.addressLines", ", "), F.lit(""))
        return [*[text(f"entity.{name}.{k}").alias(f"{prefix}_{n}") for k, n in (("country", "country"), ("region", "region"), ("city", "city"), ("postalCode", "postal_code"), ("language", "language"))], lines.alias(f"{prefix}_lines")]

    others = F.coalesce(F.array_join(F.transform("entity.otherEntityNames", lambda x: F.concat_ws(":", x["type"], x["name"])), "; "), F.lit(""))
    return a.select(
        text("lei").alias("lei_code"), text("entity.legalName.name").alias("legal_name"), text("entity.status", "UNKNOWN").alias("entity_status"), text("entity.legalAddress.country").alias("jurisdiction"),
        text("entity.legalForm.id").alias("legal_form"), text("entity.legalForm.name").alias("legal_form_name"), text("entity.category", "GENERAL").alias("category"), text("entity.subCategory").alias("sub_category"), text("registration.status", "UNKNOWN").alias("registration_status"),
        *address("headquartersAddress", "headquarters"), *address("legalAddress", "legal"), others.alias("other_names"), F.coalesce(F.array_join("entity.associatedBIC", ", "), F.lit("")).alias("bics"),
        text("registration.initialRegistrationDate").alias("registered"), text("registration.nextRenewalDate").alias("renewal"), text("registration.managingLOU").alias("authority"), text("lastUpdateDate").alias("updated"), text("successorEntity.lei").alias("successor"),
    )


EMPTY = "'' AS headquarters_language, '' AS legal_language, '' AS sub_category, '' AS renewal, '' AS updated, '' AS successor, '' AS headquarters_region, '' AS legal_form_name"


@query(
    "S9_full_record",
    f"""SELECT lei_code, legal_name, entity_status, jurisdiction, legal_form, coalesce(category, 'GENERAL') AS category, registration_status, country AS headquarters_country, coalesce(city, '') AS headquarters_city, 'Street 1, Floor 2' AS headquarters_lines, '' AS headquarters_postal_code,
        jurisdiction AS legal_country, 'R1' AS legal_region, coalesce(city, '') AS legal_city, cast(n AS VARCHAR) AS legal_postal_code, '' AS legal_lines, concat('TRADING:T', n) AS other_names, CASE WHEN n % 2 = 0 THEN concat('BIC', n, ', XBIC') ELSE '' END AS bics, '2020-01-01' AS registered, 'LOU1' AS authority, {EMPTY} FROM {E} e""",
)
def full_records(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    legal = F.struct(c("jurisdiction").alias("country"), F.lit("R1").alias("region"), "city", c("n").cast("string").alias("postalCode"))
    head = F.struct(c("country"), "city", F.array(F.lit("Street 1"), F.lit("Floor 2")).alias("addressLines"))
    others = F.array(F.struct(F.concat(F.lit("T"), c("n").cast("string")).alias("name"), F.lit("TRADING").alias("type")))
    bics = F.when(c("n") % 2 == 0, F.array(F.concat(F.lit("BIC"), c("n").cast("string")), F.lit("XBIC")))
    entity = F.struct(F.struct(c("legal_name").alias("name")).alias("legalName"), c("entity_status").alias("status"), "category", F.struct(c("legal_form").alias("id")).alias("legalForm"), legal.alias("legalAddress"), head.alias("headquartersAddress"), others.alias("otherEntityNames"), bics.alias("associatedBIC"))
    registration = F.struct(c("registration_status").alias("status"), F.lit("2020-01-01").alias("initialRegistrationDate"), F.lit("LOU1").alias("managingLOU"))
    raw = ENTITIES.read(spark, sf).select(F.to_json(F.struct(F.struct(c("lei_code").alias("lei"), entity.alias("entity"), registration.alias("registration")).alias("attributes"))).alias("json"))
    return full_record(raw)
