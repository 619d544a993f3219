"""Judgements on matches, names and answers: validation of a match, search patterns, confidences, classes of domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators.evidence import BORDER, TEXT_SQL, quoted, tagless
from tessera.operators.ladders import TITLE, flat, flat_sql
from tessera.operators.scoring import any_in, case, contains_any, listed, lookup
from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, DUMPS, ENTITIES

D, C, E, P = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql, DUMPS.sql
bordered = lambda pattern: pattern.replace(r"\b", BORDER)

# Patterns of legal entities by country.
LEGAL_ENTITIES = [
    r"\b[\w\s&-]+\s+GmbH\b", r"\b[\w\s&-]+\s+AG\b", r"\b[\w\s&-]+\s+KG\b", r"\b[\w\s&-]+\s+GmbH\s*&\s*Co\.?\s*KG\b", r"\b[\w\s&-]+\s+(?:Inc\.|Incorporated|Corp\.|Corporation|LLC|L\.L\.C\.)\b",
    r"\b[\w\s&-]+\s+(?:Ltd\.|Limited|PLC|P\.L\.C\.)\b", r"\b[\w\s&-]+\s+(?:B\.V\.|BV|N\.V\.|NV)\b", r"\b[\w\s&-]+\s+(?:S\.A\.|SA|S\.A\.S\.|SAS|SARL|S\.A\.R\.L\.)\b",
    r"\b[\w\s&-]+\s+(?:Pty Ltd|Pte Ltd|S\.p\.A\.|SpA|S\.L\.|SL)\b",
]


#: What no legal name can begin in: from a border on, the rest of a run that holds no ending behind it; before one, what stands between words.
PASSED = rf"|{BORDER}[\w\s&-]++|[\s&-]++"


def legal_entities(text: Column) -> Column:
    """The first ten distinct legal names of 4 to 99 characters, country by country. A run without an ending is passed as a whole, an empty find, so the steps grow with the text."""
    every = lambda p: F.filter(F.regexp_extract_all(text, F.lit(f"(?i)({bordered(p)}){PASSED}"), F.lit(1)), lambda x: x != "")
    found = F.concat(*[F.transform(every(p), lambda x: F.trim(x)) for p in LEGAL_ENTITIES])
    return F.slice(F.filter(F.array_distinct(found), lambda x: F.length(x).between(4, 99)), 1, 10)


@query(
    "X59_X76_legal_entities",
    f"""SELECT dump_id, array_to_string(list_slice(list_filter(l, lambda x, i: length(x) BETWEEN 4 AND 99 AND list_position(l, x) = i), 1, 10), '; ') AS entities
        FROM (SELECT dump_id, flatten([{', '.join(f"list_transform(regexp_extract_all(t, {quoted('(?i)' + p)}), lambda x: trim(x))" for p in LEGAL_ENTITIES)}]) AS l FROM (SELECT dump_id, {TEXT_SQL} AS t FROM {P} p) q) r""",
)
def page_legal_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = DUMPS.read(spark, sf).select("dump_id", tagless(F.col("html")).alias("t"))
    return rows.select("dump_id", F.array_join(legal_entities(F.col("t")), "; ").alias("entities"))


# Confidence of an answer.
ANSWER_SUFFIXES = ["Inc.", "Corp.", "Corporation", "Ltd.", "LLC", "GmbH", "S.A.", "AG"]


def answer_confidence(result: Column, domain: Column) -> Column:
    """50, 30 more with a legal ending, 20 more if the domain's label occurs; at most 100."""
    total = 50 + F.when(contains_any(result, ANSWER_SUFFIXES), 30).otherwise(0) + F.when(F.lower(result).contains(F.lower(F.split(domain, r"\.")[0])), 20).otherwise(0)
    return F.when(result.isNotNull(), F.least(F.lit(100), total))


def cited_confidence(name: Column, kind: Column, country: Column, sources: Column, citations: Column, said: Column) -> Column:
    """60 for a name, 15, 10 and 10 for its type, country and sources, 5 a citation up to 15; what the answer said of itself is a floor; 5 for its structure; at most 95."""
    total = 60 + F.when(kind.isNotNull(), 15).otherwise(0) + F.when(country.isNotNull(), 10).otherwise(0) + F.when(sources > 0, 10).otherwise(0) + F.least(citations * 5, F.lit(15))
    floor = F.when(F.lower(said) == "high", 90).when(F.lower(said) == "medium", 70).when(F.lower(said) == "low", 50).otherwise(0)
    return F.when(F.coalesce(name, F.lit("")) == "", 0).otherwise(F.least(F.lit(95), F.greatest(total, floor) + F.when(said.isNotNull(), 5).otherwise(0)))


SAID_SQL = "CASE WHEN confidence_score >= 70 THEN 'High' WHEN confidence_score >= 40 THEN 'medium' WHEN confidence_score IS NOT NULL THEN 'low' END"


@query(
    "X49_answer_confidences",
    f"""SELECT id, CASE WHEN company_name IS NOT NULL THEN least(100, 50 + CASE WHEN {any_in(ANSWER_SUFFIXES, 'company_name')} THEN 30 ELSE 0 END + CASE WHEN contains(lower(company_name), lower(list_extract(string_split(domain, '.'), 1))) THEN 20 ELSE 0 END) END AS result_confidence,
        CASE WHEN coalesce(company_name, '') = '' THEN 0 ELSE least(95, greatest(60 + CASE WHEN primary_lei_code IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN guessed_country IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN cands > 0 THEN 10 ELSE 0 END + least(cands * 5, 15),
          CASE lower(said) WHEN 'high' THEN 90 WHEN 'medium' THEN 70 WHEN 'low' THEN 50 ELSE 0 END) + CASE WHEN said IS NOT NULL THEN 5 ELSE 0 END) END AS cited_confidence
        FROM (SELECT *, coalesce(level2_candidates_count, 0) AS cands, {SAID_SQL} AS said FROM {D} d) x""",
)
def answer_confidences(spark: SparkSession, sf: str) -> DataFrame:
    """Both confidences of the stored answers; candidates count as citations, the stored score as what the answer said of itself."""
    c, n = F.col, F.coalesce("level2_candidates_count", F.lit(0))
    cited = cited_confidence(c("company_name"), c("primary_lei_code"), c("guessed_country"), n, n, F.expr(SAID_SQL))
    return DOMAINS.read(spark, sf).select("id", answer_confidence(c("company_name"), c("domain")).alias("result_confidence"), cited.cast("long").alias("cited_confidence"))


# Endings that search patterns leave out, in the order they are tried, and terms that make a name no entity.
PATTERN_SUFFIXES = ["Inc", "Inc.", "Incorporated", "Corp", "Corp.", "Corporation", "Ltd", "Ltd.", "Limited", "LLC", "L.L.C.", "LLP", "GmbH", "AG", "SE", "SA", "S.A.", "NV", "N.V.", "Pty", "Pty Ltd", "Pte Ltd", "Pvt Ltd", "Co", "Co."]
PATTERN_BARRED = ["manufacturers", "suppliers", "providers", "solutions", "services", "systems"]


def bare_name(name: Column) -> Column:
    for suffix in PATTERN_SUFFIXES:
        name = F.trim(F.regexp_replace(name, rf"(?i)\s+{suffix.replace('.', chr(92) + '.')}$", ""))
    return name


def bare_name_sql(name: str) -> str:
    for suffix in PATTERN_SUFFIXES:
        name = f"trim(regexp_replace({name}, '(?i)\\s+{suffix.replace('.', chr(92) + '.')}$', ''))"
    return name


def search_patterns(name: Column) -> Column:
    """Search patterns of a name, distinct and in order: itself, without its ending, its holding, international and global forms, its first word, and with a blank after leading capitals."""
    base = F.trim(name)
    bare = bare_name(base)
    apart = (bare != base) & (F.length(bare) > 2)
    words = F.split(base, r"\s+")
    first = F.when((F.size(words) > 1) & (F.length(words[0]) > 3) & (F.substring(words[0], 1, 1) == F.upper(F.substring(words[0], 1, 1))), words[0])
    spaced = F.regexp_replace(bare, "^([A-Z]+)([a-z])", "$1 $2")
    spaced = F.when(F.length(bare).between(4, 29) & bare.rlike("^[A-Z]{2}") & (spaced != bare), spaced)
    parts = F.array(base, F.when(apart, bare), *[F.when(apart, F.concat(bare, F.lit(x))) for x in (" Holdings", " International", " Global")], first, spaced)
    listed_ = F.transform(F.array_distinct(F.array_compact(parts)), lambda x: F.concat(x, F.lit("%")))
    return F.when(contains_any(F.lower(base), PATTERN_BARRED), F.array().cast("array<string>")).otherwise(listed_)


NAMES_SQL = f"(SELECT lei_code AS k, legal_name AS name FROM {E} e UNION ALL SELECT cast(id AS VARCHAR), company_name FROM {D} d WHERE company_name IS NOT NULL)"


@query(
    "X63_all_patterns",
    f"""SELECT k, CASE WHEN {any_in(PATTERN_BARRED, 'lower(base)')} THEN '' ELSE array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: concat(x, '%')), '; ') END AS patterns
        FROM (SELECT k, base, list_filter([base, CASE WHEN apart THEN bare END, CASE WHEN apart THEN concat(bare, ' Holdings') END, CASE WHEN apart THEN concat(bare, ' International') END, CASE WHEN apart THEN concat(bare, ' Global') END,
          CASE WHEN len(words) > 1 AND length(words[1]) > 3 AND substr(words[1], 1, 1) = upper(substr(words[1], 1, 1)) THEN words[1] END,
          CASE WHEN length(bare) BETWEEN 4 AND 29 AND regexp_matches(bare, '^[A-Z]{{2}}') AND regexp_replace(bare, '^([A-Z]+)([a-z])', '\\1 \\2') <> bare THEN regexp_replace(bare, '^([A-Z]+)([a-z])', '\\1 \\2') END], lambda x: x IS NOT NULL) AS l
          FROM (SELECT *, bare <> base AND length(bare) > 2 AS apart, regexp_split_to_array(base, '\\s+') AS words FROM (SELECT k, trim(name) AS base, {bare_name_sql('trim(name)')} AS bare FROM {NAMES_SQL} n) a) b) c""",
)
def all_patterns(spark: SparkSession, sf: str) -> DataFrame:
    entities = ENTITIES.read(spark, sf).select(F.col("lei_code").alias("k"), F.col("legal_name").alias("name"))
    domains = DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select(F.col("id").cast("string").alias("k"), F.col("company_name").alias("name"))
    return entities.unionAll(domains).select("k", F.array_join(search_patterns(F.col("name")), "; ").alias("patterns"))


# Legal forms by code.
FORM_TYPES = {
    "PJ10": "Corporation", "8888": "Corporation", "C3VN": "Limited Liability Company", "TXGZ": "Public Limited Company", "5WWO": "Foundation", "PRIV": "Private Foundation", "OTHR": "Other Entity Type",
    "549300": "Corporation", "LTD": "Limited Company", "INC": "Incorporated Company", "LLC": "Limited Liability Company", "PLC": "Public Limited Company",
}


def form_type(code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("")) == "", "Unknown Legal Form").otherwise(F.coalesce(lookup(FORM_TYPES, code), F.concat(F.lit("Legal Form: "), code)))


@query("X71_form_types", f"SELECT lei_code, CASE WHEN coalesce(legal_form, '') = '' THEN 'Unknown Legal Form' ELSE coalesce({case(FORM_TYPES, 'legal_form')}, concat('Legal Form: ', legal_form)) END AS kind FROM {E} e")
def form_types(spark: SparkSession, sf: str) -> DataFrame:
    return ENTITIES.read(spark, sf).select("lei_code", form_type(F.col("legal_form")).alias("kind"))


def accessibility(category: Column) -> Column:
    """How a site's failure bars it; the words are case-sensitive, as in the application."""
    holds = lambda w: F.coalesce(category.contains(w), F.lit(False))
    return F.when(holds("cloudflare") | holds("protected"), "Cloudflare").when(holds("bot"), "Bot-Detection").when(holds("unreachable"), "Unreachable").when(holds("Protected"), "Protected").otherwise("Open")


@query(
    "X36_accessibility",
    f"""SELECT id, CASE WHEN coalesce(contains(failure_category, 'cloudflare') OR contains(failure_category, 'protected'), false) THEN 'Cloudflare' WHEN coalesce(contains(failure_category, 'bot'), false) THEN 'Bot-Detection'
        WHEN coalesce(contains(failure_category, 'unreachable'), false) THEN 'Unreachable' WHEN coalesce(contains(failure_category, 'Protected'), false) THEN 'Protected' ELSE 'Open' END AS accessibility FROM {D} d""",
)
def site_accessibility(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).select("id", accessibility(F.col("failure_category")).alias("accessibility"))


def verified_category(status: Column, score: Column, review: Column, before: Column) -> Column:
    named = F.when((status == "ACTIVE") & (score >= 85), "GLEIF Verified - High Priority").when((status == "ACTIVE") & (score >= 70), "GLEIF Matched - Good Target").when(status == "INACTIVE", "GLEIF Historical - Research Required")
    return named.when(review, "GLEIF Multiple - Manual Review").otherwise(F.coalesce(before, F.lit("Level 1 Only - Manual Review")))


@query(
    "X37_verified_category",
    f"""SELECT d.id, CASE WHEN entity_status = 'ACTIVE' AND weighted_score >= 85 THEN 'GLEIF Verified - High Priority' WHEN entity_status = 'ACTIVE' AND weighted_score >= 70 THEN 'GLEIF Matched - Good Target' WHEN entity_status = 'INACTIVE' THEN 'GLEIF Historical - Research Required'
        WHEN manual_review_required THEN 'GLEIF Multiple - Manual Review' ELSE coalesce(failure_category, 'Level 1 Only - Manual Review') END AS category
        FROM {D} d JOIN (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY weighted_score DESC, lei_code, tie1, tie3) AS rn FROM {C} x) c ON d.id = c.domain_id WHERE rn = 1""",
)
def verified_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The business category after the registry was asked, by the best candidate."""
    w = Window.partitionBy("domain_id").orderBy(F.desc("weighted_score"), "lei_code", "tie1", "tie3")
    best = CANDIDATES.read(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("domain_id", "entity_status", "weighted_score")
    rows = DOMAINS.read(spark, sf).join(best, F.col("id") == F.col("domain_id"))
    return rows.select("id", verified_category(F.col("entity_status"), F.col("weighted_score"), F.col("manual_review_required"), F.col("failure_category")).alias("category"))


# Confidence of titles.
FOR_PROFIT = r"\b(Inc\.?|LLC|Corp\.?|Corporation|Ltd\.?|Limited|Company|Co\.?|PVT\.?\s+LTD\.?|Pvt\.?\s+Ltd\.?)\b"
INSTITUTION = r"\b(University|College|Institute|Foundation|School|Hospital|Medical|Center|Association|Society|Department|Agency|Bureau|Commission)\b"
PRAISE = r"\b(leader|world|global|best|top|premier|innovative|solutions|services|products|empowering|engineered|monitoring|collaboration|enhancing|leading|cloud|enterprise|security|provider|software|platform|intelligence|artificial|continuous|glucose|game|publisher|source|information|insurance|risk|objectively|better|way|advertise)\b"
NAVIGATION = r"\b(home\s+page|homepage|search|selector|icon|pause|play|next|previous|strategy|collection|teamwork)\b"
TAGLINES = ["—", "as a Service", "for Zero Trust"]


def title_confidence(name: Column) -> Column:
    has = lambda p: name.rlike("(?i)" + bordered(p))
    kind = F.when(has(INSTITUTION), 85).when(has(FOR_PROFIT), 95).otherwise(30)
    return F.when(~F.length(name).between(3, 100), 10).when(has(PRAISE), 10).when(has(NAVIGATION), 5).when(contains_any(name, TAGLINES), 10).otherwise(kind)


@query(
    "X77_title_confidence",
    f"""SELECT dump_id, name, CASE WHEN length(name) NOT BETWEEN 3 AND 100 THEN 10 WHEN regexp_matches(name, {quoted('(?i)' + PRAISE)}) THEN 10 WHEN regexp_matches(name, {quoted('(?i)' + NAVIGATION)}) THEN 5 WHEN {any_in(TAGLINES, 'name')} THEN 10
        WHEN regexp_matches(name, {quoted('(?i)' + INSTITUTION)}) THEN 85 WHEN regexp_matches(name, {quoted('(?i)' + FOR_PROFIT)}) THEN 95 ELSE 30 END AS confidence FROM (SELECT dump_id, {flat_sql(f'regexp_extract(html, {quoted(TITLE)}, 1)')} AS name FROM {P} p) q""",
)
def title_confidences(spark: SparkSession, sf: str) -> DataFrame:
    rows = DUMPS.read(spark, sf).select("dump_id", flat(F.regexp_extract("html", TITLE, 1)).alias("name"))
    return rows.select("dump_id", "name", title_confidence(F.col("name")).alias("confidence"))


# Validation of a match.
GENERIC_TERMS = ["corporate", "company", "business", "enterprise", "group", "holdings", "ltd", "inc", "llc"]
DOMAIN_ENDING, COMMON_TERMS = r"\.(com|org|net|edu|gov|co|ltd|inc)$", ["www", "corp", "group"]
EXPECTED_PLACE = {"de": "DE", "fr": "FR", "jp": "JP", "au": "AU", "ca": "CA", "in": "IN", "cn": "CN", "br": "BR"}
UNFIT = ["FUND", "TRUST", "NONPROFIT", "GOVERNMENT"]
COMPANY_PARTS = ["corporation", "corp", "incorporated", "inc", "company", "co", "limited", "ltd", "llc", "plc", "gmbh", "sa", "ag", "nv", "bv"]


def match_confidence(legal_name: Column, jurisdiction: Column, category: Column, domain: Column, term: Column) -> Column:
    """100, less 30 for a generic term, 40 without a term of the domain in the name, 20 for another country, 15 for an unfit type, plus up to 50 for the name; 10 for a generic term without
    correlation; 0 to 100."""
    name, asked = F.lower(legal_name), F.lower(term)
    terms = F.filter(F.split(F.regexp_replace(F.lower(domain), DOMAIN_ENDING, ""), "[.-]"), lambda x: (F.length(x) > 2) & ~x.isin(COMMON_TERMS))
    related = (F.size(terms) == 0) | F.exists(terms, lambda x: name.contains(x) | (names.similarity(x, name) > 0.7))
    place = lookup(EXPECTED_PLACE, names.top_level(domain))
    generic = asked.isin(GENERIC_TERMS)
    named = F.when(name.contains(asked), 40).otherwise(0) + names.similarity(asked, name) * 30 - F.when((F.length(asked) <= 3) & ~name.startswith(asked), 20).otherwise(0) + F.when(contains_any(name, COMPANY_PARTS), 10).otherwise(0)
    total = 100 - F.when(generic, 30).otherwise(0) - F.when(~related, 40).otherwise(0) - F.when(place.isNotNull() & ~F.coalesce(jurisdiction == place, F.lit(False)), 20).otherwise(0)
    total = total - F.when(F.coalesce(category.isin(UNFIT), F.lit(False)), 15).otherwise(0) + F.greatest(F.lit(0.0), F.least(F.lit(50.0), named))
    return F.when(generic & ~related, 10.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))


SIMILAR = lambda a, b: f"(1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})))"


@query(
    "X30_full_validation",
    f"""SELECT domain_id, lei_code, tie1, tie3, confidence, confidence >= 30 AS valid FROM (SELECT *, CASE WHEN generic AND NOT related THEN 10.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 - CASE WHEN generic THEN 30 ELSE 0 END - CASE WHEN NOT related THEN 40 ELSE 0 END
          - CASE WHEN place IS NOT NULL AND NOT coalesce(jurisdiction = place, false) THEN 20 ELSE 0 END - CASE WHEN coalesce(category IN ({listed(UNFIT)}), false) THEN 15 ELSE 0 END
          + greatest(0.0::DOUBLE, least(50.0::DOUBLE, CASE WHEN contains(name, asked) THEN 40 ELSE 0 END + {SIMILAR('asked', 'name')} * 30 - CASE WHEN length(asked) <= 3 AND NOT starts_with(name, asked) THEN 20 ELSE 0 END + CASE WHEN {any_in(COMPANY_PARTS, 'name')} THEN 10 ELSE 0 END)))) END AS confidence
        FROM (SELECT *, asked IN ({listed(GENERIC_TERMS)}) AS generic, len(terms) = 0 OR len(list_filter(terms, lambda x: contains(name, x) OR {SIMILAR('x', 'name')} > 0.7)) > 0 AS related
          FROM (SELECT c.domain_id, c.lei_code, c.tie1, c.tie3, c.jurisdiction, e.category, lower(c.legal_name) AS name, lower(d.company_name) AS asked, {case(EXPECTED_PLACE, "list_extract(string_split(lower(d.domain), '.'), -1)")} AS place,
            list_filter(regexp_split_to_array(regexp_replace(lower(d.domain), {quoted(DOMAIN_ENDING)}, ''), '[.-]'), lambda x: length(x) > 2 AND x NOT IN ({listed(COMMON_TERMS)})) AS terms
            FROM {C} c JOIN {D} d ON c.domain_id = d.id LEFT JOIN {E} e ON c.lei_code = e.lei_code WHERE d.company_name IS NOT NULL) a) b) v""",
)
def full_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate of a named domain against that domain, its country and its name."""
    c = F.col
    domains = DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select(c("id").alias("domain_id"), "domain", "company_name")
    kinds = ENTITIES.read(spark, sf).select("lei_code", "category")
    rows = CANDIDATES.read(spark, sf).join(domains, "domain_id").join(kinds, "lei_code", "left")
    confidence = match_confidence(c("legal_name"), c("jurisdiction"), c("category"), c("domain"), c("company_name"))
    return rows.select("domain_id", "lei_code", "tie1", "tie3", confidence.alias("confidence")).withColumn("valid", c("confidence") >= 30)


# Named entities of a text.
NER = [
    r"(?i)©.*?(\d{4}).*?([A-Z][A-Za-z\s&,.'-]+?(?:Inc\.?|Corp\.?|Corporation|Ltd\.?|Limited|LLC|Company|Co\.?))",
    r"(?i)Copyright.*?(\d{4}).*?([A-Z][A-Za-z\s&,.'-]+?(?:Inc\.?|Corp\.?|Corporation|Ltd\.?|Limited|LLC|Company|Co\.?))",
    r"\b([A-Z][A-Za-z\s&,.'-]+?(?:Inc\.?|Corp\.?|Corporation|Ltd\.?|Limited|LLC|Company|Co\.?))\b",
    r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]*)*(?:\s+&\s+[A-Z][a-z]+)*)\s+(?:Inc\.?|Corp\.?|Corporation|Ltd\.?|Limited|LLC|Company|Co\.?)",
]
#: The same matches for the JVM, in steps that grow with the text. Behind a sign the first year is as good as any, and of a run of letters only the first one needs a try: what fails there
#: fails further on. Where a sign or a letter finds no ending, the line or the run is passed as a whole, with an empty entity.
_NAME = r"[A-Za-z\s&,.'-]"
_FIRST = r"(?<![A-Za-z][\s&,.'-]{0,20})"
NER_JVM = [
    NER[0].replace(r".*?(\d{4}).*?(", rf"(?:(?>.*?(\d{{4}})).*?{_FIRST}(") + "|.*+)",
    NER[1].replace(r".*?(\d{4}).*?(", rf"(?:(?>.*?(\d{{4}})).*?{_FIRST}(") + "|.*+)",
    NER[2] + rf"|\b[A-Z]{_NAME}*+",
    NER[3],
]
NER_GROUPS = [2, 2, 1, 1]
NER_SUFFIX, NER_GENERIC = r"(?i)\b(?:Inc\.?|Corp\.?|Corporation|Ltd\.?|Limited|LLC|Company)\b", r"(?i)\b(?:All Rights Reserved|Privacy Policy|Terms|Conditions)\b"


def ner_confidence(entity: Column, match: Column) -> Column:
    """0.5, 0.2 more for an ending, 0.15 in a copyright line, 0.1 for two to five words, 0.3 less for a generic term; 0.1 to 0.95."""
    add = lambda test, worth: F.when(test, worth).otherwise(0.0)
    total = 0.5 + add(entity.rlike(bordered(NER_SUFFIX)), 0.2) + add(match.rlike("(?i)©|Copyright"), 0.15) + add(names.word_count(entity).between(2, 5), 0.1) - add(entity.rlike(bordered(NER_GENERIC)), 0.3)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.1), total))


def ner_sql(entity: str, match: str) -> str:
    add = lambda test, worth: f"CASE WHEN {test} THEN {worth}::DOUBLE ELSE 0.0::DOUBLE END"
    words = f"len(regexp_split_to_array({entity}, '\\s+'))"
    return f"least(0.95::DOUBLE, greatest(0.1::DOUBLE, 0.5::DOUBLE + {add(f'regexp_matches({entity}, {quoted(NER_SUFFIX)})', 0.2)} + {add(f"regexp_matches({match}, '(?i)©|Copyright')", 0.15)} + {add(f'{words} BETWEEN 2 AND 5', 0.1)} - {add(f'regexp_matches({entity}, {quoted(NER_GENERIC)})', 0.3)}))"


NER_LISTS_SQL = ", ".join(
    f"list_transform(regexp_extract_all(t, {quoted(p)}), lambda m, i: {{'pattern': {n + 1}, 'entity': trim(list_extract(regexp_extract_all(t, {quoted(p)}, {g}), i)), 'match': m}})" for n, (p, g) in enumerate(zip(NER, NER_GROUPS, strict=True))
)


@query("X89_text_entities", f"SELECT dump_id, x.pattern AS pattern, x.entity AS entity, max({ner_sql('x.entity', 'x.match')}) AS confidence FROM (SELECT dump_id, unnest(list_concat({NER_LISTS_SQL})) AS x FROM (SELECT dump_id, {TEXT_SQL} AS t FROM {P} p) q) r WHERE length(x.entity) BETWEEN 4 AND 99 GROUP BY 1, 2, 3")
def text_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Named entities of a page's text by each pattern, with the best confidence of their matches."""
    rows = DUMPS.read(spark, sf).select("dump_id", tagless(F.col("html")).alias("t"))
    every = lambda p, g: F.regexp_extract_all("t", F.lit(bordered(p)), F.lit(g))
    lists = [_tagged(every(p, g), every(p, 0), n) for n, (p, g) in enumerate(zip(NER_JVM, NER_GROUPS, strict=True), 1)]
    found = rows.select("dump_id", F.explode(F.concat(*lists)).alias("x")).filter(F.length("x.entity").between(4, 99))
    return found.groupBy("dump_id", F.col("x.pattern").alias("pattern"), F.col("x.entity").alias("entity")).agg(F.max(ner_confidence(F.col("x.entity"), F.col("x.match"))).alias("confidence"))


def _tagged(found: Column, matches: Column, pattern: int) -> Column:
    return F.transform(F.arrays_zip(found.alias("entity"), matches.alias("match")), lambda x: F.struct(F.lit(pattern).alias("pattern"), F.trim(x["entity"]).alias("entity"), x["match"].alias("match")))
