"""Scores of domains, names and registry candidates. Definitions that contradict each other stay apart, as named variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions.compat import js_round
from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, ENTITIES

D, C, E = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql

# Top-level domains and the countries they stand for; and those that stand for a country only by custom.
TLD_COUNTRY = {
    "us": "US", "uk": "GB", "de": "DE", "fr": "FR", "it": "IT", "es": "ES", "nl": "NL", "be": "BE", "ch": "CH", "at": "AT", "jp": "JP", "cn": "CN", "kr": "KR", "in": "IN", "br": "BR",
    "mx": "MX", "ca": "CA", "au": "AU", "nz": "NZ", "za": "ZA", "sg": "SG", "hk": "HK", "tw": "TW", "my": "MY", "id": "ID", "th": "TH", "vn": "VN", "ph": "PH", "ru": "RU", "pl": "PL",
    "se": "SE", "no": "NO", "dk": "DK", "fi": "FI", "ie": "IE", "pt": "PT", "gr": "GR", "cz": "CZ", "hu": "HU", "ro": "RO", "bg": "BG", "hr": "HR", "si": "SI", "sk": "SK", "lt": "LT",
    "lv": "LV", "ee": "EE", "il": "IL", "ae": "AE", "sa": "SA", "eg": "EG", "ng": "NG", "ke": "KE", "ma": "MA", "tn": "TN", "tr": "TR", "pk": "PK", "bd": "BD", "lk": "LK",
}
TLD_CUSTOM = {"com": "US", "net": "US", "org": "US"}
# Jurisdictions by what a .com domain of theirs is worth.
COM_MAJOR, COM_OTHER = ["CA", "GB", "DE", "FR", "JP", "AU", "NL", "CH"], ["IT", "ES", "SE", "NO", "DK", "FI", "BE", "AT", "IE"]
# Substrings of names that count as signs of a large company.
LARGE = ["inc", "corporation", "corp", "company", "co", "ltd", "limited", "sa", "se", "ag", "gmbh", "spa", "srl", "bv", "nv"]
BRANDS = ["apple", "microsoft", "amazon", "google", "walmart", "exxon", "berkshire", "unitedhealth", "johnson", "jpmorgan", "visa"]
# Base confidence of extraction methods, and what changes it.
BASE_CONFIDENCE = {"structured_data": 70, "meta_property": 65, "footer_copyright": 75, "html_title": 55, "domain_parse": 30}
SUFFIX_BONUS, NO_SUFFIX, MARKETING_PENALTY, WORDS_BONUS = 20, -40, -30, 15
# Weights of the candidate score.
NAME, LARGE_WEIGHT, TLD, COMPLEXITY = 0.4, 0.25, 0.2, 0.15

case = lambda mapping, key: "CASE " + key + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"
listed = lambda values: ", ".join(f"'{v}'" for v in values)
any_in = lambda values, text: " OR ".join(f"contains({text}, '{v}')" for v in values)
lookup = lambda mapping, key: F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def contains_any(text: Column, values: list[str]) -> Column:
    test = F.lit(False)
    for v in values:
        test = test | text.contains(v)
    return test


def tld_score_v1(domain: Column, jurisdiction: Column) -> Column:
    """Country domains must match; .com favours large economies."""
    tld = names.top_level(domain)
    com = F.when(jurisdiction == "US", 85).when(jurisdiction.isin(COM_MAJOR), 75).when(jurisdiction.isin(COM_OTHER), 60).otherwise(30)
    return F.when(lookup(TLD_COUNTRY, tld) == jurisdiction, 100).when(tld == "com", com).when(tld.isin("org", "net"), F.when(jurisdiction == "US", 70).otherwise(50)).when(F.length(tld) == 2, 10).otherwise(25)


TLD_SQL = "list_extract(string_split(lower(domain), '.'), -1)"
TLD_V1_SQL = f"""CASE WHEN {case(TLD_COUNTRY, TLD_SQL)} = jurisdiction THEN 100 WHEN {TLD_SQL} = 'com' THEN CASE WHEN jurisdiction = 'US' THEN 85 WHEN jurisdiction IN ({listed(COM_MAJOR)}) THEN 75 WHEN jurisdiction IN ({listed(COM_OTHER)}) THEN 60 ELSE 30 END
  WHEN {TLD_SQL} IN ('org', 'net') THEN CASE WHEN jurisdiction = 'US' THEN 70 ELSE 50 END WHEN length({TLD_SQL}) = 2 THEN 10 ELSE 25 END"""


def tld_score_v2(domain: Column, jurisdiction: Column) -> Column:
    expected = lookup(TLD_COUNTRY | TLD_CUSTOM, names.top_level(domain))
    return F.when(expected.isNull(), 50).when(expected == jurisdiction, 100).otherwise(20)


TLD_V2_SQL = f"CASE WHEN {case(TLD_COUNTRY | TLD_CUSTOM, TLD_SQL)} IS NULL THEN 50 WHEN {case(TLD_COUNTRY | TLD_CUSTOM, TLD_SQL)} = jurisdiction THEN 100 ELSE 20 END"


def large_score_v1(name: Column, status: Column) -> Column:
    sign, active = contains_any(F.lower(name), LARGE), status == "ACTIVE"
    return F.when(sign & active, 100).when(sign, 75).when(active, 50).otherwise(25)


LARGE_V1_SQL = f"CASE WHEN ({any_in(LARGE, 'lower(legal_name)')}) AND entity_status = 'ACTIVE' THEN 100 WHEN {any_in(LARGE, 'lower(legal_name)')} THEN 75 WHEN entity_status = 'ACTIVE' THEN 50 ELSE 25 END"


def name_score_v1(legal: Column, company: Column) -> Column:
    """Equal, contained, shared words, or hardly anything. Repeated words count as often as they stand in the legal name."""
    a, b = F.lower(legal), F.lower(company)
    wa, wb = F.split(a, r"\s+"), F.split(b, r"\s+")
    shared = F.size(F.filter(wa, lambda w: F.array_contains(wb, w)))
    overlap = js_round(shared / F.greatest(F.size(wa), F.size(wb)) * 80)
    return F.when(F.coalesce(company, F.lit("")) == "", 0).when(a == b, 100).when(a.contains(b) | b.contains(a), 85).when(shared > 0, overlap).otherwise(10).cast("long")


WA, WB = "regexp_split_to_array(lower(legal_name), '\\s+')", "regexp_split_to_array(lower(company_name), '\\s+')"
SHARED = f"len(list_filter({WA}, lambda w: list_contains({WB}, w)))"
NAME_V1_SQL = f"""CASE WHEN coalesce(company_name, '') = '' THEN 0 WHEN lower(legal_name) = lower(company_name) THEN 100 WHEN contains(lower(legal_name), lower(company_name)) OR contains(lower(company_name), lower(legal_name)) THEN 85
  WHEN {SHARED} > 0 THEN cast(floor({SHARED}::DOUBLE / greatest(len({WA}), len({WB})) * 80 + 0.5) AS BIGINT) ELSE 10 END"""


def name_score_v2(legal: Column, company: Column) -> Column:
    a, b = F.lower(legal), F.lower(company)
    return F.when(a == b, 100).when(a.contains(b) | b.contains(a), 80).otherwise(js_round(names.similarity(a, b) * 100)).cast("long")


def complexity_v1(row_status: Column, registration: Column, domain: Column, form: Column, city: Column) -> Column:
    commercial = domain.endswith(".com") | domain.endswith(".biz")
    score = (
        F.lit(50)
        + F.when(row_status == "ACTIVE", 25).otherwise(0)
        + F.when(registration == "ISSUED", 15).when((registration == "LAPSED") & (row_status == "ACTIVE"), 5).otherwise(0)
        + F.when(commercial & form.isin("PJ10", "8888", "C3VN", "TXGZ"), 15).when(commercial & form.isin("5WWO", "PRIV"), -10).otherwise(0)
        + F.when(city.isNotNull(), 10).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


COMPLEXITY_SQL = """greatest(0, least(100, 50 + CASE WHEN entity_status = 'ACTIVE' THEN 25 ELSE 0 END + CASE WHEN registration_status = 'ISSUED' THEN 15 WHEN registration_status = 'LAPSED' AND entity_status = 'ACTIVE' THEN 5 ELSE 0 END
  + CASE WHEN (domain LIKE '%.com' OR domain LIKE '%.biz') AND legal_form IN ('PJ10', '8888', 'C3VN', 'TXGZ') THEN 15 WHEN (domain LIKE '%.com' OR domain LIKE '%.biz') AND legal_form IN ('5WWO', 'PRIV') THEN -10 ELSE 0 END + CASE WHEN city IS NOT NULL THEN 10 ELSE 0 END))"""


def reasons(name: Column, large: Column, tld: Column, complexity: Column) -> Column:
    parts = F.array_compact(F.array(F.when(name >= 85, "Strong name match"), F.when(large >= 75, "Fortune 500 indicators"), F.when(tld >= 75, "Jurisdiction alignment"), F.when(complexity >= 75, "Complete entity profile")))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("Basic entity match")


PAIRS_SQL = f"(SELECT c.*, d.domain, d.company_name FROM {C} c JOIN {D} d ON c.domain_id = d.id)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return CANDIDATES.read(spark, sf).join(DOMAINS.read(spark, sf).select(F.col("id").alias("domain_id"), "domain", "company_name"), "domain_id")


SCORED_SQL = f"(SELECT domain_id, lei_code, tie1, tie3, {NAME_V1_SQL} AS name_score, {LARGE_V1_SQL} AS large_score, {TLD_V1_SQL} AS tld_score, {COMPLEXITY_SQL} AS complexity_score FROM {PAIRS_SQL} p)"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return pairs(spark, sf).select("domain_id", "lei_code", "tie1", "tie3", name_score_v1(c("legal_name"), c("company_name")).alias("name_score"), large_score_v1(c("legal_name"), c("entity_status")).alias("large_score"), tld_score_v1(c("domain"), c("jurisdiction")).alias("tld_score"), complexity_v1(c("entity_status"), c("registration_status"), c("domain"), c("legal_form"), c("city")).alias("complexity_score"))


@query(
    "X18_X23_X25_X26_X27_X28_weighted",
    f"""SELECT *, cast(floor(name_score * {NAME}::DOUBLE + large_score * {LARGE_WEIGHT}::DOUBLE + tld_score * {TLD}::DOUBLE + complexity_score * {COMPLEXITY}::DOUBLE + 0.5) AS BIGINT) AS total,
        CASE WHEN name_score < 85 AND large_score < 75 AND tld_score < 75 AND complexity_score < 75 THEN 'Basic entity match' ELSE array_to_string(list_filter([CASE WHEN name_score >= 85 THEN 'Strong name match' END, CASE WHEN large_score >= 75 THEN 'Fortune 500 indicators' END,
          CASE WHEN tld_score >= 75 THEN 'Jurisdiction alignment' END, CASE WHEN complexity_score >= 75 THEN 'Complete entity profile' END], lambda x: x IS NOT NULL), ', ') END AS reason FROM {SCORED_SQL} s""",
)
def weighted(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    total = js_round(c("name_score") * NAME + c("large_score") * LARGE_WEIGHT + c("tld_score") * TLD + c("complexity_score") * COMPLEXITY).cast("long")
    return scored(spark, sf).select("*", total.alias("total"), reasons(c("name_score"), c("large_score"), c("tld_score"), c("complexity_score")).alias("reason"))


@query("X19_X21_name_similarity", f"SELECT domain_id, lei_code, tie1, tie3, CASE WHEN lower(legal_name) = lower(company_name) THEN 100 WHEN contains(lower(legal_name), lower(company_name)) OR contains(lower(company_name), lower(legal_name)) THEN 80 ELSE cast(floor((1 - levenshtein(lower(legal_name), lower(company_name))::DOUBLE / greatest(length(legal_name), length(company_name))) * 100 + 0.5) AS BIGINT) END AS score FROM {PAIRS_SQL} p WHERE company_name IS NOT NULL")
def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).filter("company_name IS NOT NULL").select("domain_id", "lei_code", "tie1", "tie3", name_score_v2(F.col("legal_name"), F.col("company_name")).alias("score"))


@query("X24_tld_v2", f"SELECT domain_id, lei_code, tie1, tie3, {TLD_V2_SQL} AS score FROM {PAIRS_SQL} p")
def tld_v2(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("domain_id", "lei_code", "tie1", "tie3", tld_score_v2(F.col("domain"), F.col("jurisdiction")).alias("score"))


@query("X25_brands_v2", f"SELECT lei_code, CASE WHEN {any_in(BRANDS, 'lower(legal_name)')} THEN 100 ELSE 0 END AS score FROM {E} e")
def brands(spark: SparkSession, sf: str) -> DataFrame:
    return ENTITIES.read(spark, sf).select("lei_code", F.when(contains_any(F.lower("legal_name"), BRANDS), 100).otherwise(0).alias("score"))


@query(
    "X29_entity_score_v3",
    f"""SELECT domain_id, lei_code, tie1, tie3, floor(({NAME_V1_SQL} * 0.4::DOUBLE + CASE WHEN entity_status = 'ACTIVE' THEN 25 ELSE 10 END + CASE registration_status WHEN 'ISSUED' THEN 20 WHEN 'LAPSED' THEN 15 ELSE 10 END + CASE WHEN city IS NOT NULL THEN 10 ELSE 0 END) + 0.5) AS score FROM {PAIRS_SQL} p""",
)
def entity_score_v3(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("entity_status") == "ACTIVE", 25).otherwise(10)
    registration = F.when(F.col("registration_status") == "ISSUED", 20).when(F.col("registration_status") == "LAPSED", 15).otherwise(10)
    total = name_score_v1(F.col("legal_name"), F.col("company_name")) * 0.4 + status + registration + F.when(F.col("city").isNotNull(), 10).otherwise(0)
    return pairs(spark, sf).select("domain_id", "lei_code", "tie1", "tie3", js_round(total).cast("double").alias("score"))


@query(
    "X30_match_validation",
    f"""SELECT domain_id, lei_code, tie1, tie3, greatest(0, least(100, 100 - CASE WHEN contains(lower(legal_name), 'holding') THEN 30 ELSE 0 END - CASE WHEN {SHARED} = 0 THEN 40 ELSE 0 END - CASE WHEN {TLD_V2_SQL} = 20 THEN 20 ELSE 0 END - CASE WHEN legal_form = '5WWO' THEN 15 ELSE 0 END)) AS score
        FROM {PAIRS_SQL} p WHERE company_name IS NOT NULL""",
)
def match_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Deductions for a generic name, no word in common, a foreign top level, and an unlikely form."""
    wa, wb = F.split(F.lower("legal_name"), r"\s+"), F.split(F.lower("company_name"), r"\s+")
    none = F.size(F.filter(wa, lambda w: F.array_contains(wb, w))) == 0
    score = 100 - F.when(F.lower("legal_name").contains("holding"), 30).otherwise(0) - F.when(none, 40).otherwise(0) - F.when(tld_score_v2(F.col("domain"), F.col("jurisdiction")) == 20, 20).otherwise(0) - F.when(F.col("legal_form") == "5WWO", 15).otherwise(0)
    return pairs(spark, sf).filter("company_name IS NOT NULL").select("domain_id", "lei_code", "tie1", "tie3", F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"))


@query(
    "X31_mapping_confidence",
    f"""SELECT domain_id, lei_code, tie1, tie3, least(100, 50 + CASE WHEN rank_position = 1 THEN 20 ELSE 0 END + CASE WHEN {NAME_V1_SQL} >= 85 THEN 20 WHEN {NAME_V1_SQL} >= 50 THEN 10 ELSE 0 END + CASE WHEN entity_status = 'ACTIVE' THEN 10 ELSE 0 END) AS confidence FROM {PAIRS_SQL} p""",
)
def mapping_confidence(spark: SparkSession, sf: str) -> DataFrame:
    name = name_score_v1(F.col("legal_name"), F.col("company_name"))
    total = F.lit(50) + F.when(F.col("rank_position") == 1, 20).otherwise(0) + F.when(name >= 85, 20).when(name >= 50, 10).otherwise(0) + F.when(F.col("entity_status") == "ACTIVE", 10).otherwise(0)
    return pairs(spark, sf).select("domain_id", "lei_code", "tie1", "tie3", F.least(F.lit(100), total).alias("confidence"))


SUFFIX_SQL = f"coalesce(list_extract(regexp_split_to_array(lower(regexp_replace(trim(company_name), '[.,]', '', 'g')), '\\s+'), -1) IN ({listed(names.LEGAL_SUFFIXES)}), false)"
MARKETING_SQL = f"coalesce({any_in(names.MARKETING, 'lower(company_name)')}, false)"
WORDS_SQL = "len(regexp_split_to_array(trim(company_name), '\\s+'))"


@query(
    "X15_X16_confidence",
    f"""SELECT id, {SUFFIX_SQL} AS has_suffix, greatest(0, least(100, CASE extraction_method {' '.join(f"WHEN '{k}' THEN {v}" for k, v in BASE_CONFIDENCE.items())} ELSE 50 END + CASE WHEN {SUFFIX_SQL} THEN {SUFFIX_BONUS} ELSE {NO_SUFFIX} END + CASE WHEN {MARKETING_SQL} THEN {MARKETING_PENALTY} ELSE 0 END
        + CASE WHEN {WORDS_SQL} BETWEEN 2 AND 4 THEN {WORDS_BONUS} ELSE 0 END)) AS confidence FROM {D} d WHERE company_name IS NOT NULL""",
)
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("company_name")
    return DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select("id", names.has_suffix(name).alias("has_suffix"), extraction_confidence(F.col("extraction_method"), names.has_suffix(name), names.is_marketing(name), names.word_count(name)).alias("confidence"))


def extraction_confidence(method: Column, suffix: Column, marketing: Column, words: Column) -> Column:
    base = F.coalesce(lookup(BASE_CONFIDENCE, method), F.lit(50))
    total = base + F.when(suffix, SUFFIX_BONUS).otherwise(NO_SUFFIX) + F.when(marketing, MARKETING_PENALTY).otherwise(0) + F.when(words.between(2, 4), WORDS_BONUS).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


@query("X1_domain_hash", f"SELECT id, md5(lower(trim(domain))) AS h FROM {D} d")
def hashes(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).select("id", names.domain_hash(F.col("domain")).alias("h"))


@query("X2_valid_domain", f"SELECT id, regexp_matches(domain, '^[a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?(\\.[a-zA-Z]{{2,}}){{1,2}}$') AS valid FROM {D} d")
def valid_domain(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).select("id", names.is_domain(F.col("domain")).alias("valid"))


@query("X3_bare_host", "SELECT page_id, lower(regexp_extract(url, '^(https?://)?(www\\.)?([^/?#]*)', 3)) AS host FROM pages")
def bare_host(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", names.bare_host(F.col("url")).alias("host"))


@query("X4_X5_country_of_domain", f"SELECT id, {case(TLD_COUNTRY | TLD_CUSTOM, TLD_SQL)} AS country FROM {D} d")
def country_of_domain(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).select("id", lookup(TLD_COUNTRY | TLD_CUSTOM, names.top_level(F.col("domain"))).alias("country"))


@query("X7_domain_context", f"SELECT id, list_extract(string_split(domain, '.'), 1) AS label, array_to_string(list_slice(string_split(domain, '.'), 2, 9), '.') AS suffix, len(string_split(domain, '.')) AS parts FROM {D} d")
def domain_context(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("domain", r"\.")
    return DOMAINS.read(spark, sf).select("id", names.base_label(F.col("domain")).alias("label"), F.array_join(F.slice(parts, 2, 9), ".").alias("suffix"), F.size(parts).cast("long").alias("parts"))


@query("X8_X9_stems", f"SELECT id, list_distinct(list_filter(list_concat([list_extract(string_split(domain, '.'), 1)], regexp_split_to_array(list_extract(string_split(domain, '.'), 1), '[-_0-9]+')), lambda x: length(x) > 2 AND x NOT IN ({listed(names.STOP_STEMS)}))).list_sort() AS stems FROM {D} d")
def stems(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).select("id", F.array_sort(names.stems(F.col("domain"))).alias("stems"))


@query("X10_company_of_domain", f"SELECT id, concat(upper(substr(regexp_replace(domain, '(\\.com?)?\\.[a-z]{{2,}}$', ''), 1, 1)), substr(regexp_replace(domain, '(\\.com?)?\\.[a-z]{{2,}}$', ''), 2)) AS company FROM {D} d")
def company_of_domain(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).select("id", names.company_of_domain(F.col("domain")).alias("company"))


@query("X22_similar_names", f"SELECT id, len(list_filter(regexp_split_to_array(lower(company_name), '\\s+'), lambda w: length(w) > 2 AND list_contains(['company', 'solutions', '77', 'gmbh'], w))) >= greatest(1, least(len(list_filter(regexp_split_to_array(lower(company_name), '\\s+'), lambda w: length(w) > 2)), 3) * 0.5) AS similar FROM {D} d WHERE company_name IS NOT NULL")
def similar(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select("id", names.similar_names(F.col("company_name"), F.lit("Company Solutions 77 GmbH")).alias("similar"))


@query(
    "X33_durations",
    f"""SELECT id, CASE WHEN ms < 60000 THEN concat(cast(floor(ms / 1000 + 0.5) AS BIGINT), 's') WHEN ms < 3600000 THEN concat(cast(floor(ms / 60000 + 0.5) AS BIGINT), 'm ', cast(floor((ms % 60000) / 1000 + 0.5) AS BIGINT), 's')
        ELSE concat(cast(floor(ms / 3600000) AS BIGINT), 'h ', cast(floor((ms % 3600000) / 60000 + 0.5) AS BIGINT), 'm') END AS elapsed FROM (SELECT id, cast(processing_time_ms AS DOUBLE) * 997 AS ms FROM {D} d WHERE processing_time_ms IS NOT NULL) x""",
)
def durations(spark: SparkSession, sf: str) -> DataFrame:
    rows = DOMAINS.read(spark, sf).filter("processing_time_ms IS NOT NULL").select("id", (F.col("processing_time_ms").cast("double") * 997).alias("ms"))
    return rows.select("id", duration(F.col("ms")).alias("elapsed"))


def duration(ms: Column) -> Column:
    whole = lambda x: js_round(x).cast("long").cast("string")
    minutes = F.concat(whole(ms / 60000), F.lit("m "), whole((ms % 60000) / 1000), F.lit("s"))
    hours = F.concat(F.floor(ms / 3600000).cast("string"), F.lit("h "), whole((ms % 3600000) / 60000), F.lit("m"))
    return F.when(ms < 60000, F.concat(whole(ms / 1000), F.lit("s"))).when(ms < 3600000, minutes).otherwise(hours)


@query("X34_timestamps", f"SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS formatted, date_diff('day', created_at, TIMESTAMP '2001-09-01') AS days_ago FROM {D} d")
def timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("formatted"), F.datediff(F.to_date(F.lit("2001-09-01")), F.to_date("created_at")).alias("days_ago"))


FIELDS = ["domain", "company_name", "confidence_score", "extraction_method", "guessed_country", "primary_lei_code", "processing_time_ms", "level2_status"]


@query(
    "X35_export_quality",
    f"""SELECT id, ({' + '.join(f'(CASE WHEN {f} IS NULL THEN 0 ELSE 1 END)' for f in FIELDS)}) * 100.0 / {len(FIELDS)} AS completeness, CASE WHEN confidence_score >= 80 THEN 40 WHEN confidence_score >= 50 THEN 20 ELSE 0 END + CASE WHEN primary_lei_code IS NOT NULL THEN 30 ELSE 0 END
        + CASE WHEN company_name IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN guessed_country IS NOT NULL THEN 10 ELSE 0 END AS quality FROM {D} d""",
)
def export_quality(spark: SparkSession, sf: str) -> DataFrame:
    there = F.size(F.filter(F.array(*[F.col(f).isNotNull() for f in FIELDS]), lambda x: x))
    has = lambda c, n: F.when(F.col(c).isNotNull(), n).otherwise(0)
    quality = F.when(F.col("confidence_score") >= 80, 40).when(F.col("confidence_score") >= 50, 20).otherwise(0) + has("primary_lei_code", 30) + has("company_name", 20) + has("guessed_country", 10)
    return DOMAINS.read(spark, sf).select("id", (there * 100.0 / len(FIELDS)).alias("completeness"), quality.alias("quality"))


@query("F15_quality_threshold", f"SELECT id FROM {D} d WHERE CASE WHEN confidence_score >= 80 THEN 40 WHEN confidence_score >= 50 THEN 20 ELSE 0 END + CASE WHEN primary_lei_code IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN company_name IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN guessed_country IS NOT NULL THEN 10 ELSE 0 END >= 70")
def quality_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return export_quality(spark, sf).filter("quality >= 70").select("id")


@query("X36_X37_business_labels", f"SELECT id, CASE WHEN primary_lei_code IS NOT NULL AND confidence_score >= 80 THEN 'high' WHEN primary_lei_code IS NOT NULL OR confidence_score >= 60 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN contains(company_name, 'GmbH') OR contains(company_name, 'Inc') THEN 'ready' WHEN company_name IS NOT NULL THEN 'research' ELSE 'unknown' END AS readiness FROM {D} d")
def business_labels(spark: SparkSession, sf: str) -> DataFrame:
    lei, name = F.col("primary_lei_code").isNotNull(), F.col("company_name")
    priority = F.when(lei & (F.col("confidence_score") >= 80), "high").when(lei | (F.col("confidence_score") >= 60), "medium").otherwise("low")
    readiness = F.when(name.contains("GmbH") | name.contains("Inc"), "ready").when(name.isNotNull(), "research").otherwise("unknown")
    return DOMAINS.read(spark, sf).select("id", priority.alias("priority"), readiness.alias("readiness"))


@query("X71_legal_form", f"SELECT lei_code, CASE legal_form WHEN 'PJ10' THEN 'Corporation' WHEN '5WWO' THEN 'Foundation' ELSE 'Other' END AS form FROM {E} e")
def legal_form(spark: SparkSession, sf: str) -> DataFrame:
    form = F.col("legal_form")
    return ENTITIES.read(spark, sf).select("lei_code", F.when(form == "PJ10", "Corporation").when(form == "5WWO", "Foundation").otherwise("Other").alias("form"))


@query("X72_P5_confidence_tier", f"SELECT id, CASE WHEN confidence_score / 100 > 0.7 THEN 'high' WHEN confidence_score / 100 > 0.4 THEN 'medium' ELSE 'low' END AS tier FROM {D} d WHERE confidence_score IS NOT NULL")
def confidence_tier(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("confidence_score") / 100
    return DOMAINS.read(spark, sf).filter("confidence_score IS NOT NULL").select("id", F.when(x > 0.7, "high").when(x > 0.4, "medium").otherwise("low").alias("tier"))


@query(
    "X74_changes",
    f"""SELECT lei_code, array_to_string(list_filter([CASE WHEN o_status IS DISTINCT FROM n_status THEN 'entity_status' END, CASE WHEN o_city IS DISTINCT FROM n_city THEN 'city' END], lambda x: x IS NOT NULL), ',') AS changed
        FROM (SELECT lei_code, entity_status AS o_status, city AS o_city, CASE WHEN n % 6 = 0 THEN 'INACTIVE' ELSE entity_status END AS n_status, CASE WHEN n % 4 = 1 THEN NULL ELSE city END AS n_city FROM {E} e) x WHERE o_status IS DISTINCT FROM n_status OR o_city IS DISTINCT FROM n_city""",
)
def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Fields in which a new snapshot of the registry differs from the old one, nulls compared as values."""
    old = ENTITIES.read(spark, sf).select("lei_code", "entity_status", "city", "n")
    new = old.select("lei_code", F.when(F.col("n") % 6 == 0, "INACTIVE").otherwise(F.col("entity_status")).alias("new_status"), F.when(F.col("n") % 4 != 1, F.col("city")).alias("new_city"))
    differs = lambda a, b, name: F.when(~F.col(a).eqNullSafe(F.col(b)), name)
    changed = F.array_compact(F.array(differs("entity_status", "new_status", "entity_status"), differs("city", "new_city", "city")))
    return old.join(new, "lei_code").select("lei_code", F.array_join(changed, ",").alias("changed")).filter("changed <> ''")


@query(
    "X81_evaluation",
    f"""SELECT domain_id, lei_code, tie1, tie3, CASE WHEN company_name IS NULL THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8 WHEN 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) > 0.7 THEN 0.6 ELSE 0.2 END AS score
        FROM (SELECT *, regexp_replace(lower(legal_name), '[^a-z0-9& ]', '', 'g') AS a, regexp_replace(lower(company_name), '[^a-z0-9& ]', '', 'g') AS b FROM {PAIRS_SQL} p) x""",
)
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """An extracted name against the expected one; normalised names keep the ampersand. Each side is normalised once a row, before they meet."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9& ]", "")
    expected = DOMAINS.read(spark, sf).select(F.col("id").alias("domain_id"), bare("company_name").alias("b"))
    found = CANDIDATES.read(spark, sf).select("domain_id", "lei_code", "tie1", "tie3", bare("legal_name").alias("a"))
    a, b = F.col("a"), F.col("b")
    score = F.when(b.isNull(), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.8).when(names.similarity(a, b) > 0.7, 0.6).otherwise(0.2)
    return found.join(expected, "domain_id").select("domain_id", "lei_code", "tie1", "tie3", score.alias("score"))
