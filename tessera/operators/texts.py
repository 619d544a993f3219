"""Texts for people: times in several forms, reasons for a ranking, formatted registry answers, and the best of a site's extraction results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, EDGES, ENTITIES

D, C, E, R = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql, EDGES.sql

#: The reader's time and zone.
NOW, ZONE = "2001-09-01 12:00:00", "America/New_York"
# Forms of a time, in Spark's and in the SQL engine's letters.
FORMS = {
    "iso": ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "%Y-%m-%dT%H:%M:%S.%gZ"),
    "display": ("MMM d, yyyy, hh:mm:ss a 'UTC'", "%b %-d, %Y, %I:%M:%S %p UTC"),
    "display_date": ("MMMM d, yyyy", "%B %-d, %Y"),
    "filename": ("yyyy-MM-dd_HH-mm-ss", "%Y-%m-%d_%H-%M-%S"),
    "readme": ("MMMM d, yyyy, h:mm a 'UTC'", "%B %-d, %Y, %-I:%M %p UTC"),
}


def relative_time(time: Column, now: Column) -> Column:
    """Just now, minutes, hours, yesterday, days of a week, else the date."""
    passed = F.unix_micros(now.cast("timestamp")) - F.unix_micros(time.cast("timestamp"))
    units = {name: F.floor(passed / (micros * 1_000_000)) for name, micros in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86_400))}
    ago = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))
    days = units["day"]
    early = F.when(units["second"] < 60, "Just now").when(units["minute"] < 60, ago(units["minute"], "minute")).when(units["hour"] < 24, ago(units["hour"], "hour"))
    return early.when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(time, FORMS["display_date"][0]))


def is_timestamp(text: Column) -> Column:
    """A time in ISO form: it has a T and can be read."""
    return F.coalesce(text.contains("T") & text.try_cast("timestamp").isNotNull(), F.lit(False))


_PASSED = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at))"
_UNIT = lambda seconds: f"floor({_PASSED} / {seconds}000000.0)::BIGINT"
_AGO = lambda seconds, unit: f"concat({_UNIT(seconds)}, CASE WHEN {_UNIT(seconds)} = 1 THEN ' {unit} ago' ELSE ' {unit}s ago' END)"
_MAYBE = f"CASE id % 3 WHEN 0 THEN strftime(created_at, '{FORMS['iso'][1]}') WHEN 1 THEN concat('T', domain) ELSE strftime(created_at, '%Y-%m-%d') END"


@query(
    "X34_all_time_forms",
    f"""SELECT id, {', '.join(f"strftime(created_at, '{sql}') AS {name}" for name, (_, sql) in FORMS.items())}, CASE WHEN {_UNIT(1)} < 60 THEN 'Just now' WHEN {_UNIT(60)} < 60 THEN {_AGO(60, 'minute')} WHEN {_UNIT(3600)} < 24 THEN {_AGO(3600, 'hour')}
        WHEN {_UNIT(86400)} = 1 THEN 'Yesterday' WHEN {_UNIT(86400)} < 7 THEN concat({_UNIT(86400)}, ' days ago') ELSE strftime(created_at, '{FORMS['display_date'][1]}') END AS relative,
        contains({_MAYBE}, 'T') AND TRY_CAST({_MAYBE} AS TIMESTAMP) IS NOT NULL AS valid, strftime(created_at AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%m/%d/%Y, %I:%M:%S %p') AS zoned FROM {D} d""",
)
def all_time_forms(spark: SparkSession, sf: str) -> DataFrame:
    """When each domain was added, in every form, as time ago, in the reader's zone; and which texts are times."""
    time = F.col("created_at").cast("timestamp_ntz")
    maybe = F.when(F.col("id") % 3 == 0, F.date_format(time, FORMS["iso"][0])).when(F.col("id") % 3 == 1, F.concat(F.lit("T"), "domain")).otherwise(F.date_format(time, "yyyy-MM-dd"))
    zoned = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), time), "MM/dd/yyyy, hh:mm:ss a")
    forms = [F.date_format(time, java).alias(name) for name, (java, _) in FORMS.items()]
    return DOMAINS.read(spark, sf).select("id", *forms, relative_time(time, F.lit(NOW).cast("timestamp_ntz")).alias("relative"), is_timestamp(maybe).alias("valid"), zoned.alias("zoned"))


# Weights of a ranking as percentages, corporate legal forms, and the jurisdictions that a buyer prefers.
WEIGHTS = {"parent": 40, "half parent": 28, "status": 10, "form": 5, "recency": 5, "half recency": 2.5}
CORPORATE_FORMS = ["XTIQ", "XDLC", "8888", "CORP", "INC"]
PRIMARY, SECONDARY = "US", ["DE", "GB"]
ASKED_ON = "1998-12-01"


def _first(*branches: tuple[str, str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {text}" for test, text in branches) + f" ELSE {otherwise} END"


MONTHS = "days / cast(30 AS double)"
CORPORATE = " OR ".join(f"contains(legal_form, '{f}')" for f in CORPORATE_FORMS)
# Reasons and factors in their order, in the common part of both languages.
REASONS = [
    _first(("level = 'ultimate_parent'", "'ULTIMATE PARENT - This is the top-level decision-making entity'"), ("level = 'parent'", "'PARENT ENTITY - Has subsidiaries but may itself be owned'"), ("level = 'subsidiary'", "'SUBSIDIARY - Owned by another entity, not ideal for acquisition'"), otherwise="'INDEPENDENT ENTITY - No parent/subsidiary relationships found'"),
    "CASE WHEN jurisdiction IS NOT NULL THEN concat('JURISDICTION: ', jurisdiction, ' - Discovered from entity registration data') END",
    _first(("entity_status = 'ACTIVE'", "'ACTIVE STATUS - Entity is currently operational'"), ("entity_status IS NOT NULL", "concat(entity_status, ' STATUS - May indicate merger, dissolution, or inactivity')")),
    _first((CORPORATE, "concat('CORPORATION (', legal_form, ') - Standard corporate structure suitable for acquisition')"), ("legal_form <> ''", "concat('LEGAL FORM: ', legal_form)")),
    _first((f"{MONTHS} < 12", "'RECENTLY UPDATED - Data verified within last year'"), (f"{MONTHS} < 36", "'MODERATELY RECENT - Data from last 3 years'"), ("days IS NOT NULL", f"concat('OUTDATED - Last updated ', cast(cast(floor({MONTHS} / 12) AS bigint) AS string), ' years ago')")),
    "CASE WHEN city IS NOT NULL THEN concat('HEADQUARTERS: ', city, ', ', coalesce(country, '')) END",
]
FACTORS = [
    _first(("level = 'ultimate_parent'", f"'+{WEIGHTS['parent']}% for ultimate parent status'"), ("level = 'parent'", f"'+{WEIGHTS['half parent']}% for parent status'"), ("level = 'subsidiary'", "'No bonus for subsidiary status'")),
    _first(("entity_status = 'ACTIVE'", f"'+{WEIGHTS['status']}% for active status'"), ("entity_status IS NOT NULL", "'No bonus for inactive status'")),
    _first((CORPORATE, f"'+{WEIGHTS['form']}% for corporate form'")),
    _first((f"{MONTHS} < 12", f"'+{WEIGHTS['recency']}% for recent data'"), (f"{MONTHS} < 36", "'+3% for moderate recency'"), ("days IS NOT NULL", "'No recency bonus'")),
]
SHORT = [
    _first(("level = 'ultimate_parent'", "'ULTIMATE PARENT - Top decision-maker'"), ("level = 'parent'", "'PARENT ENTITY - Has subsidiaries'"), ("level = 'subsidiary'", "'SUBSIDIARY - Requires parent approval'")),
    _first((f"jurisdiction = '{PRIMARY}'", f"'PRIMARY JURISDICTION ({PRIMARY})'"), (f"jurisdiction IN ({', '.join(repr(j) for j in SECONDARY)})", "concat('SECONDARY JURISDICTION (', jurisdiction, ')')")),
    "CASE WHEN entity_status = 'ACTIVE' THEN 'ACTIVE STATUS' END",
    "CASE WHEN city IS NOT NULL THEN concat('HQ: ', city, ', ', coalesce(country, '')) END",
]


def reasoning(rows: DataFrame) -> DataFrame:
    """``short`` and ``full`` reasons of rows with ``level`` (ultimate_parent, parent, subsidiary, else independent), ``jurisdiction``, ``entity_status``, ``legal_form``, ``days`` since the last update, ``city`` and ``country``. Nulls
    give no reason, save that a null level is independent."""
    joined = lambda parts, by: F.array_join(F.array_compact(F.array(*[F.expr(p) for p in parts])), by)
    factors = joined(FACTORS, ", ")
    full = F.concat(joined(REASONS, " | "), F.when(factors != "", F.concat(F.lit(" [Score factors: "), factors, F.lit("]"))).otherwise(""))
    return rows.withColumns({"short": joined(SHORT, " | "), "full": full})


_JOINED = lambda parts, by: f"array_to_string(list_filter([{', '.join(p.replace('AS string', 'AS VARCHAR') for p in parts)}], lambda x: x IS NOT NULL), '{by}')"


@query(
    "X69_ranking_reasons",
    f"""SELECT lei_code, {_JOINED(SHORT, ' | ')} AS short, concat({_JOINED(REASONS, ' | ')}, CASE WHEN {_JOINED(FACTORS, ', ')} <> '' THEN concat(' [Score factors: ', {_JOINED(FACTORS, ', ')}, ']') ELSE '' END) AS full_text
      FROM (SELECT e.*, CASE WHEN p.child_lei IS NULL AND k.parent_lei IS NOT NULL THEN 'ultimate_parent' WHEN k.parent_lei IS NOT NULL THEN 'parent' WHEN p.child_lei IS NOT NULL THEN 'subsidiary' END AS level, date_diff('day', u.updated::DATE, DATE '{ASKED_ON}') AS days
        FROM {E} e LEFT JOIN (SELECT DISTINCT child_lei FROM {R} r WHERE parent_lei <> child_lei) p ON e.lei_code = p.child_lei LEFT JOIN (SELECT DISTINCT parent_lei FROM {R} r WHERE parent_lei <> child_lei) k ON e.lei_code = k.parent_lei
        LEFT JOIN (SELECT lei_code, max(found_at) AS updated FROM {C} c GROUP BY lei_code) u ON e.lei_code = u.lei_code) x""",
)
def ranking_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Both builders over all entities, with their place in the hierarchy and the day on which they were found last."""
    edges = EDGES.read(spark, sf).filter("parent_lei <> child_lei")
    up = edges.select(F.col("child_lei").alias("lei_code")).distinct().withColumn("has_parent", F.lit(True))
    down = edges.select(F.col("parent_lei").alias("lei_code")).distinct().withColumn("has_children", F.lit(True))
    seen = CANDIDATES.read(spark, sf).groupBy("lei_code").agg(F.max("found_at").alias("updated"))
    rows = ENTITIES.read(spark, sf).join(up, "lei_code", "left").join(down, "lei_code", "left").join(seen, "lei_code", "left")
    level = F.when(F.col("has_parent").isNull() & F.col("has_children"), "ultimate_parent").when(F.col("has_children"), "parent").when(F.col("has_parent"), "subsidiary")
    rows = rows.withColumns({"level": level, "days": F.datediff(F.lit(ASKED_ON).cast("date"), F.col("updated").cast("date"))})
    return reasoning(rows).select("lei_code", "short", F.col("full").alias("full_text"))


@query(
    "X72_formatted_results",
    f"""SELECT lei_code, legal_name AS company_name, coalesce(jurisdiction, country, 'Not specified') AS country, CASE WHEN entity_status = 'ACTIVE' AND registration_status = 'ISSUED' THEN 'high' WHEN entity_status = 'ACTIVE' THEN 'medium' ELSE 'low' END AS confidence,
        concat('GLEIF Official Registry; LEI: ', lei_code, '; Managing LOU: N/A') AS sources, entity_status, registration_status, jurisdiction, legal_form, nullif(concat_ws(', ', city, country), '') AS headquarters FROM {E} e""",
)
def formatted_results(spark: SparkSession, sf: str) -> DataFrame:
    """Registry records as an extraction result: the tier follows from both statuses."""
    active = F.col("entity_status") == "ACTIVE"
    tier = F.when(active & (F.col("registration_status") == "ISSUED"), "high").when(active, "medium").otherwise("low")
    sources = F.concat(F.lit("GLEIF Official Registry; LEI: "), "lei_code", F.lit("; Managing LOU: N/A"))
    columns = [F.col("legal_name").alias("company_name"), F.coalesce("jurisdiction", "country", F.lit("Not specified")).alias("country"), tier.alias("confidence"), sources.alias("sources")]
    return ENTITIES.read(spark, sf).select("lei_code", *columns, "entity_status", "registration_status", "jurisdiction", "legal_form", F.nullif(F.concat_ws(", ", "city", "country"), F.lit("")).alias("headquarters"))


# Extraction methods in the order in which they are tried.
METHODS = ["structured_data", "meta_property", "footer_copyright", "html_title", "domain_parse"]


def best_result(results: Column) -> Column:
    """``company_name, method, confidence, category, status`` of an array of results (method, company_name, confidence), failed ones with a null name: the highest confidence, among equals the method tried first."""
    tried = lambda r: F.coalesce(F.array_position(F.array(*map(F.lit, METHODS)), r["method"]), F.lit(0))
    ordered = F.array_sort(F.transform(F.filter(results, lambda r: r["company_name"].isNotNull()), lambda r: F.struct((-r["confidence"]).alias("k"), tried(r).alias("t"), r["method"].alias("method"), r["company_name"].alias("company_name"), r["confidence"].alias("confidence"))))
    best = F.get(ordered, 0)
    category = F.when(best.isNull(), "Failed - No Extraction").when(best["confidence"] < 50, "Incomplete - Low Priority").when(best["confidence"] >= 95, "Success - High Confidence").otherwise("Success")
    return F.struct(best["company_name"].alias("company_name"), F.coalesce(best["method"], F.lit("none")).alias("method"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"), category.alias("category"), F.when(best.isNull(), "failed").otherwise("success").alias("status"))


@query(
    "X88_best_of_methods",
    f"""SELECT domain, company_name, coalesce(method, 'none') AS method, coalesce(confidence, 0.0::DOUBLE) AS confidence, CASE WHEN method IS NULL THEN 'Failed - No Extraction' WHEN confidence < 50 THEN 'Incomplete - Low Priority' WHEN confidence >= 95 THEN 'Success - High Confidence' ELSE 'Success' END AS category,
        CASE WHEN method IS NULL THEN 'failed' ELSE 'success' END AS status, n AS methods FROM (SELECT DISTINCT domain, n FROM (SELECT domain, count(DISTINCT extraction_method) OVER (PARTITION BY domain) AS n FROM {D} a) b) g LEFT JOIN (
          SELECT domain AS d, method, company_name, confidence FROM (SELECT domain, extraction_method AS method, max(coalesce(confidence_score, 0)) AS confidence, arg_max(company_name, {{'c': coalesce(confidence_score, 0), 'n': company_name}}) AS company_name FROM {D} x WHERE company_name IS NOT NULL GROUP BY ALL) m
          QUALIFY row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, list_position({METHODS!r}, method)) = 1) k ON g.domain = k.d""",
)
def best_of_methods(spark: SparkSession, sf: str) -> DataFrame:
    """The best result of each method for a domain, then the best of the methods."""
    score = F.coalesce("confidence_score", F.lit(0.0))
    name = F.max(F.when(F.col("company_name").isNotNull(), F.struct(score.alias("c"), F.col("company_name").alias("n"))))
    per = DOMAINS.read(spark, sf).groupBy("domain", F.col("extraction_method").alias("method")).agg(name.alias("x")).select("domain", "method", F.col("x.n").alias("company_name"), F.col("x.c").alias("confidence"))
    lists = per.groupBy("domain").agg(F.collect_list(F.struct("method", "company_name", "confidence")).alias("results"), F.count("*").alias("methods"))  # at most a result a method
    return lists.select("domain", F.element_at(F.transform(F.array("results"), best_result), 1).alias("b"), "methods").select("domain", "b.*", "methods")
