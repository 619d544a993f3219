"""Row-level rules around names, claims and answers: cleaning, validation, standard forms, evidence texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions.compat import js_round
from tessera.operators.extraction import DECODE_SQL, decoded
from tessera.operators.scoring import SUFFIX_SQL, WORDS_SQL, listed
from tessera.operators.structured import named_holders
from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, DUMPS, ENTITIES, LOG

D, C, E, P, G = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql, DUMPS.sql, LOG.sql
# Legal endings by jurisdiction, standard forms of endings, generic names, and words no entity has.
SUFFIXES = {"US": ["Inc.", "LLC", "Corp."], "DE": ["GmbH", "AG", "KG"], "FR": ["SA", "SARL", "SAS"], "GB": ["Ltd", "PLC", "LLP"], "BR": ["Ltda", "SA", "EIRELI"]}
STANDARD = {"incorporated": "Inc.", "inc": "Inc.", "corporation": "Corp.", "limited": "Ltd", "ltd": "Ltd", "gmbh": "GmbH"}
GENERIC = ["home", "welcome", "index", "untitled", "default"]
EXCLUDED = ["pension", "fund", "trust", "holding"]
NONPROFIT = ["foundation", "association", "university"]
TAIL = r"(?i)\s*[-|–]\s*(home|official site|welcome).*$"
LEGAL_ENTITY = r"([A-Z][A-Za-z0-9&#]*(?: [A-Z0-9][A-Za-z0-9&#]*){0,4} (?:Inc|GmbH|Ltd|LLC|Holding))"


@query("X6_X64_suffix_suggestions", f"SELECT e.lei_code, s.suffix FROM {E} e JOIN (VALUES {', '.join(f"('{j}', '{s}')" for j, v in SUFFIXES.items() for s in v)}) s(j, suffix) ON e.jurisdiction = s.j WHERE e.city IS NULL")
def suffix_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """The endings of a jurisdiction, for records that need one; the list is a constant."""
    endings = spark.createDataFrame([(j, s) for j, v in SUFFIXES.items() for s in v], "jurisdiction string, suffix string")
    return ENTITIES.read(spark, sf).filter("city IS NULL").join(F.broadcast(endings), "jurisdiction").select("lei_code", "suffix")


def clean_name(name: Column) -> Column:
    name = F.regexp_replace(name, TAIL, "")
    name = F.regexp_replace(name, r"[\"“”]", "")
    name = F.regexp_replace(name, r"\s+", " ")
    return F.trim(F.regexp_replace(name, r"[,;:]+$", ""))


CLEAN_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '{TAIL}', ''), '[\"“”]', '', 'g'), '\\s+', ' ', 'g'), '[,;:]+$', ''))"
RAW_SQL = f"(SELECT id, company_name, concat('\"', company_name, '\"  ', CASE WHEN id % 2 = 0 THEN ' | Home of ' ELSE ',;' END, CASE WHEN id % 2 = 0 THEN domain ELSE '' END) AS raw FROM {D} d WHERE company_name IS NOT NULL)"


def raw_names(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("id") % 2 == 0
    raw = F.concat(F.lit('"'), "company_name", F.lit('"  '), F.when(even, " | Home of ").otherwise(",;"), F.when(even, F.col("domain")).otherwise(""))
    return DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select("id", "company_name", raw.alias("raw"))


@query("X11_clean_name", f"SELECT id, {CLEAN_SQL} AS name FROM {RAW_SQL} r")
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    return raw_names(spark, sf).select("id", clean_name(F.col("raw")).alias("name"))


@query(
    "X13_X14_X17_X75_validation",
    f"""SELECT id, CASE WHEN length(company_name) < 5 THEN 'too short' WHEN length(company_name) > 100 THEN 'too long' WHEN lower(company_name) IN ({listed(GENERIC)}) THEN 'generic' WHEN contains(lower(company_name), 'solutions') THEN 'marketing'
        WHEN NOT {SUFFIX_SQL} AND NOT ({' OR '.join(f"contains(lower(company_name), '{w}')" for w in NONPROFIT)}) THEN 'no legal suffix' ELSE 'valid' END AS verdict FROM {D} d WHERE company_name IS NOT NULL""",
)
def validation(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule a name breaks; nonprofits need no legal ending."""
    name = F.col("company_name")
    nonprofit = F.exists(F.array(*map(F.lit, NONPROFIT)), lambda w: F.lower(name).contains(w))
    verdict = F.when(F.length(name) < 5, "too short").when(F.length(name) > 100, "too long").when(F.lower(name).isin(GENERIC), "generic").when(F.lower(name).contains("solutions"), "marketing").when(~names.has_suffix(name) & ~nonprofit, "no legal suffix").otherwise("valid")
    return DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select("id", verdict.alias("verdict"))


@query("X62_standard_suffix", f"SELECT id, CASE lower(regexp_replace(list_extract(string_split(company_name, ' '), -1), '[.]', '')) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STANDARD.items())} ELSE NULL END AS standard FROM {D} d WHERE company_name IS NOT NULL")
def standard_suffix(spark: SparkSession, sf: str) -> DataFrame:
    last = F.lower(F.regexp_replace(F.element_at(F.split("company_name", " "), -1), "[.]", ""))
    return DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select("id", F.create_map(*[F.lit(x) for kv in STANDARD.items() for x in kv])[last].alias("standard"))


@query("F16_excluded_entities", f"SELECT lei_code, legal_name FROM {E} e WHERE NOT ({' OR '.join(f"contains(lower(legal_name), '{w}')" for w in EXCLUDED)})")
def excluded(spark: SparkSession, sf: str) -> DataFrame:
    return ENTITIES.read(spark, sf).filter(~F.exists(F.array(*map(F.lit, EXCLUDED)), lambda w: F.lower("legal_name").contains(w))).select("lei_code", "legal_name")


@query("X44_primary_entity", f"SELECT domain_id, list_extract(list(legal_name ORDER BY CASE WHEN regexp_matches(legal_name, ' (Inc|GmbH|Holding)$') THEN 0 ELSE 1 END, length(legal_name) DESC, legal_name), 1) AS entity FROM {C} c GROUP BY domain_id")
def primary_entity(spark: SparkSession, sf: str) -> DataFrame:
    """The longest name with a legal ending, else the longest."""
    order = F.struct(F.when(F.col("legal_name").rlike(" (Inc|GmbH|Holding)$"), 0).otherwise(1), -F.length("legal_name"), "legal_name")
    return CANDIDATES.read(spark, sf).groupBy("domain_id").agg(F.min_by("legal_name", order).alias("entity"))


@query("X45_X89_evidence_confidence", f"SELECT domain_id, least(0.95, greatest(0.1, 0.5 + 0.1 * least(count(DISTINCT legal_form), 2) + CASE WHEN bool_or(regexp_matches(legal_name, ' (Inc|GmbH)$')) THEN 0.2 ELSE 0 END - CASE WHEN bool_or(contains(legal_name, 'Holding')) THEN 0.3 ELSE 0 END)) AS confidence FROM {C} c GROUP BY domain_id")
def evidence_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """What the kinds of sources, endings and generic names add up to, within bounds."""
    kinds = F.least(F.size(F.collect_set("legal_form")), F.lit(2)) * 0.1
    ending, generic = F.bool_or(F.col("legal_name").rlike(" (Inc|GmbH)$")), F.bool_or(F.col("legal_name").contains("Holding"))
    total = 0.5 + kinds + F.when(ending, 0.2).otherwise(0.0) - F.when(generic, 0.3).otherwise(0.0)
    return CANDIDATES.read(spark, sf).groupBy("domain_id").agg(F.least(F.lit(0.95), F.greatest(F.lit(0.1), total)).alias("confidence"))


@query("X59_X55_X76_legal_entities", f"SELECT lei_code, list_slice(regexp_extract_all(t, '{LEGAL_ENTITY}', 1), 1, 10) AS found, strpos(t, legal_name) AS at FROM (SELECT lei_code, legal_name, concat('operated by ', legal_name, ', part of Group ', n, ' Ltd since 1990') AS t FROM {E} e) x")
def legal_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Names with legal endings in running text, at most ten, and where the own name begins."""
    text = F.concat(F.lit("operated by "), "legal_name", F.lit(", part of Group "), F.col("n").cast("string"), F.lit(" Ltd since 1990"))
    rows = ENTITIES.read(spark, sf).withColumn("t", text)
    return rows.select("lei_code", F.slice(F.regexp_extract_all("t", F.lit(LEGAL_ENTITY), F.lit(1)), 1, 10).alias("found"), F.instr("t", F.col("legal_name")).cast("long").alias("at"))


JSON_LD_SQL = f"(SELECT lei_code, legal_name, concat('{{\"@graph\": [{{\"@type\": \"WebSite\"}}, {{\"@type\": \"Organization\", \"name\": \"', legal_name, '\"}}]}}') AS doc FROM {E} e)"


@query("X42_X43_json_ld", f"SELECT lei_code, json_extract_string(doc, '$.@graph[1].name') AS name, 0.95 AS confidence FROM {JSON_LD_SQL} j")
def json_ld(spark: SparkSession, sf: str) -> DataFrame:
    """The most trusted name anywhere in linked data."""
    doc = F.concat(F.lit('{"@graph": [{"@type": "WebSite"}, {"@type": "Organization", "name": "'), "legal_name", F.lit('"}]}'))
    found = named_holders(ENTITIES.read(spark, sf).select("lei_code", doc.alias("doc")), "lei_code", "doc")
    best = F.min_by(F.struct("name", "confidence"), F.struct(-F.col("confidence"), "path")).alias("x")
    return found.groupBy(F.col("id").alias("lei_code")).agg(best).select("lei_code", "x.name", "x.confidence")


STEM_SQL = "lower(string_split(p.domain, '.')[-2])"


@query("X54_footer_stems", f"SELECT p.dump_id, contains(lower({DECODE_SQL('p.html')}), {STEM_SQL}) AS has_stem, CASE WHEN regexp_matches(lower({DECODE_SQL('p.html')}), concat('©[^<]*', regexp_escape({STEM_SQL}))) THEN 98 WHEN contains(lower({DECODE_SQL('p.html')}), {STEM_SQL}) THEN 75 ELSE 0 END AS confidence FROM {P} p")
def footer_stems(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern of its own for each row: the domain's stem, whatever its characters, after a copyright sign."""
    stem, text = F.lower(F.element_at(F.split("domain", r"\."), -2)), F.lower(decoded(F.col("html")))
    confidence = F.when(F.rlike(text, F.concat(F.lit(r"©[^<]*\Q"), stem, F.lit(r"\E"))), 98).when(text.contains(stem), 75).otherwise(0)
    return DUMPS.read(spark, sf).select("dump_id", text.contains(stem).alias("has_stem"), confidence.alias("confidence"))


@query(
    "X69_X78_X80_texts",
    f"""SELECT lei_code, array_to_string(list_filter([concat('Status ', lower(entity_status)), CASE WHEN city IS NOT NULL THEN concat('seat in ', city) END, CASE WHEN legal_form = 'PJ10' THEN 'a corporation' END], lambda x: x IS NOT NULL), ', ') AS reasoning FROM {E} e""",
)
def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons that apply, joined."""
    parts = F.array(F.concat(F.lit("Status "), F.lower("entity_status")), F.concat(F.lit("seat in "), "city"), F.when(F.col("legal_form") == "PJ10", "a corporation"))
    return ENTITIES.read(spark, sf).select("lei_code", F.array_join(F.array_compact(parts), ", ").alias("reasoning"))


@query("X79_enriched_claims", f"SELECT legal_name AS name FROM {E} e WHERE n % 2 = 0 UNION ALL SELECT legal_name FROM {E} x WHERE n % 3 = 0 AND lower(legal_name) NOT IN (SELECT lower(legal_name) FROM {E} y WHERE n % 2 = 0)")
def enriched_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Own claims and those of related entities that are not among them."""
    entities = ENTITIES.read(spark, sf)
    own = entities.filter("n % 2 = 0").select(F.col("legal_name").alias("name"))
    related = entities.filter("n % 3 = 0").select(F.col("legal_name").alias("name")).withColumn("k", F.lower("name"))
    return own.unionAll(related.join(own.select(F.lower("name").alias("k")), "k", "left_anti").select("name"))


@query(
    "X85_W10_best_attempt",
    f"SELECT domain, arg_max(extraction_method, {{'c': coalesce(confidence_score, 0), 'i': -id}}) AS best_method, max(coalesce(confidence_score, 0)) AS best_score FROM {D} d GROUP BY domain",
)
def best_attempt(spark: SparkSession, sf: str) -> DataFrame:
    """The first of a domain's best attempts."""
    score = F.coalesce("confidence_score", F.lit(0.0))
    return DOMAINS.read(spark, sf).groupBy("domain").agg(F.max_by("extraction_method", F.struct(score, -F.col("id"))).alias("best_method"), F.max(score).alias("best_score"))


@query(
    "X87_score_v4",
    f"""SELECT domain_id, lei_code, tie1, tie3, cast(floor((CASE WHEN jurisdiction = 'US' THEN 80 ELSE 50 END) * 0.3::DOUBLE + (CASE WHEN contains(lower(legal_name), 'inc') THEN 90 ELSE 40 END) * 0.3::DOUBLE + (CASE legal_form WHEN 'PJ10' THEN 100 WHEN '5WWO' THEN 20 ELSE 60 END) * 0.25::DOUBLE
        + (CASE WHEN entity_status = 'ACTIVE' THEN 100 ELSE 30 END) * 0.15::DOUBLE + 0.5) AS BIGINT) AS score FROM {C} c""",
)
def score_v4(spark: SparkSession, sf: str) -> DataFrame:
    tld, name = F.when(F.col("jurisdiction") == "US", 80).otherwise(50), F.when(F.lower("legal_name").contains("inc"), 90).otherwise(40)
    form = F.when(F.col("legal_form") == "PJ10", 100).when(F.col("legal_form") == "5WWO", 20).otherwise(60)
    total = tld * 0.3 + name * 0.3 + form * 0.25 + F.when(F.col("entity_status") == "ACTIVE", 100).otherwise(30) * 0.15
    return CANDIDATES.read(spark, sf).select("domain_id", "lei_code", "tie1", "tie3", js_round(total).cast("long").alias("score"))


@query("X88_level1_category", f"SELECT id, CASE WHEN coalesce(confidence_score, 0) >= 95 THEN 'final' WHEN coalesce(confidence_score, 0) < 50 THEN 'level2' ELSE 'review' END AS category FROM {D} d")
def level1_category(spark: SparkSession, sf: str) -> DataFrame:
    score = F.coalesce("confidence_score", F.lit(0.0))
    return DOMAINS.read(spark, sf).select("id", F.when(score >= 95, "final").when(score < 50, "level2").otherwise("review").alias("category"))


@query("X49_X77_answer_confidence", f"SELECT id, least(1.0, 0.4 + CASE WHEN company_name IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN guessed_country IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN {WORDS_SQL} BETWEEN 2 AND 4 THEN 0.1 ELSE 0 END) AS confidence FROM {D} d")
def answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda c: F.col(c).isNotNull()
    total = 0.4 + F.when(has("company_name"), 0.3).otherwise(0.0) + F.when(has("guessed_country"), 0.2).otherwise(0.0) + F.when(names.word_count(F.col("company_name")).between(2, 4), 0.1).otherwise(0.0)
    return DOMAINS.read(spark, sf).select("id", F.least(F.lit(1.0), total).alias("confidence"))


@query("O9_bounded_slices", f"SELECT domain_id, list_slice(list(lei_code ORDER BY rank_position, lei_code), 1, 5) AS first_five FROM (SELECT DISTINCT domain_id, lei_code, rank_position FROM {C} c) x GROUP BY domain_id")
def bounded_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Five at most; ranked before they are gathered."""
    w = Window.partitionBy("domain_id").orderBy("rank_position", "lei_code")
    few = CANDIDATES.read(spark, sf).select("domain_id", "lei_code", "rank_position").distinct().withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    return few.groupBy("domain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "lei_code"))), lambda x: x["lei_code"]).alias("first_five"))


@query("K9_K17_append", f"SELECT count(*) AS n, count(DISTINCT id) AS distinct_ids FROM (SELECT id FROM {D} d UNION ALL SELECT id + 10000000 FROM {D} x WHERE batch_id = 'b1') y")
def append(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot with new rows appended."""
    rows = DOMAINS.read(spark, sf).select("id", "batch_id")
    return rows.select("id").unionAll(rows.filter("batch_id = 'b1'").select((F.col("id") + 10_000_000).alias("id"))).agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"))


@query("J12_J19_eager_children", f"SELECT d.id, coalesce(list_sort(list_distinct(list(c.lei_code) FILTER (c.lei_code IS NOT NULL))), []) AS leis FROM {D} d LEFT JOIN {C} c ON d.id = c.domain_id WHERE d.batch_id = 'b11' GROUP BY d.id")
def eager_children(spark: SparkSession, sf: str) -> DataFrame:
    domains = DOMAINS.read(spark, sf).filter("batch_id = 'b11'")
    asked = CANDIDATES.read(spark, sf).join(domains.select(F.col("id").alias("domain_id")), "domain_id", "left_semi")
    found = asked.groupBy("domain_id").agg(F.array_sort(F.collect_set("lei_code")).alias("leis"))
    return domains.join(found, F.col("id") == F.col("domain_id"), "left").select("id", F.coalesce("leis", F.array().cast("array<string>")).alias("leis"))


@query("M7_stalls", f"SELECT batch_id, seq FROM (SELECT batch_id, seq, ts, lag(ts) OVER (PARTITION BY batch_id ORDER BY ts, seq) AS before FROM {G} l) x WHERE ts - before > INTERVAL 2 HOUR")
def stalls(spark: SparkSession, sf: str) -> DataFrame:
    """Events that follow a silence of more than two hours in their batch."""
    rows = LOG.read(spark, sf).withColumn("before", F.lag("ts").over(Window.partitionBy("batch_id").orderBy("ts", "seq")))
    return rows.filter("ts - before > INTERVAL 2 HOURS").select("batch_id", "seq")


@query("P6_claim_types", f"SELECT domain_id, lei_code, tie1, tie3, CASE WHEN rank_position = 1 THEN 'llm_extracted' ELSE 'gleif_candidate' END AS stored FROM {C} c")
def claim_types(spark: SparkSession, sf: str) -> DataFrame:
    """All kinds of claims are stored as one of two."""
    return CANDIDATES.read(spark, sf).select("domain_id", "lei_code", "tie1", "tie3", F.when(F.col("rank_position") == 1, "llm_extracted").otherwise("gleif_candidate").alias("stored"))


@query(
    "X20_name_containment",
    f"""SELECT domain_id, lei_code, tie1, tie3, CASE WHEN a = b THEN 100 WHEN contains(a, b) OR contains(b, a) THEN 90 ELSE cast(floor(len(list_filter(string_split(a, ' '), lambda w: len(list_filter(string_split(b, ' '), lambda v: contains(w, v) OR contains(v, w))) > 0))::DOUBLE
        / greatest(len(string_split(a, ' ')), len(string_split(b, ' '))) * 80 + 0.5) AS BIGINT) END AS score FROM (SELECT c.*, lower(c.legal_name) AS a, lower(d.company_name) AS b FROM {C} c JOIN {D} d ON c.domain_id = d.id WHERE d.company_name IS NOT NULL) x""",
)
def name_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Equal, contained, or the share of words that hold or are held by one of the other's."""
    companies = DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select(F.col("id").alias("domain_id"), F.lower("company_name").alias("b"))
    rows = CANDIDATES.read(spark, sf).join(companies, "domain_id").withColumn("a", F.lower("legal_name"))
    a, b = F.col("a"), F.col("b")
    wa, wb = F.split(a, " "), F.split(b, " ")
    met = F.size(F.filter(wa, lambda w: F.exists(wb, lambda v: w.contains(v) | v.contains(w))))
    score = F.when(a == b, 100).when(a.contains(b) | b.contains(a), 90).otherwise(js_round(met / F.greatest(F.size(wa), F.size(wb)) * 80))
    return rows.select("domain_id", "lei_code", "tie1", "tie3", score.cast("long").alias("score"))


@query("X46_page_summary", f"SELECT dump_id, trim({DECODE_SQL(f"regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)")}) AS title, len(regexp_extract_all(html, '(?i)<meta ')) AS metas, list_slice(list_distinct(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')), 1, 5).list_sort() AS emails FROM {P} p")
def page_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Title, number of meta tags and five addresses of each page; expressions on the page suffice."""
    emails = F.array_sort(F.slice(F.array_distinct(F.regexp_extract_all("html", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))), 1, 5))
    return DUMPS.read(spark, sf).select("dump_id", F.trim(decoded(F.regexp_extract("html", r"(?i)<title[^>]*>([^<]*)</title>", 1))).alias("title"), F.regexp_count("html", F.lit("(?i)<meta ")).cast("long").alias("metas"), emails.alias("emails"))


@query("M4_refresh_due", f"SELECT lei_code FROM (SELECT lei_code, max(found_at) AS seen FROM {C} c GROUP BY lei_code) x WHERE seen < TIMESTAMP '2001-11-01' - INTERVAL 1 DAY ORDER BY seen, lei_code LIMIT 500")
def refresh_due(spark: SparkSession, sf: str) -> DataFrame:
    """Records not seen for a day, the oldest first; a refresh takes 500 at most."""
    seen = CANDIDATES.read(spark, sf).groupBy("lei_code").agg(F.max("found_at").alias("seen"))
    return seen.filter("seen < timestamp'2001-11-01' - INTERVAL 1 DAY").orderBy("seen", "lei_code").limit(500).select("lei_code")
