"""Whole export records: the wide row of a domain with its candidates, the CSV that carries it, the nested record and its field presets; and what a claim is made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, CLEANED, DETAILS, DOMAINS, DUMPS, EDGES, ENTITIES, PROCESSED

D, X, C, E, R, P = DOMAINS.sql, DETAILS.sql, CANDIDATES.sql, ENTITIES.sql, EDGES.sql, DUMPS.sql

# The header of the CSV export with the column of each, and the presets of the nested export.
CSV_HEADER = {
    "Domain": "domain", "Company Name": "company_name", "Extraction Method": "extraction_method", "Confidence Score": "confidence_score", "Primary LEI Code": "primary_lei_code", "Primary GLEIF Name": "primary_gleif_name", "Country": "guessed_country",
    "Total GLEIF Candidates": "gleif_candidate_count", "All LEI Codes": "all_lei_codes", "All Legal Names": "all_legal_names", "All Jurisdictions": "all_jurisdictions", "All Entity Statuses": "all_entity_statuses", "Level 2 Status": "level2_status",
    "Level 2 Candidates Count": "level2_candidates_count", "Final Legal Name": "final_legal_name", "Final Confidence": "final_confidence", "Recommendation": "recommendation", "Processing Time (ms)": "processing_time_ms", "Status": "status",
    "Error Message": "error_message", "Failure Category": "failure_category", "Technical Details": "technical_details", "Retry Count": "retry_count", "Created At": "created_at", "Processed At": "processed_at",
}
DEFAULT_FIELDS = ["domain", "finalLegalName", "primaryLeiCode", "finalConfidence", "level2Status", "businessPriority", "acquisitionReadiness", "jurisdiction", "entityStatus", "processingTimeMs", "dataCompleteness", "qualityScore"]
COMPREHENSIVE_FIELDS = [
    *DEFAULT_FIELDS, "level1CompanyName", "level1ExtractionMethod", "level1Confidence", "level2CandidatesCount", "selectionAlgorithm", "predictedEntityCategory", "entityCategoryConfidence", "technicalAccessibility", "allGleifCandidates",
    "discoveredRelationships", "domainEntityMappings",
]
ZERO_WHERE_EMPTY = ["gleif_candidate_count", "level2_candidates_count", "retry_count"]
LISTED = {"all_lei_codes": "lei_code", "all_legal_names": "legal_name", "all_jurisdictions": "jurisdiction", "all_entity_statuses": "entity_status"}
IN_ORDER = ["rank_position", "tie1", "tie2", "tie3"]
WIDE = ["id", *CSV_HEADER.values()]


def wide(spark: SparkSession, sf: str, domains: DataFrame) -> DataFrame:
    """The export's columns for some domains. Candidates become one row a domain before they join, their values in rank order."""
    asked = CANDIDATES.read(spark, sf).join(domains.select(F.col("id").alias("domain_id")), "domain_id", "left_semi")
    lists = asked.groupBy("domain_id").agg(F.count("*").alias("gleif_candidate_count"), F.array_sort(F.collect_list(F.struct(*IN_ORDER, *LISTED.values()))).alias("c"))
    names = ENTITIES.read(spark, sf).select(F.col("lei_code").alias("primary_lei_code"), F.col("legal_name").alias("primary_gleif_name"))
    rows = domains.join(DETAILS.read(spark, sf), "id").join(names, "primary_lei_code", "left").join(lists, F.col("id") == F.col("domain_id"), "left")
    texts = lambda v: F.array_join(F.transform("c", lambda x: x[v]), "; ")
    joined = {n: F.coalesce(texts(v), F.lit("")) for n, v in LISTED.items()}
    return rows.withColumns(joined).withColumn("gleif_candidate_count", F.coalesce("gleif_candidate_count", F.lit(0))).select(*WIDE)


WIDE_SQL = f"""SELECT d.id, {', '.join(f"coalesce(k.{n}, '') AS {n}" for n in LISTED)}, coalesce(k.n, 0) AS gleif_candidate_count, e.legal_name AS primary_gleif_name, {', '.join(f'd.{c}' for c in CSV_HEADER.values() if c in DOMAINS.columns)},
  {', '.join(f'x.{c}' for c in CSV_HEADER.values() if c in DETAILS.columns)} FROM {D} d JOIN {X} x ON d.id = x.id LEFT JOIN {E} e ON d.primary_lei_code = e.lei_code
  LEFT JOIN (SELECT domain_id, count(*) AS n, {', '.join(f"string_agg({v}, '; ' ORDER BY {', '.join(IN_ORDER)}) AS {n}" for n, v in LISTED.items())} FROM {C} c GROUP BY domain_id) k ON d.id = k.domain_id"""


@query("K1_K3_all_columns", WIDE_SQL)
def all_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The wide export of every domain."""
    return wide(spark, sf, DOMAINS.read(spark, sf))


def cell(name: str, kind: str) -> Column:
    """A value as the CSV shows it: times in ISO form, numbers without a fraction of zero, nothing for what counts as empty; always quoted."""
    value = F.col(name)
    if kind.startswith("timestamp"):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif kind == "string":
        text = value
    else:
        whole = F.when(value == F.floor(value), F.floor(value).cast("long").cast("string")).otherwise(value.cast("string"))
        text = F.when(value == 0, "0" if name in ZERO_WHERE_EMPTY else "").otherwise(whole)
    empty = F.lit("0" if name in ZERO_WHERE_EMPTY else "")
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, empty), F.lit('"'), F.lit('""')), F.lit('"'))


def _cell_sql(name: str) -> str:
    empty = "'0'" if name in ZERO_WHERE_EMPTY else "''"
    if name in ("created_at", "processed_at"):
        text = f"strftime({name}, '%Y-%m-%dT%H:%M:%S.%gZ')"
    elif name in ("confidence_score", "final_confidence", "processing_time_ms", *ZERO_WHERE_EMPTY):
        text = f"CASE WHEN {name} = 0 THEN {empty} WHEN {name} = floor({name}) THEN cast(cast({name} AS BIGINT) AS VARCHAR) ELSE cast({name} AS VARCHAR) END"
    else:
        text = name
    return f"""concat('"', replace(coalesce({text}, {empty}), '"', '""'), '"')"""


@query("K1_csv_export", f"SELECT id, concat_ws(',', {', '.join(map(_cell_sql, CSV_HEADER.values()))}) AS line FROM ({WIDE_SQL}) w WHERE id IN (SELECT id FROM {D} d WHERE batch_id = 'b4')")
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """A batch's lines of the CSV export, below a header of the 25 names."""
    rows = wide(spark, sf, DOMAINS.read(spark, sf).filter("batch_id = 'b4'"))
    kinds = dict(rows.dtypes)
    return rows.select("id", F.concat_ws(",", *[cell(c, kinds[c]) for c in CSV_HEADER.values()]).alias("line"))


CANDIDATE_FIELDS = {"leiCode": "lei_code", "legalName": "legal_name", "entityStatus": "entity_status", "jurisdiction": "jurisdiction", "legalForm": "legal_form", "registrationStatus": "registration_status", "weightedScore": "cast(weighted_score AS BIGINT)", "rankPosition": "rank_position"}
RELATION_FIELDS = {"parentLei": "parent_lei", "childLei": "child_lei", "relationshipType": "relationship_type", "relationshipConfidence": "relationship_confidence"}
ENTITY_FIELDS = {"legalName": "legal_name", "entityStatus": "entity_status", "jurisdiction": "jurisdiction", "legalForm": "legal_form", "entityCategory": "category", "registrationStatus": "registration_status", "headquartersCountry": "country", "headquartersCity": "city"}
#: Fields of the record that are columns of the stored rows.
PLAIN = {
    "domainId": "id", "domain": "domain", "batchId": "batch_id", "status": "status", "processingTimeMs": "processing_time_ms", "retryCount": "retry_count", "level1CompanyName": "company_name", "level1ExtractionMethod": "extraction_method",
    "level1Confidence": "confidence_score", "level1FailureCategory": "failure_category", "level1ErrorMessage": "error_message", "level1TechnicalDetails": "technical_details", "level1Recommendation": "recommendation", "guessedCountry": "guessed_country",
    "level2Attempted": "level2_attempted", "level2Status": "level2_status", "level2CandidatesCount": "level2_candidates_count", "level2ProcessingTimeMs": "level2_processing_time_ms", "primaryLeiCode": "primary_lei_code",
    "primarySelectionConfidence": "primary_selection_confidence", "selectionAlgorithm": "selection_algorithm", "selectionNotes": "selection_notes", "manualReviewRequired": "manual_review_required", "finalLegalName": "final_legal_name",
    "finalConfidence": "final_confidence", "finalExtractionMethod": "final_extraction_method", "predictedEntityCategory": "predicted_entity_category", "entityCategoryConfidence": "entity_category_confidence",
}
WHOLE_NUMBERS = ["confidence_score", "final_confidence"]
# Fields whose presence counts as completeness, one each of twenty, candidates three and relationships two.
COUNTED = ["domain", "status", "company_name", "extraction_method", "confidence_score", "processed_at", "level2_status", "primary_lei_code", "primary_gleif_name", "guessed_country", "final_legal_name", "final_confidence", "predicted_entity_category"]


def _case(branches: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{label}'" for test, label in branches) + f" ELSE '{otherwise}' END"


# Classifications in the common part of both languages; a zero final confidence counts as none.
BELIEF = "coalesce(nullif(final_confidence, 0), confidence_score)"
PRIORITY = _case(
    [
        ("contains(extraction_method, 'domain_mapping') AND confidence_score >= 95", "Fortune500"),
        ("entity_category = 'Corporation' AND jurisdiction IN ('US', 'GB', 'DE')", "Enterprise"),
        (f"primary_lei_code IS NOT NULL AND {BELIEF} >= 85", "Enterprise"),
        (f"{BELIEF} >= 70", "Mid-Market"),
        (f"company_name IS NOT NULL AND {BELIEF} >= 50", "SMB"),
    ],
    "Unknown",
)
READINESS = _case([("failure_category = 'Protected - Manual Review'", "Protected"), ("status = 'failed'", "Skip"), (f"primary_lei_code IS NOT NULL AND {BELIEF} >= 85", "Ready"), (f"{BELIEF} >= 70", "Good-Target")], "Research-Required")
ACCESS = _case(
    [("contains(failure_category, 'cloudflare') OR contains(failure_category, 'protected')", "Cloudflare"), ("contains(failure_category, 'bot') OR contains(technical_details, 'bot')", "Bot-Detection"), ("contains(failure_category, 'unreachable')", "Unreachable"), ("contains(failure_category, 'Protected')", "Protected")],
    "Open",
)
COMPLETENESS = (
    "cast(floor(("
    + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in COUNTED)
    + " + CASE WHEN processing_time_ms <> 0 THEN 1 ELSE 0 END + CASE WHEN level2_attempted THEN 1 ELSE 0 END + CASE WHEN n_candidates > 0 THEN 3 ELSE 0 END + CASE WHEN n_relations > 0 THEN 2 ELSE 0 END) * cast(5 AS double) + cast(0.5 AS double)) AS bigint)"
)
QUALITY = f"""cast(floor(coalesce({BELIEF}, 0) / cast(100 AS double) * 40 + CASE WHEN primary_lei_code IS NOT NULL AND primary_gleif_name IS NOT NULL THEN 30 WHEN n_candidates > 0 THEN 15 ELSE 0 END + completeness / cast(100 AS double) * 20
  + CASE WHEN status = 'success' THEN 10 WHEN status = 'failed' AND company_name IS NOT NULL THEN 5 ELSE 0 END + cast(0.5 AS double)) AS bigint)"""


def _struct(fields: dict[str, str]) -> Column:
    return F.struct(*[F.expr(v).alias(k) for k, v in fields.items()])


def records(spark: SparkSession, sf: str, domains: DataFrame) -> DataFrame:
    """The nested records of some domains: plain fields, candidates in rank order, relationships of the primary entity on either side, mappings of the domain, the entity itself, classifications, completeness and quality. Each kind
    of children is one row a key before it joins."""
    asked = CANDIDATES.read(spark, sf).join(domains.select(F.col("id").alias("domain_id")), "domain_id", "left_semi")
    of_domain = asked.groupBy("domain_id").agg(F.count("*").alias("n_candidates"), F.array_sort(F.collect_list(F.struct(*IN_ORDER, _struct(CANDIDATE_FIELDS).alias("x")))).alias("c"))
    edges = EDGES.read(spark, sf)
    sides = edges.withColumn("me", F.col("parent_lei")).unionByName(edges.withColumn("me", F.col("child_lei")).filter("parent_lei <> child_lei"))
    wanted = domains.select(F.col("primary_lei_code").alias("me")).filter("me IS NOT NULL").distinct()
    related = sides.join(wanted, "me", "left_semi").groupBy(F.col("me").alias("primary_lei_code")).agg(F.count("*").alias("n_relations"), F.array_sort(F.collect_list(_struct(RELATION_FIELDS))).alias("r"))
    names = domains.select(F.col("domain").alias("mapped")).distinct()
    all_of = DOMAINS.read(spark, sf).filter("primary_lei_code IS NOT NULL").select(F.col("domain").alias("mapped"), "primary_lei_code").join(names, "mapped", "left_semi")
    mapped = all_of.groupBy("mapped", "primary_lei_code").agg(F.count("*").alias("n")).groupBy("mapped").agg(F.array_sort(F.collect_list(F.struct(F.col("primary_lei_code").alias("leiCode"), F.col("n").alias("mappingFrequency")))).alias("m"))
    entity = ENTITIES.read(spark, sf).select(F.col("lei_code").alias("primary_lei_code"), F.col("legal_name").alias("primary_gleif_name"), F.col("category").alias("entity_category"), "jurisdiction", F.col("entity_status").alias("entity_status"), F.col("discovery_frequency").cast("long").alias("entity_frequency"), _struct(ENTITY_FIELDS).alias("entity"))
    rows = domains.join(DETAILS.read(spark, sf), "id").join(entity, "primary_lei_code", "left").join(related, "primary_lei_code", "left").join(of_domain, F.col("id") == F.col("domain_id"), "left").join(mapped, F.col("domain") == F.col("mapped"), "left")
    rows = rows.withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0)), "n_relations": F.coalesce("n_relations", F.lit(0))}).withColumn("completeness", F.expr(COMPLETENESS))
    plain = {k: F.col(v).cast("long") if v in WHOLE_NUMBERS else F.col(v) for k, v in PLAIN.items()}
    none = lambda c: F.coalesce(c, F.array())
    fields = plain | {
        "primaryGleifName": F.col("primary_gleif_name"), "jurisdiction": F.col("jurisdiction"), "entityStatus": F.col("entity_status"), "entityFrequency": F.col("entity_frequency"), "businessPriority": F.expr(PRIORITY), "acquisitionReadiness": F.expr(READINESS),
        "technicalAccessibility": F.expr(ACCESS), "dataCompleteness": F.col("completeness"), "qualityScore": F.expr(QUALITY), "allGleifCandidates": none(F.transform("c", lambda x: x["x"])), "discoveredRelationships": none(F.col("r")),
        "domainEntityMappings": none(F.col("m")), "gleifEntityData": F.col("entity"), "exportVersion": F.lit("1.0"),
    }
    return rows.select(*[c.alias(k) for k, c in fields.items()])


def _records_sql(where: str) -> str:
    json_of = lambda fields, t="": "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"
    plain = ", ".join(f'cast({v} AS BIGINT) AS "{k}"' if v in WHOLE_NUMBERS else f'{v} AS "{k}"' for k, v in PLAIN.items())
    sides = f"SELECT *, parent_lei AS me FROM {R} r UNION ALL SELECT *, child_lei FROM {R} r2 WHERE parent_lei <> child_lei"
    return f"""(SELECT {plain}, primary_gleif_name AS "primaryGleifName", jurisdiction, entity_status AS "entityStatus", entity_frequency AS "entityFrequency", {PRIORITY} AS "businessPriority", {READINESS} AS "acquisitionReadiness", {ACCESS} AS "technicalAccessibility",
      completeness AS "dataCompleteness", {QUALITY} AS "qualityScore", coalesce(c, []) AS "allGleifCandidates", coalesce(r, []) AS "discoveredRelationships", coalesce(m, []) AS "domainEntityMappings", entity AS "gleifEntityData", '1.0' AS "exportVersion"
      FROM (SELECT *, {COMPLETENESS} AS completeness FROM (SELECT d.*, x.* EXCLUDE (id), e.legal_name AS primary_gleif_name, e.category AS entity_category, e.jurisdiction, e.entity_status, e.discovery_frequency::BIGINT AS entity_frequency, coalesce(k.n, 0) AS n_candidates, k.c, coalesce(l.n, 0) AS n_relations, l.r, q.m,
        CASE WHEN e.lei_code IS NOT NULL THEN {json_of({a: f'e.{b}' for a, b in ENTITY_FIELDS.items()})} END AS entity
        FROM {D} d JOIN {X} x ON d.id = x.id LEFT JOIN {E} e ON d.primary_lei_code = e.lei_code
        LEFT JOIN (SELECT domain_id, count(*) AS n, list({json_of(CANDIDATE_FIELDS)} ORDER BY {', '.join(IN_ORDER)}) AS c FROM {C} c GROUP BY domain_id) k ON d.id = k.domain_id
        LEFT JOIN (SELECT me, count(*) AS n, list_sort(list({json_of(RELATION_FIELDS)})) AS r FROM ({sides}) s GROUP BY me) l ON d.primary_lei_code = l.me
        LEFT JOIN (SELECT domain, list_sort(list({{'leiCode': primary_lei_code, 'mappingFrequency': n}})) AS m FROM (SELECT domain, primary_lei_code, count(*) AS n FROM {D} y WHERE primary_lei_code IS NOT NULL GROUP BY ALL) z GROUP BY domain) q ON d.domain = q.domain
        WHERE {where}) j) o)"""


def _as_json(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.select(F.col("domainId").alias("id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


def _json_sql(fields: list[str], where: str) -> str:
    return f"""SELECT "domainId" AS id, cast(to_json({{{', '.join(f"'{f}': \"{f}\"" for f in fields)}}}) AS VARCHAR) AS record FROM {_records_sql(where)} t"""


RECORD_FIELDS = [*PLAIN, "primaryGleifName", "jurisdiction", "entityStatus", "entityFrequency", "businessPriority", "acquisitionReadiness", "technicalAccessibility", "dataCompleteness", "qualityScore", "allGleifCandidates", "discoveredRelationships", "domainEntityMappings", "gleifEntityData", "exportVersion"]


@query("K5_J15_full_records", _json_sql(RECORD_FIELDS, "d.batch_id = 'b0'"))
def full_records(spark: SparkSession, sf: str) -> DataFrame:
    """A batch's nested records with all their children."""
    return _as_json(records(spark, sf, DOMAINS.read(spark, sf).filter("batch_id = 'b0'")), RECORD_FIELDS)


@query("K8_default_preset", f"""SELECT "domainId" AS id, {', '.join(f'"{f}"' for f in DEFAULT_FIELDS)} FROM {_records_sql('true')} t""")
def default_preset(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve default fields of every domain."""
    return records(spark, sf, DOMAINS.read(spark, sf)).select(F.col("domainId").alias("id"), *DEFAULT_FIELDS)


@query("K8_comprehensive_preset", _json_sql(COMPREHENSIVE_FIELDS, "d.batch_id = 'b4'"))
def comprehensive_preset(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty-three fields of the comprehensive preset, a batch's."""
    return _as_json(records(spark, sf, DOMAINS.read(spark, sf).filter("batch_id = 'b4'")), COMPREHENSIVE_FIELDS)


# --- what a claim is made from -------------------------------------------------------------------------------------------

TITLE = r"(?i)<title[^>]*>([^<]*)</title>"
HEADING = r"(?is)<h1[^>]*>(.*?)</h1>"


def claim_inputs(dumps: DataFrame, processed: DataFrame, cleaned: DataFrame) -> DataFrame:
    """``dump_id, source_type, domain, title, entity_name, origin``: for each dump the newest processing result with a name; where there is none its latest cleaning result, even one without a name; where there is none of either the
    page's own first heading, the cleaned page of old. A dump without any keeps a null."""
    keys = ["source_type", "source_id"]
    named = processed.filter("entity_name IS NOT NULL AND entity_name <> ''").groupBy(*keys).agg(F.max_by("entity_name", F.struct("created_seq", "result_id")).alias("processed_name"))
    latest = cleaned.groupBy(*keys).agg(F.max_by(F.struct("entity_name"), "result_id").alias("cleaning"))
    heading = F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", HEADING, 1), r"<[^>]*>", " ")), F.lit(""))
    rows = dumps.select(F.col("dump_id"), F.col("source_type"), F.col("dump_id").alias("source_id"), "domain", F.nullif(F.regexp_extract("html", TITLE, 1), F.lit("")).alias("title"), heading.alias("heading"))
    rows = rows.join(named, keys, "left").join(latest, keys, "left")
    name = F.when(F.col("processed_name").isNotNull(), F.col("processed_name")).when(F.col("cleaning").isNotNull(), F.col("cleaning.entity_name")).otherwise(F.col("heading"))
    origin = F.when(F.col("processed_name").isNotNull(), "processing").when(F.col("cleaning").isNotNull(), "cleaning").when(F.col("heading").isNotNull(), "page").otherwise("none")
    return rows.select("dump_id", "source_type", "domain", "title", name.alias("entity_name"), origin.alias("origin"))


_CLAIMS_SQL = f"""(SELECT p.dump_id, p.source_type, p.domain, p.created_seq, nullif(regexp_extract(p.html, '{TITLE}', 1), '') AS title, CASE WHEN n.name IS NOT NULL THEN n.name WHEN c.k IS NOT NULL THEN c.name ELSE p.heading END AS entity_name,
  CASE WHEN n.name IS NOT NULL THEN 'processing' WHEN c.k IS NOT NULL THEN 'cleaning' WHEN p.heading IS NOT NULL THEN 'page' ELSE 'none' END AS origin
  FROM (SELECT *, nullif(trim(regexp_replace(regexp_extract(html, '{HEADING}', 1), '<[^>]*>', ' ', 'g')), '') AS heading FROM {P} p0) p
  LEFT JOIN (SELECT source_type, source_id, arg_max(entity_name, {{'t': created_seq, 'i': result_id}}) AS name FROM {PROCESSED.sql} r WHERE entity_name <> '' GROUP BY ALL) n ON p.source_type = n.source_type AND p.dump_id = n.source_id
  LEFT JOIN (SELECT source_type, source_id, result_id AS k, entity_name AS name FROM {CLEANED.sql} r QUALIFY row_number() OVER (PARTITION BY source_type, source_id ORDER BY result_id DESC) = 1) c ON p.source_type = c.source_type AND p.dump_id = c.source_id)"""


@query("S22_claim_fallbacks", f"SELECT dump_id, source_type, domain, title, entity_name, origin FROM {_CLAIMS_SQL} x")
def claim_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """What each dump's claims are made from."""
    return claim_inputs(DUMPS.read(spark, sf), PROCESSED.read(spark, sf), CLEANED.read(spark, sf))


@query("S23_batch_claims", f"SELECT domain, dump_id, title, entity_name, origin FROM {_CLAIMS_SQL} x QUALIFY row_number() OVER (PARTITION BY domain ORDER BY created_seq DESC, dump_id) = 1")
def batch_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form: the newest dump of each domain, with the same fallbacks. The original's batch form read raw fields only."""
    newest = DUMPS.read(spark, sf).groupBy("domain").agg(F.max_by("dump_id", F.struct("created_seq", -F.col("dump_id"))).alias("dump_id"))
    chosen = DUMPS.read(spark, sf).join(newest.select("dump_id"), "dump_id", "left_semi")
    return claim_inputs(chosen, PROCESSED.read(spark, sf), CLEANED.read(spark, sf)).select("domain", "dump_id", "title", "entity_name", "origin")
