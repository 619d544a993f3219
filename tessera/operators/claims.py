"""Claims about which entity owns a domain: normalisation, deduplication, arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.compat import js_round
from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, ENTITIES, MODELS

D, C, E, M = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql, MODELS.sql
AS_OF = "2001-11-01"
# Grades by score, and what a claim's score adds up from.
GRADES = ((0.9, "A+"), (0.8, "A"), (0.7, "B+"), (0.6, "B"))
PARENT, NOT_PARENT, ACTIVE, FORM, RECENT, OLD = 1.0, 0.7, 0.2, 0.1, 1.0, 0.5
BASE_SHARE, BIAS_SHARE, FOCUS, EXCLUDED = 0.7, 0.3, 0.2, -0.5
STEP = 0.15

#: Claims: claim 0 is what extraction found, the others are candidates in rank order. Codes are broken and confidences given in two scales, as in raw input.
CLAIMS_SQL = f"""(SELECT domain_id, rank_position AS claim_number, CASE WHEN tie2 % 9 = 0 THEN substr(lei_code, 1, 18) WHEN tie2 % 10 = 0 THEN NULL ELSE lei_code END AS lei_code, legal_name AS entity_name,
  CASE WHEN tie1 % 8 = 0 THEN NULL WHEN tie1 % 2 = 0 THEN weighted_score ELSE weighted_score / 100 END AS raw_confidence, CASE WHEN tie1 % 3 = 0 THEN 'gleif_verified' ELSE NULL END AS raw_type, jurisdiction, entity_status, legal_form, found_at, tie1, tie2, tie3 FROM {C} c)"""


def claims(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("tie2") % 9 == 0, F.substring("lei_code", 1, 18)).when(F.col("tie2") % 10 != 0, F.col("lei_code"))
    confidence = F.when(F.col("tie1") % 8 == 0, None).when(F.col("tie1") % 2 == 0, F.col("weighted_score")).otherwise(F.col("weighted_score") / 100)
    return CANDIDATES.read(spark, sf).select("domain_id", F.col("rank_position").alias("claim_number"), code.alias("lei_code"), F.col("legal_name").alias("entity_name"), confidence.alias("raw_confidence"), F.when(F.col("tie1") % 3 == 0, "gleif_verified").alias("raw_type"), "jurisdiction", "entity_status", "legal_form", "found_at", "tie1", "tie2", "tie3")


def normal_confidence(x: Column) -> Column:
    """Above one it is a percentage; missing it is one half; at most one."""
    return F.least(F.lit(1.0), F.coalesce(F.when(x > 1, x / 100).otherwise(x), F.lit(0.5)))


def valid_lei(x: Column) -> Column:
    return F.coalesce(x.rlike("^[A-Z0-9]{20}$"), F.lit(False))


CONFIDENCE_SQL = "least(1.0, coalesce(CASE WHEN raw_confidence > 1 THEN raw_confidence / 100 ELSE raw_confidence END, 0.5))"


@query(
    "X60_normal_claims",
    f"""SELECT domain_id, claim_number, tie1, tie3, CASE WHEN regexp_matches(lei_code, '^[A-Z0-9]{{20}}$') THEN lei_code END AS lei_code, {CONFIDENCE_SQL} AS confidence,
        coalesce(raw_type, CASE WHEN regexp_matches(lei_code, '^[A-Z0-9]{{20}}$') THEN 'gleif_candidate' ELSE 'llm_extracted' END) AS claim_type FROM {CLAIMS_SQL} c""",
)
def normal_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Codes that are no codes vanish, confidences take one scale, missing types follow from what is there."""
    code = F.when(valid_lei(F.col("lei_code")), F.col("lei_code"))
    kind = F.coalesce("raw_type", F.when(code.isNotNull(), "gleif_candidate").otherwise("llm_extracted"))
    return claims(spark, sf).select("domain_id", "claim_number", "tie1", "tie3", code.alias("lei_code"), normal_confidence(F.col("raw_confidence")).alias("confidence"), kind.alias("claim_type"))


@query(
    "X61_deduplicated_claims",
    f"""SELECT domain_id, k, confidence FROM (SELECT domain_id, k, confidence, row_number() OVER (PARTITION BY domain_id, k ORDER BY CASE WHEN is_code THEN confidence ELSE 0 END DESC, claim_number, tie1, tie2, tie3) AS rn
        FROM (SELECT *, {CONFIDENCE_SQL} AS confidence, coalesce(regexp_matches(lei_code, '^[A-Z0-9]{{20}}$'), false) AS is_code, CASE WHEN coalesce(regexp_matches(lei_code, '^[A-Z0-9]{{20}}$'), false) THEN lei_code ELSE lower(trim(entity_name)) END AS k FROM {CLAIMS_SQL} c) x) y WHERE rn = 1""",
)
def deduplicated_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Of one code the most confident claim stays, of one name the first."""
    is_code = valid_lei(F.col("lei_code"))
    rows = claims(spark, sf).withColumn("confidence", normal_confidence(F.col("raw_confidence"))).withColumn("is_code", is_code).withColumn("k", F.when(is_code, F.col("lei_code")).otherwise(F.lower(F.trim("entity_name"))))
    w = Window.partitionBy("domain_id", "k").orderBy(F.desc(F.when(F.col("is_code"), F.col("confidence")).otherwise(0.0)), "claim_number", "tie1", "tie2", "tie3")
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("domain_id", "k", "confidence")


@query("A31_normalisation_stats", f"SELECT count(*) AS total, count(*) FILTER (regexp_matches(lei_code, '^[A-Z0-9]{{20}}$')) AS with_code, count(*) FILTER (lei_code IS NOT NULL AND NOT regexp_matches(lei_code, '^[A-Z0-9]{{20}}$')) AS broken, count(*) FILTER (raw_confidence IS NULL) AS without_confidence FROM {CLAIMS_SQL} c")
def normalisation_stats(spark: SparkSession, sf: str) -> DataFrame:
    ok = valid_lei(F.col("lei_code"))
    return claims(spark, sf).agg(F.count("*").alias("total"), F.count_if(ok).alias("with_code"), F.count_if(F.col("lei_code").isNotNull() & ~ok).alias("broken"), F.count_if(F.col("raw_confidence").isNull()).alias("without_confidence"))


def grade(score: Column) -> Column:
    """By the score before it is capped."""
    out = F.lit("C")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


ARBITRATION_SQL = f"""(SELECT *, ({CONFIDENCE_SQL} + CASE WHEN tie2 % 2 = 0 THEN {PARENT}::DOUBLE ELSE {NOT_PARENT}::DOUBLE END + CASE WHEN entity_status = 'ACTIVE' THEN {ACTIVE}::DOUBLE ELSE 0 END + CASE WHEN legal_form = 'PJ10' THEN {FORM}::DOUBLE ELSE 0 END
  + CASE WHEN found_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY THEN {RECENT}::DOUBLE ELSE {OLD}::DOUBLE END) / 3.3::DOUBLE AS score FROM {CLAIMS_SQL} c)"""


def arbitrated(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence, place in the group, standing, form and age; the jurisdiction bonus is one application's only and stays out."""
    total = (
        normal_confidence(F.col("raw_confidence"))
        + F.when(F.col("tie2") % 2 == 0, PARENT).otherwise(NOT_PARENT)
        + F.when(F.col("entity_status") == "ACTIVE", ACTIVE).otherwise(0.0)
        + F.when(F.col("legal_form") == "PJ10", FORM).otherwise(0.0)
        + F.when(F.expr(f"found_at >= timestamp'{AS_OF}' - INTERVAL 365 DAYS"), RECENT).otherwise(OLD)
    )
    return claims(spark, sf).withColumn("score", total / 3.3)


@query(
    "X66_X68_W3_arbitration",
    f"""SELECT domain_id, tie1, tie2, tie3, rn, floor(score * 10000 + 0.5) / 10000 AS score, CASE {' '.join(f"WHEN score >= {s}::DOUBLE THEN '{g}'" for s, g in GRADES)} ELSE 'C' END AS grade
        FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY score DESC, claim_number, tie1, tie2, tie3) AS rn FROM {ARBITRATION_SQL} a) x WHERE rn <= 5""",
)
def arbitration(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("domain_id").orderBy(F.desc("score"), "claim_number", "tie1", "tie2", "tie3")
    best = arbitrated(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    return best.select("domain_id", "tie1", "tie2", "tie3", "rn", js_round(F.col("score"), 4).alias("score"), grade(F.col("score")).alias("grade"))


BIAS_SQL = f"({BASE_SHARE}::DOUBLE * score + {BIAS_SHARE}::DOUBLE * (CASE WHEN jurisdiction = 'US' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN legal_form = 'PJ10' THEN {FOCUS}::DOUBLE WHEN legal_form = '5WWO' THEN {EXCLUDED}::DOUBLE ELSE 0 END))"


@query(
    "X67_W4_bias_blend",
    f"SELECT domain_id, tie1, tie2, tie3, floor(blended * 10000 + 0.5) / 10000 AS blended, row_number() OVER (PARTITION BY domain_id ORDER BY blended DESC, claim_number, tie1, tie2, tie3) AS rn FROM (SELECT *, {BIAS_SQL} AS blended FROM {ARBITRATION_SQL} a) x",
)
def bias_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Claims ranked anew after the user's preferences take their share."""
    bias = F.when(F.col("jurisdiction") == "US", 1.0).otherwise(0.4) + F.when(F.col("legal_form") == "PJ10", FOCUS).when(F.col("legal_form") == "5WWO", EXCLUDED).otherwise(0.0)
    rows = arbitrated(spark, sf).withColumn("blended", BASE_SHARE * F.col("score") + BIAS_SHARE * bias)
    w = Window.partitionBy("domain_id").orderBy(F.desc("blended"), "claim_number", "tie1", "tie2", "tie3")
    return rows.select("domain_id", "tie1", "tie2", "tie3", js_round(F.col("blended"), 4).alias("blended"), F.row_number().over(w).alias("rn"))


@query("J16_ranked_with_claims", f"SELECT r.domain_id, r.rn, r.tie1, r.tie3, coalesce(c.raw_confidence, 1 - (r.rn - 1) * {STEP}::DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY claim_number, tie1, tie2, tie3) AS rn FROM {CLAIMS_SQL} x) r LEFT JOIN (SELECT domain_id, tie1, tie2, tie3, max(raw_confidence) AS raw_confidence FROM {CLAIMS_SQL} y WHERE raw_confidence <= 1 GROUP BY ALL) c ON r.domain_id = c.domain_id AND r.tie1 = c.tie1 AND r.tie2 = c.tie2 AND r.tie3 = c.tie3")
def ranked_with_claims(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking's entries take their claim's confidence, or one that falls with the rank."""
    keys = ["domain_id", "tie1", "tie2", "tie3"]
    rows = claims(spark, sf)
    rank = rows.withColumn("rn", F.row_number().over(Window.partitionBy("domain_id").orderBy("claim_number", "tie1", "tie2", "tie3"))).select(*keys, "rn")
    known = rows.filter("raw_confidence <= 1").groupBy(*keys).agg(F.max("raw_confidence").alias("raw_confidence"))
    return rank.join(known, keys, "left").select("domain_id", "rn", "tie1", "tie3", F.coalesce("raw_confidence", 1 - (F.col("rn") - 1) * STEP).alias("confidence"))


@query(
    "X32_claim_confidence",
    f"SELECT domain_id, claim_number, tie1, tie3, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN tie2 % 2 = 0 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN entity_status = 'ACTIVE' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN legal_form = 'PJ10' THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN found_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY THEN 0.05::DOUBLE ELSE 0 END) AS confidence FROM {CLAIMS_SQL} c",
)
def claim_confidence(spark: SparkSession, sf: str) -> DataFrame:
    total = F.lit(0.5) + F.when(F.col("tie2") % 2 == 0, 0.3).otherwise(0.2) + F.when(F.col("entity_status") == "ACTIVE", 0.1).otherwise(0.0) + F.when(F.col("legal_form") == "PJ10", 0.05).otherwise(0.0) + F.when(F.expr(f"found_at >= timestamp'{AS_OF}' - INTERVAL 365 DAYS"), 0.05).otherwise(0.0)
    return claims(spark, sf).select("domain_id", "claim_number", "tie1", "tie3", F.least(F.lit(1.0), total).alias("confidence"))


@query(
    "X65_claim_zero",
    f"SELECT id, coalesce(company_name, CASE WHEN primary_lei_code IS NOT NULL THEN 'registry' END, domain) AS entity, CASE WHEN company_name IS NOT NULL AND confidence_score >= 70 THEN 0.9 WHEN company_name IS NOT NULL THEN 0.8 WHEN primary_lei_code IS NOT NULL THEN 0.7 ELSE 0.5 END AS confidence FROM {D} d",
)
def claim_zero(spark: SparkSession, sf: str) -> DataFrame:
    """What extraction itself says, by how it knows."""
    name, lei = F.col("company_name").isNotNull(), F.col("primary_lei_code").isNotNull()
    confidence = F.when(name & (F.col("confidence_score") >= 70), 0.9).when(name, 0.8).when(lei, 0.7).otherwise(0.5)
    return DOMAINS.read(spark, sf).select("id", F.coalesce("company_name", F.when(lei, "registry"), "domain").alias("entity"), confidence.alias("confidence"))


@query(
    "U3_assembled_claims",
    f"""SELECT domain_id, row_number() OVER (PARTITION BY domain_id ORDER BY part, pos, t1, t3) - 1 AS claim_number, entity FROM (SELECT id AS domain_id, 0 AS part, 0 AS pos, coalesce(company_name, domain) AS entity, 0 AS t1, 0 AS t3 FROM {D} d WHERE batch_id = 'b5'
        UNION ALL SELECT c.domain_id, 1, c.rank_position, c.legal_name, c.tie1, c.tie3 FROM {C} c JOIN {D} d ON c.domain_id = d.id WHERE d.batch_id = 'b5') x""",
)
def assembled_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The base claim, then the registry's, numbered through."""
    batch = DOMAINS.read(spark, sf).filter("batch_id = 'b5'")
    base = batch.select(F.col("id").alias("domain_id"), F.lit(0).alias("part"), F.lit(0).alias("pos"), F.coalesce("company_name", "domain").alias("entity"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t3"))
    found = CANDIDATES.read(spark, sf).join(batch.select(F.col("id").alias("domain_id")), "domain_id").select("domain_id", F.lit(1), F.col("rank_position"), "legal_name", "tie1", "tie3")
    w = Window.partitionBy("domain_id").orderBy("part", "pos", "t1", "t3")
    return base.unionAll(found).select("domain_id", (F.row_number().over(w) - 1).alias("claim_number"), "entity")


@query(
    "X63_search_patterns",
    f"""SELECT lei_code, unnest(list_distinct([legal_name, regexp_replace(legal_name, '\\s+(Inc|GmbH|Holding)$', ''), concat(regexp_replace(legal_name, '\\s+(Inc|GmbH|Holding)$', ''), ' Holdings'), concat(regexp_replace(legal_name, '\\s+(Inc|GmbH|Holding)$', ''), ' International'), string_split(legal_name, ' ')[1]])) AS pattern FROM {E} e""",
)
def search_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Names to search for: as it is, without its ending, with the endings of groups, and its first word."""
    bare = F.regexp_replace("legal_name", r"\s+(Inc|GmbH|Holding)$", "")
    patterns = F.array_distinct(F.array("legal_name", bare, F.concat(bare, F.lit(" Holdings")), F.concat(bare, F.lit(" International")), F.element_at(F.split("legal_name", " "), 1)))
    return ENTITIES.read(spark, sf).select("lei_code", F.explode(patterns).alias("pattern"))


@query("X70_citations", "SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(concat(text, ' [', turn % 7, '] [', conv_id % 5, '] [', turn % 7, ']'), '\\[([0-9]+)\\]', 1))) AS cited FROM conversations WHERE role = 'assistant'")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in brackets, once each."""
    text = F.concat("text", F.lit(" ["), (F.col("turn") % 7).cast("string"), F.lit("] ["), (F.col("conv_id") % 5).cast("string"), F.lit("] ["), (F.col("turn") % 7).cast("string"), F.lit("]"))
    turns = spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'assistant'")
    return turns.select("conv_id", "turn", F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)))).alias("cited"))


@query("X48_json_repair", f"SELECT id, regexp_replace(regexp_extract(concat('```json\n{{\"name\": \"', domain, '\", \"n\": ', id, ',}}\n``` thanks'), '\\{{.*\\}}', 0), ',\\s*\\}}', '}}') AS repaired FROM {D} d")
def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """The braces of a model's answer, without fences and trailing commas."""
    answer = F.concat(F.lit('```json\n{"name": "'), "domain", F.lit('", "n": '), F.col("id").cast("string"), F.lit(",}\n``` thanks"))
    return DOMAINS.read(spark, sf).select("id", F.regexp_replace(F.regexp_extract(answer, r"\{.*\}", 0), r",\s*\}", "}").alias("repaired"))


@query("X50_model_costs", f"SELECT extraction_method, sum(processing_time_ms) * p.price / 1000 AS cost FROM {D} d JOIN (VALUES ('footer_copyright', 0.2), ('html_title', 0.5), ('meta_property', 1.5)) p(model, price) ON d.extraction_method = p.model GROUP BY extraction_method, p.price")
def model_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Usage at each model's price; the price list comes with the call."""
    prices = spark.createDataFrame([("footer_copyright", 0.2), ("html_title", 0.5), ("meta_property", 1.5)], "extraction_method string, price double")
    used = DOMAINS.read(spark, sf).groupBy("extraction_method").agg(F.sum("processing_time_ms").alias("used"))
    return used.join(F.broadcast(prices), "extraction_method").select("extraction_method", (F.col("used") * F.col("price") / 1000).alias("cost"))


@query("O8_O10_method_choice", f"SELECT model, price FROM {M} m WHERE enabled ORDER BY price, model LIMIT 3")
def method_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The three cheapest that are enabled."""
    return MODELS.read(spark, sf).filter("enabled").orderBy("price", "model").limit(3).select("model", "price")


@query("O8_consensus_choice", f"SELECT provider, model, place FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY accuracy DESC, price, model) AS place FROM {M} m WHERE enabled) x WHERE place <= 3")
def consensus_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Of each provider the three models that a consensus asks: the most accurate, then the cheaper ones."""
    w = Window.partitionBy("provider").orderBy(F.desc("accuracy"), "price", "model")
    return MODELS.read(spark, sf).filter("enabled").withColumn("place", F.row_number().over(w)).filter("place <= 3").select("provider", "model", F.col("place").cast("long").alias("place"))


@query("O8_provider_cheapest", f"SELECT provider, arg_min(model, {{'p': price, 'm': model}}) AS cheapest, min(price) AS price, arg_min(model, {{'p': priority, 'm': model}}) AS preferred FROM {M} m WHERE enabled GROUP BY provider")
def provider_cheapest(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest enabled model of each provider, and the one of the highest priority."""
    per = MODELS.read(spark, sf).filter("enabled").groupBy("provider")
    return per.agg(F.min_by("model", F.struct("price", "model")).alias("cheapest"), F.min("price").alias("price"), F.min_by("model", F.struct("priority", "model")).alias("preferred"))


@query("O10_by_priority", f"SELECT model, priority FROM {M} m WHERE enabled ORDER BY priority, model")
def by_priority(spark: SparkSession, sf: str) -> DataFrame:
    """All enabled ones in the order in which they are tried."""
    return MODELS.read(spark, sf).filter("enabled").select("model", "priority").orderBy("priority", "model")


@query("W9_smoke_winner", f"SELECT domain, CASE WHEN count(*) > 1 THEN 'Tie' ELSE max(extraction_method) END AS winner FROM (SELECT domain, extraction_method, s, max(s) OVER (PARTITION BY domain) AS best FROM (SELECT domain, extraction_method, max(coalesce(confidence_score, 0) + CASE WHEN processing_time_ms < 2000 THEN 10 ELSE 0 END) AS s FROM {D} d GROUP BY domain, extraction_method) x) y WHERE s = best GROUP BY domain")
def smoke_winner(spark: SparkSession, sf: str) -> DataFrame:
    """The method of the best score with its speed bonus; several of them tie."""
    score = F.coalesce("confidence_score", F.lit(0.0)) + F.when(F.col("processing_time_ms") < 2000, 10).otherwise(0)
    per = DOMAINS.read(spark, sf).groupBy("domain", "extraction_method").agg(F.max(score).alias("s"))
    best = per.withColumn("best", F.max("s").over(Window.partitionBy("domain"))).filter("s = best")
    return best.groupBy("domain").agg(F.when(F.count("*") > 1, "Tie").otherwise(F.max("extraction_method")).alias("winner"))


@query("X57_failure_class", f"SELECT id, CASE WHEN error_message LIKE '%timeout%' THEN 'timeout' WHEN error_message LIKE '%ENOTFOUND%' THEN 'dns' WHEN error_message LIKE '%403%' THEN 'protected' WHEN company_name IS NOT NULL THEN 'incomplete' ELSE 'unknown' END AS class FROM {D} d WHERE status = 'failed'")
def failure_class(spark: SparkSession, sf: str) -> DataFrame:
    error = F.coalesce("error_message", F.lit(""))
    kind = F.when(error.contains("timeout"), "timeout").when(error.contains("ENOTFOUND"), "dns").when(error.contains("403"), "protected").when(F.col("company_name").isNotNull(), "incomplete").otherwise("unknown")
    return DOMAINS.read(spark, sf).filter("status = 'failed'").select("id", kind.alias("class"))
