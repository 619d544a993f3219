"""Exports and changes of stored tables. Parquet has no UPDATE: a change is a new snapshot, built from the old one and a delta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.relational import BEST, ranked
from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, DUMPS, EDGES, ENTITIES, LOG

D, C, E, R, G, P = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql, EDGES.sql, LOG.sql, DUMPS.sql
# The presets of export fields that have a column here.
DEFAULT_FIELDS = ["id", "domain", "company_name", "status", "confidence_score", "extraction_method", "primary_lei_code"]
COMPREHENSIVE_FIELDS = [*DEFAULT_FIELDS, "batch_id", "guessed_country", "processing_time_ms", "failure_category", "retry_count", "level2_attempted", "level2_status", "level2_candidates_count", "manual_review_required"]


@query("K1_K3_wide_export", f"SELECT {', '.join(COMPREHENSIVE_FIELDS)} FROM {D} d WHERE batch_id = 'b4' ORDER BY id")
def wide_export(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("batch_id = 'b4'").select(*COMPREHENSIVE_FIELDS).orderBy("id")


@query("K8_default_fields", f"SELECT {', '.join(DEFAULT_FIELDS)} FROM {D} d WHERE batch_id = 'b4'")
def default_fields(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("batch_id = 'b4'").select(*DEFAULT_FIELDS)


@query(
    "K2_K4_normalised_export",
    f"""SELECT d.id, d.domain, coalesce(string_agg(c.lei_code, '; ' ORDER BY c.rn), '') AS lei_codes, coalesce(string_agg(c.legal_name, '; ' ORDER BY c.rn), '') AS legal_names FROM {D} d
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY {BEST}) AS rn FROM {C} x) c ON d.id = c.domain_id WHERE d.batch_id = 'b2' GROUP BY d.id, d.domain""",
)
def normalised_export(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates in rank order, repeated ones too."""
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", c))), lambda x: x[c]), "; ")
    domains = DOMAINS.read(spark, sf).filter("batch_id = 'b2'")
    asked = CANDIDATES.read(spark, sf).join(domains.select(F.col("id").alias("domain_id")), "domain_id", "left_semi")  # others' candidates are not sorted
    lists = ranked(asked).groupBy("domain_id").agg(in_order("lei_code").alias("lei_codes"), in_order("legal_name").alias("legal_names"))
    joined = domains.join(lists, F.col("id") == F.col("domain_id"), "left")
    return joined.select("id", "domain", F.coalesce("lei_codes", F.lit("")).alias("lei_codes"), F.coalesce("legal_names", F.lit("")).alias("legal_names"))


@query(
    "K5_J15_nested_export",
    f"""SELECT d.id, cast(to_json({{'domain': d.domain, 'candidates': coalesce(c.n, 0), 'best': c.best, 'entity': e.legal_name, 'relationships': coalesce(r.n, 0)}}) AS VARCHAR) AS record FROM {D} d
        LEFT JOIN (SELECT domain_id, count(*) AS n, max(cast(weighted_score AS BIGINT)) AS best FROM {C} x GROUP BY domain_id) c ON d.id = c.domain_id LEFT JOIN {E} e ON d.primary_lei_code = e.lei_code
        LEFT JOIN (SELECT parent_lei, count(*) AS n FROM {R} y GROUP BY parent_lei) r ON d.primary_lei_code = r.parent_lei WHERE d.batch_id = 'b0'""",
)
def nested_export(spark: SparkSession, sf: str) -> DataFrame:
    """Each enrichment is aggregated to one row a key before its left join."""
    domains = DOMAINS.read(spark, sf).filter("batch_id = 'b0'")
    asked = CANDIDATES.read(spark, sf).join(domains.select(F.col("id").alias("domain_id")), "domain_id", "left_semi")
    found = asked.groupBy("domain_id").agg(F.count("*").alias("n"), F.max(F.col("weighted_score").cast("long")).alias("best"))
    names = ENTITIES.read(spark, sf).select(F.col("lei_code").alias("primary_lei_code"), F.col("legal_name").alias("entity"))
    related = EDGES.read(spark, sf).groupBy(F.col("parent_lei").alias("primary_lei_code")).agg(F.count("*").alias("m"))
    rows = domains.join(found, F.col("id") == F.col("domain_id"), "left").join(names, "primary_lei_code", "left").join(related, "primary_lei_code", "left")
    record = F.struct("domain", F.coalesce("n", F.lit(0)).alias("candidates"), "best", "entity", F.coalesce("m", F.lit(0)).alias("relationships"))
    return rows.select("id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


@query("K6_csv_lines", f"SELECT id, concat(id, ',', CASE WHEN contains(coalesce(company_name, ''), ' ') THEN concat('\"', replace(company_name, '\"', '\"\"'), '\"') ELSE coalesce(company_name, '') END, ',', coalesce(cast(cast(confidence_score AS BIGINT) AS VARCHAR), '')) AS line FROM {D} d WHERE batch_id = 'b9'")
def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Cells quoted only where they hold a separator."""
    name = F.coalesce("company_name", F.lit(""))
    cell = F.when(name.rlike('[ ,"\n]'), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(name)
    return DOMAINS.read(spark, sf).filter("batch_id = 'b9'").select("id", F.concat_ws(",", F.col("id").cast("string"), cell, F.coalesce(F.col("confidence_score").cast("long").cast("string"), F.lit(""))).alias("line"))


@query("K10_update_by_key", f"SELECT id, CASE WHEN id % 13 = 0 THEN 'success' ELSE status END AS status FROM {D} d")
def update_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot overlaid with a delta of changed rows."""
    rows = DOMAINS.read(spark, sf).select("id", "status")
    delta = rows.filter("id % 13 = 0").select("id", F.lit("success").alias("new_status"))
    return rows.join(delta, "id", "left").select("id", F.coalesce("new_status", "status").alias("status"))


@query(
    "K11_primary_reselection",
    f"SELECT domain_id, lei_code, tie1, tie3, row_number() OVER (PARTITION BY domain_id ORDER BY lei_code DESC, {BEST}) = 1 AS is_primary FROM {C} c",
)
def primary_reselection(spark: SparkSession, sf: str) -> DataFrame:
    """The flag moves to the chosen candidate; here the one of the highest code."""
    w = Window.partitionBy("domain_id").orderBy(F.desc("lei_code"), F.desc("weighted_score"), "rank_position", "tie1", "tie2", "tie3")
    return CANDIDATES.read(spark, sf).select("domain_id", "lei_code", "tie1", "tie3", (F.row_number().over(w) == 1).alias("is_primary"))


@query("K12_clear_operational", f"SELECT (SELECT count(*) FROM {D} d WHERE false) AS domains, (SELECT count(*) FROM {E} e) AS entities")
def clear_operational(spark: SparkSession, sf: str) -> DataFrame:
    """Operational tables are overwritten with empty ones; knowledge stays."""
    empty = DOMAINS.read(spark, sf).limit(0).agg(F.count("*").alias("domains"))
    return empty.join(ENTITIES.read(spark, sf).agg(F.count("*").alias("entities")))


@query("K15_upsert_by_model", f"SELECT domain, extraction_method, id, confidence_score FROM (SELECT *, row_number() OVER (PARTITION BY domain, extraction_method ORDER BY created_at DESC, id DESC) AS rn FROM {D} d) x WHERE rn = 1")
def upsert_by_model(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("domain", "extraction_method").orderBy(F.desc("created_at"), F.desc("id"))
    return DOMAINS.read(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("domain", "extraction_method", "id", "confidence_score")


@query("K16_retention", f"SELECT count(*) AS n FROM {D} d WHERE created_at >= TIMESTAMP '2001-09-01' - INTERVAL 365 DAY")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("created_at >= timestamp'2001-09-01' - INTERVAL 365 DAYS").agg(F.count("*").alias("n"))


@query("K18_M6_stage_state", f"SELECT id, CASE WHEN status = 'success' AND level2_status = 'success' THEN 4 WHEN status = 'success' AND level2_attempted THEN 3 WHEN status = 'success' THEN 2 ELSE 1 END AS stage, CASE WHEN status = 'pending' THEN 'processing' WHEN status = 'processing' AND retry_count < 3 THEN 'pending' WHEN status = 'processing' THEN 'failed' ELSE status END AS next_status FROM {D} d")
def stage_state(spark: SparkSession, sf: str) -> DataFrame:
    """How far each row has come, and the retry machine's next state."""
    ok = F.col("status") == "success"
    stage = F.when(ok & (F.col("level2_status") == "success"), 4).when(ok & F.col("level2_attempted"), 3).when(ok, 2).otherwise(1)
    waiting = F.col("status") == "processing"
    following = F.when(F.col("status") == "pending", "processing").when(waiting & (F.col("retry_count") < 3), "pending").when(waiting, "failed").otherwise(F.col("status"))
    return DOMAINS.read(spark, sf).select("id", stage.alias("stage"), following.alias("next_status"))


@query("K19_newest_hundred", f"SELECT batch_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts DESC, seq DESC) AS rn FROM {G} l) x WHERE rn <= 100")
def newest_hundred(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("batch_id").orderBy(F.desc("ts"), F.desc("seq"))
    return LOG.read(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 100").select("batch_id", "seq")


@query("K20_change_log", f"SELECT seq, event FROM {G} l ORDER BY ts DESC, seq DESC LIMIT 20")
def change_log(spark: SparkSession, sf: str) -> DataFrame:
    return LOG.read(spark, sf).orderBy(F.desc("ts"), F.desc("seq")).limit(20).select("seq", "event")


@query("K21_level2_reset", f"SELECT id, CASE WHEN batch_id = 'b7' THEN NULL ELSE level2_status END AS level2_status, CASE WHEN batch_id = 'b7' THEN false ELSE level2_attempted END AS level2_attempted FROM {D} d")
def level2_reset(spark: SparkSession, sf: str) -> DataFrame:
    reset = F.col("batch_id") == "b7"
    return DOMAINS.read(spark, sf).select("id", F.when(~reset, F.col("level2_status")).alias("level2_status"), F.when(reset, F.lit(False)).otherwise(F.col("level2_attempted")).alias("level2_attempted"))


@query("P3_camel_case", f"SELECT domain_id AS domainId, lei_code AS leiCode, legal_name AS legalName, weighted_score AS weightedScore FROM {C} c")
def camel_case(spark: SparkSession, sf: str) -> DataFrame:
    def camel(name: str) -> str:
        first, *rest = name.split("_")
        return first + "".join(x.title() for x in rest)

    columns = ["domain_id", "lei_code", "legal_name", "weighted_score"]
    return CANDIDATES.read(spark, sf).select(*columns).withColumnsRenamed({c: camel(c) for c in columns})


@query("P4_label_to_number", f"SELECT id, CASE business WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 ELSE 0.3 END AS number FROM (SELECT id, CASE WHEN confidence_score >= 70 THEN 'high' WHEN confidence_score >= 40 THEN 'medium' ELSE 'low' END AS business FROM {D} d) x")
def label_to_number(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("confidence_score") >= 70, "high").when(F.col("confidence_score") >= 40, "medium").otherwise("low")
    return DOMAINS.read(spark, sf).select("id", F.create_map(*[F.lit(x) for x in ("high", 0.9, "medium", 0.6, "low", 0.3)])[label].alias("number"))


@query("P7_dump_sizes", f"SELECT dump_id, CASE WHEN n >= 1048576 THEN concat(cast(floor(n / 1048576) AS BIGINT), ' MB') WHEN n >= 10240 THEN concat(cast(floor(n / 1024) AS BIGINT), ' kB') ELSE concat(n, ' bytes') END AS pretty FROM (SELECT dump_id, octet_length(encode(html)) AS n FROM {P} p WHERE html IS NOT NULL) x")
def dump_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.octet_length("html")
    pretty = F.when(n >= 1048576, F.concat(F.floor(n / 1048576).cast("string"), F.lit(" MB"))).when(n >= 10240, F.concat(F.floor(n / 1024).cast("string"), F.lit(" kB"))).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    return DUMPS.read(spark, sf).filter("html IS NOT NULL").select("dump_id", pretty.alias("pretty"))


@query("P8_json_object", f"SELECT id, cast(to_json({{'domain': domain, 'status': status, 'method': extraction_method, 'retries': retry_count}}) AS VARCHAR) AS document FROM {D} d")
def json_object(spark: SparkSession, sf: str) -> DataFrame:
    return json_objects(DOMAINS.read(spark, sf))


def json_objects(domains: DataFrame) -> DataFrame:
    record = F.struct("domain", "status", F.col("extraction_method").alias("method"), F.col("retry_count").alias("retries"))
    return domains.select("id", F.to_json(record).alias("document"))
