"""Aggregations: batch statistics, session results, duplicates across batches, registry profiles, log metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.compat import joined_distinct, js_round, percent, upper_median
from tessera.operators.relational import mappings
from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, EDGES, ENTITIES, LOG

D, C, E, R, G = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql, EDGES.sql, LOG.sql
AS_OF = "2001-09-01 00:00:00"


def count_where(test: Column | str) -> Column:
    return F.count_if(F.expr(test) if isinstance(test, str) else test)


@query("A1_counts", f"SELECT count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status IN ('success', 'failed')) AS finished FROM {D} d")
def counts(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).agg(F.count("*").alias("total"), count_where("status = 'success'").alias("successful"), count_where("status IN ('success', 'failed')").alias("finished"))


@query(
    "A2_processing_stats",
    f"""SELECT batch_id, total, processed, successful,
        CASE WHEN processed > 0 THEN floor(successful * 1000.0 / processed + 0.5) / 10 ELSE 0 END AS success_rate,
        CASE WHEN elapsed > 0 THEN floor(processed * 60.0 / elapsed * 10 + 0.5) / 10 ELSE 0 END AS per_minute, total - processed AS remaining
        FROM (SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ('success', 'failed')) AS processed, count(*) FILTER (status = 'success') AS successful,
          date_diff('second', min(created_at), TIMESTAMP '{AS_OF}') AS elapsed, max(created_at) AS newest FROM {D} d GROUP BY batch_id) x ORDER BY newest DESC, batch_id LIMIT 1""",
)
def processing_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of the newest batch as of a given time."""
    elapsed = F.unix_timestamp(F.lit(AS_OF)) - F.unix_timestamp(F.min("created_at"))
    per = DOMAINS.read(spark, sf).groupBy("batch_id").agg(F.count("*").alias("total"), count_where("status IN ('success', 'failed')").alias("processed"), count_where("status = 'success'").alias("successful"), elapsed.alias("elapsed"), F.max("created_at").alias("newest"))
    newest = per.orderBy(F.desc("newest"), "batch_id").limit(1)
    speed = F.when(F.col("elapsed") > 0, js_round(F.col("processed") * 60.0 / F.col("elapsed"), 1)).otherwise(0)
    return newest.select("batch_id", "total", "processed", "successful", percent(F.col("successful"), F.col("processed"), 1).alias("success_rate"), speed.alias("per_minute"), (F.col("total") - F.col("processed")).alias("remaining"))


@query(
    "A3_A4_session_results",
    f"""SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed,
        floor(count(*) FILTER (status = 'success') * 100.0 / count(*) + 0.5) AS success_rate,
        coalesce(floor(avg(confidence_score) FILTER (status = 'success' AND confidence_score > 0) + 0.5), 0) AS average_confidence,
        count(*) FILTER (status = 'success' AND confidence_score >= 90) AS high, count(*) FILTER (status = 'success' AND confidence_score >= 70 AND confidence_score < 90) AS medium,
        count(*) FILTER (status = 'success' AND confidence_score > 0 AND confidence_score < 70) AS low,
        count(*) FILTER (status = 'success' AND extraction_method = 'domain_parse') AS parsed, count(*) FILTER (status = 'success' AND extraction_method LIKE '%html%') AS from_html,
        count(*) FILTER (manual_review_required) AS manual_review, count(*) FILTER (level2_attempted) AS level2_attempted,
        count(*) FILTER (level2_attempted AND primary_lei_code IS NOT NULL) AS level2_success, count(*) FILTER (level2_candidates_count > 1) AS multiple_candidates,
        count(*) FILTER (earlier) AS duplicates, count(*) FILTER (earlier AND confidence_score >= 85) AS reused
        FROM (SELECT d.*, min(created_at) OVER (PARTITION BY domain) < created_at AS earlier FROM {D} d) x GROUP BY batch_id""",
)
def session_results(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of every batch; a domain seen before counts as duplicate, and as reused if its score would have been."""
    rows = DOMAINS.read(spark, sf).withColumn("earlier", F.min("created_at").over(Window.partitionBy("domain")) < F.col("created_at"))
    ok = F.col("status") == "success"
    score = F.when(ok & (F.col("confidence_score") > 0), F.col("confidence_score"))
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("total"), count_where(ok).alias("successful"), count_where("status = 'failed'").alias("failed"),
        percent(count_where(ok), F.count("*")).alias("success_rate"), F.coalesce(js_round(F.avg(score)), F.lit(0)).cast("double").alias("average_confidence"),
        count_where(score >= 90).alias("high"), count_where((score >= 70) & (score < 90)).alias("medium"), count_where(score < 70).alias("low"),
        count_where(ok & (F.col("extraction_method") == "domain_parse")).alias("parsed"), count_where(ok & F.col("extraction_method").contains("html")).alias("from_html"),
        count_where("manual_review_required").alias("manual_review"), count_where("level2_attempted").alias("level2_attempted"),
        count_where("level2_attempted AND primary_lei_code IS NOT NULL").alias("level2_success"), count_where("level2_candidates_count > 1").alias("multiple_candidates"),
        count_where("earlier").alias("duplicates"), count_where("earlier AND confidence_score >= 85").alias("reused"),
    )


@query("A3_method_histogram", f"SELECT batch_id, coalesce(extraction_method, 'unknown') AS method, count(*) AS n FROM {D} d WHERE status = 'success' GROUP BY ALL")
def method_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("status = 'success'").groupBy("batch_id", F.coalesce("extraction_method", F.lit("unknown")).alias("method")).agg(F.count("*").alias("n"))


@query("A3_failure_histogram", f"SELECT batch_id, coalesce(error_message, 'Unknown error') AS reason, count(*) AS n FROM {D} d WHERE status = 'failed' GROUP BY ALL")
def failure_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("status = 'failed'").groupBy("batch_id", F.coalesce("error_message", F.lit("Unknown error")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "A5_batch_analytics",
    f"""SELECT batch_id, floor(count(*) FILTER (ok) * 100.0 / count(*) + 0.5) AS success_rate,
        coalesce(list_sort(list(score) FILTER (score IS NOT NULL))[cast(floor(count(score) / 2) AS INT) + 1], 0) AS median_confidence,
        coalesce(floor(avg(score) + 0.5), 0) AS average_confidence,
        CASE WHEN count(*) FILTER (ok) > 0 THEN floor(count(*) FILTER (ok AND extraction_method = 'domain_parse') * 100.0 / count(*) FILTER (ok) + 0.5) ELSE 0 END AS parsed_percentage,
        coalesce(floor(avg(processing_time_ms) FILTER (processing_time_ms > 0) + 0.5), 0) AS average_ms,
        CASE WHEN count(*) FILTER (ok) > 0 THEN floor(count(*) FILTER (score >= 90) * 100.0 / count(*) FILTER (ok) + 0.5) ELSE 0 END AS high_percentage
        FROM (SELECT *, status = 'success' AS ok, CASE WHEN status = 'success' AND confidence_score > 0 THEN confidence_score END AS score FROM {D} d) x GROUP BY batch_id""",
)
def batch_analytics(spark: SparkSession, sf: str) -> DataFrame:
    rows = DOMAINS.read(spark, sf).withColumn("ok", F.col("status") == "success").withColumn("score", F.when(F.col("ok") & (F.col("confidence_score") > 0), F.col("confidence_score")))
    ok = count_where("ok")
    return rows.groupBy("batch_id").agg(
        percent(ok, F.count("*")).alias("success_rate"), F.coalesce(upper_median("score"), F.lit(0.0)).alias("median_confidence"), F.coalesce(js_round(F.avg("score")), F.lit(0)).cast("double").alias("average_confidence"),
        percent(count_where("ok AND extraction_method = 'domain_parse'"), ok).alias("parsed_percentage"),
        F.coalesce(js_round(F.avg(F.when(F.col("processing_time_ms") > 0, F.col("processing_time_ms")))), F.lit(0)).cast("double").alias("average_ms"), percent(count_where("score >= 90"), ok).alias("high_percentage"),
    )


def labels() -> list[Column]:
    """What the export says of a domain's registry status, business category and next step; a missing score is in none of the classes."""
    level2, score = F.col("level2_status"), F.col("confidence_score")
    status = F.when(level2 == "success", "GLEIF Verified").when(level2 == "multiple_candidates", "GLEIF Multiple").when(level2 == "failed", "GLEIF Failed").otherwise("No GLEIF")
    category = F.when(score >= 85, "High Priority").when(score >= 60, "Good Target").when(score >= 30, "Research Required").otherwise("Manual Review")
    step = F.when(F.col("status") == "failed", "Retry with Level 2").when(score < 70, "GLEIF Enhancement").otherwise("Ready for Analysis")
    return [status.alias("gleif_status"), category.alias("business_category"), step.alias("recommendation")]


CASES_SQL = """CASE WHEN level2_status = 'success' THEN 'GLEIF Verified' WHEN level2_status = 'multiple_candidates' THEN 'GLEIF Multiple' WHEN level2_status = 'failed' THEN 'GLEIF Failed' ELSE 'No GLEIF' END AS gleif_status,
  CASE WHEN confidence_score >= 85 THEN 'High Priority' WHEN confidence_score >= 60 THEN 'Good Target' WHEN confidence_score >= 30 THEN 'Research Required' ELSE 'Manual Review' END AS business_category,
  CASE WHEN status = 'failed' THEN 'Retry with Level 2' WHEN confidence_score < 70 THEN 'GLEIF Enhancement' ELSE 'Ready for Analysis' END AS recommendation"""


def candidate_lists(spark: SparkSession, sf: str, domains: DataFrame) -> DataFrame:
    """Per given domain: how many candidates, and their distinct values joined. Others' candidates go before the aggregate, which comes before the join, so domains never multiply."""
    fields = {"all_lei_codes": "lei_code", "all_legal_names": "legal_name", "all_jurisdictions": "jurisdiction", "all_entity_statuses": "entity_status"}
    asked = CANDIDATES.read(spark, sf).join(domains.select(F.col("id").alias("domain_id")), "domain_id", "left_semi")
    return asked.groupBy("domain_id").agg(F.count("*").alias("n"), *[joined_distinct(F.col(c)).alias(n) for n, c in fields.items()])


LISTS_SQL = ", ".join(f"coalesce(string_agg(DISTINCT c.{c}, '; ' ORDER BY c.{c}), '') AS {n}" for n, c in {"all_lei_codes": "lei_code", "all_legal_names": "legal_name", "all_jurisdictions": "jurisdiction", "all_entity_statuses": "entity_status"}.items())


@query(
    "A6_export_aggregate",
    f"""SELECT d.id, d.domain, d.company_name, d.extraction_method, d.confidence_score, d.status, {CASES_SQL}, d.primary_lei_code AS lei_code, count(c.lei_code) AS gleif_candidate_count, {LISTS_SQL}
        FROM {D} d LEFT JOIN {C} c ON d.id = c.domain_id WHERE d.batch_id = 'b3' GROUP BY ALL ORDER BY d.id""",
)
def export_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """The batch export with its derived labels and its candidates in lists."""
    domains = DOMAINS.read(spark, sf).filter("batch_id = 'b3'")
    joined = domains.join(candidate_lists(spark, sf, domains), F.col("id") == F.col("domain_id"), "left")
    lists = [F.coalesce(n, F.lit("")).alias(n) for n in ("all_lei_codes", "all_legal_names", "all_jurisdictions", "all_entity_statuses")]
    return joined.select("id", "domain", "company_name", "extraction_method", "confidence_score", "status", *labels(), F.col("primary_lei_code").alias("lei_code"), F.coalesce("n", F.lit(0)).alias("gleif_candidate_count"), *lists).orderBy("id")


@query("P1_export_labels", f"SELECT id, {CASES_SQL} FROM {D} d")
def export_labels(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).select("id", *labels())


@query(
    "A7_export_by_hash",
    f"""SELECT md5(d.domain) AS domain_hash, d.domain, d.status, d.confidence_score, count(DISTINCT c.lei_code) AS gleif_candidate_count, string_agg(DISTINCT c.lei_code, '; ' ORDER BY c.lei_code) AS all_lei_codes,
        string_agg(DISTINCT c.jurisdiction, '; ' ORDER BY c.jurisdiction) AS all_jurisdictions FROM {D} d LEFT JOIN {C} c ON d.id = c.domain_id WHERE d.batch_id = 'b6' GROUP BY ALL""",
)
def export_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    domains = DOMAINS.read(spark, sf).filter("batch_id = 'b6'").withColumn("domain_hash", F.md5(F.col("domain").cast("binary")))
    joined = domains.join(CANDIDATES.read(spark, sf).select("domain_id", "lei_code", "jurisdiction"), F.col("id") == F.col("domain_id"), "left")
    lists = [F.nullif(joined_distinct(F.col(c)), F.lit("")).alias(n) for n, c in (("all_lei_codes", "lei_code"), ("all_jurisdictions", "jurisdiction"))]
    return joined.groupBy("domain_hash", "domain", "status", "confidence_score").agg(F.size(F.collect_set("lei_code")).cast("long").alias("gleif_candidate_count"), *lists)


@query(
    "A8_candidates_json",
    f"""SELECT domain_id, cast(to_json(list({{'rank_position': rank_position, 'lei_code': lei_code, 'weighted_score': cast(weighted_score AS BIGINT)}} ORDER BY rank_position, lei_code, weighted_score)) AS VARCHAR) AS candidates
        FROM {C} c GROUP BY domain_id""",
)
def candidates_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every domain's candidates; a filter on the domain is pushed below the aggregate."""
    one = F.struct("rank_position", "lei_code", F.col("weighted_score").cast("long").alias("weighted_score"))
    return CANDIDATES.read(spark, sf).groupBy("domain_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("candidates"))


@query(
    "A9_geographic_bias",
    f"""SELECT domain_id, count(*) FILTER (jurisdiction = 'US') * 100.0 / count(*) AS us_percentage, CASE WHEN count(*) FILTER (jurisdiction = 'US') > count(*) * 0.6 THEN 'High US bias detected' ELSE 'Balanced distribution' END AS assessment,
        count(DISTINCT jurisdiction) > 2 AS multinational, count(*) FILTER (entity_status = 'ACTIVE') AS active FROM {C} c GROUP BY domain_id""",
)
def geographic_bias(spark: SparkSession, sf: str) -> DataFrame:
    us = count_where("jurisdiction = 'US'")
    assessment = F.when(us > F.count("*") * 0.6, "High US bias detected").otherwise("Balanced distribution")
    return CANDIDATES.read(spark, sf).groupBy("domain_id").agg((us * 100.0 / F.count("*")).alias("us_percentage"), assessment.alias("assessment"), (F.size(F.collect_set("jurisdiction")) > 2).alias("multinational"), count_where("entity_status = 'ACTIVE'").alias("active"))


@query(
    "A10_batch_performance",
    f"""SELECT batch_id, count(*) AS total_domains, count(*) FILTER (status = 'success') * 100.0 / count(*) AS success_rate, avg(coalesce(processing_time_ms, 0)) AS avg_processing_time, count(*) FILTER (n > 0) * 100.0 / count(*) AS enrichment_rate
        FROM (SELECT d.id, d.batch_id, d.status, d.processing_time_ms, count(c.lei_code) AS n FROM {D} d LEFT JOIN {C} c ON d.id = c.domain_id GROUP BY ALL) x GROUP BY batch_id""",
)
def batch_performance(spark: SparkSession, sf: str) -> DataFrame:
    """A missing time counts as zero over all rows."""
    found = CANDIDATES.read(spark, sf).select(F.col("domain_id").alias("id")).distinct().withColumn("has", F.lit(True))
    rows = DOMAINS.read(spark, sf).join(found, "id", "left")
    return rows.groupBy("batch_id").agg(F.count("*").alias("total_domains"), (count_where("status = 'success'") * 100.0 / F.count("*")).alias("success_rate"), F.avg(F.coalesce("processing_time_ms", F.lit(0))).alias("avg_processing_time"), (count_where("has") * 100.0 / F.count("*")).alias("enrichment_rate"))


@query(
    "A10_top_performers",
    f"""SELECT id, domain, processing_time_ms, (SELECT count(*) FROM {C} c WHERE c.domain_id = d.id) AS gleif_candidates FROM {D} d WHERE batch_id = 'b8' ORDER BY processing_time_ms DESC NULLS LAST, id LIMIT 10""",
)
def top_performers(spark: SparkSession, sf: str) -> DataFrame:
    top = DOMAINS.read(spark, sf).filter("batch_id = 'b8'").orderBy(F.desc_nulls_last("processing_time_ms"), "id").limit(10)
    n = CANDIDATES.read(spark, sf).groupBy("domain_id").agg(F.count("*").alias("n"))
    return top.join(n, F.col("id") == F.col("domain_id"), "left").select("id", "domain", "processing_time_ms", F.coalesce("n", F.lit(0)).alias("gleif_candidates"))


@query(
    "A11_compare_batches",
    f"SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (level2_status = 'success') AS verified, floor(avg(confidence_score) * 100 + 0.5) / 100 AS avg_confidence, floor(avg(processing_time_ms) * 100 + 0.5) / 100 AS avg_ms FROM {D} d WHERE batch_id IN ('b1', 'b2', 'b3') GROUP BY batch_id",
)
def compare_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = DOMAINS.read(spark, sf).filter(F.col("batch_id").isin("b1", "b2", "b3"))
    return rows.groupBy("batch_id").agg(F.count("*").alias("total"), count_where("status = 'success'").alias("successful"), count_where("level2_status = 'success'").alias("verified"), js_round(F.avg("confidence_score"), 2).alias("avg_confidence"), js_round(F.avg("processing_time_ms"), 2).alias("avg_ms"))


@query("A12_search_with_counts", f"SELECT d.id, d.domain, d.confidence_score, count(c.lei_code) AS n FROM {D} d LEFT JOIN {C} c ON d.id = c.domain_id WHERE d.domain ILIKE '%mach1%' OR d.company_name ILIKE '%Company 21%' GROUP BY ALL ORDER BY d.confidence_score DESC NULLS LAST, d.id LIMIT 20")
def search_with_counts(spark: SparkSession, sf: str) -> DataFrame:
    hits = DOMAINS.read(spark, sf).filter(F.col("domain").ilike("%mach1%") | F.col("company_name").ilike("%Company 21%")).orderBy(F.desc_nulls_last("confidence_score"), "id").limit(20)
    n = CANDIDATES.read(spark, sf).groupBy("domain_id").agg(F.count("*").alias("n"))
    return hits.join(n, F.col("id") == F.col("domain_id"), "left").select("id", "domain", "confidence_score", F.coalesce("n", F.lit(0)).alias("n"))


@query("A13_duplicates", f"SELECT domain, count(*) AS occurrences, count(DISTINCT batch_id) AS batch_count, list_sort(list_distinct(list(batch_id))) AS batch_ids, min(created_at) AS first_seen, max(created_at) AS last_seen FROM {D} d GROUP BY domain HAVING count(*) > 1 ORDER BY occurrences DESC, domain LIMIT 20")
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    per = DOMAINS.read(spark, sf).groupBy("domain").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("batch_id")).alias("batch_ids"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return per.filter("occurrences > 1").withColumn("batch_count", F.size("batch_ids").cast("long")).orderBy(F.desc("occurrences"), "domain").limit(20)


@query(
    "A14_J5_cross_batch",
    f"""SELECT a.*, coalesce(l.unique_lei_codes, 0) AS unique_lei_codes FROM (SELECT domain, count(DISTINCT batch_id) AS batch_appearances, count(*) AS attempts, max(confidence_score) AS best, min(confidence_score) AS worst,
        count(DISTINCT company_name) AS name_variations, string_agg(DISTINCT company_name, ' | ' ORDER BY company_name) AS all_names, bool_or(status = 'success') AS ever_successful FROM {D} d GROUP BY domain HAVING count(DISTINCT batch_id) > 1) a
        LEFT JOIN (SELECT d.domain, count(DISTINCT c.lei_code) AS unique_lei_codes FROM {D} d LEFT JOIN {C} c ON d.id = c.domain_id GROUP BY d.domain) l ON a.domain = l.domain ORDER BY best DESC NULLS LAST, a.domain LIMIT 20""",
)
def cross_batch(spark: SparkSession, sf: str) -> DataFrame:
    domains = DOMAINS.read(spark, sf)
    names = F.array_sort(F.collect_set("company_name"))
    per = domains.groupBy("domain").agg(F.count_distinct("batch_id").alias("batch_appearances"), F.count("*").alias("attempts"), F.max("confidence_score").alias("best"), F.min("confidence_score").alias("worst"), F.size(names).cast("long").alias("name_variations"), F.nullif(F.array_join(names, " | "), F.lit("")).alias("all_names"), F.bool_or(F.col("status") == "success").alias("ever_successful"))
    top = per.filter("batch_appearances > 1").orderBy(F.desc_nulls_last("best"), "domain").limit(20)  # before the join: twenty rows meet the candidates
    leis = domains.select("id", "domain").join(F.broadcast(top.select("domain")), "domain").join(CANDIDATES.read(spark, sf).select(F.col("domain_id").alias("id"), "lei_code"), "id").groupBy("domain").agg(F.count_distinct("lei_code").alias("leis"))
    return top.join(leis, "domain", "left").withColumn("unique_lei_codes", F.coalesce("leis", F.lit(0))).drop("leis")


@query(
    "A15_domain_history",
    f"""SELECT domain, count(*) AS attempts, count(DISTINCT batch_id) AS batches, arg_max(company_name, {{'s': coalesce(confidence_score, 0), 'c': created_at, 'i': id}}) FILTER (company_name IS NOT NULL) AS best_name, max(confidence_score) AS best_score, min(created_at) AS first_seen, max(created_at) AS last_seen FROM {D} d GROUP BY domain""",
)
def domain_history(spark: SparkSession, sf: str) -> DataFrame:
    order = F.when(F.col("company_name").isNotNull(), F.struct(F.coalesce("confidence_score", F.lit(0.0)), "created_at", "id"))
    return DOMAINS.read(spark, sf).groupBy("domain").agg(F.count("*").alias("attempts"), F.count_distinct("batch_id").alias("batches"), F.max_by("company_name", order).alias("best_name"), F.max("confidence_score").alias("best_score"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


@query(
    "A16_graph_stats",
    f"SELECT (SELECT count(*) FROM {E} e) AS entities, (SELECT count(*) FROM {R} r) AS relationships, (SELECT count(DISTINCT parent_lei) FROM {R} r) AS parents, (SELECT count(DISTINCT jurisdiction) FROM {E} e) AS jurisdictions, (SELECT avg(relationship_confidence) FROM {R} r) AS avg_confidence",
)
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    entities = ENTITIES.read(spark, sf).agg(F.count("*").alias("entities"), F.count_distinct("jurisdiction").alias("jurisdictions"))
    edges = EDGES.read(spark, sf).agg(F.count("*").alias("relationships"), F.count_distinct("parent_lei").alias("parents"), F.avg("relationship_confidence").alias("avg_confidence"))
    return entities.join(edges)  # one row each


@query(
    "A17_level2_analytics",
    f"""SELECT c.jurisdiction, count(*) AS n, count(*) FILTER (c.entity_status = 'ACTIVE') AS active, avg(c.weighted_score) AS avg_score FROM {C} c JOIN {D} d ON c.domain_id = d.id WHERE d.level2_attempted GROUP BY c.jurisdiction ORDER BY n DESC, c.jurisdiction LIMIT 10""",
)
def level2_analytics(spark: SparkSession, sf: str) -> DataFrame:
    attempted = DOMAINS.read(spark, sf).filter("level2_attempted").select(F.col("id").alias("domain_id"))
    per = CANDIDATES.read(spark, sf).join(attempted, "domain_id").groupBy("jurisdiction").agg(F.count("*").alias("n"), count_where("entity_status = 'ACTIVE'").alias("active"), F.avg("weighted_score").alias("avg_score"))
    return per.orderBy(F.desc("n"), "jurisdiction").limit(10)


@query("A27_level2_percentages", f"SELECT count(*) FILTER (level2_attempted) AS attempted, CASE WHEN count(*) FILTER (level2_attempted) > 0 THEN floor(count(*) FILTER (level2_attempted AND level2_status = 'success') * 100.0 / count(*) FILTER (level2_attempted) + 0.5) ELSE 0 END AS success_percentage FROM {D} d")
def level2_percentages(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).agg(count_where("level2_attempted").alias("attempted"), percent(count_where("level2_attempted AND level2_status = 'success'"), count_where("level2_attempted")).alias("success_percentage"))


@query("A18_A28_method_view", f"SELECT extraction_method, count(*) AS tests, count(CASE WHEN status = 'success' THEN 1 END) AS successes, avg(processing_time_ms) AS avg_ms, avg(confidence_score) AS avg_confidence, avg(retry_count) AS avg_retries FROM {D} d GROUP BY extraction_method")
def method_view(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).groupBy("extraction_method").agg(F.count("*").alias("tests"), count_where("status = 'success'").alias("successes"), F.avg("processing_time_ms").alias("avg_ms"), F.avg("confidence_score").alias("avg_confidence"), F.avg("retry_count").alias("avg_retries"))


@query("A19_nested_sessions", f"SELECT batch_id, cast(to_json(list({{'event': event, 'n': n}} ORDER BY event)) AS VARCHAR) AS events FROM (SELECT batch_id, event, count(*) AS n FROM {G} l GROUP BY batch_id, event) x GROUP BY batch_id")
def nested_sessions(spark: SparkSession, sf: str) -> DataFrame:
    per = LOG.read(spark, sf).groupBy("batch_id", "event").agg(F.count("*").alias("n"))
    return per.groupBy("batch_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("event", "n")))).alias("events"))


@query("A20_distinct_models", f"SELECT DISTINCT domain_id, legal_form FROM {C} c")
def distinct_models(spark: SparkSession, sf: str) -> DataFrame:
    return CANDIDATES.read(spark, sf).select("domain_id", "legal_form").distinct()


COMPLETE = ["lei_code", "legal_name", "jurisdiction", "entity_status", "registration_status", "legal_form", "category", "city", "country"]


@query(
    "A21_X73_completeness",
    f"""SELECT grade, count(*) AS n, avg(score) AS avg_score, sum(no_city) AS without_city, sum(no_category) AS without_category FROM (SELECT *, CASE WHEN score > 95 THEN 'complete' WHEN score > 80 THEN 'good' ELSE 'partial' END AS grade
        FROM (SELECT ({' + '.join(f'(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)' for c in COMPLETE)}) * 100.0 / {len(COMPLETE)} AS score, CASE WHEN city IS NULL THEN 1 ELSE 0 END AS no_city, CASE WHEN category IS NULL THEN 1 ELSE 0 END AS no_category FROM {E} e) x) y GROUP BY grade""",
)
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """The share of a registry record's fields that are there, and how records grade by it."""
    score = F.size(F.filter(F.array(*[F.col(c).isNotNull() for c in COMPLETE]), lambda x: x)) * 100.0 / len(COMPLETE)
    rows = ENTITIES.read(spark, sf).withColumn("score", score)
    grade = F.when(F.col("score") > 95, "complete").when(F.col("score") > 80, "good").otherwise("partial")
    return rows.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), count_where("city IS NULL").alias("without_city"), count_where("category IS NULL").alias("without_category"))


@query(
    "A22_log_metrics",
    f"""SELECT batch_id, count(*) AS events, count(*) FILTER (event = 'domain_success') AS successes, count(*) FILTER (event = 'domain_failed') AS failures, count(*) FILTER (event = 'domain_timeout') AS timeouts,
        avg(ms) FILTER (ms > 0 AND event = 'domain_success') AS avg_ms, count(*) FILTER (event IN ('domain_failed', 'domain_timeout')) * 100.0 / count(*) AS failure_rate, min(ts) AS first_event, max(ts) AS last_event FROM {G} l GROUP BY batch_id""",
)
def log_metrics(spark: SparkSession, sf: str) -> DataFrame:
    is_ = lambda *e: F.col("event").isin(*e)
    return LOG.read(spark, sf).groupBy("batch_id").agg(
        F.count("*").alias("events"), count_where(is_("domain_success")).alias("successes"), count_where(is_("domain_failed")).alias("failures"), count_where(is_("domain_timeout")).alias("timeouts"),
        F.avg(F.when(is_("domain_success") & (F.col("ms") > 0), F.col("ms"))).alias("avg_ms"), (count_where(is_("domain_failed", "domain_timeout")) * 100.0 / F.count("*")).alias("failure_rate"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event"),
    )


@query(
    "A23_hourly_fold",
    f"SELECT hour, n, floor(folded * 1000 + 0.5) / 1000 AS folded FROM (SELECT extract('hour' FROM ts) AS hour, count(*) AS n, list_reduce(list_prepend(0.0::DOUBLE, list(ms ORDER BY ts, seq)), lambda a, x: (a + x) / 2) AS folded FROM {G} l WHERE event = 'domain_success' GROUP BY 1) x",
)
def hourly_fold(spark: SparkSession, sf: str) -> DataFrame:
    """A running mean that halves its past with each event. An event k steps from the newest weighs 2^-(k+1), so the fold is a sum, exact to double precision over the newest events of an hour and free of any order inside the aggregate."""
    w = Window.partitionBy("hour").orderBy(F.desc("ts"), F.desc("seq"))
    rows = LOG.read(spark, sf).filter("event = 'domain_success'").withColumn("hour", F.hour("ts").cast("long")).withColumn("k", F.row_number().over(w))
    return rows.groupBy("hour").agg(F.count("*").alias("n"), js_round(F.sum(F.col("ms") * F.pow(F.lit(0.5), F.col("k"))), 3).alias("folded"))


@query("A24_consensus", f"SELECT jurisdiction, legal_form, n, floor(n * 100.0 / total + 0.5) AS share FROM (SELECT jurisdiction, legal_form, n, sum(n) OVER (PARTITION BY jurisdiction) AS total, row_number() OVER (PARTITION BY jurisdiction ORDER BY n DESC, first_seen) AS rn FROM (SELECT jurisdiction, legal_form, count(*) AS n, min(n) AS first_seen FROM {E} e GROUP BY jurisdiction, legal_form) x) y WHERE rn = 1")
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    """The most common answer and its share; ties go to the first seen."""
    per = ENTITIES.read(spark, sf).groupBy("jurisdiction", "legal_form").agg(F.count("*").alias("n"), F.min("n").alias("first_seen"))
    w = Window.partitionBy("jurisdiction")
    ranked = per.withColumn("total", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "first_seen"))).filter("rn = 1")
    return ranked.select("jurisdiction", "legal_form", "n", percent(F.col("n"), F.col("total")).alias("share"))


@query(
    "A26_latest_vs_history",
    f"""SELECT max(CASE WHEN rn = 1 THEN rate END) AS latest, avg(CASE WHEN rn > 1 THEN rate END) AS historical FROM (SELECT rate, row_number() OVER (ORDER BY newest DESC, batch_id) AS rn
        FROM (SELECT batch_id, count(*) FILTER (status = 'success') * 100.0 / count(*) AS rate, max(created_at) AS newest FROM {D} d GROUP BY batch_id) x) y""",
)
def latest_vs_history(spark: SparkSession, sf: str) -> DataFrame:
    per = DOMAINS.read(spark, sf).groupBy("batch_id").agg((count_where("status = 'success'") * 100.0 / F.count("*")).alias("rate"), F.max("created_at").alias("newest"))
    ranked = per.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("newest"), "batch_id")))  # one row a batch
    return ranked.agg(F.max(F.when(F.col("rn") == 1, F.col("rate"))).alias("latest"), F.avg(F.when(F.col("rn") > 1, F.col("rate"))).alias("historical"))


@query("A29_stuck_by_batch", f"SELECT batch_id, list(id ORDER BY id) AS ids FROM {D} d WHERE status = 'processing' GROUP BY batch_id")
def stuck_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("status = 'processing'").groupBy("batch_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))


@query("A30_registry_profile", f"SELECT count(DISTINCT category) AS categories, count(DISTINCT legal_form) AS forms, count(DISTINCT entity_status) AS statuses, count(DISTINCT jurisdiction) AS jurisdictions, count(city) AS with_city FROM {E} e")
def registry_profile(spark: SparkSession, sf: str) -> DataFrame:
    distinct = {"categories": "category", "forms": "legal_form", "statuses": "entity_status", "jurisdictions": "jurisdiction"}
    return ENTITIES.read(spark, sf).agg(*[F.count_distinct(c).alias(n) for n, c in distinct.items()], F.count("city").alias("with_city"))


@query(
    "A32_model_benchmark",
    f"""SELECT extraction_method AS model, count(*) AS n, count(*) FILTER (confidence_score >= 90) AS success, count(*) FILTER (confidence_score >= 50 AND confidence_score < 90) AS partial, avg(processing_time_ms) AS avg_ms,
        count(*) FILTER (confidence_score >= 90) * 1000.0 / count(*) / avg(processing_time_ms) AS efficiency FROM {D} d WHERE confidence_score IS NOT NULL GROUP BY extraction_method""",
)
def model_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    success = count_where("confidence_score >= 90")
    rows = DOMAINS.read(spark, sf).filter("confidence_score IS NOT NULL")
    return rows.groupBy(F.col("extraction_method").alias("model")).agg(F.count("*").alias("n"), success.alias("success"), count_where("confidence_score >= 50 AND confidence_score < 90").alias("partial"), F.avg("processing_time_ms").alias("avg_ms"), (success * 1000.0 / F.count("*") / F.avg("processing_time_ms")).alias("efficiency"))


METHODS = ["domain_parse", "footer_copyright", "html_title", "meta_property", "structured_data"]


@query("A32_category_by_model", f"SELECT coalesce(failure_category, 'none') AS category, {', '.join(f"count(*) FILTER (extraction_method = '{m}') AS {m}" for m in METHODS)} FROM {D} d GROUP BY 1")
def category_by_model(spark: SparkSession, sf: str) -> DataFrame:
    pivot = DOMAINS.read(spark, sf).groupBy(F.coalesce("failure_category", F.lit("none")).alias("category")).pivot("extraction_method", METHODS).count()
    return pivot.fillna(0, METHODS)


@query("A33_search_analysis", f"SELECT domain_id, count(*) AS n, count(*) FILTER (entity_status = 'ACTIVE') AS active, count(*) FILTER (registration_status = 'ISSUED') AS issued, list_sort(list_distinct(list(jurisdiction))) AS jurisdictions, count(DISTINCT legal_form) AS forms FROM {C} c GROUP BY domain_id")
def search_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return CANDIDATES.read(spark, sf).groupBy("domain_id").agg(F.count("*").alias("n"), count_where("entity_status = 'ACTIVE'").alias("active"), count_where("registration_status = 'ISSUED'").alias("issued"), F.array_sort(F.collect_set("jurisdiction")).alias("jurisdictions"), F.size(F.collect_set("legal_form")).cast("long").alias("forms"))


@query("A35_ner_report", f"SELECT count(*) FILTER (company_name IS NOT NULL) * 100.0 / count(*) AS success_rate, avg(processing_time_ms) AS avg_ms FROM {D} d")
def ner_report(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).agg((F.count("company_name") * 100.0 / F.count("*")).alias("success_rate"), F.avg("processing_time_ms").alias("avg_ms"))


@query("P2_batch_list", f"SELECT batch_id, total, processed, successful, processed - successful AS failed, CASE WHEN processed > 0 THEN floor(successful * 1000.0 / processed + 0.5) / 10 ELSE 0 END AS success_rate FROM (SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ('success', 'failed')) AS processed, count(*) FILTER (status = 'success') AS successful FROM {D} d GROUP BY batch_id) x")
def batch_list(spark: SparkSession, sf: str) -> DataFrame:
    per = DOMAINS.read(spark, sf).groupBy("batch_id").agg(F.count("*").alias("total"), count_where("status IN ('success', 'failed')").alias("processed"), count_where("status = 'success'").alias("successful"))
    return per.select("*", (F.col("processed") - F.col("successful")).alias("failed"), percent(F.col("successful"), F.col("processed"), 1).alias("success_rate"))


@query("N4_knowledge_accumulation", f"SELECT d.domain, c.lei_code, count(*) AS mapping_frequency, bool_or(c.rank_position = 1) AS is_primary FROM {C} c JOIN {D} d ON c.domain_id = d.id GROUP BY ALL")
def knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """How often each mapping was found; any primary finding makes it primary."""
    return mappings(spark, sf).select("domain", "lei_code", "mapping_frequency", "is_primary")
