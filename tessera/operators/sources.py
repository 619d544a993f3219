"""Queries over the sources: uploads, registry searches, the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.register import query
from tessera.sources import files
from tessera.sources.logical import DOMAINS, DUMPS, ENTITIES, LOG

D, E, G, P = DOMAINS.sql, ENTITIES.sql, LOG.sql, DUMPS.sql


@query("S1_upload_first_cells", f"SELECT domain FROM {D} d WHERE id % 3 <> 0 AND regexp_matches(domain, '^[a-zA-Z0-9]([a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?(\\.[a-zA-Z]{{2,}}){{1,2}}$')")
def upload_first_cells(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.when(F.col("id") % 3 == 0, F.concat(F.lit("not a domain "), "domain")).otherwise(F.col("domain"))
    return files.first_cells(DOMAINS.read(spark, sf).select(F.concat(F.lit("  "), broken, F.lit(" ,note,1")).alias("value")))


@query("S2_upload_all_cells", f"SELECT DISTINCT x AS domain FROM (SELECT unnest([domain, lower(concat('shop', id % 50, '.de'))]) AS x FROM {D} d) y")
def upload_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit('"'), F.upper("domain"), F.lit('", SHOP'), (F.col("id") % 50).cast("string"), F.lit(".de,x"))
    return files.all_cells(DOMAINS.read(spark, sf).select(line.alias("value")))


@query("S6_S7_registry_search", f"SELECT lei_code, legal_name FROM {E} e WHERE legal_name ILIKE '%gmbh%' AND jurisdiction = 'DE' ORDER BY lei_code LIMIT 10")
def registry_search(spark: SparkSession, sf: str) -> DataFrame:
    return files.registry_search(ENTITIES.read(spark, sf), "GMBH", "geographic", "DE").select("lei_code", "legal_name")


@query("S6_exact_search", f"SELECT lei_code, legal_name FROM {E} e WHERE lower(legal_name) = 'supplier#000000003' ORDER BY lei_code LIMIT 10")
def exact_search(spark: SparkSession, sf: str) -> DataFrame:
    return files.registry_search(ENTITIES.read(spark, sf), "Supplier#000000003").select("lei_code", "legal_name")


@query("S8_prefix_search", f"SELECT lei_code, legal_name FROM {E} e WHERE contains(legal_name, 'Supplier#000000021') ORDER BY CASE WHEN starts_with(legal_name, 'Supplier#000000021') THEN 0 ELSE 1 END, lei_code LIMIT 200")
def prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    return files.prefix_search(ENTITIES.read(spark, sf), "Supplier#000000021 Inc").select("lei_code", "legal_name")


@query("S9_flat_record", f"SELECT lei_code, legal_name, jurisdiction, entity_status, city FROM {E} e")
def flat_record(spark: SparkSession, sf: str) -> DataFrame:
    entity = F.struct(F.struct(F.col("legal_name").alias("name")).alias("legalName"), "jurisdiction", F.col("entity_status").alias("status"), F.struct("city").alias("legalAddress"))
    raw = ENTITIES.read(spark, sf).select(F.to_json(F.struct(F.struct(F.col("lei_code").alias("lei"), entity.alias("entity")).alias("attributes"))).alias("json"))
    return files.flat_record(raw)


@query("S16_log_list", f"SELECT batch_id, count(*) AS events, arg_min(event, {{'t': ts, 's': seq}}) AS first_event, arg_max(event, {{'t': ts, 's': seq}}) AS last_event, max(ts) AS last_at FROM {G} l GROUP BY batch_id")
def log_list(spark: SparkSession, sf: str) -> DataFrame:
    at = F.struct("ts", "seq")
    per = LOG.read(spark, sf).groupBy("batch_id").agg(F.count("*").alias("events"), F.min_by("event", at).alias("first_event"), F.max_by("event", at).alias("last_event"), F.max("ts").alias("last_at"))
    return per.orderBy(F.desc("last_at"))


@query("S17_batch_log", f"SELECT seq, event, ms FROM {G} l WHERE batch_id = 'b4'")
def batch_log(spark: SparkSession, sf: str) -> DataFrame:
    return LOG.read(spark, sf).filter("batch_id = 'b4'").select("seq", "event", "ms")


@query(
    "S22_S23_claim_input",
    f"""SELECT p.domain, coalesce(t.title, p.domain) AS best, p.dump_id FROM (SELECT domain, dump_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created_seq DESC, dump_id) AS rn FROM {P} x) y WHERE rn = 1) p
        LEFT JOIN (SELECT dump_id, nullif(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1), '') AS title FROM {P} z) t ON p.dump_id = t.dump_id""",
)
def claim_input(spark: SparkSession, sf: str) -> DataFrame:
    """The newest dump of each domain; its title, or else the domain."""
    newest = DUMPS.read(spark, sf).groupBy("domain").agg(F.max_by(F.struct("dump_id", "html"), F.struct("created_seq", -F.col("dump_id"))).alias("x"))
    title = F.nullif(F.regexp_extract("x.html", r"(?i)<title[^>]*>([^<]*)</title>", 1), F.lit(""))
    return newest.select("domain", F.coalesce(title, "domain").alias("best"), F.col("x.dump_id").alias("dump_id"))
