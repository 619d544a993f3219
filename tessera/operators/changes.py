"""Writes that change stored tables: the relationship cache, cleaned data by model, updates by key, resets of a batch, primary selections, and knowledge that grows from a stream of finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.rounds import new_folder
from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, EDGES, ENTITIES
from tessera.sources.stored import StoredTable, exists

D, C, E, R = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql, EDGES.sql
#: Days that a cached answer holds; the times of the two fillings of the cache.
TTL_DAYS, FIRST_FILL, SECOND_FILL = 7, "2024-01-01 00:00:00", "2024-01-05 12:00:00"


def cached(edges: DataFrame, now: str) -> DataFrame:
    """``lei_code, parent_lei, ultimate_parent_lei, relationship_type, cached_at, expires_at``: the first parent of each entity and its ultimate one."""
    ultimate = F.col("relationship_type") == "IS_ULTIMATELY_CONSOLIDATED_BY"
    at = F.lit(now).cast("timestamp_ntz")
    per = edges.groupBy(F.col("child_lei").alias("lei_code")).agg(
        F.min("parent_lei").alias("parent_lei"), F.min(F.when(ultimate, F.col("parent_lei"))).alias("ultimate_parent_lei"), F.min_by("relationship_type", F.struct("parent_lei", "relationship_type")).alias("relationship_type")
    )
    return per.select("*", at.alias("cached_at"), (at + F.expr(f"INTERVAL {TTL_DAYS} DAYS")).alias("expires_at"))


@query(
    "K14_stored_cache",
    f"""SELECT child_lei AS lei_code, parent_lei, CASE WHEN relationship_type = 'IS_ULTIMATELY_CONSOLIDATED_BY' THEN parent_lei END AS ultimate_parent_lei, relationship_type, filled AS cached_at, filled + INTERVAL {TTL_DAYS} DAY AS expires_at
      FROM (SELECT *, CASE WHEN relationship_confidence % 3 = 0 THEN TIMESTAMP '{SECOND_FILL}' ELSE TIMESTAMP '{FIRST_FILL}' END AS filled FROM {R} r WHERE relationship_confidence % 3 = 0 OR relationship_confidence % 2 = 0) x""",
)
def stored_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A cache filled once and merged twice with a later filling, the second time to no effect: known entities get the new answer and a new expiry, unknown ones are added, the others stay."""
    edges = EDGES.read(spark, sf)
    table = StoredTable(spark, new_folder(spark, "cache")).create(cached(edges.filter("relationship_confidence % 2 = 0"), FIRST_FILL), ["lei_code"])
    for _ in range(2):
        table.merge(cached(edges.filter("relationship_confidence % 3 = 0"), SECOND_FILL), source="refresh", number=1)
    return table.read()


@query(
    "K15_stored_by_model",
    f"""SELECT domain, model, id, confidence_score, coalesce(runs, 1) AS runs FROM (SELECT domain, extraction_method AS model, id, confidence_score, count(*) OVER (PARTITION BY domain, extraction_method, id % 2) AS n,
        max(id % 2) OVER p + 1 - min(id % 2) OVER p AS runs, row_number() OVER (p ORDER BY id % 2 DESC, created_at DESC, id DESC) AS rn FROM {D} d WINDOW p AS (PARTITION BY domain, extraction_method)) x WHERE rn = 1""",
)
def stored_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned data by (domain, model): the runs of even ids first, those of odd ids merged over them; a row of both was updated once."""
    newest = Window.partitionBy("domain", "model").orderBy(F.desc("created_at"), F.desc("id"))
    rows = DOMAINS.read(spark, sf).select("domain", F.col("extraction_method").alias("model"), "id", "confidence_score", "created_at")
    one = lambda odd: rows.filter(F.col("id") % 2 == odd).withColumn("rn", F.row_number().over(newest)).filter("rn = 1").select("domain", "model", "id", "confidence_score", F.lit(1).cast("long").alias("runs"))
    table = StoredTable(spark, new_folder(spark, "models")).create(one(0), ["domain", "model"])
    values = {"id": F.col("new.id"), "confidence_score": F.col("new.confidence_score"), "runs": F.coalesce(F.col("old.runs"), F.lit(0)) + 1}
    table.merge(one(1), values)
    return table.read()


@query("K10_K21_stored_updates", f"SELECT id, batch_id, CASE WHEN id % 13 = 0 THEN 'success' ELSE status END AS status, CASE WHEN batch_id = 'b7' THEN NULL ELSE level2_status END AS level2_status, CASE WHEN batch_id = 'b7' THEN false ELSE level2_attempted END AS level2_attempted, CASE WHEN batch_id = 'b7' THEN NULL ELSE primary_lei_code END AS primary_lei_code FROM {D} d")
def stored_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows updated by key, then the second level of a batch reset in place."""
    rows = DOMAINS.read(spark, sf).select("id", "batch_id", "status", "level2_status", "level2_attempted", "primary_lei_code")
    table = StoredTable(spark, new_folder(spark, "domains")).create(rows, ["id"])
    table.merge(rows.filter("id % 13 = 0").select("id", F.lit("success").alias("status")), insert=False)
    table.update(F.col("batch_id") == "b7", {"level2_status": F.lit(None), "level2_attempted": F.lit(False), "primary_lei_code": F.lit(None)})
    return table.read()


CHOICE = "id % 6 = 0"


@query(
    "K11_selected_primary",
    f"""SELECT id, coalesce(c.lei_code, d.primary_lei_code) AS primary_lei_code, coalesce(c.legal_name, d.company_name) AS company_name, coalesce(c.weighted_score, d.confidence_score) AS confidence_score, CASE WHEN c.lei_code IS NULL THEN d.manual_review_required ELSE false END AS manual_review_required
      FROM {D} d LEFT JOIN (SELECT domain_id, lei_code, legal_name, weighted_score::DOUBLE AS weighted_score FROM {C} c WHERE domain_id % 6 = 0 QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY lei_code, tie1, tie2, tie3) = 1) c ON d.id = c.domain_id""",
)
def selected_primary(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewers choose a candidate for some domains, here the one of the lowest code: the choice becomes the only primary one and reaches the domain's row."""
    domains = DOMAINS.read(spark, sf).select("id", "primary_lei_code", "company_name", "confidence_score", "manual_review_required")
    table = StoredTable(spark, new_folder(spark, "primary")).create(domains, ["id"])
    w = Window.partitionBy("domain_id").orderBy("lei_code", "tie1", "tie2", "tie3")
    chosen = CANDIDATES.read(spark, sf).filter(F.expr(CHOICE.replace("id", "domain_id", 1))).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    table.merge(reselected(chosen), insert=False)
    return table.read()


def reselected(chosen: DataFrame) -> DataFrame:
    """What a chosen candidate (``domain_id, lei_code, legal_name, weighted_score``) writes into its domain."""
    return chosen.select(F.col("domain_id").alias("id"), F.col("lei_code").alias("primary_lei_code"), F.col("legal_name").alias("company_name"), F.col("weighted_score").cast("double").alias("confidence_score"), F.lit(False).alias("manual_review_required"))


def accumulate(rows: DataFrame, number: int, path: str) -> None:
    """Takes a micro batch of finds (``lei_code, legal_name, found_at``) into the stored entities: a find adds one to the frequency, the newest gives the name. A micro batch that comes again changes nothing."""
    met = rows.groupBy("lei_code").agg(F.count("*").alias("frequency"), F.max(F.struct("found_at", "legal_name")).alias("last"))
    met = met.select("lei_code", F.col("last.legal_name").alias("legal_name"), "frequency", F.col("last.found_at").alias("last_seen"))
    later = F.struct("new.last_seen", "new.legal_name") >= F.struct("old.last_seen", "old.legal_name")
    take = lambda c: F.when(F.col("old").isNull() | F.col("old.last_seen").isNull() | later, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    values = {"lei_code": F.col("new.lei_code"), "legal_name": take("legal_name"), "last_seen": take("last_seen"), "frequency": F.coalesce(F.col("old.frequency"), F.lit(0)) + F.col("new.frequency")}
    StoredTable(rows.sparkSession, path).merge(met, values, source="finds", number=number)


def follow_finds(finds: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a stream of finds into the stored entities at ``path``, which must exist."""
    return finds.writeStream.foreachBatch(lambda rows, number: accumulate(rows, number, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def find_stream(spark: SparkSession, sf: str, **options) -> DataFrame:
    """The candidates as a stream of files, with the registry as static side."""
    stored = spark.readStream.schema(spark.read.parquet(f"{sf}/lineitem.parquet").schema).options(**options).parquet(f"{sf}/lineitem.parque[t]")
    for name, left, right in CANDIDATES.joins:
        stored = stored.join(F.broadcast(spark.read.parquet(f"{sf}/{name}.parquet")) if name == "nation" else spark.read.parquet(f"{sf}/{name}.parquet"), F.col(left) == F.col(right))
    return stored.selectExpr(*[f"{e} AS {n}" for n, e in CANDIDATES.columns.items() if n in ("lei_code", "legal_name", "found_at")])


@query(
    "N4_finds_stream",
    f"""SELECT coalesce(p.lei_code, m.lei_code) AS lei_code, coalesce(m.newest, p.legal_name) AS legal_name, coalesce(p.discovery_frequency, 0) + coalesce(m.n, 0) AS frequency, m.last_seen FROM {E} p
      FULL JOIN (SELECT lei_code, count(*) AS n, max(found_at) AS last_seen, arg_max(legal_name, {{'t': found_at, 'n': legal_name}}) AS newest FROM {C} c GROUP BY lei_code) m ON p.lei_code = m.lei_code""",
)
def finds_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The stored entities after all candidates ran through the stream."""
    path = new_folder(spark, "knowledge")
    if not exists(spark, path):
        kind = CANDIDATES.read(spark, sf).schema["found_at"].dataType
        known = ENTITIES.read(spark, sf).select("lei_code", "legal_name", F.col("discovery_frequency").cast("long").alias("frequency"), F.lit(None).cast(kind).alias("last_seen"))
        StoredTable(spark, path).create(known, ["lei_code"])
    follow_finds(find_stream(spark, sf), path, f"{path}-checkpoint", availableNow=True).awaitTermination()
    return StoredTable(spark, path).read()
