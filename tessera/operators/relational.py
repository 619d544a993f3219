"""Point reads, filters, joins, rankings, sorts and set operations over domains, candidates and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, DUMPS, EDGES, ENTITIES, LOG

AS_OF = "2001-09-01 00:00:00"
D, C, E, R, P = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql, EDGES.sql, DUMPS.sql
#: The full order of a domain's candidates: score, then fields that settle ties.
BEST = "weighted_score DESC, rank_position, tie1, tie2, tie3"
#: Attempts of one domain that lie in one array, the most that each of its mappings opens at once.
ATTEMPTS = 1_000
#: Shares, a power of two, that the mappings of one domain are dealt to: each share meets each array of attempts on its own.
SHARES = 8


def ranked(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("rn", F.row_number().over(Window.partitionBy("domain_id").orderBy(F.desc("weighted_score"), "rank_position", "tie1", "tie2", "tie3")))


# --- point reads -----------------------------------------------------------------------------------------------


@query("S3_point_read", f"SELECT id, domain, batch_id, status FROM {D} d WHERE id = 42")
def point_read(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("id = 42").limit(1).select("id", "domain", "batch_id", "status")


@query("S21_lei_lookup", f"SELECT lei_code, legal_name, entity_status FROM {E} e WHERE lei_code = upper(substr(md5('7'), 1, 20)) AND length(lei_code) = 20")
def lei_lookup(spark: SparkSession, sf: str) -> DataFrame:
    code = F.upper(F.substring(F.md5(F.lit("7").cast("binary")), 1, 20))
    return ENTITIES.read(spark, sf).filter((F.col("lei_code") == code) & (F.length("lei_code") == 20)).select("lei_code", "legal_name", "entity_status")


@query("S19_bound_sql", f"SELECT status, count(*) AS n FROM {D} d WHERE batch_id = 'b3' AND confidence_score >= 50 GROUP BY status")
def bound_sql(spark: SparkSession, sf: str) -> DataFrame:
    """SQL passed through with its parameters bound."""
    return spark.sql("SELECT status, count(*) AS n FROM {domains} WHERE batch_id = :batch AND confidence_score >= :least GROUP BY status", args={"batch": "b3", "least": 50}, domains=DOMAINS.read(spark, sf))


# --- filters ---------------------------------------------------------------------------------------------------


@query("F1_conjunctive", f"SELECT id, domain FROM {D} d WHERE batch_id = 'b7' AND status = 'success'")
def conjunctive(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("batch_id = 'b7' AND status = 'success'").select("id", "domain")


@query("F2_ilike_domain", f"SELECT id, domain FROM {D} d WHERE domain ILIKE '%AUTO1%'")
def ilike_domain(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter(F.col("domain").ilike("%AUTO1%")).select("id", "domain")


@query("F3_ilike_either", f"SELECT id, domain, company_name FROM {D} d WHERE domain ILIKE '%hous12%' OR company_name ILIKE '%y 77%'")
def ilike_either(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter(F.col("domain").ilike("%hous12%") | F.col("company_name").ilike("%y 77%")).select("id", "domain", "company_name")


@query("F4_reusable_result", f"SELECT domain, max(confidence_score) AS best FROM {D} d WHERE status = 'success' AND confidence_score >= 85 GROUP BY domain")
def reusable(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("status = 'success' AND confidence_score >= 85").groupBy("domain").agg(F.max("confidence_score").alias("best"))


@query(
    "F5_level2_eligible_sql",
    f"""SELECT id FROM {D} d WHERE NOT level2_attempted AND ((status = 'failed' AND company_name IS NOT NULL)
        OR (status = 'success' AND confidence_score < 70) OR failure_category = 'Protected - Manual Review')""",
)
def level2_sql(spark: SparkSession, sf: str) -> DataFrame:
    failed = (F.col("status") == "failed") & F.col("company_name").isNotNull()
    low = (F.col("status") == "success") & (F.col("confidence_score") < 70)
    return DOMAINS.read(spark, sf).filter(~F.col("level2_attempted") & (failed | low | (F.col("failure_category") == "Protected - Manual Review"))).select("id")


@query(
    "F6_level2_eligible_app",
    f"""SELECT id FROM {D} d WHERE NOT level2_attempted AND (coalesce(status = 'failed' AND length(company_name) > 2, false)
        OR (status = 'success' AND coalesce(confidence_score, 0) < 95) OR coalesce(failure_category = 'Protected - Manual Review', false)
        OR coalesce(failure_category = 'incomplete_low_priority' AND company_name <> '', false)
        OR coalesce(status = 'success' AND length(company_name) > 3, false))""",
)
def level2_app(spark: SparkSession, sf: str) -> DataFrame:
    name, category = F.length("company_name"), F.col("failure_category")
    tests = [
        (F.col("status") == "failed") & (name > 2),
        (F.col("status") == "success") & (F.coalesce("confidence_score", F.lit(0)) < 95),
        category == "Protected - Manual Review",
        (category == "incomplete_low_priority") & (name > 0),
        (F.col("status") == "success") & (name > 3),
    ]
    return DOMAINS.read(spark, sf).filter(~F.col("level2_attempted") & F.exists(F.array(*tests), lambda x: F.coalesce(x, F.lit(False)))).select("id")


@query("F7_manual_review_queue", f"SELECT id, confidence_score FROM {D} d WHERE manual_review_required ORDER BY confidence_score DESC NULLS FIRST, id DESC LIMIT 50")
def manual_review(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("manual_review_required").orderBy(F.desc_nulls_first("confidence_score"), F.desc("id")).limit(50).select("id", "confidence_score")


@query("F8_stuck", f"SELECT id, batch_id FROM {D} d WHERE status = 'processing' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE")
def stuck(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter(f"status = 'processing' AND created_at < timestamp'{AS_OF}' - INTERVAL 5 MINUTES").select("id", "batch_id")


@query("F9_finished", f"SELECT count(*) AS n FROM {D} d WHERE status IN ('success', 'failed')")
def finished(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter(F.col("status").isin("success", "failed")).agg(F.count("*").alias("n"))


@query("F10_any_batch", f"SELECT batch_id, count(*) AS n FROM {D} d WHERE batch_id = ANY(['b1', 'b4', 'b9']) GROUP BY batch_id")
def any_batch(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter(F.col("batch_id").isin("b1", "b4", "b9")).groupBy("batch_id").agg(F.count("*").alias("n"))


@query("F11_prefix_patterns", f"SELECT lei_code, legal_name FROM {E} e WHERE legal_name LIKE 'Supplier#00000000%' OR legal_name LIKE 'Supplier#00000002%' ORDER BY lei_code LIMIT 100")
def prefix_patterns(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("legal_name")
    return ENTITIES.read(spark, sf).filter(name.startswith("Supplier#00000000") | name.startswith("Supplier#00000002")).orderBy("lei_code").limit(100).select("lei_code", "legal_name")


@query("F12_symmetric_edges", f"SELECT parent_lei, child_lei FROM {R} r WHERE parent_lei = upper(substr(md5('5'), 1, 20)) OR child_lei = upper(substr(md5('5'), 1, 20))")
def symmetric(spark: SparkSession, sf: str) -> DataFrame:
    edges, code = EDGES.read(spark, sf), F.upper(F.substring(F.md5(F.lit("5").cast("binary")), 1, 20))
    own = edges.filter(F.col("parent_lei") == code)
    return own.unionByName(edges.filter((F.col("child_lei") == code) & (F.col("parent_lei") != code))).select("parent_lei", "child_lei")


@query("F13_unexpired", f"SELECT lei_code FROM (SELECT lei_code, max(found_at) AS cached_at FROM {C} c GROUP BY lei_code) x WHERE cached_at + INTERVAL 7 DAY > TIMESTAMP '2001-11-01 00:00:00'")
def unexpired(spark: SparkSession, sf: str) -> DataFrame:
    """Cache entries live seven days."""
    return CANDIDATES.read(spark, sf).groupBy("lei_code").agg(F.max("found_at").alias("cached_at")).filter("cached_at + INTERVAL 7 DAYS > timestamp'2001-11-01 00:00:00'").select("lei_code")


@query("F14_first_log_row", f"SELECT min(seq) AS seq FROM {LOG.sql} l WHERE props LIKE '%\"k\": 42}}%'")
def first_log_row(spark: SparkSession, sf: str) -> DataFrame:
    return LOG.read(spark, sf).filter(F.get_json_object("props", "$.k") == "42").agg(F.min("seq").alias("seq"))


@query("F17_valid_dumps", f"SELECT dump_id FROM {P} p WHERE html IS NOT NULL AND (status IS NULL OR status IN ('completed', 'success'))")
def valid_dumps(spark: SparkSession, sf: str) -> DataFrame:
    return DUMPS.read(spark, sf).filter(F.col("html").isNotNull() & F.coalesce(F.col("status").isin("completed", "success"), F.lit(True))).select("dump_id")


@query(
    "F18_triage",
    f"""SELECT id, CASE WHEN retry_count >= 3 OR (retry_count >= 1 AND domain IN ('auto1.com', 'buil2.de', 'furn3.io', 'hous4.fr')) THEN 'circuit_breaker' ELSE 'continue' END AS triage FROM {D} d""",
)
def triage(spark: SparkSession, sf: str) -> DataFrame:
    """A circuit breaker after three tries, and after one for domains known to hang."""
    hanging = F.col("domain").isin("auto1.com", "buil2.de", "furn3.io", "hous4.fr")
    broken = (F.col("retry_count") >= 3) | ((F.col("retry_count") >= 1) & hanging)
    return DOMAINS.read(spark, sf).select("id", F.when(broken, "circuit_breaker").otherwise("continue").alias("triage"))


@query(
    "F19_retry_decision",
    f"""SELECT id, CASE WHEN error_message IS NULL THEN 'retry' WHEN error_message LIKE '%timeout%' THEN 'retry' WHEN error_message LIKE '%ENOTFOUND%' THEN 'give_up'
        WHEN error_message LIKE '%403%' THEN 'protected' ELSE 'retry' END AS decision FROM {D} d WHERE status = 'failed'""",
)
def retry_decision(spark: SparkSession, sf: str) -> DataFrame:
    error = F.coalesce("error_message", F.lit(""))
    decision = F.when(error.contains("timeout"), "retry").when(error.contains("ENOTFOUND"), "give_up").when(error.contains("403"), "protected").otherwise("retry")
    return DOMAINS.read(spark, sf).filter("status = 'failed'").select("id", decision.alias("decision"))


@query(
    "F20_J9_upload_dedup",
    f"SELECT DISTINCT domain FROM {D} d WHERE batch_id = 'b5' AND NOT EXISTS (SELECT 1 FROM {D} k WHERE k.domain = d.domain AND k.status = 'success' AND k.confidence_score >= 85)",
)
def upload_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """New uploads without domains that have a confident success."""
    domains = DOMAINS.read(spark, sf)
    good = domains.filter("status = 'success' AND confidence_score >= 85").select("domain")
    return domains.filter("batch_id = 'b5'").select("domain").join(good, "domain", "left_anti").distinct()


# --- joins -----------------------------------------------------------------------------------------------------


@query("J1_candidates_per_domain", f"SELECT d.id, count(c.lei_code) AS n, max(c.weighted_score) AS best FROM {D} d LEFT JOIN {C} c ON d.id = c.domain_id GROUP BY d.id")
def candidates_per_domain(spark: SparkSession, sf: str) -> DataFrame:
    per = CANDIDATES.read(spark, sf).groupBy("domain_id").agg(F.count("*").alias("n"), F.max("weighted_score").alias("best"))
    return DOMAINS.read(spark, sf).join(per, F.col("id") == F.col("domain_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "best")


def mappings(spark: SparkSession, sf: str) -> DataFrame:
    """Domain to entity, with the number of candidates behind it and whether one was first."""
    joined = CANDIDATES.read(spark, sf).join(DOMAINS.read(spark, sf).select("id", "domain"), F.col("domain_id") == F.col("id"))
    return joined.groupBy("domain", "lei_code").agg(F.count("*").alias("mapping_frequency"), F.max("weighted_score").alias("mapping_confidence"), F.max(F.col("rank_position") == 1).alias("is_primary"))


M = f"(SELECT d.domain, c.lei_code, count(*) AS mapping_frequency, max(c.weighted_score) AS mapping_confidence, bool_or(c.rank_position = 1) AS is_primary FROM {C} c JOIN {D} d ON c.domain_id = d.id GROUP BY d.domain, c.lei_code)"


@query("J2_mappings_with_attempts", f"SELECT m.domain, m.lei_code, m.mapping_frequency, d.id, d.status FROM {M} m JOIN {D} d ON m.domain = d.domain WHERE m.domain LIKE 'auto1%'")
def mappings_with_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each past attempt of the domain, by design: the result is the product of a domain's mappings and attempts. It is dealt to tasks in blocks, a share of the mappings with an array of attempts, so that neither a domain nor a few
    of them weigh on one task; the attempts of a block travel as one array, which each mapping opens."""
    attempts = DOMAINS.read(spark, sf).filter(F.col("domain").startswith("auto1")).select("domain", "id", "status")
    number = F.row_number().over(Window.partitionBy("domain").orderBy("id", "status"))
    attempts = attempts.withColumn("part", F.floor((number - 1) / ATTEMPTS).cast("int"))
    parts = attempts.groupBy("domain").agg(F.max("part").alias("last"))
    arrays = attempts.groupBy("domain", "part").agg(F.collect_list(F.struct("id", "status")).alias("attempts"))
    arrays = arrays.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    found = mappings(spark, sf).select("domain", "lei_code", "mapping_frequency").join(parts, "domain").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))
    found = found.withColumn("share", F.hash("lei_code").bitwiseAND(SHARES - 1))  # never null, so no check of it goes down to the scan
    block = ["domain", "part", "share"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that small inputs of a large product aren't packed into one task
    return found.repartition(tasks, *block).join(arrays.repartition(tasks, *block), block).select("domain", "lei_code", "mapping_frequency", F.inline("attempts"))


@query(
    "J3_edges_with_names",
    f"""SELECT r.parent_lei, p.legal_name AS parent_name, r.child_lei, c.legal_name AS child_name, r.relationship_type
        FROM {R} r LEFT JOIN {E} p ON r.parent_lei = p.lei_code LEFT JOIN {E} c ON r.child_lei = c.lei_code WHERE p.jurisdiction = 'US' OR c.jurisdiction = 'US'""",
)
def edges_with_names(spark: SparkSession, sf: str) -> DataFrame:
    names = ENTITIES.read(spark, sf).select("lei_code", "legal_name", "jurisdiction")
    parent = names.select(F.col("lei_code").alias("parent_lei"), F.col("legal_name").alias("parent_name"), F.col("jurisdiction").alias("pj"))
    child = names.select(F.col("lei_code").alias("child_lei"), F.col("legal_name").alias("child_name"), F.col("jurisdiction").alias("cj"))
    return EDGES.read(spark, sf).join(parent, "parent_lei", "left").join(child, "child_lei", "left").filter("pj = 'US' OR cj = 'US'").select("parent_lei", "parent_name", "child_lei", "child_name", "relationship_type")


@query(
    "J4_attempts_with_totals",
    f"""SELECT d.id, d.domain, s.total_attempts, s.batch_count FROM {D} d JOIN (SELECT md5(domain) AS h, count(*) AS total_attempts, count(DISTINCT batch_id) AS batch_count FROM {D} x GROUP BY md5(domain)) s ON md5(d.domain) = s.h""",
)
def attempts_with_totals(spark: SparkSession, sf: str) -> DataFrame:
    domains = DOMAINS.read(spark, sf).select("id", "domain", "batch_id", F.md5(F.col("domain").cast("binary")).alias("h"))
    totals = domains.groupBy("h").agg(F.count("*").alias("total_attempts"), F.count_distinct("batch_id").alias("batch_count"))
    return domains.join(totals, "h").select("id", "domain", "total_attempts", "batch_count")


@query(
    "J6_session_models",
    f"""SELECT s.batch_id, l.event, count(*) AS n FROM (SELECT batch_id, list_distinct(list(event)) AS models FROM {LOG.sql} x WHERE ms > 100 GROUP BY batch_id) s
        LEFT JOIN {LOG.sql} l ON s.batch_id = l.batch_id AND list_contains(s.models, l.event) GROUP BY s.batch_id, l.event""",
)
def session_models(spark: SparkSession, sf: str) -> DataFrame:
    """An equi join whose residual tests membership in an array."""
    log = LOG.read(spark, sf)
    sessions = log.filter("ms > 100").groupBy("batch_id").agg(F.collect_set("event").alias("models"))
    l = log.select(F.col("batch_id").alias("b"), "event")
    joined = sessions.join(l, (F.col("batch_id") == F.col("b")) & F.array_contains("models", F.col("event")), "left")
    return joined.groupBy("batch_id", "event").agg(F.count("*").alias("n"))


@query("J10_W8_seen_earlier", f"SELECT id, EXISTS (SELECT 1 FROM {D} e WHERE e.domain = d.domain AND e.created_at < d.created_at) AS seen_earlier FROM {D} d")
def seen_earlier(spark: SparkSession, sf: str) -> DataFrame:
    first = F.min("created_at").over(Window.partitionBy("domain"))
    return DOMAINS.read(spark, sf).select("id", (first < F.col("created_at")).alias("seen_earlier"))


@query("J11_K13_delete_by_batch", f"SELECT count(*) AS n FROM {C} c WHERE domain_id NOT IN (SELECT id FROM {D} d WHERE batch_id = 'b2')")
def delete_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    """What is left after the candidates of a batch's domains are deleted."""
    gone = DOMAINS.read(spark, sf).filter("batch_id = 'b2'").select(F.col("id").alias("domain_id"))
    return CANDIDATES.read(spark, sf).join(gone, "domain_id", "left_anti").agg(F.count("*").alias("n"))


@query(
    "J13_three_hops",
    f"""SELECT m.domain, m.lei_code, e.legal_name, count(r.child_lei) AS n_children FROM {M} m JOIN {E} e ON m.lei_code = e.lei_code LEFT JOIN {R} r ON r.parent_lei = e.lei_code
        WHERE m.is_primary GROUP BY m.domain, m.lei_code, e.legal_name""",
)
def three_hops(spark: SparkSession, sf: str) -> DataFrame:
    children = EDGES.read(spark, sf).groupBy(F.col("parent_lei").alias("lei_code")).agg(F.count("*").alias("n_children"))
    entities = ENTITIES.read(spark, sf).select("lei_code", "legal_name").join(children, "lei_code", "left")
    return mappings(spark, sf).filter("is_primary").join(entities, "lei_code").select("domain", "lei_code", "legal_name", F.coalesce("n_children", F.lit(0)).alias("n_children"))


@query(
    "J14_entity_profile",
    f"""SELECT e.lei_code, (SELECT count(*) FROM {M} m WHERE m.lei_code = e.lei_code) AS n_domains, (SELECT count(*) FROM {R} r WHERE r.parent_lei = e.lei_code OR r.child_lei = e.lei_code) AS n_relationships FROM {E} e""",
)
def entity_profile(spark: SparkSession, sf: str) -> DataFrame:
    domains = mappings(spark, sf).groupBy("lei_code").agg(F.count("*").alias("n_domains"))
    edges = EDGES.read(spark, sf)
    ends = edges.select(F.explode(F.array_distinct(F.array("parent_lei", "child_lei"))).alias("lei_code")).groupBy("lei_code").agg(F.count("*").alias("n_relationships"))
    joined = ENTITIES.read(spark, sf).join(domains, "lei_code", "left").join(ends, "lei_code", "left")
    return joined.select("lei_code", F.coalesce("n_domains", F.lit(0)).alias("n_domains"), F.coalesce("n_relationships", F.lit(0)).alias("n_relationships"))


@query(
    "J17_related_entities",
    f"""SELECT x.me, o.legal_name AS related_name, x.relationship_type FROM (SELECT parent_lei AS me, child_lei AS other, relationship_type FROM {R} r UNION ALL SELECT child_lei, parent_lei, relationship_type FROM {R} r2) x
        JOIN {E} e ON x.me = e.lei_code JOIN {E} o ON x.other = o.lei_code WHERE e.entity_status = 'ACTIVE'""",
)
def related_entities(spark: SparkSession, sf: str) -> DataFrame:
    edges, entities = EDGES.read(spark, sf), ENTITIES.read(spark, sf)
    both = edges.select(F.col("parent_lei").alias("me"), F.col("child_lei").alias("other"), "relationship_type").unionAll(edges.select("child_lei", "parent_lei", "relationship_type"))
    active = entities.filter("entity_status = 'ACTIVE'").select(F.col("lei_code").alias("me"))
    names = entities.select(F.col("lei_code").alias("other"), F.col("legal_name").alias("related_name"))
    return both.join(active, "me").join(names, "other").select("me", "related_name", "relationship_type")


#: Confidence from which a result counts as known.
KNOWN_FROM = 95


@query("J18_known_company", f"SELECT d.id, k.name AS known_name FROM {D} d LEFT JOIN (SELECT domain, min(company_name) AS name FROM {D} x WHERE status = 'success' AND confidence_score >= {KNOWN_FROM} AND company_name IS NOT NULL GROUP BY domain) k ON d.domain = k.domain")
def known_company(spark: SparkSession, sf: str) -> DataFrame:
    """Exact lookup in a dictionary of domains, here the companies that certain results name."""
    domains = DOMAINS.read(spark, sf)
    certain = domains.filter(f"status = 'success' AND confidence_score >= {KNOWN_FROM} AND company_name IS NOT NULL")
    known = certain.groupBy("domain").agg(F.min("company_name").alias("known_name"))
    return domains.join(known, "domain", "left").select("id", "known_name")


# --- rankings --------------------------------------------------------------------------------------------------


@query("W1_rank_candidates", f"SELECT domain_id, lei_code, row_number() OVER (PARTITION BY domain_id ORDER BY {BEST}) AS rn, row_number() OVER (PARTITION BY domain_id ORDER BY {BEST}) = 1 AS is_primary FROM {C} c")
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(CANDIDATES.read(spark, sf)).select("domain_id", "lei_code", "rn", (F.col("rn") == 1).alias("is_primary"))


@query(
    "W2_close_call",
    f"""SELECT domain_id, top - second < 15 AS needs_review FROM (SELECT domain_id, max(CASE WHEN rn = 1 THEN weighted_score END) AS top, max(CASE WHEN rn = 2 THEN weighted_score END) AS second
        FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY {BEST}) AS rn FROM {C} c) x GROUP BY domain_id) y WHERE second IS NOT NULL""",
)
def close_call(spark: SparkSession, sf: str) -> DataFrame:
    """Review where the two best scores are less than 15 apart."""
    top = ranked(CANDIDATES.read(spark, sf)).filter("rn <= 2").groupBy("domain_id").agg(F.max(F.when(F.col("rn") == 1, F.col("weighted_score"))).alias("top"), F.max(F.when(F.col("rn") == 2, F.col("weighted_score"))).alias("second"))
    return top.filter("second IS NOT NULL").select("domain_id", (F.col("top") - F.col("second") < 15).alias("needs_review"))


@query("W3_top_five", f"SELECT domain_id, lei_code, rn FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY {BEST}) AS rn FROM {C} c) x WHERE rn <= 5")
def top_five(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(CANDIDATES.read(spark, sf)).filter("rn <= 5").select("domain_id", "lei_code", "rn")


@query("W5_daily_sequence", f"SELECT seq, row_number() OVER (PARTITION BY cast(ts AS DATE) ORDER BY ts, seq) AS daily_sequence FROM {LOG.sql} l")
def daily_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return LOG.read(spark, sf).select("seq", F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "seq")).alias("daily_sequence"))


@query("W6_keep_best_per_lei", f"SELECT lei_code, domain_id, weighted_score FROM (SELECT *, row_number() OVER (PARTITION BY lei_code ORDER BY weighted_score DESC, domain_id, rank_position, tie1, tie3) AS rn FROM {C} c) x WHERE rn = 1")
def keep_best(spark: SparkSession, sf: str) -> DataFrame:
    """The first of the best; a rank keeps it stable where max_by would not."""
    w = Window.partitionBy("lei_code").orderBy(F.desc("weighted_score"), "domain_id", "rank_position", "tie1", "tie3")
    return CANDIDATES.read(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("lei_code", "domain_id", "weighted_score")


@query(
    "W7_replace_low",
    f"""SELECT lei_code, domain_id FROM (SELECT *, row_number() OVER (PARTITION BY lei_code ORDER BY CASE WHEN weighted_score < 40 THEN 1 ELSE 0 END, domain_id, rank_position, tie1, tie3) AS rn FROM {C} c) x WHERE rn = 1""",
)
def replace_low(spark: SparkSession, sf: str) -> DataFrame:
    """The first of a key, but one of low confidence gives way to the first that is not."""
    w = Window.partitionBy("lei_code").orderBy(F.when(F.col("weighted_score") < 40, 1).otherwise(0), "domain_id", "rank_position", "tie1", "tie3")
    return CANDIDATES.read(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("lei_code", "domain_id")


@query("W11_latest_per_domain", f"SELECT domain, id, status FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id DESC) AS rn FROM {D} d) x WHERE rn = 1")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("domain").orderBy(F.desc("created_at"), F.desc("id"))
    return DOMAINS.read(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("domain", "id", "status")


# --- sorts and limits ------------------------------------------------------------------------------------------


@query("O1_page", f"SELECT id, created_at FROM {D} d ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def page(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).offset(100).limit(50)


@query("O2_two_keys", f"SELECT id, confidence_score FROM {D} d WHERE confidence_score IS NOT NULL ORDER BY confidence_score DESC, id DESC LIMIT 20")
def two_keys(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).filter("confidence_score IS NOT NULL").select("id", "confidence_score").orderBy(F.desc("confidence_score"), F.desc("id")).limit(20)


@query("O3_nulls_last", f"SELECT id, processing_time_ms FROM {D} d ORDER BY processing_time_ms DESC NULLS LAST, id LIMIT 25")
def nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).select("id", "processing_time_ms").orderBy(F.desc_nulls_last("processing_time_ms"), "id").limit(25)


@query("O4_top_entities", f"SELECT lei_code, discovery_frequency FROM {E} e ORDER BY discovery_frequency DESC, lei_code LIMIT 10")
def top_entities(spark: SparkSession, sf: str) -> DataFrame:
    return ENTITIES.read(spark, sf).select("lei_code", "discovery_frequency").orderBy(F.desc("discovery_frequency"), "lei_code").limit(10)


@query("O5_by_rank", f"SELECT lei_code, rank_position, tie1, tie3 FROM {C} c WHERE domain_id = 77 ORDER BY rank_position")
def by_rank(spark: SparkSession, sf: str) -> DataFrame:
    return CANDIDATES.read(spark, sf).filter("domain_id = 77").select("lei_code", "rank_position", "tie1", "tie3").orderBy("rank_position")


@query("O6_U1_merged_dumps", f"SELECT dump_id, source_type FROM {P} p ORDER BY created_seq DESC, dump_id LIMIT 40")
def merged_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Four sources merged newest first: one scan, since one table holds them."""
    kinds = ("crawlee_dump", "scrapy_crawl", "playwright_dump", "axios_cheerio_dump")
    merged = DUMPS.read(spark, sf).select("dump_id", "source_type", "created_seq").filter(F.col("source_type").isin(*kinds))
    return merged.orderBy(F.desc("created_seq"), "dump_id").limit(40).select("dump_id", "source_type")


@query("S4_newest_dumps_per_kind", f"SELECT source_type, dump_id FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY created_seq DESC, dump_id) AS rn FROM {P} p WHERE status = 'completed' AND html IS NOT NULL) x WHERE rn <= 20")
def newest_dumps(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("source_type").orderBy(F.desc("created_seq"), "dump_id")
    return DUMPS.read(spark, sf).filter("status = 'completed' AND html IS NOT NULL").withColumn("rn", F.row_number().over(w)).filter("rn <= 20").select("source_type", "dump_id")


@query("S5_S20_dump_by_id", f"SELECT dump_id, source_type, CASE source_type WHEN 'axios_cheerio_dump' THEN length(html) ELSE NULL END AS html_length FROM {P} p WHERE source_type = 'axios_cheerio_dump' AND dump_id = 7")
def dump_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return DUMPS.read(spark, sf).filter("source_type = 'axios_cheerio_dump' AND dump_id = 7").select("dump_id", "source_type", F.length("html").alias("html_length"))


@query("O7_validated_only", f"SELECT lei_code, balance FROM {E} e WHERE balance >= 15 ORDER BY balance DESC, lei_code")
def validated_only(spark: SparkSession, sf: str) -> DataFrame:
    return ENTITIES.read(spark, sf).filter("balance >= 15").select("lei_code", "balance").orderBy(F.desc("balance"), "lei_code")


# --- set operations --------------------------------------------------------------------------------------------


@query("U2_success_and_failed", f"SELECT id, status FROM {D} d WHERE status = 'success' UNION ALL SELECT id, status FROM {D} d2 WHERE status = 'failed'")
def success_and_failed(spark: SparkSession, sf: str) -> DataFrame:
    domains = DOMAINS.read(spark, sf).select("id", "status")
    return domains.filter("status = 'success'").unionAll(domains.filter("status = 'failed'"))


@query("U4_first_occurrences", f"SELECT domain, min(id) AS first_id FROM {D} d GROUP BY domain")
def first_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return DOMAINS.read(spark, sf).groupBy("domain").agg(F.min("id").alias("first_id"))


@query("U5_caseless_names", f"SELECT id, company_name FROM (SELECT id, company_name, row_number() OVER (PARTITION BY lower(trim(company_name)) ORDER BY id) AS rn FROM {D} d WHERE company_name IS NOT NULL) x WHERE rn = 1")
def caseless_names(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(F.lower(F.trim("company_name"))).orderBy("id")
    return DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "company_name")


@query("U7_dumps_with_preview", f"SELECT dump_id, source_type, length(html) AS size, substr(html, 1, 80) AS preview FROM {P} p WHERE source_type <> 'scrapy_crawl' AND length(html) > 1000 ORDER BY created_seq DESC, dump_id LIMIT 30")
def dumps_with_preview(spark: SparkSession, sf: str) -> DataFrame:
    dumps = DUMPS.read(spark, sf).filter(F.col("source_type") != "scrapy_crawl").withColumn("size", F.length("html")).filter("size > 1000")
    return dumps.orderBy(F.desc("created_seq"), "dump_id").limit(30).select("dump_id", "source_type", "size", F.substring("html", 1, 80).alias("preview"))
