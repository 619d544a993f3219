"""What searches leave behind: link priorities, ranked answers, accumulated entities and mappings, the cache, and records as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.evidence import quoted
from tessera.operators.ladders import LINK, flat, flat_sql
from tessera.operators.scoring import contains_any
from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, DOMAINS, DUMPS, EDGES, ENTITIES

D, C, E, P = DOMAINS.sql, CANDIDATES.sql, ENTITIES.sql, DUMPS.sql

# What makes a link worth following.
LINK_WORTH = [(("/about",), ("about",), 3), (("/company",), ("company",), 3), (("/contact",), ("contact",), 2), (("/products", "/services"), (), 2), (("/blog", "/news"), (), 1)]
NO_PAGE, DOCUMENT = ("#", "javascript:"), (".pdf", ".doc")
MOST_LINKS = 10


def link_priority(url: Column, text: Column) -> Column:
    """The sum of what address and text are worth; anchors and scripts -10, documents -5."""
    url, text = F.lower(url), F.lower(text)
    holds = lambda column, words: contains_any(column, list(words))
    total = sum((F.when(holds(url, a) | holds(text, b), worth).otherwise(0) for a, b, worth in LINK_WORTH), F.lit(0))
    return F.when(holds(url, DOCUMENT), -5).when(holds(url, NO_PAGE), -10).otherwise(total)


def link_key(url: Column) -> Column:
    """The address without fragment, tracking, index files and a slash at the end."""
    key = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*", "")
    key = F.regexp_replace(key, r"^([^?&]*)&", "$1?")  # what follows a tracking parameter that came first
    return F.regexp_replace(F.regexp_replace(key, r"/index\.(html?|php)$", ""), r"/$", "")


_any = lambda column, words: "(" + (" OR ".join(f"contains({column}, '{w}')" for w in words) or "false") + ")"
PRIORITY_SQL = f"CASE WHEN {_any('lower(href)', DOCUMENT)} THEN -5 WHEN {_any('lower(href)', NO_PAGE)} THEN -10 ELSE {' + '.join(f'CASE WHEN {_any("lower(href)", a)} OR {_any("lower(label)", b)} THEN {w} ELSE 0 END' for a, b, w in LINK_WORTH)} END"
KEY_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(href, '#.*$', ''), '([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*', '', 'g'), '^([^?&]*)&', '\\1?'), '/index\\.(html?|php)$', ''), '/$', '')"


@query(
    "S11_S12_link_priority",
    f"""SELECT dump_id, link, priority, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY priority DESC, link) AS rn FROM (SELECT dump_id, link, max(priority) AS priority FROM (
        SELECT dump_id, {KEY_SQL} AS link, {PRIORITY_SQL} AS priority FROM (SELECT dump_id, list_extract(h, i) AS href, {flat_sql('list_extract(l, i)')} AS label FROM (SELECT dump_id, h, l, unnest(range(1, len(h) + 1)) AS i FROM (
          SELECT dump_id, regexp_extract_all(html, {quoted(LINK)}, 1) AS h, regexp_extract_all(html, {quoted(LINK)}, 2) AS l FROM {P} p) a) b) c) d GROUP BY 1, 2) e) f WHERE rn <= {MOST_LINKS}""",
)
def link_priorities(spark: SparkSession, sf: str) -> DataFrame:
    """The ten links of each page that are most worth following; of equal addresses the highest priority stays."""
    links = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label"))
    rows = DUMPS.read(spark, sf).select("dump_id", F.explode(links).alias("x"))
    each = rows.select("dump_id", link_key(F.col("x.href")).alias("link"), link_priority(F.col("x.href"), flat(F.col("x.label"))).alias("priority"))
    best = each.groupBy("dump_id", "link").agg(F.max("priority").alias("priority"))
    w = Window.partitionBy("dump_id").orderBy(F.desc("priority"), "link")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= MOST_LINKS).select("dump_id", "link", "priority", F.col("place").cast("long").alias("place"))


def similarity_v3(name: Column, term: Column) -> Column:
    """100 equal, 90 contained, else 80 times the share of words of more than two letters that contain or are contained; 20 without such words."""
    a, b = F.lower(F.trim(name)), F.lower(F.trim(term))
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 2)
    shared = F.size(F.filter(words(a), lambda w: F.exists(words(b), lambda v: w.contains(v) | v.contains(w))))
    some = F.floor(shared / F.greatest(F.size(words(a)), F.size(words(b))) * 80 + 0.5)
    return F.when(a == b, 100).when(a.contains(b) | b.contains(a), 90).when((F.size(words(a)) == 0) | (F.size(words(b)) == 0), 20).otherwise(some)


WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: length(w) > 2)"
SIMILARITY_SQL = f"""CASE WHEN a = b THEN 100 WHEN contains(a, b) OR contains(b, a) THEN 90 WHEN len({WORDS('a')}) = 0 OR len({WORDS('b')}) = 0 THEN 20
  ELSE floor(len(list_filter({WORDS('a')}, lambda w: len(list_filter({WORDS('b')}, lambda v: contains(w, v) OR contains(v, w))) > 0)) / greatest(len({WORDS('a')}), len({WORDS('b')})) * 80 + 0.5) END"""


def entity_score(name: Column, term: Column, status: Column, registration: Column, country: Column, city: Column, form: Column, category: Column) -> Column:
    """Name 40, status 25 or 10, registration 20, 15 or 10, 2 for each of country, city and form, category 5 or 3; rounded."""
    total = similarity_v3(name, term) * 0.4 + F.when(status == "ACTIVE", 25).when(status == "INACTIVE", 10).otherwise(0)
    total = total + F.when(registration == "ISSUED", 20).when(registration == "PENDING_VALIDATION", 15).when(registration == "LAPSED", 10).otherwise(0)
    total = total + sum((F.when(F.coalesce(x, F.lit("")) != "", 2).otherwise(0) for x in (country, city, form)), F.lit(0)) + F.when(category == "GENERAL", 5).when(category == "FUND", 3).otherwise(0)
    return F.floor(total + 0.5)


ANSWERS_SQL = f"""(SELECT c.domain_id, c.lei_code, c.tie1, c.tie3, c.jurisdiction, c.legal_form, c.entity_status, c.registration_status, c.city, e.category, lower(trim(c.legal_name)) AS a, lower(trim(d.company_name)) AS b
  FROM {C} c JOIN {D} d ON c.domain_id = d.id LEFT JOIN {E} e ON c.lei_code = e.lei_code WHERE d.company_name IS NOT NULL)"""
ENTITY_SCORE_SQL = f"""cast(floor(({SIMILARITY_SQL}) * 0.4::DOUBLE + CASE entity_status WHEN 'ACTIVE' THEN 25 WHEN 'INACTIVE' THEN 10 ELSE 0 END + CASE registration_status WHEN 'ISSUED' THEN 20 WHEN 'PENDING_VALIDATION' THEN 15 WHEN 'LAPSED' THEN 10 ELSE 0 END
  + {' + '.join(f"CASE WHEN coalesce({x}, '') <> '' THEN 2 ELSE 0 END" for x in ('jurisdiction', 'city', 'legal_form'))} + CASE category WHEN 'GENERAL' THEN 5 WHEN 'FUND' THEN 3 ELSE 0 END + 0.5) AS BIGINT)"""


@query(
    "A33_X29_search_analysis",
    f"""SELECT domain_id, lei_code, tie1, tie3, score, row_number() OVER (PARTITION BY domain_id ORDER BY score DESC, lei_code, tie1, tie3) AS place, CASE WHEN max(score) OVER w >= 85 THEN 'high' WHEN max(score) OVER w >= 65 THEN 'medium' ELSE 'low' END AS confidence,
        count(*) OVER w AS total, count(*) FILTER (entity_status = 'ACTIVE') OVER w AS active, count(*) FILTER (registration_status = 'ISSUED') OVER w AS issued FROM (SELECT *, {ENTITY_SCORE_SQL} AS score FROM {ANSWERS_SQL} x) y WINDOW w AS (PARTITION BY domain_id)""",
)
def search_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """The entities that a search found, scored and ranked, with the search's confidence and counts."""
    c = F.col
    domains = DOMAINS.read(spark, sf).filter("company_name IS NOT NULL").select(c("id").alias("domain_id"), "company_name")
    rows = CANDIDATES.read(spark, sf).join(domains, "domain_id").join(ENTITIES.read(spark, sf).select("lei_code", "category"), "lei_code", "left")
    score = entity_score(c("legal_name"), c("company_name"), c("entity_status"), c("registration_status"), c("jurisdiction"), c("city"), c("legal_form"), c("category"))
    found = Window.partitionBy("domain_id")
    scored = rows.select("domain_id", "lei_code", "tie1", "tie3", "entity_status", "registration_status", score.alias("score"))
    best = F.max("score").over(found)
    counted = lambda test: F.count_if(test).over(found)
    return scored.select(
        "domain_id", "lei_code", "tie1", "tie3", "score", F.row_number().over(found.orderBy(F.desc("score"), "lei_code", "tie1", "tie3")).cast("long").alias("place"), F.when(best >= 85, "high").when(best >= 65, "medium").otherwise("low").alias("confidence"),
        F.count("*").over(found).alias("total"), counted(c("entity_status") == "ACTIVE").alias("active"), counted(c("registration_status") == "ISSUED").alias("issued"),
    )


def accumulated(prior: DataFrame, found: DataFrame) -> DataFrame:
    """``lei_code, legal_name, frequency``: a snapshot of known entities (same columns) merged with finds (``lei_code, legal_name, found_at``): a find adds one, the newest find gives the name."""
    met = found.groupBy("lei_code").agg(F.count("*").alias("n"), F.max_by("legal_name", F.struct("found_at", "legal_name")).alias("newest"))
    merged = prior.join(met, "lei_code", "full_outer")
    return merged.select("lei_code", F.coalesce("newest", "legal_name").alias("legal_name"), (F.coalesce("frequency", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("frequency"))


@query(
    "N4_accumulated_entities",
    f"""SELECT coalesce(p.lei_code, m.lei_code) AS lei_code, coalesce(m.newest, p.legal_name) AS legal_name, coalesce(p.discovery_frequency, 0) + coalesce(m.n, 0) AS frequency FROM {E} p
        FULL JOIN (SELECT lei_code, count(*) AS n, arg_max(legal_name, {{'t': found_at, 'n': legal_name}}) AS newest FROM {C} c GROUP BY lei_code) m ON p.lei_code = m.lei_code""",
)
def accumulated_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The stored entities as the snapshot before, all candidates as finds."""
    return accumulated(ENTITIES.read(spark, sf).select("lei_code", "legal_name", F.col("discovery_frequency").alias("frequency")), CANDIDATES.read(spark, sf).select("lei_code", "legal_name", "found_at"))


@query("N4_accumulated_mappings", f"SELECT d.domain, c.lei_code, count(*) AS frequency, coalesce(bool_or(c.lei_code = d.primary_lei_code), false) AS is_primary FROM {C} c JOIN {D} d ON c.domain_id = d.id GROUP BY 1, 2")
def accumulated_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """How often each domain met each entity, and whether it ever was the primary one."""
    domains = DOMAINS.read(spark, sf).select(F.col("id").alias("domain_id"), "domain", "primary_lei_code")
    met = CANDIDATES.read(spark, sf).select("domain_id", "lei_code").join(domains, "domain_id")
    return met.groupBy("domain", "lei_code").agg(F.count("*").alias("frequency"), F.coalesce(F.bool_or(F.col("lei_code") == F.col("primary_lei_code")), F.lit(False)).alias("is_primary"))


#: Days that a cached answer holds, and the time at which a reader asks.
TTL_DAYS, ASKED_AT = 7, "1996-01-01"


@query(
    "K14_cache_with_expiry",
    f"""SELECT lei_code, legal_name, cached_at, cached_at + INTERVAL {TTL_DAYS} DAY AS expires_at, cached_at + INTERVAL {TTL_DAYS} DAY > TIMESTAMP '{ASKED_AT}' AS fresh FROM (
        SELECT lei_code, max(found_at) AS cached_at, arg_max(legal_name, {{'t': found_at, 'n': legal_name}}) AS legal_name FROM {C} c GROUP BY lei_code) x""",
)
def cache_with_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """The last answer for each entity, when it expires, and whether it still holds."""
    last = CANDIDATES.read(spark, sf).groupBy("lei_code").agg(F.max("found_at").alias("cached_at"), F.max_by("legal_name", F.struct("found_at", "legal_name")).alias("legal_name"))
    expires = F.col("cached_at") + F.expr(f"INTERVAL {TTL_DAYS} DAYS")
    return last.select("lei_code", "legal_name", "cached_at", expires.alias("expires_at"), (expires > F.lit(ASKED_AT).cast("timestamp")).alias("fresh"))


def csv_cell(value: Column) -> Column:
    """Empty for null; quoted only if it holds a comma, a quote or a line end."""
    return F.coalesce(F.when(value.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value), F.lit(""))


def csv_line(paths: list[str], df: DataFrame) -> Column:
    """The values at dotted paths as one line; objects and lists as JSON."""
    kinds = df.select(*[F.col(p).alias(str(i)) for i, p in enumerate(paths)]).schema
    return F.concat_ws(",", *[csv_cell(F.to_json(F.col(p)) if kinds[str(i)].dataType.typeName() in ("struct", "array", "map") else F.col(p).cast("string")) for i, p in enumerate(paths)])


CELL_SQL = lambda x: f"""coalesce(CASE WHEN regexp_matches({x}, '[,"\\n]') THEN concat('"', replace({x}, '"', '""'), '"') ELSE {x} END, '')"""


@query(
    "K6_dotted_csv",
    f"""SELECT id, concat({CELL_SQL('domain')}, ',', {CELL_SQL('company_name')}, ',', {CELL_SQL('status')}, ',', {CELL_SQL("cast(to_json({'status': level2_status, 'lei': primary_lei_code}) AS VARCHAR)")}, ',', {CELL_SQL('primary_lei_code')}) AS line
        FROM {D} d WHERE level2_status IS NOT NULL AND primary_lei_code IS NOT NULL""",
)
def dotted_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of records whose registry answer is complete, fields by dotted path."""
    rows = DOMAINS.read(spark, sf).filter("level2_status IS NOT NULL AND primary_lei_code IS NOT NULL")
    record = rows.select("id", F.struct("domain", F.col("company_name").alias("name"), "status").alias("site"), F.struct(F.col("level2_status").alias("status"), F.col("primary_lei_code").alias("lei")).alias("registry"))
    return record.select("id", csv_line(["site.domain", "site.name", "site.status", "registry", "registry.lei"], record).alias("line"))


def alike(a: Column, b: Column) -> Column:
    """They share a word of more than two letters, and at least half of the shorter name's words; only a-z counts."""
    words = lambda x: F.filter(F.split(F.regexp_replace(F.lower(x), r"[^a-z\s]", ""), " "), lambda w: F.length(w) > 2)
    shared = F.size(F.filter(words(a), lambda w: F.array_contains(words(b), w)))
    return (shared >= 1) & (shared >= F.least(F.size(words(a)), F.size(words(b))) * 0.5)


ALIKE_WORDS = lambda x: f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z\\s]', '', 'g'), ' '), lambda w: length(w) > 2)"
SHARED_SQL = f"len(list_filter({ALIKE_WORDS('legal_name')}, lambda w: list_contains({ALIKE_WORDS('best')}, w)))"


@query(
    "X22_like_the_best",
    f"""SELECT domain_id, lei_code, tie1, tie3, {SHARED_SQL} >= 1 AND {SHARED_SQL} >= least(len({ALIKE_WORDS('legal_name')}), len({ALIKE_WORDS('best')})) * 0.5::DOUBLE AS similar
        FROM (SELECT *, first_value(legal_name) OVER (PARTITION BY domain_id ORDER BY weighted_score DESC, lei_code, tie1, tie3) AS best FROM {C} c) x""",
)
def like_the_best(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each candidate's name is similar to that of its domain's best one: one comparison a candidate, not all pairs."""
    w = Window.partitionBy("domain_id").orderBy(F.desc("weighted_score"), "lei_code", "tie1", "tie3")
    rows = CANDIDATES.read(spark, sf).withColumn("best", F.first("legal_name").over(w))
    return rows.select("domain_id", "lei_code", "tie1", "tie3", alike(F.col("legal_name"), F.col("best")).alias("similar"))


# Core fields of a full record, and the weights of quality.
CORE_FIELDS, FOUND_WORTH, RELATED_WORTH = 20, 3, 2
FILLED = ["domain", "status", "company_name", "extraction_method", "confidence_score", "created_at", "level2_status", "primary_lei_code", "primary_name", "guessed_country"]
FILLED_SQL = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f in FILLED)


@query(
    "X35_full_quality",
    f"""SELECT id, completeness, cast(floor(coalesce(confidence_score, 0) / 100 * 40 + CASE WHEN primary_lei_code IS NOT NULL AND primary_name IS NOT NULL THEN 30 WHEN found > 0 THEN 15 ELSE 0 END + completeness / 100.0::DOUBLE * 20
          + CASE WHEN status = 'success' THEN 10 WHEN status = 'failed' AND company_name IS NOT NULL THEN 5 ELSE 0 END + 0.5) AS BIGINT) AS quality
        FROM (SELECT *, cast(floor(({FILLED_SQL} + CASE WHEN coalesce(processing_time_ms, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN level2_attempted THEN 1 ELSE 0 END + CASE WHEN found > 0 THEN {FOUND_WORTH} ELSE 0 END + CASE WHEN related > 0 THEN {RELATED_WORTH} ELSE 0 END) * 100.0::DOUBLE / {CORE_FIELDS} + 0.5) AS BIGINT) AS completeness
          FROM (SELECT d.*, e.legal_name AS primary_name, coalesce(c.n, 0) AS found, coalesce(r.n, 0) AS related FROM {D} d LEFT JOIN (SELECT domain_id, count(*) AS n FROM {C} x GROUP BY domain_id) c ON d.id = c.domain_id LEFT JOIN {E} e ON d.primary_lei_code = e.lei_code
            LEFT JOIN (SELECT parent_lei, count(*) AS n FROM {EDGES.sql} y GROUP BY parent_lei) r ON d.primary_lei_code = r.parent_lei) a) b""",
)
def full_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Completeness of a record out of twenty, and its quality: confidence 40, registry 30, completeness 20, success 10. Fields that the tables lack count as empty."""
    c = F.col
    found = CANDIDATES.read(spark, sf).groupBy("domain_id").agg(F.count("*").alias("found"))
    named = ENTITIES.read(spark, sf).select(c("lei_code").alias("primary_lei_code"), c("legal_name").alias("primary_name"))
    related = EDGES.read(spark, sf).groupBy(c("parent_lei").alias("primary_lei_code")).agg(F.count("*").alias("related"))
    rows = DOMAINS.read(spark, sf).join(found, c("id") == c("domain_id"), "left").join(named, "primary_lei_code", "left").join(related, "primary_lei_code", "left")
    one = lambda test, worth=1: F.when(test, worth).otherwise(0)
    filled = sum((one(c(f).isNotNull()) for f in FILLED), F.lit(0)) + one(F.coalesce("processing_time_ms", F.lit(0)) != 0) + one(c("level2_attempted")) + one(F.coalesce("found", F.lit(0)) > 0, FOUND_WORTH) + one(F.coalesce("related", F.lit(0)) > 0, RELATED_WORTH)
    rows = rows.withColumn("completeness", F.floor(filled * 100.0 / CORE_FIELDS + 0.5))
    checked = F.when(c("primary_lei_code").isNotNull() & c("primary_name").isNotNull(), 30).when(F.coalesce("found", F.lit(0)) > 0, 15).otherwise(0)
    done = F.when(c("status") == "success", 10).when((c("status") == "failed") & c("company_name").isNotNull(), 5).otherwise(0)
    quality = F.floor(F.coalesce("confidence_score", F.lit(0.0)) / 100 * 40 + checked + c("completeness") / 100.0 * 20 + done + 0.5)
    return rows.select("id", "completeness", quality.alias("quality"))
