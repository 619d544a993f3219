"""Text and entity extraction from captured pages, by regular expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.register import query
from tessera.sources.logical import DUMPS

P = DUMPS.sql
#: Text of a page that later steps read, as in the application.
TEXT_CHARS = 50_000
# Patterns of content in HTML and text.
TITLE, HEADING = r"(?i)<title[^>]*>([^<]*)</title>", r"(?i)<h1[^>]*>([^<]*)</h1>"
COPYRIGHT = r"(?:©|\([cC]\)|Copyright)\s*(?:[0-9]{4}[-– ]*)*\s*([A-Z][A-Za-z0-9&., ]{2,60})"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CURRENCY = r"\b(USD|EUR|GBP|JPY|CHF)\b"
PHONE = r"\+?[0-9][0-9() .-]{8,}[0-9]"
HREF = r'(?i)<a[^>]*href="([^"]*)"'
LEGAL_LINK = {"privacy": r"(?i)privacy|datenschutz", "terms": r"(?i)terms|conditions|agb", "imprint": r"(?i)imprint|impressum|legal"}


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return DUMPS.read(spark, sf)


def decoded(text: Column) -> Column:
    """The entities that pages use."""
    for entity, char in (("&copy;", "©"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def stripped(html: Column) -> Column:
    """Without scripts, styles and tags; white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, TEXT_CHARS)


STRIP_SQL = f"substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, {TEXT_CHARS})"
DECODE_SQL = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("X38_strip_html", f"SELECT dump_id, {STRIP_SQL} AS text FROM {P} p")
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("dump_id", stripped(F.col("html")).alias("text"))


@query("X39_title_meta", f"SELECT dump_id, regexp_extract(html, '{TITLE}', 1) AS title, regexp_extract(html, '(?i)<html[^>]*lang=\"([^\"]*)\"', 1) AS lang, regexp_extract(html, '{HEADING}', 1) AS heading FROM {P} p")
def title_meta(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("dump_id", F.regexp_extract("html", TITLE, 1).alias("title"), F.regexp_extract("html", r'(?i)<html[^>]*lang="([^"]*)"', 1).alias("lang"), F.regexp_extract("html", HEADING, 1).alias("heading"))


@query(
    "X40_X82_strategy_ladder",
    f"""SELECT dump_id, coalesce(nullif(trim(cr), ''), nullif(trim(h1), ''), nullif(trim(title), '')) AS name, CASE WHEN trim(cr) <> '' THEN 75 WHEN trim(h1) <> '' THEN 65 WHEN trim(title) <> '' THEN 60 ELSE 0 END AS confidence
        FROM (SELECT dump_id, regexp_extract({DECODE_SQL('html')}, '{COPYRIGHT}', 1) AS cr, {DECODE_SQL(f"regexp_extract(html, '{HEADING}', 1)")} AS h1, {DECODE_SQL(f"regexp_extract(html, '{TITLE}', 1)")} AS title FROM {P} p) x""",
)
def strategy_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """The first strategy with a result wins: copyright line, heading, title."""
    found = {"copyright": (F.regexp_extract(decoded(F.col("html")), COPYRIGHT, 1), 75), "heading": (decoded(F.regexp_extract("html", HEADING, 1)), 65), "title": (decoded(F.regexp_extract("html", TITLE, 1)), 60)}
    rows = pages(spark, sf).select("dump_id", *[F.nullif(F.trim(x), F.lit("")).alias(n) for n, (x, _) in found.items()])
    confidence = F.lit(0)
    for n in reversed(found):
        confidence = F.when(F.col(n).isNotNull(), found[n][1]).otherwise(confidence)
    return rows.select("dump_id", F.coalesce(*found).alias("name"), confidence.alias("confidence"))


@query("X41_copyright_entities", f"SELECT dump_id, list_transform(regexp_extract_all({DECODE_SQL('html')}, '{COPYRIGHT}', 1), lambda x: trim(x)) AS names FROM {P} p")
def copyright_entities(spark: SparkSession, sf: str) -> DataFrame:
    names = F.regexp_extract_all(decoded(F.col("html")), F.lit(COPYRIGHT), F.lit(1))
    return pages(spark, sf).select("dump_id", F.transform(names, F.trim).alias("names"))


@query("X12_clean_title", f"SELECT dump_id, CASE WHEN length(t) BETWEEN 3 AND 100 THEN t END AS name FROM (SELECT dump_id, trim(regexp_replace(regexp_extract({DECODE_SQL(f"regexp_extract(html, '{TITLE}', 1)")}, '^[^|–-]*', 0), '[.,!?*%$#&]+$', '')) AS t FROM {P} p) x")
def clean_title(spark: SparkSession, sf: str) -> DataFrame:
    """What stands before the first separator, without punctuation at the end; null if too short or long."""
    head = F.regexp_extract(decoded(F.regexp_extract("html", TITLE, 1)), r"^[^|–-]*", 0)
    name = F.trim(F.regexp_replace(head, r"[.,!?*%$#&]+$", ""))
    return pages(spark, sf).select("dump_id", name.alias("t")).select("dump_id", F.when(F.length("t").between(3, 100), F.col("t")).alias("name"))


@query("X47_X84_contacts", f"SELECT doc_id, list_slice(list_distinct(regexp_extract_all(text, '{EMAIL}')), 1, 10).list_sort() AS emails, len(regexp_extract_all(text, '{CURRENCY}')) AS currencies FROM documents d")
def contacts(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    emails = F.array_sort(F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))), 1, 10))
    return docs.select("doc_id", emails.alias("emails"), F.regexp_count("text", F.lit(CURRENCY)).cast("long").alias("currencies"))


@query("X47_phones", f"SELECT doc_id, regexp_extract_all(text, '{PHONE}') AS phones FROM documents WHERE regexp_matches(text, '{PHONE}')")
def phones(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("text").rlike(PHONE)).select("doc_id", F.regexp_extract_all("text", F.lit(PHONE), F.lit(0)).alias("phones"))


@query("S11_page_links", f"SELECT dump_id, pos, link FROM (SELECT dump_id, unnest(l) AS link, unnest(range(len(l))) AS pos FROM (SELECT dump_id, regexp_extract_all(html, '{HREF}', 1) AS l FROM {P} p) x) y WHERE pos < 10")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten links of a page, in order."""
    links = F.slice(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), 1, 10)
    return pages(spark, sf).select("dump_id", F.posexplode(links).alias("pos", "link"))


@query("S12_normal_urls", f"SELECT url_key, min(dump_id) AS first_dump, count(*) AS n FROM (SELECT dump_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|fbclid|gclid|ref)=[^&]*', '', 'g'), '/(index\\.html?)?$', '') AS url_key FROM {P} p) x GROUP BY url_key")
def normal_urls(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each address without fragment, tracking and index files."""
    key = F.regexp_replace("url", r"#.*$", "")
    key = F.regexp_replace(key, r"([?&])(utm_[a-z]+|fbclid|gclid|ref)=[^&]*", "")
    key = F.regexp_replace(key, r"/(index\.html?)?$", "")
    return pages(spark, sf).groupBy(key.alias("url_key")).agg(F.min("dump_id").alias("first_dump"), F.count("*").alias("n"))


@query("S12_best_per_host", f"SELECT domain, dump_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN url LIKE '%about%' THEN 0 WHEN url LIKE '%.html' THEN 1 ELSE 2 END, dump_id) AS rn FROM {P} p) x WHERE rn = 1")
def best_per_host(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.when(F.col("url").contains("about"), 0).when(F.col("url").endswith(".html"), 1).otherwise(2)
    return pages(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy(priority, "dump_id"))).filter("rn = 1").select("domain", "dump_id")


@query(
    "S18_legal_links",
    f"""SELECT dump_id, {', '.join(f"max(CASE WHEN regexp_matches(link, '{p}') THEN 1 ELSE 0 END) AS {k}" for k, p in LEGAL_LINK.items())} FROM (SELECT dump_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS link FROM {P} p) x GROUP BY dump_id""",
)
def legal_links(spark: SparkSession, sf: str) -> DataFrame:
    links = pages(spark, sf).select("dump_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    return links.groupBy("dump_id").agg(*[F.max(F.when(F.col("link").rlike(p), 1).otherwise(0)).alias(k) for k, p in LEGAL_LINK.items()])


@query("X58_page_metadata", f"SELECT dump_id, regexp_extract(html, '(?i)<html[^>]*lang=\"([^\"]*)\"', 1) AS language, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<li>')) AS items, contains(html, '<form') AS has_form, contains(html, 'application/ld+json') AS has_json_ld FROM {P} p")
def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda x: F.col("html").contains(x)
    return pages(spark, sf).select("dump_id", F.regexp_extract("html", r'(?i)<html[^>]*lang="([^"]*)"', 1).alias("language"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"), has("<form").alias("has_form"), has("application/ld+json").alias("has_json_ld"))


@query("X83_site_type", f"SELECT dump_id, CASE WHEN regexp_matches(html, '(?i)cart|checkout|basket') THEN 'ecommerce' WHEN regexp_matches(html, '(?i)pricing|free trial|sign ?up') THEN 'saas' WHEN regexp_matches(html, '(?i)investor|about us|careers') THEN 'corporate' ELSE 'general' END AS kind FROM {P} p")
def site_type(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    kind = F.when(html.rlike("(?i)cart|checkout|basket"), "ecommerce").when(html.rlike("(?i)pricing|free trial|sign ?up"), "saas").when(html.rlike("(?i)investor|about us|careers"), "corporate").otherwise("general")
    return pages(spark, sf).select("dump_id", kind.alias("kind"))


@query("A34_crawl_stats", f"SELECT source_type, count(*) AS pages, count(*) FILTER (status = 'completed') AS successes, count(*) FILTER (status = 'failed') AS failures, sum(length(html)) AS total_size FROM {P} p GROUP BY source_type")
def crawl_stats(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy("source_type").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "completed").alias("successes"), F.count_if(F.col("status") == "failed").alias("failures"), F.sum(F.length("html")).alias("total_size"))


@query("P9_dump_profile", f"SELECT dump_id, regexp_matches(html, '{TITLE}') AS has_title, len(regexp_extract_all(html, '(?i)<meta ')) AS meta_count, length({STRIP_SQL}) AS text_length FROM {P} p")
def dump_profile(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("dump_id", F.col("html").rlike(TITLE).alias("has_title"), F.regexp_count("html", F.lit("(?i)<meta ")).cast("long").alias("meta_count"), F.length(stripped(F.col("html"))).cast("long").alias("text_length"))


@query(
    "A25_entity_frequency",
    f"""SELECT name, n FROM (SELECT trim(unnest(regexp_extract_all({DECODE_SQL('html')}, '{COPYRIGHT}', 1))) AS name, 1 AS one FROM {P} p) x JOIN (SELECT trim(unnest(regexp_extract_all({DECODE_SQL('html')}, '{COPYRIGHT}', 1))) AS k, count(*) AS n FROM {P} q GROUP BY 1) y ON x.name = y.k GROUP BY name, n ORDER BY n DESC, name LIMIT 5""",
)
def entity_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """The five names that most pages claim."""
    found = pages(spark, sf).select(F.explode(F.regexp_extract_all(decoded(F.col("html")), F.lit(COPYRIGHT), F.lit(1))).alias("raw"))
    return found.groupBy(F.trim("raw").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(5)


@query("X56_protection", f"SELECT dump_id, regexp_matches(html, '(?i)cloudflare|cf-ray|attention required') AS protected FROM {P} p")
def protection(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("dump_id", F.col("html").rlike("(?i)cloudflare|cf-ray|attention required").alias("protected"))


# A short list of industries and their words; the full one is in evidence.py.
INDUSTRY = {"technology": ["software", "cloud", "digital"], "finance": ["bank", "invest", "insurance"], "health": ["medical", "pharma", "clinic"], "retail": ["shop", "store", "retail"]}


@query(
    "X53_industry",
    f"""SELECT dump_id, industry, hits FROM (SELECT dump_id, industry, hits, row_number() OVER (PARTITION BY dump_id ORDER BY hits DESC, industry) AS rn FROM (
        {' UNION ALL '.join(f"SELECT dump_id, '{k}' AS industry, len(regexp_extract_all(lower(html), '{'|'.join(v)}')) AS hits FROM {P} p" for k, v in INDUSTRY.items())}) x WHERE hits > 0) y WHERE rn <= 3""",
)
def industry(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword hits by category; the three best of each page."""
    hits = F.array(*[F.struct(F.lit(k).alias("industry"), F.regexp_count(F.lower("html"), F.lit("|".join(v))).cast("long").alias("hits")) for k, v in INDUSTRY.items()])
    best = F.slice(F.array_sort(F.transform(F.filter(hits, lambda x: x["hits"] > 0), lambda x: F.struct((-x["hits"]).alias("h"), x["industry"].alias("industry")))), 1, 3)
    return pages(spark, sf).select("dump_id", F.explode(best).alias("x")).select("dump_id", "x.industry", (-F.col("x.h")).alias("hits"))


# A short list of markers that place a page; the full one is in evidence.py.
MARKERS = {"language": r'(?i)lang="(de|fr|es|en)"', "currency": r"€|\$|£", "phone": r"\+(?:49|33|34|1|44)", "address": r"(?i)straße|rue |calle |street"}
MARKER_WEIGHTS = {"language": 10, "currency": 5, "phone": 20, "address": 15}


@query(
    "X51_X52_X86_geography",
    f"SELECT dump_id, least(100, {' + '.join(f"len(regexp_extract_all(html, '{p}')) * {MARKER_WEIGHTS[k]}" for k, p in MARKERS.items())}) AS confidence, regexp_extract(html, '(?i)<html[^>]*lang=\"([^\"]*)\"', 1) AS vote FROM {P} p",
)
def geography(spark: SparkSession, sf: str) -> DataFrame:
    total = F.lit(0)
    for k, p in MARKERS.items():
        total = total + F.regexp_count("html", F.lit(p)) * MARKER_WEIGHTS[k]
    return pages(spark, sf).select("dump_id", F.least(F.lit(100), total).cast("long").alias("confidence"), F.regexp_extract("html", r'(?i)<html[^>]*lang="([^"]*)"', 1).alias("vote"))
