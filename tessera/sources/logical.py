"""The logical tables (domains, candidates, entities, ...) derived from the stored ones.

Each is a list of column expressions in the common part of Spark SQL and ANSI SQL, over joins of stored tables. A cluster
deployment swaps these definitions for its own tables; the operators see only the logical columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logical:
    """A table ``name`` whose columns are expressions over ``base`` joined with ``joins`` (table, left key, right key)."""

    base: str
    joins: tuple[tuple[str, str, str], ...]
    columns: dict[str, str]
    where: str = ""

    @property
    def sql(self) -> str:
        joins = "".join(f" JOIN {t} ON {a} = {b}" for t, a, b in self.joins)
        return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.base}{joins}{f' WHERE {self.where}' if self.where else ''})"

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df = table(self.base)
        for name, left, right in self.joins:
            df = df.join(table(name), F.col(left) == F.col(right))
        if self.where:
            df = df.filter(self.where)
        return df.selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])


DOMAINS = Logical(
    "orders",
    (("customer", "o_custkey", "c_custkey"),),
    {
        "id": "o_orderkey",
        "domain": "concat(lower(substr(c_mktsegment, 1, 4)), cast(o_custkey % 300 as string), CASE o_orderkey % 6 WHEN 0 THEN '.com' WHEN 1 THEN '.de' WHEN 2 THEN '.co.uk' WHEN 3 THEN '.io' WHEN 4 THEN '.fr' ELSE '.com.br' END)",
        "batch_id": "concat('b', cast(o_orderkey % 20 as string))",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'processing' END END",
        "confidence_score": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE cast(cast(floor(o_totalprice) as bigint) % 101 as double) END",
        "company_name": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('Company ', cast(o_custkey % 300 as string), CASE o_orderkey % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' GmbH' WHEN 2 THEN '' WHEN 3 THEN ' Ltd' ELSE ' Solutions' END) END",
        "extraction_method": "CASE o_orderpriority WHEN '1-URGENT' THEN 'footer_copyright' WHEN '2-HIGH' THEN 'structured_data' WHEN '3-MEDIUM' THEN 'meta_property' WHEN '4-NOT SPECIFIED' THEN 'html_title' ELSE 'domain_parse' END",
        "processing_time_ms": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_custkey * 37) % 9000 END",
        "error_message": "CASE WHEN o_orderstatus <> 'O' THEN NULL WHEN o_orderkey % 4 = 0 THEN 'timeout of 11000ms exceeded' WHEN o_orderkey % 4 = 1 THEN 'getaddrinfo ENOTFOUND' WHEN o_orderkey % 4 = 2 THEN 'Request failed with status code 403' ELSE NULL END",
        "failure_category": "CASE WHEN o_orderstatus <> 'O' THEN NULL WHEN o_orderkey % 3 = 0 THEN 'technical_issue' WHEN o_orderkey % 3 = 1 THEN 'Protected - Manual Review' ELSE 'incomplete_low_priority' END",
        "retry_count": "o_orderkey % 5",
        "guessed_country": "CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE concat('C', cast(c_nationkey as string)) END",
        "created_at": "o_orderdate",
        "level2_attempted": "o_orderkey % 4 = 0",
        "level2_status": "CASE WHEN o_orderkey % 4 <> 0 THEN NULL WHEN o_orderkey % 12 = 0 THEN 'failed' WHEN o_orderkey % 8 = 0 THEN 'multiple_candidates' ELSE 'success' END",
        "level2_candidates_count": "CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 5 END",
        "primary_lei_code": "CASE WHEN o_orderkey % 8 = 0 THEN upper(substr(md5(cast(o_custkey % 100 as string)), 1, 20)) END",
        "manual_review_required": "o_orderkey % 10 = 0",
    },
)
CANDIDATES = Logical(
    "lineitem",
    (("supplier", "l_suppkey", "s_suppkey"), ("nation", "s_nationkey", "n_nationkey")),
    {
        "domain_id": "l_orderkey",
        "lei_code": "upper(substr(md5(cast(l_suppkey as string)), 1, 20))",
        "legal_name": "concat(s_name, CASE l_suppkey % 4 WHEN 0 THEN ' Inc' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' Holding' ELSE '' END)",
        "jurisdiction": "CASE s_nationkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'GB' WHEN 4 THEN 'US' ELSE 'BR' END",
        "entity_status": "CASE l_linestatus WHEN 'O' THEN 'ACTIVE' ELSE 'INACTIVE' END",
        "registration_status": "CASE l_returnflag WHEN 'R' THEN 'LAPSED' WHEN 'A' THEN 'ISSUED' ELSE 'PENDING' END",
        "legal_form": "CASE l_suppkey % 3 WHEN 0 THEN 'PJ10' WHEN 1 THEN '5WWO' ELSE 'XTIQ' END",
        "city": "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('City ', cast(s_nationkey as string)) END",
        "rank_position": "l_linenumber",
        "weighted_score": "l_quantity * 2",
        "tie1": "l_partkey",
        "tie2": "l_suppkey",
        "tie3": "cast(round(l_extendedprice * 100) as bigint)",
        "found_at": "l_shipdate",
    },
)
ENTITIES = Logical(
    "supplier",
    (("nation", "s_nationkey", "n_nationkey"),),
    {
        "lei_code": "upper(substr(md5(cast(s_suppkey as string)), 1, 20))",
        "legal_name": "concat(s_name, CASE s_suppkey % 4 WHEN 0 THEN ' Inc' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' Holding' ELSE '' END)",
        "jurisdiction": "CASE s_nationkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'GB' WHEN 4 THEN 'US' ELSE 'BR' END",
        "entity_status": "CASE WHEN s_acctbal >= 0 THEN 'ACTIVE' ELSE 'INACTIVE' END",
        "registration_status": "CASE s_suppkey % 3 WHEN 0 THEN 'LAPSED' ELSE 'ISSUED' END",
        "legal_form": "CASE s_suppkey % 3 WHEN 0 THEN 'PJ10' WHEN 1 THEN '5WWO' ELSE 'XTIQ' END",
        "category": "CASE s_suppkey % 4 WHEN 0 THEN 'GENERAL' WHEN 1 THEN 'FUND' WHEN 2 THEN 'BRANCH' ELSE NULL END",
        "city": "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('City ', cast(s_nationkey as string)) END",
        "country": "n_name",
        "discovery_frequency": "s_suppkey % 13 + 1",
        "balance": "s_acctbal",
        "n": "s_suppkey",
    },
)
#: A forest: every entity but the first under the one of half its number.
EDGES = Logical(
    "supplier",
    (),
    {
        "parent_lei": "upper(substr(md5(cast(cast(floor(s_suppkey / 2) as bigint) as string)), 1, 20))",
        "child_lei": "upper(substr(md5(cast(s_suppkey as string)), 1, 20))",
        "relationship_type": "CASE s_suppkey % 3 WHEN 0 THEN 'IS_ULTIMATELY_CONSOLIDATED_BY' WHEN 1 THEN 'IS_DIRECTLY_CONSOLIDATED_BY' ELSE 'IS_FUND_MANAGED_BY' END",
        "relationship_confidence": "50 + s_suppkey % 50",
    },
    where="s_suppkey > 0",
)
#: Pages as crawl dumps of four kinds.
DUMPS = Logical(
    "pages",
    (),
    {
        "dump_id": "page_id",
        "source_type": "CASE page_id % 4 WHEN 0 THEN 'crawlee_dump' WHEN 1 THEN 'scrapy_crawl' WHEN 2 THEN 'playwright_dump' ELSE 'axios_cheerio_dump' END",
        "domain": "regexp_extract(url, '^https?://([^/?#]+)', 1)",
        "url": "url",
        "html": "html",
        "status": "CASE WHEN page_id % 11 = 0 THEN 'failed' WHEN page_id % 13 = 0 THEN NULL ELSE 'completed' END",
        "created_seq": "(page_id * 7919) % 100003",
    },
)
#: The event log: each event belongs to a batch of its user.
LOG = Logical(
    "events",
    (),
    {
        "seq": "event_id",
        "ts": "ts",
        "batch_id": "concat('b', cast(user_id % 12 as string))",
        "domain": "concat('u', cast(user_id as string), '.com')",
        "event": "CASE event_type WHEN 'view' THEN 'domain_start' WHEN 'signup' THEN 'batch_progress' WHEN 'purchase' THEN 'domain_success' WHEN 'error' THEN 'domain_failed' ELSE 'domain_timeout' END",
        "ms": "value",
        "props": "props",
    },
)
#: The rest of a domain's stored row: what the second level, reviewers and classifiers leave in it.
DETAILS = Logical(
    "orders",
    (),
    {
        "id": "o_orderkey",
        "final_legal_name": "CASE WHEN o_orderkey % 8 = 0 THEN concat('Company ', cast(o_custkey % 300 as string), ' Group \"', cast(o_orderkey % 3 as string), '\"') END",
        "final_confidence": "CASE WHEN o_orderkey % 8 = 0 THEN cast(60 + o_custkey % 40 as double) END",
        "final_extraction_method": "CASE WHEN o_orderkey % 8 = 0 THEN 'gleif_level2' END",
        "recommendation": "CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'Manual review needed - Use browser or proxy' ELSE 'Wait, then try again' END",
        "technical_details": "CASE WHEN o_orderkey % 7 = 3 THEN 'anti-bot page' WHEN o_orderkey % 7 = 5 THEN 'DNS, SSL, or server issues' END",
        "processing_started_at": "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderdate END",
        "processed_at": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END",
        "level2_processing_time_ms": "CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 4000 END",
        "selection_algorithm": "CASE WHEN o_orderkey % 8 = 0 THEN 'weighted_v1' END",
        "selection_notes": "CASE WHEN o_orderkey % 16 = 0 THEN 'chosen by name' END",
        "primary_selection_confidence": "CASE WHEN o_orderkey % 8 = 0 THEN 50 + o_custkey % 50 END",
        "predicted_entity_category": "CASE o_custkey % 4 WHEN 0 THEN 'Corporation' WHEN 1 THEN 'Fund' ELSE NULL END",
        "entity_category_confidence": "CASE WHEN o_custkey % 4 < 2 THEN o_custkey % 100 END",
    },
)
#: Results of the processing pipeline and of text cleaning for dumps: several a dump, some without a name.
PROCESSED = Logical(
    "documents",
    (),
    {
        "source_type": "CASE doc_id % 4 WHEN 0 THEN 'crawlee_dump' WHEN 1 THEN 'scrapy_crawl' WHEN 2 THEN 'playwright_dump' ELSE 'axios_cheerio_dump' END",
        "source_id": "doc_id % 600",
        "result_id": "doc_id",
        "created_seq": "(doc_id * 7919) % 100003",
        "entity_name": "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 5 = 0 THEN NULL ELSE concat('Entity ', cast(doc_id % 97 as string), ' ', upper(coalesce(lang, 'xx'))) END",
    },
)
CLEANED = Logical(
    "conversations",
    (),
    {
        "source_type": "CASE conv_id % 4 WHEN 0 THEN 'crawlee_dump' WHEN 1 THEN 'scrapy_crawl' WHEN 2 THEN 'playwright_dump' ELSE 'axios_cheerio_dump' END",
        "source_id": "conv_id % 800",
        "result_id": "conv_id * 1000 + turn",
        "entity_name": "CASE WHEN turn % 3 = 2 THEN NULL ELSE concat('Cleaned ', cast(conv_id % 89 as string), ' ', role) END",
    },
)
#: The models and methods that can be asked, with their settings.
MODELS = Logical(
    "supplier",
    (),
    {
        "model": "lower(replace(s_name, '#', '-'))",
        "provider": "CASE s_nationkey % 4 WHEN 0 THEN 'perplexity' WHEN 1 THEN 'openrouter' WHEN 2 THEN 'openai' ELSE 'local' END",
        "price": "cast(s_suppkey * 37 % 400 as double) / 100",
        "accuracy": "cast(s_suppkey * 53 % 100 as double) / 100",
        "priority": "s_suppkey * 31 % 97",
        "enabled": "s_suppkey % 3 <> 0",
    },
)
