"""Reading uploads and logs, writing exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.names import is_domain

#: Of the event log, one JSON object on a line.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("batchId", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
    ]
)


def first_cells(lines: DataFrame, is_csv: bool = True) -> DataFrame:
    """An upload's domains: the first comma field of each line (or the line), trimmed; what is no domain goes, headers too."""
    cell = F.element_at(F.split("value", ","), 1) if is_csv else F.col("value")
    return lines.select(F.trim(cell).alias("domain")).filter((F.col("domain") != "") & is_domain(F.col("domain")))


def all_cells(lines: DataFrame) -> DataFrame:
    """The other upload parser: every cell is a domain; quotes go, lengths are 3 to 253, each domain counts once."""
    cells = lines.select(F.explode(F.split("value", ",")).alias("cell"))
    bare = F.lower(F.trim(F.regexp_replace("cell", "[\"']", "")))
    return cells.select(bare.alias("domain")).filter(F.length("domain").between(3, 253) & F.col("domain").contains(".")).distinct()


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    return first_cells(spark.read.text(path), path.lower().endswith(".csv"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def log_summary(log: DataFrame) -> DataFrame:
    """For each batch: events, the first and the last one by time, latest batches first."""
    at = F.to_timestamp("timestamp")
    per = log.groupBy("batchId").agg(F.count("*").alias("events"), F.min_by("event", at).alias("first_event"), F.max_by("event", at).alias("last_event"), F.max(at).alias("last_at"))
    return per.orderBy(F.desc("last_at"))


def write_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def registry_search(registry: DataFrame, term: str, method: str = "exact", country: str | None = None, page: int = 10) -> DataFrame:
    """A search of the registry table as its service would answer: exact name, fuzzy, or fuzzy within a country; one page."""
    name = F.col("legal_name")
    found = {"exact": F.lower(name) == term.lower(), "fuzzy": name.ilike(f"%{term}%"), "geographic": name.ilike(f"%{term}%")}[method]
    rows = registry.filter(found & (F.col("jurisdiction") == country if country else F.lit(True)))
    return rows.orderBy("lei_code").limit(page)


def prefix_search(registry: DataFrame, name: str, rows: int = 200) -> DataFrame:
    """Entities whose name begins with the first word of the given one, else those that hold it."""
    first = name.split(" ")[0]
    rank: Column = F.when(F.col("legal_name").startswith(first), 0).otherwise(1)
    return registry.filter(F.col("legal_name").contains(first)).orderBy(rank, "lei_code").limit(rows)


def flat_record(raw: DataFrame, column: str = "json") -> DataFrame:
    """A registry answer in JSON as flat columns; missing parts are null."""
    at = lambda path: F.get_json_object(column, path)
    return raw.select(
        at("$.attributes.lei").alias("lei_code"),
        at("$.attributes.entity.legalName.name").alias("legal_name"),
        at("$.attributes.entity.jurisdiction").alias("jurisdiction"),
        at("$.attributes.entity.status").alias("entity_status"),
        F.coalesce(at("$.attributes.entity.headquartersAddress.city"), at("$.attributes.entity.legalAddress.city")).alias("city"),
    )
