"""Network addresses in texts, classed by the longest matching address range; protection of a site by its address, headers and body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scoring import contains_any
from tessera.plans.register import query

# Address prefixes, headers and phrases of the protecting network.
PROTECTED_PREFIXES = [
    "104.16.", "104.17.", "104.18.", "104.19.", "104.20.", "104.21.", "104.22.", "104.23.", "104.24.", "104.25.", "104.26.", "104.27.", "104.28.", "104.29.", "104.30.", "104.31.",
    "172.64.", "172.65.", "172.66.", "172.67.", "172.68.", "172.69.", "172.70.", "172.71.", "173.245.", "188.114.", "190.93.", "197.234.", "198.41.",
]
PROTECTED_HEADERS = ["cf-ray", "cf-cache-status", "cf-request-id", "cf-visitor", "cf-connecting-ip", "cf-ipcountry", "cf-edge-cache"]
PROTECTED_SERVERS = ["cloudflare", "cf-"]
CHALLENGES = ["checking your browser", "cloudflare", "ray id", "challenge", "just a moment", "enable javascript and cookies", "cf-browser-verification"]
# Special-purpose ranges of the public address registry.
SPECIAL = {"0.0.0.0/8": "this network", "10.0.0.0/8": "private", "100.64.0.0/10": "shared", "127.0.0.0/8": "loopback", "169.254.0.0/16": "link local", "172.16.0.0/12": "private", "192.0.2.0/24": "documentation", "192.168.0.0/16": "private", "198.18.0.0/15": "benchmark", "198.51.100.0/24": "documentation", "203.0.113.0/24": "documentation", "224.0.0.0/4": "multicast", "240.0.0.0/4": "reserved"}
#: Everything else, by its owner's part of the address space: the answer where no longer range fits.
WHOLE = {"0.0.0.0/1": "public", "128.0.0.0/1": "public"}
ADDRESS = r"(?:[^0-9.]|^)([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"


def ranges() -> list[tuple[int, int, str]]:
    """First address, length of the prefix, and class."""
    out = []
    for text, kind in [(f"{p}0.0/16", "protected") for p in PROTECTED_PREFIXES] + list((SPECIAL | WHOLE).items()):
        base, length = text.split("/")
        a, b, c, d = map(int, base.split("."))
        out.append(((a << 24) + (b << 16) + (c << 8) + d, int(length), kind))
    return out


def number(address: Column) -> Column:
    """The 32 bits of a dotted address, null if a part is above 255."""
    parts = F.transform(F.split(address, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda x: x < 256), value)


def longest_range(addresses: DataFrame, table: DataFrame, value: str = "value") -> DataFrame:
    """The rows of ``addresses`` with the ``first, bits, kind`` of the longest range of ``table`` that holds their number in ``value``; rows without one, nulls too, keep nulls.

    A range is an equality on the leading bits, so the join is an equi join for each length that occurs (at most 32): an address asks for its own prefix of each length. Distinct addresses ask, so an address that fills the
    table asks once."""
    lengths = sorted(r["bits"] for r in table.select("bits").distinct().collect())
    asked = addresses.select(F.col(value).alias("asked")).filter("asked IS NOT NULL").distinct()
    asked = asked.withColumn("bits", F.explode(F.array(*[F.lit(n) for n in lengths]))).withColumn("first", F.col("asked") - F.col("asked") % F.expr("shiftleft(1L, 32 - bits)"))
    best = asked.join(table, ["first", "bits"]).groupBy("asked").agg(F.max(F.struct("bits", "first", "kind")).alias("range"))
    found = addresses.join(best, F.col(value) == F.col("asked"), "left")
    return found.select(*addresses.columns, F.col("range.first").alias("first"), F.col("range.bits").alias("bits"), F.col("range.kind").alias("kind"))


def protection(headers: Column, body: Column, address: Column) -> Column:
    """What shows that a site is behind the protecting network: its address, a header, its server or a challenge in its page; null if nothing does. Header names are in lower case; nulls show nothing."""
    prefixes = [address.startswith(p) for p in PROTECTED_PREFIXES]
    by_address = prefixes[0]
    for p in prefixes[1:]:
        by_address = by_address | p
    by_header = F.coalesce(F.exists(F.map_keys(F.map_filter(headers, lambda k, v: v != "")), lambda k: k.isin(PROTECTED_HEADERS)), F.lit(False))
    by_server = F.coalesce(contains_any(F.lower(F.element_at(headers, "server")), PROTECTED_SERVERS), F.lit(False))
    by_body = F.coalesce(contains_any(F.lower(body), CHALLENGES), F.lit(False))
    return F.when(F.coalesce(by_address, F.lit(False)), "address").when(by_header, "header").when(by_server, "server").when(by_body, "challenge")


_RANGES_SQL = "(VALUES " + ", ".join(f"({first}, {first + (1 << (32 - bits)) - 1}, {bits}, '{kind}')" for first, bits, kind in ranges()) + ") r(low, high, bits, kind)"
FOUND_SQL = f"""(SELECT doc_id, pos, address, CASE WHEN greatest(string_split(address, '.')[1]::INT, string_split(address, '.')[2]::INT, string_split(address, '.')[3]::INT, string_split(address, '.')[4]::INT) < 256 THEN
  string_split(address, '.')[1]::BIGINT * 16777216 + string_split(address, '.')[2]::BIGINT * 65536 + string_split(address, '.')[3]::BIGINT * 256 + string_split(address, '.')[4]::BIGINT END AS value
  FROM (SELECT doc_id, unnest(l) AS address, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{ADDRESS}', 1) AS l FROM documents) a) b)"""


@query("X56_address_ranges", f"SELECT f.doc_id, f.pos::INT AS pos, f.address, r.kind, r.bits FROM {FOUND_SQL} f LEFT JOIN {_RANGES_SQL} ON f.value BETWEEN r.low AND r.high QUALIFY row_number() OVER (PARTITION BY f.doc_id, f.pos ORDER BY r.bits DESC NULLS LAST) = 1")
def address_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Every address in the documents with the class of the longest range around it; no class for what is no address."""
    found = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(1))).alias("pos", "address"))
    table = spark.createDataFrame(ranges(), "first long, bits int, kind string")
    return longest_range(found.withColumn("value", number(F.col("address"))), table).select("doc_id", "pos", "address", "kind", "bits")


@query("X56_protected_documents", f"""SELECT doc_id, count(*) AS addresses, count(*) FILTER (kind = 'protected') AS protected, list_sort(list(DISTINCT kind)) AS kinds FROM (
        SELECT f.doc_id, f.pos, r.kind FROM {FOUND_SQL} f JOIN {_RANGES_SQL} ON f.value BETWEEN r.low AND r.high QUALIFY row_number() OVER (PARTITION BY f.doc_id, f.pos ORDER BY r.bits DESC) = 1) x GROUP BY doc_id""")  # fmt: skip
def protected_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = address_ranges(spark, sf).filter("kind IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.count("*").alias("addresses"), F.count_if(F.col("kind") == "protected").alias("protected"), F.array_sort(F.collect_set("kind")).alias("kinds"))
