"""Names that hold others or nearly equal them, for all names at once: n-gram joins that spread hot grams, with exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.rounds import cut
from tessera.plans.register import query
from tessera.sources.logical import DOMAINS, ENTITIES

D, E = DOMAINS.sql, ENTITIES.sql

GRAM = 3
#: Rows of one key that a task joins; a key with more is dealt to so many parts as it takes, and what asks for it is sent to each of them.
POSTINGS = 50_000
#: Answers of one search.
PAGE = 10


def joined_in_parts(asking: DataFrame, posted: DataFrame, keys: list[str], name: str, most: int = POSTINGS) -> DataFrame:
    """An inner join on ``keys`` in which no task meets more than about ``most`` rows of a key of ``posted``, dealt by the hash of its column ``name``."""
    parts = posted.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    asked = asking.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = posted.join(parts.filter("parts > 1"), keys, "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(name), F.col("parts").cast("long"))).cast("int")
    tasks = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small inputs of a large join aren't packed into one task
    return asked.repartition(tasks, *keys, "part").join(dealt.withColumn("part", part).drop("parts").repartition(tasks, *keys, "part"), [*keys, "part"]).drop("part")


def grams(text: Column, n: Column | int) -> Column:
    """Distinct pieces of n characters; none of a shorter text."""
    n = F.lit(n) if isinstance(n, int) else n
    every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.when(F.length(text) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def infix_matches(needles: DataFrame, names: DataFrame, most: int = POSTINGS) -> DataFrame:
    """``needle, name``: all pairs of distinct values where the name holds the needle, letter case aside.

    An inverted index lists the names of each piece of three characters. A needle asks for its rarest piece only (one or two characters are a piece themselves) and each name found is verified. Nulls and empty needles match
    nothing."""
    asked = needles.select("needle").filter("needle <> ''").distinct().withColumn("low", F.lower("needle"))
    asked = asked.withColumn("gram", F.explode(grams(F.col("low"), F.least(F.length("low"), F.lit(GRAM)))))
    wanted = cut(asked.select("gram").distinct())
    low = F.lower("name")
    pieces = F.array_distinct(F.concat(*[grams(low, n) for n in range(1, GRAM + 1)]))
    index = names.select("name").filter("name IS NOT NULL").distinct().select("name", F.explode(pieces).alias("gram")).join(wanted, "gram", "left_semi")
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("needle", "low").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return joined_in_parts(rarest, index, ["gram"], "name", most).filter(F.lower("name").contains(F.col("low"))).select("needle", "name")


def numbered_grams(text: Column, q: int) -> Column:
    """All pieces of q characters, repeats told apart by their number."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, F.lit(q)))
    all_ = F.when(F.length(text) >= q, every).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(all_), lambda g: F.transform(g, lambda x, i: F.concat(x, F.lit("\x01"), F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda y: y == x)).cast("string")))), 1)


def without_letters(text: Column, k: int) -> Column:
    """The text and all that remains of it after up to k deletions."""
    found = F.array(text)
    for _ in range(k):
        shorter = F.flatten(F.transform(found, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        found = F.array_distinct(F.concat(found, shorter))
    return found


def close_names(names: DataFrame, k: int = 2, q: int = 2, most: int = POSTINGS) -> DataFrame:
    """``name, other, distance``: all pairs of distinct names, the smaller first, within k edits.

    Two names within k edits share all but k*q pieces of the longer one, so among the k*q+1 rarest pieces of either there is a common one; only those are joined, and only between lengths that differ by k at most. Names too
    short to have so many pieces meet each other by what remains of them after up to k deletions. Each pair is verified where it meets. Nulls take no part."""
    rows = cut(names.select("name").filter("name IS NOT NULL").distinct().withColumn("size", F.length("name")))
    tokens = rows.select("name", "size", F.explode(numbered_grams(F.col("name"), q)).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("n", "token"))), 1, k * q + 1)["token"]
    prefix = tokens.join(counts, "token").groupBy("name", "size").agg(rarest.alias("tokens"))
    short = rows.filter(F.col("size") <= k * q + q - 1).select("name", "size", F.transform(without_letters(F.col("name"), k), lambda x: F.concat(F.lit("\x02"), x)).alias("tokens"))
    every = prefix.unionByName(short).groupBy("name", "size").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    keyed = cut(every.withColumn("tokens", F.array_distinct(F.transform("tokens", lambda x: F.xxhash64(x)))))
    posted = keyed.select("name", F.col("size"), "tokens", F.explode("tokens").alias("token"))
    asking = keyed.select(F.col("name").alias("left"), F.col("size").alias("own"), F.col("tokens").alias("asked"), F.explode("tokens").alias("token"))
    asking = asking.withColumn("size", F.explode(F.sequence(F.col("own"), F.col("own") + k)))  # the shorter one asks, of equally long ones the smaller
    met = joined_in_parts(asking, posted, ["token", "size"], "name", most).filter((F.col("own") < F.col("size")) | (F.col("left") < F.col("name")))
    # verified where they meet, and told at the least of the keys they share: so no task holds the pairs to find those that met twice
    near = met.withColumn("distance", F.levenshtein("left", "name", k)).filter("distance >= 0").filter(F.col("token") == F.array_min(F.array_intersect("asked", "tokens")))
    return near.select(F.least("left", "name").alias("name"), F.greatest("left", "name").alias("other"), "distance")


#: A company's name without its generic word and legal suffix: what a search would send.
TERM = "regexp_replace(company_name, '^Company | (Inc\\\\.|GmbH|Ltd|Solutions)$', '')"
TERM_SQL = "regexp_replace(company_name, '^Company | (Inc\\.|GmbH|Ltd|Solutions)$', '', 'g')"


@query("J8_S6_infix_names", f"SELECT DISTINCT t.term, e.lei_code, e.legal_name FROM (SELECT DISTINCT {TERM_SQL} AS term FROM {D} d WHERE company_name IS NOT NULL) t JOIN {E} e ON e.legal_name ILIKE concat('%', t.term, '%')")
def infix_names(spark: SparkSession, sf: str) -> DataFrame:
    """All registry names that hold the term of any domain."""
    entities = ENTITIES.read(spark, sf).select("lei_code", "legal_name")
    terms = DOMAINS.read(spark, sf).select(F.expr(TERM).alias("needle"))
    found = infix_matches(terms, entities.select(F.col("legal_name").alias("name")))
    return found.join(entities, F.col("name") == F.col("legal_name")).select(F.col("needle").alias("term"), "lei_code", "legal_name")


@query(
    "S6_S7_all_domains",
    f"""SELECT d.id, a.lei_code, a.place FROM {D} d JOIN (SELECT term, lei_code, row_number() OVER (PARTITION BY term ORDER BY lei_code) AS place FROM (
        SELECT DISTINCT t.term, e.lei_code FROM (SELECT DISTINCT {TERM_SQL} AS term FROM {D} x WHERE company_name IS NOT NULL) t JOIN {E} e ON e.legal_name ILIKE concat('%', t.term, '%')) y QUALIFY place <= {PAGE}) a
        ON {TERM_SQL.replace('company_name', 'd.company_name')} = a.term""",
)
def all_domains(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of answers to every domain's search: each term is searched once."""
    answers = infix_names(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy("lei_code"))).filter(F.col("place") <= PAGE)
    return DOMAINS.read(spark, sf).select("id", F.expr(TERM).alias("term")).join(answers, "term").select("id", "lei_code", F.col("place").cast("long").alias("place"))


@query("X21_close_names", f"WITH n AS (SELECT DISTINCT legal_name AS name FROM {E} e) SELECT a.name, b.name AS other, levenshtein(a.name, b.name)::INT AS distance FROM n a JOIN n b ON a.name < b.name AND levenshtein(a.name, b.name) <= 2")
def registry_close_names(spark: SparkSession, sf: str) -> DataFrame:
    """Registry names within two edits of each other."""
    return close_names(ENTITIES.read(spark, sf).select(F.col("legal_name").alias("name")))
