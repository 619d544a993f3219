"""Linked data of any depth: documents as VARIANT, walked level by level, no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rounds import cut
from tessera.plans.register import query
from tessera.sources.logical import EDGES, ENTITIES

E, R = ENTITIES.sql, EDGES.sql

# How far a name is trusted by the kind of its holder.
TRUST = {"Organization": 0.95, "Corporation": 0.95, "LocalBusiness": 0.9, "Brand": 0.85}


def nodes(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, path, node``: every object, array and value of each document, the document itself at ``$``. A round opens all objects and arrays of a level, so there are as many rounds as the deepest document has levels. Null and
    malformed documents have no nodes."""
    spark = docs.sparkSession
    level = docs.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.try_parse_json(json_col).alias("node")).filter("node IS NOT NULL")
    found = level
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = cut(opened.select("id", F.concat("path", step).alias("path"), F.col("value").alias("node")))
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def trust(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair])[kind]


def named_holders(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id, path, kind, name, confidence``: every object of a known kind (one of several counts too, the most trusted first) with a name, anywhere in a document."""
    found = nodes(docs, id_col, json_col).select("id", "path", F.try_variant_get("node", "$.name", "string").alias("name"), F.try_variant_get("node", "$['@type']", "array<string>").alias("many"), F.try_variant_get("node", "$['@type']", "string").alias("one"))
    kinds = F.filter(F.coalesce("many", F.array("one")), lambda k: k.isin(list(TRUST)))
    best = F.get(F.array_sort(F.transform(kinds, lambda k: F.struct((-trust(k)).alias("t"), k.alias("kind")))), 0)
    rows = found.filter("name IS NOT NULL").withColumn("best", best).filter("best IS NOT NULL")
    return rows.select("id", "path", F.col("best.kind").alias("kind"), "name", (-F.col("best.t")).alias("confidence"))


def group_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A document of linked data for each entity that has children: a graph of its site and itself, its children within it, and their children within them."""
    c = F.col
    edges = EDGES.read(spark, sf).filter("parent_lei <> child_lei").select("parent_lei", "child_lei")
    names = ENTITIES.read(spark, sf).select("lei_code", "legal_name", "legal_form")
    kind = F.when(c("legal_form") == "PJ10", "Corporation").when(c("legal_form") == "5WWO", "LocalBusiness").otherwise("Fund")
    leaf = lambda *more: F.struct(kind.alias("@type"), c("legal_name").alias("name"), *more)
    below = edges.join(names, c("child_lei") == c("lei_code")).groupBy(c("parent_lei").alias("holder")).agg(F.array_sort(F.collect_list(leaf())).alias("sub"))
    middle = edges.join(names, c("child_lei") == c("lei_code")).join(below, c("child_lei") == c("holder"), "left")
    middle = middle.groupBy(c("parent_lei").alias("top")).agg(F.collect_list(leaf(c("sub").alias("subOrganization"))).alias("subs"))
    whole = names.join(middle, c("lei_code") == c("top"))
    graph = F.struct(F.array(F.to_json(F.struct(F.lit("WebSite").alias("@type"), c("legal_name").alias("name"))), F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("Organization")).alias("@type"), c("legal_name").alias("name"), c("subs").alias("subOrganization")))).alias("g"))
    return whole.select("lei_code", F.concat(F.lit('{"@context": "https://schema.org", "@graph": ['), F.array_join(graph["g"], ", "), F.lit("]}")).alias("doc"))


_KIND = "CASE legal_form WHEN 'PJ10' THEN 'Corporation' WHEN '5WWO' THEN 'LocalBusiness' END"


@query(
    "X42_X43_linked_data",
    f"""WITH x AS (SELECT parent_lei, child_lei FROM {R} r WHERE parent_lei <> child_lei), n AS (SELECT lei_code, legal_name, {_KIND} AS kind FROM {E} e),
      t AS (SELECT DISTINCT n.lei_code, n.legal_name FROM n JOIN x ON n.lei_code = x.parent_lei JOIN n k ON x.child_lei = k.lei_code),
      f AS (SELECT lei_code, 'Organization' AS kind, legal_name AS name, 1 AS times FROM t UNION ALL SELECT x.parent_lei, k.kind, k.legal_name, 1 FROM x JOIN n k ON x.child_lei = k.lei_code WHERE x.parent_lei IN (SELECT lei_code FROM t) AND k.kind IS NOT NULL
        UNION ALL SELECT x.parent_lei, k.kind, k.legal_name, 1 FROM x JOIN n m ON x.child_lei = m.lei_code JOIN x y ON x.child_lei = y.parent_lei JOIN n k ON y.child_lei = k.lei_code WHERE x.parent_lei IN (SELECT lei_code FROM t) AND k.kind IS NOT NULL)
      SELECT lei_code, kind, name, CASE kind WHEN 'LocalBusiness' THEN 0.9 ELSE 0.95 END::DOUBLE AS confidence, count(*) AS n FROM f GROUP BY ALL""",
)
def linked_data(spark: SparkSession, sf: str) -> DataFrame:
    """The trusted names in the linked data of groups of companies, three levels of organisations deep."""
    found = named_holders(group_documents(spark, sf), "lei_code", "doc")
    return found.groupBy(F.col("id").alias("lei_code"), "kind", "name", "confidence").agg(F.count("*").alias("n"))
