"""The entity graph: hierarchy levels, ultimate parents, families, inferred relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.register import query
from tessera.sources.logical import CANDIDATES, EDGES, ENTITIES

E, R, C = ENTITIES.sql, EDGES.sql, CANDIDATES.sql
#: Steps that a walk to the ultimate parent takes at most.
DEPTH = 5


@query(
    "N1_hierarchy_level",
    f"""SELECT e.lei_code, CASE WHEN p.child_lei IS NULL AND c.parent_lei IS NOT NULL THEN 'ultimate_parent' WHEN p.child_lei IS NULL THEN 'standalone' WHEN p.ultimate THEN 'subsidiary' ELSE 'parent' END AS level
        FROM {E} e LEFT JOIN (SELECT child_lei, bool_or(relationship_type = 'IS_ULTIMATELY_CONSOLIDATED_BY') AS ultimate FROM {R} r GROUP BY child_lei) p ON e.lei_code = p.child_lei LEFT JOIN (SELECT DISTINCT parent_lei FROM {R} r) c ON e.lei_code = c.parent_lei""",
)
def hierarchy_level(spark: SparkSession, sf: str) -> DataFrame:
    edges = EDGES.read(spark, sf)
    up = edges.groupBy(F.col("child_lei").alias("lei_code")).agg(F.bool_or(F.col("relationship_type") == "IS_ULTIMATELY_CONSOLIDATED_BY").alias("ultimate"))
    down = edges.select(F.col("parent_lei").alias("lei_code")).distinct().withColumn("has_children", F.lit(True))
    joined = ENTITIES.read(spark, sf).select("lei_code").join(up, "lei_code", "left").join(down, "lei_code", "left")
    top = F.col("ultimate").isNull()
    return joined.select("lei_code", F.when(top & F.col("has_children"), "ultimate_parent").when(top, "standalone").when(F.col("ultimate"), "subsidiary").otherwise("parent").alias("level"))


@query(
    "N2_ultimate_parent",
    f"""WITH RECURSIVE walk(lei_code, node, depth) AS (SELECT lei_code, lei_code, 0 FROM {E} e UNION ALL SELECT w.lei_code, r.parent_lei, w.depth + 1 FROM walk w JOIN {R} r ON w.node = r.child_lei WHERE w.depth < {DEPTH})
        SELECT lei_code, arg_max(node, depth) AS ultimate_parent, max(depth) AS depth FROM walk GROUP BY lei_code""",
)
def ultimate_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Up along the first parent, a bounded number of steps: one left join a step, no recursion over the graph's size."""
    first = EDGES.read(spark, sf).groupBy(F.col("child_lei").alias("at")).agg(F.min("parent_lei").alias("up"))
    walk = ENTITIES.read(spark, sf).select("lei_code", F.col("lei_code").alias("at"), F.lit(0).alias("depth"))
    for _ in range(DEPTH):
        walk = walk.join(first, "at", "left").select("lei_code", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("depth"))
    return walk.select("lei_code", F.col("at").alias("ultimate_parent"), "depth")


@query(
    "U6_corporate_family",
    f"""WITH u AS (SELECT c.child_lei AS lei_code, coalesce(g.parent_lei, c.parent_lei) AS top FROM {R} c LEFT JOIN {R} g ON c.parent_lei = g.child_lei)
        SELECT DISTINCT lei_code, member FROM (SELECT lei_code, top AS member FROM u UNION SELECT u.lei_code, r.child_lei FROM u JOIN {R} r ON u.top = r.parent_lei UNION SELECT lei_code, lei_code FROM u) x""",
)
def corporate_family(spark: SparkSession, sf: str) -> DataFrame:
    """The grandparent (or parent), its children, and the entity itself."""
    edges = EDGES.read(spark, sf).select("parent_lei", "child_lei")
    above = edges.select(F.col("child_lei").alias("parent_lei"), F.col("parent_lei").alias("above"))
    top = edges.join(above, "parent_lei", "left").select(F.col("child_lei").alias("lei_code"), F.coalesce("above", "parent_lei").alias("top"))
    children = top.join(edges, F.col("top") == F.col("parent_lei")).select("lei_code", F.col("child_lei").alias("member"))
    return top.select("lei_code", F.col("top").alias("member")).union(children).union(top.select("lei_code", "lei_code")).distinct()


@query(
    "J7_N3_inferred_relationships",
    f"""SELECT a.domain_id, a.lei_code AS one, b.lei_code AS two, CASE WHEN a.jurisdiction <> b.jurisdiction AND a.city IS DISTINCT FROM b.city THEN 'subsidiary' ELSE 'affiliate' END AS kind, CASE WHEN a.jurisdiction <> b.jurisdiction AND a.city IS DISTINCT FROM b.city THEN 70 ELSE 60 END AS confidence
        FROM (SELECT DISTINCT domain_id, lei_code, legal_name, jurisdiction, city FROM {C} c) a JOIN (SELECT DISTINCT domain_id, lei_code, legal_name, jurisdiction, city FROM {C} c) b ON a.domain_id = b.domain_id AND a.lei_code < b.lei_code
        WHERE len(list_filter(regexp_split_to_array(lower(a.legal_name), '\\s+'), lambda w: length(w) > 2 AND list_contains(regexp_split_to_array(lower(b.legal_name), '\\s+'), w)))
          >= greatest(1, least(len(list_filter(regexp_split_to_array(lower(a.legal_name), '\\s+'), lambda w: length(w) > 2)), len(list_filter(regexp_split_to_array(lower(b.legal_name), '\\s+'), lambda w: length(w) > 2))) * 0.5)""",
)
def inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs within one domain's search result that share enough words: only candidates with a word in common meet, by domain and word, and the words they share are counted.

    Rows lie together by domain first, so what counts within a domain needs no further exchange; a word that one candidate of a domain has alone meets nothing and is not sent again."""
    c = F.col
    found = CANDIDATES.read(spark, sf).select("domain_id", "lei_code", "legal_name", "jurisdiction", "city").repartition("domain_id").distinct()
    words = found.withColumn("words", F.filter(F.split(F.lower("legal_name"), r"\s+"), lambda w: F.length(w) > 2))
    words = words.withColumn("me", F.struct("lei_code", "legal_name", "jurisdiction", "city", F.size("words").alias("n")))
    once = words.select("domain_id", "me", "words", F.explode(F.array_distinct("words")).alias("word"))
    several = once.withColumn("rows", F.count("*").over(Window.partitionBy("domain_id", "word"))).filter("rows > 1")
    kept = several.select("domain_id", "me", "word", F.size(F.filter("words", lambda w: w == c("word"))).alias("times"))
    met = kept.join(kept.select("domain_id", "word", c("me").alias("you")), ["domain_id", "word"]).filter("me.lei_code < you.lei_code").groupBy("domain_id", "me", "you").agg(F.sum("times").alias("shared"))
    enough = c("shared") >= F.greatest(F.lit(1.0), F.least("me.n", "you.n") * 0.5)
    pairs = met.filter(enough).select("domain_id", c("me").alias("a"), c("you").alias("b"))
    apart = (c("a.jurisdiction") != c("b.jurisdiction")) & ~c("a.city").eqNullSafe(c("b.city"))
    return pairs.select("domain_id", c("a.lei_code").alias("one"), c("b.lei_code").alias("two"), F.when(apart, "subsidiary").otherwise("affiliate").alias("kind"), F.when(apart, 70).otherwise(60).alias("confidence"))


@query("S10_relationships_by_type", f"SELECT child_lei, max(CASE WHEN relationship_type = 'IS_ULTIMATELY_CONSOLIDATED_BY' THEN parent_lei END) AS ultimate_parent, list(parent_lei ORDER BY parent_lei) FILTER (relationship_type <> 'IS_ULTIMATELY_CONSOLIDATED_BY') AS parents FROM {R} r GROUP BY child_lei")
def relationships_by_type(spark: SparkSession, sf: str) -> DataFrame:
    ultimate = F.col("relationship_type") == "IS_ULTIMATELY_CONSOLIDATED_BY"
    parents = F.array_sort(F.collect_list(F.when(~ultimate, F.col("parent_lei"))))
    return EDGES.read(spark, sf).groupBy("child_lei").agg(F.max(F.when(ultimate, F.col("parent_lei"))).alias("ultimate_parent"), F.when(F.size(parents) > 0, parents).alias("parents"))


@query("J8_name_patterns", f"SELECT e.lei_code, p.pattern FROM {E} e JOIN (SELECT DISTINCT concat(string_split(legal_name, ' ')[1]) AS pattern FROM {E} x WHERE n % 5 = 0) p ON e.legal_name LIKE concat(p.pattern, '%')")
def name_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix patterns met through their first word: an equi join in place of a theta join."""
    entities = ENTITIES.read(spark, sf)
    first = F.element_at(F.split("legal_name", " "), 1)
    patterns = entities.filter("n % 5 = 0").select(first.alias("pattern")).distinct()
    return entities.withColumn("pattern", first).join(patterns, "pattern").select("lei_code", "pattern")


@query("K14_cache_upsert", f"SELECT lei_code, cached FROM (SELECT lei_code, cached, row_number() OVER (PARTITION BY lei_code ORDER BY fresh DESC) AS rn FROM (SELECT lei_code, balance AS cached, 0 AS fresh FROM {E} e UNION ALL SELECT lei_code, balance * 2, 1 FROM {E} e2 WHERE n % 3 = 0) x) y WHERE rn = 1")
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """New rows replace old ones of their key; the others stay."""
    old = ENTITIES.read(spark, sf).select("lei_code", F.col("balance").alias("cached"), "n")
    new = old.filter("n % 3 = 0").select("lei_code", (F.col("cached") * 2).alias("cached"))
    return old.select("lei_code", "cached").join(new.select("lei_code"), "lei_code", "left_anti").unionByName(new)
