"""A crawl of captured sites: breadth-first rounds of joins over their link graph, with depth, page quota and path filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.rounds import cut
from tessera.operators.evidence import quoted
from tessera.operators.knowledge import KEY_SQL, link_key
from tessera.operators.ladders import LINK, flat, flat_sql
from tessera.operators.scoring import contains_any
from tessera.plans.register import query
from tessera.sources.logical import DUMPS

P = DUMPS.sql

# What makes a link come before the others of its page, in its address or its text.
FIRST_PATHS = ["/about", "/company", "/legal", "/terms", "/contact", "/team"]
FIRST_WORDS = ["about", "company", "legal", "contact"]


@dataclass(frozen=True)
class Limits:
    """Rounds after the start page, pages of a site, links followed from a page, and parts of addresses of which one must, or none may, occur."""

    depth: int = 2
    pages: int = 10
    links: int = 10
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def address(url: Column) -> Column:
    """Host and path without scheme, fragment, tracking, index file and last slash: what makes two links the same page."""
    return F.regexp_replace(link_key(url), r"(?i)^https?://", "")


def site(addr: Column) -> Column:
    return F.lower(F.regexp_extract(addr, r"^[^/?]+", 0))


def resolved(href: Column, url: Column) -> Column:
    """The address a link of a page leads to; null for what is no web address."""
    page = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://", ""), r"[?#].*$", "")
    whole = (
        F.when(href.rlike(r"(?i)^https?://"), href)
        .when(href.startswith("//"), F.substr(href, F.lit(3)))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(href.startswith("/"), F.concat(F.regexp_extract(page, r"^[^/]*", 0), href))
        .when((href == "") | href.startswith("#") | href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(F.regexp_replace(page, r"/[^/]*$", ""), F.lit("/"), F.regexp_replace(href, r"^(\./)+", "")))
    )
    return address(whole)


def _address_sql(url: str) -> str:
    return f"regexp_replace({KEY_SQL.replace('href', url, 1)}, '(?i)^https?://', '')"


def _resolved_sql(href: str, url: str) -> str:
    page = f"regexp_replace(regexp_replace({url}, '(?i)^https?://', ''), '[?#].*$', '')"
    return _address_sql(
        f"""(CASE WHEN regexp_matches({href}, '(?i)^https?://') THEN {href} WHEN starts_with({href}, '//') THEN substr({href}, 3) WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
        WHEN starts_with({href}, '/') THEN concat(regexp_extract({page}, '^[^/]*'), {href}) WHEN {href} = '' OR starts_with({href}, '#') OR starts_with({href}, '?') THEN concat({page}, {href})
        ELSE concat(regexp_replace({page}, '/[^/]*$', ''), '/', regexp_replace({href}, '^(\\./)+', '')) END)"""
    )


def captured(pages: DataFrame) -> DataFrame:
    """``addr, dump_id, size, links``: one capture of each address, the one with the smallest id; links with target and text in the page's order."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label"))
    links = F.transform(both, lambda x: F.struct(resolved(x["href"], F.col("url")).alias("to"), F.lower(flat(x["label"])).alias("text")))
    rows = pages.select(address(F.col("url")).alias("addr"), "dump_id", F.octet_length("html").cast("long").alias("size"), F.filter(links, lambda x: x["to"].isNotNull()).alias("links"))
    first = rows.groupBy("addr").agg(F.min("dump_id").alias("dump_id"))  # ids alone decide, so the links shuffle once
    return rows.join(first, ["addr", "dump_id"])


def link_graph(found: DataFrame, most: int) -> DataFrame:
    """``addr, pos, to``: the links that a crawl follows. Of a captured page the first ``most`` of its preferred and then all its links within the site; an address that was not captured lists, as the index of a server would,
    the captured pages below it by id."""
    inside = F.filter("links", lambda x: site(x["to"]) == site(F.col("addr")))
    preferred = F.filter(inside, lambda x: contains_any(F.lower(x["to"]), FIRST_PATHS) | contains_any(x["text"], FIRST_WORDS))
    of_page = found.select("addr", F.posexplode(F.slice(F.concat(preferred, inside), 1, most)).alias("pos", "x")).select("addr", "pos", F.col("x.to").alias("to"))
    path = F.split(F.regexp_replace("addr", r"\?.*$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.array_join(F.slice(path, F.lit(1), n), "/"))
    sections = found.select(F.explode(F.filter(above, lambda a: a != F.col("addr"))).alias("section"), "dump_id", F.col("addr").alias("to"))
    ranked = sections.withColumn("pos", F.row_number().over(Window.partitionBy("section").orderBy("dump_id")) - 1).filter(F.col("pos") < most)
    of_index = ranked.join(found.select(F.col("addr").alias("section")), "section", "left_anti").select(F.col("section").alias("addr"), "pos", "to")
    return of_page.unionByName(of_index)


def crawl(starts: DataFrame, graph: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``site, addr, depth, place``: the addresses that a crawl visits, site by site.

    A round takes the links of the addresses visited last, drops those visited before and those that the path filters bar, keeps the first way to each and admits them in the order in which they were found until the site's
    pages are used up. Links of the last round are visited, not followed. ``starts`` has a site and address each; equal ones count once."""
    allowed = F.lit(True)
    if limits.include:
        allowed = allowed & contains_any(F.col("to"), list(limits.include))
    if limits.exclude:
        allowed = allowed & ~contains_any(F.col("to"), list(limits.exclude))
    graph = graph.filter(allowed)
    visited = frontier = cut(starts.select("site", "addr").distinct().groupBy("site").agg(F.min("addr").alias("addr")).select("site", "addr", F.lit(0).alias("depth"), F.lit(1).alias("place")))
    for depth in range(1, limits.depth + 1):
        ways = frontier.join(graph, "addr").groupBy("site", F.col("to").alias("addr")).agg(F.min(F.struct("place", "pos")).alias("way"))
        used = visited.groupBy("site").agg(F.max("place").alias("used"))
        new = ways.join(visited.select("site", "addr"), ["site", "addr"], "left_anti").join(used, "site")
        order = F.row_number().over(Window.partitionBy("site").orderBy("way", "addr"))
        frontier = new.withColumn("n", order).filter(F.col("n") <= limits.pages).withColumn("place", F.col("used") + F.col("n")).filter(F.col("place") <= limits.pages)
        frontier = cut(frontier.select("site", "addr", F.lit(depth).alias("depth"), "place"))
        visited = visited.unionByName(frontier)
    return visited


def crawl_captures(spark: SparkSession, sf: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    found = cut(captured(DUMPS.read(spark, sf)))
    starts = found.select(site(F.col("addr")).alias("site")).distinct().withColumn("addr", F.col("site"))
    return crawl(starts, link_graph(found, limits.links), limits), found


def crawl_sql(limits: Limits = Limits()) -> str:
    """The rounds as common table expressions, ending in ``visited`` (site, addr, depth, place) and ``found``."""
    site_of = lambda c: f"lower(regexp_extract({c}, '^[^/?]+'))"
    holds = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    allowed = " AND ".join([holds('"to"', limits.include)] * bool(limits.include) + [f"NOT {holds('"to"', limits.exclude)}"] * bool(limits.exclude)) or "true"
    parts = [
        f"""raw AS (SELECT {_address_sql('url')} AS addr, dump_id, octet_length(encode(html))::BIGINT AS size, url, regexp_extract_all(html, {quoted(LINK)}, 1) AS h, regexp_extract_all(html, {quoted(LINK)}, 2) AS l FROM {P} p)""",
        f"""found AS (SELECT addr, dump_id, size, list_filter(list_transform(range(1, len(h) + 1), lambda i: {{'to': {_resolved_sql('h[i]', 'url')}, 'text': lower({flat_sql('l[i]')})}}), lambda x: x['to'] IS NOT NULL) AS links
          FROM raw WHERE dump_id = (SELECT min(dump_id) FROM raw r WHERE r.addr = raw.addr))""",
        f"""inside AS (SELECT addr, list_filter(links, lambda x: {site_of("x['to']")} = {site_of('addr')}) AS links FROM found)""",
        f"""of_page AS (SELECT addr, unnest(range(len(k))) AS pos, unnest(list_transform(k, lambda x: x['to'])) AS "to" FROM (
          SELECT addr, list_concat(list_filter(links, lambda x: {holds("lower(x['to'])", FIRST_PATHS)} OR {holds("x['text']", FIRST_WORDS)}), links)[1:{limits.links}] AS k FROM inside) y)""",
        """paths AS (SELECT addr, dump_id, string_split(regexp_replace(addr, '\\?.*$', ''), '/') AS s FROM found)""",
        f"""of_index AS (SELECT section AS addr, pos, addr AS "to" FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY dump_id) - 1 AS pos FROM (
          SELECT unnest(list_transform(range(1, len(s) + 1), lambda n: array_to_string(s[1:n], '/'))) AS section, dump_id, addr FROM paths) y WHERE section <> addr) z WHERE pos < {limits.links} AND section NOT IN (SELECT addr FROM found))""",
        f"""graph AS (SELECT * FROM (SELECT * FROM of_page UNION ALL SELECT * FROM of_index) g WHERE {allowed})""",
        f"""v0 AS (SELECT DISTINCT {site_of('addr')} AS site, {site_of('addr')} AS addr, 0 AS depth, 1 AS place FROM found)""",
    ]
    for d in range(1, limits.depth + 1):
        before = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(d))
        parts.append(
            f"""v{d} AS (SELECT site, addr, {d} AS depth, place FROM (SELECT w.site, w.addr, u.used + row_number() OVER (PARTITION BY w.site ORDER BY w.way, w.addr) AS place FROM (
              SELECT f.site, g."to" AS addr, min((f.place, g.pos)) AS way FROM v{d - 1} f JOIN graph g ON f.addr = g.addr GROUP BY ALL) w JOIN (SELECT site, max(place) AS used FROM ({before}) b GROUP BY site) u ON w.site = u.site
              WHERE NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.site = w.site AND b.addr = w.addr)) x WHERE place <= {limits.pages})"""
        )
    return "WITH " + ",\n".join(parts) + ", visited AS (" + " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(limits.depth + 1)) + ")"


@query(
    "S11_site_crawl",
    f"""{crawl_sql()} SELECT v.site, v.addr AS address, v.depth, v.place::INT AS place, f.dump_id, CASE WHEN f.dump_id IS NOT NULL THEN 'page' WHEN v.addr IN (SELECT addr FROM of_index) THEN 'index' ELSE 'missing' END AS kind
      FROM visited v LEFT JOIN found f ON v.addr = f.addr""",
)
def site_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Every captured site from its host: ten pages, two rounds."""
    return described(*crawl_captures(spark, sf))


def described(visited: DataFrame, found: DataFrame) -> DataFrame:
    """The visited addresses with their captures; ``index`` where captured pages lie below, ``missing`` where nothing was captured."""
    path = F.split(F.regexp_replace("addr", r"\?.*$", ""), "/")
    above = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.array_join(F.slice(path, F.lit(1), n), "/"))).alias("addr")).distinct().withColumn("is_index", F.lit(True))
    joined = visited.join(found.select("addr", "dump_id"), "addr", "left").join(above, "addr", "left")
    kind = F.when(F.col("dump_id").isNotNull(), "page").when(F.col("is_index"), "index").otherwise("missing")
    return joined.select("site", F.col("addr").alias("address"), "depth", "place", "dump_id", kind.alias("kind"))


@query(
    "S11_section_crawl",
    f"""{crawl_sql(Limits(depth=3, pages=25, links=25, exclude=('?', '/fr')))} SELECT v.site, v.addr AS address, v.depth, v.place::INT AS place, f.dump_id,
      CASE WHEN f.dump_id IS NOT NULL THEN 'page' WHEN v.addr IN (SELECT addr FROM of_index) THEN 'index' ELSE 'missing' END AS kind FROM visited v LEFT JOIN found f ON v.addr = f.addr""",
)
def section_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds, 25 pages, neither addresses with a query nor the French section."""
    return described(*crawl_captures(spark, sf, Limits(depth=3, pages=25, links=25, exclude=("?", "/fr"))))


@query(
    "S11_site_map",
    f"""{crawl_sql()}, l AS (SELECT v.site, x['to'] AS "to" FROM visited v JOIN (SELECT addr, unnest(links) AS x FROM found) f ON v.addr = f.addr)
      SELECT v.site, count(*) AS visited, count(f.dump_id) AS pages, coalesce(sum(f.size), 0)::BIGINT AS total_bytes, max(v.depth) AS depth, coalesce(any_value(k.internal), 0) AS internal_links, coalesce(any_value(k.external), []) AS external_links
      FROM visited v LEFT JOIN found f ON v.addr = f.addr LEFT JOIN (SELECT site, count(DISTINCT "to") FILTER (lower(regexp_extract("to", '^[^/?]+')) = site) AS internal,
        list_sort(list(DISTINCT "to") FILTER (lower(regexp_extract("to", '^[^/?]+')) <> site))[1:100] AS external FROM l GROUP BY site) k ON v.site = k.site GROUP BY v.site""",
)
def site_map(spark: SparkSession, sf: str) -> DataFrame:
    """What a crawl leaves of each site: pages, bytes, links within it, and a hundred links out of it."""
    visited, found = crawl_captures(spark, sf)
    pages = visited.join(found, "addr", "left")
    sums = pages.groupBy("site").agg(F.count("*").alias("visited"), F.count("dump_id").alias("pages"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.max("depth").alias("depth"))
    links = pages.select("site", F.explode("links").alias("x")).select("site", F.col("x.to").alias("to")).distinct().withColumn("inside", site(F.col("to")) == F.col("site"))
    internal = links.filter("inside").groupBy("site").agg(F.count("*").alias("internal_links"))
    first = links.filter("NOT inside").withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("to"))).filter("n <= 100")
    external = first.groupBy("site").agg(F.array_sort(F.collect_list("to")).alias("external_links"))
    joined = sums.join(internal, "site", "left").join(external, "site", "left")
    return joined.withColumn("internal_links", F.coalesce("internal_links", F.lit(0))).withColumn("external_links", F.coalesce("external_links", F.array().cast("array<string>")))
