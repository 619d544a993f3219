"""The crawl on a small site, by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import crawl

PAGES = [
    (1, "https://a.org/x/1.html", '<a class=k href="/x/2.html">next</a> <a class=k href="mailto:m@a.org">m</a> <a class=k href="https://b.org/q">out</a> <a class=k href="3.html#top">three</a> <a class=k href="/team">our people</a>'),
    (2, "http://a.org/x/2.html?utm_source=f", '<a class=k href="../y">up</a> <a class=k href="//a.org/z/">z</a> <a class=k href="?page=2">more</a>'),
    (3, "https://a.org/x/3.html", "no links"),
    (4, "https://a.org/z", '<a class=k href="/z/deep">deep</a>'),
    (5, "https://a.org/z/deep", ""),
    (9, "https://a.org/x/3.html#again", '<a class=k href="/never">a later capture of the same page</a>'),
]


def _crawled(spark, **limits):
    limits = crawl.Limits(**limits)
    rows = spark.createDataFrame(PAGES, "dump_id long, url string, html string")
    found = crawl.captured(rows).cache()
    starts = spark.createDataFrame([("a.org", "a.org"), ("a.org", "a.org")], "site string, addr string")
    got = crawl.described(crawl.crawl(starts, crawl.link_graph(found, limits.links), limits), found).orderBy("place").collect()
    return [(r["address"], r["depth"], r["kind"]) for r in got]


def test_order_depth_and_kinds(spark):
    assert _crawled(spark, depth=1) == [("a.org", 0, "index"), ("a.org/x/1.html", 1, "page"), ("a.org/x/2.html", 1, "page"), ("a.org/x/3.html", 1, "page"), ("a.org/z", 1, "page"), ("a.org/z/deep", 1, "page")]
    # the preferred link of page 1 comes first, then the others in order; what was seen before does not come again
    assert _crawled(spark, depth=2)[6:] == [("a.org/team", 2, "missing"), ("a.org/x/../y", 2, "missing"), ("a.org/x/2.html?page=2", 2, "missing")]


def test_quota_links_and_filters(spark):
    assert [x[0] for x in _crawled(spark, depth=3, pages=4)] == ["a.org", "a.org/x/1.html", "a.org/x/2.html", "a.org/x/3.html"]
    assert [x[0] for x in _crawled(spark, depth=2, links=1)] == ["a.org", "a.org/x/1.html", "a.org/team"]
    assert [x[0] for x in _crawled(spark, depth=3, include=("/z",))] == ["a.org", "a.org/z", "a.org/z/deep"]
    assert "a.org/team" not in [x[0] for x in _crawled(spark, depth=2, exclude=("/team",))]


def test_no_pages(spark):
    empty = spark.createDataFrame([], "dump_id long, url string, html string")
    found = crawl.captured(empty)
    starts = found.select(crawl.site(F.col("addr")).alias("site"), "addr")
    assert crawl.crawl(starts, crawl.link_graph(found, 10)).collect() == []
