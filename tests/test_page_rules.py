"""Rules on pages and names, with values worked out by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import entities, evidence, judgements, knowledge, ladders, metadata
from tests.conftest import SF


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "v string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0])


PAGE = """<html lang="de"><head><title>Acme Steel | Home</title>{head}</head><body><header><div class="logo"><img src="a.png" alt="{alt}"></div></header><h1>{h1}</h1>{body}<footer>&copy; 2024 Acme Steel GmbH, All rights reserved</footer></body></html>"""
LD = '<script type="application/ld+json">{"@type": "%s", "name": "Acme Holding"}</script>'


@pytest.mark.parametrize(
    ("head", "h1", "site", "browser", "static"),
    [
        (LD % "Organization", "Welcome", ("Acme Holding", "json-ld_organization", 95), ("Acme Holding", "structured_data", 95), ("Acme Steel", "html_title", 70)),
        (LD % "Corporation", "Welcome", ("Acme Steel", "title_tag", 70), ("Acme Holding", "structured_data", 95), ("Acme Steel", "html_title", 70)),
        ('<meta property="og:site_name" content=" Acme ">', "x", ("Acme", "meta_og:site_name", 90), ("Acme", "meta_property", 85), ("Acme", "meta_property", 85)),
        ('<meta content="Acme App" name="application-name"/>', "x", ("Acme App", "meta_application-name", 85), ("Acme App", "meta_property", 85), ("Acme App", "meta_property", 85)),
        ('<meta name="author" content="Ann">', "x", ("Ann", "meta_author", 80), ("Acme Steel GmbH", "footer_copyright", 75), ("Acme Steel", "html_title", 70)),
        ("<script type='application/ld+json'>{broken</script>", "x", ("Acme Steel", "title_tag", 70), ("Acme Steel GmbH", "footer_copyright", 75), ("Acme Steel", "html_title", 70)),
    ],
)
def test_ladders(spark, head, h1, site, browser, static):
    html = PAGE.format(head=head, h1=h1, alt="Acme", body="")
    for ladder, want in ((ladders.site_ladder, site), (ladders.browser_ladder, browser), (ladders.static_ladder, static)):
        assert one(spark, html, *ladders.climb(ladder(F.col("v")))) == want


def test_lower_rungs(spark):
    bare = "<html><head><title></title></head><body>{}</body></html>"
    climb = lambda html, ladder: one(spark, html, *ladders.climb(ladder(F.col("v"))))
    assert climb(bare.format("<h1>Hi</h1><div class='x'></div><div class=\"top logo\">Acme Works</div>"), ladders.site_ladder) == ("Acme Works", "header_.logo", 75)
    assert climb(bare.format('<div class="page-footer">© 2020 Acme Ltd. All</div>'), ladders.site_ladder) == ("Acme Ltd", "footer_copyright", 60)
    assert climb(bare.format('<nav><a class="brand"> <img src="x" alt="Acme"></a></nav><h1>Steel</h1>'), ladders.browser_ladder) == ("Acme", "logo_alt_text", 70)
    assert climb(bare.format('<nav><a class="brand"><img alt="Acme logo"></a></nav><h1>Steel</h1>'), ladders.browser_ladder) == ("Steel", "h1_text", 65)
    assert climb(bare.format("<h1>Welcome home</h1>"), ladders.browser_ladder) == (None, None, 0)
    assert climb("<title>Example Domain</title>", ladders.site_ladder) == (None, None, 0)


@pytest.mark.parametrize(
    ("name", "valid", "reason"),
    [
        ("Acme", False, "Missing required legal suffix for corporate entity"),
        ("Acme Inc.", True, None),
        ("SecureVision", True, "Missing required legal suffix for corporate entity"),
        ("Error Tech", True, "Contains blacklisted pattern: error"),
        ("Access Denied", False, "Missing required legal suffix for corporate entity"),
        ("da Silva Comercio", False, "Missing required legal suffix for corporate entity"),
        ("platform", True, "Missing required legal suffix for corporate entity"),
        ("premier", False, "Missing required legal suffix for corporate entity"),
        ("Harvard University", True, None),
        ("12345", False, "Missing required legal suffix for corporate entity"),
        ("Welcome to Acme Inc", True, "Contains blacklisted pattern: welcome to"),
        ("ab", False, "Too short"),
        ("x" * 101, False, "Too long"),
    ],
)
def test_names(spark, name, valid, reason):
    assert one(spark, name, names.is_valid_name(F.col("v")), names.validation_reason(F.col("v"))) == (valid, reason)


def test_issues(spark):
    issues = lambda x: one(spark, x, names.name_issues(F.col("v")))[0]
    assert issues("Acme, Inc.") == issues("Acme Steel") == []
    assert issues("A") == ["Name too short", "Missing legal suffix (Inc., LLC, Ltd., etc.)"]
    assert issues("The Best Leading Co") == ['Contains marketing phrase: "the best"', 'Contains marketing phrase: "leading"']
    assert one(spark, "Your Industry Leader", names.is_marketing(F.col("v")), names.is_slogan(F.col("v"))) == (True, False)
    assert one(spark, "Re(AI)magining the world", names.is_marketing(F.col("v")), names.is_slogan(F.col("v"))) == (False, True)


def test_expected(spark):
    expected = lambda x: one(spark, x, names.expected_names(F.col("v")))[0]
    assert expected("mcinc-products.com") == ["Mcinc Products", "Mcinc-products", "Mcinc", "Products"]
    assert expected("abc_corp2go.de") == ["Abc Corp2go", "Abc_corp2go", "Abc"]


def test_markers(spark):
    def marked(text):
        found = evidence.markers(F.col("v"))
        return dict(zip(found, one(spark, text.lower(), *found.values()), strict=True))

    got = marked("Call +49 30 123 4567, Handelsregister HRB 123, registered in Berlin, Germany. € 5")
    assert sorted(got["hits"]) == ["DE", "DE", "DE", "DE"]  # phone, register, its number, city with country
    assert {"Germany"} <= set(got["mentions"]) and got["placed"] == ["registered in berlin, germany"] and got["signs"] == 1
    assert marked("only $5 AUD")["hits"] == [] and marked("$5 AUD and $50")["hits"] == ["US"]
    assert marked("tel +44 20 and +1 555")["dialled"] == ["+44", "+1"]
    assert marked("10 main street, 11 high road")["addresses"] == 2


def test_categories(spark):
    best = one(spark, "cloud banking", evidence.category_scores(F.lit("databank.io"), F.lit("Data Bank"), F.col("v")))[0]
    # technology: data in the domain 30 and the name 25, cloud in the content 15, .io 15; finance: bank 30, 25, ending 20, banking 15
    assert [(r["category"], -r["key"]) for r in best] == [("Financial Services", 90.0), ("Technology/Software", 85.0)]
    assert one(spark, "nothing", evidence.category_scores(F.lit("x.org"), F.lit(None).cast("string"), F.col("v")))[0] == []


def test_priority(spark):
    def vote(domain, phones, currency, lang):
        return one(spark, "", *evidence.priority_vote(F.lit(domain), F.array(*map(F.lit, phones)).cast("array<string>"), F.lit(currency), F.lit(lang)))

    assert vote("a.co.uk", ["+49 30"], "EUR", "de") == ("GB", 85)
    assert vote("a.com", ["+7 1", "+49 30"], "EUR", "fr") == ("DE", 75)
    assert vote("a.com", [], "EUR", "fr") == ("EU", 60)
    assert vote("a.com", [], "", "pt-BR") == ("BR", 50)
    assert vote("a.com", [], "", "sv") == (None, 0)


def test_contacts(spark):
    html = '<a href="/impressum">About <b>us</b></a><a class="x" href="/terms.html">T</a><a href="https://twitter.com/acme">t</a><a href="/about">x</a>'
    text = "Mail a@b.com, c@d.org, a@b.com; call (212) 555-7713 or +1 212 555 7714. 12 Main Street. Company No. 0123-X VAT: GB123 USA £"
    found = ladders.contacts(F.col("v"), F.lit(html))
    got = dict(zip(found, one(spark, text, *found.values()), strict=True))
    assert got["emails"] == "a@b.com; c@d.org" and got["addresses"] == "12 Main Street" and got["currencies"] == "£" and got["countries"] == "USA"
    assert (got["about_link"], got["terms_link"], got["privacy_link"], got["social"]) == ("/impressum", "/terms.html", None, "https://twitter.com/acme")
    assert (got["company_no"], got["vat"]) == ("0123-X", "GB123") and "(212) 555-7713" in got["phones"]


def test_score_v4(spark):
    c = [F.lit(x) for x in ("acme.com", "Acme", "Acme Stiftung", "8888", "US", "ACTIVE", "LAPSED")]
    assert one(spark, "", *ladders.score_v4(*c).values()) == (95, 95, 25, 70)
    c = [F.lit(x) for x in ("acme.de", "The Acme Works", "Acme GmbH", "2HBR", "DE", "INACTIVE", "ISSUED")]
    assert one(spark, "", *ladders.score_v4(*c).values()) == (90, 60, 60, 20)


def test_metadata(spark):
    html = """<html lang="en-GB"><head><meta property="og:price:currency" content="EUR"><meta property="og:price:amount" content="5"></head><body itemtype="https://schema.org/Organization">
    <script type="application/ld+json">{"@type": "Organization", "address": {"addressCountry": "IE", "addressLocality": "Cork"}}</script><a href="/terms">Terms</a><footer>© Acme Ltd</footer></body></html>"""
    text = "We are registered in England and Wales. The fee is £5 or £6 and $1, USD. Stripe. GDPR: privacy policy, cookie consent, data controller. Hereby the parties shall and shall not. insurance banking trading finance investment banking FCA"
    facts = metadata.page_metadata(F.lit(html), F.col("v"), F.lit("acme.de"))
    got = dict(zip(facts, one(spark, text, *facts.values()), strict=True))
    assert (got["language"], got["country"], got["city"], got["jurisdiction"]) == ("en", "IE", "Cork", "England and Wales")
    assert got["language_confidence"] == pytest.approx(0.5) and got["location_confidence"] == pytest.approx(0.7)
    assert (got["currency"], got["currencies"], got["currency_confidence"]) == ("GBP", "EUR,GBP,USD", 1.0)
    assert (got["formality"], got["private"], got["sector"], got["region"], got["disclosure"]) == ("low", True, "Financial Services", "UK_FCA", "high")
    assert got["transparency"] == pytest.approx(0.8)  # footer 0.3, registered 0.2, item type 0.3


def test_summary(spark):
    html = '<html><head><title>Welcome to Acme Solutions | Home</title>{}</head></html>'
    text = "© 2024 Acme Steel GmbH, Mail x@y.com or +49 301 234 5678"
    summed = lambda head: dict(zip(("title", "company", "primary", "entities", "emails", "phones"), one(spark, text, *metadata.summary(F.lit(html.format(head)), F.col("v")).values()), strict=True))
    got = summed("")
    assert (got["entities"], got["primary"], got["emails"]) == ("Acme; Acme Steel GmbH", "Acme Steel GmbH", "x@y.com") and "301 234 5678" in got["phones"]
    assert summed('<meta property="og:site_name" content="The  Site.">')["primary"] == "The Site"


def test_entity_evidence(spark):
    def page(blocks, text="", title="Acme | Home"):
        html = f"<html><head><title>{title}</title>" + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) + "</head></html>"
        found = spark.createDataFrame([(html, text)], "h string, t string").select(entities.evidence(F.col("h"), F.col("t")).alias("e"))
        facts = entities.page_entities(F.col("e"))
        row = found.select(*[c.alias(n) for n, c in facts.items()]).collect()[0]
        return row["primary_entity"], row["entities"], row["evidence"], round(row["confidence"], 9)

    assert page([]) == ("Acme", "Acme", "page_title=Acme", 0.6)
    # organisation .3, title .1, ending .2 on .5: capped
    assert page(['{"@type": "Organization", "name": "Acme Steel"}']) == ("Acme Steel Inc.", "Acme; Acme Steel Inc.", "page_title=Acme; json-ld_organization=Acme Steel Inc.", 0.95)
    graph = '{"@graph": [{"@type": ["Thing", "LocalBusiness"], "name": "Acme Shop"}, {"brand": {"name": "acme"}, "publisher": {"name": "Big Press AG"}}]}'
    assert page([graph])[1] == "Acme; Acme Shop Inc.; Big Press AG"
    assert page([graph])[2] == "page_title=Acme; json-ld_local_business=Acme Shop Inc.; json-ld_brand=acme; json-ld_publisher=Big Press AG"
    assert page(['[{"@type": "Organization", "name": "One GmbH"}, {"@type": "Organization", "name": "Longer Two GmbH"}]'])[0] == "Longer Two GmbH"
    assert page([], "Copyright by Acme Works, All. © 2024 x", "")[2] == "copyright=Acme Works"
    assert page([], "", "")[0] is None and page([], "", "")[3] == 0.0
    assert page([], "© Your Partner in steel, x", "Ab | x") == (None, "", "", 0.0)


def test_footer_ladder(spark):
    climb = lambda text: one(spark, f"<p>x</p><footer>{text}</footer>", *entities.footer_ladder(F.col("v")))
    assert climb("&copy; 2024 Acme Steel GmbH. All rights reserved") == ("Acme Steel GmbH", "puppeteer_footer_copyright", 85)
    assert climb("Acme Holdings - All Rights Reserved") == ("Acme Holdings", "puppeteer_footer_copyright", 85)
    assert climb("This site is operated by Acme Steel Corporation") == ("Acme Steel Corp", "puppeteer_legal_disclaimer", 75)
    assert climb("nothing here") == (None, "puppeteer_failed", 0)


def test_full_record(spark):
    rows = ['{"attributes": {"lei": "L1", "entity": {"legalName": {"name": "A"}, "associatedBIC": ["X", "Y"], "legalAddress": {"country": "DE", "addressLines": ["S 1", "F 2"]}}, "successorEntity": {"lei": "L2"}}}', '{"attributes": {"lei": "L3"}}', "{broken"]
    got = entities.full_record(spark.createDataFrame([(r,) for r in rows], "json string")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["lei_code"], r["entity_status"], r["category"], r["registration_status"], r["bics"], r["legal_lines"], r["jurisdiction"], r["successor"], r["headquarters_city"]) == ("L1", "UNKNOWN", "GENERAL", "UNKNOWN", "X, Y", "S 1, F 2", "DE", "L2", "")


def test_judgements(spark):
    value = lambda c: one(spark, "", c)[0]
    text = F.lit("Held by Acme Steel GmbH and Beta Works Limited, also ACME STEEL GMBH")
    assert value(judgements.legal_entities(text)) == ["Held by Acme Steel GmbH", "also ACME STEEL GMBH", "Held by Acme Steel GmbH and Beta Works Limited"]
    assert value(judgements.answer_confidence(F.lit("Acme Inc."), F.lit("acme.com"))) == 100 and value(judgements.answer_confidence(F.lit("Beta"), F.lit("acme.com"))) == 50
    cited = lambda n, k, c, s, m, said: value(judgements.cited_confidence(*(F.lit(x).cast(t) for x, t in zip((n, k, c, s, m, said), ("string", "string", "string", "int", "int", "string"), strict=True))))
    assert cited("A", None, None, 0, 0, None) == 60 and cited("A", "x", "DE", 1, 9, None) == 95 and cited("A", None, None, 0, 1, "High") == 95 and cited("", "x", "y", 1, 1, "high") == 0
    assert cited("A", None, None, 0, 1, "low") == 70
    patterns = lambda x: value(judgements.search_patterns(F.lit(x)))
    assert patterns("ELcomponics Ltd.") == ["ELcomponics Ltd.%", "ELcomponics%", "ELcomponics Holdings%", "ELcomponics International%", "ELcomponics Global%", "EL componics%"]
    assert patterns("Acme Systems") == [] and patterns("Acme") == ["Acme%"] and patterns("the Acme") == ["the Acme%"]
    assert [value(judgements.form_type(F.lit(x).cast("string"))) for x in ("5WWO", "ZZZZ", None)] == ["Foundation", "Legal Form: ZZZZ", "Unknown Legal Form"]
    assert [value(judgements.accessibility(F.lit(x).cast("string"))) for x in ("Protected - x", "cloudflare", "bot wall", None)] == ["Protected", "Cloudflare", "Bot-Detection", "Open"]
    assert [value(judgements.title_confidence(F.lit(x))) for x in ("Acme Inc.", "Harvard University", "World leader Inc.", "Search", "Acme", "AB")] == [95, 85, 10, 5, 30, 10]
    # name found 40, similarity 0.4 times 30, a company part 10: capped at 50; no term of the domain in the name
    match = lambda legal, place, kind, domain, term: value(judgements.match_confidence(*(F.lit(x).cast("string") for x in (legal, place, kind, domain, term))))
    assert match("Acme GmbH", "DE", None, "acme.de", "Acme") == 100
    assert match("Beta GmbH", "FR", "FUND", "acme.de", "zz") == pytest.approx(100 - 40 - 20 - 15 + max(0, (1 - 9 / 9) * 30 - 20 + 10))
    assert match("Beta GmbH", "DE", None, "acme.de", "Group") == 10
    assert value(judgements.ner_confidence(F.lit("Acme Steel Inc"), F.lit("© 2024 Acme Steel Inc"))) == pytest.approx(0.95)
    assert value(judgements.ner_confidence(F.lit("Terms Co"), F.lit("x"))) == pytest.approx(0.3)


def test_knowledge(spark):
    value = lambda c: one(spark, "", c)[0]
    worth = lambda url, text="": value(knowledge.link_priority(F.lit(url), F.lit(text)))
    assert [worth("/About-us"), worth("/x", "About our Company"), worth("/contact"), worth("/blog/about"), worth("/a#top"), worth("/about.pdf"), worth("/x")] == [3, 6, 2, 4, -10, -5, 0]
    assert [value(knowledge.link_key(F.lit(u))) for u in ("http://a/b/index.html#x", "http://a/b/?utm_source=q", "http://a/b?gclid=1&y=2&utm_x=3&z=4", "http://a/b/")] == ["http://a/b", "http://a/b", "http://a/b?y=2&z=4", "http://a/b"]
    alike = lambda a, b: value(knowledge.similarity_v3(F.lit(a), F.lit(b)))
    assert [alike("Acme", " acme "), alike("Acme Steel", "acme"), alike("Acme Steel Works", "acmes ironworks"), alike("ab cd", "xy zw")] == [100, 90, 53, 20]
    score = knowledge.entity_score(*(F.lit(x) for x in ("Acme", "acme", "ACTIVE", "ISSUED", "DE", "", "GMBH", "FUND")))
    assert value(score) == 40 + 25 + 20 + 4 + 3
    prior = spark.createDataFrame([("A", "old", 4), ("B", "kept", 1)], "lei_code string, legal_name string, frequency int")
    found = spark.createDataFrame([("A", "new", 2), ("A", "older", 1), ("C", "first", 1)], "lei_code string, legal_name string, found_at int")
    assert sorted(map(tuple, knowledge.accumulated(prior, found).collect())) == [("A", "new", 6), ("B", "kept", 1), ("C", "first", 1)]
    rows = spark.createDataFrame([(("a,b", 'say "x"'), [1, 2])], "r struct<p: string, q: string>, l array<int>")
    assert rows.select(knowledge.csv_line(["r.p", "r.q", "l"], rows).alias("x")).collect()[0]["x"] == '"a,b","say ""x""","[1,2]"'


def test_facts_once(spark):
    """Each dictionary of a page's metadata is read in one pass: what a judgement names twice is not computed twice."""
    plan = metadata.described(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in ("banking|", "hereby|", "United States|", "A\\$[")] == [1, 1, 1, 1]


def _texts():
    """Texts of the pieces that the patterns are about, in any order, and one of a single long run of words."""
    rng = random.Random(11)
    parts = ["Acme", "steel", "AND", "GmbH", "gmbh", "Co.", "KG", "& ", "Inc.", "Inc", "Ltd", "L.L.C.", "S.A.", "AG", "Corp", "Company", "2024", "12345", "12345-6", "©", "Copyright", ", ", ". ", "-", "'", "é", "0", "12", "main street", "ny", "a, ny 12345", "in", " ", "  ", "x"]
    return ["".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["word " * 300 + "2024", "© 2024 " + "word " * 300]


def _same_finds(spark, old, new, group, column=lambda c: c):
    df = spark.createDataFrame([(t,) for t in _texts()], "v string").select(column(F.col("v")).alias("v"))
    find = lambda p: F.filter(F.regexp_extract_all("v", F.lit(p), F.lit(group)), lambda x: x != "")
    got = df.select(find(old).alias("old"), find(new).alias("new")).collect()
    assert [r["new"] for r in got] == [r["old"] for r in got] and sum(len(r["new"]) for r in got) > 5


@pytest.mark.parametrize("at", range(len(judgements.LEGAL_ENTITIES)))
def test_legal_patterns(spark, at):
    p = judgements.bordered(judgements.LEGAL_ENTITIES[at])
    df = spark.createDataFrame([(t,) for t in _texts()], "v string")
    old = F.regexp_extract_all("v", F.lit(f"(?i){p}"), F.lit(0))
    new = F.filter(F.regexp_extract_all("v", F.lit(f"(?i)({p}){judgements.PASSED}"), F.lit(1)), lambda x: x != "")
    got = df.select(old.alias("old"), new.alias("new")).collect()
    assert [r["new"] for r in got] == [r["old"] for r in got]


@pytest.mark.parametrize("at", range(3))
def test_name_patterns(spark, at):
    _same_finds(spark, judgements.bordered(judgements.NER[at]), judgements.bordered(judgements.NER_JVM[at]), judgements.NER_GROUPS[at])


@pytest.mark.parametrize("at", range(3))
def test_street_patterns(spark, at):
    _same_finds(spark, evidence.STREETS[at], evidence.STREETS_JVM[at], 0, F.lower)


def test_long_runs(spark):
    """Steps grow with the text: these took the square of its length, hours for such a text."""
    text = "tone " * 200_000 + "2024 © 2024 Copyright 2024 " + "tone " * 200_000
    df = spark.createDataFrame([(text,)], "v string")
    every = [(p, 1) for p in (f"(?i)({judgements.bordered(x)}){judgements.PASSED}" for x in judgements.LEGAL_ENTITIES)] + [(judgements.bordered(p), g) for p, g in zip(judgements.NER_JVM[:3], judgements.NER_GROUPS, strict=False)]
    finds = [F.size(F.filter(F.regexp_extract_all("v", F.lit(p), F.lit(g)), lambda x: x != "")) for p, g in every] + [F.regexp_count("v", F.lit(p)) for p in evidence.STREETS_JVM]
    assert set(df.select(*[c.alias(f"c{i}") for i, c in enumerate(finds)]).collect()[0]) == {0}


def test_legal_names_keep_their_digits(spark):
    """Blanks are trimmed; the place of a find in its list is no character to trim."""
    assert one(spark, "0 Acme GmbH. 1 Beta GmbH, 2 Gamma GmbH", judgements.legal_entities(F.col("v")))[0] == ["0 Acme GmbH", "1 Beta GmbH", "2 Gamma GmbH"]


def test_borders(spark):
    """The cheaper border before a letter finds what the border of both sides finds, also beside letters that are not ASCII."""
    texts = _texts()[:300] + ["éparis, france", "xparis, france", "paris, france", "über uns", "xüber uns", "_hrb 1", "hrb 1", "中uk limited", "ſiret", "12345 usa"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").select(F.lower("v").alias("v"))
    old = lambda p: F.col("v").rlike("(?iu)" + p.replace(r"\b", evidence.BORDER))
    patterns = [p for p, _ in evidence.GEO if p.startswith(r"\b")]
    assert sum(evidence.jvm(p).startswith("(?iu)" + evidence.BEFORE) for p in patterns) > 25
    assert df.select(*[F.sum((old(p) != evidence.found(F.col("v"), p)).cast("int")).alias(f"c{i}") for i, p in enumerate(patterns)]).collect()[0] == tuple(0 for _ in patterns)
