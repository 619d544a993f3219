"""What pages and names give away: places, industries, contacts, and the ladders that name a page's company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators.extraction import DECODE_SQL, decoded
from tessera.operators.scoring import TLD_COUNTRY, TLD_SQL, case, lookup
from tessera.plans.register import query
from tessera.sources.logical import DOMAINS, DUMPS

D, P = DOMAINS.sql, DUMPS.sql
#: A word border in ASCII, as in the application; the JVM's own one follows Unicode.
BORDER = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
quoted = lambda x: "'" + x.replace("'", "''") + "'"


#: What cannot stand before a border that a letter or digit of ASCII follows: cheaper than BORDER, which looks both ways at every place.
BEFORE = r"(?<![0-9A-Za-z_])"


def jvm(pattern: str) -> str:
    first = pattern.removeprefix(r"\b")
    starts = [x[:1] for x in first[1 : first.index(")")].split("|")] if first.startswith("(") else [first[:1]]
    if first != pattern and all(x.isascii() and x.isalnum() for x in starts):
        return "(?iu)" + BEFORE + first.replace(r"\b", BORDER)
    return "(?iu)" + pattern.replace(r"\b", BORDER)


def found(text: Column, pattern: str) -> Column:
    return text.rlike(jvm(pattern))


def found_sql(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted('(?i)' + pattern)})"


def tagless(html: Column) -> Column:
    """The text of a page, whole, without scripts, styles and tags."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(text, r"<[^>]*>", " ")), r"\s+", " "))


TEXT_SQL = f"trim(regexp_replace({DECODE_SQL("regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'))"
HTML_LANG = r'(?i)<html[^>]*\slang="([^"]*)"'

# Patterns that place a page, by class, with the country each stands for. Terms in other scripts have no word borders, which are ASCII.
GEO_PHONE = [
    (r"\+1[\s\-\.]?\(?[0-9]{3}\)?[\s\-\.]?[0-9]{3}[\s\-\.]?[0-9]{4}", "US"),
    (r"\+44[\s\-\.]?[0-9]{2,4}[\s\-\.]?[0-9]{3,4}[\s\-\.]?[0-9]{3,4}", "GB"),
    (r"\+49[\s\-\.]?[0-9]{2,4}[\s\-\.]?[0-9]{3,4}[\s\-\.]?[0-9]{3,4}", "DE"),
    (r"\+33[\s\-\.]?[0-9]{1}[\s\-\.]?[0-9]{2}[\s\-\.]?[0-9]{2}[\s\-\.]?[0-9]{2}[\s\-\.]?[0-9]{2}", "FR"),
    (r"\+55[\s\-\.]?\(?[0-9]{2}\)?[\s\-\.]?[0-9]{4,5}[\s\-\.]?[0-9]{4}", "BR"),
    (r"\+65[\s\-\.]?[0-9]{4}[\s\-\.]?[0-9]{4}", "SG"),
    (r"\+81[\s\-\.]?[0-9]{1,4}[\s\-\.]?[0-9]{1,4}[\s\-\.]?[0-9]{1,4}", "JP"),
    (r"\+86[\s\-\.]?[0-9]{2,4}[\s\-\.]?[0-9]{3,4}[\s\-\.]?[0-9]{3,4}", "CN"),
    (r"\+91[\s\-\.]?[0-9]{4}[\s\-\.]?[0-9]{3}[\s\-\.]?[0-9]{3}", "IN"),
    (r"\+90[\s\-\.]?[0-9]{3}[\s\-\.]?[0-9]{3}[\s\-\.]?[0-9]{2}[\s\-\.]?[0-9]{2}", "TR"),
    (r"\+7[\s\-\.]?[0-9]{3}[\s\-\.]?[0-9]{3}[\s\-\.]?[0-9]{2}[\s\-\.]?[0-9]{2}", "RU"),
    (r"\+52[\s\-\.]?\(?[0-9]{2,3}\)?[\s\-\.]?[0-9]{3,4}[\s\-\.]?[0-9]{4}", "MX"),
]
GEO_CURRENCY = [
    (r"USD?\s*\$?[0-9,]+(\.[0-9]{2})?", "US"),
    (r"£[0-9,]+(\.[0-9]{2})?", "GB"),
    (r"GBP\s*£?[0-9,]+(\.[0-9]{2})?", "GB"),
    (r"€[0-9,]+(\.[0-9]{2})?", "EU"),
    (r"EUR\s*€?[0-9,]+(\.[0-9]{2})?", "EU"),
    (r"¥[0-9,]+", "JP"),
    (r"JPY\s*¥?[0-9,]+", "JP"),
    (r"R\$[0-9,]+(\.[0-9]{2})?", "BR"),
    (r"BRL\s*R?\$?[0-9,]+(\.[0-9]{2})?", "BR"),
    (r"₹[0-9,]+(\.[0-9]{2})?", "IN"),
    (r"INR\s*₹?[0-9,]+(\.[0-9]{2})?", "IN"),
    (r"₩[0-9,]+", "KR"),
    (r"KRW\s*₩?[0-9,]+", "KR"),
    (r"¥[0-9,]+\s*(RMB|CNY|中国)", "CN"),
    (r"RMB\s*¥?[0-9,]+(\.[0-9]{2})?", "CN"),
]
GEO_JURISDICTION = [
    (r"\b(Delaware|Nevada|California|New York|Texas|Florida)\s+(corporation|corp\.?|inc\.?|LLC)\b", "US"),
    (r"\b(SEC|Securities and Exchange Commission|IRS|Internal Revenue Service)\b", "US"),
    (r"\bEIN\s*:?\s*[0-9]{2}-[0-9]{7}\b", "US"),
    (r"\b(Companies House|UK|United Kingdom|England|Scotland|Wales)\s+(Limited|Ltd\.?|PLC)\b", "GB"),
    (r"\bCompany\s+Number\s*:?\s*[0-9]{8}\b", "GB"),
    (r"\bVAT\s+(Registration\s+)?Number\s*:?\s*GB[0-9]{9}\b", "GB"),
    (r"\b(Handelsregister|Amtsgericht|Registergericht)\b", "DE"),
    (r"\bHRB\s*[0-9]+\b", "DE"),
    (r"\bUStIdNr\.?\s*:?\s*DE[0-9]{9}\b", "DE"),
    (r"\b(Registre du commerce|SIRET|SIREN|RCS)\b", "FR"),
    (r"\bSIRET\s*:?\s*[0-9]{14}\b", "FR"),
    (r"\bSIREN\s*:?\s*[0-9]{9}\b", "FR"),
    (r"\b(CNPJ|Receita Federal|Junta Comercial)\b", "BR"),
    (r"\bCNPJ\s*:?\s*[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}\b", "BR"),
    (r"\b(ACRA|Singapore|Accounting and Corporate Regulatory Authority)\b", "SG"),
    (r"\bUEN\s*:?\s*[0-9]{8}[A-Z]\b", "SG"),
    (r"中国|\bPeople's Republic of China\b|\bPRC\b|工商|营业执照", "CN"),
    (r"统一社会信用代码\s*:?\s*[0-9A-Z]{18}\b", "CN"),
    (r"\b(Ministry of Corporate Affairs|MCA|Corporate Identity Number|CIN)\b", "IN"),
    (r"\bCIN\s*:?\s*[UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}\b", "IN"),
    (r"\b(Ticaret Sicil|Merkezi Sicil|Vergi Dairesi)\b", "TR"),
    (r"\bVergi\s+No\s*:?\s*[0-9]{10}\b", "TR"),
    (r"ОГРН|ИНН|Федеральная налоговая служба|ФНС", "RU"),
    (r"ОГРН\s*:?\s*[0-9]{13}\b", "RU"),
    (r"ИНН\s*:?\s*[0-9]{10,12}\b", "RU"),
]
GEO_ADDRESS = [
    (
        r"\b(Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming)\b",
        "US",
    ),
    (r"\b[0-9]{5}(-[0-9]{4})?\s+(USA|United States)\b", "US"),
    (r"\b(London|Manchester|Birmingham|Edinburgh|Glasgow)\b.*\b(UK|United Kingdom|England|Scotland)\b", "GB"),
    (r"\b(Berlin|Munich|Hamburg|Frankfurt|Cologne|Stuttgart|Düsseldorf)\b.*\bGermany\b", "DE"),
    (r"\b(Paris|Lyon|Marseille|Toulouse|Nice|Nantes|Strasbourg)\b.*\bFrance\b", "FR"),
    (r"\b(São Paulo|Rio de Janeiro|Brasília|Salvador|Fortaleza|Belo Horizonte)\b.*\bBrazil\b", "BR"),
    (r"\b(Tokyo|Osaka|Kyoto|Yokohama|Nagoya|Sapporo|Fukuoka)\b.*\bJapan\b", "JP"),
    (r"\b(Beijing|Shanghai|Guangzhou|Shenzhen|Chengdu|Hangzhou|Nanjing)\b.*\bChina\b", "CN"),
    (r"\b(Mumbai|Delhi|Bangalore|Hyderabad|Chennai|Kolkata|Pune)\b.*\bIndia\b", "IN"),
    (r"\b(Istanbul|Ankara|Izmir|Bursa|Antalya)\b.*\bTurkey\b", "TR"),
    (r"\b(Moscow|St\. Petersburg|Novosibirsk|Yekaterinburg|Nizhny Novgorod)\b.*\bRussia\b", "RU"),
]
GEO_LANGUAGE = [
    (r"\b(privacy policy|terms of service|about us|contact us|copyright|all rights reserved)\b", "US"),
    (r"política de privacidade|termos de serviço|sobre nós|fale conosco|direitos reservados", "BR"),
    (r"politique de confidentialité|conditions d'utilisation|à propos|nous contacter|droits réservés", "FR"),
    (r"\b(datenschutz|nutzungsbedingungen|über uns|kontakt|alle rechte vorbehalten)\b", "DE"),
    (r"隐私政策|服务条款|关于我们|联系我们|版权所有", "CN"),
    (r"プライバシーポリシー|利用規約|会社概要|お問い合わせ|著作権", "JP"),
    (r"gizlilik politikası|kullanım şartları|hakkımızda|iletişim|tüm hakları saklıdır", "TR"),
    (r"политика конфиденциальности|условия использования|о нас|контакты|все права защищены", "RU"),
]
GEO = [*GEO_PHONE, *GEO_CURRENCY, *GEO_JURISDICTION, *GEO_ADDRESS, *GEO_LANGUAGE]
# Words that mention a country, dialling codes, currency signs, and phrases before a place.
COUNTRY_TERMS = {
    "United States": ["US", "USA", "United States", "America", "Delaware", "California", "New York", "Texas", "Florida"],
    "Germany": ["Germany", "Deutschland", "German", "Berlin", "Munich", "Hamburg", "GmbH", "AG"],
    "United Kingdom": ["UK", "United Kingdom", "Britain", "British", "England", "London", "Scotland", "Wales"],
    "France": ["France", "French", "Paris", "Lyon", "Marseille", "SA", "SAS", "SARL"],
    "Japan": ["Japan", "Japanese", "Tokyo", "Osaka", "Kyoto", "Co., Ltd.", "K.K.", "Kabushiki"],
    "Canada": ["Canada", "Canadian", "Toronto", "Vancouver", "Montreal", "Inc.", "Ltd.", "Corp."],
    "Italy": ["Italy", "Italian", "Rome", "Milan", "S.p.A.", "S.r.l."],
    "Spain": ["Spain", "Spanish", "Madrid", "Barcelona", "S.A.", "S.L."],
    "Netherlands": ["Netherlands", "Dutch", "Amsterdam", "B.V.", "N.V."],
    "Australia": ["Australia", "Australian", "Sydney", "Melbourne", "Pty Ltd"],
    "Switzerland": ["Switzerland", "Swiss", "Zurich", "Geneva", "AG", "GmbH"],
    "Austria": ["Austria", "Austrian", "Vienna", "Salzburg", "GmbH", "AG"],
}
DIALLING = {"+1": "US/Canada", "+44": "UK", "+49": "Germany", "+33": "France", "+81": "Japan", "+39": "Italy", "+34": "Spain", "+31": "Netherlands", "+61": "Australia", "+41": "Switzerland", "+43": "Austria"}
SIGNS = ["$", "€", "£", "¥"]
PLACED = ["incorporated in", "registered in", "headquartered in", "based in", "located in"]
STREETS = [r"\d+\s+[a-z\s]+(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln)", r"[a-z\s]+,\s*[a-z]{2}\s+\d{5}", r"[a-z\s]+\s+\d{5}\s+[a-z\s]+"]
#: The same matches for the JVM, in steps that grow with the text: a run of letters is entered at its start only (whatever fails from there fails from within) and not given back.
STREETS_JVM = [
    r"(?<!\d)\d++\s+[a-z\s]+(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln)",
    r"(?<![a-z\s])[a-z\s]++,\s*[a-z]{2}\s+\d{5}",
    r"(?<![a-z\s])[a-z\s]++(?<=[a-z\s]\s)\d{5}\s[a-z\s]++",
]
DIALLED = r"(\+\d{1,3})\s*[\d\s\-\(\)]+"
GEO_WEIGHTS = {"countries": 25, "phones": 20, "legal": 30, "addresses": 15, "currencies": 10, "languages": 15}
#: Every country that may win the vote; of equal scores the first one wins.
VOTED = [*dict.fromkeys([*sorted(set(TLD_COUNTRY.values())), *(c for _, c in GEO), *COUNTRY_TERMS, *DIALLING.values()])]
#: A dollar amount, unless all of them are single digits before another dollar's code.
DOLLARS, OTHER_DOLLARS = r"\$[0-9,]+", r"\$[0-9,]\s*(?:aud|cad|nzd|sgd)"


def markers(text: Column) -> dict[str, Column]:
    """``hits`` (countries of all patterns found, once a pattern), ``mentions`` (countries by their words), ``dialled`` (known codes), ``placed`` (phrases that place the
    company), ``addresses`` and ``signs`` (counts); of text in lower case."""
    hits = [F.when(F.regexp_count(text, F.lit(DOLLARS)) > F.regexp_count(text, F.lit(OTHER_DOLLARS)), F.lit("US"))] + [F.when(found(text, p), F.lit(c)) for p, c in GEO]
    mentioned = lambda terms: F.greatest(*[text.contains(t.lower()) for t in terms])
    return {
        "hits": F.array_compact(F.array(*hits)),
        "mentions": F.array_compact(F.array(*[F.when(mentioned(t), F.lit(c)) for c, t in COUNTRY_TERMS.items()])),
        "dialled": F.filter(F.regexp_extract_all(text, F.lit(DIALLED), F.lit(1)), lambda x: x.isin(list(DIALLING))),
        "placed": F.concat(*[F.regexp_extract_all(text, F.lit(t + r"\s+[a-z\s,]+"), F.lit(0)) for t in PLACED]),
        "addresses": sum((F.least(F.regexp_count(text, F.lit(p)), F.lit(3)) for p in STREETS_JVM), F.lit(0)).cast("long"),
        "signs": sum((F.when(text.contains(s), 1).otherwise(0) for s in SIGNS), F.lit(0)).cast("long"),
    }


MARKERS_SQL = f"""(SELECT dump_id, domain, lang,
  list_filter([CASE WHEN len(regexp_extract_all(t, {quoted(DOLLARS)})) > len(regexp_extract_all(t, {quoted(OTHER_DOLLARS)})) THEN 'US' END, {', '.join(f"CASE WHEN {found_sql('t', p)} THEN '{c}' END" for p, c in GEO)}], lambda x: x IS NOT NULL) AS hits,
  list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'contains(t, {quoted(x.lower())})' for x in terms)} THEN '{c}' END" for c, terms in COUNTRY_TERMS.items())}], lambda x: x IS NOT NULL) AS mentions,
  list_filter(regexp_extract_all(t, {quoted(DIALLED)}, 1), lambda x: x IN ({', '.join(map(quoted, DIALLING))})) AS dialled,
  flatten([{', '.join(f"regexp_extract_all(t, {quoted(x + chr(92) + 's+[a-z' + chr(92) + 's,]+')})" for x in PLACED)}]) AS placed,
  {' + '.join(f"least(len(regexp_extract_all(t, {quoted(p)})), 3)" for p in STREETS)} AS addresses,
  {' + '.join(f"CASE WHEN contains(t, '{s}') THEN 1 ELSE 0 END" for s in SIGNS)} AS signs
  FROM (SELECT dump_id, domain, lower({TEXT_SQL}) AS t, regexp_extract(html, {quoted(HTML_LANG)}, 1) AS lang FROM {P} p) q)"""


def marked(spark: SparkSession, sf: str) -> DataFrame:
    rows = DUMPS.read(spark, sf).select("dump_id", "domain", F.lower(tagless(F.col("html"))).alias("t"), F.regexp_extract("html", HTML_LANG, 1).alias("lang"))
    return rows.select("dump_id", "domain", "lang", *[c.alias(n) for n, c in markers(F.col("t")).items()])


GEO_SQL = f"""least(100, {GEO_WEIGHTS['countries']} * len(list_distinct(list_concat(hits, mentions))) + {GEO_WEIGHTS['phones']} * (len(hits) + len(dialled)) + {GEO_WEIGHTS['legal']} * (len(hits) + len(placed))
  + {GEO_WEIGHTS['addresses']} * (len(hits) + addresses) + {GEO_WEIGHTS['currencies']} * (len(hits) + signs) + {GEO_WEIGHTS['languages']} * (len(hits) + CASE WHEN lang <> '' THEN 1 ELSE 0 END))"""


def geo_confidence() -> Column:
    """Each pattern found counts in all five classes, as in the application, beside the classes' own finds."""
    hits, w = F.size("hits"), GEO_WEIGHTS
    total = w["countries"] * F.size(F.array_distinct(F.concat("hits", "mentions"))) + w["phones"] * (hits + F.size("dialled")) + w["legal"] * (hits + F.size("placed"))
    total = total + w["addresses"] * (hits + F.col("addresses")) + w["currencies"] * (hits + F.col("signs")) + w["languages"] * (hits + F.when(F.col("lang") != "", 1).otherwise(0))
    return F.least(F.lit(100), total).cast("long")


@query("X51_geographic_markers", f"SELECT dump_id, array_to_string(list_sort(list_distinct(list_concat(hits, mentions))), ',') AS countries, len(hits) AS patterns, len(dialled) AS dialled, len(placed) AS placed, addresses, signs, lang, {GEO_SQL} AS confidence FROM {MARKERS_SQL} m")
def geographic_markers(spark: SparkSession, sf: str) -> DataFrame:
    """The patterns, country words, dialling codes, places, addresses and currency signs of each page, and the confidence they give."""
    size = lambda c: F.size(c).cast("long").alias(c)
    countries = F.array_join(F.array_sort(F.array_distinct(F.concat("hits", "mentions"))), ",")
    return marked(spark, sf).select("dump_id", countries.alias("countries"), F.size("hits").cast("long").alias("patterns"), size("dialled"), size("placed"), "addresses", "signs", "lang", geo_confidence().alias("confidence"))


def _in_code(country: str, code: str) -> int:
    """How many of a country's words a code holds: a pattern's code counts as a place too."""
    return sum(t.lower() in code.lower() for t in COUNTRY_TERMS.get(country, []))


def _how_many(array: str, test) -> Column:
    return F.size(F.filter(array, test))


def _holds(term: str):
    return lambda x: x.contains(term)


def _among(values: list[str]):
    return lambda x: x.isin(values)


def vote_keys(tld: Column, domain: Column) -> list[Column]:
    """A number for each country of VOTED: its score, then how early it stands."""
    keys = []
    for i, country in enumerate(VOTED):
        score = F.when(F.coalesce(lookup(TLD_COUNTRY, tld), F.lit("")) == country, 0 if country == "US" else 20).otherwise(0)
        if country == "United States":
            score = score + F.when(domain.endswith(".com"), 15).otherwise(0)
        score = score + F.when(F.array_contains("hits", country) | F.array_contains("mentions", country), 30).otherwise(0)
        codes = [c for c, x in DIALLING.items() if x == country]
        if codes:
            score = score + 25 * _how_many("dialled", _among(codes))
        for term in COUNTRY_TERMS.get(country, []):
            score = score + 35 * _how_many("placed", _holds(term.lower()))
        for code in dict.fromkeys(c for _, c in GEO):
            if n := _in_code(country, code):
                score = score + 35 * n * _how_many("hits", _among([code]))
        keys.append(score.cast("long") * 1000 + (999 - i))
    return keys


def _vote_sql(i: int, country: str) -> str:
    tld = case(TLD_COUNTRY, TLD_SQL)
    parts = [f"CASE WHEN coalesce({tld}, '') = {quoted(country)} THEN {0 if country == 'US' else 20} ELSE 0 END"]
    if country == "United States":
        parts.append("CASE WHEN domain LIKE '%.com' THEN 15 ELSE 0 END")
    parts.append(f"CASE WHEN list_contains(hits, {quoted(country)}) OR list_contains(mentions, {quoted(country)}) THEN 30 ELSE 0 END")
    if codes := [quoted(c) for c, x in DIALLING.items() if x == country]:
        parts.append(f"25 * len(list_filter(dialled, lambda x: x IN ({', '.join(codes)})))")
    parts += [f"35 * len(list_filter(placed, lambda x: contains(x, {quoted(t.lower())})))" for t in COUNTRY_TERMS.get(country, [])]
    parts += [f"{35 * n} * len(list_filter(hits, lambda x: x = '{code}'))" for code in dict.fromkeys(c for _, c in GEO) if (n := _in_code(country, code))]
    return f"({' + '.join(parts)}) * 1000 + {999 - i}"


@query("X52_country_vote", f"SELECT dump_id, CASE WHEN k >= 1000 THEN list_extract([{', '.join(map(quoted, VOTED))}], (1000 - k % 1000)::INT) ELSE 'Unknown' END AS country, k // 1000 AS score FROM (SELECT dump_id, greatest({', '.join(_vote_sql(i, c) for i, c in enumerate(VOTED))}) AS k FROM {MARKERS_SQL} m) v")
def country_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The country with most votes: by domain (20, or 15 for .com), detection (30), dialling codes (25 each) and places named (35 each)."""
    rows = marked(spark, sf)
    voted = rows.select("dump_id", F.greatest(*vote_keys(names.top_level(F.col("domain")), F.col("domain"))).alias("k"))
    country = F.when(F.col("k") >= 1000, F.element_at(F.array(*map(F.lit, VOTED)), (1000 - F.col("k") % 1000).cast("int"))).otherwise("Unknown")
    return voted.select("dump_id", country.alias("country"), F.floor(F.col("k") / 1000).alias("score"))


# What speaks for a country by priority, of the older detector.
VOTE_TLD = {"uk": "GB", "de": "DE", "fr": "FR", "jp": "JP", "cn": "CN", "ca": "CA", "au": "AU", "in": "IN", "br": "BR", "mx": "MX"}
VOTE_PHONE = {"+1": "US", "+44": "GB", "+49": "DE", "+33": "FR", "+81": "JP", "+86": "CN", "+91": "IN", "+55": "BR", "+52": "MX"}
VOTE_CURRENCY = {"USD": "US", "EUR": "EU", "GBP": "GB", "JPY": "JP", "CNY": "CN"}
VOTE_LANGUAGE = {"en": "US", "de": "DE", "fr": "FR", "es": "ES", "pt": "BR", "ja": "JP", "zh": "CN", "hi": "IN"}
INTERNATIONAL = r"\+[0-9][0-9 ().-]{6,}[0-9]"
CODES = r"\b(USD|EUR|GBP|JPY|CNY)\b"


def priority_vote(domain: Column, phones: Column, currency: Column, lang: Column) -> tuple[Column, Column]:
    """The country and its confidence: domain 85, first phone with a known code 75, first currency 60, language 50; nothing 0."""
    code = F.array_compact(F.transform(phones, lambda p: F.coalesce(*[F.when(p.startswith(k), v) for k, v in VOTE_PHONE.items()])))
    ladder = [(lookup(VOTE_TLD, names.top_level(domain)), 85), (F.get(code, 0), 75), (lookup(VOTE_CURRENCY, currency), 60), (lookup(VOTE_LANGUAGE, F.split(lang, "-")[0]), 50)]
    confidence = F.lit(0)
    for country, worth in reversed(ladder):
        confidence = F.when(country.isNotNull(), worth).otherwise(confidence)
    return F.coalesce(*[c for c, _ in ladder]), confidence


PRIORITY_SQL = [
    (case(VOTE_TLD, TLD_SQL), 85),
    (f"list_extract(list_filter(list_transform(phones, lambda p: CASE {' '.join(f'WHEN starts_with(p, {quoted(k)}) THEN {quoted(v)}' for k, v in VOTE_PHONE.items())} END), lambda x: x IS NOT NULL), 1)", 75),
    (case(VOTE_CURRENCY, "currency"), 60),
    (case(VOTE_LANGUAGE, "list_extract(string_split(lang, '-'), 1)"), 50),
]


@query(
    "X86_priority_vote",
    f"""SELECT dump_id, coalesce({', '.join(f'({x})' for x, _ in PRIORITY_SQL)}) AS country, CASE {' '.join(f'WHEN ({x}) IS NOT NULL THEN {n}' for x, n in PRIORITY_SQL)} ELSE 0 END AS confidence
        FROM (SELECT dump_id, domain, lang, regexp_extract_all(t, {quoted(INTERNATIONAL)}) AS phones, regexp_extract(t, {quoted(CODES)}, 1) AS currency FROM (SELECT dump_id, domain, {TEXT_SQL} AS t, regexp_extract(html, {quoted(HTML_LANG)}, 1) AS lang FROM {P} p) q) r""",
)
def vote_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = DUMPS.read(spark, sf).select("dump_id", "domain", tagless(F.col("html")).alias("t"), F.regexp_extract("html", HTML_LANG, 1).alias("lang"))
    phones, currency = F.regexp_extract_all("t", F.lit(INTERNATIONAL), F.lit(0)), F.regexp_extract("t", CODES.replace(r"\b", BORDER), 1)
    country, confidence = priority_vote(F.col("domain"), phones, currency, F.col("lang"))
    return rows.select("dump_id", country.alias("country"), confidence.cast("long").alias("confidence"))


# Categories with words of domains and names, words of content, endings of names, and weight.
CATEGORIES = {
    "Technology/Software": (["tech", "software", "digital", "cloud", "data", "ai", "cyber", "app"], ["software", "technology", "digital", "platform", "cloud", "artificial intelligence", "machine learning", "cybersecurity", "saas", "api"], [], 1.0),
    "Financial Services": (["bank", "finance", "invest", "capital", "credit", "loan", "insurance"], ["banking", "financial", "investment", "insurance", "credit", "loans", "wealth management", "portfolio", "trading", "fintech"], ["bank", "capital", "investments", "insurance", "financial"], 1.0),
    "Healthcare/Pharmaceutical": (["health", "pharma", "medical", "bio", "med", "care"], ["healthcare", "pharmaceutical", "medicine", "medical", "patient", "therapy", "drug", "clinical", "biotechnology", "diagnostics"], ["healthcare", "pharmaceuticals", "medical", "biotech"], 1.0),
    "Manufacturing/Industrial": (["manufacturing", "industrial", "auto", "steel", "chemical", "materials"], ["manufacturing", "industrial", "production", "automotive", "steel", "chemical", "materials", "engineering", "machinery", "components"], ["manufacturing", "industries", "industrial", "automotive"], 0.9),
    "Energy/Utilities": (["energy", "power", "electric", "oil", "gas", "renewable", "utility"], ["energy", "electricity", "power", "oil", "gas", "renewable", "solar", "wind", "utilities", "petroleum"], ["energy", "power", "electric", "utilities"], 1.0),
    "Retail/Consumer": (["retail", "shop", "store", "market", "consumer", "brand"], ["retail", "shopping", "consumer", "products", "brands", "merchandise", "e-commerce", "marketplace", "fashion", "lifestyle"], ["retail", "brands", "consumer", "products"], 0.8),
    "Telecommunications": (["telecom", "mobile", "network", "communications", "wireless"], ["telecommunications", "mobile", "network", "communications", "wireless", "broadband", "5g", "connectivity", "internet"], ["telecom", "communications", "mobile", "networks"], 1.0),
    "Aerospace/Defense": (["aerospace", "aviation", "defense", "aircraft", "space"], ["aerospace", "aviation", "aircraft", "defense", "space", "satellite", "military", "flight", "aviation"], ["aerospace", "aviation", "defense", "aircraft"], 1.0),
    "Food/Beverage": (["food", "beverage", "nutrition", "restaurant", "dining"], ["food", "beverage", "nutrition", "restaurant", "dining", "culinary", "ingredients", "dairy", "agriculture"], ["foods", "beverages", "nutrition", "agriculture"], 0.9),
    "Real Estate": (["real", "estate", "property", "construction", "development"], ["real estate", "property", "construction", "development", "building", "residential", "commercial", "investment"], ["properties", "development", "construction", "realty"], 0.8),
}
TECH_ENDINGS = [".io", ".tech", ".ai", ".app"]


def category_scores(domain: Column, name: Column, text: Column) -> Column:
    """``array<struct<key, category, score>>`` of the categories with any score, best first: 30 for each word in the domain, 15 in the content, 25 in the name, 20 for an ending
    of the name, 15 for a technical top level; times the category's weight. Of equal scores the first category wins."""
    one = lambda text, words, worth: sum((F.when(text.contains(w), worth).otherwise(0) for w in words), F.lit(0))
    scores = []
    for i, (category, (short, long, ends, weight)) in enumerate(CATEGORIES.items()):
        total = one(F.lower(domain), short, 30) + one(text, long, 15) + one(F.lower(F.coalesce(name, F.lit(""))), short, 25) + one(F.lower(F.coalesce(name, F.lit(""))), ends, 20)
        if i == 0:
            total = total + sum((F.when(domain.endswith(e), 15).otherwise(0) for e in TECH_ENDINGS), F.lit(0))
        scores.append(F.struct((-(total * F.lit(weight))).alias("key"), F.lit(i).alias("at"), F.lit(category).alias("category")))
    return F.array_sort(F.filter(F.array(*scores), lambda x: x["key"] < 0))


def _category_sql(i: int, category: str) -> str:
    short, long, ends, weight = CATEGORIES[category]
    one = lambda text, words, worth: [f"CASE WHEN contains({text}, {quoted(w)}) THEN {worth} ELSE 0 END" for w in words]
    parts = one("lower(domain)", short, 30) + one("t", long, 15) + one("lower(coalesce(name, ''))", short, 25) + one("lower(coalesce(name, ''))", ends, 20)
    if i == 0:
        parts += [f"CASE WHEN domain LIKE '%{e}' THEN 15 ELSE 0 END" for e in TECH_ENDINGS]
    return f"{{'key': -(({' + '.join(parts)}) * {weight}::DOUBLE), 'at': {i}, 'category': {quoted(category)}}}"


TITLE = r"(?i)<title[^>]*>([^<]*)</title>"
NAMED_SQL = f"(SELECT dump_id, domain, lower({TEXT_SQL}) AS t, nullif(trim(list_extract(regexp_split_to_array({DECODE_SQL(f"regexp_extract(html, '{TITLE}', 1)")}, '[-|–—]'), 1)), '') AS name FROM {P} p)"


@query(
    "X53_entity_category",
    f"""SELECT dump_id, CASE WHEN len(s) = 0 THEN 'General Business' ELSE s[1].category END AS category, CASE WHEN len(s) = 0 THEN 30 ELSE least(95, floor(-s[1].key + 0.5)) END::BIGINT AS confidence,
        array_to_string(list_transform(list_slice(s, 2, 3), lambda x: concat(x.category, ' ', least(95, floor(x.key / s[1].key * 100 + 0.5))::BIGINT)), '; ') AS alternatives
        FROM (SELECT dump_id, list_sort(list_filter([{', '.join(_category_sql(i, c) for i, c in enumerate(CATEGORIES))}], lambda x: x.key < 0)) AS s FROM {NAMED_SQL} n) c""",
)
def entity_category(spark: SparkSession, sf: str) -> DataFrame:
    """The industry of each page with its confidence, and the next two relative to it; the name is what the title says first."""
    title = F.nullif(F.trim(F.split(decoded(F.regexp_extract("html", TITLE, 1)), "[-|–—]")[0]), F.lit(""))
    rows = DUMPS.read(spark, sf).select("dump_id", "domain", F.lower(tagless(F.col("html"))).alias("t"), title.alias("name"))
    best = rows.select("dump_id", category_scores(F.col("domain"), F.col("name"), F.col("t")).alias("s"))
    none, first = F.size("s") == 0, F.get("s", 0)
    rounded = lambda x: F.least(F.lit(95), F.floor(x + 0.5)).cast("long")
    others = F.transform(F.slice("s", 2, 2), lambda x: F.concat_ws(" ", x["category"], rounded(x["key"] / first["key"] * 100).cast("string")))
    return best.select("dump_id", F.when(none, "General Business").otherwise(first["category"]).alias("category"), F.when(none, 30).otherwise(rounded(-first["key"])).cast("long").alias("confidence"), F.array_join(others, "; ").alias("alternatives"))
