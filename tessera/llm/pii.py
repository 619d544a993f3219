"""Personal data by candidate generation and gradient-boosted trees; DataFrame and SQL functions only.

Base spans follow fixed formats and always stay. Generators with high recall propose further spans, which may overlap; every candidate gets a few
discrete format and context features; runs of digits inside base matches that fail are candidates too. The counts of all feature combinations over the whole corpus (a bounded table) train boosted trees: candidates of the base
formats teach, those that pass the formats' checks as positive and those that fail as negative; addresses that lack a domain teach as failing e-mail. Neither the check nor what decides it is a feature, so that
the trees learn from the context. Thresholds for each kind are set
where the precision holds on documents that do not teach; generated candidates that pass their check, score above and overlap no base span of their kind are added.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Least precision of a score among the calibrating candidates at or above it, and the share of documents that calibrate (one in so many).
PRECISION = 0.95
CALIBRATE = 4
TREES, DEPTH = 10, 3
SPANS = "array<struct<start:int,end:int,match:string,left:string,right:string>>"


@dataclass(frozen=True)
class Format:
    """A pattern and a cheap test that any text with a match passes. Patterns are possessive where what follows cannot
    match what was taken, so they find the same spans in linear time and without recursion."""

    pattern: str
    first: str


#: Equal to the contract's patterns. A match may begin only where a run of its characters begins or where the last match ended: from
#: the middle of a run that failed nothing else can succeed.
BASE = {
    "email": Format(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": Format(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": Format(r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){16}"),
    "phone": Format(r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
#: Up to six groups on one side of the gap of a compressed IPv6 address.
SIX = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}"
#: The generators.
LOOSE = {
    "email": Format(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]++){1,8}", r"(?i)[(\[{]at[)\]}]"),
    "ip": Format(rf"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Fa-f:])|(?<![0-9A-Za-z:.])(?:{SIX})?::(?:{SIX})?(?![0-9A-Za-z:])", r"(?:[0-9A-Fa-f]{1,4}:){7}|::"),
    "card": Format(r"(?<![0-9])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{4}(?![0-9])", r"[0-9]{4}[./_][0-9]{4}[./_]"),
    "phone": Format(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|00[0-9]{1,3}[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
}
#: An at sign between nothing that makes an address: teaches as an e-mail that fails, since the base format has no check to fail.
NEAR_EMAIL = Format(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9-]*+(?!\.[A-Za-z0-9-]|@)", "@")
#: Generators inside base matches that fail: runs of so many digits that begin and end where groups of digits do. Each matches the first digit and looks at the rest.
CARD_RUNS = {n: Format(rf"(?<![0-9])(?=([0-9](?:[\x20-]?[0-9]){{{n - 1}}})(?![0-9]))[0-9]", "[0-9]") for n in range(16, 20)}
PHONE_RUNS = [rf"^\+[0-9](?:[\x20().-]*[0-9]){{{n - 1}}}(?![0-9])" for n in range(8, 16)]
#: Words that announce a kind, in the text just before.
CUES = {"email": r"(?i)mail|contact", "ip": r"(?i)\bip\b|host|addr", "card": r"(?i)card|visa|carte|karte|tarjeta", "phone": r"(?i)tel|phone|call|fax|mobil"}
CUE_CHARS = 24
#: Matches whose positions are summed at a time: growing arrays are copied, and two levels of them keep the copies short up to 100,000 matches in a text.
STRIDE = 128


def spans(text: Column, fmt: Format) -> Column:
    """All matches from the left, without overlap, with code point positions (end exclusive) and the text around them. The gaps come from
    splitting at the same pattern, so positions are running sums of lengths, by blocks of matches and within each."""
    gaps, found = F.split(text, fmt.pattern, -1), F.regexp_extract_all(text, F.lit(fmt.pattern), F.lit(0))
    empty = F.array().cast(SPANS)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), F.right(x["gap"], F.lit(CUE_CHARS)).alias("left"), F.left(x["after"], F.lit(1)).alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def walked(z: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(z) / STRIDE).cast("int") - 1, F.lit(0)))
        block = lambda b: F.slice(z, b * STRIDE + 1, F.lit(STRIDE))
        width = lambda b: F.aggregate(block(b), F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["match"]))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(blocks, begin, lambda acc, b: F.struct((acc["at"] + width(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        of_block = lambda o: lambda b: F.aggregate(block(b), F.struct(F.element_at(o, b + 1).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
        return bound(begins, lambda o: F.flatten(F.transform(blocks, of_block(o))))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), F.slice(gaps, 2, F.size(found)).alias("after"))
    return F.when(text.rlike(fmt.first), bound(zipped, walked)).otherwise(empty)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def part(x: Column, at: Column, match: Column) -> Column:
    """The span of a match that begins ``at`` characters into the span x."""
    start, end = x["start"] + at, x["start"] + at + F.length(match)
    right = F.substring(F.concat(x["match"], x["right"]), at + F.length(match) + 1, F.lit(1))
    left = F.right(F.concat(x["left"], F.left(x["match"], at)), F.lit(CUE_CHARS))
    return F.struct(start.alias("start"), end.alias("end"), match.alias("match"), left.alias("left"), right.alias("right"))


def inner_cards(x: Column) -> Column:
    """Runs of 16 to 19 digits in a base match, at the borders of its groups, that pass the check; they may overlap. A pattern matches the first digit alone and captures the run and what follows it while looking ahead;
    only runs that pass are described further."""

    def runs(n: int) -> Column:
        found = F.transform(spans(x["match"], CARD_RUNS[n]), lambda y: y["start"])
        texts = F.regexp_extract_all(x["match"], F.lit(CARD_RUNS[n].pattern), F.lit(1))
        passing = F.filter(F.arrays_zip(found.alias("at"), texts.alias("match")), lambda y: passes("card", y["match"]))
        return F.transform(passing, lambda y: part(x, y["at"], y["match"]))

    return F.concat(*[runs(n) for n in CARD_RUNS])


def inner_phones(x: Column) -> Column:
    """Beginnings of a base match of 8 to 15 digits, cut at the borders of its groups."""
    return F.filter(F.transform(F.array(*[F.regexp_extract(x["match"], p, 0) for p in PHONE_RUNS]), lambda m: part(x, F.lit(0), m)), lambda y: y["match"] != "")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def small_number(digits_only: Column) -> Column:
    """Whether a run of digits is at most 255."""
    bare = F.regexp_replace(digits_only, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def passes(kind: str, match: Column) -> Column:
    """The check of a format on one match."""
    if kind == "ip":
        groups = F.size(F.filter(F.split(match, ":"), lambda x: x != ""))
        return F.forall(F.split(match, r"[.:]"), small_number) & (F.size(F.split(match, r"\.")) == 4) | match.contains(":") & F.when(match.contains("::"), groups.between(1, 7)).otherwise(groups == 8)
    if kind == "card":
        return F.length(digits(match)).between(16, 19) & F.call_function("luhn_check", digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def side(char: Column) -> Column:
    return F.when(F.coalesce(char, F.lit("")) == "", 0).when(char.rlike("[0-9]"), 1).when(char.rlike(r"\p{L}"), 2).when(char.rlike(r"\s"), 0).otherwise(3)


#: Names of the features of a candidate; each takes few values, so the combinations are at most some 20,000 for any corpus.
FEATURES = ("kind", "digits", "parts", "before", "after", "cue", "plain")
#: Kinds whose check follows from the number of digits or parts: both are 0 there, else the trees would only learn the check.
BY_COUNT = ("email", "ip", "phone")


def features(kind: str, x: Column) -> Column:
    """Small integers, joined: the kind, its digits, its parts, its neighbours, an announcing word, and whether it repeats few digits."""
    only = digits(x["match"])
    values = (
        F.lit(KINDS.index(kind)),
        F.lit(0) if kind in BY_COUNT else F.least(F.length(only), F.lit(20)),
        F.lit(0) if kind in BY_COUNT else F.least(F.size(F.split(x["match"], "[^0-9A-Za-z]+")), F.lit(6)),
        side(F.right(x["left"], F.lit(1))),
        side(x["right"]),
        F.when(x["left"].rlike(CUES[kind]), 1).otherwise(0),
        F.when(F.regexp_replace(only, r"^([0-9]?)\1*$", "") == "", 1).otherwise(0),
    )
    return F.concat_ws(",", *[v.cast("string") for v in values])


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, base, loose``: arrays of (kind, start, end, valid, features) of the base formats, failing ones too, and of the generators. A failing phone match of more than 15 digits may hold a number, so it is none of the
    failing ones."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    raw = rows.select("doc_id", *[spans(F.col("text"), f).alias(f"{name}_{k}") for name, formats in (("base", BASE), ("loose", LOOSE), ("near", {"email": NEAR_EMAIL})) for k, f in formats.items()])

    def failing(k: str, least: int) -> Column:
        return F.filter(f"base_{k}", lambda x: (F.length(x["match"]) > least) & ~passes(k, x["match"]))

    inner = {"card": F.flatten(F.transform(failing("card", 16), inner_cards)), "phone": F.flatten(F.transform(failing("phone", 8), inner_phones))}
    raw = raw.withColumns({f"loose_{k}": F.concat(f"loose_{k}", c) for k, c in inner.items()} | {"base_phone": F.filter("base_phone", lambda x: F.length(digits(x["match"])) <= 15)})

    def one(k: str, valid: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(KINDS.index(k)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), valid(x["match"]).alias("valid"), features(k, x).alias("features"))

    def described(name: str) -> list[Column]:
        return [F.transform(f"{name}_{k}", one(k, lambda m, k=k: passes(k, m))) for k in KINDS]

    near = F.transform("near_email", one("email", lambda m: F.lit(False)))
    return raw.select("doc_id", F.concat(*described("base"), near).alias("base"), F.concat(*described("loose")).alias("loose"))


def accepted(found: DataFrame, precision: float = PRECISION) -> dict[str, float]:
    """Feature combinations of generated candidates that boosted trees and the thresholds accept, with their scores.

    The trees see one row for each combination and label with its count over the teaching documents as weight, so training reads a bounded table. For each kind the
    threshold is the lowest score at or above which the candidates of the base formats in the other documents are positive with the asked precision; all documents
    calibrate a kind that those lack. Where nothing fails a check all scores are 1; a kind without positive candidates accepts nothing."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    aside = (F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0).alias("aside")
    taught = F.transform("base", lambda x: F.struct(x["features"].alias("features"), F.when(x["valid"], 1).otherwise(0).alias("label")))
    asked = F.transform(F.filter("loose", lambda x: x["valid"]), lambda x: F.struct(x["features"].alias("features"), F.lit(-1).alias("label")))
    counts = materialize(found.select(aside, F.explode(F.concat(taught, asked)).alias("x")).groupBy("aside", "x.features", "x.label").agg(F.count("*").cast("double").alias("weight")))
    parts = F.split("features", ",")
    table = counts.select("aside", "features", "label", "weight", *[parts[i].cast("double").alias(n) for i, n in enumerate(FEATURES)])
    labels = {(r["aside"], r["label"]) for r in table.select("aside", "label").distinct().collect()}
    if not {-1, 1} <= {label for _, label in labels}:
        return {}
    if (False, 0) in labels and (False, 1) in labels:
        teaching = table.filter("label >= 0 AND NOT aside")
    else:
        teaching = table.filter("label >= 0")
    scored = table.withColumn("score", F.lit(1.0))
    if 0 in {label for _, label in labels}:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
        model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(assembler.transform(teaching).coalesce(1))
        scored = model.transform(assembler.transform(table.withColumn("label", F.col("label").cast("double")))).withColumn("score", F.round(vector_to_array("probability")[1], 9))
    scored = materialize(scored.select("aside", "features", "kind", "label", "weight", "score"))
    held = scored.filter("label >= 0").withColumn("any_aside", F.max("aside").over(Window.partitionBy("kind"))).filter("aside OR NOT any_aside")
    above = Window.partitionBy("kind").orderBy(F.desc("score"))
    right = F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0)).over(above) / F.sum("weight").over(above)
    limits = held.withColumn("right", right).filter(F.col("right") >= precision).groupBy("kind").agg(F.min("score").alias("least"))
    chosen = scored.filter("label = -1").join(limits, "kind").filter("score >= least").select("features", "score").distinct()
    return {r["features"]: r["score"] for r in chosen.collect()}


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for each row.

    Counts and ``base_sha256`` are of base spans; ``spans`` lists base and added ones as kind:start:end. A null text is empty and has none; repeated rows each get
    a row. Where the corpus has no generated candidates, or none to learn from, only base spans remain."""
    found = materialize(candidates(docs, id_col, text_col))  # the texts are searched once; a few bytes a document stay
    chosen = accepted(found, precision)
    base = F.filter("base", lambda x: x["valid"])
    clear = lambda x: ~F.exists("kept", lambda b: (b["kind"] == x["kind"]) & (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = F.filter("loose", lambda x: x["valid"] & x["features"].isin(sorted(chosen)) & clear(x)) if chosen else F.filter("loose", lambda x: F.lit(False))
    scores = F.from_json(F.lit(json.dumps(chosen)), "map<string,double>")
    # of spans that begin at one place the best score stays, then the longest; others may overlap
    rank = lambda x: F.struct(F.element_at(scores, x["features"]), x["end"])
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), rank(x).alias("rank"), x.alias("span"))
    last = lambda s: lambda x, i: (i + 1 == F.size(s)) | (F.struct(x["kind"], x["start"]) != bound(F.get(s, i + 1), lambda y: F.struct(y["kind"], y["start"])))
    best = F.transform(bound(F.array_sort(F.transform("more", place)), lambda s: F.filter(s, last(s))), lambda x: x["span"])
    rows = found.select("doc_id", base.alias("kept"), "loose").withColumn("more", more).withColumn("added", F.array_distinct(best))
    in_order = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    named = lambda c: F.array_join(F.transform(in_order(c), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("kept", lambda x: x["kind"] == i)).cast("long")
    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(named(F.col("kept")).cast("binary"), 256).alias("base_sha256"), named(F.concat("kept", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
