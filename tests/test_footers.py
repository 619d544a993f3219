"""The footer ladder on pages made by hand, and endings suggested for names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import footers

PAD = "Lorem ipsum dolor sit amet consectetur, and nothing else here. "
CASES = [
    ("acme-steel.com", f"{PAD} by Acme Steel  Corporation of Ohio", "Acme Steel Corporation", 98),
    ("acme.de", f"{PAD} run by ACME GmbH in Berlin", "ACME GmbH", 98),
    ("acme.de", f"{PAD} run by Acme, GmbH in Berlin", "Acme, GmbH", 98),
    ("acme.com", f"{PAD} run by Acme Bright Rolling Holdings today", "Acme Bright Rolling Holdings", 95),
    ("acme.com", f"{PAD} run by MegaAcme of the north Holdings today", "MegaAcme of the north Holdings", 85),
    ("acme.fr", f"{PAD} 12 Grande Forge SARL 34", "Grande Forge SARL", 75),
    ("müller.de", f"{PAD} run by Müller GmbH", "Müller GmbH", 98),
    ("a+b.de", f"{PAD} run by a+b Werk GmbH", "a+b Werk GmbH", 95),
    ("acme.com", f"{PAD} nobody", None, None),
    ("acme.com", "Acme Corporation", None, None),
]


def test_ladder(spark):
    df = spark.createDataFrame(CASES, "domain string, footer string, want string, score int")
    got = df.select("domain", "want", "score", footers.footer_ladder(F.col("domain"), F.col("footer"), F.col("footer")).alias("x")).collect()
    assert [(r["domain"], r["x"] and r["x"]["name"], r["x"] and r["x"]["confidence"]) for r in got] == [(r["domain"], r["want"], r["score"]) for r in got]


def test_endings(spark):
    df = spark.createDataFrame([("x.de",), ("x.com",), ("x.cz",), ("x.info",)], "d string")
    assert [r[0][0] for r in df.select(footers.endings_of(F.col("d"))).collect()] == ["GmbH", "Inc.", "s.r.o.", "Inc."]
    assert sum(len(v) for v in footers.ENDINGS.values()) < 200


def test_suggestions(spark):
    df = spark.createDataFrame([("Acme", "DE"), ("Acme GmbH", "DE"), ("Acme Inc.", "US"), ("Acme", "XX"), (None, "DE"), (" Acme ", "CZ")], "n string, c string")
    got = [r[0] and [x["entity"] for x in r[0]] for r in df.select(footers.suggestions(F.col("n"), F.col("c"))).collect()]
    assert got == [["Acme GmbH", "Acme UG", "Acme AG"], None, None, None, None, ["Acme s.r.o.", "Acme spol. s r.o.", "Acme společnost s ručením omezeným"]]
