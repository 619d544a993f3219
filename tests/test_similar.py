"""Joins of similar names and of address ranges against brute force."""

from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from tessera.operators import addresses, similar


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_infix_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abAB é%_") for _ in range(n))
    names = [word(rng.randint(0, 12)) for _ in range(300)] + ["Acme Steel Group", "ACME", None, "100%"]
    needles = [word(rng.randint(0, 5)) for _ in range(120)] + ["acme", "steel g", "%", "_", None, "", "nothing here"]
    one = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    want = {(t, n) for t in set(needles) if t for n in set(names) if n is not None and t.lower() in n.lower()}
    for most in (7, 100_000):
        got = [(r["needle"], r["name"]) for r in similar.infix_matches(one("needle", needles), one("name", names), most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert similar.infix_matches(one("needle", []), one("name", names)).count() == 0


def test_close_names_brute_force(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["kitten", "sitting", "smitten", "aaaaaaaa", "aaaaaaaaaa", None]
    names += [f"Company {i:03d} GmbH" for i in range(60)]
    df = spark.createDataFrame([(x,) for x in names], "name string")
    known = sorted({x for x in names if x is not None})
    for k, q, most in ((1, 2, 100_000), (2, 2, 5), (2, 3, 100_000)):
        want = {(a, b, _distance(a, b)) for i, a in enumerate(known) for b in known[i + 1 :] if _distance(a, b) <= k}
        got = [(r["name"], r["other"], r["distance"]) for r in similar.close_names(df, k, q, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_close_names_verified_where_they_meet(spark):
    """No aggregate takes in the pairs that share a key before they are verified, and a small input is not packed into one task."""
    df = spark.createDataFrame([(f"Company {i:03d}",) for i in range(50)], "name string")
    plan = similar.close_names(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan[plan.index("Join") :].split("\n")[0] and "Aggregate" not in plan[: plan.index("Join")]
    assert "RepartitionByExpression [token" in plan and f", {spark.conf.get('spark.sql.shuffle.partitions')}" in plan


def test_longest_range(spark):
    rng = random.Random(6)
    table = [(0, 0, "all")] + [((rng.getrandbits(32) >> (32 - n)) << (32 - n), n, f"r{n}") for n in range(4, 25) for _ in range(3)]
    table += [(10 << 24, 8, "ten"), ((10 << 24) + (1 << 16), 16, "ten one")]
    values = [rng.getrandbits(32) for _ in range(400)] + [t[0] for t in table] + [(10 << 24) + 70_000, None, None]
    got = addresses.longest_range(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value long"), spark.createDataFrame(table, "first long, bits int, kind string")).collect()
    assert len(got) == len(values)
    for r in got:
        holding = [t for t in table if r["value"] is not None and r["value"] >> (32 - t[1]) == t[0] >> (32 - t[1])]
        assert (r["kind"] is None and not holding) or r["bits"] == max(t[1] for t in holding)


def test_ranges_are_prefixes():
    for first, bits, _ in addresses.ranges():
        ipaddress.ip_network((first, bits))


def test_protection(spark):
    rows = [
        ({"cf-ray": "1"}, "", "1.2.3.4", "header"),
        ({"cf-ray": ""}, "", "1.2.3.4", None),
        ({"server": "Cloudflare-nginx"}, None, None, "server"),
        ({}, "Please wait. Just a moment...", None, "challenge"),
        (None, None, "104.16.9.9", "address"),
        (None, None, "104.160.9.9", None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "headers map<string,string>, body string, ip string, want string")
    got = df.select("want", addresses.protection(F.col("headers"), F.col("body"), F.col("ip")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
