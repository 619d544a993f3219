"""Linked data: depth, arrays, several kinds, malformed documents."""

from __future__ import annotations

import json

from tessera.operators import structured

ORG = {"@type": "Organization", "name": "Deep"}
DOCS = [
    (1, json.dumps({"a": [[[{"b": {"c": [1, {"d": [ORG]}]}}]]]})),
    (2, json.dumps([{"@type": ["Thing", "Brand", "LocalBusiness"], "name": "Shop"}, {"@type": "Person", "name": "Ann"}, {"@type": "Brand"}, {"@type": "Brand", "name": 5}])),
    (3, '{"@type": "Organization", "name": "cut off'),
    (4, None),
    (5, '"Organization"'),
    (6, json.dumps(ORG | {"brand": {"@type": "Brand", "name": "B"}, "@graph": [ORG]})),
]


def test_names_anywhere(spark):
    df = spark.createDataFrame(DOCS, "id long, doc string")
    got = sorted((r["id"], r["path"], r["kind"], r["name"], r["confidence"]) for r in structured.named_holders(df, "id", "doc").collect())
    want = [
        (1, "$.a[0][0][0].b.c[1].d[0]", "Organization", "Deep", 0.95),
        (2, "$[0]", "LocalBusiness", "Shop", 0.9),
        (2, "$[3]", "Brand", "5", 0.85),
        (6, "$", "Organization", "Deep", 0.95),
        (6, "$.@graph[0]", "Organization", "Deep", 0.95),
        (6, "$.brand", "Brand", "B", 0.85),
    ]
    assert got == want


def test_no_documents(spark):
    df = spark.createDataFrame([], "id long, doc string")
    assert structured.named_holders(df, "id", "doc").collect() == []
