"""Queries over whole tables give every row of them a result."""

from __future__ import annotations

import pytest

from tessera.plans import registry
from tessera.sources.logical import CANDIDATES, DOMAINS
from tests.conftest import SF

WHOLE = {
    "A8_candidates_json": (CANDIDATES, "domain_id"),
    "A20_distinct_models": (CANDIDATES, "domain_id"),
    "X48_json_repair": (DOMAINS, "id"),
    "X8_X9_stems": (DOMAINS, "id"),
    "J18_known_company": (DOMAINS, "id"),
    "P8_json_object": (DOMAINS, "id"),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole(spark, name):
    logical, key = WHOLE[name]
    want = {r[0] for r in logical.read(spark, SF).select(key).distinct().collect()}
    assert {r[0] for r in registry.queries()[name](spark, SF).select(key).distinct().collect()} == want
