"""All registered queries of the entity-resolution operators, and their SQL."""

from __future__ import annotations

from tessera.operators import addresses, analytics, answers, changes, claims, crawl, details, entities, evidence, exports, extraction, footers, graph, judgements, knowledge, ladders, lookups, metadata, records, relational, scoring, sections, similar, sources, structured, texts  # noqa: F401  they register themselves
from tessera.plans.register import QUERIES, SQL, Query
from tessera.streaming import events, stalls  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
