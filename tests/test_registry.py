"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from tessera.plans import registry
from tests.compare import assert_same
from tests.conftest import SF

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert_same(df, duck, SQL[name])
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
    assert set(QUERIES) <= set(__spark_entry__.queries())
