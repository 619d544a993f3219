"""Results of Spark and DuckDB in one comparable form."""

from __future__ import annotations

import decimal
import math


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(f"{v:.9g}") if abs(v) < 1 << 53 else v
    return v


def canonical(rows, columns) -> list:
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def assert_same(df, con, sql: str) -> None:
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), names)
