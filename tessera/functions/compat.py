"""Semantics of the application's language that differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column, digits: int = 0) -> Column:
    """Halves round up, also below zero."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    """Rounded percentage; 0 where there is nothing."""
    return F.when(whole > 0, js_round(part * 100.0 / whole, digits)).otherwise(0).cast("double")


def upper_median(name: str) -> Column:
    """The element at floor(n/2) of a column's ascending values: the discrete median from above."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s ﻿]+|[\s ﻿]+$", "")


def joined_distinct(x: Column, separator: str = "; ") -> Column:
    """Distinct values in order, joined; empty without values."""
    return F.array_join(F.array_sort(F.collect_set(x)), separator)


def falsy(x: Column) -> Column:
    """Null, zero."""
    return x.isNull() | (x == 0)
