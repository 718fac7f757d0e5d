"""Comparisons in which a missing value is a value: negations hold for it, ranges do not."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_or_null(c: Column, value) -> Column:
    return c.isNull() | (c == value)


def not_equal(c: Column, value) -> Column:
    """True for null too."""
    return ~c.eqNullSafe(value)


def not_in(c: Column, values) -> Column:
    """True for null too."""
    return F.coalesce(~c.isin(*values), F.lit(True)) if values else F.lit(True)


def not_matching(c: Column, pattern: str) -> Column:
    """True for null too."""
    return F.coalesce(~c.rlike(pattern), F.lit(True))
