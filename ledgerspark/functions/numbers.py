"""Numeric column helpers: safe ratios, growth and presentation rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return _col(c).cast("double")


def ratio(top, bottom, digits: int | None = None) -> Column:
    """top / bottom in double; null when the divisor is zero or null (ANSI division would raise)."""
    value = F.try_divide(as_double(top), as_double(bottom))
    return F.round(value, digits) if digits is not None else value


def percent(top, bottom, digits: int = 2) -> Column:
    return F.round(F.try_divide(as_double(top) * 100, as_double(bottom)), digits)


def growth(now, before, digits: int = 2) -> Column:
    """Change in percent of the absolute earlier value."""
    change = as_double(_col(now) - _col(before))
    return F.round(F.try_divide(change, as_double(F.abs(_col(before)))) * 100, digits)


def flag(condition: Column) -> Column:
    """Boolean as 0/1 with unknown counted as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def bands(value: Column, steps: list[tuple[float, str]], otherwise: str, strict: bool = True) -> Column:
    """First label whose limit lies below the value; ``strict`` compares with >, otherwise with >=."""
    out = None
    for limit, label in steps:
        test = value > limit if strict else value >= limit
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def two_decimals(c) -> Column:
    """Fixed two-decimal text without thousands separators."""
    return _col(c).cast("decimal(38,2)").cast("string")


def cents(value) -> Column:
    """Amount rounded half up to two decimals; the six-decimal step removes binary noise before a tie is settled."""
    return F.round(_col(value).cast("decimal(28,6)"), 2).cast("double")
