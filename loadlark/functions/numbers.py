"""Null-aware arithmetic. Missing is null, never NaN; a comparison with missing is false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, places: int = 0) -> Column:
    """Rounded on the scaled double, halves to even."""
    scale = float(10**places)
    return F.rint(x * scale) / scale if places else F.rint(x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null if ``b`` is missing or not positive."""
    return F.when(b > 0, a / b)


def share(a: Column, b: Column) -> Column:
    """``a`` in percent of ``b``; null if ``b`` is missing or not positive."""
    return F.when(b > 0, a / b * 100)


def pct_change(current: Column, base: Column, places: int = 1) -> Column:
    """Change in percent of ``base``; null if either is missing or ``base`` is 0."""
    return half_even(F.when(base != 0, (current - base) / base * 100), places)


def holds(condition: Column) -> Column:
    """A condition in which missing counts as false."""
    return F.coalesce(condition, F.lit(False))


def nothing(c: Column) -> Column:
    """Zero or missing."""
    return F.coalesce(c, F.lit(0.0)) == 0


def sum_known(*cols: Column) -> Column:
    """The sum with missing as 0; null only if all are missing."""
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cols))
    return F.when(F.coalesce(*cols).isNotNull(), total)


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def numeric(c: Column) -> Column:
    """A typed number; what can't be read, and NaN, is missing."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def spread_pct(c: str) -> Column:
    """Population coefficient of variation in percent, as an aggregate."""
    return F.when(F.avg(c) != 0, F.stddev_pop(c) / F.avg(c) * 100)
