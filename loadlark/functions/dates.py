"""Calendar columns: Sunday weeks, seasons and phases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASON_MONTH = 7
REPORT_SEASON_MONTH = 8
#: Phase of each calendar month.
PHASES = {
    7: "fora de época", 8: "pré-época", 9: "1ª volta", 10: "1ª volta", 11: "1ª volta", 12: "1ª volta",
    1: "2ª volta", 2: "2ª volta", 3: "2ª volta", 4: "2ª volta", 5: "2ª volta", 6: "final de época",
}
PHASE_ORDER = ("pré-época", "1ª volta", "2ª volta", "final de época", "fora de época")


def week_start(d: Column) -> Column:
    """The Sunday on or before ``d``."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def season(d: Column, first_month: int = SEASON_MONTH) -> Column:
    """``2025/26`` for a season that starts on the first of ``first_month``; sorts as text in time order."""
    y = F.year(F.add_months(d, 1 - first_month))
    return F.concat(y.cast("string"), F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def phase(d: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PHASES.items() for x in pair))
    return table[F.month(d)]


def position(c: Column, order: tuple[str, ...]) -> Column:
    """Place of a label in a fixed order; unknown ones come last."""
    out = F.lit(len(order))
    for i, x in reversed(list(enumerate(order))):
        out = F.when(c == x, i).otherwise(out)
    return out


def day_number(d: Column) -> Column:
    return F.unix_date(d)


def month_label(d: Column) -> Column:
    """``Jan 2025``."""
    return F.date_format(d, "MMM yyyy")


def day_label(d: Column) -> Column:
    """``05 Jan 2025``."""
    return F.date_format(d, "dd MMM yyyy")


def month_key(d: Column) -> Column:
    """``2025-01``; sorts as text in time order."""
    return F.date_format(d, "yyyy-MM")
