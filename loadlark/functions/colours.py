"""Colours of cells: linear between the stops of a scale, channel by channel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scales of the weekly change (by its size in percent) and of the share of Gref, and the colour of a missing value.
CHANGE = ((0.0, "#22B14C"), (5.0, "#22B14C"), (15.0, "#E9C21B"), (25.0, "#EE8A2A"), (35.0, "#D9433F"))
BANDS = ((10.0, "#22B14C"), (20.0, "#E9C21B"), (30.0, "#EE8A2A"), (None, "#D9433F"))
DEMAND = ((0.0, "#0D366B"), (25.0, "#1C5CAB"), (50.0, "#3987E5"), (75.0, "#86B6EF"), (100.0, "#CDE2FB"))
MISSING = "#1F1F1F"


def _channels(colour: str) -> tuple[int, ...]:
    return tuple(int(colour[i : i + 2], 16) for i in (1, 3, 5))


def interpolated(x: Column, stops: tuple[tuple[float, str], ...]) -> Column:
    """The colour at ``x``; before the first stop and behind the last one theirs. Channels are rounded, halves to even."""
    known = F.when(~F.isnan(x.cast("double")), x.cast("double"))
    parts = []
    for i in range(3):
        level = F.when(known <= stops[0][0], float(_channels(stops[0][1])[i]))
        for (x0, c0), (x1, c1) in zip(stops, stops[1:], strict=False):
            a, b = _channels(c0)[i], _channels(c1)[i]
            level = level.when(known <= x1, a + (b - a) * ((known - x0) / (x1 - x0)))
        parts.append(F.rint(level.when(known.isNotNull(), float(_channels(stops[-1][1])[i]))).cast("int"))
    return F.when(known.isNotNull(), F.format_string("#%02X%02X%02X", *parts)).otherwise(MISSING)


def change_colour(pct: Column) -> Column:
    """Of a change in percent, by its size."""
    return interpolated(F.abs(pct), CHANGE)


def change_band(pct: Column) -> Column:
    """The flat band of a change in percent, by its size."""
    size = F.abs(pct.cast("double"))
    out = F.when(size.isNull() | F.isnan(size), MISSING)
    for upper, colour in BANDS[:-1]:
        out = out.when(size <= upper, colour)
    return out.otherwise(BANDS[-1][1])


def demand_colour(pct: Column) -> Column:
    """Of a share of Gref in percent, from dark to light at 100."""
    return interpolated(pct, DEMAND)


def luminance(colour: Column) -> Column:
    """Relative luminance of a ``#RRGGBB`` colour."""

    def channel(at: int) -> Column:
        c = F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def readable(colour: Column, light: str = "#FFFFFF", dark: str = "#000000") -> Column:
    """The ink with more contrast on ``colour``; light if both are alike."""
    y = luminance(colour)
    return F.when(1.05 / (y + 0.05) >= (y + 0.05) / 0.05, light).otherwise(dark)
