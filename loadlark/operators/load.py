"""Daily and weekly load. Every window is partitioned by the entity and covers a dense calendar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import CATEGORIES, acwr_zone
from ..functions.dates import week_start
from ..functions.numbers import half_even, pct_change


def _spine(days: DataFrame, entity: list[str], name: str, first: Column, last: Column, step: str) -> DataFrame:
    """Each entity's calendar from its first to its last date."""
    ends = days.groupBy(*entity).agg(first.alias("_a"), last.alias("_z"))
    return ends.select(*entity, F.explode(F.expr(f"sequence(_a, _z, interval {step} day)")).alias(name))


def daily_load(sessions: DataFrame, entity: list[str], value: str = "total_distance_m", date: str = "date") -> DataFrame:
    """``entity, date, load`` on every day from the first to the last session; days without one are 0."""
    own = sessions.filter(F.col(date).isNotNull()).groupBy(*entity, F.col(date).alias("date")).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("load")
    )
    spine = _spine(own, entity, "date", F.min("date"), F.max("date"), "1")
    return spine.join(own, [*entity, "date"], "left").select(*entity, "date", F.coalesce("load", F.lit(0.0)).alias("load"))


def daily_acwr(daily: DataFrame, entity: list[str], acute: int = 7, chronic: int = 28) -> DataFrame:
    """Acute sum by the mean of the days before it, as a load of the same length; null until both are full."""
    w = Window.partitionBy(*entity).orderBy("date")
    near, far = w.rowsBetween(1 - acute, 0), w.rowsBetween(1 - acute - chronic, -acute)
    full = lambda frame, n: F.count("load").over(frame) == n
    return daily.withColumns(
        {
            "acute": F.when(full(near, acute), F.sum("load").over(near)),
            "chronic": F.when(full(far, chronic), F.sum("load").over(far) / chronic * acute),
        }
    ).withColumn("acwr", half_even(F.when(F.col("chronic") != 0, F.col("acute") / F.col("chronic")), 2))


def weekly_load(sessions: DataFrame, entity: list[str], value: str = "total_distance_m") -> DataFrame:
    """One row for each Sunday-to-Saturday week, empty ones included.

    Columns: ``week_start, week_end, total``, one total for each category,
    ``sessions, missing_sessions, incomplete, partial, wow_pct, spike``. Totals
    count recorded sessions; a week that ends after the last session is partial
    and isn't compared.
    """
    dated = sessions.filter(F.col("date").isNotNull()).withColumn("week_start", week_start(F.col("date")))
    v = F.when(F.col("has_gps"), F.col(value))
    own = dated.groupBy(*entity, "week_start").agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total"),
        *(F.coalesce(F.sum(F.when(F.col("match_category") == c, v)), F.lit(0.0)).alias(c) for c in CATEGORIES),
        F.count("*").alias("sessions"),
        F.count_if(~F.col("has_gps") & ~F.col("unused_sub")).alias("missing_sessions"),
        F.max("date").alias("_last"),
    )
    ends = own.groupBy(*entity).agg(F.min("week_start").alias("_a"), F.max("week_start").alias("_z"), F.max("_last").alias("_last_day"))
    spine = ends.select(*entity, "_last_day", F.explode(F.expr("sequence(_a, _z, interval 7 day)")).alias("week_start"))
    w = Window.partitionBy(*entity).orderBy("week_start")
    previous = F.lag("total").over(w)
    return (
        spine.join(own.drop("_last"), [*entity, "week_start"], "left")
        .na.fill(0, ["total", *CATEGORIES, "sessions", "missing_sessions"])
        .withColumn("week_end", F.date_add("week_start", 6))
        .withColumn("incomplete", F.col("missing_sessions") > 0)
        .withColumn("partial", F.col("week_end") > F.col("_last_day"))
        .withColumn("wow_pct", F.when(~F.col("partial"), pct_change(F.col("total"), previous)))
        .withColumn("spike", F.coalesce(F.col("wow_pct") > 10, F.lit(False)))
        .drop("_last_day")
    )


def weekly_acwr(weekly: DataFrame, entity: list[str], chronic: int = 4, history: int = 4) -> DataFrame:
    """Week's total by the mean of the ``chronic`` weeks before it, with its zone."""
    w = Window.partitionBy(*entity).orderBy("week_start")
    before = w.rowsBetween(-chronic, -1)
    mean = F.when(F.count("total").over(before) == chronic, F.sum("total").over(before) / chronic)
    return _rated(weekly, w, mean, F.when(mean != 0, F.col("total") / mean), history)


def _rated(weekly: DataFrame, w, chronic: Column, value: Column, history: int) -> DataFrame:
    rated = (F.row_number().over(w) > history) & ~F.col("partial")
    return weekly.withColumns(
        {"chronic": half_even(chronic, 1), "acwr": half_even(F.when(rated, value), 2)}
    ).withColumn("acwr_zone", F.when(F.col("partial"), "Partial week").otherwise(acwr_zone(F.col("acwr"))))


#: Days of a block; its weights stay far from the ends of what a double can hold.
BLOCK_DAYS = 128


def ewma(daily: DataFrame, entity: list[str], spans: dict[str, int]) -> DataFrame:
    """Exponential means of the daily load, one column for each span; the first day starts them.

    The recurrence is a weighted sum of all days before. In blocks of days it is a
    running sum, each day's weight taken relative to its block's start; what comes before
    a block is the sum of the ends of earlier blocks, whose weights fall so fast that
    those beyond 1e-20 are left out, a fixed number of lags. ``daily`` has a row for each
    day; no entity's days are held at once.
    """
    order = Window.partitionBy(*entity).orderBy("date")
    days = daily.select(*entity, "date", "load").withColumn("_number", F.row_number().over(order) - 1)
    days = days.withColumns({"_block": F.floor(F.col("_number") / BLOCK_DAYS), "_place": (F.col("_number") % BLOCK_DAYS).cast("double")})
    within = Window.partitionBy(*entity, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    keep = {name: 1 - 2.0 / (span + 1) for name, span in spans.items()}
    share = lambda k: F.when(F.col("_number") == 0, 1.0).otherwise(1 - k)  # noqa: E731  the first day has all of its own weight
    own = days.withColumns({f"_own_{n}": F.sum(F.col("load") * share(k) * F.pow(F.lit(k), -F.col("_place"))).over(within) * F.pow(F.lit(k), F.col("_place")) for n, k in keep.items()})
    ends = own.filter(F.col("_place") == BLOCK_DAYS - 1)
    blocks = Window.partitionBy(*entity).orderBy("_block")
    carried = {}
    for n, k in keep.items():
        fade = k**BLOCK_DAYS
        lags = max(1, math.ceil(math.log(1e-20) / math.log(fade)))
        carried[f"_carried_{n}"] = sum((F.coalesce(F.lag(f"_own_{n}", i).over(blocks), F.lit(0.0)) * fade**i for i in range(1, lags + 1)), F.col(f"_own_{n}"))
    before = ends.select(*entity, (F.col("_block") + 1).alias("_block"), *(c.alias(n) for n, c in carried.items()))
    return own.join(before, [*entity, "_block"], "left").select(
        *entity, "date", "load",
        *((F.col(f"_own_{n}") + F.coalesce(F.col(f"_carried_{n}"), F.lit(0.0)) * F.pow(F.lit(k), F.col("_place") + 1)).alias(n) for n, k in keep.items()),
    )


def weekly_acwr_ewma(sessions: DataFrame, entity: list[str], value: str = "total_distance_m", history: int = 4) -> DataFrame:
    """As :func:`weekly_acwr` from exponential means of 7 and 28 days, read on each week's last day."""
    weekly = weekly_load(sessions, entity, value)
    own = sessions.filter(F.col("date").isNotNull()).groupBy(*entity, "date").agg(
        F.coalesce(F.sum(F.when(F.col("has_gps"), F.col(value))), F.lit(0.0)).alias("load")
    )
    spine = _spine(own, entity, "date", F.min("date"), F.date_add(week_start(F.max("date")), 6), "1")
    daily = spine.join(own, [*entity, "date"], "left").na.fill(0.0, ["load"])
    means = ewma(daily, entity, {"e7": 7, "e28": 28}).select(*entity, F.col("date").alias("week_end"), "e7", "e28")
    both = weekly.join(means, [*entity, "week_end"], "left")
    w = Window.partitionBy(*entity).orderBy("week_start")
    ratio = F.when(F.col("e28") != 0, F.col("e7") / F.col("e28"))
    return _rated(both, w, F.col("e28") * 7, ratio, history).drop("e7", "e28")


def monotony_and_strain(daily: DataFrame, entity: list[str]) -> DataFrame:
    """Mean by sample deviation of a week's days, and total times that; edge weeks have the days they have."""
    sd = F.stddev_samp("load")
    return (
        daily.groupBy(*entity, week_start(F.col("date")).alias("week_start"))
        .agg(F.sum("load").alias("total"), half_even(F.when(sd > 0, F.avg("load") / sd), 2).alias("monotony"))
        .withColumn("strain", half_even(F.col("total") * F.col("monotony"), 1))
    )
