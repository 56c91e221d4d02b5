"""As-of and interval joins without inequality joins: bucketed equi-joins, unions and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import phase, season
from ..functions.numbers import half_even
from ..functions.text import match_quality


def nearest(left: DataFrame, right: DataFrame, by: list[str], key: str, left_date: str, right_date: str, columns: list[str], tolerance: int = 1) -> DataFrame:
    """Each left row with the nearest right row within ``tolerance`` days, the earlier one of two.

    The right side is dealt to each day it may match, the join is on the day.
    Adds ``columns``, ``days_from`` and ``match_quality``.
    """
    best = right.groupBy(*by, right_date).agg(F.min(F.struct(*columns)).alias("_c"))
    near = best.withColumn("_d", F.explode(F.sequence(F.date_sub(right_date, tolerance), F.date_add(right_date, tolerance))))
    joined = left.join(near.withColumnRenamed(right_date, "_r"), [*(left[c] == near[c] for c in by), left[left_date] == F.col("_d")], "left")
    joined = joined.select(left["*"], "_r", "_c")
    order = Window.partitionBy(key).orderBy(F.abs(F.datediff("_r", left_date)), "_r")
    chosen = joined.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    offset = F.datediff(left_date, "_r")
    return chosen.select(
        *left.columns, F.col("_r").alias(right_date), *(F.col(f"_c.{c}").alias(c) for c in columns if c != right_date),
        offset.alias("days_from"), match_quality(offset).alias("match_quality"),
    )


def backward(left: DataFrame, right: DataFrame, by: list[str], key: str, left_date: str, right_date: str, columns: list[str], stale_after: int | None = 120) -> DataFrame:
    """Each left row with the last right row on or before its date, blank if that is too old.

    Both sides are united and one window carries the last right row forward: a
    sort by entity, no join. Adds ``right_date``, ``columns`` and ``age_days``.
    """
    carried = F.struct(F.col(right_date).alias("d"), *columns)
    own = left.select(*by, F.col(left_date).alias("_t"), F.lit(1).alias("_k"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    other = right.groupBy(*by, right_date).agg(F.min(carried).alias("_r")).select(
        *by, F.col(right_date).alias("_t"), F.lit(0).alias("_k"), F.lit(None).alias("_l"), "_r"
    )
    w = Window.partitionBy(*by).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other).withColumn("_c", F.last("_r", ignorenulls=True).over(w)).filter("_k = 1")
    age = F.datediff(F.col("_t"), F.col("_c.d"))
    fresh = F.lit(True) if stale_after is None else age <= stale_after
    return both.select(
        *(F.col(f"_l.{c}").alias(c) for c in left.columns),
        *(F.when(fresh, F.col(f"_c.{c}")).alias(n) for c, n in (("d", right_date), *((c, c) for c in columns))), F.when(fresh, age).alias("age_days"),
    )


def windows_between(assessments: DataFrame, sessions: DataFrame, by: list[str], metrics: list[str], loads: list[str], date: str = "date") -> DataFrame:
    """One row for each pair of consecutive assessments, with the sessions after the first up to the second.

    ``start, end, days``, of each metric ``_start, _end`` and ``_delta``, ``sessions``, and
    of each load its sum and ``_per_week``. A session belongs to the next assessment on
    or after it, found by a window over both; the rest is an equi-join. Windows without
    sessions stay, with sums of 0; a window of no days has no rate.
    """
    w = Window.partitionBy(*by).orderBy(date)
    spans = assessments.select(
        *by, F.lag(date).over(w).alias("start"), F.col(date).alias("end"),
        *(x for m in metrics for x in (F.lag(m).over(w).alias(f"{m}_start"), F.col(m).alias(f"{m}_end"), (F.col(m) - F.lag(m).over(w)).alias(f"{m}_delta"))),
    ).filter("start is not null")
    own = sessions.select(*by, F.col(date).alias("_t"), F.lit(0).alias("_k"), *loads)
    marks = assessments.select(*by, F.col(date).alias("_t"), F.lit(1).alias("_k"), *(F.lit(None).cast("double").alias(c) for c in loads))
    # from the last row down: a frame that grows is carried on, one that shrinks would be read anew for each row
    ahead = Window.partitionBy(*by).orderBy(F.desc("_t"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    placed = own.unionByName(marks).withColumn("end", F.last(F.when(F.col("_k") == 1, F.col("_t")), ignorenulls=True).over(ahead)).filter("_k = 0 and end is not null")
    sums = placed.groupBy(*by, "end").agg(F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in loads))
    days = F.datediff("end", "start")
    joined = spans.join(sums, [*by, "end"], "left").na.fill(0, ["sessions", *loads])
    return joined.withColumns({"days": days} | {f"{c}_per_week": F.when(days > 0, F.col(c) / days * 7) for c in loads})


def window_report(windows: DataFrame, metrics: list[str], loads: list[str], distance: str = "total_distance_m", energy: str = "calories") -> DataFrame:
    """:func:`windows_between` as it is shown: the season and phase of its end, rates a week and a day, rounded values."""
    end, days = F.col("end"), F.when(F.col("days") > 0, F.col("days"))
    rates = {"sessions_per_week": half_even(F.col("sessions") / days * 7, 2)}
    if distance in loads:
        rates["km_per_week"] = half_even(F.col(distance) / 1000 / days * 7, 1)
    if energy in loads:
        rates["football_kcal_per_day"] = half_even(F.col(energy) / days)
    kept = [c for c in windows.columns if not c.endswith("_per_week")]
    rounded = {c: half_even(F.col(c), 1) for c in loads} | {f"{m}_delta": half_even(F.col(f"{m}_delta"), 2) for m in metrics}
    return windows.select(*kept, season(end).alias("season"), phase(end).alias("phase")).withColumns(rates).withColumns(rounded)


def lookback_mean(assessments: DataFrame, sessions: DataFrame, by: list[str], loads: list[str], days: int = 28, date: str = "date") -> DataFrame:
    """Each assessment with the means of the sessions of the ``days`` before it, its own day included.

    Windows may overlap. A session's sums by day are merged first, then each
    assessment meets its days by equality; cost grows with assessments times days.
    """
    daily = sessions.groupBy(*by, F.col(date).alias("_d")).agg(
        F.count("*").alias("_n"), *(x for c in loads for x in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}")))
    )
    want = assessments.select(*by, date).distinct().withColumn("_d", F.explode(F.sequence(F.date_sub(date, days - 1), F.col(date))))
    found = want.join(daily, [*by, "_d"], "left").groupBy(*by, date).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("sessions_in_window"),
        *(F.when(F.sum(f"_n_{c}") > 0, F.sum(f"_s_{c}") / F.sum(f"_n_{c}")).alias(f"{c}_mean") for c in loads),
    )
    return assessments.join(found, [*by, date], "left")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, change``: rows that only the new (added) or only the old side (removed) has, each key once."""
    side = lambda df, name: df.select(*keys, F.lit(1).alias(name))
    both = side(old, "_old").unionByName(side(new, "_new"), allowMissingColumns=True).groupBy(*keys).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return both.filter("_old is null or _new is null").select(*keys, F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change"))

