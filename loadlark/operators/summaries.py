"""Grouped views of sessions: months, weeks, types, results, best and rolling values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import CATEGORIES, SHORT_MINUTES
from ..functions.dates import week_start
from ..functions.numbers import half_even, positive

# Weight of each metric in the monthly quality, and of its two parts.
QUALITY_WEIGHTS = {
    "total_distance_m": 0.25, "sprint_distance_m": 0.20, "high_speed_distance_m": 0.15, "top_speed_kmh": 0.15,
    "distance_per_min": 0.15, "accelerations": 0.05, "decelerations": 0.05,
}
PARTS = {"game": 0.6, "training": 0.4}
MONTHLY = ("duration_min", "total_distance_m", "sprint_distance_m", "high_speed_distance_m", "top_speed_kmh", "accelerations", "decelerations")


def month(d: Column) -> Column:
    return F.trunc(d, "MM")


def monthly_summary(sessions: DataFrame, entity: list[str], metrics: tuple[str, ...] = MONTHLY) -> DataFrame:
    """Mean, sum and most of each metric by calendar month, and the sessions with a duration."""
    stats = [
        c for m in metrics
        for c in (half_even(F.avg(m), 2).alias(f"{m}_mean"), F.sum(m).alias(f"{m}_sum"), F.max(m).alias(f"{m}_max"))
    ]
    return sessions.groupBy(*entity, month(F.col("date")).alias("month")).agg(F.count("duration_min").alias("duration_min_count"), *stats)


def by_type(sessions: DataFrame, entity: list[str], category: str, metrics: tuple[str, ...]) -> DataFrame:
    """Counts and means by session type (training) or competition (games)."""
    key = "session_type" if category == "training" else "competition_type"
    return sessions.filter((F.col("match_category") == category) & F.col(key).isNotNull()).groupBy(*entity, F.col(key).alias("type")).agg(
        F.count("*").alias("sessions"), *(half_even(F.avg(m), 2).alias(f"{m}_mean") for m in metrics)
    )


def weekly_pivot(sessions: DataFrame, entity: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """Sum of each metric by Sunday week and category, and over all; weeks without sessions aren't made up."""
    part = lambda m, c: F.coalesce(F.sum(F.when(F.col("match_category") == c, F.col(m))), F.lit(0.0))
    return sessions.groupBy(*entity, week_start(F.col("date")).alias("week_start")).agg(
        *(part(m, c).alias(f"{m}_{c}") for m in metrics for c in CATEGORIES),
        *(F.coalesce(F.sum(m), F.lit(0.0)).alias(f"{m}_total") for m in metrics),
    )


def starter_or_substitute(sessions: DataFrame, entity: list[str], metrics: tuple[str, ...]) -> DataFrame:
    games = sessions.filter((F.col("session_kind") == "game") & F.col("was_starter").isNotNull() & (F.col("duration_min") > 0))
    return games.groupBy(*entity, F.when(F.col("was_starter"), "Starter").otherwise("Substitute").alias("role")).agg(
        F.count("*").alias("games"), *(half_even(F.avg(m), 2).alias(f"{m}_mean") for m in metrics)
    )


def average_minutes(sessions: DataFrame, entity: list[str]) -> DataFrame:
    return sessions.groupBy(*entity, "match_category").agg(F.avg(positive(F.col("duration_min"))).alias("mean_minutes"))


def against_baseline(per90: DataFrame, baseline: DataFrame, entity: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """Mean per-90 values (top speed: the most) against ``baseline(metric, baseline)``, of games of 20 minutes or more."""
    games = per90.filter(F.col("official_minutes") >= SHORT_MINUTES)
    wide = games.groupBy(*entity).agg(
        *(F.avg(f"{m}_per90").alias(m) for m in metrics), F.max("top_speed_kmh").alias("top_speed_kmh")
    )
    long = wide.unpivot(entity, [*metrics, "top_speed_kmh"], "metric", "value")
    return long.join(baseline, "metric").select(
        *entity, "metric", half_even(F.col("value"), 2).alias("value"), "baseline",
        half_even(F.col("value") - F.col("baseline"), 2).alias("difference"),
        half_even((F.col("value") - F.col("baseline")) / F.col("baseline") * 100, 1).alias("difference_pct"),
    )


def monthly_quality(sessions: DataFrame, entity: list[str], weights: dict[str, float] = QUALITY_WEIGHTS) -> DataFrame:
    """``entity, month, game, training, combined``: weighted share of each month's means in their best month, in percent.

    A kind's quality counts the metrics it has; the combination weights games
    and training 60 to 40 and takes the one there is where the other is missing.
    """
    means = sessions.withColumn("part", F.when(F.col("session_kind") == "training", "training").otherwise("game")).groupBy(
        *entity, "part", month(F.col("date")).alias("month")
    ).agg(*(F.avg(m).alias(m) for m in weights))
    long = means.unpivot([*entity, "part", "month"], list(weights), "metric", "v").filter("v is not null")
    top = F.max("v").over(Window.partitionBy(*entity, "part", "metric"))
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("metric")]
    scored = long.withColumns({"_s": F.when(top > 0, F.col("v") / top), "_w": weight}).filter("_s is not null")
    parts = scored.groupBy(*entity, "month").pivot("part", list(PARTS)).agg(F.sum(F.col("_s") * F.col("_w")) / F.sum("_w") * 100)
    weighted = sum((F.coalesce(F.col(p) * w, F.lit(0.0)) for p, w in PARTS.items()), F.lit(0.0))
    used = sum((F.when(F.col(p).isNotNull(), w).otherwise(0.0) for p, w in PARTS.items()), F.lit(0.0))
    return parts.select(
        *entity, "month", *(half_even(F.col(p), 1).alias(p) for p in PARTS), half_even(weighted / used, 1).alias("combined")
    )


def season_summary(sessions: DataFrame, entity: list[str]) -> DataFrame:
    """Counts by category, kilometres, peak speed and mean quality within each season."""
    quality = monthly_quality(sessions, [*entity, "season"]).groupBy(*entity, "season").agg(half_even(F.avg(F.rint(F.col("combined") * 10)) / 10, 1).alias("mean_quality"))
    counts = sessions.groupBy(*entity, "season").agg(
        *(F.count_if(F.col("match_category") == c).alias(c) for c in CATEGORIES),
        half_even(F.coalesce(F.sum("total_distance_m"), F.lit(0.0)) / 1000, 1).alias("km"),
        F.max("top_speed_kmh").alias("peak_speed"),
    )
    return counts.join(quality, [*entity, "season"], "left")


def retention_summary(retention: DataFrame, entity: list[str]) -> DataFrame:
    return retention.groupBy(*entity, "match_category").agg(
        F.count("*").alias("n"), half_even(F.median("retention"), 2).alias("median"), F.min("retention").alias("least"), F.max("retention").alias("most")
    )


def high_speed_exposure(sessions: DataFrame, entity: list[str], share: float = 0.9) -> DataFrame:
    """Sessions near the entity's best speed, by month."""
    best = F.max("top_speed_kmh").over(Window.partitionBy(*entity))
    fast = sessions.filter("top_speed_kmh is not null").withColumn("_near", F.col("top_speed_kmh") >= best * share)
    return fast.groupBy(*entity, month(F.col("date")).alias("month")).agg(
        F.count("*").alias("sessions"), F.count_if("_near").alias("near_max"),
        half_even(F.count_if("_near") / F.count("*") * 100, 1).alias("near_max_pct"), F.max("top_speed_kmh").alias("best"),
    )


def intensity_gap(sessions: DataFrame, entity: list[str]) -> DataFrame:
    """Training intensity in percent of match intensity, of months that have both."""
    v = F.when(F.col("total_distance_m") > 0, F.col("high_speed_distance_m") / F.col("total_distance_m"))
    train, game = F.when(F.col("session_kind") == "training", v), F.when(F.col("match_category") == "official_match", v)
    both = sessions.groupBy(*entity, month(F.col("date")).alias("month")).agg(
        F.avg(train).alias("t"), F.avg(game).alias("g"), F.count(train).alias("n_training"), F.count(game).alias("n_match")
    )
    return both.filter("n_training > 0 and n_match > 0 and g > 0").select(
        *entity, "month", "n_training", "n_match", half_even(F.col("t") / F.col("g") * 100, 1).alias("gap_pct")
    )


def output_by(sessions: DataFrame, entity: list[str], key: str, metrics: tuple[str, ...], floor: float = SHORT_MINUTES) -> DataFrame:
    """Mean minutes and per-90 output by a column such as the result or the venue; short appearances are left out."""
    kept = sessions.filter((F.col("official_minutes") >= floor) & F.col(key).isNotNull())
    return kept.groupBy(*entity, key).agg(
        F.count("*").alias("n"), half_even(F.avg("official_minutes"), 1).alias("mean_minutes"),
        *(half_even(F.avg(f"{m}_per90"), 1).alias(f"{m}_per90_mean") for m in metrics),
    )


def robust_top_speed(sessions: DataFrame, entity: list[str], window: int = 10, share: float = 0.95, key: str = "session_id", places: int = 2) -> DataFrame:
    """Rolling percentile of the top speed; sessions without one keep their place in the window."""
    w = Window.partitionBy(*entity).orderBy("date", key).rowsBetween(1 - window, 0)
    return sessions.withColumn("robust_top_speed", half_even(F.percentile("top_speed_kmh", share).over(w), places))


def rolling_mean(sessions: DataFrame, entity: list[str], metric: str, n: int = 5, key: str = "session_id") -> DataFrame:
    w = Window.partitionBy(*entity).orderBy("date", key).rowsBetween(1 - n, 0)
    return sessions.filter(F.col(metric).isNotNull()).withColumn("rolling", F.avg(metric).over(w))


def best_and_worst(sessions: DataFrame, entity: list[str], metric: str, n: int = 5, key: str = "session_id") -> DataFrame:
    """The ``n`` most and least positive values of each entity."""
    rows = sessions.filter(F.col(metric) > 0)
    rank = lambda o: F.row_number().over(Window.partitionBy(*entity).orderBy(o, key))
    both = rows.withColumns({"best_rank": rank(F.desc(metric)), "worst_rank": rank(F.asc(metric))})
    return both.filter((F.col("best_rank") <= n) | (F.col("worst_rank") <= n))


def percentile_rank(sessions: DataFrame, entity: list[str], metric: str) -> DataFrame:
    """Share of the entity's other values that lie below each one, in percent."""
    rows = sessions.filter(F.col(metric).isNotNull())
    own = Window.partitionBy(*entity)
    return rows.withColumn("pct_rank", (F.rank().over(own.orderBy(metric)) - 1) / F.count("*").over(own) * 100)


def radar(sessions: DataFrame, entity: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """Mean of each metric by category as a share of the highest category's."""
    means = sessions.groupBy(*entity, "match_category").agg(*(F.avg(m).alias(m) for m in metrics))
    long = means.unpivot([*entity, "match_category"], list(metrics), "metric", "mean")
    top = F.max("mean").over(Window.partitionBy(*entity, "metric"))
    return long.withColumn("share", F.when(top > 0, F.col("mean") / top))


def heat(weekly: DataFrame, entity: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Each column by its highest value; a column of zeros stays 0."""
    top = lambda c: F.max(c).over(Window.partitionBy(*entity))
    return weekly.withColumns({c: F.when(top(c) > 0, F.col(c) / top(c)).otherwise(0.0) for c in columns})


def kpis(sessions: DataFrame, entity: list[str], metrics: tuple[str, ...], key: str = "session_id") -> DataFrame:
    """Mean of each metric, best speed and the day it was reached, of recorded sessions."""
    return sessions.filter("has_gps").groupBy(*entity).agg(
        F.count("*").alias("n"), *(half_even(F.avg(m), 2).alias(m) for m in metrics), F.max("top_speed_kmh").alias("top_speed_kmh"),
        F.max(F.when(F.col("top_speed_kmh").isNotNull(), F.struct("top_speed_kmh", "date", key)))["date"].alias("top_speed_date"),
    )


def load_kpis(weekly: DataFrame, entity: list[str]) -> DataFrame:
    """Latest complete week, latest rated week, weeks outside the band (its ends are inside) and spikes."""
    rated = F.col("acwr").isNotNull()
    return weekly.groupBy(*entity).agg(
        F.max_by("total", F.when(~F.col("partial"), F.col("week_start"))).alias("latest_total"),
        F.max_by("acwr", F.when(rated, F.col("week_start"))).alias("latest_acwr"),
        F.count_if(rated & ~F.col("acwr").between(0.8, 1.5)).alias("outside_band"),
        F.count_if("spike").alias("spikes"),
    )
