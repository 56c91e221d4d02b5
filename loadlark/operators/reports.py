"""What reports choose and show: nested scopes, key figures against references, latest sessions against history."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from . import load, sessions as S
from .body import evolution

NEAR_BEST = 0.9
# The metrics at the top of a body report, in their order.
HEADLINE = ("Peso", "Massa Gorda", "Massa Isenta de Gordura", "Massa Muscular", "Massa Isenta de Gordura / Peso", "Soma de Pregas", "Perímetro Coxa corrigido", "Coxa corrigida / peso")


@dataclass(frozen=True)
class Scope:
    """A season, days of it, and kinds of sessions; each view narrows the one before. Whole-load views use ``in_range``."""

    season: str
    start: date
    end: date
    categories: tuple[str, ...]

    def season_sessions(self, df: DataFrame) -> DataFrame:
        return S.scoped(df, season=self.season)

    def in_range(self, df: DataFrame) -> DataFrame:
        return S.scoped(df, season=self.season, start=self.start, end=self.end)

    def filtered(self, df: DataFrame) -> DataFrame:
        return S.scoped(df, season=self.season, start=self.start, end=self.end, categories=list(self.categories))

    def counts(self, df: DataFrame, entity: list[str]) -> DataFrame:
        """Sessions of each view, and recorded ones of the narrowest, in one pass over the season."""
        days = F.col("date").between(F.lit(self.start), F.lit(self.end))
        kind = days & F.col("match_category").isin(*self.categories)
        return self.season_sessions(df).groupBy(*entity).agg(
            F.count("*").alias("season_sessions"), F.count_if(days).alias("in_range"), F.count_if(kind).alias("filtered"), F.count_if(kind & F.col("has_gps")).alias("measured")
        )


def default_season(sessions: DataFrame, entity: list[str]) -> DataFrame:
    """``entity, season``: the latest one with an official match, else the latest one."""
    official = F.when(F.col("match_category") == "official_match", F.col("season"))
    return sessions.groupBy(*entity).agg(F.coalesce(F.max(official), F.max("season")).alias("season"))


def analyzed(sessions: DataFrame, category: str | None = None, month: int | None = None, year: int | None = None) -> DataFrame:
    """Sessions of a kind, a month as it was typed, and a calendar year."""
    wanted = (("match_category", category), ("month", month))
    for column, value in wanted:
        if value is not None:
            sessions = sessions.filter(F.col(column) == value)
    return sessions if year is None else sessions.filter(F.year("date") == year)


def with_distance_per_min(sessions: DataFrame) -> DataFrame:
    """The rate computed anew, whatever was exported."""
    rate = F.when(F.col("duration_min") > 0, F.col("total_distance_m") / F.col("duration_min"))
    return sessions.withColumn("distance_per_min", half_even(rate, 2))


def cards(sessions: DataFrame, reference: DataFrame, entity: list[str], metrics: tuple[str, ...], peaks: tuple[str, ...] = ("top_speed_kmh",)) -> DataFrame:
    """``entity, season, metric, n, value, gref, pct``: mean of recorded sessions, the peak of ``peaks``, in percent of the reference."""
    by = [*entity, "season"]
    figures = sessions.filter("has_gps").groupBy(*by).agg(F.count("*").alias("n"), *((F.max if m in peaks else F.avg)(F.col(m).cast("double")).alias(m) for m in metrics))
    long = figures.unpivot([*by, "n"], list(metrics), "metric", "value")
    return long.join(reference.select(*by, "metric", "gref"), [*by, "metric"], "left").select(
        *by, "metric", "n", half_even(F.col("value"), 2).alias("value"), half_even(F.col("gref"), 4).alias("gref"),
        half_even(F.when(F.col("gref") > 0, F.col("value") / F.col("gref") * 100), 1).alias("pct"),
    )


def speed(season_sessions: DataFrame, filtered: DataFrame, entity: list[str]) -> DataFrame:
    """Best of the season and its day, best in range as its share, sessions near it, and sprints in range."""
    has = lambda df: df.filter("has_gps")
    best = has(season_sessions).groupBy(*entity).agg(
        F.max("top_speed_kmh").alias("season_best"),
        # of equals the first day
        F.max_by("date", F.when(F.col("top_speed_kmh").isNotNull(), F.struct("top_speed_kmh", (-F.unix_date("date")).alias("d")))).alias("season_best_date"),
    )
    rows = has(filtered).join(best, entity)
    near = F.col("top_speed_kmh") >= NEAR_BEST * F.col("season_best")
    figures = rows.groupBy(*entity).agg(
        F.max("top_speed_kmh").alias("range_best"), F.count_if(near).alias("near_best"), F.count("top_speed_kmh").alias("with_speed"),
        F.coalesce(F.sum("sprints_total"), F.lit(0.0)).alias("sprints"), F.coalesce(F.sum("sprint_distance_m"), F.lit(0.0)).alias("sprint_m"),
    )
    share = F.rint(F.when(F.col("season_best") > 0, F.col("range_best") / F.col("season_best") * 100))
    return best.join(figures, entity, "left").na.fill(0, ["near_best", "with_speed", "sprints", "sprint_m"]).withColumn("range_pct_of_best", share)


def games_in_reference(sessions: DataFrame, reference: DataFrame, entity: list[str], metrics: tuple[str, ...], key: str = "session_id") -> DataFrame:
    """Every recorded friendly and official match, each metric in percent of the season's reference."""
    games = sessions.filter(F.col("has_gps") & F.col("match_category").isin("official_match", "practice_match"))
    keys = [*entity, "season", key, "match_category"]
    long = games.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, list(metrics), "metric", "v").filter("v is not null")
    return long.join(reference.filter("gref <> 0").select(*entity, "season", "metric", "gref"), [*entity, "season", "metric"]).select(
        *entity, key, "match_category", "metric", half_even(F.col("v") / F.col("gref") * 100, 1).alias("pct")
    )


def link_coverage(linked: DataFrame, resolution: str, by: list[str]) -> DataFrame:
    """``by, resolution, sessions`` of official sessions, those without a fixture under null."""
    return linked.filter(S.is_official()).groupBy(*by, resolution).agg(F.count("*").alias("sessions"))


def headline(long: DataFrame, by: list[str], dimension: DataFrame, metrics: tuple[str, ...] = HEADLINE) -> DataFrame:
    """Latest against previous value of fixed metrics, with their place in the fixed order."""
    place = F.array_position(F.array(*map(F.lit, metrics)), F.col("metric"))
    return evolution(long.filter(F.col("metric").isin(*metrics)), by, dimension, baseline="previous").withColumn("place", place)


def paired(body: DataFrame, performance: DataFrame, by: list[str], body_metric: str, performance_metric: str) -> DataFrame:
    """The points behind one correlation: both values on one date, neither missing."""
    both = body.select(*by, F.col(f"`{body_metric}`").alias("body_value")).join(performance.select(*by, F.col(f"`{performance_metric}`").alias("performance_value")), by)
    return both.filter("body_value is not null and performance_value is not null")


def latest_form(sessions: DataFrame, entity: list[str], metric: str, last: int = 5, key: str = "session_id") -> DataFrame:
    """The latest session with the metric ranked against history, and mean intensity of the ``last`` sessions."""
    down = Window.partitionBy(*entity).orderBy(F.desc("date"), F.desc(key))
    shares = S.intensity_ratios(sessions).select(*entity, "date", key, metric, "hsr_share_pct", "sprint_share_pct")
    ranked = shares.withColumns(
        {
            "_n": F.row_number().over(down),
            "_latest": F.first(metric, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    known = F.count(metric)
    recent = lambda c: half_even(F.avg(F.when(F.col("_n") <= last, F.col(c))), 2)
    return ranked.groupBy(*entity).agg(
        F.max("_latest").alias("latest"), half_even(F.when(known > 0, F.count_if(F.col(metric) < F.col("_latest")) / known * 100), 1).alias("pct_rank"),
        recent("hsr_share_pct").alias("hsr_share_last"), recent("sprint_share_pct").alias("sprint_share_last"),
    )


def typical_week(weekly: DataFrame, entity: list[str]) -> DataFrame:
    """Latest rated week's monotony and strain, and the median strain of all rated weeks."""
    rated = weekly.filter("monotony is not null")
    latest = lambda c: F.max_by(c, "week_start").alias(f"latest_{c}")
    return rated.groupBy(*entity).agg(F.max("week_start").alias("week_start"), latest("monotony"), latest("strain"), half_even(F.median("strain"), 1).alias("typical_strain"))


def two_ratios(sessions: DataFrame, entity: list[str]) -> DataFrame:
    """``entity, week_start, mechanical_acwr, distance_acwr``: weeks that either rates."""
    def ratio(df: DataFrame, value: str, name: str) -> DataFrame:
        return load.weekly_acwr(load.weekly_load(df, entity, value), entity).select(*entity, "week_start", F.col("acwr").alias(name))

    both = ratio(S.mechanical_load(sessions), "mechanical_load", "mechanical_acwr").join(ratio(sessions, "total_distance_m", "distance_acwr"), [*entity, "week_start"], "full")
    return both.filter("mechanical_acwr is not null or distance_acwr is not null")


def phase_profile(long: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Mean of each metric by phase and its change from the phase before, in the season's order."""
    means = long.groupBy(*by, "phase", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).withColumn("phase_order", order)
    before = F.lag("mean").over(Window.partitionBy(*by, "metric").orderBy("phase_order"))
    return means.select(*by, "phase", "metric", "n", "phase_order", half_even(F.col("mean"), 2).alias("mean"), half_even(F.col("mean") - before, 2).alias("change"))
