"""Cleaning of session logs and rates of single sessions: projections only, no shuffle."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes, dates
from ..functions.numbers import half_even, holds, nothing, numeric, positive, ratio, share, sum_known

# Measured columns of a session, and those that show that there is a recording.
CORE = ("total_distance_m", "high_speed_distance_m", "sprint_distance_m", "top_speed_kmh", "accelerations", "decelerations")
MEASURED = (*CORE, "distance_per_min", "sprints_1st_half", "sprints_2nd_half", "sprints_total", "calories")
NUMBERS = ("duration_min", "minutes_game_zerozero", *MEASURED)
PER90 = ("total_distance_m", "high_speed_distance_m", "sprint_distance_m", "accelerations", "decelerations", "sprints_total", "hia")


def prepare(raw: DataFrame) -> DataFrame:
    """Typed, classified sessions.

    Adds ``match_category, season, unused_sub, has_gps, minutes_played,
    short_appearance, hsr_sprint_m, hsr_m, hia, m_per_min``. A game with nothing
    but zeros or gaps is an unused substitute, its measures become missing;
    without any core measure there is no recording; a top speed of 0 is a dropout.
    """
    have = set(raw.columns)
    number = {c: numeric(F.col(c)) if c in have else F.lit(None).cast("double") for c in NUMBERS}
    others = [c for c in raw.columns if c not in {*NUMBERS, "date"}]
    typed = raw.select(*others, F.to_date("date").alias("date"), *(x.alias(c) for c, x in number.items()))
    game = F.col("session_kind") == "game"
    zero = reduce(lambda a, b: a & b, (nothing(F.col(c)) for c in ("duration_min", "minutes_game_zerozero", *CORE)))
    # one step for each level of columns that the next one reads more than once: what stands in a step is computed once
    flagged = typed.select("*", holds(game & zero).alias("unused_sub"))
    seen = flagged.select("*", (~F.col("unused_sub") & F.coalesce(*CORE).isNotNull()).alias("has_gps"))
    cleared = {c: F.when(F.col("has_gps"), F.col(c)) for c in MEASURED} | {
        "top_speed_kmh": F.when(F.col("has_gps") & (F.col("top_speed_kmh") != 0), F.col("top_speed_kmh")),
        "duration_min": F.when(~F.col("unused_sub"), F.col("duration_min")),
    }
    kept = seen.select(*(c for c in seen.columns if c not in cleared), *(x.alias(c) for c, x in cleared.items()))
    sheet = F.when(game, positive(F.col("minutes_game_zerozero")))
    played = kept.select("*", F.coalesce(sheet, positive(F.col("duration_min"))).alias("minutes_played"))
    rest = F.col("high_speed_distance_m") - F.col("sprint_distance_m")
    return played.select(
        "*", classes.match_category(F.col("session_kind"), F.col("competition_type")).alias("match_category"), dates.season(F.col("date")).alias("season"),
        holds(game & F.col("has_gps") & (F.col("minutes_played") < classes.SHORT_MINUTES)).alias("short_appearance"),
        F.col("high_speed_distance_m").alias("hsr_sprint_m"), F.when(rest.isNotNull(), F.greatest(rest, F.lit(0.0))).alias("hsr_m"),
        (F.col("accelerations") + F.col("decelerations") + F.col("sprints_total")).alias("hia"),
        half_even(ratio(F.col("total_distance_m"), F.col("duration_min")), 1).alias("m_per_min"),
    )


def measured(sessions: DataFrame) -> DataFrame:
    return sessions.filter("has_gps")


def scoped(
    sessions: DataFrame, season: str | None = None, start: date | None = None, end: date | None = None,
    categories: list[str] | None = None,
) -> DataFrame:
    """All bounds are optional and inclusive; they reach the scan."""
    if season is not None:
        sessions = sessions.filter(F.col("season") == season)
    if start is not None:
        sessions = sessions.filter(F.col("date") >= F.lit(start))
    if end is not None:
        sessions = sessions.filter(F.col("date") <= F.lit(end))
    if categories is not None:
        sessions = sessions.filter(F.col("match_category").isin(categories))
    return sessions


def is_official() -> Column:
    """A game of an official competition; stricter than the category, which doesn't ask for a game."""
    return (F.col("session_kind") == "game") & holds(F.col("competition_type").isin(*classes.OFFICIAL))


def official_minutes(sessions: DataFrame) -> DataFrame:
    """``official_minutes`` of the match sheet, else the recording, and ``minutes_source``."""
    sheet, gps = F.col("minutes_game_zerozero"), F.col("duration_min")
    return sessions.withColumns(
        {
            "official_minutes": F.coalesce(positive(sheet), positive(gps)),
            "minutes_source": F.when(sheet > 0, "match_sheet").when(gps > 0, "gps_runtime").otherwise("none"),
        }
    )


def per90(sessions: DataFrame, minutes: str, suffix: str = "_per90", metrics: tuple[str, ...] = PER90) -> DataFrame:
    return sessions.withColumns({f"{m}{suffix}": half_even(ratio(F.col(m), F.col(minutes)) * 90, 2) for m in metrics})


def intensity_ratios(sessions: DataFrame) -> DataFrame:
    total = F.col("total_distance_m")
    return sessions.withColumns(
        {
            "hsr_share_pct": half_even(share(F.col("high_speed_distance_m"), total), 2),
            "sprint_share_pct": half_even(share(F.col("sprint_distance_m"), total), 2),
        }
    )


def mechanical_load(sessions: DataFrame) -> DataFrame:
    """Accelerations and decelerations together, by minute, and their ratio with its class."""
    acc, dec = F.col("accelerations"), F.col("decelerations")
    load = sum_known(acc, dec)
    balance = half_even(ratio(acc, dec), 2)
    return sessions.withColumns(
        {
            "mechanical_load": load,
            "mechanical_load_per_min": half_even(ratio(load, F.col("duration_min")), 2),
            "accel_decel_ratio": balance,
            "accel_decel_class": classes.accel_decel_class(balance),
        }
    )


def flag_short(sessions: DataFrame, floor: float = classes.SHORT_MINUTES) -> DataFrame:
    """``short_appearance`` by official minutes, for any kind of session; no row is dropped."""
    if "official_minutes" not in sessions.columns:
        sessions = official_minutes(sessions)
    return sessions.withColumn("short_appearance", holds(F.col("official_minutes") < floor))


def minutes_overhang(sessions: DataFrame) -> DataFrame:
    """Sessions with both clocks: recorded less official minutes."""
    sheet, gps = F.col("minutes_game_zerozero"), F.col("duration_min")
    diff = half_even(gps - sheet, 1)
    return sessions.filter((sheet > 0) & gps.isNotNull()).withColumns(
        {"minutes_overhang": diff, "overhang_pct": half_even((gps - sheet) / sheet * 100, 1), "note": classes.overhang_note(diff)}
    )


def second_half_retention(sessions: DataFrame, least_minutes: float = 50.0) -> DataFrame:
    """Second-half sprints by first-half sprints, of long enough games with both halves."""
    first, second = F.col("sprints_1st_half"), F.col("sprints_2nd_half")
    minutes = F.coalesce(positive(F.col("minutes_game_zerozero")), F.col("duration_min"))
    return sessions.filter((first > 0) & second.isNotNull() & (minutes >= least_minutes)).withColumns(
        {"minutes": minutes, "retention": half_even(second / first, 2)}
    )
