"""Classes of sessions, loads and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
OFFICIAL = ("Campeonato", "Taça")
CATEGORIES = ("training", "official_match", "practice_match")
ACWR_BAND = (0.8, 1.5)
MONOTONY = (1.0, 2.0)
ACCEL_DECEL_BAND = (0.8, 1.25)
SHORT_MINUTES = 20.0
OVERHANG = (-5.0, 10.0)
TIERS = (8, 6, 4)


def match_category(kind: Column, competition: Column) -> Column:
    """Official by its competition, practice for every other game, also one without a competition."""
    return (
        F.when(kind == "training", "training")
        .when(F.coalesce(competition.isin(*OFFICIAL), F.lit(False)), "official_match")
        .otherwise("practice_match")
    )


def acwr_zone(x: Column) -> Column:
    low, high = ACWR_BAND
    return F.when(x.isNull(), "Insufficient history").when(x < low, "Below range").when(x < high, "Within range").otherwise("Above range")


def monotony_class(x: Column) -> Column:
    low, high = MONOTONY
    return F.when(x.isNull(), "Unknown").when(x < low, "Low").when(x < high, "Normal").otherwise("High — low day-to-day variability")


def accel_decel_class(x: Column) -> Column:
    low, high = ACCEL_DECEL_BAND
    return F.when(x.isNull(), "Unknown").when(x < low, "Deceleration-dominant").when(x > high, "Acceleration-dominant").otherwise("Balanced")


def result_letter(goals_for: Column, goals_against: Column) -> Column:
    return F.when(goals_for > goals_against, "W").when(goals_for < goals_against, "L").when(goals_for == goals_against, "D")


def winner(home: Column, away: Column) -> Column:
    return F.when(home > away, "Home").when(home < away, "Away").otherwise("Draw")


def overhang_note(diff: Column) -> Column:
    under, over = OVERHANG
    return F.when(diff > over, "wide recording window").when(diff < under, "unit under-recorded").otherwise("")


def reliability(n: Column) -> Column:
    a, b, c = TIERS
    return F.when(n >= a, "reliable").when(n >= b, "indicative").when(n >= c, "exploratory").otherwise("not testable")


def session_status(unused: Column, has_gps: Column, short: Column) -> Column:
    return F.when(unused, "unused sub").when(~has_gps, "no GPS").when(short, "short appearance").otherwise("")


def change_verdict(direction: Column, delta: Column, threshold: Column) -> Column:
    """Noise before direction; ``direction`` is 1 (more is better), -1 or 0."""
    return (
        F.when(delta.isNull(), "neutral")
        .when(F.abs(delta) < F.coalesce(threshold, F.lit(0.0)), "noise")
        .when((F.coalesce(direction, F.lit(0)) == 0) | (delta == 0), "neutral")
        .when(delta * direction > 0, "better")
        .otherwise("worse")
    )
