"""Line-ups and match events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..functions.text import first_minute, is_penalty, parse_minutes

EVENTS = {"Goals": "goal", "Assists": "assist", "Yellow Card": "yellow_card", "Red Card": "red_card"}


def events(lineups: DataFrame) -> DataFrame:
    """``match_url, team, player_name, minute, event_type, goal_type``: one row for each minute in the event cells."""
    kind = F.create_map(*(F.lit(x) for pair in EVENTS.items() for x in pair))
    long = lineups.unpivot(["match_url", "team", "name"], list(EVENTS), "_column", "_cell")
    return long.select(
        "match_url", "team", F.col("name").alias("player_name"), F.explode(parse_minutes(F.col("_cell"))).alias("minute"),
        kind[F.col("_column")].alias("event_type"),
        F.when(F.col("_column") == "Goals", F.when(is_penalty(F.col("_cell")), "penalty").otherwise("open_play")).alias("goal_type"),
    )


def minutes_played(lineups: DataFrame) -> DataFrame:
    """Starters until their substitution or 90; others from it to 90, or not at all."""
    out, came = first_minute(F.col("Substitution OUT")), first_minute(F.col("Substitution IN"))
    return lineups.withColumn(
        "minutes", F.when(F.col("status") == "Starter", F.coalesce(out, F.lit(90))).otherwise(F.coalesce(90 - came, F.lit(0)))
    )


def season_stats(lineups: DataFrame, keys: list[str] = ["team", "name"]) -> DataFrame:  # noqa: B006
    """Matches, starts, substitute appearances, events and rates of each player."""
    rows = minutes_played(lineups)
    size = lambda c: F.sum(F.size(parse_minutes(F.col(c))))
    sums = rows.groupBy(*keys).agg(
        F.countDistinct("match_url").alias("matches"), F.countDistinct(F.when(F.col("status") == "Starter", F.col("match_url"))).alias("starts"),
        F.countDistinct(F.when(F.col("status") == "Suplente", F.col("match_url"))).alias("substitute"),
        size("Goals").alias("goals"), size("Assists").alias("assists"), size("Yellow Card").alias("yellow_cards"), size("Red Card").alias("red_cards"),
        F.sum("minutes").alias("minutes"),
    )
    involved = F.col("goals") + F.col("assists")
    return sums.withColumns(
        {
            "goals_assists": involved,
            "goals_assists_per_game": half_even(involved / F.col("matches"), 2),
            "goals_assists_per_90": half_even(F.when(F.col("minutes") > 0, involved / F.col("minutes") * 90).otherwise(0.0), 2),
        }
    )


def totals(player_stats: DataFrame) -> DataFrame:
    if "Competition" not in player_stats.columns:
        raise ValueError("player statistics need a Competition column")
    return player_stats.filter(F.col("Competition") == "Total")
