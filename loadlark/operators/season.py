"""Fixtures, league tables, team strength and season simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import winner
from ..functions.numbers import half_even
from ..functions.text import numeric_matchweek

# Fixed values.
HOME_ADVANTAGE, DEFENSE_SMOOTHING = 1.15, 0.1


def split_fixtures(raw: DataFrame, competition: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(played, remaining)`` of raw team fixtures, each fixture once.

    The tracked team is ``Team1``; ``Location`` says where it plays, ``Result``
    is home first. Both teams list a fixture, so the first row by home team of a
    matchweek and unordered pair stays.
    """
    if competition is not None:
        raw = raw.filter(F.col("Competition") == competition)
    at_home = F.col("Location") == "(C)"
    sided = raw.withColumns(
        {
            "matchweek_number": numeric_matchweek(F.col("Matchweek")),
            "home_team": F.when(at_home, F.col("Team1")).otherwise(F.col("Team2")),
            "away_team": F.when(at_home, F.col("Team2")).otherwise(F.col("Team1")),
        }
    )
    pair = Window.partitionBy("matchweek_number", F.least("home_team", "away_team"), F.greatest("home_team", "away_team"))
    once = lambda df: df.withColumn("_r", F.row_number().over(pair.orderBy("home_team", "Team1"))).filter("_r = 1").drop("_r")
    names = ["matchweek_number", "home_team", "away_team"]
    goals = F.split("Result", "-")
    played = once(sided.filter(F.col("Played?"))).select(
        *names, F.get(goals, F.lit(0)).try_cast("int").alias("home_goals"), F.get(goals, F.lit(1)).try_cast("int").alias("away_goals")
    )
    return played.withColumn("winner", winner(F.col("home_goals"), F.col("away_goals"))), once(sided.filter(~F.col("Played?"))).select(*names)


def _sides(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Two rows for each match: a team, its goals and those against it."""
    side = lambda a, b: F.struct(F.col(f"{a}_team").alias("team"), F.col(f"{a}_goals").alias("gf"), F.col(f"{b}_goals").alias("ga"))
    return matches.select(*keys, F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select(*keys, "s.*")


def league_table(matches: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Points, results and goals of each team; three points a win. Order: points, goal difference, name."""
    won, drawn, lost = F.col("gf") > F.col("ga"), F.col("gf") == F.col("ga"), F.col("gf") < F.col("ga")
    return _sides(matches, keys).groupBy(*keys, "team").agg(
        (3 * F.count_if(won) + F.count_if(drawn)).alias("points"), F.count_if(won).alias("wins"), F.count_if(drawn).alias("draws"),
        F.count_if(lost).alias("losses"), F.sum("gf").alias("goals_scored"), F.sum("ga").alias("goals_conceded"),
        (F.sum("gf") - F.sum("ga")).alias("gd"), F.count("*").alias("played"),
    )


def ranked(table: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    w = Window.partitionBy(*keys).orderBy(F.desc("points"), F.desc("gd"), "team")
    return table.withColumn("position", F.row_number().over(w))


def team_strength(matches: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Attack and defence of each team relative to the mean goals of a team in a match; both 0 where no team has scored."""
    goals = _sides(matches, keys).groupBy(*keys, "team").agg(F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.count("*").alias("n"))
    league = Window.partitionBy(*keys)  # one row for each team
    mean = F.sum("gf").over(league) / F.sum("n").over(league)
    attack = F.when(F.col("mean_goals") == 0, 0.0).otherwise(F.col("gf") / F.col("n") / F.col("mean_goals"))
    return goals.withColumn("mean_goals", mean).select(
        *keys, "team", "mean_goals", attack.alias("attack"),
        (F.col("mean_goals") / (F.col("ga") / F.col("n") + DEFENSE_SMOOTHING)).alias("defense"),
    )


def expected_goals(fixtures: DataFrame, strength: DataFrame, goals_scale: float = 0.5) -> DataFrame:
    """Means of both sides' goals; an unknown team counts as average, and without any goal so far none is expected.

    ``goals_scale`` 0.5 halves the mean of a team once more, as published
    predictions do; 1 leaves it.
    """
    side = lambda p: strength.select(F.col("team").alias(f"{p}_team"), F.col("attack").alias(f"_{p}_a"), F.col("defense").alias(f"_{p}_d"))
    one = strength.agg(F.coalesce(F.first("mean_goals"), F.lit(1.0)).alias("_level"))  # one row, whatever the input
    level = F.col("_level")
    known = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    against = lambda a, d: F.when(level == 0, 0.0).otherwise(known(a) / known(d))
    return (
        fixtures.join(side("home"), "home_team", "left").join(side("away"), "away_team", "left").join(F.broadcast(one))
        .withColumns(
            {
                "home_xg": against("_home_a", "_away_d") * (level * goals_scale) * HOME_ADVANTAGE,
                "away_xg": against("_away_a", "_home_d") * (level * goals_scale),
            }
        )
        .drop("_home_a", "_home_d", "_away_a", "_away_d", "_level")
    )


def poisson_steps(mean: Column) -> Column:
    """The Poisson distribution function from 0 up, until what is left (under 1e-16) can't be drawn any more."""
    # ten deviations above the mean, and 24 more for small means
    last = (mean + F.sqrt(mean) * 10 + 24).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.expr("cast(array() as array<double>)").alias("all")),
        lambda s, i: F.struct(
            (s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"), F.array_append(s["all"], s["c"]).alias("all")
        ),
        lambda s: s["all"],
    )


def quantile(steps: Column, u: Column, near: int = 12) -> Column:
    """How many ``steps`` are below ``u``; the first ones, which nearly all draws stop at, are compared in compiled code."""
    found = F.when(u <= steps[0], 0)
    for k in range(1, near):
        found = found.when(u <= steps[k], k)
    return found.otherwise(F.size(F.filter(steps, lambda c: u > c)))


def poisson(mean: Column, u: Column) -> Column:
    """The Poisson quantile at ``u``: counts how often the running distribution is below it."""
    return quantile(poisson_steps(mean), u)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits that depends on ``parts`` alone, so on no partitioning, by a digest that any engine has."""
    digest = F.md5(F.concat_ws("|", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def simulate(played: DataFrame, remaining: DataFrame, n: int = 1000, seed: int = 42, goals_scale: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``(table, positions)``: mean final statistics and chances, and how often each team ends in each place.

    Only remaining fixtures are drawn; what was played is added once to each
    simulated table, by team. A fixture's distributions are made once, before its
    draws; fixtures are dealt to all cores, as their draws are the work.
    """
    strength = team_strength(played)
    xg = expected_goals(remaining, strength, goals_scale)
    parts = remaining.sparkSession.sparkContext.defaultParallelism * 2
    steps = xg.repartition(parts, "matchweek_number", "home_team", "away_team").withColumns({f"_{p}": poisson_steps(F.col(f"{p}_xg")) for p in ("home", "away")})
    draws = steps.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sim"))
    u = lambda side: uniform(F.lit(seed), "sim", "matchweek_number", "home_team", "away_team", F.lit(side))
    drawn = draws.withColumns({"home_goals": quantile(F.col("_home"), u("h")), "away_goals": quantile(F.col("_away"), u("a"))})
    numbers = ["points", "wins", "draws", "losses", "goals_scored", "goals_conceded", "gd", "played"]
    both = league_table(played).select("team", *numbers)
    teams = both.select("team").union(remaining.select("home_team")).union(remaining.select("away_team")).distinct()
    base = teams.join(both, "team", "left").na.fill(0).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("sim", F.col("sim").cast("long"))
    more = league_table(drawn.withColumn("sim", F.col("sim").cast("long")), ["sim"]).select("sim", "team", *numbers)
    final = base.unionByName(more).groupBy("sim", "team").agg(*(F.sum(c).alias(c) for c in numbers))
    placed = ranked(final, ["sim"])
    n_teams = F.max("n_teams")
    counted = placed.withColumn("n_teams", F.count("*").over(Window.partitionBy("sim")))
    span = F.least(F.lit(3), F.col("n_teams"))
    table = counted.groupBy("team").agg(
        *(half_even(F.avg(c), 2).alias(f"mean_{c}") for c in numbers), half_even(F.avg("position"), 2).alias("mean_position"),
        half_even(F.avg(F.when(F.col("position") == 1, 100.0).otherwise(0.0)), 1).alias("title_pct"),
        half_even(F.avg(F.when(F.col("position") <= span, 100.0).otherwise(0.0)), 1).alias("top3_pct"),
        half_even(F.avg(F.when(F.col("position") > F.col("n_teams") - span, 100.0).otherwise(0.0)), 1).alias("bottom3_pct"),
        n_teams.alias("n_teams"),
    )
    return table, placed.groupBy("team", "position").agg(F.count("*").alias("times"))


def is_complete(played: DataFrame) -> DataFrame:
    """Whether every team has met every other twice."""
    teams = _sides(played, []).select("team").distinct().agg(F.count("*").alias("teams"))
    return teams.join(played.agg(F.count("*").alias("matches"))).withColumn("complete", F.col("matches") == F.col("teams") * (F.col("teams") - 1))
