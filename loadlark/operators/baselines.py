"""Published match demands by playing position, and what training is held to of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_even

METRICS = ("total_distance_m", "high_speed_distance_m", "sprint_distance_m", "accelerations", "decelerations", "top_speed_kmh")
# A full official match, in the order of METRICS.
MATCH = {
    "goalkeeper": (5000.0, 30.0, 10.0, 15.0, 15.0, 26.0),
    "center_back": (10627.0, 612.0, 215.0, 26.5, 50.9, 32.0),
    "full_back": (11410.0, 1054.0, 402.0, 30.4, 54.1, 32.0),
    "central_midfielder": (12027.0, 875.0, 248.0, 27.1, 54.8, 32.0),
    "wide_midfielder": (11990.0, 1184.0, 446.0, 34.9, 64.5, 32.0),
    "forward": (11254.0, 1025.0, 404.0, 29.9, 55.2, 32.0),
}
# Share of a match that a training session is held to.
TRAINING = {"total_distance_m": 0.70, "high_speed_distance_m": 0.45, "sprint_distance_m": 0.35, "accelerations": 0.75, "decelerations": 0.75, "top_speed_kmh": 0.95}


def baselines(spark: SparkSession, positions: list[str] | None = None) -> DataFrame:
    """``position, match_category, metric, baseline``; practice matches are held to official ones, an unknown position is an error."""
    if unknown := sorted(set(positions or ()) - set(MATCH)):
        raise ValueError(f"unknown positions {unknown}; known are {sorted(MATCH)}")
    rows = [(p, m, v, TRAINING[m]) for p in positions or MATCH for m, v in zip(METRICS, MATCH[p], strict=True)]
    table = spark.createDataFrame(rows, "position string, metric string, value double, part double")
    kinds = F.array(*(F.struct(F.lit(k).alias("match_category"), x.alias("baseline")) for k, x in (
        ("training", half_even(F.col("value") * F.col("part"), 1)), ("official_match", F.col("value")), ("practice_match", F.col("value")),
    )))
    return table.select("position", "metric", F.inline(kinds))


def against(sessions: DataFrame, position: str, entity: list[str]) -> DataFrame:
    """``entity, match_category, metric, n, mean, baseline, pct``: what was done in percent of the position's baseline."""
    dim = baselines(sessions.sparkSession, [position])
    means = sessions.filter("has_gps").groupBy(*entity, "match_category").agg(*(F.avg(m).alias(m) for m in METRICS), F.count("*").alias("n"))
    long = means.unpivot([*entity, "match_category", "n"], list(METRICS), "metric", "mean")
    return long.join(dim, ["match_category", "metric"]).select(
        *entity, "match_category", "metric", "n", half_even(F.col("mean"), 2).alias("mean"), "baseline", half_even(F.col("mean") / F.col("baseline") * 100, 1).alias("pct")
    )
