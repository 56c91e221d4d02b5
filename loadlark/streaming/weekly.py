"""Weekly load of a stream of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_load_stream(sessions: DataFrame, entity: list[str], value: str = "total_distance_m", late: str = "7 days") -> DataFrame:
    """``entity, week_start, total, sessions``; in append mode only weeks that are over are emitted.

    ``sessions`` has a timestamp ``ts``. The windows start on Sundays (the epoch
    was a Thursday). A session that is sent twice within ``late`` counts once.
    """
    once = sessions.withWatermark("ts", late).dropDuplicatesWithinWatermark([*entity, "session_id"])
    weeks = once.groupBy(*entity, F.window("ts", "7 days", "7 days", "3 days")).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.count("*").alias("sessions")
    )
    return weeks.select(*entity, F.to_date("window.start").alias("week_start"), "total", "sessions")
