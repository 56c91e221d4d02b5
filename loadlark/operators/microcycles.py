"""Match-day labels: each session's distance to the official matches around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_number
from ..functions.text import md_label, md_order

PLUS_MAX, LEAD, EXTENDED = 2, 6, 10


def label_microcycles(sessions: DataFrame, entity: list[str]) -> DataFrame:
    """Adds ``md_label, md_offset, md_order, microcycle_id, microcycle_start, microcycle_end, microcycle_days, microcycle_extended``.

    Within a season, the last match on or before a day and the next one after
    it are range-framed extremes over day numbers. Up to two days after a match
    count from it, as do days without a next match; other days count down to the
    next match; before the first match only the last six days do, the rest is
    preparation.
    """
    day = day_number(F.col("date"))
    w = Window.partitionBy(*entity, "season").orderBy("_day")
    down = Window.partitionBy(*entity, "season").orderBy(F.desc("_day"))  # so that this frame grows too
    anchor = F.when(F.col("match_category") == "official_match", F.col("_day"))
    marked = sessions.withColumn("_day", day).withColumns(
        {
            "_prev": F.max(anchor).over(w.rangeBetween(Window.unboundedPreceding, 0)),
            "_next": F.min(anchor).over(down.rangeBetween(Window.unboundedPreceding, -1)),
            "_last": F.max("_day").over(Window.partitionBy(*entity, "season")),
        }
    )
    since, until = F.col("_day") - F.col("_prev"), F.col("_next") - F.col("_day")
    offset = (
        F.when((since <= PLUS_MAX) | (since.isNotNull() & until.isNull()), since)
        .when(until.isNotNull() & (since.isNotNull() | (until <= LEAD)), -until)
        .cast("int")
    )
    start = F.date_from_unix_date(F.col("_prev"))
    end = F.date_from_unix_date(F.coalesce(F.col("_next") - 1, F.col("_last")).cast("int"))
    days = F.when(start.isNotNull(), F.datediff(end, start) + 1)
    return marked.withColumn("md_offset", offset).withColumns(
        {
            "md_label": md_label(F.col("md_offset")),
            "md_order": md_order(F.col("md_offset")),
            "microcycle_start": start,
            "microcycle_end": F.when(start.isNotNull(), end),
            "microcycle_id": F.date_format(start, "yyyy-MM-dd"),
            "microcycle_days": days,
            "microcycle_extended": F.coalesce(days > EXTENDED, F.lit(False)),
        }
    ).drop("_day", "_prev", "_next", "_last")


def microcycle_profile(labelled: DataFrame, entity: list[str], metric: str) -> DataFrame:
    """Mean, least, most and count of a metric by label, of recorded sessions in microcycles of usual length."""
    official = F.col("match_category") == "official_match"
    kept = labelled.filter(
        F.col("has_gps") & ~F.col("microcycle_extended") & F.col("md_offset").isNotNull()
        & (F.col("match_category").isin("training", "official_match")) & ((F.col("md_label") == "MD") == official)
    )
    return kept.groupBy(*entity, "md_label", "md_order").agg(
        F.avg(metric).alias("mean"), F.min(metric).alias("least"), F.max(metric).alias("most"), F.count(metric).alias("n")
    )


def demand_by_label(labelled: DataFrame, gref: DataFrame, entity: list[str], metrics: list[str]) -> DataFrame:
    """Mean of each metric by label in percent of its reference, long: ``md_label, metric, demand_pct, n``."""
    kept = labelled.filter(F.col("has_gps") & F.col("md_offset").isNotNull())
    means = kept.groupBy(*entity, "season", "md_label").agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("n"))
    long = means.unpivot([*entity, "season", "md_label", "n"], metrics, "metric", "mean")
    return long.join(gref.select(*entity, "season", "metric", "gref"), [*entity, "season", "metric"], "left").select(
        *entity, "season", "md_label", "metric", "n",
        F.rint(F.when(F.col("gref") > 0, F.col("mean") / F.col("gref") * 100)).alias("demand_pct"),
    )
