"""Body-composition assessments: long and wide layouts, changes, verdicts, summaries and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import change_verdict
from ..functions.dates import PHASE_ORDER, position
from ..functions.numbers import half_even

WHOLE_SEASON = "época completa"


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, metric, value`` of every other column; missing values are dropped."""
    metrics = [c for c in wide.columns if c not in keys]
    typed = wide.select(*(F.col(f"`{k}`") for k in keys), *(F.col(f"`{m}`").cast("double").alias(m) for m in metrics))
    return typed.unpivot(keys, [F.col(f"`{m}`") for m in metrics], "metric", "value").filter("value is not null")


def to_wide(long: DataFrame, keys: list[str], metrics: list[str], order: str = "date") -> DataFrame:
    """One column for each listed metric; of several values the last by ``order``."""
    return long.groupBy(*keys).pivot("metric", metrics).agg(F.max_by("value", F.struct(order, "value")))


def prefer_raw(raw: DataFrame, derived: DataFrame, by: list[str]) -> DataFrame:
    """All raw rows, and derived ones of metrics that the entity has no raw row of."""
    known = raw.select(*by, "metric").distinct()
    return raw.unionByName(derived.join(known, [*by, "metric"], "left_anti"), allowMissingColumns=True)


def changes(long: DataFrame, by: list[str], thresholds: DataFrame) -> DataFrame:
    """Each value against the one before and the first one, by metric.

    ``thresholds(metric, threshold)``: the least change that means something.
    """
    w = Window.partitionBy(*by, "metric").orderBy("date")
    previous, first = F.lag("value").over(w), F.first("value").over(w)
    days = F.datediff("date", F.lag("date").over(w))
    delta = F.col("value") - F.col("_p")
    return (
        long.withColumns({"_p": previous, "_f": first, "days_since_previous": days})
        .join(thresholds, "metric", "left")
        .select(
            *by, "date", "metric", "value", "days_since_previous", half_even(delta, 2).alias("delta_previous"),
            half_even(F.when(F.col("_p") != 0, delta / F.col("_p") * 100), 1).alias("pct_previous"),
            half_even(F.when(F.col("days_since_previous") > 0, delta / F.col("days_since_previous") * 30), 2).alias("rate_per_30d"),
            F.when(delta.isNull() | F.col("threshold").isNull(), "").when(F.abs(delta) >= F.col("threshold"), "sim").otherwise("ruído").alias("meaningful_change"),
            half_even(F.col("value") - F.col("_f"), 2).alias("delta_baseline"),
        )
    )


def evolution(long: DataFrame, by: list[str], dimension: DataFrame, baseline: str = "first") -> DataFrame:
    """Latest value of each metric against the first or the previous one, with its verdict.

    ``dimension(metric, direction, threshold)``; metrics with one value are left out.
    """
    group = [*by, "metric"]
    down = Window.partitionBy(*group).orderBy(F.desc("date"))
    rows = long.withColumns({"_d": F.row_number().over(down), "_n": F.count("*").over(Window.partitionBy(*group))}).filter("_n > 1")
    base = F.col("_d") == (F.col("_n") if baseline == "first" else F.lit(2))
    pairs = rows.groupBy(*group).agg(
        F.max(F.when(F.col("_d") == 1, F.col("value"))).alias("latest"), F.max(F.when(base, F.col("value"))).alias("base"),
        F.max("date").alias("latest_date"), F.max(F.when(base, F.col("date"))).alias("base_date"),
    )
    delta = F.col("latest") - F.col("base")
    return pairs.join(dimension, "metric", "left").select(
        *by, "metric", "base_date", "latest_date", "base", "latest", half_even(delta, 2).alias("change"),
        half_even(F.when(F.col("base") != 0, delta / F.col("base") * 100), 1).alias("change_pct"),
        change_verdict(F.col("direction"), delta, F.col("threshold")).alias("verdict"),
    )


def verdict_counts(evolved: DataFrame, by: list[str]) -> DataFrame:
    kinds = ("worse", "better", "noise", "neutral")
    return evolved.groupBy(*by).agg(
        *(F.count_if(F.col("verdict") == k).alias(k) for k in kinds), F.count_if(F.col("verdict").isin("worse", "better")).alias("directional")
    )


def phase_means(long: DataFrame, by: list[str]) -> DataFrame:
    return long.groupBy(*by, "phase", "metric").agg(half_even(F.avg("value"), 2).alias("mean"), F.count("*").alias("n")).withColumn(
        "phase_order", position(F.col("phase"), PHASE_ORDER)
    )


def season_levels(long: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of each metric by season and by season and phase, in one pass of two grouping sets."""
    whole = [*by, "season", "metric"]
    rows = long.groupingSets([[F.col(c) for c in whole], [F.col(c) for c in (*whole, "phase")]], *(F.col(c) for c in (*whole, "phase"))).agg(
        F.grouping("phase").alias("whole"), F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
    )
    return rows.select(
        *by, "season", F.when(F.col("whole") == 1, WHOLE_SEASON).otherwise(F.col("phase")).alias("phase"), "metric", "n", "first_date", "last_date",
        "first", "last", half_even(F.col("last") - F.col("first"), 2).alias("net_change"), "least", "most",
        half_even(F.col("most") - F.col("least"), 2).alias("range"), half_even(F.col("mean"), 4).alias("mean"),
        half_even(F.when(F.col("mean") != 0, F.col("sd") / F.col("mean") * 100), 4).alias("cv_pct"),
    )


def implausible(long: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values outside of ``ranges(metric, low, high)``."""
    return long.join(ranges, "metric").filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def quality_flags(long: DataFrame, by: list[str], ranges: DataFrame, jump: float = 0.3) -> DataFrame:
    """Values out of range, and jumps of more than ``jump`` where the value isn't flagged already."""
    w = Window.partitionBy(*by, "metric").orderBy("date")
    p = F.lag("value").over(w)
    rows = long.withColumn("_p", p).join(ranges, "metric", "left")
    out = F.coalesce((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), F.lit(False))
    jumped = F.coalesce((F.col("_p") != 0) & (F.abs(F.col("value") - F.col("_p")) / F.abs("_p") > jump), F.lit(False))
    return rows.filter(out | jumped).select(*by, "date", "metric", "value", F.when(out, "out of range").otherwise("jump").alias("flag"))


def corrected(long: DataFrame, corrections: DataFrame, by: list[str]) -> DataFrame:
    """Values replaced by ``corrections(by, date, metric, corrected_value, why)``; the printed one stays in ``value_original``."""
    joined = long.join(corrections, [*by, "date", "metric"], "left")
    fixed = F.col("corrected_value").isNotNull()
    return joined.withColumns(
        {"value_original": F.when(fixed, F.col("value")), "corrected": F.when(fixed, "sim").otherwise(""), "correction_note": F.col("why")}
    ).withColumn("value", F.coalesce("corrected_value", "value")).drop("corrected_value", "why")


def recomputed(rows: DataFrame, ratios: DataFrame, by: list[str]) -> DataFrame:
    """:func:`corrected` rows, with the ratios of assessments that hold a correction computed anew.

    ``ratios(metric, numerator, denominator)``. A ratio that moves by less than
    0.005, or has no denominator other than zero, stays as printed.
    """
    at = [*by, "date"]
    touched = rows.filter("corrected = 'sim'").select(*at).distinct()
    part = lambda role, name: rows.select(*at, F.col("metric").alias(role), F.col("value").alias(name))
    fresh = half_even(F.when(F.col("_d") != 0, F.col("_n") / F.col("_d")), 2)
    moved = (
        rows.select(*at, "metric", "value").join(ratios, "metric").join(touched, at)
        .join(part("numerator", "_n"), [*at, "numerator"]).join(part("denominator", "_d"), [*at, "denominator"])
        .withColumn("_new", fresh).filter(F.abs(F.col("_new") - F.col("value")) >= 0.005)
        .select(*at, "metric", "_new", F.concat(F.lit("recalculado de "), "numerator", F.lit("/"), "denominator", F.lit(" após correção")).alias("_why"))
    )
    new = F.col("_new").isNotNull()
    return rows.join(moved, [*at, "metric"], "left").withColumns(
        {
            "value_original": F.when(new, F.col("value")).otherwise(F.col("value_original")), "corrected": F.when(new, "sim").otherwise(F.col("corrected")),
            "correction_note": F.coalesce("_why", "correction_note"), "value": F.coalesce("_new", "value"),
        }
    ).drop("_new", "_why")


def applied_corrections(long: DataFrame) -> DataFrame:
    return long.filter(F.lower(F.trim("corrected")) == "sim")


def newest_report(records: DataFrame, keys: list[str], report: str = "report_date") -> DataFrame:
    """One row for each key: that of the newest report, of equals the first by source."""
    w = Window.partitionBy(*keys).orderBy(F.desc(report), "source_file")
    return records.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
