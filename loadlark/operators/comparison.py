"""Match references and like-for-like change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_number
from ..functions.numbers import half_even, pct_change

TOP_N = 5
RATE_METRICS = ("m_per_min",)


def match_reference(sessions: DataFrame, entity: list[str], metrics: list[str], top_n: int = TOP_N, key: str = "session_id") -> DataFrame:
    """``entity, season, metric, gref, used, eligible``: the mean of the best ``top_n`` official matches of a season.

    Rates leave short appearances out.
    """
    official = sessions.filter((F.col("match_category") == "official_match") & F.col("has_gps"))
    usable = lambda m: F.when(~F.col("short_appearance"), F.col(m)) if m in RATE_METRICS else F.col(m)
    values = F.array(*(F.struct(F.lit(m).alias("metric"), usable(m).cast("double").alias("v")) for m in metrics))
    fit = official.select(*entity, "season", key, F.inline(values)).filter("v is not null")
    group = [*entity, "season", "metric"]
    best = Window.partitionBy(*group).orderBy(F.desc("v"), key)
    return (
        fit.withColumn("_r", F.row_number().over(best))
        .groupBy(*group)
        .agg(
            (F.sum(F.when(F.col("_r") <= top_n, F.col("v"))) / F.count_if(F.col("_r") <= top_n)).alias("gref"),
            F.count_if(F.col("_r") <= top_n).alias("used"),
            F.count("*").alias("eligible"),
        )
    )


def borrowed_reference(sessions: DataFrame, reference: DataFrame, entity: list[str]) -> DataFrame:
    """``entity, season, source_season, borrowed, metric, gref, used, eligible`` for every season of ``sessions``.

    A season without matches takes the latest earlier one that has some: one
    ordered window over seasons instead of an inequality join.
    """
    seasons = sessions.select(*entity, "season").distinct()
    own = reference.select(*entity, "season").distinct().withColumn("_own", F.col("season"))
    w = Window.partitionBy(*entity).orderBy("season").rowsBetween(Window.unboundedPreceding, 0)
    source = seasons.join(own, [*entity, "season"], "left").withColumn(
        "source_season", F.last("_own", ignorenulls=True).over(w)
    ).select(*entity, "season", "source_season")
    return source.join(reference.withColumnRenamed("season", "source_season"), [*entity, "source_season"]).withColumn(
        "borrowed", F.col("source_season") != F.col("season")
    )


def pct_of_reference(sessions: DataFrame, reference: DataFrame, entity: list[str], metrics: list[str], key: str = "session_id") -> DataFrame:
    """``key, metric, value, gref, pct`` for each recorded session and metric."""
    long = sessions.filter("has_gps").select(*entity, "season", key, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(
        [*entity, "season", key], metrics, "metric", "value"
    )
    return long.join(reference.select(*entity, "season", "metric", "gref"), [*entity, "season", "metric"], "left").withColumn(
        "pct", half_even(F.when(F.col("gref") != 0, F.col("value") / F.col("gref") * 100), 1)
    )


def weekly_change(labelled: DataFrame, entity: list[str], metrics: list[str], key: str = "session_id") -> DataFrame:
    """Each recorded session against the comparable one before it.

    Base: the last recorded session of the same category and label in the
    microcycle just before; else the last recorded one of the category on an
    earlier day (``fallback``); else none. Preparation days always fall back. The
    microcycle before is found by its dense number, so both bases are an
    equi-join and a window, not a search for each row.
    """
    group = [*entity, "season", "match_category"]
    order = F.dense_rank().over(Window.partitionBy(*entity, "season").orderBy(F.col("microcycle_start").asc_nulls_first()))
    rows = labelled.withColumns({"_cycle": order, "_day": day_number(F.col("date"))})
    best = F.struct("_day", key, "date", *metrics)
    gps = F.when(F.col("has_gps"), best)
    before = Window.partitionBy(*group).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_fall", F.max(gps).over(before))
    same = (
        rows.filter(F.col("has_gps") & F.col("md_offset").isNotNull())
        .groupBy(*group, "md_label", (F.col("_cycle") + 1).alias("_cycle"))
        .agg(F.max(best).alias("_same"))
    )
    joined = rows.filter("has_gps").join(same, [*group, "md_label", "_cycle"], "left")
    base = F.coalesce("_same", "_fall")
    out = joined.withColumn("_base", base)
    return out.select(
        *entity, "season", key, "date", "match_category", "md_label",
        F.col("_base.date").alias("base_date"), F.col(f"_base.{key}").alias("base_id"),
        (F.col("_same").isNull() & F.col("_fall").isNotNull()).alias("fallback"),
        *(c for m in metrics for c in (F.col(m), F.col(f"_base.{m}").alias(f"{m}_base"), pct_change(F.col(m), F.col(f"_base.{m}")).alias(f"{m}_pct"))),
    )


def shown(changes: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``changes`` whose session is in a view's ``selection``; what a selection holds twice counts once."""
    return changes.join(selection.select(*keys), keys, "left_semi")
