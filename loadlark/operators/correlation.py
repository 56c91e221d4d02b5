"""Rank correlation of every pair of metrics, with false discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import reliability
from ..functions.numbers import half_even
from ..functions.special import rank_correlation_p

# Pairs at which a coefficient is worth trusting, a strong one, and the verdicts.
TRUSTED, STRONG, PERFECT = 8, 0.5, 0.99
NOTHING, SOME = "Nothing here separates from chance.", "%d of %d pairs survive false-discovery correction."


def spearman_grid(left: DataFrame, right: DataFrame, by: list[str], on: list[str], least: int = 4) -> DataFrame:
    """``by, body_metric, load_metric, n, rho, tier``: correlation of ranks (ties share their mean rank).

    ``left`` and ``right`` are long: ``by, on, metric, value``. Pairs with fewer
    than ``least`` values, or a constant side, are left out.
    """
    a = left.select(*by, *on, F.col("metric").alias("body_metric"), F.col("value").alias("x"))
    b = right.select(*by, *on, F.col("metric").alias("load_metric"), F.col("value").alias("y"))
    pairs = a.join(b, [*by, *on]).filter("x is not null and y is not null")
    group = [*by, "body_metric", "load_metric"]
    mean_rank = lambda c: F.rank().over(Window.partitionBy(*group).orderBy(c)) + (F.count("*").over(Window.partitionBy(*group, c)) - 1) / 2
    ranked = pairs.withColumns({"rx": mean_rank("x"), "ry": mean_rank("y")})
    stats = ranked.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"), F.sum(F.col("rx") * F.col("ry")).alias("sxy"),
        F.sum(F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("ry") * F.col("ry")).alias("syy"),
    )
    n = F.col("n")
    # ranks are halves, so the sums are exact whatever their order
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    kept = stats.filter((n >= max(3, least)) & (vx > 0) & (vy > 0))
    return kept.select(*group, "n", (cov / (F.sqrt(vx) * F.sqrt(vy))).alias("_rho")).select(
        *group, "n", half_even(F.col("_rho"), 3).alias("rho"), F.col("_rho").alias("rho_exact"), reliability(F.col("n")).alias("tier")
    )


def with_p(grid: DataFrame) -> DataFrame:
    return grid.withColumn("p", half_even(rank_correlation_p(F.col("rho_exact"), F.col("n")), 4))


def benjamini_hochberg(grid: DataFrame, by: list[str], keys: list[str], p: str = "p") -> DataFrame:
    """Adds ``q`` and ``survives`` (q below 0.05) within ``by``."""
    up = Window.partitionBy(*by).orderBy(p, *keys)
    n = F.count(p).over(Window.partitionBy(*by))
    ranked = grid.withColumns({"_r": F.row_number().over(up), "_n": n})
    later = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in (p, *keys))).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(later))
    return ranked.withColumn("q", half_even(q, 4)).withColumn("survives", F.col("q") < 0.05).drop("_r", "_n")


def findings(grid: DataFrame, by: list[str]) -> DataFrame:
    """What a grid with ``q`` says, a row for each ``by``.

    ``tested, survivors, best_n``; ``underpowered``: no pair reaches the size that is
    worth trusting; ``strong`` survivors; ``suspect_survivors``: those in a perfect
    order of too few points; ``verdict``; and the pair with the greatest coefficient,
    survivor or not (of equal ones the first by name), with its ``rho``, ``n`` and
    ``tier``. An entity without any pair has no row.
    """
    size = F.abs("rho")
    strongest = F.min_by(F.struct("body_metric", "load_metric", "rho", "n", "tier"), F.struct(-size, "body_metric", "load_metric"))
    counts = grid.groupBy(*by).agg(
        F.count("*").alias("tested"), F.count_if("survives").alias("survivors"), F.max("n").alias("best_n"),
        F.count_if(F.col("survives") & (size >= STRONG)).alias("strong"),
        F.count_if(F.col("survives") & (size >= PERFECT) & (F.col("n") < TRUSTED)).alias("suspect_survivors"), strongest.alias("s"),
    )
    return counts.select(
        *by, "tested", "survivors", "best_n", (F.col("best_n") < TRUSTED).alias("underpowered"), "strong", "suspect_survivors",
        F.when(F.col("survivors") == 0, NOTHING).otherwise(F.format_string(SOME, "survivors", "tested")).alias("verdict"),
        *(F.col(f"s.{c}").alias(f"strongest_{c}") for c in ("body_metric", "load_metric", "rho", "n", "tier")),
    )


def coverage(assessments: DataFrame, by: list[str], needed: int = 8, least: int = 4) -> DataFrame:
    """How many assessments have sessions in their window, and whether they are enough to analyse."""
    paired = F.col("sessions_in_window") > 0
    n = F.count_if(paired)
    return assessments.groupBy(*by).agg(
        F.count("*").alias("assessments"), n.alias("paired"), F.greatest(F.lit(0), needed - n).alias("shortfall"),
        (n >= least).alias("analysable"), (n >= needed).alias("well_powered"), F.min(F.when(paired, F.col("date"))).alias("first_paired"),
    )
