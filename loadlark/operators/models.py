"""Small models of one measurement from the others of its row, scored by leaving each row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_even

# The candidates' names, each with its number of fitted parameters, in the order that settles ties.
OFFSET, RATIO, LINE, BALANCE = "desvio constante", "rácio constante", "regressão linear", "balanço de massa"
CANDIDATES = ((OFFSET, 1), (RATIO, 1), (LINE, 2), (BALANCE, 0))


def _fits(total: dict[str, Column], distinct: Column) -> dict[str, tuple[Column, Column]]:
    """Intercept and slope of each fitted candidate from sums over its rows."""
    n, nz, sx, sy, sxx, sxy, sr = (total[k] for k in ("n", "nz", "x", "y", "xx", "xy", "r"))
    slope = F.when(distinct > 1, F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx))
    return {OFFSET: (F.try_divide(sy - sx, n), F.lit(1.0)), RATIO: (F.lit(0.0), F.try_divide(sr, nz)), LINE: (F.try_divide(sy - slope * sx, n), slope)}


def _paired(wide: DataFrame, by: list[str], x: str, y: str, balance: Column) -> tuple[DataFrame, dict[str, Column]]:
    """Rows that have both sides, each with its entity's sums; the row's own share of every sum."""
    rows = wide.select(*by, F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"), balance.cast("double").alias("balance"))
    rows = rows.filter("x is not null and y is not null")
    share = {
        "n": F.lit(1.0), "nz": F.when(F.col("x") != 0, 1.0).otherwise(0.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"),
        "xy": F.col("x") * F.col("y"), "r": F.when(F.col("x") != 0, F.col("y") / F.col("x")).otherwise(0.0),
    }
    w = Window.partitionBy(*by)
    alike = F.count("*").over(Window.partitionBy(*by, "x"))
    sums = rows.withColumns({f"t_{k}": F.sum(c).over(w) for k, c in share.items()} | {"_alike": alike, "_first": F.row_number().over(Window.partitionBy(*by, "x").orderBy("y"))})
    return sums.withColumn("t_distinct", F.sum(F.when(F.col("_first") == 1, 1).otherwise(0)).over(w)), share


def scoreboard(wide: DataFrame, by: list[str], x: str, y: str, balance: Column) -> DataFrame:
    """``by, model, n_params, loo_mae_pp, loo_max_pp, n_paired, a, b, rank``: each candidate for ``y``, the best first.

    Three candidates are fitted to ``x``: a constant difference, a constant ratio, a
    line. ``balance`` is a candidate over other columns with nothing to fit. A row's
    error is that of the fit to all others, whose sums are the entity's less the row's
    own share: one window, no self-join. A fit needs two rows more than it has
    parameters; a row that a candidate can't be fitted without, or can't say anything
    of, doesn't count for it. Errors are rounded before they are ranked; of equal ones
    the candidate with fewer parameters wins. ``y`` is ``a + b * x`` from all rows, both
    null for ``balance``.
    """
    rows, share = _paired(wide, by, x, y, balance)
    left = _fits({k: F.col(f"t_{k}") - c for k, c in share.items()}, F.col("t_distinct") - F.when(F.col("_alike") == 1, 1).otherwise(0))
    whole = _fits({k: F.max(f"t_{k}") for k in share}, F.max("t_distinct"))
    others = F.col("t_n") > 1
    errors = rows.withColumns(
        {f"e{i}": F.abs((F.col("balance") if m == BALANCE else left[m][0] + left[m][1] * F.col("x")) - F.col("y")) for i, (m, _) in enumerate(CANDIDATES)}
    )
    board = errors.groupBy(*by).agg(
        F.max("t_n").cast("long").alias("n_paired"),
        F.array(*(
            F.struct(
                F.lit(m).alias("model"), F.lit(p).alias("n_params"), half_even(F.avg(F.when(others, F.col(f"e{i}"))), 3).alias("loo_mae_pp"),
                half_even(F.max(F.when(others, F.col(f"e{i}"))), 3).alias("loo_max_pp"), F.lit(i).alias("place"),
                (F.lit(None).cast("double") if m == BALANCE else whole[m][0]).alias("a"), (F.lit(None).cast("double") if m == BALANCE else whole[m][1]).alias("b"),
            )
            for i, (m, p) in enumerate(CANDIDATES)
        )).alias("all"),
    )
    listed = board.select(*by, "n_paired", F.inline("all")).filter("loo_mae_pp is not null and (n_params = 0 or n_paired >= n_params + 2)")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("loo_mae_pp", "n_params", "place"))
    return listed.withColumn("rank", rank).select(*by, "model", "n_params", "loo_mae_pp", "loo_max_pp", "n_paired", "a", "b", "rank")


def predicted(wide: DataFrame, by: list[str], x: str, y: str, balance: Column, name: str = "model_value") -> DataFrame:
    """``wide`` with what its entity's best candidate says of each row, that candidate's name and its error.

    Null where the entity has no candidate, or the row lacks what it needs.
    """
    best = scoreboard(wide, by, x, y, balance).filter("rank = 1").select(*by, F.col("model").alias(f"{name}_model"), F.col("loo_mae_pp").alias(f"{name}_error"), "a", "b")
    says = F.when(F.col(f"{name}_model") == BALANCE, balance).otherwise(F.col("a") + F.col("b") * F.col(f"`{x}`").cast("double"))
    return wide.join(best, by, "left").withColumn(name, says).drop("a", "b")
