"""Two independent records of the same matches, held against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("opponent", "venue", "goals_for", "goals_against", "team_result")


def reconcile(labels: DataFrame, fixtures: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    """``by, date, grade, fields`` and both sides of :data:`FIELDS` as ``label_...`` and ``fixture_...``, a row for each match.

    A match is found on both sides by ``by`` and its date; several on one day are taken
    in order of their opponent and venue. ``fields`` lists what differs where both sides
    say something, and ``grade`` is the worst of it: ``contradiction`` (venue or result:
    one record is wrong), ``score`` (the same result by other goals), ``name`` (only the
    opponent), ``incomplete`` (nothing differs, but one side leaves a field out),
    ``agrees``; ``label only`` and ``fixture only`` have no other side.

    Rows without a date are matched by nothing and stay on their side.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        order = Window.partitionBy(*by, date).orderBy(*FIELDS)
        return df.select(
            *by, date, F.row_number().over(order).alias("_k"), F.struct(*(F.col(f).cast("string").alias(f) for f in FIELDS)).alias(name)
        )

    both = side(labels, "_l").join(side(fixtures, "_f"), [*by, date, "_k"], "full")
    left, right = {f: F.col(f"_l.{f}") for f in FIELDS}, {f: F.col(f"_f.{f}") for f in FIELDS}
    differs = {f: left[f] != right[f] for f in FIELDS}
    any_of = lambda *names: F.coalesce(F.greatest(*(F.coalesce(differs[f], F.lit(False)) for f in names), F.lit(False)), F.lit(False))
    gap = F.greatest(*(left[f].isNull() != right[f].isNull() for f in FIELDS))
    grade = (
        F.when(F.col("_f").isNull(), "label only").when(F.col("_l").isNull(), "fixture only")
        .when(any_of("venue", "team_result"), "contradiction").when(any_of("goals_for", "goals_against"), "score").when(any_of("opponent"), "name")
        .when(gap, "incomplete").otherwise("agrees")
    )
    return both.select(
        *by, date, grade.alias("grade"), F.concat_ws(",", *(F.when(differs[f], f) for f in FIELDS)).alias("fields"),
        *(left[f].alias(f"label_{f}") for f in FIELDS), *(right[f].alias(f"fixture_{f}") for f in FIELDS),
    )


def summary(checked: DataFrame, by: list[str]) -> DataFrame:
    """``by, grade, n``: how many matches have each grade."""
    return checked.groupBy(*by, "grade").agg(F.count("*").alias("n"))
