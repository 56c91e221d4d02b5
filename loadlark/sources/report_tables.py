"""Tables in the text of assessment reports.

A page is walked once as an array of its lines. The first line with two dates or
more heads the table; it ends at the first line that starts with a stop word. In
between, a line with a value behind a label is a row: its values are counted from
the first one, as many as there are dates, and what follows is the reference. A
line without any value continues the label of the row before it. All of it is
expressions over the line arrays: a page stays in its row until its table is
taken apart, so nothing is shuffled.

Defined cases: a null or empty page, or one without such a head, gives no rows; a
dash, and anything else that isn't a number, is no value; a continuation before
the first row, a line that starts with a value and section headers are passed
over; fewer values than dates belong to the first dates; rows without a value
for any date are left out; a text that stands twice gives its rows twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_unit

# How dates and values are printed, and the words of the printed reports.
DATE, VALUE = r"^\d{2}-\d{2}-\d{4}$", r"^-$|^\d+[.,]?\d*$"
SECTIONS = ("AVALIAÇÃO ANTROPOMÉTRICA", "PREGAS E PERÍMETROS")
STOPS = ("Página", "Impresso em", "Processado por")

_LABEL = "struct<metric:string,unit:string>"


def _named(label: Column) -> Column:
    """``struct<metric, unit>`` of a label: a last pair of brackets is the unit."""
    clean = F.btrim(label)
    return F.struct(
        F.btrim(strip_unit(clean)).alias("metric"), F.regexp_extract(clean, r"\(([^()]*)\)$", 1).alias("unit")
    ).cast(_LABEL)


def _continued(name: Column, line: Column) -> Column:
    """The label with one more line: the unit goes back into it before it is read anew."""
    whole = F.when(name["unit"] != "", F.concat(name["metric"], F.lit(" ("), name["unit"], F.lit(")"))).otherwise(name["metric"])
    return _named(F.concat_ws(" ", whole, line))


def _from(xs: Column, start: Column | int, length: Column) -> Column:
    """Up to ``length`` entries of ``xs`` from ``start`` (1 is the first) on; empty for no length."""
    return F.slice(xs, start if isinstance(start, Column) else F.lit(start), F.greatest(length, F.lit(0)))


def report_rows(texts: DataFrame, key: str, column: str, stops: tuple[str, ...] = STOPS, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """``key, line, metric, unit, dates, values, reference`` of each row of a page's table; values are text, as printed."""
    dated = lambda words: F.filter(words, lambda w: w.rlike(DATE))
    lines = F.filter(F.transform(F.split(column, "\n"), lambda x: F.split(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")), lambda w: w[0] != "")
    pages = texts.select(F.col(key), lines.alias("_lines")).withColumn(
        "_head", F.array_position(F.transform("_lines", lambda w: F.size(dated(w)) >= 2), True)
    )
    said = lambda w: F.array_join(w, " ")
    stopped = lambda w: F.exists(F.array(*map(F.lit, stops)), lambda s: said(w).startswith(s)) if stops else F.lit(False)
    tables = (
        pages.filter("_head > 0")
        .withColumn("dates", dated(F.get("_lines", (F.col("_head") - 1).cast("int"))))
        .withColumn("_body", _from(F.col("_lines"), (F.col("_head") + 1).cast("int"), F.size("_lines")))
        .withColumn("_stop", F.array_position(F.transform("_body", stopped), True).cast("int"))
        .withColumn("_body", F.when(F.col("_stop") > 0, _from(F.col("_body"), 1, F.col("_stop") - 1)).otherwise(F.col("_body")))
        .withColumn("_body", F.filter("_body", lambda w: ~F.upper(said(w)).isin(*sections)))
        # where a line's first value stands: 0 for none, 1 for a line without a label
        .withColumn("_first", F.transform("_body", lambda w: F.array_position(F.transform(w, lambda x: x.rlike(VALUE)), True).cast("int")))
        .withColumn("_rows", F.filter(F.sequence(F.lit(0), F.size("_body")), lambda i: F.coalesce(F.get("_first", i) > 1, F.lit(False))))
    )

    def row(at: Column, number: Column) -> Column:
        until = F.coalesce(F.get("_rows", number + 1), F.size("_body"))
        words, first = F.get("_body", at), F.get("_first", at)
        more = F.filter(
            F.arrays_zip(_from(F.col("_body"), at + 2, until - at - 1).alias("w"), _from(F.col("_first"), at + 2, until - at - 1).alias("f")), lambda x: x["f"] == 0
        )
        n = F.size("dates")
        return F.struct(
            number.alias("line"),
            F.aggregate(more, _named(said(_from(words, 1, first - 1))), lambda name, x: _continued(name, said(x["w"]))).alias("name"),
            _from(words, first, n).alias("values"), said(_from(words, first + n, F.size(words))).alias("reference"),
        )

    return tables.select(key, "dates", F.explode(F.transform("_rows", row)).alias("r")).select(
        key, "r.line", "r.name.metric", "r.name.unit", "dates", "r.values", "r.reference"
    )


def report_tables(texts: DataFrame, key: str, column: str, stops: tuple[str, ...] = STOPS, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """``key, line, date, metric, unit, value, reference``: one row for each number of a page's table."""
    cells = report_rows(texts, key, column, stops, sections).select(
        key, "line", "metric", "unit", "reference", F.explode(F.arrays_zip("dates", F.col("values").alias("printed"))).alias("c")
    )
    value = F.regexp_replace("c.printed", ",", ".").try_cast("double")
    return cells.select(
        key, "line", F.try_to_date("c.dates", "dd-MM-yyyy").alias("date"), "metric", "unit", value.alias("value"), "reference"
    ).filter("date is not null and value is not null")
