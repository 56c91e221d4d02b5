"""Writers: the session log and the fixtures as versions of a :class:`~loadlark.sources.log.Log`; CSV where a file is for people."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import phase, season
from ..operators.asof import diff
from .log import Log, Version
from .readers import PLAYED_SCHEMA, REMAINING_SCHEMA, SESSION_SCHEMA

KINDS = ("game", "training")
CHANGE_KEYS = ["date", "session_kind", "session_type"]


def session_log(spark: SparkSession, path: str) -> Log:
    """``sessions``, and ``changes``: what the last sync added and removed."""
    return Log(spark, path, {"sessions": SESSION_SCHEMA, "changes": "date date, session_kind string, session_type string, change string"})


def fixture_log(spark: SparkSession, path: str) -> Log:
    return Log(spark, path, {"played": PLAYED_SCHEMA, "remaining": REMAINING_SCHEMA})


def save_sessions(df: DataFrame, path: str, fmt: str = "parquet") -> Version | None:
    """Replaces the log, with its columns in their fixed order; as CSV, a plain folder of files."""
    if fmt == "csv":
        df.select(*(f.name for f in SESSION_SCHEMA.fields)).write.mode("overwrite").option("header", True).csv(path)
        return None
    return session_log(df.sparkSession, path).replace({"sessions": df})


def append_session(spark: SparkSession, row: dict, path: str, token: str | None = None) -> Version:
    """Adds one session, checked before anything is written; once for a token."""
    if not isinstance(row.get("date"), date) or row.get("session_kind") not in KINDS:
        raise ValueError(f"a session needs a date and a session_kind of {KINDS}")
    names = [f.name for f in SESSION_SCHEMA.fields]
    if unknown := set(row) - set(names):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    values = [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in (row.get(n) for n in names)]
    return session_log(spark, path).append({"sessions": spark.createDataFrame([tuple(values)], SESSION_SCHEMA)}, token)


def save_fixtures(played: DataFrame, remaining: DataFrame, folder: str) -> Version:
    """Replaces both tables in one step."""
    return fixture_log(played.sparkSession, folder).replace({"played": played, "remaining": remaining})


def wide(long: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and one ``metric (unit)`` column for each metric, in the order of their first dates; a metric has the unit of its first date."""
    firsts = long.groupBy("metric").agg(F.min("date").alias("d"), F.min_by("unit", F.struct("date", "unit")).alias("u"))
    heads = [(r["metric"], f"{r['metric']} ({r['u']})" if r["u"] else r["metric"]) for r in firsts.orderBy("d", "metric").collect()]  # a metric list
    table = long.groupBy(*keys).pivot("metric", [m for m, _ in heads]).agg(F.max_by("value", "date"))
    return table.select(*keys, *(F.col(f"`{m}`").alias(h) for m, h in heads))


def save_wide(long: DataFrame, keys: list[str], path: str, fmt: str = "csv") -> None:
    """:func:`wide` with ``season`` and ``phase`` behind the date; as CSV, in order of the keys, missing values empty."""
    table = wide(long, keys)
    if "date" in keys:
        at = keys.index("date") + 1
        dated = [*keys[:at], season(F.col("date")).alias("season"), phase(F.col("date")).alias("phase"), *keys[at:]]
        table = table.select(*dated, *(F.col(f"`{c}`") for c in table.columns if c not in keys))
    writer = table.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
    writer.option("header", True).option("emptyValue", "").csv(path) if fmt == "csv" else writer.parquet(path)


def sync(new: DataFrame, path: str, write: bool = True) -> DataFrame:
    """What a rebuilt log adds to and removes from the stored one; replaces it, in one step with its changes, if asked to."""
    log = session_log(new.sparkSession, path)
    now = log.version()
    changes = diff(log.read("sessions", now), new, CHANGE_KEYS)
    if not write:
        return changes
    return log.read("changes", log.replace({"sessions": new, "changes": changes}, now))
