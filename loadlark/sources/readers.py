"""Readers. Schemas are declared; a path that isn't there gives an empty typed table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.dates import season
from ..functions.numbers import numeric
from .log import Log

_D, _S = T.DoubleType(), T.StringType()
SESSION_SCHEMA = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("date", T.DateType()), ("session_kind", _S), ("week", _D), ("month", _D), ("session_type", _S), ("competition_type", _S),
            ("was_starter", T.BooleanType()), ("duration_min", _D), ("minutes_game_zerozero", _D), ("total_distance_m", _D),
            ("sprint_distance_m", _D), ("high_speed_distance_m", _D), ("distance_per_min", _D), ("top_speed_kmh", _D),
            ("sprints_1st_half", _D), ("sprints_2nd_half", _D), ("sprints_total", _D), ("accelerations", _D), ("decelerations", _D),
            ("calories", _D), ("notes", _S),
        ]
    ]
)
FIXTURE_SCHEMA = "`Result - abv` string, Date date, Hour string, Location string, Team1 string, Team2 string, Result string, Competition string, Matchweek string, `Played?` boolean"
REMAINING_SCHEMA = "matchweek_number int, home_team string, away_team string"
PLAYED_SCHEMA = f"{REMAINING_SCHEMA}, home_goals int, away_goals int, winner string"
MEASUREMENT_SCHEMA = "date date, metric string, unit string, value double, value_original double, corrected string, correction_note string, reference string, source_file string"


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """A CSV with a header, columns found by name."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    try:
        text = spark.read.csv(path, header=True, enforceSchema=False)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    have = set(text.columns)

    def typed(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            return numeric(c).alias(f.name)
        return (c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name)

    return text.select(*map(typed, schema.fields))


def sessions(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, SESSION_SCHEMA)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that are there, in any file system that the session knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return [p for p in paths if place(p).getFileSystem(conf).exists(place(p))]


def team_fixtures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw fixtures of many teams, typed; teams without a file are left out.

    The team's slug is the file's name without its ending.
    """
    schema = T._parse_datatype_string(FIXTURE_SCHEMA)
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("team_slug", _S)]))
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(_fixtures)?\.csv$", 1)
    text = spark.read.csv(there, header=True)
    have = set(text.columns)
    typed = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast("string")).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return text.select(*typed, name.alias("team_slug"))


def processed_fixtures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(played, remaining)`` as :func:`~loadlark.sources.sinks.save_fixtures` left them last, of one version; empty if it never ran."""
    log = Log(spark, folder, {"played": PLAYED_SCHEMA, "remaining": REMAINING_SCHEMA})
    now = log.version()
    return log.read("played", now), log.read("remaining", now)


def stale(spark: SparkSession, sources: list[str], output: str) -> bool:
    """Whether ``output`` is missing or older than one of ``sources``; sources that aren't there don't count."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def changed(p: str) -> int:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).getFileStatus(path).getModificationTime()

    if not existing(spark, [output]):
        return True
    return any(changed(p) > changed(output) for p in existing(spark, sources))


def own_view(fixtures: DataFrame) -> DataFrame:
    """Played fixtures from the tracked team's side: venue, opponent, goals for and against."""
    goals = F.split("Result", "-")
    left, right = F.get(goals, F.lit(0)).try_cast("int"), F.get(goals, F.lit(1)).try_cast("int")
    home = F.col("Location") == "(C)"
    gf, ga = F.when(home, left).otherwise(right), F.when(home, right).otherwise(left)
    return fixtures.filter(F.col("Played?") & F.col("Date").isNotNull()).select(
        F.col("Date").alias("fixture_date"), F.col("Competition").alias("competition"), F.col("Matchweek").alias("matchweek"),
        F.when(home, "home").otherwise("away").alias("venue"), F.col("Team2").alias("opponent"), gf.alias("goals_for"), ga.alias("goals_against"),
        F.col("Result").alias("scoreline"), F.when(gf > ga, "W").when(gf < ga, "L").when(gf == ga, "D").alias("team_result"),
    )


def body_measurements(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, MEASUREMENT_SCHEMA)


#: Columns of assessment files that hold text; every other one but dates is a number.
_WORDS = {"season", "phase", "group", "metric", "unit", "note", "reference", "source_file", "corrected", "correction_note", "meaningful_change", "verdict"}


def assessment_table(spark: SparkSession, path: str, least: str = "date date, season string") -> DataFrame:
    """One of the assessment files (measurements, wide, derived, changes, season summaries), whatever metrics it has.

    The file's season is kept as ``season_reported``; ``season`` follows from the
    date, and rows without a date (summaries) have none. A path that isn't there
    gives no rows, with the columns of ``least``.
    """
    if existing(spark, [path]):
        text = spark.read.csv(path, header=True, encoding="UTF-8")
        kind = lambda c: "date" if c == "date" or c.endswith("_date") else "string" if c in _WORDS else "double"
        as_is = {"date": lambda c: c.try_cast("date"), "string": lambda c: c, "double": numeric}
        rows = text.select(*(as_is[kind(c)](F.col(f"`{c}`")).alias(c) for c in text.columns))
    else:
        rows = spark.createDataFrame([], least)
    rows = rows.withColumnRenamed("season", "season_reported")
    return rows.withColumn("season", season(F.col("date"))) if "date" in rows.columns else rows


def report_binaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, content`` of each PDF below folders, matching patterns or named outright; each once."""
    exact = [p for p in paths if re.search(r"[*?\[]", p)] + existing(spark, [p for p in paths if not re.search(r"[*?\[]", p)])
    none = spark.createDataFrame([], "path string, content binary")
    if not exact:
        return none
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(exact)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return none
    return found.select("path", "content")


def report_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path`` of each PDF as :func:`report_binaries` finds them; contents aren't read."""
    return report_binaries(spark, paths).select("path").distinct()


def report_facts(pages: DataFrame, key: str, page: str, column: str) -> DataFrame:
    """``key, table_text, age, sex`` of reports given as the text of their pages: of each fact the first page that has it."""
    text, upper = F.col(column), F.upper(column)
    age = F.regexp_extract(text, r"(\d{1,3})\s*Anos", 1).try_cast("int")
    sex = F.when(text.contains("Masculino"), "M").when(text.contains("Feminino"), "F")
    table = F.when(upper.contains("PREGAS") & upper.rlike("ANTROPOM|ATROPOM"), text)
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(page)))
    return pages.groupBy(key).agg(first(table).alias("table_text"), first(age).alias("age"), first(sex).alias("sex"))


SEASON_SCHEMA = "key string, label string, competition_name string, primary_team string, teams map<string,string>, team_name_mapping map<string,string>"


def seasons(spark: SparkSession, path: str) -> DataFrame:
    """The registry of seasons, a JSON list; ``teams`` gives each team's page, ``team_name_mapping`` the team of each printed name."""
    return spark.read.schema(SEASON_SCHEMA).json(path, multiLine=True)


def one_season(registry: DataFrame, key: str) -> Row:
    found = registry.filter(F.col("key") == key).head()
    if found is None:
        raise KeyError(f"no season {key!r}; there are {', '.join(r['key'] for r in registry.select('key').orderBy('key').collect())}")
    return found


def with_season_key(rows: DataFrame, registry: DataFrame, label: str = "season") -> DataFrame:
    """``rows`` with the ``season_key`` of the registry whose years are those of a label such as ``2025/26``; else null."""
    keys = registry.select(F.regexp_replace(F.regexp_extract("key", r"(\d{4}_\d{2})$", 1), "_", "/").alias(label), F.col("key").alias("season_key"))
    return rows.join(keys.groupBy(label).agg(F.min("season_key").alias("season_key")), label, "left")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """``date, metric, corrected_value, why`` of a JSON list."""
    schema = "date date, metric string, value double, why string"
    try:
        rows = spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], schema)
    return rows.withColumnRenamed("value", "corrected_value")
