"""Queries of what is written: logs as versions, tables for people, the stream of daily loads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import body, comparison, players
from ..sources import pages, readers, sinks
from ..sources.files import shared_folder
from ..streaming.daily import daily_acwr_stream, run_available
from . import bindings as B
from .reference import BOD, E, SES, _r, query


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _log_rows(spark, d):
    """The sessions in the log's columns, and their number."""
    raw = B.raw_sessions(spark, d)
    kept = [(F.col(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in readers.SESSION_SCHEMA.fields]
    return raw.select("session_id", *kept)


_STORED = "date, session_kind, session_type, competition_type, was_starter, duration_min, total_distance_m, top_speed_kmh, sprints_total"


@query(f"SELECT {_STORED} FROM raw", SES)
def log_append_retry(spark, d):
    """Three appends; the second dies once before its manifest and is run again, the third is run twice."""
    rows, log = _log_rows(spark, d), sinks.session_log(spark, _folder(spark, "log"))
    part = lambda i: {"sessions": rows.filter(F.col("session_id") % 3 == i)}
    log.append(part(0), "first")
    log._stage(part(1))  # what a job leaves that dies here
    log.append(part(1), "second")
    for _ in range(2):
        log.append(part(2), "third")
    return log.read("sessions").select(*_STORED.split(", "))


@query("""SELECT date, session_kind, session_type, CASE WHEN old THEN 'removed' ELSE 'added' END AS change FROM (
  SELECT date, session_kind, session_type, bool_or(session_id % 10 <> 1) AS old, bool_or(session_id % 10 <> 0) AS new FROM raw GROUP BY 1, 2, 3) WHERE old <> new""", SES)
def log_sync(spark, d):
    """A rebuilt log replaces the stored one, with what that adds and removes, in one step."""
    rows, path = _log_rows(spark, d), _folder(spark, "log")
    sinks.save_sessions(rows.filter("session_id % 10 <> 1"), path)
    return sinks.sync(rows.filter("session_id % 10 <> 0"), path)


_UNITS = {"Peso": "kg", "Massa Gorda": "kg", "Altura": "cm"}


@query("""SELECT player_id::DOUBLE AS player_id, date, CASE WHEN month(date) >= 7 THEN year(date)::VARCHAR || '/' || lpad(((year(date) + 1) % 100)::VARCHAR, 2, '0')
      ELSE (year(date) - 1)::VARCHAR || '/' || lpad((year(date) % 100)::VARCHAR, 2, '0') END AS season_reported,
    CASE WHEN month(date) = 7 THEN 'fora de época' WHEN month(date) = 8 THEN 'pré-época' WHEN month(date) >= 9 THEN '1ª volta' WHEN month(date) <= 5 THEN '2ª volta' ELSE 'final de época' END AS phase,
    round("Peso", 1) AS "Peso (kg)", round("Massa Gorda", 1) AS "Massa Gorda (kg)", "Altura" AS "Altura (cm)", "Perímetro Cintura" FROM assessments""", BOD)
def wide_csv(spark, d):
    """Assessments written as a CSV for people, with units in its header, and read by their loader."""
    long = body.to_long(B.assessments(spark, d), ["player_id", "date"])
    unit = F.create_map(*(F.lit(x) for kv in _UNITS.items() for x in kv))
    path = _folder(spark, "wide")
    sinks.save_wide(long.withColumn("value", F.round("value", 1)).withColumn("unit", F.coalesce(unit[F.col("metric")], F.lit(""))), ["player_id", "date"], path)
    return readers.assessment_table(spark, path).drop("season")


@query(f"""SELECT player_id, date, load, acute, chronic, CASE WHEN chronic <> 0 THEN {_r('acute / chronic', 2)} END AS acwr FROM (
  SELECT player_id, date, load, CASE WHEN i >= 7 THEN sum(load) OVER near END AS acute, CASE WHEN i >= 35 THEN sum(load) OVER far / 28 * 7 END AS chronic FROM (
    SELECT s.player_id, s.date, coalesce(v.load, 0) AS load, row_number() OVER (PARTITION BY s.player_id ORDER BY s.date) AS i FROM (
      SELECT player_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM raw WHERE date <= (SELECT max(date) - 8 FROM raw) GROUP BY 1) s
    LEFT JOIN (SELECT player_id, date, sum(coalesce(total_distance_m, 0)) AS load FROM raw GROUP BY 1, 2) v USING (player_id, date))
  WINDOW near AS (PARTITION BY player_id ORDER BY date ROWS 6 PRECEDING), far AS (PARTITION BY player_id ORDER BY date ROWS BETWEEN 34 PRECEDING AND 7 PRECEDING))""", SES)
def acwr_stream(spark, d):
    """The sessions as they arrive: in three lots, some after their year's end, a fifth of them first with a wrong load, a ninth twice.

    Each lot is a run of the stream that goes on from the checkpoint of the one before.
    """
    k, day = F.col("session_id"), F.col("date")
    sent = B.raw_sessions(spark, d).select("player_id", "session_id", F.to_timestamp(F.date_add(day, 0)).alias("_day"), "total_distance_m", "date").withColumn(
        "ts", F.col("_day") + F.expr("interval 10 hours")
    )
    late = (F.month(day) == 12) & (F.dayofmonth(day) >= 27) & (k % 3 == 0)
    year = F.year(day) + F.when(late, 1).otherwise(0)
    lot = F.when(year <= 1993, 0).when(year <= 1995, 1).otherwise(2)
    # each session as it is sent: right, first wrong, twice; one pass over the sessions for all lots
    sends = F.array_compact(F.array(
        F.struct(F.lit(1).cast("long").alias("version"), F.col("total_distance_m").alias("total_distance_m")),
        F.when(k % 5 == 0, F.struct(F.lit(0).cast("long").alias("version"), F.lit(999.0).alias("total_distance_m"))),
        F.when(k % 9 == 0, F.struct(F.lit(1).cast("long").alias("version"), F.col("total_distance_m").alias("total_distance_m"))),
    ))
    home = _folder(spark, "stream")
    sent.select("player_id", "session_id", F.explode(sends).alias("s"), "ts", lot.alias("lot")).select(
        "player_id", "session_id", "s.version", "ts", "s.total_distance_m", "lot"
    ).write.partitionBy("lot").parquet(f"{home}/lots")
    schema = "player_id long, session_id long, version long, ts timestamp, total_distance_m double"
    for n in range(3):
        spark.read.schema(f"{schema}, lot int").parquet(f"{home}/lots").filter(F.col("lot") == n).drop("lot").write.mode("append").parquet(f"{home}/in")
        arriving = spark.readStream.schema(schema).parquet(f"{home}/in")
        run_available(daily_acwr_stream(arriving, E), f"{home}/out", f"{home}/checkpoint")
    return spark.read.schema("player_id long, date date, load double, acute double, chronic double, acwr double").parquet(f"{home}/out/batch=*")


# --- files and their records --------------------------------------------------


@query(f"SELECT {_STORED} FROM raw", SES)
def csv_sessions(spark, d):
    """The session log written as CSV and read by its typed reader."""
    path = _folder(spark, "csv")
    sinks.save_sessions(_log_rows(spark, d), path, "csv")
    return readers.sessions(spark, path).select(*_STORED.split(", "))


@query("""SELECT session_id, CASE WHEN was_starter IS NULL THEN NULL ELSE was_starter END AS started FROM raw""", SES)
def starter_flags(spark, d):
    """The sheet's SIM and NÃO, in any case and with blanks, as booleans."""
    word = F.when(F.col("was_starter"), F.when(F.col("session_id") % 2 == 0, " sim ").otherwise("SIM")).when(~F.col("was_starter"), "Não")
    return B.raw_sessions(spark, d).select("session_id", text.yes(word).alias("started"))


_MADE = """persons AS (SELECT l_orderkey AS order_id, l_linenumber AS n, l_partkey AS part, l_suppkey AS supplier, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, l_quantity AS q FROM lineitem)"""


def _orders(spark, d):
    keep = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sort_array(F.collect_list(F.struct(*keep))).alias("v"))


@query("""SELECT order_id, n::VARCHAR AS number, 'Jogador ' || part AS name, 'https://site/jogador/p' || part || '/' || supplier AS profile_url, CASE WHEN part % 2 = 0 THEN '/f/' || part || '.png' END AS photo_url,
    'https://site/estatisticas/p' || part || '-equipa/p' || supplier || '-t77?filter_match=in_with' AS stats_url FROM persons WHERE part % 5 <> 0""", _MADE)
def squad_people(spark, d):
    """A squad page for each order, a person for each of its lines, some without a link; and where each one's statistics are."""
    person = lambda x: F.concat(
        F.lit("<div class='staff'><div class='number'>"), x["l_linenumber"].cast("string"), F.lit("</div>"),
        F.when(x["l_partkey"] % 2 == 0, F.concat(F.lit("<div class='photo' style=\"background:url('/f/"), x["l_partkey"].cast("string"), F.lit(".png')\"></div>"))).otherwise(""),
        F.lit("<div class='name'><div class='micrologo_and_text'><div class='logo'><a name='x'></a></div><div class='text'>"),
        F.when(x["l_partkey"] % 5 != 0, F.concat(F.lit("<a href='/jogador/p"), x["l_partkey"].cast("string"), F.lit("/"), x["l_suppkey"].cast("string"), F.lit("'>"))).otherwise("<b>"),
        F.lit("Jogador "), x["l_partkey"].cast("string"), F.lit("</a></div></div></div></div>"),
    )
    made = _orders(spark, d).select("order_id", F.concat(F.lit("<body><div>"), F.array_join(F.transform("v", person), ""), F.lit("</div>")).alias("html"))
    found = pages.squads(made, "order_id", "html", "https://site")
    return found.withColumn("stats_url", text.team_stats_url(F.col("profile_url"), F.lit("equipa"), F.lit("77"), "https://site"))


@query("""SELECT order_id, 'Total' AS "Competition", sum(q)::BIGINT::VARCHAR AS "J" FROM persons GROUP BY 1""", _MADE)
def player_totals(spark, d):
    """A table of competitions for each order, with a nameless first column and a total, of which the total is read."""
    row = lambda x: F.concat(F.lit("<tr><td>Liga "), x["l_linenumber"].cast("string"), F.lit("<td>"), x["l_quantity"].cast("long").cast("string"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x["l_quantity"].cast("long")).cast("string")
    made = _orders(spark, d).select(
        "order_id", F.concat(F.lit("<div id='team_games'><table class='zztable'><tr><th><th>J</tr>"), F.array_join(F.transform("v", row), ""), F.lit("<tr><td><td><b>"), total, F.lit("</b></table></div>")).alias("html"),
    )
    cells = pages.player_stats(made, "order_id", "html")
    return players.totals(cells.groupBy("order_id", "row").pivot("name", ["Competition", "J"]).agg(F.first("value"))).drop("row")


@query("SELECT player_id, date, metric, value / 10 AS value, value AS value_original, 'sim' AS corrected, 'decimal point' AS correction_note FROM long_body WHERE metric = 'Altura' AND value > 220", BOD)
def applied_corrections(spark, d):
    rows = body.to_long(B.assessments(spark, d), ["player_id", "date"])
    fixes = rows.filter("metric = 'Altura' and value > 220").select("player_id", "date", "metric", (F.col("value") / 10).alias("corrected_value"), F.lit("decimal point").alias("why"))
    return body.applied_corrections(body.corrected(rows, fixes, E))


@query("""SELECT player_id, date, metric, value, 'raw' AS origin FROM long_body WHERE metric <> 'Altura' OR player_id % 3 <> 0
  UNION ALL SELECT player_id, date, metric, value + 1, 'derived' FROM long_body l WHERE metric = 'Altura' AND player_id % 3 = 0""", BOD)
def raw_over_derived(spark, d):
    """Measured values, and computed ones only of metrics that a player has none of."""
    rows = body.to_long(B.assessments(spark, d), ["player_id", "date"])
    raw = rows.filter("metric <> 'Altura' or player_id % 3 <> 0").withColumn("origin", F.lit("raw"))
    return body.prefer_raw(raw, rows.withColumns({"value": F.col("value") + 1, "origin": F.lit("derived")}), E)


@query("""SELECT player_id, date, metric, value + 2 AS value, DATE '2000-01-03' AS report_date, 'b.pdf' AS source_file FROM long_body""", BOD)
def newest_report(spark, d):
    """Each value as the newest of the reports that print it has it."""
    rows = body.to_long(B.assessments(spark, d), ["player_id", "date"])
    prints = F.array(*(F.struct(F.lit(x).cast("date").alias("report_date"), F.lit(f).alias("source_file"), F.lit(k).alias("k")) for x, f, k in (("2000-01-01", "a.pdf", 0), ("2000-01-03", "c.pdf", 9), ("2000-01-03", "b.pdf", 2), ("1999-01-01", "z.pdf", 5))))
    printed = rows.select("*", F.inline(prints)).withColumn("value", F.col("value") + F.col("k")).drop("k")
    return body.newest_report(printed, ["player_id", "date", "metric"])


@query("""SELECT session_id, strftime(date, '%b %Y') AS month_label, strftime(date, '%d %b %Y') AS day_label, strftime(date, '%Y-%m') AS month_key FROM sessions""", SES)
def date_labels(spark, d):
    day = F.col("date")
    return B.sessions(spark, d).select("session_id", dates.month_label(day).alias("month_label"), dates.day_label(day).alias("day_label"), dates.month_key(day).alias("month_key"))


@query("SELECT session_id, total_distance_m FROM sessions WHERE match_category = 'official_match' AND has_gps", SES)
def shown_sessions(spark, d):
    rows = B.sessions(spark, d)
    picked = rows.filter("match_category = 'official_match'")
    return comparison.shown(rows.filter("has_gps").select("session_id", "total_distance_m"), picked.union(picked), ["session_id"])
