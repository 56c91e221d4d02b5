"""One query for each operator over the driver tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes, dates
from ..functions.numbers import half_even
from ..operators import comparison, load, microcycles, summaries
from ..operators import sessions as S
from . import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
E = B.ENTITY
_found: dict[str, tuple[Query, str | None]] = {}


def _r(x: str, places: int = 0) -> str:
    scale = f"{10**places}.0::DOUBLE"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def _with(*tables: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(t.strip() for t in tables)


def query(oracle: str | None = None, *tables: str):
    """Registers a query, with its oracle over the named common tables."""

    def add(f: Query) -> Query:
        _found[f.__name__] = f, (f"{_with(*tables)}\n{oracle}" if tables else oracle) if oracle else None
        return f

    return add


SES, MAT, BOD = B.SQL, B.MATCHES_SQL, B.ASSESSMENTS_SQL
MEASURES = ("total_distance_m", "hsr_sprint_m", "sprint_distance_m", "hia", "accelerations", "decelerations")

# --- sessions ---------------------------------------------------------------


@query("SELECT session_id, match_category FROM sessions", SES)
def match_category(spark, d):
    raw = B.raw_sessions(spark, d)
    return raw.select("session_id", classes.match_category(F.col("session_kind"), F.col("competition_type")).alias("match_category"))


@query(
    """SELECT session_id, season, CASE WHEN month(date) >= 8 THEN year(date) ELSE year(date) - 1 END AS report_year,
    CASE WHEN month(date) = 7 THEN 'fora de época' WHEN month(date) = 8 THEN 'pré-época' WHEN month(date) >= 9 THEN '1ª volta'
      WHEN month(date) <= 5 THEN '2ª volta' ELSE 'final de época' END AS phase, date - dayofweek(date)::INT AS week_start FROM sessions""", SES)
def season_label(spark, d):
    day = F.col("date")
    return B.sessions(spark, d).select(
        "session_id", "season", F.substring(dates.season(day, dates.REPORT_SEASON_MONTH), 1, 4).cast("int").alias("report_year"),
        dates.phase(day).alias("phase"), dates.week_start(day).alias("week_start"),
    )


_CLEAN = ("session_id", "match_category", "season", "unused_sub", "has_gps", "minutes_played", "short_appearance", "total_distance_m", "top_speed_kmh",
          "duration_min", "hsr_sprint_m", "hsr_m", "hia", "m_per_min")


@query(f"SELECT {', '.join(_CLEAN)} FROM sessions", SES)
def clean_sessions(spark, d):
    return B.sessions(spark, d).select(*_CLEAN)


_OFFICIAL = """official AS (SELECT *, CASE WHEN minutes_game_zerozero > 0 THEN minutes_game_zerozero WHEN duration_min > 0 THEN duration_min END AS official_minutes,
  CASE WHEN minutes_game_zerozero > 0 THEN 'match_sheet' WHEN duration_min > 0 THEN 'gps_runtime' ELSE 'none' END AS minutes_source FROM sessions)"""


@query("SELECT session_id, official_minutes, minutes_source, coalesce(official_minutes < 20, false) AS short_appearance FROM official", SES, _OFFICIAL)
def official_minutes(spark, d):
    return S.flag_short(S.official_minutes(B.sessions(spark, d))).select("session_id", "official_minutes", "minutes_source", "short_appearance")


_P90 = ", ".join(f"CASE WHEN official_minutes > 0 THEN {_r(f'{m} / official_minutes * 90', 2)} END AS {m}_per90" for m in S.PER90)


@query(f"SELECT session_id, {_P90} FROM official", SES, _OFFICIAL)
def per90_official(spark, d):
    return S.per90(S.official_minutes(B.sessions(spark, d)), "official_minutes").select("session_id", *(f"{m}_per90" for m in S.PER90))


@query(f"""SELECT session_id, CASE WHEN total_distance_m > 0 THEN {_r('high_speed_distance_m / total_distance_m * 100', 2)} END AS hsr_share_pct,
  CASE WHEN total_distance_m > 0 THEN {_r('sprint_distance_m / total_distance_m * 100', 2)} END AS sprint_share_pct FROM sessions""", SES)
def intensity_ratios(spark, d):
    return S.intensity_ratios(B.sessions(spark, d)).select("session_id", "hsr_share_pct", "sprint_share_pct")


@query(f"""SELECT *, CASE WHEN accel_decel_ratio IS NULL THEN 'Unknown' WHEN accel_decel_ratio < 0.8 THEN 'Deceleration-dominant'
  WHEN accel_decel_ratio > 1.25 THEN 'Acceleration-dominant' ELSE 'Balanced' END AS accel_decel_class FROM (
  SELECT session_id, l AS mechanical_load, CASE WHEN duration_min > 0 THEN {_r('l / duration_min', 2)} END AS mechanical_load_per_min,
    CASE WHEN decelerations > 0 THEN {_r('accelerations / decelerations', 2)} END AS accel_decel_ratio
  FROM (SELECT *, CASE WHEN coalesce(accelerations, decelerations) IS NOT NULL THEN coalesce(accelerations, 0) + coalesce(decelerations, 0) END AS l FROM sessions))""", SES)
def mechanical_load(spark, d):
    return S.mechanical_load(B.sessions(spark, d)).select("session_id", "mechanical_load", "mechanical_load_per_min", "accel_decel_ratio", "accel_decel_class")


@query(f"""SELECT session_id, minutes_overhang, overhang_pct, CASE WHEN minutes_overhang > 10 THEN 'wide recording window'
  WHEN minutes_overhang < -5 THEN 'unit under-recorded' ELSE '' END AS note FROM (
  SELECT session_id, {_r('duration_min - minutes_game_zerozero', 1)} AS minutes_overhang,
    {_r('(duration_min - minutes_game_zerozero) / minutes_game_zerozero * 100', 1)} AS overhang_pct
  FROM sessions WHERE minutes_game_zerozero > 0 AND duration_min IS NOT NULL)""", SES)
def minutes_overhang(spark, d):
    return S.minutes_overhang(B.sessions(spark, d)).select("session_id", "minutes_overhang", "overhang_pct", "note")


_RET = f"""retained AS (SELECT *, {_r('sprints_2nd_half / sprints_1st_half', 2)} AS retention FROM (
  SELECT *, CASE WHEN minutes_game_zerozero > 0 THEN minutes_game_zerozero ELSE duration_min END AS minutes FROM sessions)
  WHERE sprints_1st_half > 0 AND sprints_2nd_half IS NOT NULL AND minutes >= 50)"""


@query("SELECT session_id, minutes, retention FROM retained", SES, _RET)
def second_half_retention(spark, d):
    return S.second_half_retention(B.sessions(spark, d)).select("session_id", "minutes", "retention")


@query(f"SELECT player_id, match_category, count(*) AS n, {_r('median(retention)', 2)} AS median, min(retention) AS least, max(retention) AS most FROM retained GROUP BY 1, 2", SES, _RET)
def retention_summary(spark, d):
    return summaries.retention_summary(S.second_half_retention(B.sessions(spark, d)), E)


@query("""SELECT session_id, CASE WHEN unused_sub THEN 'unused sub' WHEN NOT has_gps THEN 'no GPS' WHEN short_appearance THEN 'short appearance' ELSE '' END AS status
  FROM sessions WHERE season = '1997/98' AND match_category IN ('official_match', 'practice_match')""", SES)
def scoped_status(spark, d):
    kept = S.scoped(B.sessions(spark, d), season="1997/98", categories=["official_match", "practice_match"])
    return kept.select("session_id", classes.session_status(F.col("unused_sub"), F.col("has_gps"), F.col("short_appearance")).alias("status"))


# --- load -------------------------------------------------------------------

_DAILY = """days AS (SELECT player_id, date, coalesce(sum(total_distance_m), 0) AS load FROM sessions GROUP BY 1, 2),
daily AS (SELECT s.player_id, s.day::DATE AS date, coalesce(d.load, 0) AS load
  FROM (SELECT player_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS day FROM days GROUP BY 1) s
  LEFT JOIN days d ON d.player_id = s.player_id AND d.date = s.day)"""


@query("SELECT * FROM daily", SES, _DAILY)
def daily_load(spark, d):
    return load.daily_load(B.sessions(spark, d), E)


@query(f"""SELECT player_id, date, acute, chronic, CASE WHEN chronic <> 0 THEN {_r('acute / chronic', 2)} END AS acwr FROM (
  SELECT player_id, date, CASE WHEN count(load) OVER near = 7 THEN sum(load) OVER near END AS acute,
    CASE WHEN count(load) OVER far = 28 THEN sum(load) OVER far / 28 * 7 END AS chronic FROM daily
  WINDOW near AS (PARTITION BY player_id ORDER BY date ROWS 6 PRECEDING),
    far AS (PARTITION BY player_id ORDER BY date ROWS BETWEEN 34 PRECEDING AND 7 PRECEDING))""", SES, _DAILY)
def daily_acwr(spark, d):
    return load.daily_acwr(load.daily_load(B.sessions(spark, d), E), E).select("player_id", "date", "acute", "chronic", "acwr")


_CAT = ", ".join(f"coalesce(sum(total_distance_m) FILTER (match_category = '{c}'), 0) AS {c}" for c in classes.CATEGORIES)
_WEEKLY = f"""weeks AS (SELECT player_id, date - dayofweek(date)::INT AS week_start, coalesce(sum(total_distance_m), 0) AS total, {_CAT}, count(*) AS sessions,
    count(*) FILTER (NOT has_gps AND NOT unused_sub) AS missing_sessions FROM sessions GROUP BY 1, 2),
ends AS (SELECT player_id, max(date) AS last_day FROM sessions GROUP BY 1),
weekly AS (SELECT s.player_id, s.w::DATE AS week_start, s.w::DATE + 6 AS week_end, coalesce(total, 0) AS total,
    {', '.join(f'coalesce({c}, 0) AS {c}' for c in classes.CATEGORIES)}, coalesce(sessions, 0) AS sessions,
    coalesce(missing_sessions, 0) AS missing_sessions, coalesce(missing_sessions, 0) > 0 AS incomplete, s.w::DATE + 6 > last_day AS partial
  FROM (SELECT player_id, unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS w FROM weeks GROUP BY 1) s
  JOIN ends USING (player_id) LEFT JOIN weeks k ON k.player_id = s.player_id AND k.week_start = s.w)"""


@query(f"""SELECT *, coalesce(wow_pct > 10, false) AS spike FROM (SELECT *, CASE WHEN NOT partial AND p <> 0 THEN {_r('(total - p) / p * 100', 1)} END AS wow_pct
  FROM (SELECT *, lag(total) OVER (PARTITION BY player_id ORDER BY week_start) AS p FROM weekly))""".replace("SELECT *, coalesce", "SELECT * EXCLUDE (p), coalesce", 1), SES, _WEEKLY)
def weekly_load(spark, d):
    return load.weekly_load(B.sessions(spark, d), E)


_ZONE = """CASE WHEN partial THEN 'Partial week' WHEN acwr IS NULL THEN 'Insufficient history' WHEN acwr < 0.8 THEN 'Below range'
  WHEN acwr < 1.5 THEN 'Within range' ELSE 'Above range' END AS acwr_zone"""
_ACWR = f"""acwr AS (SELECT player_id, week_start, total, partial, {_r('m', 1)} AS chronic,
    CASE WHEN rn > 4 AND NOT partial AND m <> 0 THEN {_r('total / m', 2)} END AS acwr FROM (
  SELECT *, CASE WHEN count(total) OVER w = 4 THEN sum(total) OVER w / 4 END AS m, row_number() OVER (PARTITION BY player_id ORDER BY week_start) AS rn
  FROM weekly WINDOW w AS (PARTITION BY player_id ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)))"""


@query(f"SELECT *, {_ZONE} FROM acwr", SES, _WEEKLY, _ACWR)
def acwr_rolling(spark, d):
    return load.weekly_acwr(load.weekly_load(B.sessions(spark, d), E), E).select("player_id", "week_start", "total", "partial", "chronic", "acwr", "acwr_zone")


@query(f"""SELECT player_id, week_start, {_r('e28 * 7', 1)} AS chronic, CASE WHEN rn > 4 AND NOT partial AND e28 <> 0 THEN {_r('e7 / e28', 2)} END AS acwr FROM (
  SELECT w.*, row_number() OVER (PARTITION BY w.player_id ORDER BY w.week_start) AS rn, e.e7, e.e28 FROM weekly w JOIN ewma e ON e.player_id = w.player_id AND e.date = w.week_end)""",
  SES, _WEEKLY, """gdays AS (SELECT player_id, date, coalesce(sum(total_distance_m), 0) AS load FROM sessions GROUP BY 1, 2),
full_days AS (SELECT s.player_id, s.day::DATE AS date, coalesce(d.load, 0) AS load, row_number() OVER (PARTITION BY s.player_id ORDER BY s.day) AS i
  FROM (SELECT player_id, unnest(generate_series(min(date), max(date - dayofweek(date)::INT) + 6, INTERVAL 1 DAY)) AS day FROM gdays GROUP BY 1) s
  LEFT JOIN gdays d ON d.player_id = s.player_id AND d.date = s.day),
ewma AS (SELECT player_id, date, i, load AS e7, load AS e28 FROM full_days WHERE i = 1 UNION ALL
  SELECT f.player_id, f.date, f.i, e.e7 * (1 - 2.0::DOUBLE / 8) + f.load * (2.0::DOUBLE / 8), e.e28 * (1 - 2.0::DOUBLE / 29) + f.load * (2.0::DOUBLE / 29)
  FROM ewma e JOIN full_days f ON f.player_id = e.player_id AND f.i = e.i + 1)""")
def acwr_ewma(spark, d):
    return load.weekly_acwr_ewma(B.sessions(spark, d), E).select("player_id", "week_start", "chronic", "acwr")


_MONO = f"""mono AS (SELECT player_id, date - dayofweek(date)::INT AS week_start, sum(load) AS total,
  CASE WHEN stddev_samp(load) > 0 THEN {_r('avg(load) / stddev_samp(load)', 2)} END AS monotony FROM daily GROUP BY 1, 2)"""


@query(f"""SELECT *, {_r('total * monotony', 1)} AS strain, CASE WHEN monotony IS NULL THEN 'Unknown' WHEN monotony < 1 THEN 'Low' WHEN monotony < 2 THEN 'Normal'
  ELSE 'High — low day-to-day variability' END AS class FROM mono""", SES, _DAILY, _MONO)
def monotony_strain(spark, d):
    rows = load.monotony_and_strain(load.daily_load(B.sessions(spark, d), E), E)
    return rows.withColumn("class", classes.monotony_class(F.col("monotony")))


@query("""SELECT player_id, max_by(total, week_start) FILTER (NOT partial) AS latest_total, max_by(acwr, week_start) FILTER (acwr IS NOT NULL) AS latest_acwr,
  count(*) FILTER (acwr IS NOT NULL AND NOT acwr BETWEEN 0.8 AND 1.5) AS outside_band FROM acwr GROUP BY 1""", SES, _WEEKLY, _ACWR)
def load_kpis(spark, d):
    return summaries.load_kpis(load.weekly_acwr(load.weekly_load(B.sessions(spark, d), E), E), E).drop("spikes")


# --- microcycles and comparison ---------------------------------------------

_MD = """anchored AS (SELECT *, max(date) FILTER (match_category = 'official_match') OVER (PARTITION BY player_id, season ORDER BY date RANGE UNBOUNDED PRECEDING) AS prev,
    min(date) FILTER (match_category = 'official_match') OVER (PARTITION BY player_id, season ORDER BY date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
    max(date) OVER (PARTITION BY player_id, season) AS last_day FROM sessions),
labelled AS (SELECT *, CASE WHEN md_offset IS NULL THEN 'PRE' WHEN md_offset = 0 THEN 'MD' ELSE printf('MD%+d', md_offset) END AS md_label,
    CASE WHEN md_offset IS NULL THEN 1000 WHEN md_offset >= 0 THEN md_offset ELSE 100 + md_offset END AS md_order,
    CASE WHEN microcycle_start IS NOT NULL THEN datediff('day', microcycle_start, microcycle_end) + 1 END AS microcycle_days,
    coalesce(microcycle_start IS NOT NULL AND datediff('day', microcycle_start, microcycle_end) + 1 > 10, false) AS microcycle_extended
  FROM (SELECT *, CASE WHEN prev IS NOT NULL AND (date - prev <= 2 OR nxt IS NULL) THEN date - prev
      WHEN nxt IS NOT NULL AND (prev IS NOT NULL OR nxt - date <= 6) THEN -(nxt - date) END::INT AS md_offset,
    prev AS microcycle_start, CASE WHEN prev IS NOT NULL THEN coalesce(nxt - 1, last_day) END AS microcycle_end FROM anchored))"""
_MD_COLS = ("session_id", "md_label", "md_offset", "md_order", "microcycle_start", "microcycle_end", "microcycle_days", "microcycle_extended")


def _labelled(spark, d):
    return microcycles.label_microcycles(B.sessions(spark, d), E)


@query(f"SELECT {', '.join(_MD_COLS)} FROM labelled", SES, _MD)
def md_labels(spark, d):
    return _labelled(spark, d).select(*_MD_COLS)


@query("""SELECT player_id, md_label, md_order, avg(total_distance_m) AS mean, min(total_distance_m) AS least, max(total_distance_m) AS most, count(total_distance_m) AS n
  FROM labelled WHERE has_gps AND NOT microcycle_extended AND md_offset IS NOT NULL AND match_category IN ('training', 'official_match')
  AND (md_label = 'MD') = (match_category = 'official_match') GROUP BY 1, 2, 3""", SES, _MD)
def microcycle_profile(spark, d):
    return microcycles.microcycle_profile(_labelled(spark, d), E, "total_distance_m")


_GM = ("total_distance_m", "hia", "m_per_min", "top_speed_kmh")
_GREF = f"""gref AS (SELECT player_id, season, metric, sum(v) FILTER (r <= 5) / count(*) FILTER (r <= 5) AS gref, count(*) FILTER (r <= 5) AS used, count(*) AS eligible FROM (
  SELECT *, row_number() OVER (PARTITION BY player_id, season, metric ORDER BY v DESC, session_id) AS r FROM (
    UNPIVOT (SELECT player_id, season, session_id, short_appearance, {', '.join(_GM)} FROM sessions WHERE match_category = 'official_match' AND has_gps)
    ON {', '.join(_GM)} INTO NAME metric VALUE v) WHERE NOT (metric = 'm_per_min' AND short_appearance)) GROUP BY 1, 2, 3)"""


@query(f"SELECT * REPLACE ({_r('gref', 6)} AS gref) FROM gref", SES, _GREF)
def gref(spark, d):
    return comparison.match_reference(B.sessions(spark, d), E, list(_GM)).withColumn("gref", half_even(F.col("gref"), 6))


@query(f"""SELECT s.player_id, s.season, g.season AS source_season, g.season <> s.season AS borrowed, g.metric, {_r('g.gref', 6)} AS gref, g.used, g.eligible
  FROM (SELECT DISTINCT player_id, season FROM sessions) s JOIN gref g ON g.player_id = s.player_id
    AND g.season = (SELECT max(x.season) FROM gref x WHERE x.player_id = s.player_id AND x.season <= s.season)""", SES, _GREF)
def gref_borrowed(spark, d):
    rows = B.sessions(spark, d)
    return comparison.borrowed_reference(rows, comparison.match_reference(rows, E, list(_GM)), E).withColumn("gref", half_even(F.col("gref"), 6))


@query(f"""SELECT s.session_id, 'total_distance_m' AS metric, CASE WHEN gref <> 0 THEN {_r('total_distance_m / gref * 100', 1)} END AS pct
  FROM sessions s LEFT JOIN gref g ON g.player_id = s.player_id AND g.season = s.season AND metric = 'total_distance_m' WHERE has_gps AND total_distance_m IS NOT NULL""", SES, _GREF)
def pct_of_gref(spark, d):
    rows = B.sessions(spark, d)
    found = comparison.pct_of_reference(rows, comparison.match_reference(rows, E, list(_GM)), E, ["total_distance_m"])
    return found.filter("value is not null").select("session_id", "metric", "pct")


@query(f"""SELECT m.player_id, m.season, m.md_label, m.n, 'total_distance_m' AS metric, round_even(CASE WHEN gref > 0 THEN mean / gref * 100 END, 0) AS demand_pct FROM (
  SELECT player_id, season, md_label, count(*) AS n, avg(total_distance_m) AS mean FROM labelled WHERE has_gps AND md_offset IS NOT NULL GROUP BY 1, 2, 3) m
  LEFT JOIN gref g ON g.player_id = m.player_id AND g.season = m.season AND g.metric = 'total_distance_m'""", SES, _MD, _GREF)
def md_demand(spark, d):
    rows = _labelled(spark, d)
    return microcycles.demand_by_label(rows, comparison.match_reference(rows, E, list(_GM)), E, ["total_distance_m"])


@query(f"""SELECT player_id, season, session_id, date, match_category, md_label, base_date, base_id, same_id IS NULL AND base_id IS NOT NULL AS fallback,
    total_distance_m, total_distance_m_base, CASE WHEN total_distance_m_base <> 0 THEN {_r('(total_distance_m - total_distance_m_base) / total_distance_m_base * 100', 1)} END AS total_distance_m_pct
  FROM (SELECT r.*, b.session_id AS same_id, coalesce(b.session_id, f.session_id) AS base_id, coalesce(b.date, f.date) AS base_date,
      CASE WHEN b.session_id IS NOT NULL THEN b.total_distance_m ELSE f.total_distance_m END AS total_distance_m_base
    FROM cyc r
    LEFT JOIN cyc b ON b.session_id = (SELECT max_by(x.session_id, (x.date, x.session_id)) FROM cyc x WHERE x.player_id = r.player_id AND x.season = r.season
      AND x.match_category = r.match_category AND x.md_offset IS NOT NULL AND x.md_label = r.md_label AND x.cycle = r.cycle - 1)
    LEFT JOIN cyc f ON f.session_id = (SELECT max_by(x.session_id, (x.date, x.session_id)) FROM cyc x WHERE x.player_id = r.player_id AND x.season = r.season
      AND x.match_category = r.match_category AND x.date < r.date))""", SES, _MD,
  """cyc AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY player_id, season ORDER BY microcycle_start NULLS FIRST) AS cycle FROM labelled) WHERE has_gps)""")
def weekly_change(spark, d):
    return comparison.weekly_change(_labelled(spark, d), E, ["total_distance_m"])


# --- summaries --------------------------------------------------------------

_MON = ", ".join(f"{_r(f'avg({m})', 2)} AS {m}_mean, sum({m}) AS {m}_sum, max({m}) AS {m}_max" for m in ("duration_min", "total_distance_m", "accelerations"))


@query(f"SELECT player_id, date_trunc('month', date)::DATE AS month, count(duration_min) AS duration_min_count, {_MON} FROM sessions GROUP BY 1, 2", SES)
def monthly_summary(spark, d):
    return summaries.monthly_summary(B.sessions(spark, d), E, ("duration_min", "total_distance_m", "accelerations"))


@query(f"""SELECT player_id, session_type AS type, count(*) AS sessions, {_r('avg(total_distance_m)', 2)} AS total_distance_m_mean FROM sessions
  WHERE match_category = 'training' AND session_type IS NOT NULL GROUP BY 1, 2""", SES)
def session_type_stats(spark, d):
    return summaries.by_type(B.sessions(spark, d), E, "training", ("total_distance_m",))


_PIV = ", ".join(f"coalesce(sum(total_distance_m) FILTER (match_category = '{c}'), 0) AS total_distance_m_{c}" for c in classes.CATEGORIES)


@query(f"SELECT player_id, date - dayofweek(date)::INT AS week_start, {_PIV}, coalesce(sum(total_distance_m), 0) AS total_distance_m_total FROM sessions GROUP BY 1, 2", SES)
def weekly_pivot(spark, d):
    return summaries.weekly_pivot(B.sessions(spark, d), E, ("total_distance_m",))


@query(f"""SELECT player_id, CASE WHEN was_starter THEN 'Starter' ELSE 'Substitute' END AS role, count(*) AS games, {_r('avg(total_distance_m)', 2)} AS total_distance_m_mean
  FROM sessions WHERE session_kind = 'game' AND was_starter IS NOT NULL AND duration_min > 0 GROUP BY 1, 2""", SES)
def starter_vs_sub(spark, d):
    return summaries.starter_or_substitute(B.sessions(spark, d), E, ("total_distance_m",))


@query("SELECT player_id, match_category, avg(duration_min) FILTER (duration_min > 0) AS mean_minutes FROM sessions GROUP BY 1, 2", SES)
def average_minutes(spark, d):
    return summaries.average_minutes(B.sessions(spark, d), E)


_QW = summaries.QUALITY_WEIGHTS
_QUAL = f"""q_means AS (SELECT player_id, season, CASE WHEN session_kind = 'training' THEN 'training' ELSE 'game' END AS part, date_trunc('month', date)::DATE AS month,
    {', '.join(f'avg({m}) AS {m}' for m in _QW)} FROM sessions GROUP BY ALL),
q_long AS (SELECT *, max(v) OVER (PARTITION BY player_id, season, part, metric) AS top FROM (UNPIVOT q_means ON {', '.join(_QW)} INTO NAME metric VALUE v)),
q_parts AS (SELECT player_id, season, month, {', '.join(f"sum(v / top * w) FILTER (part = '{p}') / sum(w) FILTER (part = '{p}') * 100 AS {p}" for p in ('game', 'training'))}
  FROM q_long JOIN (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _QW.items())}) b(m, w) ON m = metric WHERE top > 0 GROUP BY 1, 2, 3),
quality AS (SELECT player_id, season, month, {_r('game', 1)} AS game, {_r('training', 1)} AS training,
  {_r("(coalesce(game * 0.6::DOUBLE, 0) + coalesce(training * 0.4::DOUBLE, 0)) / (CASE WHEN game IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN training IS NULL THEN 0 ELSE 0.4::DOUBLE END)", 1)} AS combined FROM q_parts)"""


@query("SELECT * FROM quality", SES, _QUAL)
def monthly_quality(spark, d):
    return summaries.monthly_quality(B.sessions(spark, d), [*E, "season"])


@query(f"""SELECT s.*, q.mean_quality FROM (SELECT player_id, season, {', '.join(f"count(*) FILTER (match_category = '{c}') AS {c}" for c in classes.CATEGORIES)},
  {_r('coalesce(sum(total_distance_m), 0) / 1000', 1)} AS km, max(top_speed_kmh) AS peak_speed FROM sessions GROUP BY 1, 2) s
  LEFT JOIN (SELECT player_id, season, {_r('avg(round_even(combined * 10, 0)) / 10', 1)} AS mean_quality FROM quality GROUP BY 1, 2) q USING (player_id, season)""", SES, _QUAL)
def season_summary(spark, d):
    return summaries.season_summary(B.sessions(spark, d), E)


@query(f"""SELECT player_id, date_trunc('month', date)::DATE AS month, count(*) AS sessions, count(*) FILTER (near) AS near_max,
  {_r('count(*) FILTER (near) / count(*)::DOUBLE * 100', 1)} AS near_max_pct, max(top_speed_kmh) AS best
  FROM (SELECT *, top_speed_kmh >= max(top_speed_kmh) OVER (PARTITION BY player_id) * 0.9::DOUBLE AS near FROM sessions) WHERE top_speed_kmh IS NOT NULL GROUP BY 1, 2""", SES)
def high_speed_exposure(spark, d):
    return summaries.high_speed_exposure(B.sessions(spark, d), E)


@query("""SELECT player_id, month, n_training, n_match, round(t / g * 100, 6) AS gap FROM (SELECT player_id, date_trunc('month', date)::DATE AS month,
  avg(v) FILTER (session_kind = 'training') AS t, avg(v) FILTER (match_category = 'official_match') AS g, count(v) FILTER (session_kind = 'training') AS n_training,
  count(v) FILTER (match_category = 'official_match') AS n_match FROM (SELECT *, CASE WHEN total_distance_m > 0 THEN high_speed_distance_m / total_distance_m END AS v FROM sessions) GROUP BY 1, 2)
  WHERE n_training > 0 AND n_match > 0 AND g > 0""".replace("round(t / g * 100, 6) AS gap", f"{_r('t / g * 100', 1)} AS gap_pct"), SES)
def intensity_gap(spark, d):
    return summaries.intensity_gap(B.sessions(spark, d), E)


@query(f"""SELECT player_id, competition_type, count(*) AS n, {_r('avg(official_minutes)', 1)} AS mean_minutes, {_r(f"avg({_r('total_distance_m / official_minutes * 90', 2)})", 1)} AS total_distance_m_per90_mean
  FROM official WHERE official_minutes >= 20 AND competition_type IS NOT NULL GROUP BY 1, 2""", SES, _OFFICIAL)
def output_by_competition(spark, d):
    rows = S.per90(S.official_minutes(B.sessions(spark, d)), "official_minutes")
    return summaries.output_by(rows, E, "competition_type", ("total_distance_m",))


@query(f"""SELECT session_id, {_r('quantile_cont(top_speed_kmh, 0.95) OVER (PARTITION BY player_id ORDER BY date, session_id ROWS 9 PRECEDING)', 4)} AS robust_top_speed FROM sessions""", SES)
def robust_top_speed(spark, d):
    return summaries.robust_top_speed(B.sessions(spark, d), E, places=4).select("session_id", "robust_top_speed")


@query("""SELECT session_id, avg(total_distance_m) OVER (PARTITION BY player_id ORDER BY date, session_id ROWS 4 PRECEDING) AS rolling
  FROM sessions WHERE total_distance_m IS NOT NULL""", SES)
def rolling_mean_5(spark, d):
    return summaries.rolling_mean(B.sessions(spark, d), E, "total_distance_m").select("session_id", "rolling")


@query("""SELECT * FROM (SELECT player_id, session_id, total_distance_m, row_number() OVER (PARTITION BY player_id ORDER BY total_distance_m DESC, session_id) AS best_rank,
  row_number() OVER (PARTITION BY player_id ORDER BY total_distance_m, session_id) AS worst_rank FROM sessions WHERE total_distance_m > 0) WHERE best_rank <= 5 OR worst_rank <= 5""", SES)
def best_worst(spark, d):
    return summaries.best_and_worst(B.sessions(spark, d), E, "total_distance_m").select("player_id", "session_id", "total_distance_m", "best_rank", "worst_rank")


@query("""SELECT session_id, (rank() OVER (PARTITION BY player_id ORDER BY total_distance_m) - 1) / count(*) OVER (PARTITION BY player_id)::DOUBLE * 100 AS pct_rank
  FROM sessions WHERE total_distance_m IS NOT NULL""", SES)
def percentile_rank(spark, d):
    return summaries.percentile_rank(B.sessions(spark, d), E, "total_distance_m").select("session_id", "pct_rank")


@query("""SELECT *, CASE WHEN max(mean) OVER (PARTITION BY player_id, metric) > 0 THEN mean / max(mean) OVER (PARTITION BY player_id, metric) END AS share FROM (
  UNPIVOT (SELECT player_id, match_category, avg(total_distance_m) AS total_distance_m, avg(hia) AS hia FROM sessions GROUP BY 1, 2) ON total_distance_m, hia INTO NAME metric VALUE mean)""", SES)
def intensity_radar(spark, d):
    return summaries.radar(B.sessions(spark, d), E, ("total_distance_m", "hia"))


@query("""SELECT player_id, week_start, CASE WHEN max(total) OVER w > 0 THEN total / max(total) OVER w ELSE 0 END AS total,
  CASE WHEN max(training) OVER w > 0 THEN training / max(training) OVER w ELSE 0 END AS training FROM weekly WINDOW w AS (PARTITION BY player_id)""", SES, _WEEKLY)
def load_heat(spark, d):
    return summaries.heat(load.weekly_load(B.sessions(spark, d), E), E, ("total", "training")).select("player_id", "week_start", "total", "training")


@query(f"""SELECT player_id, count(*) AS n, {_r('avg(total_distance_m)', 2)} AS total_distance_m, max(top_speed_kmh) AS top_speed_kmh,
  (max((top_speed_kmh, date, session_id)) FILTER (top_speed_kmh IS NOT NULL))[2] AS top_speed_date FROM sessions WHERE has_gps GROUP BY 1""", SES)
def kpi_cards(spark, d):
    return summaries.kpis(B.sessions(spark, d), E, ("total_distance_m",))


def queries() -> dict[str, Query]:
    from . import body_report, documents, reference_more, stored  # noqa: F401  register the rest

    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    from . import body_report, documents, reference_more, stored  # noqa: F401

    return {k: sql for k, (_, sql) in _found.items() if sql}
