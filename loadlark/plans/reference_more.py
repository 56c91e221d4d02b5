"""Queries of fixtures, joins, body composition, correlation and players."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import anthropometry as A
from ..functions import text
from ..functions.numbers import half_even
from ..operators import asof, body, correlation, players, reconcile, season
from ..operators import sessions as S
from . import bindings as B
from .reference import BOD, E, MAT, SES, _r, query

# --- fixtures ---------------------------------------------------------------

_SIDES = """sides AS (SELECT home_team AS team, home_goals AS gf, away_goals AS ga FROM matches UNION ALL SELECT away_team, away_goals, home_goals FROM matches)"""


@query("""SELECT *, row_number() OVER (ORDER BY points DESC, gd DESC, team) AS position FROM (
  SELECT team, 3 * count(*) FILTER (gf > ga) + count(*) FILTER (gf = ga) AS points, count(*) FILTER (gf > ga) AS wins, count(*) FILTER (gf = ga) AS draws,
    count(*) FILTER (gf < ga) AS losses, sum(gf) AS goals_scored, sum(ga) AS goals_conceded, sum(gf) - sum(ga) AS gd, count(*) AS played FROM sides GROUP BY 1)""", MAT, _SIDES)
def league_table(spark, d):
    return season.ranked(season.league_table(B.matches(spark, d)))


_STRENGTH = """strength AS (SELECT team, sum(gf) OVER () / sum(n) OVER () AS mean_goals, gf / n / (sum(gf) OVER () / sum(n) OVER ()) AS attack,
  (sum(gf) OVER () / sum(n) OVER ()) / (ga / n + 0.1::DOUBLE) AS defense FROM (SELECT team, sum(gf)::DOUBLE AS gf, sum(ga)::DOUBLE AS ga, count(*)::DOUBLE AS n FROM sides GROUP BY 1))"""


@query(f"SELECT team, {_r('mean_goals', 6)} AS mean_goals, {_r('attack', 6)} AS attack, {_r('defense', 6)} AS defense FROM strength", MAT, _SIDES, _STRENGTH)
def team_strength(spark, d):
    s = season.team_strength(B.matches(spark, d))
    return s.select("team", *(half_even(F.col(c), 6).alias(c) for c in ("mean_goals", "attack", "defense")))


_RAWFIX = """rawfix AS (SELECT matchweek_number AS mw, 'J' || matchweek_number::VARCHAR AS matchweek, home_team, away_team, min(home_goals) AS hg, min(away_goals) AS ag,
  matchweek_number <= 30 AS played FROM matches GROUP BY ALL)"""


def _raw_fixtures(spark, d):
    """Each fixture as its home team lists it, and as its away team does."""
    m = B.matches(spark, d).groupBy("matchweek_number", "home_team", "away_team").agg(F.min("home_goals").alias("hg"), F.min("away_goals").alias("ag"))
    side = lambda a, b, place: F.struct(F.col(a).alias("Team1"), F.col(b).alias("Team2"), F.lit(place).alias("Location"))
    return m.select(
        F.concat(F.lit("J"), F.col("matchweek_number").cast("string")).alias("Matchweek"), F.concat_ws("-", "hg", "ag").alias("Result"),
        (F.col("matchweek_number") <= 30).alias("Played?"), F.explode(F.array(side("home_team", "away_team", "(C)"), side("away_team", "home_team", "(F)"))).alias("s"),
    ).select("Matchweek", "Result", "Played?", "s.*")


@query("""SELECT mw AS matchweek_number, home_team, away_team, hg AS home_goals, ag AS away_goals, CASE WHEN hg > ag THEN 'Home' WHEN hg < ag THEN 'Away' ELSE 'Draw' END AS winner
  FROM (SELECT *, row_number() OVER (PARTITION BY mw, least(home_team, away_team), greatest(home_team, away_team) ORDER BY home_team) AS r FROM rawfix WHERE played) WHERE r = 1""", MAT, _RAWFIX)
def fixtures_played(spark, d):
    return season.split_fixtures(_raw_fixtures(spark, d))[0]


@query("""SELECT mw AS matchweek_number, home_team, away_team FROM (SELECT *, row_number() OVER (PARTITION BY mw, least(home_team, away_team), greatest(home_team, away_team)
  ORDER BY home_team) AS r FROM rawfix WHERE NOT played) WHERE r = 1""", MAT, _RAWFIX)
def fixtures_remaining(spark, d):
    return season.split_fixtures(_raw_fixtures(spark, d))[1]


@query(f"""SELECT home_team, away_team, {_r('coalesce(h.attack, 1) / coalesce(a.defense, 1) * (m * 0.5::DOUBLE) * 1.15::DOUBLE', 6)} AS home_xg,
  {_r('coalesce(a.attack, 1) / coalesce(h.defense, 1) * (m * 0.5::DOUBLE)', 6)} AS away_xg
  FROM (SELECT DISTINCT home_team, away_team FROM matches) f LEFT JOIN strength h ON h.team = home_team LEFT JOIN strength a ON a.team = away_team,
  (SELECT max(mean_goals) AS m FROM strength)""", MAT, _SIDES, _STRENGTH)
def expected_goals(spark, d):
    m = B.matches(spark, d)
    xg = season.expected_goals(m.select("home_team", "away_team").distinct(), season.team_strength(m))
    return xg.select("home_team", "away_team", *(half_even(F.col(c), 6).alias(c) for c in ("home_xg", "away_xg")))


_NUMBERS = ("points", "wins", "draws", "losses", "goals_scored", "goals_conceded", "gd", "played")


def _standing(source: str, keys: str = "") -> str:
    return f"""SELECT {keys} team, 3 * count(*) FILTER (gf > ga) + count(*) FILTER (gf = ga) AS points, count(*) FILTER (gf > ga) AS wins, count(*) FILTER (gf = ga) AS draws, count(*) FILTER (gf < ga) AS losses,
    sum(gf) AS goals_scored, sum(ga) AS goals_conceded, sum(gf) - sum(ga) AS gd, count(*) AS played FROM (SELECT {keys} home_team AS team, hg AS gf, ag AS ga FROM {source}
    UNION ALL SELECT {keys} away_team, ag, hg FROM {source}) GROUP BY {keys} team"""


def _draw(side: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', 42, sim, mw, home_team, away_team, '{side}')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


# The season drawn a thousand times: a side's goals are how many of its distribution's values lie below the draw.
_SIMULATED = f"""once AS (SELECT *, row_number() OVER (PARTITION BY played, mw, least(home_team, away_team), greatest(home_team, away_team) ORDER BY home_team) AS r FROM rawfix),
was AS (SELECT mw, home_team, away_team, hg, ag FROM once WHERE played AND r = 1), left_over AS (SELECT mw, home_team, away_team FROM once WHERE NOT played AND r = 1),
psides AS (SELECT home_team AS team, hg AS gf, ag AS ga FROM was UNION ALL SELECT away_team, ag, hg FROM was),
p{_STRENGTH.replace('FROM sides', 'FROM psides')},
sided AS (SELECT mw, home_team, away_team, unnest([{{'side': 'h', 'm': coalesce(h.attack, 1) / coalesce(a.defense, 1) * (mean * 0.5::DOUBLE) * 1.15::DOUBLE}}, {{'side': 'a', 'm': coalesce(a.attack, 1) / coalesce(h.defense, 1) * (mean * 0.5::DOUBLE)}}], recursive := true)
  FROM left_over LEFT JOIN pstrength h ON h.team = home_team LEFT JOIN pstrength a ON a.team = away_team, (SELECT max(mean_goals) AS mean FROM pstrength)),
steps AS (SELECT mw, home_team, away_team, side, list(c ORDER BY i) AS cdf FROM (SELECT *, sum(exp(i * ln(m) - m - lgamma(i + 1))) OVER (PARTITION BY mw, home_team, away_team, side ORDER BY i) AS c
  FROM (SELECT *, unnest(range(0, floor(m + sqrt(m) * 10 + 24)::BIGINT + 1)) AS i FROM sided)) GROUP BY ALL),
sims AS (SELECT unnest(range(1000)) AS sim),
drawn AS (SELECT sim, f.mw, f.home_team, f.away_team, len(list_filter(h.cdf, lambda c: c < uh)) AS hg, len(list_filter(a.cdf, lambda c: c < ua)) AS ag
  FROM (SELECT *, {_draw('h')} AS uh, {_draw('a')} AS ua FROM left_over, sims) f JOIN steps h ON h.side = 'h' AND h.mw = f.mw AND h.home_team = f.home_team AND h.away_team = f.away_team
  JOIN steps a ON a.side = 'a' AND a.mw = f.mw AND a.home_team = f.home_team AND a.away_team = f.away_team),
now AS ({_standing('was')}), later AS ({_standing('drawn', 'sim,')}),
final AS (SELECT sim, team, {', '.join(f'sum({c}) AS {c}' for c in _NUMBERS)} FROM (SELECT sim, now.* FROM now, sims UNION ALL SELECT sim, team, {', '.join(_NUMBERS)} FROM later) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY points DESC, gd DESC, team) AS position, count(*) OVER (PARTITION BY sim) AS n_teams FROM final)"""


@query(f"""SELECT team, {', '.join(f"{_r(f'avg({c}::BIGINT)', 2)} AS mean_{c}" for c in _NUMBERS)}, {_r('avg(position)', 2)} AS mean_position, {_r('count(*) FILTER (position = 1) * 100.0::DOUBLE / count(*)', 1)} AS title_pct,
    {_r('count(*) FILTER (position <= 3) * 100.0::DOUBLE / count(*)', 1)} AS top3_pct, {_r('count(*) FILTER (position > n_teams - 3) * 100.0::DOUBLE / count(*)', 1)} AS bottom3_pct, max(n_teams) AS n_teams FROM placed GROUP BY 1""",
    MAT, _RAWFIX, _SIMULATED)
def simulate_season(spark, d):
    played, remaining = season.split_fixtures(_raw_fixtures(spark, d))
    return season.simulate(played, remaining)[0]


@query("SELECT team, position, count(*) AS times FROM placed GROUP BY 1, 2", MAT, _RAWFIX, _SIMULATED)
def simulated_positions(spark, d):
    """How often each team ends in each place."""
    played, remaining = season.split_fixtures(_raw_fixtures(spark, d))
    return season.simulate(played, remaining)[1]


@query("SELECT count(DISTINCT team) AS teams, (SELECT count(*) FROM matches) AS matches, (SELECT count(*) FROM matches) = count(DISTINCT team) * (count(DISTINCT team) - 1) AS complete FROM sides", MAT, _SIDES)
def season_complete(spark, d):
    return season.is_complete(B.matches(spark, d))


# --- as-of and interval joins ------------------------------------------------

_GAMES = "games AS (SELECT DISTINCT player_id, date AS fixture_date FROM sessions WHERE match_category = 'practice_match')"


def _fixtures(spark, d):
    return B.sessions(spark, d).filter("match_category = 'practice_match'").select("player_id", F.col("date").alias("fixture_date")).distinct()


@query("""SELECT session_id, fixture_date, date - fixture_date AS days_from, CASE WHEN fixture_date IS NULL THEN 'unmatched' WHEN fixture_date = date THEN 'exact'
    ELSE printf('%+dd', date - fixture_date) END AS match_quality FROM (
  SELECT s.session_id, s.date, g.fixture_date, row_number() OVER (PARTITION BY s.session_id ORDER BY abs(s.date - g.fixture_date), g.fixture_date) AS n
  FROM sessions s LEFT JOIN games g ON g.player_id = s.player_id AND abs(s.date - g.fixture_date) <= 1 WHERE s.match_category = 'official_match') WHERE n = 1""", SES, _GAMES)
def asof_nearest(spark, d):
    left = B.sessions(spark, d).filter("match_category = 'official_match'").select("session_id", "player_id", "date")
    return asof.nearest(left, _fixtures(spark, d), E, "session_id", "date", "fixture_date", ["fixture_date"]).select("session_id", "fixture_date", "days_from", "match_quality")


@query("""SELECT s.session_id, CASE WHEN s.date - a.date <= 120 THEN a.date END AS assessed, CASE WHEN s.date - a.date <= 120 THEN "Peso" END AS "Peso",
  CASE WHEN s.date - a.date <= 120 THEN s.date - a.date END AS age_days FROM sessions s ASOF LEFT JOIN assessments a ON s.player_id = a.player_id AND s.date >= a.date""", SES, BOD)
def asof_backward(spark, d):
    right = B.assessments(spark, d).select("player_id", F.col("date").alias("assessed"), "Peso")
    left = B.sessions(spark, d).select("player_id", "session_id", "date")
    return asof.backward(left, right, E, "session_id", "date", "assessed", ["Peso"]).select("session_id", "assessed", "Peso", "age_days")


_SPANS = """spans AS (SELECT player_id, lag(date) OVER w AS start, date AS "end", "Peso" - lag("Peso") OVER w AS delta FROM assessments WINDOW w AS (PARTITION BY player_id ORDER BY date))"""


@query(f"""SELECT p.player_id, p.start, p."end", {_r('max(delta)', 4)} AS "Peso_delta", count(s.session_id) AS sessions, coalesce(sum(total_distance_m), 0) AS total_distance_m,
  p."end" - p.start AS days, {_r('coalesce(sum(total_distance_m), 0) / (p."end" - p.start) * 7', 4)} AS total_distance_m_per_week
  FROM spans p LEFT JOIN sessions s ON s.player_id = p.player_id AND s.date > p.start AND s.date <= p."end" WHERE p.start IS NOT NULL GROUP BY p.player_id, p.start, p."end" """, SES, BOD, _SPANS)
def interval_windows(spark, d):
    found = asof.windows_between(B.assessments(spark, d), B.sessions(spark, d), E, ["Peso"], ["total_distance_m"])
    return found.drop("Peso_start", "Peso_end").withColumns({c: half_even(F.col(c), 4) for c in ("Peso_delta", "total_distance_m_per_week")})


@query(f"""SELECT p.player_id, p.start, p."end", "Peso_start", "Peso_end", {_r('"Peso_end" - "Peso_start"', 2)} AS "Peso_delta", "Altura_start", "Altura_end", {_r('"Altura_end" - "Altura_start"', 2)} AS "Altura_delta",
    count(s.session_id) AS sessions, coalesce(sum(total_distance_m), 0) AS total_distance_m, coalesce(sum(calories), 0) AS calories, p."end" - p.start AS days,
    CASE WHEN month(p."end") >= 7 THEN year(p."end")::VARCHAR || '/' || lpad(((year(p."end") + 1) % 100)::VARCHAR, 2, '0') ELSE (year(p."end") - 1)::VARCHAR || '/' || lpad((year(p."end") % 100)::VARCHAR, 2, '0') END AS season,
    CASE WHEN month(p."end") = 7 THEN 'fora de época' WHEN month(p."end") = 8 THEN 'pré-época' WHEN month(p."end") >= 9 THEN '1ª volta' WHEN month(p."end") <= 5 THEN '2ª volta' ELSE 'final de época' END AS phase,
    {_r('count(s.session_id) / (p."end" - p.start) * 7', 2)} AS sessions_per_week, {_r('coalesce(sum(total_distance_m), 0) / 1000 / (p."end" - p.start) * 7', 1)} AS km_per_week,
    {_r('coalesce(sum(calories), 0) / (p."end" - p.start)')} AS football_kcal_per_day
  FROM (SELECT player_id, lag(date) OVER w AS start, date AS "end", lag("Peso") OVER w AS "Peso_start", "Peso" AS "Peso_end", lag("Altura") OVER w AS "Altura_start", "Altura" AS "Altura_end" FROM assessments
    WINDOW w AS (PARTITION BY player_id ORDER BY date)) p LEFT JOIN sessions s ON s.player_id = p.player_id AND s.date > p.start AND s.date <= p."end" WHERE p.start IS NOT NULL
  GROUP BY p.player_id, p.start, p."end", "Peso_start", "Peso_end", "Altura_start", "Altura_end" """, SES, BOD)
def assessment_windows(spark, d):
    metrics, loads = ["Peso", "Altura"], ["total_distance_m", "calories"]
    return asof.window_report(asof.windows_between(B.assessments(spark, d), B.sessions(spark, d), E, metrics, loads), metrics, loads)


_LOOK = """looked AS (SELECT a.player_id, a.date, count(s.session_id) AS sessions_in_window, avg(s.total_distance_m) AS total_distance_m_mean, avg(s.hia) AS hia_mean
  FROM assessments a LEFT JOIN sessions s ON s.player_id = a.player_id AND s.date > a.date - 28 AND s.date <= a.date GROUP BY 1, 2)"""


def _lookback(spark, d):
    return asof.lookback_mean(B.assessments(spark, d), B.sessions(spark, d), E, ["total_distance_m", "hia"])


@query("SELECT * FROM looked", SES, BOD, _LOOK)
def lookback_mean(spark, d):
    return _lookback(spark, d).select("player_id", "date", "sessions_in_window", "total_distance_m_mean", "hia_mean")


@query("""SELECT player_id, count(*) AS assessments, count(*) FILTER (sessions_in_window > 0) AS paired, greatest(0, 8 - count(*) FILTER (sessions_in_window > 0)) AS shortfall,
  count(*) FILTER (sessions_in_window > 0) >= 4 AS analysable, count(*) FILTER (sessions_in_window > 0) >= 8 AS well_powered, min(date) FILTER (sessions_in_window > 0) AS first_paired FROM looked GROUP BY 1""", SES, BOD, _LOOK)
def pair_coverage(spark, d):
    return correlation.coverage(_lookback(spark, d), E)


@query("""SELECT player_id, date, session_type, 'added' AS change FROM (SELECT DISTINCT player_id, date, session_type FROM sessions WHERE session_id % 10 <> 0
    EXCEPT SELECT player_id, date, session_type FROM sessions WHERE session_id % 10 <> 1)
  UNION ALL SELECT player_id, date, session_type, 'removed' FROM (SELECT DISTINCT player_id, date, session_type FROM sessions WHERE session_id % 10 <> 1
    EXCEPT SELECT player_id, date, session_type FROM sessions WHERE session_id % 10 <> 0)""", SES)
def sync_diff(spark, d):
    rows = B.sessions(spark, d)
    return asof.diff(rows.filter("session_id % 10 <> 1"), rows.filter("session_id % 10 <> 0"), ["player_id", "date", "session_type"])


# --- body -------------------------------------------------------------------

_DIM = [("Peso", -1, 0.8), ("Massa Gorda", -1, 0.5), ("Altura", 0, None), ("Perímetro Cintura", 0, 1.0)]
_DIMSQL = "dim(metric, direction, threshold) AS (VALUES ('Peso', -1, 0.8::DOUBLE), ('Massa Gorda', -1, 0.5), ('Altura', 0, NULL), ('Perímetro Cintura', 0, 1.0))"
_RANGESQL = "ranges(metric, low, high) AS (VALUES ('Altura', 120::DOUBLE, 220::DOUBLE), ('Peso', 35, 200), ('Perímetro Cintura', 50, 160))"


def _long(spark, d):
    return body.to_long(B.assessments(spark, d), ["player_id", "date"])


def _dim(spark):
    return spark.createDataFrame(_DIM, "metric string, direction int, threshold double")


def _ranges(spark):
    return spark.createDataFrame([("Altura", 120.0, 220.0), ("Peso", 35.0, 200.0), ("Perímetro Cintura", 50.0, 160.0)], "metric string, low double, high double")


@query("SELECT player_id, date, metric, value FROM long_body", BOD)
def unpivot_body(spark, d):
    return _long(spark, d)


@query('SELECT player_id, date, "Peso", "Altura" FROM assessments', BOD)
def pivot_assessments(spark, d):
    return body.to_wide(_long(spark, d), ["player_id", "date"], ["Peso", "Altura"])


@query(f"""SELECT player_id, date, metric, value, days AS days_since_previous, {_r('value - p', 2)} AS delta_previous, CASE WHEN p <> 0 THEN {_r('(value - p) / p * 100', 1)} END AS pct_previous,
  CASE WHEN days > 0 THEN {_r('(value - p) / days * 30', 2)} END AS rate_per_30d, CASE WHEN p IS NULL OR threshold IS NULL THEN '' WHEN abs(value - p) >= threshold THEN 'sim' ELSE 'ruído' END AS meaningful_change,
  {_r('value - f', 2)} AS delta_baseline FROM (SELECT *, lag(value) OVER w AS p, first_value(value) OVER w AS f, date - lag(date) OVER w AS days FROM long_body
  WINDOW w AS (PARTITION BY player_id, metric ORDER BY date)) LEFT JOIN dim USING (metric)""", BOD, _DIMSQL)
def body_changes(spark, d):
    return body.changes(_long(spark, d), E, _dim(spark).select("metric", "threshold"))


_EVO = f"""evo AS (SELECT player_id, metric, base_date, latest_date, base, latest, {_r('latest - base', 2)} AS change, CASE WHEN base <> 0 THEN {_r('(latest - base) / base * 100', 1)} END AS change_pct,
    CASE WHEN abs(latest - base) < coalesce(threshold, 0) THEN 'noise' WHEN coalesce(direction, 0) = 0 OR latest = base THEN 'neutral'
      WHEN (latest - base) * direction > 0 THEN 'better' ELSE 'worse' END AS verdict
  FROM (SELECT player_id, metric, min(date) AS base_date, max(date) AS latest_date, min_by(value, date) AS base, max_by(value, date) AS latest FROM long_body GROUP BY 1, 2 HAVING count(*) > 1)
  LEFT JOIN dim USING (metric))"""


@query("SELECT * FROM evo", BOD, _DIMSQL, _EVO)
def body_evolution(spark, d):
    return body.evolution(_long(spark, d), E, _dim(spark))


@query("""SELECT player_id, count(*) FILTER (verdict = 'worse') AS worse, count(*) FILTER (verdict = 'better') AS better, count(*) FILTER (verdict = 'noise') AS noise,
  count(*) FILTER (verdict = 'neutral') AS neutral, count(*) FILTER (verdict IN ('worse', 'better')) AS directional FROM evo GROUP BY 1""", BOD, _DIMSQL, _EVO)
def verdict_counts(spark, d):
    return body.verdict_counts(body.evolution(_long(spark, d), E, _dim(spark)), E)


_PHASED = """phased AS (SELECT *, CASE WHEN month(date) >= 7 THEN year(date)::VARCHAR ELSE (year(date) - 1)::VARCHAR END AS season,
  CASE WHEN month(date) BETWEEN 7 AND 12 THEN 'a' ELSE 'b' END AS phase, round_even(value * 10, 0) AS tenths FROM long_body)"""


def _phased(spark, d):
    y = F.year(F.add_months("date", -6)).cast("string")
    return _long(spark, d).withColumns({"season": y, "phase": F.when(F.month("date").between(7, 12), "a").otherwise("b"), "value": F.rint(F.col("value") * 10)})


@query(f"""SELECT player_id, season, CASE WHEN grouping(phase) = 1 THEN 'época completa' ELSE phase END AS phase, metric, count(*) AS n, min(date) AS first_date, max(date) AS last_date,
  min_by(tenths, date) AS first, max_by(tenths, date) AS last, {_r('max_by(tenths, date) - min_by(tenths, date)', 2)} AS net_change, min(tenths) AS least, max(tenths) AS most,
  {_r('max(tenths) - min(tenths)', 2)} AS range, {_r('avg(tenths)', 4)} AS mean, CASE WHEN avg(tenths) <> 0 THEN {_r('stddev_pop(tenths) / avg(tenths) * 100', 4)} END AS cv_pct
  FROM phased GROUP BY GROUPING SETS ((player_id, season, metric), (player_id, season, phase, metric))""", BOD, _PHASED)
def season_levels(spark, d):
    return body.season_levels(_phased(spark, d), E)


@query(f"SELECT player_id, phase, metric, {_r('avg(tenths)', 2)} AS mean, count(*) AS n, 5 AS phase_order FROM phased GROUP BY 1, 2, 3", BOD, _PHASED)
def phase_means(spark, d):
    return body.phase_means(_phased(spark, d), E)


@query("SELECT player_id, date, metric, value, low, high FROM long_body JOIN ranges USING (metric) WHERE value < low OR value > high", BOD, _RANGESQL)
def implausible_values(spark, d):
    return body.implausible(_long(spark, d), _ranges(spark))


@query("""SELECT player_id, date, metric, value, CASE WHEN bad THEN 'out of range' ELSE 'jump' END AS flag FROM (
  SELECT *, coalesce(value < low OR value > high, false) AS bad, coalesce(p <> 0 AND abs(value - p) / abs(p) > 0.3::DOUBLE, false) AS jump FROM (
    SELECT *, lag(value) OVER (PARTITION BY player_id, metric ORDER BY date) AS p FROM long_body) LEFT JOIN ranges USING (metric)) WHERE bad OR jump""", BOD, _RANGESQL)
def quality_flags(spark, d):
    return body.quality_flags(_long(spark, d), E, _ranges(spark))


@query("""SELECT player_id, date, metric, CASE WHEN fix THEN value / 10 ELSE value END AS value, CASE WHEN fix THEN value END AS value_original, CASE WHEN fix THEN 'sim' ELSE '' END AS corrected,
  CASE WHEN fix THEN 'decimal point' END AS correction_note FROM (SELECT *, metric = 'Altura' AND value > 220 AS fix FROM long_body)""", BOD)
def corrected_values(spark, d):
    rows = _long(spark, d)
    return body.corrected(rows, _fixes(rows), E)


def _fixes(rows):
    return rows.filter("metric = 'Altura' and value > 220").select("player_id", "date", "metric", (F.col("value") / 10).alias("corrected_value"), F.lit("decimal point").alias("why"))


@query(f"""SELECT player_id, date, metric, CASE WHEN fix THEN value / 10 ELSE value END AS value, CASE WHEN fix THEN value END AS value_original, CASE WHEN fix THEN 'sim' ELSE '' END AS corrected,
  CASE WHEN fix THEN 'decimal point' END AS correction_note FROM (SELECT *, metric = 'Altura' AND value > 220 AS fix FROM long_body)
  UNION ALL SELECT player_id, date, 'Cintura/Altura', CASE WHEN fix THEN {_r('waist / (height / 10)', 2)} ELSE {_r('waist / height', 2)} END, CASE WHEN fix THEN {_r('waist / height', 2)} END,
  CASE WHEN fix THEN 'sim' ELSE '' END, CASE WHEN fix THEN 'recalculado de Perímetro Cintura/Altura após correção' END
  FROM (SELECT w.player_id, w.date, w.value AS waist, h.value AS height, h.value > 220 AS fix FROM long_body w JOIN long_body h ON w.player_id = h.player_id AND w.date = h.date
    WHERE w.metric = 'Perímetro Cintura' AND h.metric = 'Altura')""", BOD)
def recomputed_ratios(spark, d):
    rows = _long(spark, d)
    pick = lambda metric, name: rows.filter(F.col("metric") == metric).select("player_id", "date", F.col("value").alias(name))
    printed = pick("Perímetro Cintura", "waist").join(pick("Altura", "height"), ["player_id", "date"]).select(
        "player_id", "date", F.lit("Cintura/Altura").alias("metric"), half_even(F.col("waist") / F.col("height"), 2).alias("value")
    )
    ratios = spark.createDataFrame([("Cintura/Altura", "Perímetro Cintura", "Altura")], "metric string, numerator string, denominator string")
    return body.recomputed(body.corrected(rows.unionByName(printed), _fixes(rows), E), ratios, E)


_X = ("Peso", "Altura", "Perímetro Cintura")


@query(f"""SELECT player_id, date, {_r('495 / (1.1631::DOUBLE - 0.0632::DOUBLE * log10(f * 4)) - 450', 6)} AS durnin_womersley, {_r('0.153::DOUBLE * (f * 4) + 5.783::DOUBLE', 6)} AS faulkner,
  {_r('0.1051::DOUBLE * (f * 6) + 2.585::DOUBLE', 6)} AS yuhasz, {_r('w - pi() * f / 10', 6)} AS corrected_girth, {_r('0.007184::DOUBLE * pow(h, 0.725) * pow(p, 0.425)', 6)} AS surface_area,
  {_r("CASE WHEN h / cbrt(p) >= 40.75 THEN 0.732::DOUBLE * (h / cbrt(p)) - 28.58::DOUBLE WHEN h / cbrt(p) > 38.25 THEN 0.463::DOUBLE * (h / cbrt(p)) - 17.63::DOUBLE ELSE 0.1::DOUBLE END", 6)} AS ectomorphy
  FROM (SELECT player_id, date, "Peso" AS p, "Altura" AS h, "Perímetro Cintura" AS w, "Massa Gorda" AS f FROM assessments) WHERE f IS NOT NULL""", BOD)
def anthropometry(spark, d):
    f, w, h, p = F.col("Massa Gorda"), F.col("Perímetro Cintura"), F.col("Altura"), F.col("Peso")
    found = {
        "durnin_womersley": A.durnin_womersley(F.lit("M"), F.lit(25), f, f, f, f), "faulkner": A.faulkner(f, f, f, f), "yuhasz": A.yuhasz(f, f, f, f, f, f),
        "corrected_girth": A.corrected_girth(w, f), "surface_area": A.surface_area(p, h), "ectomorphy": A.ectomorphy(h, p),
    }
    return B.assessments(spark, d).filter(f.isNotNull()).select("player_id", "date", *(half_even(c, 6).alias(k) for k, c in found.items()))


# --- correlation ------------------------------------------------------------


def _grid(spark, d):
    perf = _lookback(spark, d).select("player_id", "date", "total_distance_m_mean", "hia_mean")
    return correlation.spearman_grid(_long(spark, d), body.to_long(perf, ["player_id", "date"]), E, ["date"])


_GRID = f"""grid AS (SELECT player_id, metric AS body_metric, load_metric, count(*) AS n, corr(rx, ry) AS exact, {_r('corr(rx, ry)', 3)} AS rho,
    CASE WHEN count(*) >= 8 THEN 'reliable' WHEN count(*) >= 6 THEN 'indicative' WHEN count(*) >= 4 THEN 'exploratory' ELSE 'not testable' END AS tier
  FROM (SELECT *, rank() OVER (PARTITION BY player_id, metric, load_metric ORDER BY value) + (count(*) OVER (PARTITION BY player_id, metric, load_metric, value) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER (PARTITION BY player_id, metric, load_metric ORDER BY y) + (count(*) OVER (PARTITION BY player_id, metric, load_metric, y) - 1) / 2.0::DOUBLE AS ry
    FROM long_body b JOIN (UNPIVOT (SELECT player_id, date, total_distance_m_mean, hia_mean FROM looked) ON total_distance_m_mean, hia_mean INTO NAME load_metric VALUE y) p USING (player_id, date))
  GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0)"""
# Student's t at a whole number of degrees of freedom is a finite sum; written so, apart from the operator's continued fraction.
_TESTED = f"""probable AS (SELECT *, {_r('p_exact', 4)} AS p FROM (SELECT *, CASE WHEN abs(exact) >= 1 THEN 0 WHEN n % 2 = 0
    THEN 1 - abs(exact) * list_sum(list_transform(range(0, n // 2 - 1), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(1 - exact * exact, k)))
    ELSE 1 - 2 / pi() * (asin(abs(exact)) + abs(exact) * list_sum(list_transform(range(0, (n - 3) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(1 - exact * exact, k + 0.5)))) END AS p_exact FROM grid)),
tested AS (SELECT player_id, body_metric, load_metric, n, rho, tier, p, {_r('q', 4)} AS q, {_r('q', 4)} < 0.05 AS survives FROM (
  SELECT *, least(1.0::DOUBLE, min(p * m / r) OVER (PARTITION BY player_id ORDER BY p, body_metric, load_metric ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY p, body_metric, load_metric) AS r, count(*) OVER (PARTITION BY player_id) AS m FROM probable)))"""


@query("SELECT player_id, body_metric, load_metric, n, rho, tier FROM grid", SES, BOD, _LOOK, _GRID)
def spearman_grid(spark, d):
    return _grid(spark, d).drop("rho_exact")


def _tested(spark, d):
    return correlation.benjamini_hochberg(correlation.with_p(_grid(spark, d)), E, ["body_metric", "load_metric"]).drop("rho_exact")


@query("SELECT * FROM tested", SES, BOD, _LOOK, _GRID, _TESTED)
def spearman_fdr(spark, d):
    return _tested(spark, d)


@query("""SELECT player_id, count(*) AS tested, count(*) FILTER (survives) AS survivors, max(n) AS best_n, max(n) < 8 AS underpowered, count(*) FILTER (survives AND abs(rho) >= 0.5) AS strong,
    count(*) FILTER (survives AND abs(rho) >= 0.99 AND n < 8) AS suspect_survivors,
    CASE WHEN count(*) FILTER (survives) = 0 THEN 'Nothing here separates from chance.' ELSE count(*) FILTER (survives) || ' of ' || count(*) || ' pairs survive false-discovery correction.' END AS verdict,
    arg_min(body_metric, (-abs(rho), body_metric, load_metric)) AS strongest_body_metric, arg_min(load_metric, (-abs(rho), body_metric, load_metric)) AS strongest_load_metric,
    arg_min(rho, (-abs(rho), body_metric, load_metric)) AS strongest_rho, arg_min(n, (-abs(rho), body_metric, load_metric)) AS strongest_n, arg_min(tier, (-abs(rho), body_metric, load_metric)) AS strongest_tier
  FROM tested GROUP BY 1""", SES, BOD, _LOOK, _GRID, _TESTED)
def correlation_findings(spark, d):
    return correlation.findings(_tested(spark, d), E)


_PS = "ps AS (SELECT nationkey, body_metric, p FROM (SELECT c_nationkey AS nationkey, c_custkey AS body_metric, (c_custkey % 97 + 1)::DOUBLE / 10000 * (c_nationkey + 1) AS p FROM customer))"


@query(f"""SELECT nationkey, body_metric, p, {_r('q', 4)} AS q, {_r('q', 4)} < 0.05 AS survives FROM (SELECT *, least(1.0::DOUBLE, min(p * n / r) OVER (PARTITION BY nationkey ORDER BY p, body_metric
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY nationkey ORDER BY p, body_metric) AS r, count(*) OVER (PARTITION BY nationkey) AS n FROM ps))""", _PS)
def bh_fdr(spark, d):
    c = B.table(spark, d, "customer")
    ps = c.select(F.col("c_nationkey").alias("nationkey"), F.col("c_custkey").alias("body_metric"), ((F.col("c_custkey") % 97 + 1) / 10000.0 * (F.col("c_nationkey") + 1)).alias("p"))
    return correlation.benjamini_hochberg(ps, ["nationkey"], ["body_metric"])


# --- text and players -------------------------------------------------------

_LABELS = """labels_made AS (SELECT match_id, matchweek_number, away_team AS opponent, CASE WHEN match_id % 2 = 0 THEN 'CASA' ELSE 'FORA' END AS word, CASE match_id % 3 WHEN 0 THEN 'Campeonato'
  WHEN 1 THEN 'Taça' ELSE 'Treino' END AS competition, home_goals AS hg, away_goals AS ag FROM matches)"""


def _label_parts(spark, d):
    m = B.matches(spark, d)
    home = F.col("match_id") % 2 == 0
    return m.select(
        "match_id", "matchweek_number", F.col("away_team").alias("opponent"), F.when(home, "home").otherwise("away").alias("venue"),
        F.when(F.col("match_id") % 3 == 0, "Campeonato").when(F.col("match_id") % 3 == 1, "Taça").otherwise("Treino").alias("competition"),
        F.when(home, F.col("home_goals")).otherwise(F.col("away_goals")).alias("gf"), F.when(home, F.col("away_goals")).otherwise(F.col("home_goals")).alias("ga"),
    )


def _labels(spark, d):
    p = _label_parts(spark, d)
    return p.select("match_id", text.build_label(*(F.col(c) for c in ("competition", "matchweek_number", "opponent", "venue", "gf", "ga"))).alias("label"))


@query("""SELECT match_id, CASE competition WHEN 'Campeonato' THEN 'Jornada ' || matchweek_number::VARCHAR || ' - ' WHEN 'Taça' THEN 'Jogo Taça - ' ELSE 'Jogo Treino ' END
  || opponent || ' (' || word || ') ' || hg::VARCHAR || '-' || ag::VARCHAR AS label FROM labels_made""", MAT, _LABELS)
def build_label(spark, d):
    return _labels(spark, d)


@query("""SELECT match_id, opponent, CASE word WHEN 'CASA' THEN 'home' ELSE 'away' END AS venue, CASE word WHEN 'CASA' THEN hg ELSE ag END AS goals_for, CASE word WHEN 'CASA' THEN ag ELSE hg END AS goals_against,
  hg::VARCHAR || '-' || ag::VARCHAR AS scoreline, CASE WHEN hg = ag THEN 'D' WHEN (hg > ag) = (word = 'CASA') THEN 'W' ELSE 'L' END AS team_result,
  CASE competition WHEN 'Campeonato' THEN matchweek_number::VARCHAR END AS matchweek FROM labels_made""", MAT, _LABELS)
def parse_label(spark, d):
    return _labels(spark, d).select("match_id", text.parse_label(F.col("label")).alias("p")).select("match_id", "p.*")


_RECORDS = """fixture_side AS (SELECT DISTINCT ON (match_id) * FROM (SELECT match_id, DATE '2024-01-01' + (match_id % 365)::INT AS date, opponent, CASE word WHEN 'CASA' THEN 'home' ELSE 'away' END AS venue,
    CASE word WHEN 'CASA' THEN hg ELSE ag END AS gf, CASE word WHEN 'CASA' THEN ag ELSE hg END AS ga FROM labels_made) ORDER BY match_id, opponent, gf, ga, venue),
label_side AS (SELECT match_id, date, opponent || CASE WHEN match_id % 13 = 0 THEN ' B' ELSE '' END AS opponent, CASE WHEN (match_id % 7 = 0) = (venue = 'home') THEN 'away' ELSE 'home' END AS venue,
    CASE WHEN match_id % 23 <> 0 THEN gf + CASE WHEN match_id % 11 = 0 THEN 1 ELSE 0 END END AS gf, CASE WHEN match_id % 23 <> 0 THEN ga END AS ga FROM fixture_side),
joined AS (SELECT coalesce(l.match_id, f.match_id) AS match_id, coalesce(l.date, f.date) AS date, l.match_id IS NOT NULL AS has_l, f.match_id IS NOT NULL AS has_f, l.opponent AS lo, f.opponent AS fo, l.venue AS lv, f.venue AS fv,
    l.gf AS lgf, f.gf AS fgf, l.ga AS lga, f.ga AS fga, CASE WHEN l.gf > l.ga THEN 'W' WHEN l.gf < l.ga THEN 'L' WHEN l.gf = l.ga THEN 'D' END AS lr, CASE WHEN f.gf > f.ga THEN 'W' WHEN f.gf < f.ga THEN 'L' WHEN f.gf = f.ga THEN 'D' END AS fr
  FROM (SELECT * FROM label_side WHERE match_id % 17 <> 0) l FULL JOIN (SELECT * FROM fixture_side WHERE match_id % 19 <> 0) f USING (match_id, date))"""


@query("""SELECT match_id, date, CASE WHEN NOT has_f THEN 'label only' WHEN NOT has_l THEN 'fixture only' WHEN lv <> fv OR coalesce(lr <> fr, false) THEN 'contradiction' WHEN coalesce(lgf <> fgf OR lga <> fga, false) THEN 'score'
    WHEN lo <> fo THEN 'name' WHEN lgf IS NULL THEN 'incomplete' ELSE 'agrees' END AS grade,
    concat_ws(',', CASE WHEN lo <> fo THEN 'opponent' END, CASE WHEN lv <> fv THEN 'venue' END, CASE WHEN lgf <> fgf THEN 'goals_for' END, CASE WHEN lga <> fga THEN 'goals_against' END, CASE WHEN lr <> fr THEN 'team_result' END) AS fields,
    lv AS label_venue, fv AS fixture_venue, lr AS label_team_result, fr AS fixture_team_result FROM joined""", MAT, _LABELS, _RECORDS)
def match_record_check(spark, d):
    """Labels with planted faults (venue, goals, names, unknown goals, missing records) against the fixtures they were made of."""
    p = _label_parts(spark, d).withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("match_id") % 365).cast("int")))
    p = p.withColumn("_n", F.row_number().over(Window.partitionBy("match_id").orderBy("opponent", "gf", "ga", "venue"))).filter("_n = 1")
    k, gf, ga = F.col("match_id"), F.col("gf"), F.col("ga")
    other = F.when(F.col("venue") == "home", "away").otherwise("home")
    made = text.build_label(
        F.col("competition"), F.col("matchweek_number"), F.concat("opponent", F.when(k % 13 == 0, " B").otherwise("")), F.when(k % 7 == 0, other).otherwise(F.col("venue")),
        F.when(k % 23 != 0, gf + F.when(k % 11 == 0, 1).otherwise(0)), F.when(k % 23 != 0, ga),
    )
    labels = p.filter(k % 17 != 0).select("match_id", "date", made.alias("label")).select("match_id", "date", text.parse_label(F.col("label")).alias("p")).select("match_id", "date", "p.*")
    result = F.when(gf > ga, "W").when(gf < ga, "L").otherwise("D")
    fixtures = p.filter(k % 19 != 0).select("match_id", "date", "opponent", "venue", gf.alias("goals_for"), ga.alias("goals_against"), result.alias("team_result"))
    return reconcile.reconcile(labels, fixtures, ["match_id"]).select("match_id", "date", "grade", "fields", "label_venue", "fixture_venue", "label_team_result", "fixture_team_result")


_LINEUP = """lineup AS (SELECT e.user_id AS name, 'm' || (e.event_id % 500)::VARCHAR AS match_url, 't' || (e.user_id % 7)::VARCHAR AS team, CASE WHEN e.event_id % 3 = 0 THEN 'Suplente' ELSE 'Starter' END AS status,
  (e.event_id % 91)::INT AS m, e.event_type FROM events e)"""


def _lineups(spark, d):
    m = (F.col("event_id") % 91).cast("string")
    cell = lambda kind, s: F.when(F.col("event_type") == kind, s)
    return B.table(spark, d, "events").select(
        F.col("user_id").alias("name"), F.concat(F.lit("m"), (F.col("event_id") % 500).cast("string")).alias("match_url"), F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("team"),
        F.when(F.col("event_id") % 3 == 0, "Suplente").otherwise("Starter").alias("status"), cell("click", F.concat(m, F.lit(", 45+2'"))).alias("Goals"), cell("view", F.concat(m, F.lit("'"))).alias("Assists"),
        cell("error", F.concat(m, F.lit(" (g.p.)"))).alias("Red Card"), cell("purchase", m).alias("Yellow Card"),
        F.when((F.col("event_id") % 3 != 0) & (F.col("event_id") % 2 == 0), m).alias("Substitution OUT"), F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") % 2 == 0), m).alias("Substitution IN"), "event_id",
    )


@query(f"""SELECT *, goals + assists AS goals_assists, {_r('(goals + assists) / matches::DOUBLE', 2)} AS goals_assists_per_game,
    CASE WHEN minutes > 0 THEN {_r('(goals + assists) / minutes::DOUBLE * 90', 2)} ELSE 0 END AS goals_assists_per_90 FROM (
  SELECT team, name, count(DISTINCT match_url) AS matches, count(DISTINCT match_url) FILTER (status = 'Starter') AS starts, count(DISTINCT match_url) FILTER (status = 'Suplente') AS substitute,
    sum(CASE WHEN event_type = 'click' THEN 2 ELSE 0 END) AS goals, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS assists, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS yellow_cards,
    sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS red_cards,
    sum(CASE WHEN status = 'Starter' THEN CASE WHEN event_id % 2 = 0 THEN m ELSE 90 END ELSE CASE WHEN event_id % 2 = 0 THEN 90 - m ELSE 0 END END) AS minutes
  FROM (SELECT l.*, e.event_id FROM lineup l JOIN events e ON false UNION ALL SELECT e.user_id, 'm' || (e.event_id % 500)::VARCHAR, 't' || (e.user_id % 7)::VARCHAR,
    CASE WHEN e.event_id % 3 = 0 THEN 'Suplente' ELSE 'Starter' END, (e.event_id % 91)::INT, e.event_type, e.event_id FROM events e) GROUP BY 1, 2)""", _LINEUP)
def player_season_stats(spark, d):
    return players.season_stats(_lineups(spark, d))


@query("""SELECT match_url, team, name AS player_name, minute, kind AS event_type, CASE WHEN kind = 'goal' THEN 'open_play' END AS goal_type FROM (
  SELECT match_url, team, name, unnest(CASE event_type WHEN 'click' THEN [m, 47] ELSE [m] END) AS minute, CASE event_type WHEN 'click' THEN 'goal' WHEN 'view' THEN 'assist'
    WHEN 'purchase' THEN 'yellow_card' ELSE 'red_card' END AS kind FROM lineup WHERE event_type IN ('click', 'view', 'purchase', 'error'))""", _LINEUP)
def match_events(spark, d):
    return players.events(_lineups(spark, d))
