"""Queries of derived body metrics, position baselines and report figures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import anthropometry as A
from ..functions import colours
from ..functions.dates import PHASE_ORDER, position
from ..functions.numbers import half_even
from ..operators import baselines as P
from ..operators import asof, body, comparison, composition, load, models, reports, summaries
from ..operators import sessions as S
from . import bindings as B
from .reference import _DAILY, _GREF, _MONO, _OFFICIAL, BOD, E, SES, _r, query
from .reference_more import _long, _lookback, _LOOK

# --- derived body metrics ---------------------------------------------------

_SITES = tuple(composition.FOLDS.values())
#: Column -> (rows that have it, value) in the shared syntax of both engines.
_SHEET = {
    composition.FAT_SEDENTARY: ("k % 5 <> 0", "10 + k % 80 / 10"), composition.FAT_ATHLETE: ("k % 3 = 0", "8 + k % 60 / 10"), "Peso": ("k % 17 <> 0", "60 + k % 300 / 10"),
    "Altura": ("k % 19 <> 0", "165 + k % 30"), "Massa Magra": ("k % 2 = 0", "50 + k % 150 / 10"), "Massa Muscular": ("k % 7 <> 0", "30 + k % 100 / 10"), "Perímetro Cintura": ("k > 0", "70 + k % 30"),
    "Perímetro Anca/Glúteo": ("k % 11 <> 0", "85 + k % 25"), "Perímetro Umbigo": ("k % 13 <> 0", "75 + k % 20"), "Perímetro Braço": ("k > 0", "28 + k % 80 / 10"), "Perímetro Coxa": ("k > 0", "50 + k % 120 / 10"),
    "Perímetro Gémeo": ("k > 0", "33 + k % 70 / 10"), **{s: (f"(k + {i}) % 9 <> 0", f"5 + (k * {i + 3}) % 150 / 10") for i, s in enumerate(_SITES)},
}
_MEASURED = "measured AS (SELECT player_id, date, CASE WHEN player_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex, 15 + k % 45 AS age, " + ", ".join(
    f'''CASE WHEN {has} THEN {value.replace("/ 10", "/ 10.0::DOUBLE")} END::DOUBLE AS "{c}"''' for c, (has, value) in _SHEET.items()
) + """ FROM (SELECT c_nationkey AS player_id, max(CAST(o_orderdate AS DATE)) AS date, max(o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority = '2-HIGH' GROUP BY c_nationkey, date_trunc('quarter', o_orderdate)))"""


_SED, _ATH = composition.FAT_SEDENTARY, composition.FAT_ATHLETE
_LEANFAT = """CASE WHEN "Peso" > 0 AND "Massa Magra" > 0 THEN ("Peso" - "Massa Magra") / "Peso" * 100 END"""
# Each row is left out by joining it to all others of its player.
_BOARD = f"""known AS (SELECT player_id, date, "{_SED}" AS x, "{_ATH}" AS y, {_LEANFAT} AS bal FROM measured WHERE "{_SED}" IS NOT NULL AND "{_ATH}" IS NOT NULL),
folds AS (SELECT a.player_id, a.date, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.bal) AS bal, avg(b.x - b.y) AS c, avg(b.y / b.x) FILTER (b.x <> 0) AS k,
    CASE WHEN count(DISTINCT b.x) > 1 THEN regr_slope(b.y, b.x) END AS s, CASE WHEN count(DISTINCT b.x) > 1 THEN regr_intercept(b.y, b.x) END AS i
  FROM known a JOIN known b ON a.player_id = b.player_id AND a.date <> b.date GROUP BY 1, 2),
fits AS (SELECT player_id, count(*) AS n_paired, avg(x - y) AS c, avg(y / x) FILTER (x <> 0) AS k, CASE WHEN count(DISTINCT x) > 1 THEN regr_slope(y, x) END AS s,
    CASE WHEN count(DISTINCT x) > 1 THEN regr_intercept(y, x) END AS i FROM known GROUP BY 1),
board AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY loo_mae_pp, n_params, place) AS rank FROM (
  SELECT player_id, model, any_value(n_params) AS n_params, {_r('avg(e)', 3)} AS loo_mae_pp, {_r('max(e)', 3)} AS loo_max_pp, any_value(n_paired)::BIGINT AS n_paired, any_value(place) AS place FROM (
    SELECT player_id, m.*, n_paired, abs(y - CASE place WHEN 0 THEN f.x - f.c WHEN 1 THEN f.x * f.k WHEN 2 THEN f.i + f.s * f.x ELSE f.bal END) AS e
    FROM folds f JOIN fits USING (player_id), (VALUES ('desvio constante', 1, 0), ('rácio constante', 1, 1), ('regressão linear', 2, 2), ('balanço de massa', 0, 3)) m(model, n_params, place))
  GROUP BY 1, 2 HAVING avg(e) IS NOT NULL AND (any_value(n_params) = 0 OR any_value(n_paired) >= any_value(n_params) + 2)))"""
_SHEETS = _MEASURED + f""",
{_BOARD},
sheets AS (SELECT m.*, CASE b.place WHEN 0 THEN "{_SED}" - f.c WHEN 1 THEN "{_SED}" * f.k WHEN 2 THEN f.i + f.s * "{_SED}" WHEN 3 THEN {_LEANFAT} END AS model_value
  FROM measured m LEFT JOIN fits f USING (player_id) LEFT JOIN (SELECT * FROM board WHERE rank = 1) b USING (player_id))"""


def _measured(spark, d):
    """Wide assessments with all measured columns, one for each player and quarter."""
    day = F.to_date("o_orderdate")
    own = B.table(spark, d, "orders").filter("o_orderpriority = '2-HIGH'").join(B.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = own.groupBy(F.col("c_nationkey").alias("player_id"), F.trunc(day, "quarter")).agg(F.max(day).alias("date"), F.max("o_orderkey").alias("k"))
    return rows.select(
        "player_id", "date", F.when(F.col("player_id") % 2 == 0, "M").otherwise("F").alias("sex"), (15 + F.col("k") % 45).alias("age"),
        *(F.when(F.expr(has), F.expr(value).cast("double")).alias(c) for c, (has, value) in _SHEET.items()),
    )


def _balance():
    return A.fat_from_lean_mass(F.col("Peso"), F.col("`Massa Magra`"))


def _sheets(spark, d):
    """The assessments with what the best of each player's models says of them."""
    return models.predicted(_measured(spark, d), E, _SED, _ATH, _balance())


@query("SELECT player_id, model, n_params, loo_mae_pp, loo_max_pp, n_paired, rank FROM board", _MEASURED, _BOARD)
def athlete_models(spark, d):
    return models.scoreboard(_measured(spark, d), E, _SED, _ATH, _balance()).drop("a", "b")


@query("SELECT player_id, model, loo_mae_pp AS mae FROM board WHERE rank = 1", _MEASURED, _BOARD)
def loo_model_selection(spark, d):
    best = models.scoreboard(_measured(spark, d), E, _SED, _ATH, _balance()).filter("rank = 1")
    return best.select("player_id", "model", F.col("loo_mae_pp").alias("mae"))


_T, _SUB, _BI, _SUPRA, _AB, _TH, _CA, _IL = (f'"{s}"' for s in _SITES)
_GAP = f"""gaps AS (SELECT player_id, coalesce(p, i) AS gap, CASE WHEN np > 0 THEN np ELSE ni END AS n, CASE WHEN np > 0 THEN 'printed' WHEN ni > 0 THEN 'lean mass' ELSE '' END AS origin FROM (
  SELECT player_id, avg(sed - ath) AS p, count(sed - ath) AS np, avg(sed - lean) AS i, count(sed - lean) AS ni FROM (
    SELECT player_id, "{composition.FAT_SEDENTARY}" AS sed, "{composition.FAT_ATHLETE}" AS ath, {_LEANFAT} AS lean FROM sheets) GROUP BY 1))"""


@query(f"SELECT player_id, {_r('gap', 6)} AS gap, n, origin FROM gaps", _SHEETS, _GAP)
def calibrated_gap(spark, d):
    return composition.calibrate_gap(_sheets(spark, d), E).withColumn("gap", half_even(F.col("gap"), 6))


def _sum(*cols):
    return " + ".join(cols)


def _any(*cols):
    return f"CASE WHEN coalesce({', '.join(cols)}) IS NOT NULL THEN {' + '.join(f'coalesce({c}, 0)' for c in cols)} END"


def _density(sex, bands):
    return " ".join(f"WHEN sex = '{sex}' AND age <= {high} THEN {c}::DOUBLE - {m}::DOUBLE * log10(s4)" for high, c, m in bands)


# Durnin and Womersley's published bands, written out apart from the operator's table.
_MEN = ((19, 1.1620, 0.0630), (29, 1.1631, 0.0632), (39, 1.1422, 0.0544), (49, 1.1620, 0.0700), (200, 1.1715, 0.0779))
_WOMEN = ((19, 1.1549, 0.0678), (29, 1.1599, 0.0717), (39, 1.1423, 0.0632), (49, 1.1333, 0.0612), (200, 1.1339, 0.0645))
_BODYSTAGE = f"""staged AS (SELECT *, w - fat AS free, coalesce(ath, model_value, lean, sed - gap, faulkner) AS athlete,
    CASE WHEN ath IS NOT NULL THEN 'printed' WHEN model_value IS NOT NULL THEN 'model' WHEN lean IS NOT NULL THEN 'lean mass' WHEN sed - gap IS NOT NULL THEN 'gap' WHEN faulkner IS NOT NULL THEN 'skinfolds' END AS origin,
    CASE WHEN s4 > 0 THEN 495 / (CASE {_density('M', _MEN)} {_density('F', _WOMEN)} END) - 450 END AS dw
  FROM (SELECT s.*, g.gap, "{composition.FAT_SEDENTARY}" AS sed, "{composition.FAT_ATHLETE}" AS ath, nullif("Peso", 0) AS w, nullif("Altura", 0) / 100 AS h, nullif("Altura", 0) AS cm, nullif("Massa Muscular", 0) AS mus,
    {_LEANFAT} AS lean, nullif("Peso", 0) * nullif("{composition.FAT_SEDENTARY}", 0) / 100 AS fat, 0.153::DOUBLE * ({_sum(_T, _SUB, _IL, _AB)}) + 5.783::DOUBLE AS faulkner, {_sum(_T, _BI, _SUB, _IL)} AS s4,
    "Perímetro Coxa" - pi() * {_TH} / 10 AS thigh, "Perímetro Gémeo" - pi() * {_CA} / 10 AS calf, "Perímetro Braço" - pi() * {_T} / 10 AS arm,
    {_any(_T, _BI, _TH, _CA)} AS limbs, {_any(_SUB, _IL, _AB)} AS trunk, {_any(_T, _SUB, _BI, _SUPRA, _AB, _TH, _CA, _IL)} AS folds,
    {' + '.join(f'({c} IS NOT NULL)::INT' for c in (_T, _SUB, _BI, _SUPRA, _AB, _TH, _CA, _IL))} AS n_folds
    FROM sheets s LEFT JOIN gaps g USING (player_id)))"""
_PET = f"({_sum(_SUB, _T, _IL, _CA)})"
_X3 = f"(({_T} + {_SUB} + coalesce({_SUPRA}, {_IL})) * 170.18::DOUBLE / cm)"
_METRICS_SQL = (
    ("composicao", "'% Massa Gorda (Atletas)'", "%", "athlete", "origin"), ("composicao", "'Diferença Sedentários - Atletas'", "pp", "sed - athlete", "''"), ("composicao", "'% Massa Gorda (Faulkner)'", "%", "faulkner", "''"),
    ("composicao", "'% Massa Gorda (Yuhasz)'", "%", f"0.1051::DOUBLE * ({_sum(_T, _SUB, _IL, _AB, _TH, _CA)}) + 2.585::DOUBLE", "''"),
    ("composicao", "'% Massa Gorda (Petroski)'", "%", f"CASE WHEN sex = 'M' THEN 495 / (1.10726863::DOUBLE - 0.00081201::DOUBLE * {_PET} + 0.00000212::DOUBLE * {_PET} * {_PET} - 0.00041761::DOUBLE * age) - 450 END", "''"),
    ("composicao", "'Massa Gorda (Atletas)'", "kg", "w * athlete / 100", "''"), ("composicao", "'Massa Isenta de Gordura (Atletas)'", "kg", "w * (1 - athlete / 100)", "''"), ("composicao", "'Massa Gorda'", "kg", "fat", "''"),
    ("composicao", "'Massa Isenta de Gordura'", "kg", "free", "''"), ("composicao", "'Coerência: MIG calculada - Massa Magra impressa'", "kg", "free - nullif(\"Massa Magra\", 0)", "''"),
    ("composicao", "'Índice de Massa Gorda (FMI)'", "kg/m2", "fat / (h * h)", "''"), ("composicao", "'Índice de Massa Isenta de Gordura (FFMI)'", "kg/m2", "free / (h * h)", "''"),
    ("composicao", "'FFMI normalizado (1.80m)'", "kg/m2", "free / (h * h) + 6.1::DOUBLE * (1.8::DOUBLE - h)", "''"), ("composicao", "'Índice de Massa Muscular'", "kg/m2", "mus / (h * h)", "''"),
    ("distribuicao", "'Rácio Cintura/Altura'", "", "\"Perímetro Cintura\" / cm", "''"), ("distribuicao", "'Rácio Cintura/Anca (recalculado)'", "", "\"Perímetro Cintura\" / \"Perímetro Anca/Glúteo\"", "''"),
    ("distribuicao", "'Rácio Umbigo/Altura'", "", "\"Perímetro Umbigo\" / cm", "''"), ("distribuicao", "'Soma de Pregas (recalculada)'", "mm", "folds", "n_folds::VARCHAR"),
    ("futebol", "'Soma ISAK (' || n_folds::VARCHAR || ' de 8 sítios)'", "mm", "folds", "''"), ("futebol", "'Soma 6 pregas (referência de atletas)'", "mm", _sum(_T, _SUB, _AB, _TH, _CA, _IL), "''"),
    ("distribuicao", "'Soma pregas tronco'", "mm", "trunk", "''"), ("distribuicao", "'Soma pregas membros'", "mm", "limbs", "''"), ("distribuicao", "'Rácio Pregas Tronco/Membros'", "", "trunk / nullif(limbs, 0)", "''"),
    ("composicao", "'% Massa Gorda (Durnin-Womersley)'", "%", "dw", "''"), ("composicao", "'Diferença entre métodos (%MG)'", "pp", "sed - dw", "''"), ("futebol", "'Perímetro Coxa corrigido'", "cm", "thigh", "''"),
    ("futebol", "'Perímetro Gémeo corrigido'", "cm", "calf", "''"), ("futebol", "'Perímetro Braço corrigido'", "cm", "arm", "''"), ("futebol", "'Área muscular estimada da coxa'", "cm2", "thigh * thigh / (4 * pi())", "''"),
    ("futebol", "'Área muscular estimada do gémeo'", "cm2", "calf * calf / (4 * pi())", "''"), ("futebol", "'Coxa corrigida / peso'", "cm/kg", "thigh / w", "''"), ("futebol", "'Massa Isenta de Gordura / Peso'", "%", "free / w * 100", "''"),
    ("futebol", "'Índice alométrico de massa magra'", "", "free / pow(w, 0.67)", "''"), ("futebol", "'Rácio Músculo/Gordura (recalculado)'", "", "mus / fat", "''"),
    ("futebol", "'Somatótipo - Endomorfia'", "", f"-0.7182::DOUBLE + 0.1451::DOUBLE * {_X3} - 0.00068::DOUBLE * {_X3} * {_X3} + 0.0000014::DOUBLE * {_X3} * {_X3} * {_X3}", f"CASE WHEN {_SUPRA} IS NULL THEN 'suprailiac' ELSE '' END"),
    ("futebol", "'Somatótipo - Ectomorfia'", "", "CASE WHEN cm / cbrt(w) >= 40.75 THEN 0.732::DOUBLE * (cm / cbrt(w)) - 28.58::DOUBLE WHEN cm / cbrt(w) > 38.25 THEN 0.463::DOUBLE * (cm / cbrt(w)) - 17.63::DOUBLE WHEN cm / cbrt(w) IS NOT NULL THEN 0.1::DOUBLE END", "''"),
    ("futebol", "'Área de Superfície Corporal (Du Bois)'", "m2", "0.007184::DOUBLE * pow(cm, 0.725) * pow(w, 0.425)", "''"),
)
_ROWS = " UNION ALL ".join(f"SELECT player_id, date, '{g}' AS \"group\", {m} AS metric, '{u}' AS unit, ({v})::DOUBLE AS value, {n} AS note FROM staged" for g, m, u, v, n in _METRICS_SQL)
_DERIVED = f"""derived AS (SELECT player_id, date, CASE WHEN month(date) >= 7 THEN year(date)::VARCHAR || '/' || lpad(((year(date) + 1) % 100)::VARCHAR, 2, '0')
    ELSE (year(date) - 1)::VARCHAR || '/' || lpad((year(date) % 100)::VARCHAR, 2, '0') END AS season,
  CASE WHEN month(date) = 7 THEN 'fora de época' WHEN month(date) = 8 THEN 'pré-época' WHEN month(date) >= 9 THEN '1ª volta' WHEN month(date) <= 5 THEN '2ª volta' ELSE 'final de época' END AS phase,
  "group", metric, unit, {_r('value', 2)} AS value, note FROM ({_ROWS}) WHERE value IS NOT NULL)"""


def _derived(spark, d):
    return composition.derive(_sheets(spark, d), E, F.col("sex"), F.col("age"), F.col("model_value"))


@query("SELECT * FROM derived", _SHEETS, _GAP, _BODYSTAGE, _DERIVED)
def derived_body_metrics(spark, d):
    return _derived(spark, d)


def _listed(names):
    return ", ".join(f"'{x}'" for x in names)


_FAMILY = " ".join(f"WHEN metric = '{k}' THEN '{v}'" for k, v in composition.FAMILY_OF.items()) + " " + " ".join(f"WHEN starts_with(metric, '{k}') THEN '{v}'" for k, v in composition.FAMILY_STARTS.items())


@query(f"""SELECT DISTINCT metric, CASE WHEN metric IN ({_listed(composition.LOWER)}) THEN 'down' WHEN metric IN ({_listed(composition.HIGHER)}) THEN 'up' ELSE 'neutral' END AS direction,
  CASE {_FAMILY} ELSE 'Composição' END AS family FROM (SELECT metric FROM derived UNION ALL SELECT metric FROM long_body)""", _SHEETS, _GAP, _BODYSTAGE, _DERIVED, BOD)
def metric_legend(spark, d):
    return composition.legend(_derived(spark, d).select("metric").union(_long(spark, d).select("metric")))


@query(f"""SELECT player_id, metric, base_date, latest_date, base, latest, {_r('latest - base', 2)} AS change, CASE WHEN base <> 0 THEN {_r('(latest - base) / base * 100', 1)} END AS change_pct, place FROM (
  SELECT player_id, metric, list_position([{_listed(reports.HEADLINE)}], metric) AS place, max(value) FILTER (r = 1) AS latest, max(value) FILTER (r = 2) AS base, max(date) FILTER (r = 1) AS latest_date, max(date) FILTER (r = 2) AS base_date
  FROM (SELECT *, row_number() OVER (PARTITION BY player_id, metric ORDER BY date DESC) AS r FROM derived WHERE metric IN ({_listed(reports.HEADLINE)})) GROUP BY 1, 2 HAVING count(*) > 1)""", _SHEETS, _GAP, _BODYSTAGE, _DERIVED)
def headline(spark, d):
    rows = _derived(spark, d)
    dimension = composition.legend(rows).select("metric", "direction", F.lit(0.5).alias("threshold"))
    return reports.headline(rows, E, dimension).drop("verdict")


_PHASES = ", ".join(f"'{p}'" for p in PHASE_ORDER)


@query(f"""SELECT player_id, phase, metric, n, phase_order, {_r('mean', 2)} AS mean, {_r('mean - lag(mean) OVER (PARTITION BY player_id, metric ORDER BY phase_order)', 2)} AS change FROM (
  SELECT player_id, phase, metric, count(*) AS n, list_position([{_PHASES}], phase) - 1 AS phase_order, avg(round_even(value * 100, 0)) AS mean FROM derived GROUP BY 1, 2, 3)""", _SHEETS, _GAP, _BODYSTAGE, _DERIVED)
def phase_profile(spark, d):
    # in hundredths: means of whole numbers don't depend on the order of the rows
    hundredths = _derived(spark, d).withColumn("value", F.rint(F.col("value") * 100))
    return reports.phase_profile(hundredths, E, position(F.col("phase"), PHASE_ORDER))


@query("""SELECT player_id, date, "Peso" AS body_value, total_distance_m_mean AS performance_value FROM assessments JOIN looked USING (player_id, date) WHERE "Peso" IS NOT NULL AND total_distance_m_mean IS NOT NULL""", SES, BOD, _LOOK)
def paired_observations(spark, d):
    return reports.paired(B.assessments(spark, d), _lookback(spark, d), ["player_id", "date"], "Peso", "total_distance_m_mean")


# --- position baselines -----------------------------------------------------

# Published demands by position, written out apart from the operator's table.
_BASE = """dim AS (SELECT * FROM (VALUES ('goalkeeper', 5000, 30, 10, 15, 15, 26), ('center_back', 10627, 612, 215, 26.5, 50.9, 32), ('full_back', 11410, 1054, 402, 30.4, 54.1, 32),
  ('central_midfielder', 12027, 875, 248, 27.1, 54.8, 32), ('wide_midfielder', 11990, 1184, 446, 34.9, 64.5, 32), ('forward', 11254, 1025, 404, 29.9, 55.2, 32))
  v(position, total_distance_m, high_speed_distance_m, sprint_distance_m, accelerations, decelerations, top_speed_kmh)),
part AS (SELECT * FROM (VALUES ('total_distance_m', 0.7), ('high_speed_distance_m', 0.45), ('sprint_distance_m', 0.35), ('accelerations', 0.75), ('decelerations', 0.75), ('top_speed_kmh', 0.95)) v(metric, share)),
""" + f"""base AS (SELECT position, metric, match_category, CASE match_category WHEN 'training' THEN {_r('v::DOUBLE * share::DOUBLE', 1)} ELSE v::DOUBLE END AS baseline FROM (
    UNPIVOT (SELECT position, total_distance_m::DOUBLE AS total_distance_m, high_speed_distance_m::DOUBLE AS high_speed_distance_m, sprint_distance_m::DOUBLE AS sprint_distance_m, accelerations::DOUBLE AS accelerations,
      decelerations::DOUBLE AS decelerations, top_speed_kmh::DOUBLE AS top_speed_kmh FROM dim) ON {', '.join(P.METRICS)} INTO NAME metric VALUE v) JOIN part USING (metric),
  (SELECT unnest(['training', 'official_match', 'practice_match']) AS match_category))"""


@query("SELECT * FROM base", _BASE)
def position_baselines(spark, d):
    return P.baselines(spark)


@query(f"""SELECT player_id, match_category, metric, n, {_r('mean', 2)} AS mean, baseline, {_r('mean / baseline * 100', 1)} AS pct FROM (
  UNPIVOT (SELECT player_id, match_category, count(*) AS n, {', '.join(f'avg({m}) AS {m}' for m in P.METRICS)} FROM sessions WHERE has_gps GROUP BY 1, 2) ON {', '.join(P.METRICS)} INTO NAME metric VALUE mean)
  JOIN base USING (match_category, metric) WHERE position = 'full_back'""", SES, _BASE)
def against_position(spark, d):
    return P.against(B.sessions(spark, d), "full_back", E).filter("mean is not null")


# --- reports ----------------------------------------------------------------

_SCOPE = reports.Scope("1996/97", date(1996, 9, 1), date(1997, 3, 31), ("official_match", "practice_match"))
_IN = "date BETWEEN DATE '1996-09-01' AND DATE '1997-03-31'"
_KIND = f"{_IN} AND match_category IN ('official_match', 'practice_match')"


@query(f"""SELECT player_id, count(*) AS season_sessions, count(*) FILTER ({_IN}) AS in_range, count(*) FILTER ({_KIND}) AS filtered, count(*) FILTER ({_KIND} AND has_gps) AS measured
  FROM sessions WHERE season = '1996/97' GROUP BY 1""", SES)
def report_scopes(spark, d):
    return _SCOPE.counts(B.sessions(spark, d), E)


@query("SELECT player_id, coalesce(max(season) FILTER (match_category = 'official_match'), max(season)) AS season FROM sessions GROUP BY 1", SES)
def default_season(spark, d):
    return reports.default_season(B.sessions(spark, d), E)


@query(f"""SELECT session_id, CASE WHEN duration_min > 0 THEN {_r('total_distance_m / duration_min', 2)} END AS distance_per_min FROM sessions WHERE match_category = 'training' AND year(date) = 1997""", SES)
def analyzed_year(spark, d):
    return reports.with_distance_per_min(reports.analyzed(B.sessions(spark, d), "training", year=1997)).select("session_id", "distance_per_min")


_CARDS = ("total_distance_m", "hia", "m_per_min", "top_speed_kmh")


@query(f"""SELECT c.player_id, c.season, c.metric, n, {_r('value', 2)} AS value, {_r('gref', 4)} AS gref, CASE WHEN gref > 0 THEN {_r('value / gref * 100', 1)} END AS pct FROM (SELECT * FROM
  (SELECT player_id, season, count(*) AS n, avg(total_distance_m) AS total_distance_m, avg(hia) AS hia, avg(m_per_min) AS m_per_min, max(top_speed_kmh) AS top_speed_kmh FROM sessions WHERE has_gps GROUP BY 1, 2)
  UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(_CARDS)}))) c LEFT JOIN gref g ON g.player_id = c.player_id AND g.season = c.season AND g.metric = c.metric""", SES, _GREF)
def report_cards(spark, d):
    rows = B.sessions(spark, d)
    return reports.cards(rows, comparison.match_reference(rows, E, list(_CARDS)), E, _CARDS)


@query(f"""SELECT b.player_id, season_best, season_best_date, range_best, coalesce(near_best, 0) AS near_best, coalesce(with_speed, 0) AS with_speed, coalesce(sprints, 0.0::DOUBLE) AS sprints, coalesce(sprint_m, 0.0::DOUBLE) AS sprint_m,
    round_even(CASE WHEN season_best > 0 THEN range_best / season_best * 100 END, 0) AS range_pct_of_best FROM best b LEFT JOIN (
  SELECT s.player_id, max(top_speed_kmh) AS range_best, count(*) FILTER (top_speed_kmh >= 0.9::DOUBLE * season_best) AS near_best, count(top_speed_kmh) AS with_speed, coalesce(sum(sprints_total), 0) AS sprints,
    coalesce(sum(sprint_distance_m), 0) AS sprint_m FROM sessions s JOIN best USING (player_id) WHERE has_gps AND season = '1996/97' AND {_KIND} GROUP BY 1) r ON r.player_id = b.player_id""", SES,
  """best AS (SELECT player_id, max(top_speed_kmh) AS season_best, min(date) FILTER (top_speed_kmh = top) AS season_best_date FROM (
    SELECT *, max(top_speed_kmh) OVER (PARTITION BY player_id) AS top FROM sessions WHERE has_gps AND season = '1996/97') GROUP BY 1)""")
def speed_report(spark, d):
    rows = B.sessions(spark, d)
    return reports.speed(_SCOPE.season_sessions(rows), _SCOPE.filtered(rows), E)


@query(f"""SELECT s.player_id, session_id, match_category, s.metric, {_r('v / gref * 100', 1)} AS pct FROM (
  UNPIVOT (SELECT player_id, season, session_id, match_category, {', '.join(_CARDS)} FROM sessions WHERE has_gps AND match_category IN ('official_match', 'practice_match')) ON {', '.join(_CARDS)} INTO NAME metric VALUE v) s
  JOIN gref g ON g.player_id = s.player_id AND g.season = s.season AND g.metric = s.metric WHERE gref <> 0""", SES, _GREF)
def games_in_reference(spark, d):
    rows = B.sessions(spark, d)
    return reports.games_in_reference(rows, comparison.match_reference(rows, E, list(_CARDS)), E, _CARDS)


# Fixtures are the days of practice matches, each with a venue and a result; an official match takes those of the nearest one within a day.
_LINKED = """plays AS (SELECT DISTINCT player_id, date AS fixture_date, CASE WHEN day(date) % 2 = 0 THEN 'home' ELSE 'away' END AS venue, CASE day(date) % 3 WHEN 0 THEN 'W' WHEN 1 THEN 'D' ELSE 'L' END AS team_result
  FROM sessions WHERE match_category = 'practice_match'),
linked AS (SELECT * FROM (SELECT s.*, g.fixture_date, g.venue, g.team_result, CASE WHEN g.fixture_date IS NULL THEN NULL WHEN g.fixture_date = s.date THEN 'exact' ELSE printf('%+dd', s.date - g.fixture_date) END AS fixture_match,
    row_number() OVER (PARTITION BY s.session_id ORDER BY abs(s.date - g.fixture_date), g.fixture_date) AS choice
  FROM official s LEFT JOIN plays g ON g.player_id = s.player_id AND abs(s.date - g.fixture_date) <= 1 WHERE s.match_category = 'official_match') WHERE choice = 1)"""


def _linked(spark, d):
    rows = B.sessions(spark, d)
    day = F.col("date")
    plays = rows.filter("match_category = 'practice_match'").select(
        "player_id", day.alias("fixture_date"), F.when(F.dayofmonth(day) % 2 == 0, "home").otherwise("away").alias("venue"),
        F.when(F.dayofmonth(day) % 3 == 0, "W").when(F.dayofmonth(day) % 3 == 1, "D").otherwise("L").alias("team_result"),
    ).distinct()
    official = S.per90(S.official_minutes(rows.filter("match_category = 'official_match'")), "official_minutes")
    return asof.nearest(official, plays, E, "session_id", "date", "fixture_date", ["fixture_date", "venue", "team_result"])


@query("SELECT player_id, fixture_match, count(*) AS sessions FROM linked GROUP BY 1, 2", SES, _OFFICIAL, _LINKED)
def link_coverage(spark, d):
    linked = _linked(spark, d).withColumn("fixture_match", F.when(F.col("fixture_date").isNotNull(), F.col("match_quality")))
    return reports.link_coverage(linked, "fixture_match", E)


def _by(column):
    return f"""SELECT player_id, {column}, count(*) AS n, {_r('avg(official_minutes)', 1)} AS mean_minutes, {_r('avg(p90)', 1)} AS total_distance_m_per90_mean FROM (
  SELECT *, CASE WHEN official_minutes > 0 THEN {_r('total_distance_m / official_minutes * 90', 2)} END AS p90 FROM linked) WHERE official_minutes >= 20 AND {column} IS NOT NULL GROUP BY 1, 2"""


@query(_by("team_result"), SES, _OFFICIAL, _LINKED)
def output_by_result(spark, d):
    return summaries.output_by(_linked(spark, d), E, "team_result", ("total_distance_m",))


@query(_by("venue"), SES, _OFFICIAL, _LINKED)
def output_by_venue(spark, d):
    return summaries.output_by(_linked(spark, d), E, "venue", ("total_distance_m",))


_SHOWN = ("total_distance_m", "high_speed_distance_m", "sprint_distance_m", "accelerations", "decelerations")


@query(f"""SELECT player_id, metric, {_r('value', 2)} AS value, baseline, {_r('value - baseline', 2)} AS difference, {_r('(value - baseline) / baseline * 100', 1)} AS difference_pct FROM (
  SELECT player_id, {', '.join(f"avg({_r(f'{m} / official_minutes * 90', 2)}) AS {m}" for m in _SHOWN)}, max(top_speed_kmh) AS top_speed_kmh FROM official WHERE official_minutes >= 20 AND match_category = 'official_match' GROUP BY 1)
  UNPIVOT (value FOR metric IN ({', '.join(_SHOWN)}, top_speed_kmh)) JOIN (SELECT metric AS m, baseline FROM base WHERE position = 'wide_midfielder' AND match_category = 'official_match') b ON m = metric""", SES, _OFFICIAL, _BASE)
def baseline_compare(spark, d):
    games = S.per90(S.official_minutes(B.sessions(spark, d)), "official_minutes").filter("match_category = 'official_match'")
    dim = P.baselines(spark, ["wide_midfielder"]).filter("match_category = 'official_match'").select("metric", "baseline")
    return summaries.against_baseline(games, dim, E, _SHOWN)


_DOWN = "ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY date DESC, session_id DESC)"


@query(f"""SELECT player_id, max(latest) AS latest, CASE WHEN count(total_distance_m) > 0 THEN {_r('count(*) FILTER (total_distance_m < latest) / count(total_distance_m) * 100', 1)} END AS pct_rank,
    {_r('avg(hs) FILTER (r <= 5)', 2)} AS hsr_share_last, {_r('avg(sp) FILTER (r <= 5)', 2)} AS sprint_share_last FROM (
  SELECT s.*, {_DOWN.replace('player_id', 's.player_id', 1)} AS r, l.latest, CASE WHEN total_distance_m > 0 THEN {_r('high_speed_distance_m / total_distance_m * 100', 2)} END AS hs,
    CASE WHEN total_distance_m > 0 THEN {_r('sprint_distance_m / total_distance_m * 100', 2)} END AS sp
  FROM sessions s LEFT JOIN (SELECT player_id, max_by(total_distance_m, (date, session_id)) AS latest FROM sessions WHERE total_distance_m IS NOT NULL GROUP BY 1) l ON l.player_id = s.player_id) GROUP BY 1""", SES)
def latest_form(spark, d):
    return reports.latest_form(B.sessions(spark, d), E, "total_distance_m")


@query(f"""SELECT player_id, max(week_start) AS week_start, max_by(monotony, week_start) AS latest_monotony, max_by(strain, week_start) AS latest_strain, {_r('median(strain)', 1)} AS typical_strain FROM (
  SELECT *, {_r('total * monotony', 1)} AS strain FROM mono) WHERE monotony IS NOT NULL GROUP BY 1""", SES, _DAILY, _MONO)
def typical_week(spark, d):
    return reports.typical_week(load.monotony_and_strain(load.daily_load(B.sessions(spark, d), E), E), E)


def _ratio_sql(value, name):
    return f"""{name}_w AS (SELECT player_id, date - dayofweek(date)::INT AS week_start, coalesce(sum({value}), 0) AS total FROM sessions GROUP BY 1, 2),
{name}_all AS (SELECT s.player_id, s.w::DATE AS week_start, coalesce(k.total, 0) AS total, s.w::DATE + 6 > last_day AS partial FROM (
    SELECT player_id, unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY)) AS w FROM {name}_w GROUP BY 1) s
  JOIN (SELECT player_id, max(date) AS last_day FROM sessions GROUP BY 1) e ON e.player_id = s.player_id LEFT JOIN {name}_w k ON k.player_id = s.player_id AND k.week_start = s.w),
{name} AS (SELECT player_id, week_start, CASE WHEN rn > 4 AND NOT partial AND m <> 0 THEN {_r('total / m', 2)} END AS acwr FROM (
  SELECT *, CASE WHEN count(total) OVER w = 4 THEN sum(total) OVER w / 4 END AS m, row_number() OVER (PARTITION BY player_id ORDER BY week_start) AS rn FROM {name}_all
  WINDOW w AS (PARTITION BY player_id ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)))"""


@query("""SELECT coalesce(a.player_id, b.player_id) AS player_id, coalesce(a.week_start, b.week_start) AS week_start, a.acwr AS mechanical_acwr, b.acwr AS distance_acwr
  FROM mech a FULL JOIN dist b ON a.player_id = b.player_id AND a.week_start = b.week_start WHERE a.acwr IS NOT NULL OR b.acwr IS NOT NULL""",
  SES, _ratio_sql("CASE WHEN coalesce(accelerations, decelerations) IS NOT NULL THEN coalesce(accelerations, 0) + coalesce(decelerations, 0) END", "mech"), _ratio_sql("total_distance_m", "dist"))
def two_ratios(spark, d):
    return reports.two_ratios(B.sessions(spark, d), E)


# --- colours ------------------------------------------------------------------


def _hex(x: str, stops) -> str:
    """The colour at ``x`` in SQL: a row of stops on each side, channels between them."""
    part = lambda c, at: int(c[at : at + 2], 16)
    pieces = []
    for at in (1, 3, 5):
        whens = " ".join(
            f"WHEN v <= {x1} THEN {part(c0, at)} + ({part(c1, at)} - {part(c0, at)}) * ((v - {x0}) / ({x1} - {x0}))" for (x0, c0), (x1, c1) in zip(stops, stops[1:], strict=False)
        )
        pieces.append(f"CASE WHEN v <= {stops[0][0]} THEN {part(stops[0][1], at)} {whens} ELSE {part(stops[-1][1], at)} END")
    shown = " || ".join(f"lpad(upper(to_hex(round_even(({p})::DOUBLE, 0)::BIGINT)), 2, '0')" for p in pieces)
    return f"CASE WHEN ({x}) IS NULL THEN '#1F1F1F' ELSE (SELECT '#' || {shown} FROM (SELECT ({x})::DOUBLE AS v)) END"


_STOPS = ((0.0, "#22B14C"), (5.0, "#22B14C"), (15.0, "#E9C21B"), (25.0, "#EE8A2A"), (35.0, "#D9433F"))
_RAMP = ((0.0, "#0D366B"), (25.0, "#1C5CAB"), (50.0, "#3987E5"), (75.0, "#86B6EF"), (100.0, "#CDE2FB"))
_CHANGED = """shares AS (SELECT session_id, total_distance_m / 8208.0::DOUBLE * 100 AS share, (total_distance_m - lag(total_distance_m) OVER (PARTITION BY player_id ORDER BY date, session_id))
  / nullif(lag(total_distance_m) OVER (PARTITION BY player_id ORDER BY date, session_id), 0) * 100 AS change FROM sessions)"""


@query(f"""SELECT session_id, {_hex('abs(change)', _STOPS)} AS change_colour, {_hex('share', _RAMP)} AS demand_colour,
    CASE WHEN change IS NULL THEN '#1F1F1F' WHEN abs(change) <= 10 THEN '#22B14C' WHEN abs(change) <= 20 THEN '#E9C21B' WHEN abs(change) <= 30 THEN '#EE8A2A' ELSE '#D9433F' END AS change_band FROM shares""", SES, _CHANGED)
def heat_colours(spark, d):
    w = Window.partitionBy(*E).orderBy("date", "session_id")
    before = F.lag("total_distance_m").over(w)
    rows = B.sessions(spark, d).select("session_id", (F.col("total_distance_m") / 8208.0 * 100).alias("share"), F.when(before != 0, (F.col("total_distance_m") - before) / before * 100).alias("change"))
    return rows.select("session_id", colours.change_colour(F.col("change")).alias("change_colour"), colours.demand_colour(F.col("share")).alias("demand_colour"), colours.change_band(F.col("change")).alias("change_band"))
