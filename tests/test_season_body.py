import math
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from loadlark.functions import anthropometry, text
from loadlark.operators import asof, body, correlation, players, season
from loadlark.plans.reference import queries
from loadlark.sources import pages as pages_of
from loadlark.sources import readers, sinks
from loadlark.streaming.weekly import weekly_load_stream

MATCH = "matchweek_number int, home_team string, away_team string, home_goals int, away_goals int"


def test_league_table_and_strength(spark):
    m = spark.createDataFrame([(1, "A", "B", 2, 0), (1, "C", "A", 1, 1), (2, "B", "C", 0, 3)], MATCH)
    got = {r["team"]: r for r in season.ranked(season.league_table(m)).collect()}
    assert [(t, got[t]["points"], got[t]["gd"], got[t]["position"]) for t in "CAB"] == [("C", 4, 3, 1), ("A", 4, 2, 2), ("B", 0, -5, 3)]
    s = {r["team"]: r for r in season.team_strength(m).collect()}
    assert abs(s["A"]["mean_goals"] - 7 / 6) < 1e-12 and abs(s["A"]["attack"] - 1.5 / (7 / 6)) < 1e-12


def test_simulation_adds_up_and_is_reproducible(spark):
    played = spark.createDataFrame([(1, "A", "B", 2, 0), (1, "C", "D", 1, 1)], MATCH)
    rest = spark.createDataFrame([(2, "A", "C"), (2, "B", "D"), (3, "D", "A"), (3, "C", "E")], "matchweek_number int, home_team string, away_team string")
    table, places = season.simulate(played, rest, 100, 7)
    rows = table.collect()
    assert len(rows) == 5 and abs(sum(r["title_pct"] for r in rows) - 100) < 1e-6
    again, _ = season.simulate(played, rest.repartition(3), 100, 7)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))
    assert places.agg(F.sum("times")).first()[0] == 500


def test_season_query_is_the_brute_force_of_all_remaining_fixtures(spark):
    sf, n = "/root/testdata/sf0.001", 1000
    played = [tuple(r) for r in queries()["fixtures_played"](spark, sf).select("home_team", "away_team", "home_goals", "away_goals").collect()]
    remaining = queries()["fixtures_remaining"](spark, sf).cache()
    assert len({r[0] for r in remaining.select("matchweek_number").distinct().collect()}) == 8
    sides = [x for h, a, i, j in played for x in ((h, i, j), (a, j, i))]
    level = sum(x[1] for x in sides) / len(sides)
    fixtures = sorted(map(tuple, remaining.collect()))
    teams = sorted({x[0] for x in sides} | {t for f in fixtures for t in f[1:]})
    own = {t: [x[1:] for x in sides if x[0] == t] for t in teams}
    mean = lambda t, k: sum(x[k] for x in own[t]) / len(own[t])
    attack = {t: mean(t, 0) / level if own[t] else 1.0 for t in teams}
    defense = {t: level / (mean(t, 1) + 0.1) if own[t] else 1.0 for t in teams}
    u = lambda side: season.uniform(F.lit(42), "sim", "matchweek_number", "home_team", "away_team", F.lit(side)).alias(side)
    names = ["matchweek_number", "home_team", "away_team"]
    drawn = remaining.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*names, "sim", u("h"), u("a")).toArrow()
    drawn = drawn.sort_by([(c, "ascending") for c in (*names, "sim")])
    hu, au = (drawn.column(c).to_numpy().reshape(len(fixtures), n) for c in "ha")
    at = {t: k for k, t in enumerate(teams)}
    points, gd, games, scored = (np.zeros((n, len(teams))) for _ in range(4))

    def add(h, a, i, j):
        for t, x, y in ((at[h], i, j), (at[a], j, i)):
            points[:, t] += np.where(x > y, 3, np.where(x == y, 1, 0))
            gd[:, t] += x - y
            scored[:, t] += x
            games[:, t] += 1

    def goals(mean, us):
        steps = np.cumsum([math.exp(-mean) * mean**k / math.factorial(k) for k in range(30)])
        return np.searchsorted(steps, us, "left")

    for h, a, i, j in played:
        add(h, a, np.int64(i), np.int64(j))
    for k, (_, h, a) in enumerate(fixtures):
        add(h, a, goals(attack[h] / defense[a] * level / 2 * 1.15, hu[k]), goals(attack[a] / defense[h] * level / 2, au[k]))
    place = np.empty((n, len(teams)))
    for s in range(n):
        place[s, np.lexsort((np.arange(len(teams)), -gd[s], -points[s]))] = np.arange(1, len(teams) + 1)
    got = {r["team"]: r for r in queries()["simulate_season"](spark, sf).collect()}
    assert sorted(got) == teams
    for t, k in at.items():
        r = got[t]
        assert r["mean_played"] == games[0, k]
        for name, want in (("points", points), ("gd", gd), ("goals_scored", scored), ("position", place)):
            assert abs(r[f"mean_{name}"] - want[:, k].mean()) < 0.0051
        for name, want in (("title", place == 1), ("top3", place <= 3), ("bottom3", place > len(teams) - 3)):
            assert abs(r[f"{name}_pct"] - 100 * want[:, k].mean()) < 0.051


def test_season_without_any_goal_is_simulated(spark):
    played = spark.createDataFrame([(1, "A", "B", 0, 0), (1, "C", "D", 0, 0)], MATCH)
    rest = spark.createDataFrame([(2, "A", "C"), (2, "E", "D")], "matchweek_number int, home_team string, away_team string")
    strength = {(r["attack"], r["defense"]) for r in season.team_strength(played).collect()}
    assert strength == {(0.0, 0.0)}
    assert {(r["home_xg"], r["away_xg"]) for r in season.expected_goals(rest, season.team_strength(played)).collect()} == {(0.0, 0.0)}
    table, places = season.simulate(played, rest, 10, 7)
    got = {r["team"]: r for r in table.collect()}
    assert {t: (r["mean_points"], r["mean_goals_scored"]) for t, r in got.items()} == {"A": (2.0, 0.0), "B": (1.0, 0.0), "C": (2.0, 0.0), "D": (2.0, 0.0), "E": (1.0, 0.0)}
    assert sorted(map(tuple, places.collect())) == [("A", 1, 10), ("B", 4, 10), ("C", 2, 10), ("D", 3, 10), ("E", 5, 10)]


def test_poisson_draws_have_their_mean(spark):
    r = spark.range(20000).select(season.poisson(F.lit(1.3), season.uniform(F.lit(1), F.col("id"))).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(r[0] - 1.3) < 0.03 and abs(r[1] - 1.3) < 0.06


def test_a_label_is_matched_once(spark):
    rows = [("Jornada 3 - A\u0001B $1 (CASA) 2-1",), ("no label",), ("",), (None,)]
    parsed = spark.createDataFrame(rows, "l string").select("l", text.parse_label(F.col("l")).alias("p")).select("l", "p.*")
    assert [tuple(r)[1:] for r in parsed.collect()] == [("A\u0001B $1", "home", 2, 1, "2-1", "W", "3")] + [(None,) * 7] * 3
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("jornada") == 1


def test_labels(spark):
    rows = [("Jogo Taça -Canedo(CASA) 1-0",), ("Jornada 4 - Sub23 Rui (Fora) 5-1",), ("Jogo Treino X (CASA) ?-?",), ("Treino",), ("Jornada 1 Ap.Campeão - C (CASA) 1-1",), (None,)]
    got = [r["p"] for r in spark.createDataFrame(rows, "l string").select(text.parse_label(F.col("l")).alias("p")).collect()]
    assert (got[0]["opponent"], got[0]["venue"], got[0]["team_result"]) == ("Canedo", "home", "W")
    assert (got[1]["goals_for"], got[1]["goals_against"], got[1]["matchweek"]) == (1, 5, "4")
    assert got[2]["scoreline"] == "?-?" and got[2]["goals_for"] is None
    assert all(v is None for v in got[3]) and all(v is None for v in got[5])
    assert got[4]["matchweek"] == "1 Ap.Campeão" and got[4]["team_result"] == "D"


def test_minutes(spark):
    got = [r[0] for r in spark.createDataFrame([("23, 45+2' x (g.p.) 90",), (None,), ("45+2+1",)], "c string").select(text.parse_minutes(F.col("c"))).collect()]
    assert got == [[23, 47, 90], [], []]


def test_players(spark):
    cols = "match_url string, team string, name string, status string, Goals string, Assists string, `Yellow Card` string, `Red Card` string, `Substitution OUT` string, `Substitution IN` string"
    rows = [("m1", "t", "x", "Starter", "10, 20 (g.p.)", None, "", None, "60", None), ("m2", "t", "x", "Suplente", None, "5'", None, None, None, "70")]
    df = spark.createDataFrame(rows, cols)
    r = players.season_stats(df).first()
    assert (r["matches"], r["starts"], r["substitute"], r["goals"], r["assists"], r["minutes"]) == (2, 1, 1, 2, 1, 80)
    assert {e["goal_type"] for e in players.events(df).filter("event_type = 'goal'").collect()} == {"penalty"}


def test_asof(spark):
    left = spark.createDataFrame([(1, 1, date(2025, 1, 10)), (1, 2, date(2025, 1, 20)), (2, 3, date(2025, 1, 10))], "p int, k int, d date")
    right = spark.createDataFrame([(1, date(2025, 1, 9), 5.0), (1, date(2025, 1, 11), 6.0)], "p int, r date, v double")
    near = {x["k"]: x for x in asof.nearest(left, right, ["p"], "k", "d", "r", ["v"]).collect()}
    assert (near[1]["v"], near[1]["match_quality"]) == (5.0, "+1d") and near[2]["match_quality"] == "unmatched" and near[3]["v"] is None
    back = {x["k"]: x for x in asof.backward(left, right, ["p"], "k", "d", "r", ["v"], stale_after=8).collect()}
    assert back[1]["v"] == 5.0 and back[2]["v"] is None and back[3]["v"] is None
    assert {x["k"]: x["v"] for x in asof.backward(left, right, ["p"], "k", "d", "r", ["v"], None).collect()}[2] == 6.0


def test_diff(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert {(r["k"], r["change"]) for r in asof.diff(a, b, ["k"]).collect()} == {(1, "removed"), (3, "added"), (4, "added")}


def test_body(spark):
    long = spark.createDataFrame([("a", date(2025, 1, 1), "Peso", 70.0), ("a", date(2025, 1, 31), "Peso", 69.5), ("a", date(2025, 3, 2), "Peso", 60.0)], "p string, date date, metric string, value double")
    dim = spark.createDataFrame([("Peso", -1, 0.8)], "metric string, direction int, threshold double")
    c = body.changes(long, ["p"], dim.select("metric", "threshold")).orderBy("date").collect()
    assert [x["meaningful_change"] for x in c] == ["", "ruído", "sim"] and c[1]["rate_per_30d"] == -0.5
    assert body.evolution(long, ["p"], dim).first()["verdict"] == "better"
    ranges = spark.createDataFrame([("Peso", 65.0, 200.0)], "metric string, low double, high double")
    assert [x["flag"] for x in body.quality_flags(long, ["p"], ranges).collect()] == ["out of range"]


def test_correlation_and_fdr(spark):
    pairs = [(i, float(i), float(i * i)) for i in range(8)]
    x = spark.createDataFrame([("a", i, "m", v) for i, v, _ in pairs], "p string, k int, metric string, value double")
    y = spark.createDataFrame([("a", i, "n", w) for i, _, w in pairs], "p string, k int, metric string, value double")
    r = correlation.with_p(correlation.spearman_grid(x, y, ["p"], ["k"])).first()
    assert (r["rho"], r["n"], r["p"]) == (1.0, 8, 0.0)
    ps = spark.createDataFrame([("g", 1, 0.01), ("g", 2, 0.03), ("g", 3, 0.04)], "g string, k int, p double")
    assert [q["q"] for q in correlation.benjamini_hochberg(ps, ["g"], ["k"]).orderBy("k").collect()] == [0.03, 0.04, 0.04]


def test_formulas(spark):
    r = spark.range(1).select(anthropometry.faulkner(*(F.lit(10.0),) * 4), anthropometry.ectomorphy(F.lit(180.0), F.lit(70.0)), anthropometry.petroski(F.lit("F"), F.lit(20), *(F.lit(10.0),) * 4)).first()
    assert abs(r[0] - 11.903) < 1e-9 and abs(r[1] - (0.732 * 180 / 70 ** (1 / 3) - 28.58)) < 1e-9 and r[2] is None


def test_round_trip_of_sessions(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_session(spark, {"date": date(2025, 1, 1), "session_kind": "training", "duration_min": 80}, path)
    back = sinks.session_log(spark, path).read("sessions")
    assert back.count() == 1 and back.first()["duration_min"] == 80.0
    sinks.save_sessions(back, str(tmp_path / "csv"), "csv")
    assert readers.sessions(spark, str(tmp_path / "csv")).first()["session_kind"] == "training"
    assert readers.sessions(spark, str(tmp_path / "none")).count() == 0


def test_html_table(spark):
    page = '<div id="g"></div><div id="g"><table><tr><td>a</td><td>b &amp; c</td></tr><tr></tr></table></div>'
    got = pages_of.html_table(spark.createDataFrame([(1, page), (2, None)], "k int, h string"), "k", "h", "g", 1).collect()
    assert [(r["k"], r["cells"]) for r in got] == [(1, ["a", "b & c"])]


def test_weekly_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.sql("""SELECT 1 AS player_id, id AS session_id, timestamp'2024-01-07 10:00:00' + make_interval(0, 0, 0, cast(id AS int)) AS ts, 100.0D AS total_distance_m FROM range(30)""")
    rows.union(rows.limit(3)).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = weekly_load_stream(stream, ["player_id"]).writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.sql("SELECT * FROM weeks ORDER BY week_start").collect()
    assert got and got[0]["week_start"] == date(2024, 1, 7) and got[0]["total"] == 700.0 and len(got) <= 4
