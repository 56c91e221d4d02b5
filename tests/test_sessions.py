from datetime import date, timedelta

from pyspark.sql import functions as F

from loadlark.operators import comparison, load, microcycles, summaries
from loadlark.operators import sessions as S

COLUMNS = (
    "player_id int, session_id long, date date, session_kind string, session_type string, competition_type string, was_starter boolean, duration_min double,"
    "minutes_game_zerozero double, total_distance_m double, high_speed_distance_m double, sprint_distance_m double, top_speed_kmh double,"
    "sprints_1st_half double, sprints_2nd_half double, sprints_total double, accelerations double, decelerations double, distance_per_min double, calories double"
)


def row(i, day, kind="training", competition=None, dist=6000.0, minutes=80.0, sheet=None, hsd=800.0, sprint=200.0, speed=28.0, player=1):
    return (player, i, day, kind, "x", competition, None, minutes, sheet, dist, hsd, sprint, speed, None, None, 8.0, 40.0, 50.0, None, None)


def frame(spark, rows):
    return S.prepare(spark.createDataFrame(rows, COLUMNS))


def test_categories_and_flags(spark):
    d = date(2025, 10, 5)
    zero = (1, 3, d, "game", "x", "Campeonato", None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None, None, 0.0, 0.0, None, None)
    empty = (1, 4, d, "training", "x", None, None, 80.0, None, None, None, None, None, None, None, None, None, None, None, None)
    got = {
        r["session_id"]: r
        for r in frame(spark, [row(1, d), row(2, d, "game", "Taça", sheet=8.0), zero, empty, row(5, d, "game", None, speed=0.0), row(6, d, hsd=100.0, sprint=200.0)]).collect()
    }
    assert [got[i]["match_category"] for i in (1, 2, 5)] == ["training", "official_match", "practice_match"]
    assert got[2]["short_appearance"] and got[2]["minutes_played"] == 8
    assert got[3]["unused_sub"] and got[3]["duration_min"] is None and not got[3]["has_gps"]
    assert not got[4]["has_gps"] and got[4]["duration_min"] == 80
    assert got[5]["top_speed_kmh"] is None and got[5]["has_gps"]
    assert got[6]["hsr_m"] == 0 and got[1]["hia"] == 98 and got[1]["m_per_min"] == 75.0
    assert got[1]["season"] == "2025/26"


def test_weekly_acwr_by_hand_and_by_entity(spark):
    start = date(2025, 1, 5)  # a Sunday
    totals = [1000.0, 2000.0, 3000.0, 2000.0, 4000.0]
    rows = [row(i, start + timedelta(7 * i + 6), dist=t) for i, t in enumerate(totals)]
    other = [row(100 + i, start + timedelta(7 * i + 3), dist=500.0, player=2) for i in range(3)]
    one = load.weekly_acwr(load.weekly_load(frame(spark, rows), ["player_id"]), ["player_id"]).orderBy("week_start").collect()
    both = load.weekly_acwr(load.weekly_load(frame(spark, rows + other), ["player_id"]), ["player_id"]).filter("player_id = 1").orderBy("week_start").collect()
    assert one == both
    assert one[-1]["acwr"] == 2.0 and one[-1]["acwr_zone"] == "Above range" and one[-2]["acwr"] is None


def test_daily_acwr_and_ewma_by_hand(spark):
    start = date(2025, 1, 1)
    rows = [row(i, start + timedelta(i), dist=1000.0 if i < 28 else 2000.0) for i in range(35)]
    daily = load.daily_load(frame(spark, rows), ["player_id"])
    assert load.daily_acwr(daily, ["player_id"]).orderBy(F.desc("date")).first()["acwr"] == 2.0
    values = [r["e"] for r in load.ewma(daily, ["player_id"], {"e": 7}).orderBy("date").collect()]
    y = 1000.0
    for i, got in enumerate(values):
        y = y if i == 0 else y * (1 - 0.25) + (1000.0 if i < 28 else 2000.0) * 0.25
        assert abs(got - y) < 1e-9


def test_microcycles_and_change(spark):
    m = date(2025, 10, 5)
    rows = [row(1, m, "game", "Campeonato", dist=9000.0), row(2, m + timedelta(2)), row(3, m + timedelta(5), dist=3000.0), row(4, m + timedelta(7), "game", "Campeonato", dist=9900.0),
            row(5, m + timedelta(9), dist=6600.0), row(6, m - timedelta(34)), row(7, m - timedelta(5))]
    labelled = microcycles.label_microcycles(frame(spark, rows), ["player_id"])
    assert {r["session_id"]: r["md_label"] for r in labelled.collect()} == {1: "MD", 2: "MD+2", 3: "MD-2", 4: "MD", 5: "MD+2", 6: "PRE", 7: "MD-5"}
    change = {r["session_id"]: r for r in comparison.weekly_change(labelled, ["player_id"], ["total_distance_m"]).collect()}
    assert change[4]["base_id"] == 1 and change[4]["total_distance_m_pct"] == 10.0 and not change[4]["fallback"]
    assert change[5]["base_id"] == 2 and change[5]["total_distance_m_pct"] == 10.0
    assert change[6]["base_id"] is None and change[3]["fallback"]


def test_reference_takes_the_best_five_and_borrows(spark):
    d = date(2024, 9, 1)
    rows = [row(i, d + timedelta(i), "game", "Campeonato", dist=v) for i, v in enumerate([9000.0, 8000.0, 7000.0, 6000.0, 5000.0, 4000.0])] + [row(50, date(2025, 9, 1))]
    rows.append(row(60, d, dist=20000.0))
    sessions = frame(spark, rows)
    ref = comparison.match_reference(sessions, ["player_id"], ["total_distance_m"])
    got = ref.collect()
    assert len(got) == 1 and got[0]["gref"] == 7000.0 and (got[0]["used"], got[0]["eligible"]) == (5, 6)
    borrowed = {r["season"]: r for r in comparison.borrowed_reference(sessions, ref, ["player_id"]).collect()}
    assert borrowed["2025/26"]["borrowed"] and borrowed["2025/26"]["gref"] == 7000.0 and not borrowed["2024/25"]["borrowed"]


def test_empty_input_keeps_the_schema(spark):
    empty = frame(spark, [])
    for f in (lambda x: load.weekly_load(x, ["player_id"]), lambda x: microcycles.label_microcycles(x, ["player_id"]), lambda x: summaries.monthly_quality(x, ["player_id"]),
              lambda x: comparison.match_reference(x, ["player_id"], ["hia"]), lambda x: summaries.season_summary(x, ["player_id"])):
        out = f(empty)
        assert out.count() == 0 and out.columns


def test_parse_label_variants(spark):
    from loadlark.functions.text import parse_label

    cases = {
        "Jornada 3 - ADS B (CASA) 2-1": ("ADS B", "home", 2, 1, "2-1", "W", "3"),
        "jornada 12 AP. CAMPEÃO -Sub23 Rui (Fora) 2 – 1": ("Sub23 Rui", "away", 1, 2, "2-1", "L", "12 AP. CAMPEÃO"),
        "Jogo Treino Sub19 Arouca (CASA) ?-?": ("Sub19 Arouca", "home", None, None, "?-?", None, None),
        "Jogo TAÇA-Os X( fora )03-3 ": ("Os X", "away", 3, 3, "3-3", "D", None),
        "Jogo Y (casa)": ("Y", "home", None, None, None, None, None),
        "Z (fora) adiado 2-?": ("Z", "away", None, None, "2-?", None, None),
        "(casa) 1-0": (None, "home", 1, 0, "1-0", "W", None),
        "Treino 2-1": (None,) * 7, "": (None,) * 7, None: (None,) * 7,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "label string").select("label", parse_label(F.col("label")).alias("p")).select("label", "p.*")
    assert {r[0]: tuple(r)[1:] for r in rows.collect()} == cases


def test_exponential_means_over_many_blocks_equal_the_recurrence(spark):
    import random

    rng = random.Random(1)
    rows = [(p, date(2000, 1, 1) + timedelta(days=i), float(rng.choice([0, 0, rng.randint(0, 12_000)]))) for p, n in ((1, 3000), (2, 1), (3, 128), (4, 129), (5, 700)) for i in range(n)]
    spans = {"a": 7, "b": 28, "c": 200}
    got = {(r["p"], r["date"]): r for r in load.ewma(spark.createDataFrame(rows, "p int, date date, load double").repartition(3), ["p"], spans).collect()}
    assert len(got) == len(rows)
    for p in range(1, 6):
        for name, span in spans.items():
            mean, rate = None, 2 / (span + 1)
            for _, day, x in (r for r in rows if r[0] == p):
                mean = x if mean is None else mean * (1 - rate) + x * rate
                assert abs(got[p, day][name] - mean) <= 1e-9 * max(1, mean), (p, day, name)
