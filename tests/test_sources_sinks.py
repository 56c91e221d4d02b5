"""Files written and read back: fixtures of many teams, match pages, the session log and its changes."""

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loadlark.operators import season
from loadlark.sources import pages as pages_of
from loadlark.sources import readers, sinks
from loadlark.sources.log import Conflict

HEAD = "Result - abv,Date,Hour,Location,Team1,Team2,Result,Competition,Matchweek,Played?\n"


def test_fixtures_of_many_teams_split_and_come_back(spark, tmp_path):
    (tmp_path / "a_fixtures.csv").write_text(HEAD + "V,2024-09-01,15:00,(C),a,b,2-1,Liga,J1,True\nV,2024-09-08,15:00,(F),a,c,,Liga,J2,False\nV,2024-09-09,15:00,(C),a,z,9-0,Cup,R1,True\n")
    (tmp_path / "b_fixtures.csv").write_text(HEAD + "D,2024-09-01,15:00,(F),b,a,2-1,Liga,J1,True\n")
    raw = readers.team_fixtures(spark, [f"{tmp_path}/{t}_fixtures.csv" for t in ("a", "b", "missing")])
    assert dict(raw.dtypes)["Played?"] == "boolean" and {r["team_slug"] for r in raw.collect()} == {"a", "b"}
    played, remaining = season.split_fixtures(raw, "Liga")
    assert [tuple(r) for r in played.collect()] == [(1, "a", "b", 2, 1, "Home")] and [tuple(r) for r in remaining.collect()] == [(2, "c", "a")]
    sinks.save_fixtures(played, remaining, f"{tmp_path}/processed")
    again = readers.processed_fixtures(spark, f"{tmp_path}/processed")
    assert [x.collect() for x in again] == [played.collect(), remaining.collect()]
    assert [x.count() for x in readers.processed_fixtures(spark, f"{tmp_path}/nowhere")] == [0, 0]
    assert readers.team_fixtures(spark, [f"{tmp_path}/nowhere.csv"]).count() == 0


def test_own_view_of_read_fixtures(spark, tmp_path):
    (tmp_path / "a_fixtures.csv").write_text(HEAD + "V,2024-09-01,15:00,(F),a,b,2-1,Liga,J1,True\nV,2024-09-08,15:00,(F),a,c,,Liga,J2,False\n")
    row = readers.own_view(readers.team_fixtures(spark, [f"{tmp_path}/a_fixtures.csv"])).collect()
    assert [(r["venue"], r["opponent"], r["goals_for"], r["goals_against"], r["team_result"]) for r in row] == [("away", "b", 1, 2, "L")]


def test_fixture_pages(spark):
    cells = lambda *x: "<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>"
    page = "<div id='team_games'><table></table></div><div id='team_games'><table>" + cells("V", "(C)", "Bee &amp; Co", "2-1", "Liga", "J1", "") + cells("", "(F)", "c", "", "Liga", "J2", "h2h") + cells("V", "(C)", "d", "1-0", "Cup", "R1", "") + "</table></div>"
    pages = spark.createDataFrame([("a", page), ("x", "<div id='team_games'></div>"), ("y", None)], "team_slug string, html string")
    names = spark.createDataFrame([("Bee & Co", "b")], "site_name string, team string")
    got = pages_of.fixture_pages(pages, names, ["abv", "Location", "Team2", "Result", "Competition", "Matchweek", "Played?"], "Liga")
    assert sorted((r["Team1"], r["Team2"], r["Played?"]) for r in got.collect()) == [("a", "b", True), ("a", "c", False)]
    played, remaining = season.split_fixtures(got)
    assert [tuple(r)[:5] for r in played.collect()] == [(1, "a", "b", 2, 1)] and [tuple(r) for r in remaining.collect()] == [(2, "c", "a")]


def test_match_reports(spark):
    player = lambda n, name, events="": f"<div class='player'><div class='number'>{n}</div><div class='name'>{name}</div>{events}</div>"
    event = lambda title, minute, icon="x", cls="": f"<span class='{cls}' title='{title}'>{icon}</span><div>{minute}</div>"
    goals = "<div class='events'>" + event("Golos", "12'") + event("Golos", "45+2'") + event("", "80'", "8", "grey") + "</div>"
    start = "<div class='section_620 game_report'><div class='column_300'><div class='subtitle'>Reds</div>" + player(9, "Ann", goals) + "</div><div class='column_300'><div class='subtitle'>Blues</div>" + player(1, "Bea &amp; C") + "</div></div>"
    bench = "<div class='section_620 game_report'><div class='column_300'>" + player(12, "Cat", "<div class='events'>" + event("Entrou", "80'") + event("Cartões Amarelos", "85'") + "</div>") + "</div><div class='column_300'></div></div>"
    pages = spark.createDataFrame([("u", "<html>" + start + bench), ("one", start), ("none", None)], "match_url string, page string")
    got = {r["name"]: r.asDict() for r in pages_of.match_reports(pages, "match_url", "page").collect()}
    assert {k: (v["match_url"], v["team"], v["status"], v["number"]) for k, v in got.items()} == {
        "Ann": ("u", "Reds", "Starter", "9"), "Bea & C": ("u", "Blues", "Starter", "1"), "Cat": ("u", "Reds", "Suplente", "12"),
    }
    assert (got["Ann"]["Goals"], got["Ann"]["Substitution OUT"], got["Cat"]["Substitution IN"], got["Cat"]["Yellow Card"], got["Bea & C"]["Goals"]) == ("12', 45+2'", "80'", "80'", "85'", "")


def test_sync_of_the_stored_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    row = lambda day, kind: {"date": date(2024, 9, day), "session_kind": kind}
    for r in (row(1, "game"), row(2, "training")):
        sinks.append_session(spark, r, path)
    for r in (row(2, "training"), row(3, "game")):
        sinks.append_session(spark, r, f"{tmp_path}/new")
    read = lambda p: sinks.session_log(spark, p).read("sessions")
    before = read(path)
    changes = sinks.sync(read(f"{tmp_path}/new"), path)
    assert sorted((r["date"].day, r["change"]) for r in changes.collect()) == [(1, "removed"), (3, "added")]
    assert sorted(r["date"].day for r in read(path).collect()) == [2, 3]
    assert sorted(r["date"].day for r in before.collect()) == [1, 2]  # one who reads an older version isn't disturbed
    assert sinks.sync(read(f"{tmp_path}/new"), path, write=False).count() == 0


def test_a_log_is_never_half_written(spark, tmp_path, monkeypatch):
    log = sinks.session_log(spark, f"{tmp_path}/log")
    rows = lambda *days: spark.createDataFrame([(date(2024, 9, d), "game") for d in days], "date date, session_kind string")
    full = lambda df: df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in readers.SESSION_SCHEMA.fields))
    days = lambda v=None: sorted(r["date"].day for r in log.read("sessions", v).collect())
    assert log.version().number == 0 and days() == []
    first = log.append({"sessions": full(rows(1, 2))}, "a")
    with monkeypatch.context() as m:  # the rows are written, the job dies before the manifest
        m.setattr(log, "_commit", lambda new: (_ for _ in ()).throw(OSError("lost")))
        for write in (lambda: log.append({"sessions": full(rows(3))}, "b"), lambda: log.replace({"sessions": full(rows(9))})):
            with pytest.raises(OSError):
                write()
    assert days() == [1, 2]
    log.append({"sessions": full(rows(3))}, "b")
    log.append({"sessions": full(rows(3))}, "b")  # run again: counted once
    log.append({"sessions": full(rows())})
    assert days() == [1, 2, 3] and days(first) == [1, 2]
    old = log.version()
    other = sinks.session_log(spark, f"{tmp_path}/log")
    other.append({"sessions": full(rows(4))})
    with pytest.raises(Conflict):
        log.replace({"sessions": full(rows(5))}, old)
    assert days() == [1, 2, 3, 4]
    real, taken = log._commit, []

    def late(new):  # another writer takes the number first
        if not taken:
            taken.append(other.append({"sessions": full(rows(6))}))
        return real(new)

    monkeypatch.setattr(log, "_commit", late)
    log.append({"sessions": full(rows(7))})
    assert days() == [1, 2, 3, 4, 6, 7]
    gone = log.clean(1)
    assert sum(g.startswith("data/") for g in gone) == 3 and days() == [1, 2, 3, 4, 6, 7] and log.clean(1) == []
    with pytest.raises(KeyError):
        log.version(1)


def test_wide_csv_has_units_in_its_header(spark, tmp_path):
    d = lambda m, y: date(2024 + y, m, 1)
    long = spark.createDataFrame(
        [("a", d(9, 0), "Peso", "kg", 70.5), ("a", d(1, 1), "Peso", "kg", 71.0), ("a", d(1, 1), "Altura", "cm", 180.0), ("a", d(9, 0), "IMC", "", 22.0), ("b", d(9, 0), "Peso", "kg", None)],
        "player string, date date, metric string, unit string, value double",
    )
    sinks.save_wide(long, ["player", "date"], f"{tmp_path}/wide")
    lines = [x for f in sorted((tmp_path / "wide").glob("*.csv")) for x in f.read_text().splitlines()]
    assert lines[0] == "player,date,season,phase,IMC,Peso (kg),Altura (cm)"
    assert [x for x in lines if x != lines[0]] == ["a,2024-09-01,2024/25,1ª volta,22.0,70.5,", "a,2025-01-01,2024/25,2ª volta,,71.0,180.0", "b,2024-09-01,2024/25,1ª volta,,,"]
    back = readers.assessment_table(spark, f"{tmp_path}/wide")
    assert dict(back.dtypes)["Peso (kg)"] == "double" and back.count() == 3


def test_stale(spark, tmp_path):
    a, out = tmp_path / "a", tmp_path / "out"
    a.write_text("x")
    assert readers.stale(spark, [str(a)], str(out))
    out.write_text("x")
    os.utime(a, (1000, 1000)), os.utime(out, (2000, 2000))
    assert not readers.stale(spark, [str(a), f"{tmp_path}/none"], str(out))
    os.utime(a, (3000, 3000))
    assert readers.stale(spark, [str(a)], str(out))


def test_log_as_csv(spark, tmp_path):
    rows = spark.createDataFrame([(date(2024, 9, 1), "game", 90.0), (date(2024, 9, 2), "training", None)], "date date, session_kind string, duration_min double")
    full = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in readers.SESSION_SCHEMA.fields))
    sinks.save_sessions(full, f"{tmp_path}/csv", "csv")
    assert sorted(map(tuple, readers.sessions(spark, f"{tmp_path}/csv").collect())) == sorted(map(tuple, full.collect()))


def test_assessment_table(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("date,season,Peso (kg),Massa Gorda (%)\n2024-07-10,2023/24,70.5,\n2024-06-30,2023/24,71,12.5\n")
    got = {r["date"]: r.asDict() for r in readers.assessment_table(spark, f"{tmp_path}/wide.csv").collect()}
    assert [(r["season_reported"], r["season"], r["Peso (kg)"], r["Massa Gorda (%)"]) for _, r in sorted(got.items())] == [
        ("2023/24", "2023/24", 71.0, 12.5), ("2023/24", "2024/25", 70.5, None),
    ]
    (tmp_path / "summary.csv").write_text("season,metric,unit,n_sessions,first_date\n2023/24,Peso,kg,4,2023-09-01\n")
    row = readers.assessment_table(spark, f"{tmp_path}/summary.csv").first()
    assert (row["season_reported"], row["n_sessions"], row["first_date"]) == ("2023/24", 4.0, date(2023, 9, 1)) and "season" not in row
    none = readers.assessment_table(spark, f"{tmp_path}/nowhere.csv")
    assert none.count() == 0 and none.columns == ["date", "season_reported", "season"]


def test_report_files_and_facts(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    for name in ("a.pdf", "deep/b.PDF", "c.txt"):
        (tmp_path / "in" / name).write_text("x")
    got = readers.report_files(spark, [f"{tmp_path}/in", f"{tmp_path}/in/a.pdf", f"{tmp_path}/nowhere"])
    assert sorted(os.path.basename(r["path"]) for r in got.collect()) == ["a.pdf", "b.PDF"]
    assert readers.report_files(spark, [f"{tmp_path}/nowhere", f"{tmp_path}/no*"]).count() == 0
    pages = [("r", 2, "Pregas, Avaliação Antropométrica 2"), ("r", 1, "pregas antropometria 1"), ("r", 3, "30 Anos Feminino"), ("r", 4, "31 Anos Masculino"), ("s", 1, None)]
    facts = readers.report_facts(spark.createDataFrame(pages, "report string, page int, text string"), "report", "page", "text")
    assert sorted(tuple(r) for r in facts.collect()) == [("r", "pregas antropometria 1", 30, "F"), ("s", None, None, None)]


def test_seasons(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"key": "reds_2025_26", "label": "Reds", "primary_team": "reds", "teams": {"reds": "u"}}, {"key": "blues_2024_25", "label": "Blues"}]')
    registry = readers.seasons(spark, f"{tmp_path}/s.json")
    assert readers.one_season(registry, "reds_2025_26")["teams"] == {"reds": "u"}
    try:
        readers.one_season(registry, "x")
        raise AssertionError
    except KeyError as e:
        assert "blues_2024_25, reds_2025_26" in str(e)
    rows = spark.createDataFrame([("2025/26",), ("2023/24",), (None,)], "season string")
    assert {r["season"]: r["season_key"] for r in readers.with_season_key(rows, registry).collect()} == {"2025/26": "reds_2025_26", "2023/24": None, None: None}


def test_squads_and_player_stats(spark):
    person = lambda n, name, href: f"<div class='staff'><div class='number'>{n}</div><div class='photo' style=\"background:url('/p{n}.png')\"></div><div class='name'><div class='micrologo_and_text'><div class='text'>{href and f'<a href={chr(34)}{href}{chr(34)}>'}{name}</a></div></div></div></div>"
    page = person(9, "Ann &amp; A", "/jogador/ann/1") + person(10, "Nobody", "") + person(11, "Cat", "https://x/c")
    pages = spark.createDataFrame([("t", page), ("none", None)], "team string, html string")
    assert sorted(tuple(r) for r in pages_of.squads(pages, "team", "html", "https://site").collect()) == [
        ("t", "11", "Cat", "https://x/c", "/p11.png"), ("t", "9", "Ann & A", "https://site/jogador/ann/1", "/p9.png"),
    ]
    row = lambda tag, *x: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in x) + "</tr>"
    stats = "<div id='team_games'><table class='zztable'>" + row("th", "", "J", "") + row("td", "Liga", "3", "a") + row("td", "", "4") + "</table></div>"
    got = pages_of.player_stats(spark.createDataFrame([("p", stats), ("q", "")], "player string, html string"), "player", "html")
    assert sorted(tuple(r) for r in got.collect() if r["row"] == 1) == [("p", 1, "Competition", "Liga"), ("p", 1, "J", "3"), ("p", 1, "col_2", "a")]
    assert sorted((r["name"], r["value"]) for r in got.collect() if r["row"] == 2) == [("Competition", "Total"), ("J", "4"), ("col_2", None)]


def test_daily_stream_with_late_and_corrected_rows_and_a_restart(spark, tmp_path):
    """Rows that come late, twice and corrected, over three runs from one checkpoint, against the batch operators."""
    from loadlark.operators import load
    from loadlark.streaming.daily import daily_acwr_stream, run_available

    schema = "player_id int, session_id long, version long, ts timestamp, load_m double"
    row = lambda p, i, v, day, m: (p, i, v, datetime(2024, 1, 1, 10) + timedelta(days=day), m)
    lots = [
        [row(1, i, 1, 2 * i, 100.0 + i) for i in range(15)] + [row(2, 100, 1, 3, 7.0), (None, 1, 1, datetime(2024, 1, 2), 1.0), row(1, 3, 0, 6, 5.0)],
        [row(1, i, 1, 2 * i, 100.0 + i) for i in range(15, 40)] + [row(1, 14, 2, 27, 50.0), row(1, 13, 0, 26, 9.0), row(2, 101, 1, 40, 8.0), row(2, 101, 1, 40, 8.0)],
        [row(1, 40, 1, 120, 1.0), row(1, 999, 1, 2, 1000.0), row(2, 102, 1, 80, None), row(2, 100, 5, 3, 70.0)],  # 999, and 100 again: long after their days were final
    ]
    sizes = []
    for lot in lots:
        spark.createDataFrame(lot, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = daily_acwr_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["player_id"], "load_m")
        sizes.append(run_available(stream, f"{tmp_path}/out", f"{tmp_path}/c").lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {(r["player_id"], r["date"]): (r["load"], r["acute"], r["chronic"], r["acwr"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    final = [row(1, i, 1, 2 * i, 100.0 + i) for i in range(40) if i != 14] + [row(1, 14, 2, 27, 50.0), row(2, 100, 1, 3, 7.0), row(2, 101, 1, 40, 8.0), row(2, 102, 1, 80, 0.0)]
    batch = load.daily_acwr(load.daily_load(spark.createDataFrame(final, schema).withColumn("date", F.to_date("ts")), ["player_id"], "load_m"), ["player_id"])
    assert got == {(r["player_id"], r["date"]): (r["load"], r["acute"], r["chronic"], r["acwr"]) for r in batch.collect()}
    assert len(got) == 79 + 78 and max(sizes) <= 6  # two values an entity and its timer, whatever has passed through


def test_open_sessions_are_merged_as_arrays(monkeypatch):
    """Rows in many frames, merged whenever they are more than a few, against the greatest (version, day, load) of each session."""
    import random

    import numpy as np
    import pandas as pd
    from loadlark.streaming import daily

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, x):
            self.held = x

    class Timers:
        times: list = []
        listTimers = lambda self: list(self.times)
        deleteTimer = lambda self, x: self.times.remove(x)
        registerTimer = lambda self, x: self.times.append(x)

    monkeypatch.setattr(daily, "AT_ONCE", 20)
    rng, made = random.Random(3), daily.DailyLoads()
    made.handle, made.open, made.final = Timers(), Value(), Value()
    made.final.update((4, [1.0]))
    rows = [(rng.randrange(60), rng.randrange(3), rng.randrange(10), float(rng.randrange(9))) for _ in range(900)]
    for part in (rows[:500], rows[500:]):
        frames = [pd.DataFrame(part[i : i + 37], columns=["session_id", "version", "day", "load"]) for i in range(0, len(part), 37)]
        assert list(made.handleInputRows((1,), iter(frames), None)) == []
    want = {}
    for i, *new in rows:
        if new[1] > 4:
            want[i] = max(want.get(i, new), new)
    got = [np.frombuffer(x, t).tolist() for x, t in zip(made.open.held, daily.OPEN, strict=True)]
    assert {i: [*x] for i, *x in zip(*got, strict=True)} == want and len(got[0]) == len(want)
    assert made.handle.times == [(min(x[1] for x in want.values()) + 1) * daily.DAY_MS]
