"""Reports, PDF files, workbooks and pages, each against what was written into them."""

import random
import re
import zipfile
import zlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from loadlark.sources import pages, pdf, readers, workbook
from loadlark.sources.markup import parse
from loadlark.sources.report_tables import DATE, SECTIONS, STOPS, VALUE, report_rows, report_tables

# report tables


def plain(text):
    """The carried-state walk over a page's lines in plain Python."""
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    named = lambda x: (m[1].strip(), m[2].strip()) if (m := re.match(r"^(.*?)\s*\(([^()]*)\)\s*$", x)) else (x.strip(), "")
    head = next((i for i, x in enumerate(lines) if sum(bool(re.match(DATE, w)) for w in x.split()) >= 2), None)
    if head is None:
        return []
    days, rows = [w for w in lines[head].split() if re.match(DATE, w)], []
    for line in lines[head + 1 :]:
        if any(" ".join(line.split()).startswith(s) for s in STOPS):
            break
        words = line.split()
        if " ".join(words).upper() in SECTIONS:
            continue
        first = next((i for i, w in enumerate(words) if re.match(VALUE, w)), None)
        if first is None and rows:
            m, u = rows[-1][:2]
            rows[-1][:2] = named(f"{m} ({u}) {' '.join(words)}" if u else f"{m} {' '.join(words)}".strip())
        elif first:
            rest = words[first:]
            rows.append([*named(" ".join(words[:first])), rest[: len(days)], " ".join(rest[len(days) :])])
    return [(i, m, u, days, v, r) for i, (m, u, v, r) in enumerate(rows)]


def test_lines_with_a_reference_column(spark):
    text = "Relatório\nDatas 12-01-2025 03-04-2025 Referência\nPeso (kg) 70,0 71,0 60-80\nAltura (cm) 180 181 175\nPercentagem Massa Gorda 12,5 - 10 a 20\n(Sedentários) (%)\nPágina 1\nx 1 2"
    got = report_tables(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    jan, apr = date(2025, 1, 12), date(2025, 4, 3)
    assert {tuple(r)[1:] for r in got.collect()} == {
        (0, jan, "Peso", "kg", 70.0, "60-80"), (0, apr, "Peso", "kg", 71.0, "60-80"), (1, jan, "Altura", "cm", 180.0, "175"), (1, apr, "Altura", "cm", 181.0, "175"),
        (2, jan, "Percentagem Massa Gorda (Sedentários)", "%", 12.5, "10 a 20"),
    }


def test_report_rows_equal_a_plain_walk(spark):
    rng = random.Random(4)
    parts = ["Peso (kg)", "Massa", "(Atletas) (%)", "70,5", "71", "-", "60-80", "12.", "01-02-2025", "03-04-2025", "1-2", "Página", "em", " ", "(a) b", "Prega X (mm)", "10", "1e5"]
    texts = [None, "", "a\nb 1 2", "01-02-2025 03-04-2025"]
    for _ in range(150):
        lines = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 14))]
        lines += [rng.choice([*SECTIONS, "pregas e  perímetros", "Impresso em 1 2", "nota Página 1 2", ""]) for _ in range(2)]
        rng.shuffle(lines)
        texts.append("\n".join(["Datas 01-02-2025 05-06-2025 ref"] * rng.randint(0, 1) + lines))
    rows = list(enumerate(texts))
    got = report_rows(spark.createDataFrame([(i, t, "x") for i, t in rows], "k int, t string, dates string"), "k", "t").collect()
    assert sorted((r["k"], r["line"], r["metric"], r["unit"], r["dates"], r["values"], r["reference"]) for r in got) == sorted((i, *r) for i, t in rows for r in plain(t))
    assert report_tables(spark.createDataFrame([], "k int, t string"), "k", "t").count() == 0


# PDF


def made(objects, trailer=b"<< /Root 1 0 R >>"):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects) + b"trailer\n" + trailer + b"\n%%EOF"


def stream(data, entries=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), entries, data)


def flate(data, entries=b""):
    return stream(zlib.compress(data), b"/Filter /FlateDecode " + entries)


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0050> <0002> <00E9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange 1 beginbfrange <0020> <0021> [<0078> <0079007A>] endbfrange"


def a_file():
    content = (
        b"q 1 0 0 1 10 0 cm BT /F1 10 Tf 14 TL 50 700 Td (Peso \\(kg\\)) Tj 200 0 Td (70,5) Tj 60 0 Td (71) Tj -260 -14 Td (Per\\355metro) Tj 200 0 Td [(8) 20 (1) -300 (82)] TJ ET Q\n"
        b"BT /F1 10 Tf 1 0 0 1 60 750 Tm (12-01-2025) ' (line) ' ET BT /F2 9 Tf 60 600 Td <0001000200100011001200200021> Tj ET BI /W 1 ID \x01\x02(( EI"
    )
    return made(
        [
            (1, b"<< /Type /Catalog /Pages 2 0 R >>"), (6, flate(content)), (7, flate(CMAP)),
            (2, b"<< /Type /Pages /Kids [30 0 R 31 0 R] /Count 2 /Resources << /Font << /F1 40 0 R /F2 41 0 R >> >> >>"),
            (30, b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>"), (31, b"<< /Type /Page /Parent 2 0 R >>"),
            (40, b"<< /Type /Font /Subtype /TrueType /Encoding /WinAnsiEncoding >>"), (41, b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>"),
        ]
    )


def test_text_of_a_pdf_file_in_the_order_of_its_lines():
    assert pdf.texts(a_file()) == [(1, "12-01-2025\nline\nPeso (kg) 70,5 71\nPerímetro 81 82\nPéabcxyz", None), (2, "", None)]


def test_objects_inside_of_streams_and_damaged_files(spark, tmp_path):
    inner = b"<< /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] >> << /Type /Page /Contents 6 0 R /Resources << /Font << /F 4 0 R >> >> >> << /Encoding << /Differences [65 /uni00C7 /x] >> >>"
    starts = [inner.index(b"<< /Type /Catalog"), inner.index(b"<< /Type /Pages"), inner.index(b"<< /Type /Page "), inner.index(b"<< /Encoding")]
    head = b" ".join(b"%d %d" % (n, at) for n, at in zip((1, 2, 3, 4), starts, strict=True)) + b" "
    packed = flate(head + inner, b"/Type /ObjStm /N 4 /First %d" % len(head))
    whole = made([(6, flate(b"BT /F 9 Tf 1 1 Td (AB c) Tj ET")), (9, packed), (10, stream(b"", b"/Type /XRef /Root 1 0 R"))], b"null")
    assert pdf.texts(whole) == [(1, "Çx c", None)]
    (tmp_path / "in").mkdir()
    for name, data in {"a.pdf": a_file(), "B.PDF": whole, "cut.pdf": a_file()[:900], "none.pdf": b"\n", "odd.pdf": b"\x00%PDF-1.1 junk", "locked.pdf": made([(1, b"<< >>")], b"<< /Root 1 0 R /Encrypt 2 0 R >>"), "x.txt": b"%PDF-"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = {}
    for r in pdf.report_pages(spark, [str(tmp_path / "in"), str(tmp_path / "nowhere")]).collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append(r)
    assert sorted(got) == ["B.PDF", "a.pdf", "cut.pdf", "locked.pdf", "none.pdf", "odd.pdf"]
    assert [len(got[k]) for k in ("a.pdf", "B.PDF")] == [2, 1] and all(got[k][0]["error"] and got[k][0]["text"] is None for k in ("none.pdf", "odd.pdf", "locked.pdf"))
    assert pdf.page_texts(spark.createDataFrame([("p", None)], "path string, content binary")).first()["error"]
    facts = readers.report_facts(pdf.page_texts(spark.createDataFrame([("p", made([(1, b"<< /Pages 2 0 R >>"), (2, b"<< /Kids [3 0 R] >>"), (3, b"<< /Contents 4 0 R >>"), (4, stream(b"BT 0 20 Td (Masculino 31 Anos) Tj 0 -9 Td (PREGAS ANTROPOM 1) Tj ET"))]))], "path string, content binary")), "path", "page", "text")
    assert tuple(facts.first()) == ("p", "Masculino 31 Anos\nPREGAS ANTROPOM 1", 31, "M")


# workbooks


def book(path, sheets, shared, dates1904=False):
    """A workbook as other programs write it: shared strings, references, blank cells left out."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><workbookPr date1904="{int(dates1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")
        for i, rows in enumerate(sheets.values()):
            lines = []
            for n, row in enumerate(rows, 1):
                cells = []
                for j, v in enumerate(row):
                    at = f"{chr(65 + j)}{n}"
                    if isinstance(v, bool):
                        cells.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
                    elif isinstance(v, str) and v in shared:
                        cells.append(f'<c r="{at}" t="s"><v>{shared.index(v)}</v></c>')
                    elif isinstance(v, str):
                        cells.append(f'<c r="{at}" t="str"><f>A1</f><v>{v}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{at}" s="3"><v>{v}</v></c>')
                lines.append(f'<row r="{n}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")


GAMES = ["Date", "Week", "Session Type", "Type game", "Titularidade", "Duration (min)", "Nº Sprints", None, "Total Distance (m)", "Notes"]
ROWS = [
    GAMES, [None, None, None, None, None, None, "1ª", "2ª", None, None], [45536, 35, "Jogo Taça", "Taça", "SIM", 90.5, 4, 3, "n/d", "ok"],
    ["2024-09-08", 36, "Jogo 2", "Treino", "Não", "80,5", None, 2, 9000.25, None], ["FIM DE EPOCA", 1, None, None, None, None, None, None, None, None],
    [45545.75, None, "Jogo 3", "Taça", None, None, None, None, None, None],
]


def test_workbooks_of_other_programs(spark, tmp_path):
    training = [["Date", "Session Type", "Nº Sprints", "Top Speed (km/h)"], [45537, "Treino 1", 12, 30.5], ["x", "y", 1, 1]]
    shared = [x for x in {v for r in ROWS for v in r if isinstance(v, str)} if "Não" not in x]
    book(tmp_path / "a.xlsx", {"Jogos": ROWS, "Outra": [["Date"], [1]], "Treinos": training}, shared)
    book(tmp_path / "b.xlsx", {"Treinos": [["Date"], [44076]]}, [], True)
    got = workbook.read_workbooks(spark, f"file://{tmp_path}").collect()
    seen = {(r["date"], r["session_kind"]): r for r in got}
    assert len(got) == 5 and set(seen) == {(date(2024, 9, 1), "game"), (date(2024, 9, 8), "game"), (date(2024, 9, 10), "game"), (date(2024, 9, 2), "training"), (date(2024, 9, 3), "training")}
    a, b, c, t = (seen[k] for k in sorted(seen, key=lambda k: (k[1], k[0]))[:4])
    assert (a["week"], a["session_type"], a["was_starter"], a["duration_min"], a["sprints_1st_half"], a["sprints_2nd_half"], a["sprints_total"], a["total_distance_m"], a["notes"]) == (35.0, "Jogo Taça", True, 90.5, 4.0, 3.0, 7.0, None, "ok")
    assert (b["was_starter"], b["duration_min"], b["sprints_1st_half"], b["sprints_total"], b["total_distance_m"]) == (False, 80.5, None, 2.0, 9000.25)
    assert c["was_starter"] is None and c["sprints_total"] is None and (t["sprints_total"], t["top_speed_kmh"], t["competition_type"]) == (12.0, 30.5, None)
    assert workbook.read_workbooks(spark, str(tmp_path / "b.xlsx")).count() == 1
    (tmp_path / "none").mkdir()
    assert workbook.read_workbooks(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "none" / "c.xlsx").write_text("no zip")
    with pytest.raises(Exception, match="(?s)c.xlsx is not"):
        workbook.read_workbooks(spark, str(tmp_path / "none")).count()


def test_written_workbooks_come_back(spark, tmp_path):
    log = spark.createDataFrame(
        [(1, date(2024, 9, 1), "game", "Jogo <A> & \"B\" (CASA) 2-1", True, 90.25, 3.0, None), (1, date(2024, 9, 2), "training", "  Treino", None, 60.0, None, None), (2, date(2024, 9, 1), "training", None, None, None, None, 4.0), (2, None, "game", "x", None, None, None, None)],
        "player_id int, date date, session_kind string, session_type string, was_starter boolean, duration_min double, sprints_1st_half double, sprints_total double",
    )
    made_ = workbook.save_workbooks(log, ["player_id"], str(tmp_path)).collect()
    assert sorted(r["player_id"] for r in made_) == [1, 2]
    back = workbook.read_workbooks(spark, made_[0]["path"].rpartition("/")[0]).select("date", "session_kind", "session_type", "was_starter", "duration_min", "sprints_1st_half", "sprints_total")
    want = log.filter("date is not null").withColumn("sprints_total", F.when(F.col("session_kind") == "game", F.col("sprints_1st_half")).otherwise(F.col("sprints_total")))
    assert sorted(map(str, back.collect())) == sorted(map(str, want.select(*back.columns).collect()))


# pages


def test_tables_and_blocks_inside_of_each_other(spark):
    page = "<div id=g></div><div id=g><div><table><thead><tr><th>a<th>b</thead><tbody><tr><td>1<td>2 <b>x</b> &lt;y<table><tr><td>n<tr><td>m</table></td><tr><td>3</tr></tbody></table></div></div><table><tr><td>out</table>"
    got = pages.html_table(spark.createDataFrame([(1, page), (2, None), (3, "<div id=g>")], "k int, h string"), "k", "h", "g", 1)
    assert [(r["row"], r["cells"]) for r in got.collect()] == [(0, ["a", "b"]), (1, ["1", "2x<ynm"]), (2, ["3"])]


def test_references_without_a_semicolon(spark):
    page = "<html lang=en><title>a&amp;&amp</title><p>x &lt;b &lt c &amp;lt &#65;&#65<p><a href='/?a=1&amp=2'>&quot;q&quot</a>"
    frame = spark.createDataFrame([(1, page)], "k int, h string")
    read = lambda **how: tuple(pages.outline(frame, "k", "h", **how).select("title", "paragraphs", "links").first())
    assert read(ended=True) == ("a&&amp", ["x <b &lt c &lt A&#65", '"q&quot'], ['"q&quot'])
    assert read() == ("a&&", ["x <b < c &lt AA", '"q"'], ['"q"'])


def test_plain_pages_have_the_tree_of_the_full_parser():
    from loadlark.sources import markup

    def seen(e):
        return (e.tag, e.attrs, sorted(e.classes), e.order, e.last, [c if isinstance(c, str) else seen(c) for c in e.children])

    def full(page):
        builder = markup._Builder()
        builder.feed(page)
        builder.close()
        return builder.done()

    bits = ["<div class='a b'>", "</div>", "<p>", "</p>", "<table>", "</table>", "<tr>", "<td\n id=x>", "</TD>", "<br/>", "<b>", "</b>", "<a href=\"/x?a=1\">", "</a>", "t &amp; u", " &lt", "<li>", "<ul>", "<input disabled>"]
    odd = ["<!-- c -->", "<script>a<b</script>", "<title>t&amp</title>", " < ", "<a b='c>d'>", "</>", "<x-y>", "<div id=x/>", "<a href='?a&amp;b'>"]
    pages_ = ["".join(bits[(i * 7 + k * k * (i + 3)) % len(bits)] for k in range(14)) for i in range(200)]
    assert all(markup._plain(p) is not None and seen(markup.parse(p)) == seen(full(p)) for p in pages_)
    mixed = [p[: len(p) // 2] + odd[i % len(odd)] + p[len(p) // 2 :] for i, p in enumerate(pages_)]
    assert all(seen(markup.parse(p)) == seen(full(p)) for p in mixed)


def test_player_stats_need_one_pass_of_the_pages(spark):
    page = "<div id='team_games'><table><tr><th><th>J<th></tr><tr><td>Liga<td>3<td>x<tr><td><td><b>5</b></table></div>"
    got = pages.player_stats(spark.createDataFrame([("u", page), ("none", "<p>"), ("head", "<div id='team_games'><table><tr><td>J</table>")], "u string, h string"), "u", "h")
    assert sorted(map(tuple, got.collect())) == [("u", 1, "Competition", "Liga"), ("u", 1, "J", "3"), ("u", 1, "col_2", "x"), ("u", 2, "Competition", "Total"), ("u", 2, "J", "5"), ("u", 2, "col_2", None)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_what_is_not_closed_or_never_opened():
    root = parse("</p><p>one<b>bold<p>two</b><div>three</span><ul><li>a<li>b<ul><li>c</ul><li>d</ul></div></body>tail<script>x='</p><p>'</script><br/><p/>&amp;&nbsp;<img src=a>")
    assert [p.text() for p in root.all("p")] == ["onebold", "two", "&"] or [p.text() for p in root.all("p")] == ["onebold", "two", ""]
    assert [x.text() for x in root.first("ul").own("ul", "li")] == ["a", "bc", "d"]
    assert root.first("div").text() == "threeabcd" and "tail" in root.text() and "x=" not in root.text()
    assert parse(None).text() == "" and parse("a < b <").text().startswith("a < b")
    deep = parse("<div>" * 5000 + "x")
    assert deep.text() == "x" and sum(1 for _ in deep.all("div")) == 5000


def test_a_player_block_with_nested_blocks(spark):
    player = "<div class='player odd'><div class=number><span>7</span></div><div class=name><div><div>Ann</div> B.</div></div><div class=events><div><span title='2 Golos'>x</span><div><div>12'</div></div><span class='a grey'>8</span><div>80'</div></div></div></div>"
    block = lambda inner: f"<section><div class='x section_620 game_report'>{inner}</div></section>"
    side = lambda inner, name="": f"<div class='column_300'><div><div class=subtitle>{name}</div>{inner}</div></div>"
    page = block(side(player, "Reds") + side("", "Blues")) + block(side("") + side(player.replace("Ann", "Cat")))
    got = pages.match_reports(spark.createDataFrame([("u", page), ("one", block(side(player, "R"))), ("n", None)], "u string, h string"), "u", "h").collect()
    assert [(r["team"], r["status"], r["number"], r["name"], r["Goals"], r["Substitution OUT"]) for r in got] == [("Reds", "Starter", "7", "AnnB.", "12'", "80'"), ("Blues", "Suplente", "7", "CatB.", "12'", "80'")]


def test_workbooks_are_written_by_many_tasks(spark, tmp_path):
    """Small rows, many workbooks: adaptive execution must not put them into a task or two; odd values come back as they were."""
    rows = [(i % 40, date(2024, 1, 1 + i % 28), ("game", "training")[i % 2], (None, "a <b> & 'c'", " x ", "")[i % 4], (-0.0, None, 1e300, 0.1)[i // 2 % 4]) for i in range(400)]
    log = spark.createDataFrame(rows, "player_id int, date date, session_kind string, session_type string, duration_min double")
    made = workbook.save_workbooks(log, ["player_id"], str(tmp_path)).collect()
    attempts = {re.search(r"-(\d+)\.xlsx$", r["path"])[1] for r in made}
    assert len(made) == 40 and len(attempts) > 10
    back = workbook.read_workbooks(spark, made[0]["path"].rpartition("/")[0]).select("date", "session_kind", "session_type", "duration_min")
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr(r[1:]) for r in rows)
