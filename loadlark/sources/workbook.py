"""Session workbooks: a Data Source that opens ``.xlsx`` files in tasks, a partition a sheet.

    spark.dataSource.register(SessionWorkbook)
    spark.read.format("session_workbook").load(path_or_folder)

A workbook is a zip of XML parts. The driver reads the list of sheets, no more. A
task streams one sheet's cells against the shared strings, takes the header's names
and gives the rows of the log: ``Jogos`` are games, with their sprints in two halves,
``Treinos`` are trainings. ``save_workbooks`` writes the same form.

Defined cases: a row whose date can't be read (merged headings, notes) is left out;
what isn't a number is missing; the sprints of a game are missing only if both halves
are; a sheet or a column that isn't there gives no rows or no values; other sheets
aren't read; a file that is no workbook is an error that names it.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from functools import lru_cache
from itertools import islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import listed, place
from .readers import SESSION_SCHEMA

# The sheets and the headings of a session workbook.
SHEETS = {"Jogos": "game", "Treinos": "training"}
HEADINGS = {
    "Date": "date", "Week": "week", "Month": "month", "Session Type": "session_type", "Type game": "competition_type", "Titularidade": "was_starter",
    "Duration (min)": "duration_min", "Minutes (Game) -Zerozero": "minutes_game_zerozero", "Total Distance (m)": "total_distance_m",
    "Sprint Distance (m)": "sprint_distance_m", "High-Speed Distance (m)": "high_speed_distance_m", "Distance Per Minuto(m/min": "distance_per_min",
    "Top Speed (km/h)": "top_speed_kmh", "Accelerations (#)": "accelerations", "Decelerations (#)": "decelerations", "Calories": "calories", "Notes": "notes",
}
SPRINTS, YES = "Nº Sprints", "SIM"
_GAMES_ONLY = {"competition_type", "was_starter", "minutes_game_zerozero"}

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_FIELDS = {f.name: f.dataType for f in SESSION_SCHEMA.fields}


def _sheets(book: zipfile.ZipFile) -> tuple[dict[str, str], bool]:
    """The part of each sheet by name, and whether days count from 1904."""
    root = ET.fromstring(book.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    props = root.find(f"{_MAIN}workbookPr")
    parts = {s.get("name"): posixpath.normpath(posixpath.join("/xl", links[s.get(_LINK)])).lstrip("/") for s in root.iter(f"{_MAIN}sheet")}
    return parts, props is not None and props.get("date1904") in ("1", "true")


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def cells(book: zipfile.ZipFile, part: str) -> Iterator[dict[int, str | float | bool]]:
    """Each row of a sheet as its cells by column; the rows of 64 KB are in memory at once."""
    strings, parser = _strings(book), ET.XMLPullParser(("end",))
    row, cell, value, run = (f"{_MAIN}{n}" for n in ("row", "c", "v", "t"))
    with book.open(part) as raw:
        while chunk := raw.read(1 << 16):
            parser.feed(chunk)
            for e in [e for _, e in parser.read_events() if e.tag == row]:
                out, at = {}, -1
                for c in e.iter(cell):
                    given = c.attrib
                    at = _column(given["r"]) if "r" in given else at + 1
                    kind = given.get("t", "n")
                    if kind == "inlineStr":
                        out[at] = "".join([t.text or "" for t in c.iter(run)])
                    elif (text := c.findtext(value)) and kind != "e":
                        out[at] = float(text) if kind == "n" else strings[int(text)] if kind == "s" else text == "1" if kind == "b" else text if kind in ("str", "d") else float(text)
                e.clear()
                yield out
    parser.close()


@lru_cache(1 << 16, typed=True)
def _day(value, since_1904: bool) -> date | None:
    """A date: a count of days, or text that starts with one."""
    if isinstance(value, float) and 0 < value < 2_958_466:
        return (datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)).date() + timedelta(days=int(value))
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y"):
        try:
            return datetime.strptime(str(value).strip()[:10], form).date()
        except ValueError:
            pass
    return None


def _number(value) -> float | None:
    try:
        return float(value.strip().replace(",", ".") if isinstance(value, str) else value)
    except (TypeError, ValueError):
        return None


def columns(book: zipfile.ZipFile, part: str, kind: str, since_1904: bool) -> Iterator[dict[str, list]]:
    """The log's rows of one sheet, up to 4,096 at a time, as lists by field."""
    source = cells(book, part)
    head = {str(v).strip(): i for i, v in next(source, {}).items()}
    named = {field: head[h] for h, field in HEADINGS.items() if h in head and (kind == "game" or field not in _GAMES_ONLY)}
    sprints, day_at = head.get(SPRINTS), named.get("date", -1)
    while some := list(islice(source, 4096)):
        days = [_day(c.get(day_at), since_1904) for c in some]
        kept = [c for c, d in zip(some, days, strict=True) if d is not None]

        def numbers(i: int, kept: list[dict] = kept) -> list[float | None]:
            return [v if v.__class__ is float or v is None else _number(v) for v in [c.get(i) for c in kept]]

        out = {}
        for f, t in _FIELDS.items():
            i = named.get(f, -1) if f != "date" else -1
            out[f] = numbers(i) if isinstance(t, T.DoubleType) else [None if v is None else str(v) for v in [c.get(i) for c in kept]]
        out |= {"date": [d for d in days if d is not None], "session_kind": [kind] * len(kept)}
        out["was_starter"] = [None if v is None else v.strip().upper() == YES for v in out["was_starter"]]
        if sprints is not None and kind == "game":
            one, two = numbers(sprints), numbers(sprints + 1)  # the second half has no heading
            total = [None if a is None and b is None else (a or 0.0) + (b or 0.0) for a, b in zip(one, two, strict=True)]
            out |= {"sprints_1st_half": one, "sprints_2nd_half": two, "sprints_total": total}
        elif sprints is not None:
            out["sprints_total"] = numbers(sprints)
        yield out


class Sheet(InputPartition):
    def __init__(self, uri: str, part: str, kind: str, since_1904: bool):
        super().__init__(uri)
        self.uri, self.part, self.kind, self.since_1904 = uri, part, kind, since_1904


def _opened(uri: str):
    fs, path = place(uri)
    source = fs.open_input_file(path)
    try:
        return zipfile.ZipFile(source)
    except (zipfile.BadZipFile, OSError, ValueError) as e:  # one that is too short fails as it is searched
        raise ValueError(f"{uri} is not a workbook") from e


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Sheet]:
        out = []
        for uri in listed(self.path, ".xlsx"):
            with _opened(uri) as book:
                parts, since = _sheets(book)
                out += [Sheet(uri, parts[name], kind, since) for name, kind in SHEETS.items() if name in parts]
        return out or [Sheet("", "", "", False)]  # a partition without rows: Spark wants one

    def read(self, sheet: Sheet) -> Iterator[pa.RecordBatch]:
        if not sheet.uri:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(SessionWorkbook.SCHEMA)
        with _opened(sheet.uri) as book:
            for found in columns(book, sheet.part, sheet.kind, sheet.since_1904):
                found["source_file"] = [sheet.uri] * len(found["date"])
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)


class SessionWorkbook(DataSource):
    SCHEMA = T.StructType([*SESSION_SCHEMA.fields, T.StructField("source_file", T.StringType())])

    @classmethod
    def name(cls) -> str:
        return "session_workbook"

    def schema(self) -> T.StructType:
        return self.SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"])


def read_workbooks(spark, path: str) -> DataFrame:
    """The rows of a workbook, or of all below a folder, in the log's columns and ``source_file``."""
    spark.dataSource.register(SessionWorkbook)
    return spark.read.format(SessionWorkbook.name()).load(path)


# --- writing ------------------------------------------------------------------

#: Tasks that write; of more workbooks a task writes several, one after the other.
MOST_TASKS = 4096
_BOOK = f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_LINK[1:-3]}"><sheets>%s</sheets></workbook>'
_SHEET = '<sheet name="%s" sheetId="%d" r:id="rId%d"/>'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>'
_REL = '<Relationship Id="rId%d" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/%s" Target="%s"/>'
_TYPES = (
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
    'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>%s</Types>'
)
_TYPE = '<Override PartName="/xl/worksheets/sheet%d.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        value = YES if value else "NÃO"
    if isinstance(value, date):
        value = (value - date(1899, 12, 30)).days
    return f"<c><v>{value!r}</v></c>" if isinstance(value, int | float) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def _column_cells(values: pa.ChunkedArray) -> list[str]:
    found = values.to_pylist()
    if pa.types.is_floating(values.type):
        return ["<c/>" if v is None else f"<c><v>{v!r}</v></c>" for v in found]
    each = {v: _cell(v) for v in set(found)}
    return [each[v] for v in found]


def write_book(out, log: pa.Table) -> None:
    """One workbook of the log's rows, both sheets."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        n = range(1, len(SHEETS) + 1)
        book.writestr("[Content_Types].xml", _TYPES % "".join(_TYPE % i for i in n))
        book.writestr("_rels/.rels", _RELS % (_REL % (1, "officeDocument", "xl/workbook.xml")))
        book.writestr("xl/workbook.xml", _BOOK % "".join(_SHEET % (name, i, i) for i, name in zip(n, SHEETS, strict=True)))
        book.writestr("xl/_rels/workbook.xml.rels", _RELS % "".join(_REL % (i, "worksheet", f"worksheets/sheet{i}.xml") for i in n))
        for i, (name, kind) in zip(n, SHEETS.items(), strict=True):
            fields = {h: f for h, f in HEADINGS.items() if kind == "game" or f not in _GAMES_ONLY}
            sprints = ["sprints_1st_half", "sprints_2nd_half"] if kind == "game" else ["sprints_total"]
            head = [*fields, SPRINTS] + [None] * (len(sprints) - 1)
            rows = log.filter(pc.equal(log["session_kind"], kind))
            cells_ = [_column_cells(rows[f]) if f in rows.column_names else ["<c/>"] * len(rows) for f in [*fields.values(), *sprints]]
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as part:
                part.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData><row>{"".join(map(_cell, head))}</row>'.encode())
                lines = zip(*cells_, strict=True)
                while some := list(islice(lines, 1024)):
                    part.write("".join([f"<row>{''.join(x)}</row>" for x in some]).encode())
                part.write(b"</sheetData></worksheet>")


def save_workbooks(log: DataFrame, by: list[str], folder: str) -> DataFrame:
    """A workbook for each value of ``by`` (a player's season, say: what fits into one sheet), below a folder of this call's own; lists them.

    A task writes under its attempt's name, and only what a task that was kept has
    returned is listed and read. The number of tasks follows that of the workbooks:
    by the bytes of their rows, adaptive execution would put all of them into a few.
    Returns ``by, path``; runs once, at once.
    """
    spark, own = log.sparkSession, f"{folder.rstrip('/')}/workbooks-{uuid.uuid4().hex}"
    names = [f.name for f in SESSION_SCHEMA.fields if f.name in log.columns]

    def write(key: tuple, table: pa.Table) -> pa.Table:
        fs, top = place(own)
        fs.create_dir(top, recursive=True)
        name = "-".join(re.sub(r"\W+", "_", str(k.as_py())) for k in key)
        file = f"{name}-{TaskContext.get().taskAttemptId()}.xlsx"
        with fs.open_output_stream(f"{top}/{file}", compression=None) as out:
            write_book(out, table.select(names).sort_by([("date", "ascending"), ("session_kind", "ascending")]))
        return pa.table({**{b: pa.array([k.as_py()], table.schema.field(b).type) for b, k in zip(by, key, strict=True)}, "path": [f"{own}/{file}"]})

    schema = T.StructType([*(log.schema[b] for b in by), T.StructField("path", T.StringType())])
    dated = log.filter(F.col("date").isNotNull())
    books = dated.select(*by).distinct().count()
    made = dated.repartition(min(max(books, 1), MOST_TASKS), *by).groupBy(*by).applyInArrow(write, schema)
    made.write.parquet(f"{own}/_written")
    return spark.read.schema(schema).parquet(f"{own}/_written")
