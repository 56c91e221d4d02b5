"""Match and player pages: fixtures, match reports, squads, players' tables.

Each page is parsed to a tree in a task (see :mod:`.markup`), so elements inside of
each other, unclosed tags and tags inside of scripts are read as a browser does.
Pages are independent rows; a page that is null, empty or built otherwise gives none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markup import Element, parse


_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_AT_ONCE = 1024  # pages


def _parsed(pages: DataFrame, key: str, column: str, names: list[str], types: list[str], rows: Callable[[Element], Iterator[tuple]]) -> DataFrame:
    """``key`` and what ``rows`` gives for the tree of each page."""
    kinds = [_ARROW[t] for t in types]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, _AT_ONCE) for i in range(0, whole.num_rows, _AT_ONCE)):
                at, found = [], []
                for i, page in enumerate(b.column(1).to_pylist()):
                    if page:
                        tree = parse(page)
                        for x in rows(tree):
                            at.append(i)
                            found.append(x)
                        tree.page.clear()  # elements and their list hold each other
                held = zip(*found, strict=True) if found else [()] * len(names)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), *(pa.array(v, t) for v, t in zip(held, kinds, strict=True))], [key, *names])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, column).mapInArrow(read, f"`{key}` {kind}, " + ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True)))


def _rows(table: Element) -> Iterator[list[str]]:
    """The texts of each row's own cells; a row without any is left out."""
    for tr in table.own("table", "tr"):
        cells = [c.text() for c in tr.own("table", "td", "th")]
        if cells:
            yield cells


def _table(page: Element, div_id: str, number: int) -> list[list[str]]:
    """The rows of the tables in the ``number``-th element with an id."""
    places = [e for e in page.inside() if e.attrs.get("id") == div_id]
    if len(places) <= number:
        return []
    tables = [places[number]] if places[number].tag == "table" else places[number].own("table", "table")
    return [r for t in tables for r in _rows(t)]


def html_table(pages: DataFrame, key: str, column: str, div_id: str, number: int = 0) -> DataFrame:
    """``key, row, cells`` of the tables in the ``number``-th element with an id; a table in a cell belongs to that cell."""
    return _parsed(pages, key, column, ["row", "cells"], ["int", "array<string>"], lambda page: enumerate(_table(page, div_id, number)))


#: An ampersand that begins no reference which a semicolon ends.
_UNENDED = "&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)"


def outline(pages: DataFrame, key: str, column: str, ended: bool = False) -> DataFrame:
    """``key, lang, title, links, paragraphs``: labels of the links and texts of the paragraphs, in order.

    Browsers read some references that no semicolon ends, too; with ``ended`` these stay as they are written.
    """

    def rows(page: Element):
        html, title = page.first("html"), page.first("title")
        yield html and html.attrs.get("lang"), title and title.text(), [a.text() for a in page.all("a")], [p.text() for p in page.all("p")]

    if ended:
        pages = pages.withColumn(column, F.regexp_replace(column, _UNENDED, "&amp;"))
    return _parsed(pages, key, column, ["lang", "title", "links", "paragraphs"], ["string", "string", "array<string>", "array<string>"], rows)


def links(pages: DataFrame, key: str, column: str) -> DataFrame:
    """``key, href, label`` of each link of a page that leads somewhere."""

    def rows(page: Element):
        for a in page.all("a"):
            if "href" in a.attrs:
                yield a.attrs["href"], a.text()

    return _parsed(pages, key, column, ["href", "label"], ["string", "string"], rows)


def decode_fixture_rows(rows: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """Positional cells as named columns; ``names(site_name, team)`` maps opponents; an empty flag means played."""
    wide = rows.select("*", *(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns))).drop("cells")
    mapped = wide.join(names, F.col("Team2") == F.col("site_name"), "left")
    played = F.when(F.col("Played?") == "", True).when(F.col("Played?") == "h2h", False)
    return mapped.withColumns({"Team2": F.coalesce("team", "Team2"), "Played?": played}).drop("site_name", "team")


def fixture_pages(pages: DataFrame, names: DataFrame, columns: list[str], competition: str | None = None, div_id: str = "team_games") -> DataFrame:
    """Fixtures of ``pages(team_slug, html)``: the second table of games, decoded; ``Team1`` is the page's team.

    A page without a second table gives no rows.
    """
    rows = html_table(pages, "team_slug", "html", div_id, 1)
    found = decode_fixture_rows(rows, columns, names).withColumn("Team1", F.col("team_slug"))
    return found if competition is None else found.filter(F.col("Competition") == competition)


#: What an event's title holds, and what the icon of a title-less one is.
EVENTS = {"Assistência": "Assists", "Vermelhos": "Red Card", "Amarelos": "Yellow Card", "Golos": "Goals", "Entrou": "Substitution IN"}
ICONS = {"7": "Substitution IN", "8": "Substitution OUT"}
EVENT_COLUMNS = ("Goals", "Assists", "Red Card", "Yellow Card", "Substitution OUT", "Substitution IN")


def _said(e: Element | None) -> str | None:
    return e.text() if e is not None else None


def _events(block: Element | None) -> list[str]:
    """Minutes of each kind of event: an icon's minute is the first ``div`` behind it."""
    found: dict[str, list[str]] = {c: [] for c in EVENT_COLUMNS}
    minutes = list(block.all("div")) if block is not None else []
    for icon in block.all("span") if block is not None else ():
        title = icon.attrs.get("title", "")
        kind = next((k for mark, k in EVENTS.items() if mark in title), None) or (icon.has("grey") and ICONS.get(icon.text())) or None
        minute = next((m for m in minutes if m.order > icon.order), None)
        if kind and minute is not None:
            found[kind].append(minute.text())
    return [", ".join(x) for x in found.values()]


def match_reports(pages: DataFrame, key: str, column: str) -> DataFrame:
    """``key, team, status, number, name`` and a column of minutes for each kind of event, of each player of a match page.

    The first block of a page holds those who start, the second the substitutes;
    each has a column for each team, which may leave out its name the second time.
    A page with fewer blocks gives no rows.
    """

    def rows(page: Element):
        blocks = list(page.all("div", "section_620", "game_report"))
        teams: dict[int, str | None] = {}
        for status, block in zip(("Starter", "Suplente"), blocks, strict=False) if len(blocks) > 1 else ():
            for i, part in enumerate(block.all("div", "column_300")):
                teams[i] = _said(part.first("div", "subtitle")) or teams.get(i)
                for one in part.all("div", "player"):
                    yield teams[i], status, _said(one.first("div", "number")), _said(one.first("div", "name")), *_events(one.first("div", "events"))

    names = ["team", "status", "number", "name", *EVENT_COLUMNS]
    return _parsed(pages, key, column, names, ["string"] * len(names), rows)


def squads(pages: DataFrame, key: str, column: str, site: str) -> DataFrame:
    """``key, number, name, profile_url, photo_url`` of each person on a squad page; those without a link are left out."""

    def rows(page: Element):
        for one in page.all("div", "staff"):
            name, photo = one.first("div", "name"), one.first("div", "photo")
            words = name.first("div", "micrologo_and_text") if name else None
            words = words.first("div", "text") if words else None
            link = next((a for a in words.all("a") if "href" in a.attrs), None) if words else None
            if link:
                at, seen = link.attrs["href"], re.search(r"url\(['\"]?(.*?)['\"]?\)", photo.attrs.get("style", "")) if photo else None
                yield _said(one.first("div", "number")), link.text() or name.text(), site + at if at.startswith("/") else at, seen[1] if seen else None

    return _parsed(pages, key, column, ["number", "name", "profile_url", "photo_url"], ["string"] * 4, rows)


def player_stats(pages: DataFrame, key: str, column: str, div_id: str = "team_games") -> DataFrame:
    """``key, row, name, value``: the cells of a player's table of competitions under the names that its first row gives.

    A nameless first column is the ``Competition``, and empty in the row of the
    ``Total``; other nameless ones are called by their place. ``key`` is unique.
    """

    def rows(page: Element):
        head, *others = _table(page, div_id, 0) or [[]]
        for i, cells in enumerate(others, 1):
            yield i, head, cells

    read = _parsed(pages, key, column, ["row", "names", "cells"], ["int", "array<string>", "array<string>"], rows)
    cells = read.select(key, "row", "cells", F.posexplode("names").alias("at", "head"))
    value, lead = F.get("cells", F.col("at")), (F.col("at") == 0) & (F.col("head") == "")
    name = F.when(lead, "Competition").when(F.col("head") == "", F.concat(F.lit("col_"), F.col("at").cast("string"))).otherwise(F.col("head"))
    return cells.select(key, "row", name.alias("name"), F.when(lead & (value == ""), "Total").otherwise(value).alias("value"))
