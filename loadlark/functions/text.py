"""Labels of matches, minute strings and other parsed text; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classes import result_letter

# The words of a label. A league round has its number, and a mark in the play-off.
_ROUND, _PLAYOFF, _GAMES, _VENUES = "jornada", r"ap\.?\s*campeão", ("treino", "taça"), {"casa": "home", "fora": "away"}

_GOALS = r"(\d\d?|\?)"
#: The whole grammar at once; groups: matchweek, opponent, venue, the home team's goals, the away team's.
LABEL = (
    rf"(?isu)^\s*(?:{_ROUND}\s*(\d+(?:\s*{_PLAYOFF})?)|jogo(?:\s+(?:{'|'.join(_GAMES)}))?)?"
    rf"[\s–-]*(.*?)[\s–-]*\(\s*({'|'.join(_VENUES)})\s*\)(?:.*?{_GOALS}\s*[–-]\s*{_GOALS}\s*$)?"
)

#: A label as its groups, the opponent last as it may hold anything; a text that isn't a label as empty ones.
_CUT = "\u0001"
_ANY = rf"(?s)(?:{LABEL}.*|\A.+)"


def blank(c: Column) -> Column:
    """Null for the empty string."""
    return F.when(c != "", c)


def parse_label(label: Column) -> Column:
    """``struct<opponent, venue, goals_for, goals_against, scoreline, team_result, matchweek>`` of a match label.

    ``<prefix> [-] <opponent> (CASA|FORA) <home>-<away>``; without the venue in
    brackets all fields are null. Scores are home first; ``?`` keeps the score
    line alone. The matchweek keeps a play-off suffix.
    """
    # one match gives all groups, and a lambda's variable holds them, so that no field runs the pattern again
    groups = F.split(F.regexp_replace(label, _ANY, _CUT.join(f"${i}" for i in (1, 3, 4, 5, 2))), _CUT, 5)
    return F.transform(F.array(groups), _label_fields)[0]


def _label_fields(groups: Column) -> Column:
    week, place, home, away, opponent = (blank(F.get(groups, F.lit(i))) for i in range(5))
    at_home = F.lower(place) == "casa"
    own, other = F.when(at_home, home).otherwise(away).try_cast("int"), F.when(at_home, away).otherwise(home).try_cast("int")
    known = own.isNotNull() & other.isNotNull()
    number = lambda c: F.coalesce(c.try_cast("int").cast("string"), c)
    fields = {
        "opponent": opponent, "venue": F.when(at_home, _VENUES["casa"]).otherwise(_VENUES["fora"]), "goals_for": F.when(known, own), "goals_against": F.when(known, other),
        "scoreline": F.when(known, F.concat_ws("-", number(home), number(away))).otherwise(F.concat(home, F.lit("-"), away)),
        "team_result": F.when(known, result_letter(own, other)), "matchweek": F.btrim(F.regexp_replace(week, r"\s+", " ")),
    }
    return F.struct(*(F.when(place.isNotNull(), c).alias(k) for k, c in fields.items()))


def build_label(competition: Column, matchweek: Column, opponent: Column, venue: Column, goals_for: Column, goals_against: Column) -> Column:
    """The inverse of :func:`parse_label`; unknown goals are ``?``."""
    week = blank(F.btrim(matchweek.cast("string")))
    prefix = (
        F.when(competition == "Campeonato", F.concat(F.lit("Jornada"), F.coalesce(F.concat(F.lit(" "), week), F.lit("")), F.lit(" - ")))
        .when(competition == "Taça", "Jogo Taça - ")
        .otherwise("Jogo Treino ")
    )
    at_home = venue == "home"
    home, away = F.when(at_home, goals_for).otherwise(goals_against), F.when(at_home, goals_against).otherwise(goals_for)
    number = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(prefix, F.btrim(opponent), F.when(at_home, " (CASA) ").otherwise(" (FORA) "), number(home), F.lit("-"), number(away))


def parse_minutes(c: Column) -> Column:
    """``23, 45+2'`` as ``[23, 47]``; what isn't a minute is skipped, null gives an empty array."""
    clean = F.transform(F.split(F.coalesce(c, F.lit("")), "[ ,]+"), lambda t: F.btrim(t, F.lit("'")))
    plain = F.filter(clean, lambda t: t.rlike(r"^\d+'?(\+\d+)?$"))
    return F.transform(
        plain,
        lambda t: F.regexp_extract(t, r"^(\d+)", 1).cast("int") + F.coalesce(F.regexp_extract(t, r"\+(\d+)$", 1).try_cast("int"), F.lit(0)),
    )


def first_minute(c: Column) -> Column:
    return F.get(parse_minutes(c), F.lit(0))


def is_penalty(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"g\.p|pen"), F.lit(False))


def md_label(offset: Column) -> Column:
    return F.when(offset.isNull(), "PRE").when(offset == 0, "MD").otherwise(F.format_string("MD%+d", offset))


def md_order(offset: Column) -> Column:
    """Sort key: the match, days after it, days before it, preparation."""
    return F.when(offset.isNull(), 1000).when(offset == 0, 0).when(offset > 0, offset).otherwise(100 + offset)


def match_quality(offset: Column) -> Column:
    return F.when(offset.isNull(), "unmatched").when(offset == 0, "exact").otherwise(F.format_string("%+dd", offset))


def numeric_matchweek(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def strip_unit(c: Column) -> Column:
    """Drops one trailing ``(unit)``."""
    return F.regexp_replace(c, r"\s*\([^()]*\)$", "")


def split_label_unit(c: Column) -> tuple[Column, Column]:
    return F.btrim(strip_unit(c)), blank(F.regexp_extract(c, r"\(([^()]*)\)\s*$", 1))


def yes(c: Column) -> Column:
    """``SIM`` as true; missing stays missing."""
    return F.when(c.isNotNull(), F.upper(F.btrim(c)) == "SIM")


def team_stats_url(profile_url: Column, team_slug: Column, team_id: Column, site: str) -> Column:
    """A player's statistics for one team, from the address of the profile; null if that has no slug and number."""
    part = lambda i: F.regexp_extract(profile_url, r"/jogador/([^/]+)/(\d+)", i)
    page = F.format_string("%s/estatisticas/%s-%s/p%s-t%s?filter_match=in_with", F.lit(site), part(1), team_slug, part(2), team_id)
    return F.when(part(2) != "", page)
