"""Scalar expressions: roles, sentiment, numbers, small helpers for windows."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Officer titles that name a role, in the order in which they are looked for.
ROLES = ["CEO", "CFO", "COO", "CTO", "PRESIDENT", "DIRECTOR"]
ROLE_NAMES = {"PRESIDENT": "President", "DIRECTOR": "Director"}
LONG_TITLES = {"CHIEF EXECUTIVE": "CEO", "C.E.O": "CEO", "CHIEF FINANCIAL": "CFO", "C.F.O": "CFO", "CHIEF OPERATING": "COO", "C.O.O": "COO", "CHIEF TECHNOLOGY": "CTO", "CHIEF TECHNICAL": "CTO", "C.T.O": "CTO"}


def by_symbol(key: str = "symbol", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def guarded(agg, col: Column, size: int, least: int | None = None, key: str = "symbol", order: str = "date") -> Column:
    """A rolling aggregate that is null until the frame holds `least` (default: `size`) non-null rows."""
    w = by_symbol(key, order).rowsBetween(-(size - 1), 0)
    return F.when(F.count(col).over(w) >= (size if least is None else least), agg(col).over(w))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0.0))


def strip_xml_namespaces(xml: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(xml, r"""\sxmlns(:\w+)?=("[^"]*"|'[^']*')""", ""), r"(</?)\w+:", "$1")


def role_from_title(title: Column) -> Column:
    """The first role of ROLES whose name is in the title, else one that the long title spells out, else the title itself.

    A plain "Director" is a Director: the letters CTO inside it don't count.
    """
    up = F.upper(title)
    out = F.when(F.trim(up) == "DIRECTOR", F.lit("Director"))
    for role in ROLES:
        hit = F.regexp_replace(up, "DIRECTOR", "").contains(role) if role == "CTO" else up.contains(role)
        out = out.when(hit, F.lit(ROLE_NAMES.get(role, role)))
    for text, role in LONG_TITLES.items():
        out = out.when(up.contains(text), F.lit(role))
    return out.otherwise(title)


def owner_role(title: Column, is_director: Column, is_officer: Column) -> Column:
    yes = lambda c: F.lower(F.trim(c.cast("string"))).isin("1", "true")
    named = F.when(F.length(F.trim(title)) > 0, role_from_title(title))
    return F.coalesce(named, F.when(yes(is_director), F.lit("Director")), F.when(yes(is_officer), F.lit("Officer")), F.lit("Unknown"))


def sentiment_to_score(label: Column, score: Column) -> Column:
    low = F.lower(label)
    return F.when(low == "positive", 0.5 + score / 2).when(low == "negative", 0.5 - score / 2).otherwise(F.lit(0.5))


def truncate_headline(text: Column, n: int = 512) -> Column:
    return F.substring(text, 1, n)


def parse_number(text: Column) -> Column:
    """A number with thousands separators; null if it isn't one."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def year_of(date: Column) -> Column:
    return F.year(date)
