"""Numbers found in text, and numeric coercion of record fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.urls import once


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _int(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("int")


def release_year(release_date: Column, url: Column) -> Column:
    """First four digits of the release date, else the year in a ``movies-YYYY`` URL."""
    return F.coalesce(_int(_found(release_date, r"(\d{4})")), _int(_found(url, r"/movies-(\d{4})")))


def first_number(c: Column) -> Column:
    """A rating: the first number, with an optional fraction."""
    return _found(c, r"(\d+(?:\.\d+)?)").try_cast("double")


def counted(c: Column) -> Column:
    """A vote count: the first run of digits and commas."""
    return _int(_found(c, r"([\d,]+)"))


def parenthesised(c: Column) -> Column:
    """A comment count, as in ``Comments (12)``."""
    return _int(_found(c, r"\((\d+)\)"))


def whole_number(c: Column) -> Column:
    """A share count: the whole text must be a number once commas are gone."""
    return _int(F.trim(c))


def _unless_known(found: Column):
    """A number of 1 may be a mere default: another number found for it counts instead."""

    def use(n: Column) -> Column:
        return F.when(n == 1, F.coalesce(found, n)).otherwise(n)

    return use


def episode_numbering(label: Column, crumbs: Column, url: Column, title: Column) -> tuple[Column, Column]:
    """Season and episode of an episode page.

    ``label`` reads ``"2 - 5"``; where it does not settle a number, i.e. that number is still
    1, the season comes from the breadcrumb texts and the episode from the URL or the title.
    """
    parts = F.split(F.trim(label), "-")
    season, episode = [F.trim(F.get(parts, F.lit(i))).try_cast("int") for i in (0, 1)]
    # Both halves count or none does, except that the season half is read first.
    two = F.size(parts) == 2
    s = F.coalesce(F.when(two, season), F.lit(1))
    e = F.coalesce(F.when(two & season.isNotNull(), episode), F.lit(1))
    crumb_numbers = F.array_compact(
        F.transform(crumbs, lambda t: _int(_found(F.lower(t), r"season\s*(\d+)")))
    )
    s = once(s, _unless_known(F.try_element_at(crumb_numbers, F.lit(-1))))
    for text, pattern in ((url, r"ep(?:isode)?[_-]?(\d+)"), (title, r"episode\s*(\d+)")):
        e = once(e, _unless_known(_int(_found(F.lower(text), pattern))))
    return s, e


def coerce_int(c: Column) -> Column:
    """Text or number to a whole number, cut toward zero: null stays, failures give 0."""
    number = F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")
    return F.when(c.isNotNull(), F.coalesce(number.try_cast("bigint"), F.lit(0)))


def coerce_double(c: Column) -> Column:
    """Text or number to a double: null stays, failures give 0."""
    number = F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")
    return F.when(c.isNotNull(), F.coalesce(number, F.lit(0.0)))
