"""Date parsing. Naive times are UTC everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted plain date layouts, in the order tried.
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d-M-yyyy"]


def iso_timestamp(c: Column) -> Column:
    """ISO date or date-time; null when it is neither."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), c.try_cast("timestamp"))


def any_date(c: Column) -> Column:
    """ISO text with a time part, else one of the plain layouts."""
    iso = F.when(c.contains("T"), iso_timestamp(c))
    return F.coalesce(iso, *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def rfc822_timestamp(c: Column) -> Column:
    """Feed dates such as ``Tue, 02 Jan 2024 10:00:00 +0000``."""
    text = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\w+,\s*", ""), r"\s(?:GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")), iso_timestamp(F.trim(c)))


def modified_after(changed: Column, since: Column, on_unparsed: bool) -> Column:
    """Strictly later than ``since``; ``on_unparsed`` decides for missing or bad times."""
    # Spelled so that a filter on a stored time reaches the scan.
    later = changed > since
    return changed.isNull() | later if on_unparsed else changed.isNotNull() & later


def modified_within(changed: Column, asof: Column, days: int, on_unparsed: bool = True) -> Column:
    """Changed in the last ``days`` days before ``asof``."""
    return modified_after(changed, asof - F.expr(f"INTERVAL {days} DAYS"), on_unparsed)
