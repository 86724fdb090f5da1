"""Video quality labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.urls import once

# Where a resolution may stand in a media URL, most specific first.
QUALITY_PATTERNS = [
    r"[/-](\d{3,4})[pP][/-]",
    r"\.(\d{3,4})[pP]\.",
    r"quality[=/-](\d{3,4})",
    r"resolution[_\-](\d{3,4})",
    r"/(\d{3,4})[pP]?/",
    r"[_\-](\d{3,4})[pP]?[_\-]",
    r"[-_.](\d{3,4})[-_.]",
    r"[/_-](\d{3,4})[/_-]",
    r"[^0-9](\d{3,4})[^0-9]",
]
# Standard resolutions.
STANDARD_QUALITIES = [360, 480, 720, 1080, 1440, 2160, 4320]
# Phrases that stand for a resolution. Tried longest first, so that ``fullhd``
# is not taken for ``hd``.
QUALITY_PHRASES = {
    "low": "480",
    "medium": "720",
    "high": "1080",
    "hd": "720",
    "fullhd": "1080",
    "ultrahd": "2160",
    "4k": "2160",
    "8k": "4320",
}
# Labels that name a resolution.
QUALITY_LABELS = {
    "sd": "480",
    "hd": "720",
    "fullhd": "1080",
    "ultrahd": "2160",
    "4k": "2160",
    "8k": "4320",
}


def _standard(number: Column) -> Column:
    """The next standard resolution at or above ``number``."""
    out = F.when(number < 1, None)
    for step in STANDARD_QUALITIES[:-1]:
        out = out.when(number <= step, str(step))
    return out.when(number.isNotNull(), str(STANDARD_QUALITIES[-1]))


def _on_host(url: Column, hosts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for host in hosts:
        hit = hit | url.contains(host)
    return hit


def quality_from_url(url: Column, cdn_hosts: tuple[str, ...] = ()) -> Column:
    """Resolution named by a media URL, or ``unknown``. ``cdn_hosts`` are media hosts whose
    files come in two qualities only."""
    low = F.lower(url)
    numbers = [
        once(F.nullif(F.regexp_extract(url, p, 1), F.lit("")).cast("int"), _standard) for p in QUALITY_PATTERNS
    ]
    phrases = F
    for phrase in sorted(QUALITY_PHRASES, key=len, reverse=True):
        phrases = phrases.when(low.contains(phrase), QUALITY_PHRASES[phrase])
    out = F.when(F.coalesce(url, F.lit("")) == "", "unknown")
    if cdn_hosts:
        on_cdn = _on_host(low, cdn_hosts)
        out = out.when(on_cdn & low.rlike("hd|720|1080"), "720").when(on_cdn, "480")
    return out.otherwise(F.coalesce(*numbers, phrases, F.lit("unknown")))


def quick_quality(url: Column, cdn_hosts: tuple[str, ...] = ()) -> Column:
    """The cheap label used while coercing records; standard definition by default."""
    low = F.lower(url)
    out = (
        F.when(F.coalesce(url, F.lit("")) == "", "unknown")
        .when(low.contains("1080"), "1080")
        .when(low.contains("720"), "720")
        .when(low.contains("hd"), "720")
        .when(low.contains("480"), "480")
    )
    if cdn_hosts:
        out = out.when(_on_host(low, cdn_hosts), "720")
    return out.otherwise("480")


def standard_quality(label: Column) -> Column:
    """A label as a resolution: known names by table, others by their first digits."""
    digits = F.nullif(F.regexp_extract(label, r"(\d+)", 1), F.lit(""))
    out = F
    for name, value in QUALITY_LABELS.items():
        out = out.when(F.lower(label) == name, value)
    return out.otherwise(F.coalesce(digits, label))
