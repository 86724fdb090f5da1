"""Text normalisation, sanitising and blocked-page labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The extended Arabic-Indic digits and their Latin counterparts.
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
LATIN_DIGITS = "0123456789"

# Phrases that identify a challenge page, by label, in the order they are tried.
CHALLENGE_PHRASES = {
    "recaptcha": ["google.com/recaptcha", "g-recaptcha", "grecaptcha", "recaptcha/api.js"],
    "hcaptcha": ["hcaptcha.com", "h-captcha", "hcaptcha-widget"],
    "simple": [
        "captcha",
        "security code",
        "security image",
        "verify you are human",
        "verification required",
    ],
}

# The shorter yes/no list used when a page is fetched.
BLOCKED_PHRASES = [
    "captcha",
    "recaptcha",
    "g-recaptcha",
    "hcaptcha",
    "verification required",
    "verify you are human",
    "security check",
    "bot protection",
]


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Spark has no built-in for it, so this is the one scalar Python function. Only
    texts that are not plain ASCII, on which it does nothing, are handed to it."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normalize_digits(c: Column) -> Column:
    """Persian digits to Latin ones; null becomes the empty string."""
    return F.translate(F.coalesce(c, F.lit("")), PERSIAN_DIGITS, LATIN_DIGITS)


def normalize_text(c: Column, lower: bool = False, compose: bool = True) -> Column:
    """NFKC, Latin digits and, on request, lower case. ``compose=False`` skips NFKC and
    stays in the JVM, for text known to be composed already."""
    c = F.coalesce(c, F.lit(""))
    c = normalize_digits(nfkc(c) if compose else c)
    return F.lower(c) if lower else c


def sanitize_text(c: Column) -> Column:
    """NUL bytes to spaces, as text columns of row stores reject them."""
    return F.translate(c, chr(0), " ")


def sanitize_value(c: Column, dtype) -> Column:
    """A storable value for any column: scalars unchanged, text without NUL bytes,
    containers as JSON, dates and timestamps as ISO text."""
    name = dtype.typeName()
    if name in ("array", "struct", "map"):
        return F.to_json(c)
    if name in ("timestamp", "timestamp_ntz"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if name == "date":
        return F.date_format(c, "yyyy-MM-dd")
    return sanitize_text(c) if name in ("string", "varchar", "char") else c


def _any_phrase(c: Column, phrases: list[str]) -> Column:
    return F.lower(c).rlike("|".join(p.replace(".", r"\.") for p in phrases))


def challenge_label(html: Column) -> Column:
    """``recaptcha``, ``hcaptcha``, ``simple`` or the empty string."""
    out = F
    for label, phrases in CHALLENGE_PHRASES.items():
        out = out.when(_any_phrase(html, phrases), label)
    return out.otherwise("")


def is_blocked(html: Column) -> Column:
    return F.coalesce(_any_phrase(html, BLOCKED_PHRASES), F.lit(False))


def title_from_slug(url: Column) -> Column:
    """A readable title from the last path part."""
    slug = F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))
