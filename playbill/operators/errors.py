"""Failure tracking: severities, thresholds, blacklisting, expiry and reports.

Events are ``(url, error_type, ts, event_id)``. URL and error type are separate columns, so
that reports group by the real URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.operators.grouping import first_n_per_group, ranked

# Severity of the known error types, in the order partial names are matched.
SEVERITY = {
    "db_connection_error": "critical",
    "db_integrity_error": "critical",
    "file_corruption": "critical",
    "api_404": "high",
    "api_auth_error": "high",
    "captcha_detected": "high",
    "http_403": "high",
    "http_401": "high",
    "api_rate_limit": "high",
    "db_save_error": "high",
    "http_500": "medium",
    "http_502": "medium",
    "http_503": "medium",
    "http_504": "medium",
    "timeout": "medium",
    "connection_error": "medium",
    "api_error": "medium",
    "parsing_error": "medium",
    "warning": "low",
    "minor_issue": "low",
}
# Days an error stays after its last occurrence.
EXPIRY_DAYS = {"critical": 30, "high": 14, "medium": 7, "low": 3}
BASE_THRESHOLD = 3


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def severity(error_type: Column) -> Column:
    """The listed severity, else that of the first known type contained in the name, else medium."""
    names = F.array(*[F.lit(name) for name in SEVERITY])
    part = F.get(F.filter(names, lambda name: error_type.contains(name)), F.lit(0))
    known = _lookup(SEVERITY)
    return F.coalesce(known[error_type], known[part], F.lit("medium"))


def thresholds(base: int = BASE_THRESHOLD) -> dict[str, int]:
    """Errors of one type that blacklist a URL, by severity."""
    return {"critical": max(1, base // 3), "high": max(1, base // 2), "medium": base, "low": 2 * base}


def threshold(error_type: Column, base: int = BASE_THRESHOLD) -> Column:
    return _lookup(thresholds(base))[severity(error_type)]


def expiry_days(error_type: Column) -> Column:
    return _lookup(EXPIRY_DAYS)[severity(error_type)]


def clean_events(events: DataFrame) -> DataFrame:
    events = events.withColumn("url", urls.strip_slash(F.col("url")))
    return events.filter(F.col("url") != "")


def after_clears(events: DataFrame, clears: DataFrame) -> DataFrame:
    """Events that come after the last time their URL was cleared. ``clears`` has ``url, ts, event_id``."""
    last = clean_events(clears).groupBy("url").agg(F.max(F.struct("ts", "event_id")).alias("_cleared"))
    rows = clean_events(events).join(last, "url", "left")
    later = F.struct("ts", "event_id") > F.col("_cleared")
    return rows.filter(F.coalesce(later, F.lit(True))).drop("_cleared")


def counted_events(events: DataFrame, base: int = BASE_THRESHOLD) -> DataFrame:
    """The events that count, with ``hit``, the event that blacklisted their URL, if any.

    The n-th error of a type blacklists its URL, and later errors of that URL are not counted.
    So at most n events of a URL and type ever count, and all others are dropped before the
    first shuffle however many there are.
    """
    most = max(thresholds(base).values())
    early = first_n_per_group(
        clean_events(events), ["url", "error_type"], ["ts", "event_id"], most, rank="nth"
    )
    limit = threshold(F.col("error_type"), base)
    crossing = F.when(F.col("nth") == limit, F.struct("ts", "event_id"))
    early = early.withColumn("hit", F.min(crossing).over(W.partitionBy("url")))
    return early.filter(F.col("hit").isNull() | (F.struct("ts", "event_id") <= F.col("hit")))


def tracked(counted: DataFrame) -> DataFrame:
    """Tracker state: ``(url, error_type, n, last_ts)``."""
    return counted.groupBy("url", "error_type").agg(
        F.count("*").alias("n"), F.max("ts").alias("last_ts")
    )


def blacklist(counted: DataFrame) -> DataFrame:
    """Blacklisted URLs with the event that did it."""
    at = F.struct(F.col("ts"), F.col("event_id")) == F.col("hit")
    return counted.filter(at).select("url", "error_type", F.col("ts").alias("blacklisted_at"), "event_id")


def error_counts(events: DataFrame) -> DataFrame:
    """All occurrences per URL and type, blacklisting aside."""
    return tracked(clean_events(events))


def expire(errors: DataFrame, blacklisted: DataFrame, asof: Column) -> tuple[DataFrame, DataFrame]:
    """Drop errors past their severity's horizon and release URLs with no error left."""
    days = expiry_days(F.col("error_type"))
    age = F.unix_micros(asof) - F.unix_micros("last_ts")
    live = errors.filter(F.coalesce(age <= days * F.lit(86400 * 10**6).cast("bigint"), F.lit(False)))
    return live, blacklisted.join(live.select("url"), "url", "left_semi")


def problem_ranking(errors: DataFrame, min_errors: int = 1, level: str | None = None) -> DataFrame:
    """Total errors per URL and its most frequent type; equal counts go to the type seen
    first, here the alphabetically first."""
    if level:
        errors = errors.filter(severity(F.col("error_type")) == level)
    main = F.min_by("error_type", F.struct(-F.col("n"), F.col("error_type")))
    totals = errors.groupBy("url").agg(F.sum("n").alias("error_count"), main.alias("main_type"))
    return totals.filter(F.col("error_count") >= min_errors)


def top_problems(errors: DataFrame, k: int = 10, min_errors: int = 2) -> DataFrame:
    ranking = problem_ranking(errors, min_errors)
    top = ranking.orderBy(F.desc("error_count"), "url").limit(k)
    return top.withColumn("severity", severity(F.col("main_type")))


def error_stats(errors: DataFrame, blacklisted: DataFrame) -> DataFrame:
    """``(section, name, value)``: keys by type and by severity, totals and blacklist size."""
    by_type = errors.groupBy("error_type").agg(F.count("*").alias("value"))
    types = by_type.select(F.lit("error_type").alias("section"), F.col("error_type").alias("name"), "value")
    levels = by_type.groupBy(severity(F.col("error_type")).alias("name")).agg(F.sum("value").alias("value"))
    total = by_type.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    listed = blacklisted.agg(F.count("*").alias("value"))
    return (
        types.unionByName(levels.select(F.lit("severity").alias("section"), "name", "value"))
        .unionByName(total.select(F.lit("total").alias("section"), F.lit("error_count").alias("name"), "value"))
        .unionByName(
            listed.select(F.lit("total").alias("section"), F.lit("blacklist_count").alias("name"), "value")
        )
    )


def blacklist_sample(blacklisted: DataFrame, k: int = 10) -> DataFrame:
    return blacklisted.select("url").orderBy("url").limit(k)


def error_rollup(events: DataFrame) -> DataFrame:
    """Errors by category and type with subtotals and the grand total."""
    return events.rollup("category", "error_type").agg(F.count("*").alias("n"))


def failing_urls(errors: DataFrame, least: int) -> DataFrame:
    """URLs with at least ``least`` save failures, to be skipped."""
    return errors.groupBy("url").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("url")


def error_report(errors: DataFrame, blacklisted: DataFrame, urls_shown: int = 10, listed_shown: int = 5) -> DataFrame:
    """The report as lines ``(section, place, line)``: error types by number of URLs, the worst
    URLs, and the first blacklisted ones. All types are shown; as free text they may be many, so their places come from ``ranked``."""
    types = errors.groupBy("error_type").agg(F.count("*").alias("n"))
    types = ranked(types, [F.desc("n"), F.col("error_type")], "place")
    type_line = F.concat("error_type", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), severity(F.col("error_type")), F.lit(" severity)"))
    worst = top_problems(errors, urls_shown)
    by_errors = W.orderBy(F.desc("error_count"), "url")
    url_line = F.concat("url", F.lit(": "), F.col("error_count").cast("string"), F.lit(" errors ("), "main_type", F.lit(", "), "severity", F.lit(" severity)"))
    listed = blacklist_sample(blacklisted, listed_shown)
    parts = [
        types.select(F.lit("types").alias("section"), F.col("place").cast("int").alias("place"), type_line.alias("line")),
        worst.select(F.lit("urls").alias("section"), F.row_number().over(by_errors).alias("place"), url_line.alias("line")),
        listed.select(F.lit("blacklist").alias("section"), F.row_number().over(W.orderBy("url")).alias("place"), F.col("url").alias("line")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
