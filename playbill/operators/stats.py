"""Counts, summaries and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.operators.grouping import cap_per_category
from playbill.session import computed


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def category_stats(parsed: DataFrame, samples: int = 3) -> DataFrame:
    """Total and modified URLs per category, the first URLs as samples, and a row of totals."""
    counts = parsed.rollup("category").agg(
        F.count("*").alias("total"), F.count_if(F.col("is_modified")).alias("modified"), F.grouping("category").alias("_all")
    )
    first = cap_per_category(parsed.select("category", "url", "pos"), samples, order=("pos", "url"))
    first = first.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("pos", "url"))).alias("s"))
    none = F.expr("cast(array() as array<string>)")
    samples_of = F.when(F.col("_all") == 0, F.transform("s", lambda x: x["url"])).otherwise(none)
    name = F.when(F.col("_all") == 1, "all").otherwise(F.col("category"))
    return counts.join(first, "category", "left").select(name.alias("category"), "total", "modified", samples_of.alias("sample_urls"))


def progress_stats(processed: DataFrame, pending: DataFrame) -> DataFrame:
    """Processed and pending URLs per type and in total."""
    states = processed.select("content_type", F.lit("processed").alias("state")).unionByName(
        pending.select("content_type", F.lit("pending").alias("state"))
    )
    per_type = (
        states.groupBy("content_type")
        .pivot("state", ["processed", "pending"])
        .count()
        .na.fill(0, ["processed", "pending"])
    )
    total = per_type.agg(
        F.lit("all").alias("content_type"),
        F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"),
    )
    return per_type.unionByName(total)


def content_summary(content: DataFrame) -> DataFrame:
    """New items per type."""
    return content.groupBy("content_type").agg(F.count("*").alias("n"))


def feed_stats(feeds: DataFrame, state: DataFrame, blacklisted: DataFrame) -> DataFrame:
    """Every feed with whether it was seen, has a marker and is blacklisted."""
    seen = state.select("feed", F.lit(True).alias("seen"), F.col("last_guid"))
    listed = blacklisted.select("url", F.lit(True).alias("listed")).dropDuplicates(["url"])
    rows = feeds.join(seen, "feed", "left").join(listed, "url", "left")
    return rows.select(
        "feed",
        F.coalesce("seen", F.lit(False)).alias("seen"),
        (F.coalesce("last_guid", F.lit("")) != "").alias("has_guid"),
        F.coalesce("listed", F.lit(False)).alias("blacklisted"),
    )


def feed_totals(feeds: DataFrame) -> DataFrame:
    return feeds.agg(
        F.count("*").alias("total_feeds"),
        F.count_if(~F.col("blacklisted")).alias("active_feeds"),
        F.count_if("has_guid").alias("feeds_with_guid"),
        F.count_if("blacklisted").alias("blacklisted_feeds"),
    )


def id_lists(parsed: DataFrame) -> DataFrame:
    """``(id_list, category, api_id)``: all ids and the modified ones per category, one row per
    id. An id missing from the entry is read from its URL."""
    found = F.coalesce("api_id", urls.post_id(F.col("url"), "sitemap"))
    ids = computed(parsed.select("category", "is_modified", "url", "api_id"), {"api_id": found})
    ids = ids.filter(F.col("api_id").isNotNull())
    lists = F.when(F.col("is_modified"), F.array(F.lit("all"), F.lit("modified"))).otherwise(F.array(F.lit("all")))
    return ids.select(F.explode(lists).alias("id_list"), "category", "api_id")


def count_drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Counts per category now, in the previous run, and their difference."""
    rows = current.withColumnRenamed("n", "now").join(
        previous.withColumnRenamed("n", "before"), "category", "full_outer"
    )
    rows = rows.na.fill(0, ["now", "before"])
    return rows.withColumn("drift", F.col("now") - F.col("before"))
