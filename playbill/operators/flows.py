"""The three end-to-end flows: sitemap refresh, catalogue build and feed round. Each is one
lazy plan made of the operators next door."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.functions.dates import iso_timestamp, modified_after
from playbill.operators import api, feeds, frontier, joins, quality, upsert
from playbill.operators.grouping import keep_latest, latest_per_key
from playbill.schemas import conform, schema_of
from playbill.sources import xml


def refresh_sitemaps(rows: DataFrame, blacklist: DataFrame, since: Column | None = None) -> DataFrame:
    """Parsed URLs ``(category, is_modified, url, lastmod, api_id, pos)`` from sitemap rows
    ``(loc, lastmod, pos)``: categorised, without blacklisted URLs, the newest entry per URL.

    The modified list is made from modified entries alone, so its entry of a URL may differ from
    the one in the full list.
    """
    entries = xml.sitemap_entries(rows, since).filter(F.col("category").isNotNull())
    entries = frontier.exclude(entries, blacklist, ["url"])
    entries = entries.select("category", "is_modified", "url", "lastmod", "api_id", "pos")
    # The list is part of the key: both lists come out of one aggregation.
    lists = F.when(F.col("is_modified"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    listed = entries.withColumn("is_modified", F.explode(lists))
    return keep_latest(listed, ["category", "is_modified", "url"])


def sitemap_counters(rows: DataFrame, blacklist: DataFrame, since: Column | None = None) -> DataFrame:
    """One row of problem counts: uncategorised, blacklisted and unreadable dates."""
    entries = xml.sitemap_entries(rows, since)
    listed = blacklist.select("url", F.lit(True).alias("_listed")).distinct()
    marked = entries.join(listed, "url", "left")
    return marked.agg(
        F.count_if(F.col("category").isNull()).alias("url"),
        F.count_if(F.col("_listed")).alias("blacklisted"),
        F.count_if(F.col("bad_lastmod")).alias("lastmod"),
    )


def catalogue_batch(
    kind: str,
    posts: DataFrame,
    pages: DataFrame | None = None,
    existing: DataFrame | None = None,
    since: Column | None = None,
    sitemap: DataFrame | None = None,
) -> DataFrame:
    """What a run delivers for a catalogue table, one record per URL: complete API posts before page records, coerced, without
    records that lack a URL. ``pages`` are extracted records, ``sitemap`` has ``url, lastmod, api_id``.

    All sides spell URLs alike. API pages overlap, so of the posts of a URL the last changed counts,
    then the greatest id. ``lastmod`` is the sitemap's where it lists the URL, else the page's, else the post's change time. With ``since`` the records of
    URLs in ``existing`` whose post has not changed are left out."""
    spelled = urls.normalize_url(F.col("url"), nfkc=True)
    mapped = api.map_posts(posts, kind).withColumn("url", spelled)
    newest = [F.coalesce("modified_gmt", F.lit("")), F.coalesce("api_id", F.lit(0))]
    fresh = mapped = latest_per_key(mapped, ["url"], newest)
    if since is not None:
        changed = modified_after(iso_timestamp(F.col("modified_gmt")), since, on_unparsed=True)
        fresh = mapped.filter(changed)
    from_api = fresh.withColumn("source", F.lit("api"))
    if pages is not None:
        pages = pages.withColumn("url", spelled)
        if "lastmod" not in pages.columns:
            pages = pages.withColumn("lastmod", F.lit(None).cast("string"))
        times = mapped.select("url", F.col("modified_gmt").alias("_changed"))
        pages = pages.join(times, "url", "left").withColumn("lastmod", F.coalesce("lastmod", "_changed")).drop("_changed")
        if since is not None and existing is not None:
            stored = existing.select(urls.strip_slash(F.col("url")).alias("url"))
            pages = pages.join(mapped.filter(~changed).select("url").join(stored, "url", "left_semi"), "url", "left_anti")
        merged = joins.merge_sources(from_api.drop("lastmod"), pages)
        merged = merged.withColumn("lastmod", F.coalesce("lastmod", "modified_gmt"))
    else:
        merged = from_api.withColumn("lastmod", F.col("modified_gmt"))
    if sitemap is not None:
        listed = sitemap.withColumn("url", spelled).filter("url <> ''")
        listed = latest_per_key(listed.select("url", "lastmod", "api_id"), ["url"], [F.coalesce("lastmod", F.lit("")), F.coalesce("api_id", F.lit(0))])
        known = listed.select("url", F.col("lastmod").alias("_listed"), F.col("api_id").alias("_id"))
        found = F.coalesce("api_id", "_id", urls.post_id(F.col("url"), "sitemap")) if "api_id" in merged.columns else F.coalesce(F.col("_id"), urls.post_id(F.col("url"), "sitemap"))
        merged = merged.join(known, "url", "left").withColumns({"lastmod": F.coalesce("_listed", "lastmod"), "api_id": found}).drop("_listed", "_id")
    delivered = quality.coerce_records(merged)
    known = [f.name for f in schema_of(kind).fields if f.name in delivered.columns]
    checked = quality.require_fields(conform(delivered, schema_of(kind)), kind)
    return checked.select(*known)


def build_catalogue(
    kind: str,
    posts: DataFrame,
    pages: DataFrame,
    existing: DataFrame,
    scraped_at: Column,
    since: Column | None = None,
    sitemap: DataFrame | None = None,
) -> DataFrame:
    """The next version of a catalogue table: what ``catalogue_batch`` delivers, upserted with change tracking.
    Stored columns that the batch does not deliver keep their values."""
    batch = catalogue_batch(kind, posts, pages, existing, since, sitemap).withColumn("pos", F.lit(0))
    return upsert.upsert(existing, batch, scraped_at)


def build_series(
    shows: DataFrame, episodes: DataFrame, stored_shows: DataFrame, stored_episodes: DataFrame, scraped_at: Column
) -> tuple[DataFrame, DataFrame]:
    """The next versions of the show and episode tables from a batch of either (``catalogue_batch``): both upserted, a stub
    for every show that only its episodes name, and each show's ``episode_count`` from the episode table."""
    spelled = {"show_url": urls.strip_slash(F.col("show_url"))}

    def batch(df: DataFrame) -> DataFrame:
        times = {} if "lastmod" in df.columns else {"lastmod": F.lit(None).cast("string")}
        return df.withColumns(times | {"pos": F.lit(0)})

    children = upsert.upsert(stored_episodes, batch(episodes.withColumns(spelled)), scraped_at)
    parents = upsert.upsert(stored_shows, batch(shows), scraped_at)
    named = children.withColumns(spelled)
    parents = joins.add_missing_parents(named, parents, "show_url")
    return upsert.episode_counts(parents, named).select(*stored_shows.columns), children


def feed_round(
    items: DataFrame, state: DataFrame, failed_ids: DataFrame, processed_ids: DataFrame, posts: DataFrame, kind: str
) -> tuple[DataFrame, DataFrame]:
    """The records behind the unseen items of a poll, and the feed state after it."""
    fresh = feeds.since_marker(items, state)
    found = feeds.with_item_ids(fresh, failed_ids).withColumn("content_type", F.lit(kind))
    todo = frontier.unprocessed_feed_items(found, processed_ids, [kind])
    records = api.map_posts(joins.select_ids(posts, todo), kind)
    return records, feeds.next_markers(fresh, state)
