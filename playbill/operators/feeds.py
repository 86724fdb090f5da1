"""Feed items since a marker, changed sites, and page snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.functions.dates import iso_timestamp
from playbill.session import computed


def since_marker(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items ``(feed, pos, guid, ...)`` listed before the feed's ``last_guid``; all of them when
    the marker is unset or not listed. Feeds list the newest item first."""
    marked = state.filter(F.coalesce("last_guid", F.lit("")) != "").select(
        "feed", F.col("last_guid").alias("guid")
    )
    # One cut per feed: at most one row per feed reaches the second join.
    cuts = items.select("feed", "guid", "pos").join(marked, ["feed", "guid"], "left_semi")
    cuts = cuts.groupBy("feed").agg(F.min("pos").alias("_cut"))
    rows = items.join(cuts, "feed", "left")
    return rows.filter(F.col("_cut").isNull() | (F.col("pos") < F.col("_cut"))).drop("_cut")


def next_markers(new_items: DataFrame, state: DataFrame) -> DataFrame:
    """State after a poll: the first new item's guid, else the old marker. A feed that the state
    does not know yet gets its first marker."""
    first = new_items.groupBy("feed").agg(F.min_by("guid", "pos").alias("_guid"))
    rows = state.join(first, "feed", "full_outer")
    return rows.withColumn("last_guid", F.coalesce("_guid", "last_guid")).drop("_guid")


def with_item_ids(items: DataFrame, failed_ids: DataFrame) -> DataFrame:
    """Items with their post id; items without one and known failing ids go."""
    rows = computed(items, {"id": urls.feed_item_id(F.col("guid"), F.col("link"))})
    return rows.filter(F.col("id").isNotNull()).join(failed_ids.select("id"), "id", "left_anti")


def changed_sites(built: DataFrame, checks: DataFrame) -> DataFrame:
    """Sites built after their last check; unknown times count as changed."""
    # A site may be listed with several checks.
    last = checks.groupBy("site").agg(F.max("last_check").alias("last_check"))
    rows = built.join(last, "site", "left")
    return rows.filter(F.coalesce(F.col("built") > F.col("last_check"), F.lit(True)))


def snapshot_decision(
    frontier: DataFrame, snapshots: DataFrame, modified_after: Column | None = None, force: bool = False
) -> DataFrame:
    """Whether the stored page of each URL can be used or must be fetched again."""
    rows = frontier.join(snapshots.select("url", "fetched_at"), "url", "left")
    changed = iso_timestamp(F.col("lastmod"))
    have = F.col("fetched_at").isNotNull()
    newer = F.lit(False) if modified_after is None else F.col("fetched_at") > modified_after
    decision = (
        F.when(~have | F.lit(force), "refetch")
        .when(newer, "use")
        .when(changed.isNull() | (F.col("fetched_at") >= changed), "use")
        .otherwise("refetch")
    )
    return rows.withColumn("decision", decision)


def live_snapshots(
    snapshots: DataFrame, cutoff: Column | None = None, content_type: str | None = None
) -> DataFrame:
    """Snapshots that stay after clearing a type and everything fetched before ``cutoff``."""
    cleared = F.lit(True)
    if content_type is not None:
        cleared = cleared & (F.col("content_type") == content_type)
    if cutoff is not None:
        cleared = cleared & (F.col("fetched_at") < cutoff)
    return snapshots.filter(~F.coalesce(cleared, F.lit(False)))
