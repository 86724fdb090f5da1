"""Incremental feed stream: every landed item once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playbill.functions import urls
from playbill.operators.flows import catalogue_batch
from playbill.operators.joins import select_ids
from playbill.session import computed, written
from playbill.sources.versioned import Version, VersionedTable
from playbill.sources.xml import feed_items


def landed_feeds(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Items of feed files as they land; the feed is named by its folder ``feed=<name>``."""
    docs = (
        spark.readStream.format("text")
        .schema("value string, feed string")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    items = feed_items(docs.select("feed", F.col("value").alias("xml")))
    items = computed(items, {"id": urls.feed_item_id(F.col("guid"), F.col("link"))})
    return items.filter(F.col("id").isNotNull())


def unseen_items(items: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """Items whose key has not been seen. With ``event_time`` keys are forgotten ``delay`` after
    they were first seen, else never. Without it repeats within a batch go before the shuffle; with
    it a repeat may be the one row of its key that is not late, so all rows go to the state."""
    if event_time is not None:
        return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop_duplicates(keys)

    return items.mapInPandas(once, items.schema).dropDuplicates(keys)


def commit_items(
    items: DataFrame, posts: DataFrame, kind: str, table: VersionedTable, scraped_at: Column, commit: tuple[str, int]
) -> Version:
    """The posts behind a batch of feed items, upserted as batch ``commit`` of their stream. A batch that the table
    has already leaves it as it is, so one that failed half-way or is run again does no harm."""
    now = table.version()
    if now.has(commit):
        return now
    wanted = written(items.select("id").distinct(), "items")
    batch = catalogue_batch(kind, select_ids(posts, wanted))
    return table.upsert(batch.withColumn("pos", F.lit(0)), scraped_at, commit=commit, now=now)


def feed_catalogue(
    items: DataFrame, posts: DataFrame, kind: str, table: VersionedTable, scraped_at: Column, checkpoint: str, stream: str
) -> StreamingQuery:
    """Keep a catalogue table up to date from a stream of feed items ``(feed, id, ...)``: each item once, its post
    mapped and upserted, batch by batch, under the name ``stream``. Runs over what has landed and ends.

    The stream's checkpoint remembers the items seen, the table's manifest the batches written. A restart from the same
    checkpoint repeats at most the batch that was not confirmed, and the manifest tells whether it arrived."""

    def one_batch(df: DataFrame, batch_id: int) -> None:
        commit_items(df, posts, kind, table, scraped_at, (stream, batch_id))

    new = unseen_items(items, ["feed", "id"])
    return new.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
