"""Streams over several micro-batches equal their batch twins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_operators import failure_events, rows

from playbill.operators import errors as batch_errors
from playbill.plans import streams
from playbill.plans.streams import ROCKSDB, run_to_end
from playbill.session import fresh_path
from playbill.streaming import errors, feeds, notifications

LAYOUT = "url string, error_type string, ts timestamp, event_id long"


@pytest.fixture(scope="module")
def events(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    data = [e for e in failure_events(1500) if e[0]]
    df = spark.createDataFrame(data, "url string, error_type string, ts string, event_id long")
    return df.withColumn("ts", F.to_timestamp("ts"))


def in_files(spark, df, cuts):
    """The events as one file per time slice, landed in order."""
    path = fresh_path(spark, "landed")
    for low, high in zip(cuts, cuts[1:]):
        part = df.filter((F.col("event_id") >= low) & (F.col("event_id") < high))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def test_error_tracker_over_batches(spark, events):
    path = in_files(spark, events, [0, 200, 700, 1500])
    stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(path)
    out = run_to_end(errors.track_errors(stream), "tracked", "update")
    last = out.groupBy("url", "error_type").agg(F.max("n").alias("n"), F.max("last_ts").alias("last_ts"), F.bool_or("blacklisted").alias("b"))
    counted = batch_errors.counted_events(events)
    assert rows(last.drop("b")) == rows(batch_errors.tracked(counted).select("url", "error_type", "n", "last_ts"))
    assert rows(last.filter("b").select("url")) == rows(batch_errors.blacklist(counted).select("url"))


def test_expired_errors_release_their_url(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def at(days):
        return dt.datetime(2024, 1, 1) + dt.timedelta(days=days)

    data = [("a", "api_404", at(0), 0), ("b", "api_404", at(0), 1), ("a", "odd", at(1), 2), ("z", "odd", at(40), 3), ("a", "api_404", at(41), 4), ("z", "odd", at(42), 5)]
    path = in_files(spark, spark.createDataFrame(data, LAYOUT), [0, 3, 4, 5, 6])
    stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(path)
    out = run_to_end(errors.track_errors(stream, expire=True), "expired", "update")
    got = out.orderBy("url", "last_ts", F.desc("n")).select("url", "error_type", "n", "blacklisted").collect()
    # a is counted afresh by a late event; b leaves when its time is up; a's second type was never counted.
    assert [tuple(r) for r in got if r.url != "z"] == [
        ("a", "api_404", 1, True),
        ("a", "api_404", 1, True),
        ("b", "api_404", 1, True),
        ("b", "api_404", 0, False),
    ]


def test_tracker_goes_on_from_its_saved_state(spark, events):
    """Stopped, some URLs cleared, started from the table with a new checkpoint: as if the cleared errors had never been."""
    path = in_files(spark, events, [0, 300, 600])
    first, second, third = (fresh_path(spark, "checkpoint") for _ in range(3))
    stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(path)
    run_to_end(errors.track_errors(stream), "tracked", "update", first)
    early = events.filter("event_id < 600")
    counted = batch_errors.counted_events(early)
    state = errors.saved_state(spark, first)
    assert rows(state.select("url", "error_type", "n", "last_ts")) == rows(batch_errors.tracked(counted).select("url", "error_type", "n", "last_ts"))
    assert rows(state.filter("blacklisted").select("url").distinct()) == rows(batch_errors.blacklist(counted).select("url"))
    gone = state.filter("blacklisted").select("url").distinct().orderBy("url").limit(2)
    stored = fresh_path(spark, "state")
    errors.clear(state, gone).write.parquet(stored)

    late = spark.readStream.schema(LAYOUT).parquet(in_files(spark, events, [600, 1500]))
    run_to_end(errors.track_errors(late, state=spark.read.schema(errors.STATE).parquet(stored)), "tracked", "update", second)
    kept = batch_errors.clean_events(events).join(gone.withColumn("cleared", F.lit(True)), "url", "left").filter("cleared is null or event_id >= 600").drop("cleared")
    counted = batch_errors.counted_events(kept)
    state = errors.saved_state(spark, second)
    assert rows(state.select("url", "error_type", "n", "last_ts")) == rows(batch_errors.tracked(counted).select("url", "error_type", "n", "last_ts"))
    assert rows(state.filter("blacklisted").select("url").distinct()) == rows(batch_errors.blacklist(counted).select("url"))
    # All of them cleared: a tracker that knows nothing.
    run_to_end(errors.track_errors(late, state=errors.clear(state)), "tracked", "update", third)
    counted = batch_errors.counted_events(events.filter("event_id >= 600"))
    assert rows(errors.saved_state(spark, third).select("url", "error_type", "n")) == rows(batch_errors.tracked(counted).select("url", "error_type", "n"))


def test_urls_of_one_slot_share_a_key_and_stay_apart(spark, events, monkeypatch):
    """A call into Python for each URL took milliseconds: without expiry URLs share keys, and each is still tracked by itself."""
    monkeypatch.setattr(errors, "SLOTS", 2)
    first, second, stored = (fresh_path(spark, "checkpoint") for _ in range(3))
    stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(in_files(spark, events, [0, 300, 600]))
    run_to_end(errors.track_errors(stream), "tracked", "update", first)
    kept = spark.read.format("statestore").option("path", first).option("stateVarName", "errors").load()
    assert kept.select("key").distinct().count() == 2
    errors.saved_state(spark, first).write.parquet(stored)
    late = spark.readStream.schema(LAYOUT).parquet(in_files(spark, events, [600, 1500]))
    run_to_end(errors.track_errors(late, state=spark.read.schema(errors.STATE).parquet(stored)), "tracked", "update", second)
    counted = batch_errors.counted_events(events)
    state = errors.saved_state(spark, second)
    assert rows(state.select("url", "error_type", "n", "last_ts")) == rows(batch_errors.tracked(counted).select("url", "error_type", "n", "last_ts"))
    assert rows(state.filter("blacklisted").select("url").distinct()) == rows(batch_errors.blacklist(counted).select("url"))


def test_a_row_clears_its_url(spark, events):
    # Two URLs are cleared at the times of other URLs' events.
    every = batch_errors.clean_events(events).orderBy("event_id").collect()
    one, two = sorted({r.url for r in every})[:2]
    at = [next(r for r in every if r.event_id >= n and r.url not in (one, two)) for n in (400, 700, 900)]
    listed = [(u, None, r.ts, r.event_id) for u, r in zip((one, two, one + "/"), at)] + [("nobody", None, at[0].ts, 5)]
    clears = spark.createDataFrame(listed, LAYOUT)
    both = events.withColumn("clear", F.lit(False)).unionByName(clears.withColumn("clear", F.lit(True)))
    path = in_files(spark, both, [0, 500, 1500])
    checkpoint = fresh_path(spark, "checkpoint")
    stream = spark.readStream.schema(LAYOUT + ", clear boolean").option("maxFilesPerTrigger", 1).parquet(path)
    run_to_end(errors.track_errors(stream), "cleared", "update", checkpoint)
    counted = batch_errors.counted_events(batch_errors.after_clears(events, clears))
    state = errors.saved_state(spark, checkpoint)
    assert rows(state.select("url", "error_type", "n")) == rows(batch_errors.tracked(counted).select("url", "error_type", "n"))


def test_feed_items_once(spark, tmp_path):
    def feed(*ids):
        items = "".join(f"<item><guid>https://h/?p={i}</guid><title>t{i}</title></item>" for i in ids)
        return f"<rss><channel>{items}<item><guid>none</guid></item></channel></rss>"

    for n, (name, ids) in enumerate([("a", (1, 2, 2)), ("a", (3, 2, 1)), ("b", (1,))]):
        folder = tmp_path / f"feed={name}"
        folder.mkdir(exist_ok=True)
        (folder / f"{n}.xml").write_text(feed(*ids))
    stream = feeds.landed_feeds(spark, str(tmp_path), files_per_trigger=1)
    out = run_to_end(feeds.unseen_items(stream, ["feed", "id"]), "items", "append")
    assert rows(out.select("feed", "id")) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_bounded_feed_memory(spark, events):
    path = in_files(spark, events, [0, 500, 1500])
    stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(path)
    out = run_to_end(feeds.unseen_items(stream, ["url", "error_type"], "ts", "60 days"), "bounded", "append")
    assert rows(out.select("url", "error_type")) == rows(events.select("url", "error_type").distinct())


def test_content_is_announced_once(spark, events):
    content = events.select(F.col("error_type").alias("content_type"), "url", "event_id")
    path = in_files(spark, content, [0, 400, 900, 1500])
    out = fresh_path(spark, "told")
    stream = spark.readStream.schema(content.schema).option("maxFilesPerTrigger", 1).parquet(path)
    handled = content.filter("content_type = 'odd'").select("content_type", "url")
    notifications.announce_new(stream, out, fresh_path(spark, "told-checkpoint"), handled).awaitTermination()
    told = spark.read.schema("content_type string, url string, batch long").parquet(f"{out}/content")
    assert told.select("batch").distinct().count() > 1
    want = rows(content.filter("content_type <> 'odd'").select("content_type", "url").distinct())
    assert rows(told.select("content_type", "url")) == want
    marked = spark.read.schema("content_type string, url string").parquet(f"{out}/processed")
    assert rows(marked.select("content_type", "url")) == want
    counts = spark.read.schema("content_type string, n long").parquet(f"{out}/summary")
    assert counts.agg(F.sum("n")).first()[0] == len(want)


def test_more_feed_items_make_more_files_not_larger_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FEED_ITEMS", 50)
    spark.range(2000).selectExpr("id as event_id", "id % 300 as user_id", "'view' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    path = str(tmp_path / "feeds")
    files = streams._land_feeds(spark, str(tmp_path), path, feeds_per_type=2)
    texts = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    assert sum(t.count("<item>") for t in texts) == 2000
    assert max(t.count("<item>") for t in texts) <= 100
    assert len(texts) <= 3 * files <= 3 * 14 + 3
