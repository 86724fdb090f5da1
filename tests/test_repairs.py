"""Cases off the fixtures' path: slashes, ties, unknown columns and feeds, late repeats, listings that end inside a day."""

import pytest
from pyspark.sql import functions as F

from playbill.operators import feeds as markers
from playbill.operators import nesting, upsert
from playbill.streaming import errors, feeds


def test_upsert_spells_stored_urls_alike(spark):
    old = spark.createDataFrame([("https://x/a/", "m", 0, "kept")], "url string, lastmod string, is_new int, poster string")
    new = spark.createDataFrame([("https://x/a/", "m", 1)], "url string, lastmod string, pos int")
    got = upsert.upsert(old, new, F.lit("now")).collect()
    assert [tuple(r) for r in got] == [("https://x/a", "m", 0, "kept")]
    with pytest.raises(ValueError, match="extra"):
        upsert.upsert(old, new.withColumn("extra", F.lit(1)), F.lit("now"))


def test_first_marker_of_a_new_feed(spark):
    items = spark.createDataFrame([("f", 0, "g1"), ("f", 1, "g0")], "feed string, pos int, guid string")
    state = spark.createDataFrame([("e", "old")], "feed string, last_guid string")
    assert sorted(map(tuple, markers.next_markers(items, state).select("feed", "last_guid").collect())) == [("e", "old"), ("f", "g1")]


def test_one_winner_for_a_title(spark):
    rows = spark.createDataFrame([("T", "u1", 0, 1), ("T", "u2", 0, 1), ("T", "u2", 0, 2), ("", "u3", 0, 1)], "title_en string, url string, pos int, block int")
    got = nesting.keyed_by_title(rows, "pos", blocks=True).collect()
    assert sorted((r.key, r.value.url, r.value.block) for r in got) == [("T", "u2", 1), ("T", "u2", 2)]


def _streamed(spark, tmp_path, batches, schema, make, mode):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/0").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = []
    query = make(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, _: out.extend(df.collect())).start()
    query.processAllAvailable()
    query.stop()
    return out


def test_late_repeat_does_not_hide_an_item(spark, tmp_path):
    batches = [[("z", "2024-01-01 00:00:00")], [("y", "2024-04-10 00:00:00")], [("a", "2024-01-01 00:00:00"), ("a", "2024-04-11 00:00:00")]]
    got = _streamed(spark, tmp_path, batches, "id string, ts string", lambda s: feeds.unseen_items(s, ["id"], "ts", "7 days"), "append")
    assert "a" in {r.id for r in got}


def test_listed_again_on_the_day_a_listing_ends(spark, tmp_path):
    hours = ["2024-01-01 12:00:00"] * 3 + ["2024-01-08 09:00:00"] * 3 + ["2024-01-08 14:00:00"] * 3
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("u", "timeout", t, i) for i, t in enumerate(hours)]
    got = _streamed(spark, tmp_path, [rows], "url string, error_type string, ts string, event_id long", lambda s: errors.track_errors(s, base=3, expire=True), "update")
    last = max((r for r in got if r.n), key=lambda r: r.last_ts)
    assert last.blacklisted and str(last.last_ts).startswith("2024-01-08 14")


def test_errors_leave_with_the_watermark(spark, tmp_path):
    # The warning's three days are over when another error of its URL comes, but not yet by the watermark, an hour behind.
    first = [("https://x/a", "warning", "2024-01-01 00:00:00", 0), ("https://x/a", "http_500", "2024-01-04 00:30:00", 1)]
    later = [("https://x/b", "http_500", "2024-01-04 03:00:00", 2)]
    layout = "url string, error_type string, ts string, event_id long"
    got = [
        _streamed(spark, tmp_path / str(n), batches, layout, lambda df: errors.track_errors(df, base=10, expire=True), "update")
        for n, batches in enumerate(([first], [first, later]))
    ]
    gone = [[r.url for r in rows if r.error_type == "warning" and r.n == 0] for rows in got]
    assert gone == [[], ["https://x/a"]]
