"""Tables in versions, state kept in versions, page files and the sinks that count while they write."""

import glob
import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from test_operators import episodes_of, rows

from playbill.operators import nesting, upsert
from playbill.session import fresh_path
from playbill.sources import landed, sinks
from playbill.sources.versioned import VersionedTable

LAYOUT = "url string, lastmod string, is_new int, last_scraped string, note string"


def batch(spark, *values):
    return spark.createDataFrame([(*v, i) for i, v in enumerate(values)], "url string, lastmod string, note string, pos int")


@pytest.fixture
def table(spark):
    return VersionedTable.create(spark, fresh_path(spark, "table"), LAYOUT, buckets=32)


def test_batches_equal_the_plain_upsert(spark, table):
    plain = spark.createDataFrame([], LAYOUT)
    for n in range(4):
        some = batch(spark, *[(f"https://x/{(i * 7 + n * 13) % 200}/", str((i + n) % 3), f"n{n}") for i in range(60)])
        table.upsert(some, F.lit(f"t{n}"))
        plain = upsert.upsert(plain, some, F.lit(f"t{n}"))
    assert rows(table.read()) == rows(plain)
    assert table.count() == plain.count() and table.version().number == 4


def test_only_touched_buckets_are_read_and_written(spark, table):
    table.upsert(batch(spark, *[(f"https://x/{i}", "a", "first") for i in range(500)]), F.lit("t0"))
    before, read = table.version(), []
    keys = batch(spark, ("https://x/3", "b", "second"), ("https://x/new", "b", "second"))

    def change(old):
        read.append(old)
        return upsert.upsert(old, keys, F.lit("t1"))

    after = table.rewrite(keys, change)
    touched = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert 1 <= len(touched) <= 2 and len(before.folders) == 32
    # The plan scans the files of these buckets and no others.
    assert {f.split("/bucket=")[1].split("/")[0] for f in read[0].inputFiles()} == {str(b) for b in touched}
    got = {r.url: (r.lastmod, r.is_new, r.note) for r in table.read().collect()}
    assert got["https://x/3"] == ("b", 1, "second") and got["https://x/new"] == ("b", 1, "second") and len(got) == 501
    # Who reads the version before still can.
    assert {r.lastmod for r in table.read(before.number).collect()} == {"a"}


def test_a_repeated_batch_changes_nothing(spark, table):
    some = batch(spark, ("https://x/1", "a", "n"))
    table.upsert(some, F.lit("t0"), commit=("feed", 0))
    table.upsert(batch(spark, ("https://x/2", "a", "n")), F.lit("t1"), commit=("feed", 1))
    same = table.upsert(some, F.lit("t9"), commit=("feed", 0))
    assert same.number == 2 and {r.last_scraped for r in table.read().collect()} == {"t0", "t1"}
    # Another stream counts its own batches; an empty batch is noted too.
    assert table.upsert(some, F.lit("t9"), commit=("other", 0)).commits == {"feed": 1, "other": 0}
    assert table.upsert(some.limit(0), F.lit("t9"), commit=("other", 1)).commits["other"] == 1


def test_a_failed_write_leaves_the_version_as_it_is(spark, table):
    table.upsert(batch(spark, ("https://x/1", "a", "n")), F.lit("t0"))
    with pytest.raises(Exception, match="lost"):
        table.rewrite(batch(spark, ("https://x/1", "b", "n")), lambda old: old.withColumn("note", F.raise_error(F.lit("lost"))))
    assert [r.lastmod for r in table.read().collect()] == ["a"] and table.version().number == 1
    # Of two writers that begin at one version the second fails.
    with pytest.raises(Exception, match="(?i)exist"):
        table._name(table.version())


def test_marks_spelling_and_old_versions(spark, table):
    table.upsert(batch(spark, ("https://x/\ufb01lm/", "a", "n"), ("https://x/2", "a", "n"), ("", "a", "n"), (None, "a", "n")), F.lit("t0"))
    table.upsert(batch(spark, ("https://x/film", "a", "again")), F.lit("t1"))
    table.mark(spark.createDataFrame([("https://x/film/",)], "url string"), "is_new", 0)
    assert rows(table.read().select("url", "is_new", "note")) == [("https://x/2", 1, "n"), ("https://x/film", 0, "again")]
    gone = table.forget(keep=1)
    assert gone and rows(table.read().select("url")) == [("https://x/2",), ("https://x/film",)]
    with pytest.raises(ValueError, match="no version"):
        table.read(1)
    assert table.read(buckets=[]).count() == 0


def state(spark, *versions):
    path = fresh_path(spark, "state")
    for n, lines in enumerate(versions):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/version={n}")
    return landed.read_versions(spark, path, "id bigint, at string")


def test_a_damaged_version_falls_back(spark):
    whole, newer = '{"id": 1, "at": "x"}', '{"id": 2, "at": "y"}'
    found = state(spark, [whole], [newer], [newer, '{"id": 3'], ['{"id": 4}'])
    good, bad = landed.newest_valid(found, ["id", "at"])
    assert rows(good.select("version", "id", "at")) == [(1, 2, "y")]
    assert rows(bad.select("version", "reason")) == [(2, "unreadable"), (3, "missing at")]
    good, bad = landed.newest_valid(state(spark, [whole], [newer]), ["id", "at"])
    assert rows(good.select("id")) == [(2,)] and bad.count() == 0
    good, bad = landed.newest_valid(state(spark, ["broken"], ["{}"]), ["id"])
    assert good.count() == 0 and bad.count() == 2


def test_the_scan_of_page_files_is_pruned(spark):
    path = fresh_path(spark, "cache")
    pages = [("movies", "a.html", "é ü".encode()), ("movies", "b.html", "é".encode("latin-1")), ("shows", "c.html", b""), ("ep/1", "d.html", b"x"), ("shows", "e.html", None)]
    told = landed.write_snapshots(spark.createDataFrame(pages, "content_type string, file string, content binary"), path)
    assert rows(told.select("file", "bytes")) == [("a.html", 5), ("b.html", 1), ("c.html", 0), ("d.html", 1)]
    every = landed.read_snapshots(spark, path)
    assert rows(every.select("content_type", "file", "html")) == [("ep/1", "d.html", "x"), ("movies", "a.html", "é ü"), ("movies", "b.html", "é")]
    some = landed.read_snapshots(spark, path, kinds=["movies"], since="2020-01-01")
    out = io.StringIO()
    with redirect_stdout(out):
        some.explain("formatted")
    assert re.search(r"PartitionFilters: \[.*content_type", out.getvalue()) and re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(modificationTime", out.getvalue())
    assert some.count() == 2 and landed.read_snapshots(spark, path, since="2999-01-01").count() == 0


def counting(spark, df):
    """``df`` and how often its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def same(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(same, df.schema), seen


def test_sinks_compute_their_input_once(spark):
    parsed = [(k, m, f"https://x/{k}/{i}", i) for k in ("movies", "shows", "episodes", "pages") for m in (True, False) for i in range(50 if m else 20)]
    df, seen = counting(spark, spark.createDataFrame(parsed, "category string, is_modified boolean, url string, pos int"))
    path = fresh_path(spark, "parsed")
    sinks.save_parsed_urls(df, None, path, F.lit("2024-01-01"), files=2)
    assert seen.value == len(parsed)
    assert spark.read.parquet(f"{path}/metadata").first().asDict() == {
        "generated_at": "2024-01-01", "total_count": 80, "modified_count": 200, "last_full_scan": "2024-01-01",
        "movies_count": 20, "shows_count": 20, "episodes_count": 20,
    }
    folder = spark.read.parquet(f"{path}/urls").where("category = 'movies' and is_modified")
    names = {r[0] for r in folder.select(F.input_file_name()).distinct().collect()}
    assert folder.count() == 50 and len(names) <= 2

    _, eps = episodes_of(spark, {"hot": 300, "a": 4})
    shows = spark.createDataFrame([("https://x/hot",), ("https://x/a/",), ("https://x/none",)], "url string")
    films, seen = counting(spark, spark.createDataFrame([("m1",), ("m2",)], "url string"))
    out = fresh_path(spark, "export")
    sinks.export_catalogue(films, shows, eps, out, F.lit("2024-01-01"), blocks=4)
    meta = spark.read.json(f"{out}/metadata").first()
    assert (meta.movies_count, meta.shows_count, meta.episodes_count) == (2, 3, 304) and seen.value == 2
    empty = fresh_path(spark, "parsed")
    sinks.save_parsed_urls(df.limit(0), None, empty, F.lit("2024-01-01"))
    assert spark.read.parquet(f"{empty}/metadata").first()["total_count"] == 0


def test_exports_are_packed_and_episodes_move_once(spark):
    _, eps = episodes_of(spark, {"hot": 300, "a": 4})
    shows = spark.createDataFrame([("https://x/hot", "Hot", 1), ("https://x/a/", "A", 2), ("https://x/a2", "A", 1)], "url string, title_en string, pos int")
    films, out, front = spark.createDataFrame([("m1", "M", 1)], "url string, title_en string, pos int"), fresh_path(spark, "export"), fresh_path(spark, "frontend")
    sinks.export_catalogue(films, shows, eps, out, F.lit("2024-01-01"), blocks=4)
    sinks.export_frontend(films, nesting.nest_seasons(nesting.last_of_title(shows, "pos"), eps), eps, front, "pos")
    names = [f for path in (out, front) for kind in ("shows", "episodes", "movies", "tv_shows") for f in glob.glob(f"{path}/{kind}/part-*")]
    assert names and all(f.endswith(".json.gz") for f in names)
    # Episodes move once: no exchange takes those that are collected already.
    told = io.StringIO()
    with redirect_stdout(told):
        nesting.nest_seasons(shows, eps).explain("formatted")
    moved = re.findall(r"Exchange\nInput \[\d+\]: (.*)", told.getvalue())
    assert moved and not any(re.search("_rows|_seasons|full_episodes", columns) for columns in moved)


def test_an_export_divides_only_large_shows(spark, tmp_path):
    rows_ = [(f"https://x/e/{i}", "https://x/a/", 1, i) for i in range(50)] + [(f"https://x/f/{i}", "https://x/b", 1, i) for i in range(9)]
    eps = spark.createDataFrame(rows_, "url string, show_url string, season_number int, episode_number int")
    eps = eps.selectExpr("*", "'t' as title", "'d' as air_date", "'' as thumbnail", "'' as lastmod", "cast(null as string) as video_files")
    shows_ = spark.createDataFrame([("https://x/a",), ("https://x/b",), ("https://x/c",)], "url string")
    sinks.export_catalogue(shows_.limit(1), shows_, eps, str(tmp_path / "out"), F.lit("now"), most=20)
    docs = spark.read.json(str(tmp_path / "out/shows")).select("url", F.size("full_episodes").alias("n")).collect()
    assert 1 < sum(d.url == "https://x/a" for d in docs) <= 3 and sum(d.n for d in docs if d.url == "https://x/a") == 50
    assert sorted((d.url, d.n) for d in docs if d.url != "https://x/a") == [("https://x/b", 9), ("https://x/c", 0)]
    assert spark.read.json(str(tmp_path / "out/metadata")).first().shows_count == 3
