"""Queries against their oracles where pages come twice, and results that must not be cut into blocks."""

import glob
import os
import shutil

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def doubled(tmp_path_factory):
    import duckdb

    out = str(tmp_path_factory.mktemp("doubled"))
    for path in glob.glob(f"{SF}/*.parquet"):
        shutil.copy(path, out)
    again = f"SELECT page_id + 100000 AS page_id, url, html || '<p>again' AS html FROM '{SF}/pages.parquet'"
    duckdb.connect().execute(f"COPY (SELECT page_id, url, html FROM '{SF}/pages.parquet' UNION ALL {again}) TO '{out}/pages.parquet' (FORMAT parquet)")
    assert os.path.getsize(f"{out}/pages.parquet") > 0
    return out


@pytest.mark.parametrize("name", ["changed_sites", "snapshot_decode"])
def test_pages_of_one_url(spark, doubled, name):
    rows, problem = compare(spark, connect(doubled), doubled, name)
    assert problem is None and rows > 0


@pytest.mark.parametrize(("name", "key"), [("episode_urls", "show_url"), ("frontend_episodes", "url")])
def test_one_row_for_a_show(spark, name, key):
    rows = entry.queries()[name](spark, SF)
    assert rows.count() == rows.select(key).distinct().count() > 0


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """A show of 45,000 episodes beside the others, some of them twice."""
    import duckdb

    out = str(tmp_path_factory.mktemp("crowded"))
    for path in glob.glob(f"{SF}/*.parquet"):
        shutil.copy(path, out)
    items = f"'{SF}/lineitem.parquet'"
    more = f"SELECT i.* REPLACE (7 AS l_orderkey, n + i.l_suppkey AS l_suppkey) FROM (SELECT * FROM {items} LIMIT 1) i, range(45_000) r(n)"
    duckdb.connect().execute(f"COPY (SELECT * FROM {items} UNION ALL {more} UNION ALL SELECT * FROM {items} LIMIT 45_100 OFFSET 5_900) TO '{out}/lineitem.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize(("name", "key", "urls"), [("episode_urls", "show_url", "episode_urls"), ("frontend_episodes", "url", "episodes")])
def test_large_shows_come_in_parts_of_bounded_size(spark, crowded, name, key, urls):
    rows, problem = compare(spark, connect(crowded), crowded, name)
    assert problem is None and rows > 0
    parts = [r[urls].split() for r in entry.queries()[name](spark, crowded).collect() if r[key].rstrip("/").endswith("/tvshows/7")]
    assert len(parts) > 1 and max(map(len, parts)) < 40_000
    assert len({u.split("/", 2)[2] if name == "frontend_episodes" else u for part in parts for u in part}) >= 45_000


def test_seasons_of_divided_shows_are_counted_whole(spark):
    from playbill.operators import nesting

    rows = [(f"https://x/e/{i}", "https://x/a/", i % 2, i) for i in range(50)] + [("https://x/e/b", "https://x/b", 1, 1)]
    eps = spark.createDataFrame(rows, "url string, show_url string, season_number int, episode_number int")
    eps = eps.selectExpr("*", "'t' as title", "'d' as air_date", "'' as thumbnail", "'' as lastmod", "cast(null as string) as video_files")
    shows = spark.createDataFrame([("https://x/a",), ("https://x/b",), ("https://x/c",)], "url string")
    docs = nesting.nest_seasons(shows, eps, most=20).collect()
    of_a = [d for d in docs if d.url == "https://x/a"]
    assert len(docs) == len(of_a) + 2 and 1 < len(of_a) <= 3 and sum(d.lead for d in of_a) == 1
    assert sorted(e.url for d in of_a for e in d.full_episodes) == sorted(r[0] for r in rows[:50])
    assert {s.episode_count for d in of_a for s in d.seasons} == {25}
    assert [(d.block, d.lead, [s.episode_count for s in d.seasons]) for d in docs if d.url != "https://x/a"] == [(0, True, [1]), (0, True, [])]
