"""Queries against their oracles on tables of which a third of the rows share one key."""

import glob
import os
import shutil

import pytest
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    import duckdb

    out, con = str(tmp_path_factory.mktemp("skewed")), duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        shutil.copy(path, out)
    con.execute(
        f"""COPY (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id,
          CASE WHEN event_id % 3 = 0 THEN 'error' ELSE event_type END AS event_type, value, props FROM '{SF}/events.parquet' ORDER BY event_id)
        TO '{out}/events.parquet' (FORMAT parquet)"""
    )
    con.execute(
        f"""COPY (SELECT CASE WHEN l_partkey % 3 = 0 THEN 77 ELSE l_orderkey END AS l_orderkey, * EXCLUDE (l_orderkey) FROM '{SF}/lineitem.parquet')
        TO '{out}/lineitem.parquet' (FORMAT parquet)"""
    )
    assert os.path.getsize(f"{out}/lineitem.parquet") > 0
    return out


@pytest.mark.parametrize(
    "name",
    ["keep_latest", "cap_per_category", "blacklist_crossing", "problem_ranking", "feed_new_since_marker", "show_episode_join", "nest_seasons",
     "episode_urls", "upsert_change_flags", "frontier_pending", "unprocessed_content", "stream_error_tracker"],
)
def test_skewed(spark, skewed, name):
    rows, problem = compare(spark, connect(skewed), skewed, name)
    assert problem is None and rows > 0
