"""The shape of the plans: what reaches the scan, what crosses a shuffle, what is never there."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from playbill.operators import grouping
from playbill.plans import roles
from playbill.session import configure, shared_dir

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def query_plan(spark, name):
    return plan(entry.queries()[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    text = query_plan(spark, "modified_window")
    assert "GreaterThan(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


@pytest.mark.parametrize("name", ["modified_since", "url_category", "validation_report", "quality_detect", "list_coercion"])
def test_row_wise_queries_do_not_aggregate_or_sort(spark, name):
    text = query_plan(spark, name)
    assert "hashpartitioning" not in text and "rangepartitioning" not in text


def test_latest_and_counts_combine_before_the_shuffle(spark):
    for name in ("keep_latest", "error_counts", "distinct_in_order"):
        assert "partial_" in query_plan(spark, name)


def test_group_limits_run_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("pos"))
    text = plan(grouping.first_n_per_group(df, ["k"], ["pos"], 10))
    assert ", 10, Partial" in text and ", 10, Final" in text
    assert "WindowGroupLimit" in query_plan(spark, "blacklist_crossing")


@pytest.mark.parametrize(
    "name",
    ["prefix_lookup", "show_episode_join", "upsert_change_flags", "unprocessed_content", "blacklist_crossing", "spider_frontier", "nest_seasons"],
)
def test_no_nested_loops(spark, name):
    text = query_plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_pages_are_parsed_once(spark):
    assert query_plan(spark, "extract_by_page_type").count("MapInArrow (") == 1
    assert query_plan(spark, "html_lists").count("MapInArrow (") == 1


def test_only_small_scans_are_spread(spark):
    assert "REPARTITION_BY_NUM" in plan(roles.source(spark, SF, "orders"))
    text = query_plan(spark, "modified_window")
    assert "Exchange" not in text


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert configure(spark).conf.get("spark.sql.session.timeZone") == "UTC"


def test_roles_keep_every_row(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    assert roles.shows(spark, SF).count() == orders
    assert roles.episodes(spark, SF).count() == lines
    assert roles.parsed_urls(spark, SF).count() == orders + lines + parts


def test_arrow_batches_are_small(spark):
    from playbill.session import OPTIONS

    # Texts and pages take several times their room in a Python worker.
    assert int(OPTIONS["spark.sql.execution.arrow.maxBytesPerBatch"]) <= 8 * 1024 * 1024
