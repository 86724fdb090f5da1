"""Sinks: nested and title-keyed documents, parsed URLs, state tables and
notifications. Every sink writes a new folder; readers switch to it once it is complete."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from playbill.operators.nesting import BLOCKS, frontend_episodes, keyed_by_title, nest_seasons, title_map


def _write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, packed at the least effort, as links repeat in them."""
    df.write.option("zlib.compress.level", "BEST_SPEED").json(path, compression="gzip")


def _observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counts that its writing task takes on the way, so that nothing is computed a second time for them. To be called on
    the frame that is written: there each row is seen once, also if executors are lost."""
    seen = Observation(f"written-{uuid.uuid4().hex}")
    return df.observe(seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()]), seen


def export_catalogue(
    movies: DataFrame, shows: DataFrame, episodes: DataFrame, path: str, exported_at: Column, blocks: int = BLOCKS, most: int | None = None
) -> None:
    """The export as packed JSON lines: ``movies``, ``shows`` with nested seasons, ``episodes``, and one
    ``metadata`` row with the counts, taken while writing. Shows come in ``blocks``, or with ``most`` only those with more episodes than that."""
    parts = {
        "movies": (movies, F.count(F.lit(1))),
        "shows": (nest_seasons(shows, episodes, blocks, most), F.count_if("lead")),
        "episodes": (episodes, F.count(F.lit(1))),
    }
    counts = []
    for name, (df, n) in parts.items():
        df, seen = _observed(df, n=n)
        _write_lines(df, f"{path}/{name}")
        counts.append(F.lit(seen.get["n"]).cast("bigint").alias(f"{name}_count"))
    movies.sparkSession.range(1).select(exported_at.alias("exported_at"), *counts).write.json(f"{path}/metadata")


def export_frontend(movies: DataFrame, nested_shows: DataFrame, episodes: DataFrame, path: str, pos: str) -> None:
    """The title-keyed layout as packed JSON lines, each a map of one title. The blocks of a show are lines of their own."""
    _write_lines(title_map(keyed_by_title(movies, pos)), f"{path}/movies")
    _write_lines(title_map(keyed_by_title(frontend_episodes(nested_shows), pos, blocks=True)), f"{path}/tv_shows")
    _write_lines(episodes, f"{path}/episodes")


def save_parsed_urls(parsed: DataFrame, previous: DataFrame | None, path: str, run_at: Column, files: int = 32) -> None:
    """Parsed URLs partitioned for pruning, and one metadata row: totals, counts per category,
    and the time of the last full scan, which moves only when nothing was modified.

    Rows are clustered by the folder they go to, each folder in at most ``files`` files; all counts are taken while writing."""
    whole = ~F.col("is_modified")
    kinds = ("movies", "shows", "episodes")
    counts = {"total": F.count_if(whole), "modified": F.count_if("is_modified")}
    counts |= {k: F.count_if((F.col("category") == k) & whole) for k in kinds}
    place = F.pmod(F.xxhash64("url"), F.lit(files))
    rows, seen = _observed(parsed.repartition("category", "is_modified", place), **counts)
    rows.write.partitionBy("category", "is_modified").parquet(f"{path}/urls")
    n = {k: F.lit(v).cast("bigint") for k, v in seen.get.items()}
    last = F.lit(None).cast("string") if previous is None else previous.agg(F.max("last_full_scan")).scalar()
    parsed.sparkSession.range(1).select(
        run_at.alias("generated_at"),
        n["total"].alias("total_count"),
        n["modified"].alias("modified_count"),
        F.when(n["modified"] == 0, run_at).otherwise(F.coalesce(last, run_at)).alias("last_full_scan"),
        *[n[k].alias(f"{k}_count") for k in kinds],
    ).write.parquet(f"{path}/metadata")


def write_state(path: str, **tables: DataFrame) -> None:
    """State tables, one folder each. An emptied table is written as an empty one."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def read_state(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def notify(content: DataFrame, path: str, sent_at: Column) -> None:
    """New content as JSON lines and its summary per type. Repeating a write replaces it."""
    content.withColumn("timestamp", sent_at).write.mode("overwrite").json(f"{path}/content")
    summary = content.groupBy("content_type").agg(F.count("*").alias("n")).withColumn("timestamp", sent_at)
    summary.write.mode("overwrite").json(f"{path}/summary")
