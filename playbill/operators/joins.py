"""Joins between catalogue tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.session import written


def shows_with_episodes(shows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every show with its episodes, matched without trailing slashes. Episode columns that
    share a name with a show column get an ``episode_`` prefix.

    The left join is written as an inner join plus the shows without episodes: an inner join can
    be split at a show that holds many of the episodes, and can broadcast a small show table.
    """
    same = set(shows.columns)
    shows = shows.withColumn("_key", urls.strip_slash(F.col("url")))
    eps = episodes.select(
        urls.strip_slash(F.col("show_url")).alias("_key"),
        *[F.col(c).alias(f"episode_{c}" if c in same else c) for c in episodes.columns],
    )
    matched = shows.join(eps, "_key")
    lonely = shows.join(eps.select("_key").distinct(), "_key", "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True).drop("_key")


def prefix_lookup(probe: DataFrame, keyed: DataFrame, key: str, ignore_case: bool = False) -> DataFrame:
    """``probe`` rows (column ``key``) with the ``keyed`` rows that equal it or, where none does,
    start with it. The prefix is literal, unlike a LIKE pattern.

    Equal ones meet in an equi-join. For the others ``prefix_pairs`` finds which texts start with which probe in one pass over both
    in order, and two equi-joins bring the rows back.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    probe = probe.withColumn("_probe", fold(F.col(key)))
    keyed = keyed.withColumnRenamed(key, "matched").withColumn("_full", fold(F.col("matched")))
    exact = probe.join(keyed, F.col("_probe") == F.col("_full")).withColumn("match", F.lit("exact"))
    loose = probe.join(keyed.select("_full"), F.col("_probe") == F.col("_full"), "left_anti")
    pairs = prefix_pairs(loose.select("_probe"), keyed.select("_full"))
    started = loose.join(pairs, "_probe").join(keyed, "_full").withColumn("match", F.lit("prefix"))
    return exact.unionByName(started).drop("_probe", "_full")


def prefix_pairs(probes: DataFrame, texts: DataFrame) -> DataFrame:
    """Each different text of ``texts`` with each different one of ``probes`` that it starts with: ``_full``, ``_probe``. Both
    tables have one text column; nulls match nothing.

    Both are put in order together, in ranges. In order a text comes after its prefixes, and whatever starts with a probe follows it
    directly; so one pass over a range finds all pairs with the probes that are still open. The probes
    that are open where a range begins are those that its first text starts with; they come from an equi-join of the prefixes of
    these few texts and are handed to the range in front of its rows. What is shuffled is in proportion to the
    different texts; only the pairs found are more.
    """
    spark = probes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = probes.toDF("text").select("text", F.lit(True).alias("probe"), F.lit(False).alias("full")).unionAll(
        texts.toDF("text").select("text", F.lit(False), F.lit(True))
    )
    every = marked.filter("text is not null").groupBy("text").agg(F.bool_or("probe").alias("probe"), F.bool_or("full").alias("full"))
    # Written, so that a lost task cannot cut the ranges otherwise.
    ranges = written(every.repartitionByRange(parts, "text").withColumn("part", F.spark_partition_id()), "ranges")
    # A row for each range, and of it a row for each shorter prefix of its first text.
    firsts = ranges.groupBy("part").agg(F.min("text").alias("first")).filter("first <> ''")
    prefix = firsts.select("part", F.explode(F.expr("transform(sequence(0, length(first) - 1), n -> left(first, n))")).alias("text"))
    opened = prefix.join(ranges.filter("probe").select("text"), "text").select("part", "text", F.lit(True).alias("probe"), F.lit(False).alias("full"))
    rows = ranges.select("part", "text", "probe", "full").unionByName(opened)
    ordered = rows.repartition(parts, "part").sortWithinPartitions("part", "text")
    return ordered.mapInArrow(_open_prefixes, "_full string, _probe string")


def _open_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs from rows in order: a stack holds the probes that the last text starts with, each a prefix of the next."""
    now, stack = None, []
    for batch in batches:
        full, found = [], []
        for part, text, probe, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                now, stack = part, []
            while stack and not text.startswith(stack[-1]):
                stack.pop()
            if probe:
                stack.append(text)
            if wanted:
                full += [text] * len(stack)
                found += stack
            if len(full) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.string()), pa.array(found, pa.string())], names=["_full", "_probe"])
                full, found = [], []
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.string()), pa.array(found, pa.string())], names=["_full", "_probe"])


def merge_sources(api: DataFrame, html: DataFrame, defaults: dict | None = None) -> DataFrame:
    """One record per URL from the API where it has one, else from the page. Non-null API values
    win field by field; an empty ``video_files`` list counts as missing. Both sides must be
    unique by URL."""
    both = html.alias("h").join(api.alias("a"), "url", "full_outer")
    cols = [F.col("url")]
    for name in dict.fromkeys([*api.columns, *html.columns]):
        if name == "url":
            continue
        sides = [F.col(f"{s}.`{name}`") for s, df in (("a", api), ("h", html)) if name in df.columns]
        if name == "video_files":
            sides = [F.when(F.size(c) > 0, c) for c in sides]
        if defaults and name in defaults:
            sides.append(defaults[name])
        cols.append(F.coalesce(*sides).alias(name))
    return both.select(*cols)


def add_missing_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Parents plus a URL-only stub for every child whose parent is absent."""
    wanted = children.select(F.col(key).alias("url")).filter(F.col("url") != "").distinct()
    stubs = wanted.join(parents.select("url"), "url", "left_anti")
    return parents.unionByName(stubs, allowMissingColumns=True)


def select_ids(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts whose id was asked for."""
    return posts.join(ids.select("id"), "id", "left_semi")


def children_of(episodes: DataFrame, parents: DataFrame, number_order: bool = True) -> DataFrame:
    """Episodes of the given shows, ordered by season and number.

    URLs begin alike, so sorting for a merge join compares them nearly whole: the shows of a partition, each once, go into a hash
    table instead. Where an order is asked for, the episodes found are written first: cutting the order into ranges reads
    them, and would join a second time.
    """
    keyed = parents.select(urls.strip_slash(F.col("url")).alias("_show"))
    rows = episodes.join(keyed.hint("shuffle_hash"), urls.strip_slash(F.col("show_url")) == F.col("_show"), "left_semi")
    if not number_order:
        return rows
    return written(rows, "children").orderBy("show_url", "season_number", "episode_number", "url")
