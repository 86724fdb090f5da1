"""Change-tracked upserts and flag maintenance. Tables are versions: every function returns
the next version, and the sink writes it beside the one being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.operators.grouping import keep_last
from playbill.operators.joins import prefix_pairs


def upsert(existing: DataFrame, incoming: DataFrame, scraped_at: Column, pos: str = "pos") -> DataFrame:
    """Merge a batch into a table by ``url``.

    A record is new when its URL is unseen or its lastmod differs, nulls included; otherwise the
    stored flag stays. Columns of the batch overwrite, other columns keep their stored value.
    The last arrival of a URL wins; rows without a URL are left out. A column that the table
    lacks is an error, not a loss.
    """
    if unknown := sorted(set(incoming.columns) - set(existing.columns) - {pos}):
        raise ValueError(f"columns that the table lacks: {', '.join(unknown)}")
    batch = incoming.withColumn("url", urls.strip_slash(F.col("url"))).filter(F.col("url") != "")
    batch = keep_last(batch, ["url"], pos).drop(pos)
    stored = existing.withColumn("url", urls.strip_slash(F.col("url")))
    old, new = stored.withColumn("_old", F.lit(True)).alias("o"), batch.withColumn("_new", F.lit(True)).alias("n")
    both = old.join(new, "url", "full_outer")
    touched, seen = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    same = F.col("o.lastmod").eqNullSafe(F.col("n.lastmod"))
    flag = F.when(touched & ~(seen & same), 1).otherwise(F.col("o.is_new"))
    cols = [F.col("url")]
    for name in existing.columns:
        if name == "url":
            continue
        if name == "is_new":
            c = flag
        elif name == "last_scraped":
            c = F.when(touched, scraped_at).otherwise(F.col("o.last_scraped"))
        elif name in batch.columns:
            c = F.when(touched, F.col(f"n.`{name}`")).otherwise(F.col(f"o.`{name}`"))
        else:
            c = F.col(f"o.`{name}`")
        cols.append(c.alias(name))
    return both.select(*cols)


def episode_counts(shows: DataFrame, episodes: DataFrame, by_prefix: bool = False) -> DataFrame:
    """Shows with ``episode_count`` taken from the episode table. With ``by_prefix`` a show that no episode names counts those
    whose show URL starts with its own."""
    n = episodes.groupBy(urls.strip_slash(F.col("show_url")).alias("_show")).agg(
        F.count("*").cast("int").alias("_n")
    )
    if by_prefix:
        loose = shows.select(urls.strip_slash(F.col("url")).alias("_key")).filter("_key <> ''")
        loose = loose.join(n, F.col("_key") == F.col("_show"), "left_anti")
        pairs = prefix_pairs(loose, n.select("_show"))
        started = pairs.join(n, F.col("_full") == F.col("_show")).groupBy("_probe").agg(F.sum("_n").cast("int").alias("_n"))
        n = n.unionAll(started.select(F.col("_probe").alias("_show"), "_n"))
    rows = shows.withColumn("_key", urls.strip_slash(F.col("url"))).drop("episode_count")
    rows = rows.join(n, F.col("_key") == F.col("_show"), "left")
    return rows.withColumn("episode_count", F.coalesce(F.col("_n"), F.lit(0))).drop("_n", "_key", "_show")


def set_flag(df: DataFrame, ids: DataFrame, flag: str, value: int, on: str = "url") -> DataFrame:
    """Set an integer flag on the listed rows. Nothing happens if the column is absent."""
    if flag not in df.columns:
        return df
    marked = ids.select(on).distinct().withColumn("_hit", F.lit(True))
    changed = F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(flag))
    return df.join(marked, on, "left").withColumn(flag, changed).select(*df.columns)


def mark_processed(df: DataFrame, ids: DataFrame, on: str = "url") -> DataFrame:
    return set_flag(df, ids, "is_new", 0, on)


def mark_modified(df: DataFrame, ids: DataFrame, modified: bool = True, on: str = "url") -> DataFrame:
    return set_flag(df, ids, "is_modified", int(modified), on)


def flagged(df: DataFrame, flag: str, limit: int | None = None, order: str = "url") -> DataFrame:
    """Rows with a flag set; with a limit, the first of them by ``order``."""
    rows = df.filter(F.col(flag) == 1)
    return rows.orderBy(order).limit(limit) if limit else rows
