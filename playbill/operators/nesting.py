"""Nested documents: shows with seasons and episodes, and the flat forms made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.operators.grouping import block_of, keep_last

# Documents that a show's episodes are divided into at most.
BLOCKS = 16

# The episode fields of a season entry and the episode column each comes from.
_SEASON_FIELDS = [
    ("episode_number", "episode_number"),
    ("title", "title"),
    ("date", "air_date"),
    ("url", "url"),
    ("thumbnail", "thumbnail"),
    ("lastmod", "lastmod"),
    ("video_files", "video_files"),
]


def _season_entry(e: Column) -> Column:
    return F.struct(*[e[source].alias(name) for name, source in _SEASON_FIELDS])


def _by_season(rows: Column) -> Column:
    """Rows sorted by season as an array for each season: a cut wherever the season changes."""
    n = F.size(rows)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(rows, i)["_season"] != F.get(rows, i - 1)["_season"]))
    parts = urls.once(starts, lambda at: F.transform(at, lambda i, j: F.slice(rows, i + 1, F.coalesce(F.get(at, j + 1), n) - i)))
    return F.when(n > 0, parts)


def nest_seasons(shows: DataFrame, episodes: DataFrame, blocks: int = BLOCKS, most: int | None = None) -> DataFrame:
    """Shows with ``seasons`` and ``full_episodes``.

    Seasons ascend by number (a missing number is 0), their episodes by number and URL; a show
    without episodes keeps its stored seasons. A show comes as a document for each ``block`` that any of its episodes falls into by the hash of their
    URL, with those episodes and the full ``episode_count`` of their seasons; one of them is the ``lead``. With 1 block it is one document.
    The block of an episode does not depend on any count, so choose ``blocks`` so that the largest show's share fits a task.
    With ``most`` a show has as many blocks as it takes for about so many episodes each, mostly one; this is counted first.
    """
    eps = episodes.withColumn("_key", urls.strip_slash(F.col("show_url"))).filter(F.col("_key") != "")
    eps = eps.withColumn("_season", F.coalesce("season_number", F.lit(0)))
    out = shows.withColumn("_key", urls.strip_slash(F.col("url")))
    keys, count, lead = ["_key"], lambda s: F.size(s), F.lit(True)
    if most:
        parts = F.ceil(F.count("*") / most).cast("int")
        # A row for every ``most`` episodes at most.
        hot = eps.groupBy("_key").agg(parts.alias("_parts")).filter("_parts > 1")
        eps = eps.join(F.broadcast(hot), "_key", "left")
        eps = eps.withColumn("block", F.coalesce(F.when(F.col("_parts") > 1, block_of(F.col("url"), F.col("_parts"))), F.lit(0)))
    elif blocks > 1:
        eps = eps.withColumn("block", block_of(F.col("url"), blocks))
    if most or blocks > 1:
        # Three columns give the counts of whole seasons and the blocks of a show.
        totals = eps.filter("_parts > 1") if most else eps
        totals = totals.groupBy("_key", "_season").agg(F.count("*").cast("int").alias("_n"), F.collect_set("block").alias("_in"))
        totals = totals.groupBy("_key").agg(
            F.map_from_entries(F.collect_list(F.struct("_season", "_n"))).alias("_counts"),
            F.array_distinct(F.flatten(F.collect_list("_in"))).alias("_blocks"),
        )
        # Shows go to the blocks, so that episodes, which are wide, move once.
        out = out.join(totals.withColumn("_lead", F.array_min("_blocks")), "_key", "left")
        out = out.select("*", F.explode_outer("_blocks").alias("block")).drop("_blocks")
        out = out.withColumn("block", F.coalesce("block", F.lit(0)))
        keys.append("block")
        count = lambda s: F.coalesce(F.element_at("_counts", F.get(s, F.lit(0))["_season"]), F.size(s))
        lead = F.coalesce(F.col("block") == F.col("_lead"), F.lit(True))
    rest = [c for c in episodes.columns if c != "url"]
    row = F.struct("_season", F.coalesce("episode_number", F.lit(0)).alias("_order"), "url", *rest)
    by_show = eps.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    out = out.join(by_show, keys, "left")

    def season(s: Column) -> Column:
        number = F.get(s, F.lit(0))["_season"]
        return F.struct(
            number.alias("season_number"),
            F.concat(F.lit("Season "), number.cast("string")).alias("title"),
            count(s).alias("episode_count"),
            F.transform(s, _season_entry).alias("episodes"),
        )

    nested = F.transform(_by_season(F.col("_rows")), season)
    full = F.transform("_rows", lambda e: F.struct(*[e[c].alias(c) for c in episodes.columns]))
    stored = [F.col("seasons")] if "seasons" in shows.columns else []
    return out.select(
        *[F.col(c) for c in shows.columns if c != "seasons"],
        (F.col("block") if "block" in keys else F.lit(0)).alias("block"),
        lead.alias("lead"),
        F.coalesce(nested, *stored, F.array()).alias("seasons"),
        F.coalesce(full, F.array()).alias("full_episodes"),
    )


def flatten_seasons(shows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per episode of the nested seasons; shows and seasons without any stay as a row."""
    rows = shows.select(*keep, F.explode_outer("seasons").alias("s"))
    rows = rows.select(
        *keep,
        F.col("s.season_number").alias("season_number"),
        F.explode_outer("s.episodes").alias("e"),
    )
    return rows.select(*keep, "season_number", "e.*")


def frontend_episodes(shows: DataFrame) -> DataFrame:
    """Replace ``seasons`` by one ``episodes`` list in which every entry knows its season."""
    flat = F.flatten(
        F.transform(
            F.coalesce("seasons", F.array()),
            lambda s: F.transform(
                F.coalesce(s["episodes"], F.array()),
                lambda e: e.withField("season", s["season_number"]),
            ),
        )
    )
    return shows.withColumn("episodes", flat).drop("seasons")


def last_of_title(df: DataFrame, pos: str, title: str = "title_en") -> DataFrame:
    """The rows of the last record of each title, those of all its blocks; untitled records go. Of records with one title and place,
    the greatest URL wins."""
    rows = df.filter(F.coalesce(F.col(title), F.lit("")) != "")
    last = rows.groupBy(title).agg(F.max(F.struct(pos, "url")).alias("_last"))
    last = last.select(title, F.col(f"_last.{pos}").alias(pos), F.col("_last.url").alias("url"))
    return rows.join(last, [title, pos, "url"], "left_semi").select(*df.columns)


def keyed_by_title(df: DataFrame, pos: str, title: str = "title_en", blocks: bool = False) -> DataFrame:
    """``(key, value)`` entries of the title-keyed document: untitled records go and the last
    record of a title wins. Divided documents pass ``blocks`` to keep all blocks of the winner."""
    if blocks:
        rows = last_of_title(df, pos, title)
    else:
        rows = keep_last(df.filter(F.coalesce(F.col(title), F.lit("")) != ""), [title], pos)
    return rows.select(F.col(title).alias("key"), F.struct(*[c for c in df.columns if c != pos]).alias("value"))


def title_map(entries: DataFrame) -> DataFrame:
    """The title-keyed document line by line: each entry as a map of its own, in column ``entries``. Whoever wants one map of them all
    merges lines; no task has to hold more than one."""
    return entries.select(F.create_map("key", "value").alias("entries"))


def episode_urls(seasons: Column) -> Column:
    """Distinct episode URLs of a seasons array, sorted."""
    found = F.flatten(F.transform(seasons, lambda s: F.transform(s["episodes"], lambda e: e["url"])))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def numbered(df: DataFrame, labels: str) -> DataFrame:
    """One row per label with its place and number: the digits in it, else its position."""
    rest = [c for c in df.columns if c != labels]
    rows = df.select(*rest, F.posexplode(labels).alias("pos", "label"))
    found = F.nullif(F.regexp_extract("label", r"(\d+)", 1), F.lit("")).try_cast("int")
    return rows.withColumn("number", F.coalesce(found, F.col("pos") + 1))
