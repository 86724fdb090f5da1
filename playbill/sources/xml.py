"""Sitemaps and feeds.

Files with many records are read by row tag, which splits large files. Where the order of the
records matters, a document is parsed as a whole: feeds and sitemaps are limited in size by
their protocols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.functions.dates import iso_timestamp, modified_after, rfc822_timestamp
from playbill.schemas import FEED_ITEM, SITEMAP_ENTRY
from playbill.session import computed

_RSS = f"channel struct<lastBuildDate string, item array<struct<{FEED_ITEM}>>>"


def read_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of landed XML files with the file each came from."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.withColumn("file", F.input_file_name())


def sitemap_index(rows: DataFrame) -> DataFrame:
    """Index entries ``(url, lastmod, type, priority)``; entries without a location go."""
    rows = rows.filter(F.coalesce(F.trim("loc"), F.lit("")) != "")
    kind = urls.sitemap_type(F.col("loc"))
    return rows.select(
        F.trim("loc").alias("url"),
        F.trim("lastmod").alias("lastmod"),
        kind.alias("type"),
        urls.sitemap_priority(kind).alias("priority"),
    )


def in_priority_order(index: DataFrame, missing_first: bool = True) -> DataFrame:
    """Sitemaps in the order they are read: by type, then those without lastmod."""
    missing = F.col("lastmod").isNull()
    return index.orderBy("priority", missing.desc() if missing_first else missing, "url")


def content_sitemaps(index: DataFrame) -> DataFrame:
    return index.filter(F.col("type").isin("movies", "shows", "episodes", "general"))


def sitemap_entries(rows: DataFrame, since: Column | None = None, nfkc: bool = True) -> DataFrame:
    """URL entries with normalised URL, post id, category and modified flag. A missing or bad
    lastmod counts as not modified and, where a date is asked for, as a parse error."""
    rows = rows.filter(F.coalesce(F.trim("loc"), F.lit("")) != "")
    rows = rows.withColumn("url", urls.normalize_url(F.trim("loc"), nfkc=nfkc))
    changed = iso_timestamp(F.trim("lastmod"))
    flag = F.lit(False) if since is None else modified_after(changed, since, on_unparsed=False)
    bad = F.lit(False) if since is None else F.col("lastmod").isNotNull() & changed.isNull()
    return rows.select(
        *[c for c in rows.columns if c not in ("loc", "url", "lastmod")],
        "url",
        F.trim("lastmod").alias("lastmod"),
        urls.post_id(F.col("url"), "sitemap").alias("api_id"),
        flag.alias("is_modified"),
        urls.sitemap_category(F.col("url")).alias("category"),
        bad.alias("bad_lastmod"),
    )


def document_entries(documents: DataFrame, xml: str = "xml", tag: str = "url") -> DataFrame:
    """Rows of whole sitemap documents held in a column, with their position."""
    parsed = F.from_xml(F.col(xml), f"`{tag}` array<struct<{SITEMAP_ENTRY}>>")
    kept = [c for c in documents.columns if c != xml]
    rows = documents.select(*kept, F.posexplode(parsed[tag]).alias("pos", "e"))
    return rows.select(*kept, "pos", "e.loc", "e.lastmod")


def feed_items(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of feed documents in feed order: ``pos`` 0 is the newest. A feed element may stand
    for the guid; an item without one has an empty guid."""
    parsed = F.from_xml(F.col(xml), _RSS)
    kept = [c for c in documents.columns if c != xml]
    rows = documents.select(*kept, F.posexplode(parsed["channel"]["item"]).alias("pos", "i"))

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return rows.select(
        *kept,
        "pos",
        text("i.title").alias("title"),
        text("i.link").alias("link"),
        text("i.guid._VALUE").alias("guid"),
        text("i.pubDate").alias("published"),
        F.lit("rss").alias("source"),
    )


def feed_build_dates(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """The build time of each feed, null when absent or unreadable."""
    parsed = F.from_xml(F.col(xml), "channel struct<lastBuildDate string>")
    dated = computed(documents, {"_written": parsed["channel"]["lastBuildDate"]})
    return dated.withColumn("built", rfc822_timestamp(F.col("_written"))).drop(xml, "_written")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole XML files as ``(file, xml)``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("xml"))
