"""The parts the driver tables play: orders are shows, lineitem rows episodes, parts movies,
events failures and feed items, pages crawled pages. Each role exists as a DataFrame and as the
SQL text used by the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.functions.text import LATIN_DIGITS, PERSIAN_DIGITS
from playbill.session import table

SITE = "https://site.example"

# Languages of page URLs stand for content types; one of them for a taxonomy listing.
LANG_SEGMENT = {"en": "movies", "fr": "tvshows", "de": "genres", "es": "episodes"}


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Rows of a driver table that one task renders into documents.
TASK_ROWS = 100_000


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table whose rows are rendered into documents. One that arrives in fewer
    partitions than there are cores, or in partitions of more than ``TASK_ROWS`` rows, is spread first, so that tasks become
    more and not longer as it grows; any other passes unchanged. Rows are counted from the footers of the files."""
    scan = table(spark, sf, name)
    parts = max(spark.sparkContext.defaultParallelism, -(-scan.count() // TASK_ROWS))
    return scan.repartition(parts) if scan.rdd.getNumPartitions() < parts else scan


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """``page_id, url, html, lang`` with content-type paths."""
    df = source(spark, sf, "pages")
    url = F.col("url")
    for lang, segment in LANG_SEGMENT.items():
        url = F.replace(url, F.lit(f"/{lang}/"), F.lit(f"/{segment}/"))
    lang = F.regexp_extract("url", "^https?://[^/]+/([^/?#]*)", 1)
    return df.select("page_id", url.alias("url"), "html", lang.alias("lang"))


_URL = "url"
for _lang, _segment in LANG_SEGMENT.items():
    _URL = f"replace({_URL}, '/{_lang}/', '/{_segment}/')"
PAGES_SQL = f"""pg AS (
  SELECT page_id, {_URL} AS url, html, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS lang FROM pages)"""

ORIGIN_SQL = "regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
PATH_SQL = "regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
TAIL_SQL = "regexp_extract({u}, '^[^?#]*([?#].*)$', 1)"


def origin_sql(u: str) -> str:
    return ORIGIN_SQL.format(u=u)


def path_sql(u: str) -> str:
    return PATH_SQL.format(u=u)


def tail_sql(u: str) -> str:
    return TAIL_SQL.format(u=u)


def norm_sql(u: str) -> str:
    """The normalised form of a URL without escapes."""
    return f"({origin_sql(u)} || rtrim({path_sql(u)}, '/') || {tail_sql(u)})"


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with normalised URLs, without their text."""
    df = pages(spark, sf).drop("html")
    return df.withColumn("url", urls.normalize_url(F.col("url")))


PAGE_URLS_SQL = f"""{PAGES_SQL},
pu AS (SELECT page_id, {norm_sql('url')} AS url, lang FROM pg)"""


def persian(c: Column) -> Column:
    return F.translate(c, LATIN_DIGITS, PERSIAN_DIGITS)


def shows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as shows; some URLs end in a slash."""
    o = table(spark, sf, "orders")
    slash = F.when(F.col("o_orderstatus") == "P", "/").otherwise("")
    return o.select(
        text(f"{SITE}/tvshows/", F.col("o_orderkey"), slash).alias("url"),
        text("Show ", F.col("o_custkey")).alias("title_en"),
        day("o_orderdate").alias("lastmod"),
        F.col("o_orderstatus").alias("source"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("is_new"),
        F.col("o_orderkey").alias("api_id"),
    )


SHOWS_SQL = f"""shows AS (
  SELECT '{SITE}/tvshows/' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '/' ELSE '' END AS url,
    'Show ' || o_custkey AS title_en, strftime(o_orderdate, '%Y-%m-%d') AS lastmod, o_orderstatus AS source,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_new, o_orderkey AS api_id FROM orders)"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem rows as episodes; one return flag has no season."""
    item = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return item.select(
        text(f"{SITE}/episodes/", key).alias("url"),
        text(f"{SITE}/tvshows/", F.col("l_orderkey"), F.when(flag == "R", "/").otherwise("")).alias("show_url"),
        F.when(flag == "A", 1).when(flag == "N", 2).alias("season_number"),
        F.col("l_linenumber").alias("episode_number"),
        text("Episode ", F.col("l_linenumber")).alias("title"),
        day("l_shipdate").alias("air_date"),
        F.lit(None).cast("string").alias("thumbnail"),
        day("l_shipdate").alias("lastmod"),
        F.array(
            F.struct(
                F.lit("720").alias("quality"),
                F.lit("").alias("size"),
                text("https://cdn.example/", key, ".mp4").alias("url"),
                F.lit(None).cast("string").alias("mirror_url"),
            )
        ).alias("video_files"),
    )


EPISODES_SQL = f"""episodes AS (
  SELECT '{SITE}/episodes/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS url,
    '{SITE}/tvshows/' || l_orderkey || CASE WHEN l_returnflag = 'R' THEN '/' ELSE '' END AS show_url,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS season_number, l_linenumber AS episode_number,
    'Episode ' || l_linenumber AS title, strftime(l_shipdate, '%Y-%m-%d') AS air_date,
    strftime(l_shipdate, '%Y-%m-%d') AS lastmod FROM lineitem)"""


# Episodes ``e`` with show key ``k``, season ``s`` and the block of a nested document each is in.
BLOCKS_SQL = f"""{EPISODES_SQL}, whole AS (SELECT rtrim(show_url, '/') AS k, coalesce(season_number, 0) AS s, * FROM episodes),
e AS (SELECT *, (('0x' || substr(md5(url), 1, 8))::BIGINT % 16)::INT AS block FROM whole)"""

# The same, with parts only where a show has more than 20,000 episodes.
PARTS_SQL = f"""{EPISODES_SQL}, whole AS (SELECT rtrim(show_url, '/') AS k, coalesce(season_number, 0) AS s, * FROM episodes),
sizes AS (SELECT k, greatest(ceil(count(*) / 20000), 1)::INT AS parts FROM whole GROUP BY k),
e AS (SELECT w.*, parts, CASE WHEN parts > 1 THEN coalesce(('0x' || substr(md5(url), 1, 8))::BIGINT % parts, 0) ELSE 0 END::INT AS part
  FROM whole w JOIN sizes USING (k))"""


def video_files(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes with one or two video entries each, some without a quality or a URL."""
    item = table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    flag, n = F.col("l_returnflag"), F.col("l_quantity").cast("int")
    none = F.lit(None).cast("string")

    def video(quality: Column, size: Column, url: Column, mirror: Column) -> Column:
        return F.struct(
            quality.alias("quality"), size.alias("size"), url.alias("url"), mirror.alias("mirror_url")
        )

    first = video(
        F.when(flag == "A", "unknown").when(flag == "N", "1080").otherwise(none),
        text(n, " MB"),
        text("https://cdn.example/", key, F.when(n > 25, "-720p.mp4").otherwise("-sd.mp4")),
        none,
    )
    second = video(F.lit(""), none, F.when(n > 40, none).otherwise(text("https://cdn.example/HD/", key)), none)
    files = F.when(flag == "R", F.array(first, second)).otherwise(F.array(first, F.lit(None)))
    return item.select(text(f"{SITE}/episodes/", key).alias("url"), files.alias("video_files"))


def movies(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as movies; several share a title."""
    p = table(spark, sf, "part")
    return p.select(
        text(f"{SITE}/movies/", F.col("p_partkey")).alias("url"),
        F.col("p_name").alias("title_en"),
        F.col("p_partkey").alias("pos"),
        F.split("p_name", " ").alias("genres"),
        F.array("p_brand").alias("directors"),
        (F.lit(1950) + F.col("p_size")).alias("year"),
    )


def failures(spark: SparkSession, sf: str) -> DataFrame:
    """Events as failures of user pages."""
    return failure_rows(table(spark, sf, "events"))


# Error types the event types stand for, one of each severity and two of the middle one.
ERROR_TYPE = {
    "error": "http_500",
    "click": "api_404_retry",
    "purchase": "db_integrity_error",
    "signup": "warning",
    "view": "unlisted",
}


def failure_rows(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in ERROR_TYPE.items() for x in pair])[F.col("event_type")]
    return events.select(
        text(f"{SITE}/u/", F.col("user_id"), F.when(F.col("value") > 20, "/").otherwise("")).alias("url"),
        kind.alias("error_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("event_type").alias("category"),
    )


FAILURES_SQL = f"""failures AS (
  SELECT '{SITE}/u/' || user_id AS url, CASE event_type WHEN 'error' THEN 'http_500' WHEN 'click' THEN 'api_404_retry'
    WHEN 'purchase' THEN 'db_integrity_error' WHEN 'signup' THEN 'warning' ELSE 'unlisted' END AS error_type,
    ts, event_id, event_type AS category FROM events)"""


def stamp(c: str | Column) -> Column:
    """Timestamps as text, for results compared with the oracle."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def parsed_urls(spark: SparkSession, sf: str, read=table) -> DataFrame:
    """All three catalogues as one parsed-URL table; late dates count as modified."""
    cutoff = F.lit("1999-01-01").cast("timestamp_ntz")
    o, i, p = (read(spark, sf, t) for t in ("orders", "lineitem", "part"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return (
        o.select(
            F.lit("shows").alias("category"),
            text(f"{SITE}/tvshows/show-", F.col("o_orderkey")).alias("url"),
            day("o_orderdate").alias("lastmod"),
            F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")).alias("api_id"),
            (F.col("o_orderdate") > cutoff).alias("is_modified"),
            F.col("o_orderkey").alias("pos"),
        )
        .unionByName(
            i.select(
                F.lit("episodes").alias("category"),
                text(f"{SITE}/episodes/", key).alias("url"),
                day("l_shipdate").alias("lastmod"),
                F.lit(None).cast("bigint").alias("api_id"),
                (F.col("l_shipdate") > cutoff).alias("is_modified"),
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
            )
        )
        .unionByName(
            p.select(
                F.lit("movies").alias("category"),
                text(f"{SITE}/movies/film-", F.col("p_partkey")).alias("url"),
                F.lit(None).cast("string").alias("lastmod"),
                F.lit(None).cast("bigint").alias("api_id"),
                F.lit(False).alias("is_modified"),
                F.col("p_partkey").alias("pos"),
            )
        )
    )


PARSED_SQL = f"""parsed AS (
  SELECT 'shows' AS category, '{SITE}/tvshows/show-' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS lastmod,
    CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS api_id, o_orderdate > TIMESTAMP '1999-01-01' AS is_modified,
    o_orderkey AS pos FROM orders
  UNION ALL SELECT 'episodes',
    '{SITE}/episodes/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey,
    strftime(l_shipdate, '%Y-%m-%d'), NULL, l_shipdate > TIMESTAMP '1999-01-01', l_orderkey * 10 + l_linenumber
  FROM lineitem
  UNION ALL SELECT 'movies', '{SITE}/movies/film-' || p_partkey, NULL, NULL, false, p_partkey FROM part)"""
