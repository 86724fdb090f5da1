"""Column layouts of the catalogue and conformance to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VIDEO_FILE = "struct<quality string, size string, url string, mirror_url string>"
SEASON_EPISODE = (
    "struct<episode_number int, title string, date string, url string, thumbnail string, "
    f"lastmod string, video_files array<{VIDEO_FILE}>>"
)
SEASON = f"struct<season_number int, title string, episode_count int, episodes array<{SEASON_EPISODE}>>"

_COMMON = (
    "is_new int, is_modified int, lastmod string, last_scraped string, cached_at string, "
    "source string, api_id bigint, api_source string, modified_gmt string"
)
MOVIE = (
    "url string, sitemap_url string, title_en string, title_fa string, poster string, "
    "description string, release_date string, year int, rating double, rating_count int, "
    "genres array<string>, directors array<string>, cast array<string>, social_shares int, "
    f"comments_count int, video_files array<{VIDEO_FILE}>, language_code string, {_COMMON}"
)
SHOW = (
    "url string, sitemap_url string, title_en string, title_fa string, poster string, "
    "description string, first_air_date string, last_aired string, rating double, "
    "rating_count int, season_count int, episode_count int, genres array<string>, "
    "directors array<string>, cast array<string>, social_shares int, comments_count int, "
    f"seasons array<{SEASON}>, episode_urls array<string>, language_code string, {_COMMON}"
)
EPISODE = (
    "url string, sitemap_url string, show_url string, show_id bigint, season_number int, "
    "episode_number int, title string, air_date string, thumbnail string, description string, "
    f"video_files array<{VIDEO_FILE}>, language_code string, {_COMMON}"
)
ENTITIES = {"movies": MOVIE, "shows": SHOW, "episodes": EPISODE}
DEFAULTS = {"is_new": 1, "is_modified": 0, "language_code": "fa"}

SITEMAP_ENTRY = "loc string, lastmod string"
FEED_ITEM = "title string, link string, guid struct<_VALUE string, _isPermaLink string>, pubDate string"
API_POST = (
    "id bigint, link string, modified_gmt string, title struct<rendered string>, "
    "content struct<rendered string>, acf string, "
    "_embedded struct<`wp:term` array<array<struct<id bigint, name string, taxonomy string, link string>>>, "
    "`wp:featuredmedia` array<struct<source_url string>>>"
)


def schema_of(kind: str) -> StructType:
    return StructType.fromDDL(ENTITIES[kind])


def conform(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """Add the columns a schema has and the table lacks, with their defaults; keep the rest.
    Doing it twice changes nothing."""
    defaults = DEFAULTS if defaults is None else defaults
    have = set(df.columns)
    missing = [
        F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in have
    ]
    return df.select("*", *missing)
