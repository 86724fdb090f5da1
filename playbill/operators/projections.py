"""The scalar cleaning steps as table jobs: one call adds all derived columns of a kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions import dates, media, numbers, text, urls
from playbill.session import computed


def clean_urls(df: DataFrame, url: str = "url", base: str | None = None, nfkc: bool = True) -> DataFrame:
    """Add ``clean_url``, its ``slug``, and the ``cache_key`` of the URL as given."""
    df = computed(df, {"clean_url": urls.normalize_url(F.col(url), base=base, nfkc=nfkc)})
    return df.withColumns({"slug": urls.slug_of(F.col("clean_url")), "cache_key": urls.cache_key(F.col(url), nfkc)})


def classify_urls(df: DataFrame, url: str = "clean_url") -> DataFrame:
    """Add ``content_type``, ``category``, ``api_id`` and the guessed ``title`` of clean URLs."""
    c = F.col(url)
    return computed(
        df,
        {
            "content_type": urls.content_type(c),
            "category": urls.sitemap_category(c),
            "api_id": urls.post_id(c, "sitemap"),
            "title": text.title_from_slug(c),
        },
    )


def derive_media(df: DataFrame, url: str = "url", cdn_hosts: tuple[str, ...] = ()) -> DataFrame:
    """Add the ``quality`` of media URLs."""
    return df.withColumn("quality", media.quality_from_url(F.col(url), cdn_hosts))


def derive_numbers(df: DataFrame, released: str, rating: str, votes: str, url: str = "url") -> DataFrame:
    """Add ``released_at``, ``year``, ``rating_value`` and ``vote_count`` from page texts."""

    def clean(name: str) -> Column:
        return text.normalize_digits(F.col(name))

    return df.withColumns(
        {
            "released_at": dates.any_date(clean(released)),
            "year": numbers.release_year(clean(released), F.col(url)),
            "rating_value": numbers.first_number(clean(rating)),
            "vote_count": numbers.counted(clean(votes)),
        }
    )
