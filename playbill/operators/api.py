"""Mapping of landed API posts to catalogue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.dates import iso_timestamp, modified_after
from playbill.schemas import SEASON, VIDEO_FILE
from playbill.session import computed

# Fixed value: the label of records that come from the API.
API_SOURCE = "wp-json/v2"
# Taxonomy of each name list.
TAXONOMIES = {"genres": "genres", "directors": "director", "cast": "cast"}


def _truthy(c: Column) -> Column:
    return F.coalesce(~F.trim(c).isin("", "0", "0.0", "false", "null", "[]", "{}"), F.lit(False))


def _fields(acf: Column) -> Column:
    """Custom fields as texts: an object, or an empty list when there are none."""
    return F.from_json(acf, "map<string,string>")


class _Custom:
    """Access to custom fields parsed into columns ``_fields`` and ``_names``."""

    @staticmethod
    def has(name: str) -> Column:
        return F.coalesce(F.array_contains("_names", name), F.lit(False))

    @staticmethod
    def text(name: str) -> Column:
        return F.try_element_at("_fields", F.lit(name))

    def number(self, name: str, kind: str, default) -> Column:
        """Null when the field is absent, the default when it is no number."""
        text = self.text(name)
        # JSON may spell a whole number with a fraction: 12.0 is 12.
        whole = text.try_cast(kind) if kind == "double" else F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
        return F.when(self.has(name), F.coalesce(whole, F.lit(default).cast(kind)))

    def entries(self, name: str, kind: str) -> Column:
        return F.when(self.has(name), F.from_json(self.text(name), f"array<{kind}>"))


def is_complete(kind: str, fields: Column | None = None) -> Column:
    """Whether a post holds enough to replace the page: an id and a link; for shows also a title
    and one of the basic custom fields. ``fields`` are the parsed custom fields, if at hand."""
    ok = F.col("id").isNotNull() & F.col("link").isNotNull()
    if kind == "shows":
        fields = _fields(F.col("acf")) if fields is None else fields
        basic = [_truthy(F.try_element_at(fields, F.lit(n))) for n in ("title_fa", "season_count", "episode_count")]
        ok = ok & (F.coalesce(F.col("title.rendered"), F.lit("")) != "") & (basic[0] | basic[1] | basic[2])
    return ok


def terms(embedded: Column) -> Column:
    """All taxonomy terms of a post as one list."""
    return F.flatten(F.filter(embedded["wp:term"], lambda group: group.isNotNull()))


def term_names(all_terms: Column, taxonomy: str) -> Column:
    return F.transform(F.filter(all_terms, lambda t: t["taxonomy"] == taxonomy), lambda t: t["name"])


def map_posts(posts: DataFrame, kind: str, since: Column | None = None) -> DataFrame:
    """API posts as records of type ``kind``; incomplete posts and, with ``since``, posts not
    changed later are left out. Unparsable change times count as changed."""
    # Parsed once, as columns of their own: the filter and every field below read them.
    names = F.when(F.trim("acf").startswith("{"), F.json_object_keys("acf"))
    rows = computed(posts, {"_fields": _fields(F.col("acf")), "_names": names, "_terms": terms(F.col("_embedded"))})
    rows = rows.filter(is_complete(kind, F.col("_fields")))
    if since is not None:
        rows = rows.filter(modified_after(iso_timestamp(F.col("modified_gmt")), since, on_unparsed=True))
    acf = _Custom()
    title = F.coalesce(F.col("title.rendered"), F.lit(""))
    media = F.try_element_at(F.col("_embedded")["wp:featuredmedia"], F.lit(1))["source_url"]
    every = F.col("_terms")
    out = {
        "api_id": F.col("id"),
        "api_source": F.lit(API_SOURCE),
        "modified_gmt": F.col("modified_gmt"),
        "url": F.col("link"),
        "description": F.coalesce(F.col("content.rendered"), F.lit("")),
        "is_new": F.lit(1),
        "is_modified": F.lit(1 if since is not None else None).cast("int"),
    }
    if kind == "episodes":
        out |= {
            "title": title,
            "season_number": acf.number("season_number", "int", 1),
            "episode_number": acf.number("episode_number", "int", 1),
            "air_date": acf.text("air_date"),
            "thumbnail": F.when(acf.has("thumbnail"), acf.text("thumbnail")).otherwise(media),
            "video_files": acf.entries("video_files", VIDEO_FILE),
        }
        show = F.try_element_at(F.filter(every, lambda t: t["taxonomy"] == "tvshows"), F.lit(-1))
        out |= {"show_id": show["id"], "show_url": show["link"]}
        return rows.select(*[c.alias(n) for n, c in out.items()])
    out |= {"title_en": title, "poster": media, "title_fa": acf.text("title_fa")}
    out |= {"rating": acf.number("rating", "double", 0), "rating_count": acf.number("rating_count", "int", 0)}
    out |= {field: term_names(every, taxonomy) for field, taxonomy in TAXONOMIES.items()}
    if kind == "movies":
        year = F.nullif(F.regexp_extract(acf.text("release_date"), r"(\d{4})", 1), F.lit(""))
        out |= {
            "release_date": acf.text("release_date"),
            "year": year.cast("int"),
            "video_files": acf.entries("video_files", VIDEO_FILE),
        }
    else:
        out |= {
            "first_air_date": acf.text("first_air_date"),
            "last_aired": acf.text("last_aired"),
            "season_count": acf.number("season_count", "int", 0),
            "episode_count": acf.number("episode_count", "int", 0),
            "seasons": acf.entries("seasons", SEASON),
        }
    return rows.select(*[c.alias(n) for n, c in out.items()])


def newest_per_page(posts: DataFrame, page: str = "page") -> DataFrame:
    """Latest change per result page."""
    return posts.groupBy(page).agg(F.max(iso_timestamp(F.col("modified_gmt"))).alias("newest"))
