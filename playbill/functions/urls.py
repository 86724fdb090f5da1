"""URL cleaning and classification as Column expressions.

``normalize_url`` is the single normaliser; its switches cover every variant the catalogue
needs. The classifiers expect a URL that has already been through it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.text import PERSIAN_DIGITS, normalize_digits
from playbill.functions.text import nfkc as nfkc_text

# Path segments that lead to a content page, by content type, in match order.
CONTENT_SEGMENTS = {
    "movies": [r"movies", r"movies-\d{4}", r"old-iranian-movies"],
    "shows": [r"tvshows", r"series-\d+", r"iranian-series"],
    "episodes": [r"episodes"],
}
# The segments the sitemap categoriser knows.
SITEMAP_SEGMENTS = {
    "movies": [r"movies", r"movies-\d{4}", r"old-iranian-movies"],
    "shows": [r"tvshows", r"series-22", r"iranian-series"],
    "episodes": [r"episodes"],
}
# The post_type query values of content pages.
POST_TYPES = {"movies": "movies", "shows": "tvshows", "episodes": "episodes"}
# Path segment used when a URL of each type is built.
TYPE_SEGMENT = {"movies": "movies", "shows": "tvshows", "episodes": "episodes"}
# Taxonomy listings, which are never content.
TAXONOMY_SEGMENTS = [
    "genres",
    "dtcast",
    "dtdirector",
    "dtcreator",
    "dtstudio",
    "dtnetworks",
    "dtyear",
]
# Sitemap file name prefixes with a type of their own, and the scan order of types.
SITEMAP_TYPES = {"movies": "movies", "tvshows": "shows", "episodes": "episodes", "post": "general"}
SITEMAP_PRIORITY = {"movies": 1, "shows": 2, "episodes": 3, "general": 4, "other": 5}
# Other names of the show category.
TYPE_ALIASES = {"series": "shows", "tvshows": "shows"}

# Where a post id may stand, by kind of source, in the order tried.
POST_ID_PATTERNS = {
    "api": [("url", r"\?p=(\d+)"), ("url", r"/(\d+)/?$"), ("url", r"-(\d+)-")],
    "sitemap": [("url", r"[?&]p=(\d+)"), ("path", r"-(\d+)/?$"), ("path", r"-(\d+)-")],
    "guid": [("url", r"[?&]p=(\d+)")],
}


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` with no match as null instead of the empty string."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def url_origin(url: Column) -> Column:
    """``scheme://host`` or the empty string."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def url_tail(url: Column) -> Column:
    """Query and fragment with their marks."""
    return F.regexp_extract(url, r"^[^?#]*([?#].*)$", 1)


def percent_decode(c: Column) -> Column:
    """Decode percent escapes; ``+`` and malformed escapes stay as they are."""
    safe = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))).otherwise(c)


def percent_encode(c: Column) -> Column:
    """Encode a path; letters, digits, ``_.-~`` and ``/`` stay as they are."""
    out = F.url_encode(c)
    for escaped, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.expr("cast(array() as array<string>)"),
        lambda done, part: F.when(part == ".", done)
        .when((part == "..") & (F.size(done) > 1), F.slice(done, 1, F.size(done) - 1))
        .when(part == "..", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: inside the lambda of an array function
    nothing else keeps an expression from being computed at every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_parts(base: Column) -> Column:
    """What joining needs of the page URL, as a struct to keep in a column."""
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    return F.struct(
        base.alias("page"),
        F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//", 1).alias("scheme"),
        url_origin(base).alias("origin"),
        url_path(base).alias("path"),
        F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder"),
    )


def joined_url(url: Column, base: Column) -> Column:
    """Join a possibly relative reference to a page given by its ``base_parts``."""
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
        .when(url.startswith("//"), F.concat(base["scheme"], url))
        .when(url == "", base["page"])
        .when(url.startswith("#"), F.concat(F.regexp_replace(base["page"], r"#.*$", ""), url))
        .when(url.startswith("?"), F.concat(base["origin"], base["path"], url))
        .when(url.startswith("/"), F.concat(base["origin"], _without_dots(url_path(url)), url_tail(url)))
        .otherwise(F.concat(base["origin"], _without_dots(F.concat(base["folder"], url_path(url))), url_tail(url)))
    )


def absolute_url(url: Column, base: Column) -> Column:
    """Join a possibly relative reference to the page it was found on."""
    return joined_url(url, base_parts(base))


def strip_slash(url: Column) -> Column:
    """The light variant: outer trailing slashes only."""
    return F.rtrim(F.coalesce(url, F.lit("")), F.lit("/"))


def normalize_url(
    url: Column,
    base: str | None = None,
    decode: bool = True,
    nfkc: bool = False,
    digits: bool = True,
    lower: bool = False,
    requote: bool = False,
) -> Column:
    """One canonical spelling of a URL; null becomes the empty string.

    ``base`` joins URLs without an http scheme, ``decode`` undoes percent escapes in the path,
    ``nfkc`` and ``digits`` normalise its text, ``lower`` folds its case and ``requote`` escapes
    it again. Trailing slashes of the path always go; query and fragment stay.
    """
    url = F.coalesce(url, F.lit(""))
    marks = [r"/(?:[?#]|$)"]
    if base is not None:
        url = F.when((url == "") | url.rlike("^https?://"), url).otherwise(absolute_url(url, F.lit(base)))
    path = url_path(url)
    if decode:
        path = percent_decode(path)
        marks.append("%")
    if nfkc:
        path = nfkc_text(path)
    if digits:
        path = normalize_digits(path)
        marks.append(f"[{PERSIAN_DIGITS}]")
    if lower:
        path = F.lower(path)
    path = F.rtrim(path, F.lit("/"))
    if requote:
        path = percent_encode(path)
    clean = F.concat(url_origin(url), path, url_tail(url))
    if nfkc or lower or requote:
        return clean
    # Most URLs bear no mark of anything to change and pass with one look.
    return F.when(url.rlike("|".join(marks)), clean).otherwise(url)


def slug_of(url: Column) -> Column:
    """The slug of a normalised URL: that of the first content pattern, else the last path part."""
    found = []
    for kind, segments in CONTENT_SEGMENTS.items():
        for segment in segments:
            found.append(_extract(url, rf"^https?://[^/]+/{segment}/([^/]+)/?$"))
        if kind == "episodes":
            found.append(_extract(url, r"^https?://[^/]+/episodes/([^/]+)/?\?"))
        found.append(_extract(url, rf"^https?://[^/]+/([^/]+)/?\?post_type={POST_TYPES[kind]}"))
    last = F.element_at(F.split(F.trim(url_path(url), F.lit("/")), "/"), -1)
    return F.coalesce(*found, F.nullif(last, F.lit("")))


def _page_of(url: Column, kind: str) -> Column:
    segments = "|".join(CONTENT_SEGMENTS[kind])
    hit = url.rlike(rf"^https?://[^/]+/(?:{segments})/[^/]+/?$")
    hit = hit | url.rlike(rf"^https?://[^/]+/[^/]+/?\?post_type={POST_TYPES[kind]}")
    if kind == "episodes":
        hit = hit | url.rlike(r"^https?://[^/]+/episodes/[^/]+/?\?")
    return hit


def content_type(url: Column) -> Column:
    """``movies``, ``shows``, ``episodes`` or null for a normalised URL."""
    parts = F.split(F.lower(url_path(url)), "/")
    by_rule = F
    for kind in CONTENT_SEGMENTS:
        by_rule = by_rule.when(_page_of(url, kind), kind)
    by_rule = (
        by_rule.when(F.array_contains(parts, "movies"), "movies")
        .when(F.array_contains(parts, "tvshows") | F.array_contains(parts, "series"), "shows")
        .when(F.array_contains(parts, "episodes"), "episodes")
    )

    # Plain pages are told by the segment before the slug; only other URLs need the full rules.
    def by_segment(segment: Column) -> Column:
        out = F
        for kind, names in CONTENT_SEGMENTS.items():
            out = out.when(segment.rlike("^(?:" + "|".join(names) + ")$"), kind)
        return out.otherwise(None)

    segment = F.regexp_extract(url, r"^https?://[^/]+/([^/]+)/[^/]+/?$", 1)
    plain = F.when(~url.contains("?post_type="), once(segment, by_segment))
    return F.coalesce(plain, by_rule)


def start_url_type(url: Column) -> Column:
    """The stricter variant used for start URLs: one pattern per type, then substrings."""
    low = F.lower(url)
    return (
        F.when(url.rlike(r"^https?://[^/]+/movies/[^/]+/?$"), "movies")
        .when(url.rlike(r"^https?://[^/]+/episodes/[^/]+/?$"), "episodes")
        .when(url.rlike(r"^https?://[^/]+/tvshows/[^/]+/?$"), "shows")
        .when(low.contains("/movies/"), "movies")
        .when(low.contains("/episodes/"), "episodes")
        .when(low.contains("/tvshows/") | low.contains("/series"), "shows")
    )


def is_content_url(url: Column, kind: Column) -> Column:
    """Whether a normalised URL is of the expected type."""
    return F.coalesce(content_type(url) == kind, F.lit(False))


def is_taxonomy_url(url: Column) -> Column:
    return url.rlike("/(?:" + "|".join(TAXONOMY_SEGMENTS) + ")/")


def sitemap_category(url: Column, skip_taxonomies: bool = True) -> Column:
    """Category of a normalised sitemap URL, or null. The blacklist is a join, see ``frontier``."""
    path = url_path(url)
    out = F.when(is_taxonomy_url(url), None) if skip_taxonomies else F
    for kind, segments in SITEMAP_SEGMENTS.items():
        out = out.when(url.rlike("/(?:" + "|".join(segments) + ")/[^/]+/?$"), kind)
    for kind, segment in TYPE_SEGMENT.items():
        out = out.when(path.contains(f"/{segment}/"), kind)
    return out


def sitemap_type(url: Column) -> Column:
    """Type of a sitemap from its file name; ``other`` when the name says nothing."""
    name = F.element_at(F.split(url_path(url), "/"), -1)
    stem = _extract(name, r"^([A-Za-z_-]+)-sitemap\d*\.xml")
    out = F.when(stem.isNull(), "other")
    for prefix, kind in SITEMAP_TYPES.items():
        out = out.when(stem == prefix, kind)
    return out.otherwise(stem)


def sitemap_priority(kind: Column) -> Column:
    out = F
    for name, rank in SITEMAP_PRIORITY.items():
        out = out.when(kind == name, rank)
    return out.otherwise(999)


def canonical_type(kind: Column) -> Column:
    """One name per category: ``series`` and ``tvshows`` are ``shows``."""
    out = F
    for alias, name in TYPE_ALIASES.items():
        out = out.when(kind == alias, name)
    return out.otherwise(kind)


def post_id(url: Column, source: str) -> Column:
    """Numeric post id hidden in a URL; ``source`` is ``api``, ``sitemap`` or ``guid``."""
    path = url_path(url)
    return F.coalesce(
        *[
            _extract(path if where == "path" else url, pattern).try_cast("bigint")
            for where, pattern in POST_ID_PATTERNS[source]
        ]
    )


def feed_item_id(guid: Column, link: Column) -> Column:
    """Post id of a feed item: from its guid, else from its link."""
    return F.coalesce(post_id(guid, "guid"), post_id(link, "api"))


def build_url(kind: Column, slug: Column, base: str) -> Column:
    segment = F
    for name, part in TYPE_SEGMENT.items():
        segment = segment.when(kind == name, part)
    return F.concat_ws("/", F.lit(base), segment.otherwise(None), percent_encode(slug))


def cache_key(url: Column, nfkc: bool = False) -> Column:
    """A file-safe name for a URL: host, path and a short hash of the decoded URL."""
    text = percent_decode(url)
    text = normalize_digits(nfkc_text(text) if nfkc else text)
    digest = F.substring(F.md5(F.encode(text, "UTF-8")), 1, 12)
    host = F.regexp_replace(F.get(F.split(url_host(text), ":"), F.lit(0)), "[^a-zA-Z0-9]", "_")
    path = F.regexp_replace(F.trim(url_path(text), F.lit("/")), "[^a-zA-Z0-9]", "_")
    path = F.nullif(F.substring(path, 1, 30), F.lit(""))
    slug = F.concat_ws("_", F.substring(host, 1, 20), path, digest)
    return F.when(F.coalesce(url, F.lit("")) == "", "empty_url").otherwise(F.regexp_replace(slug, "_+", "_"))


def guessed_parent(url: Column) -> Column:
    """The show URL suggested by an episode slug: the text before its first dash."""
    halves = F.split(url, "/episodes/")
    slug = F.get(F.split(F.get(halves, F.lit(1)), "-"), F.lit(0))
    return F.concat(F.get(halves, F.lit(0)), F.lit("/tvshows/"), slug)
