"""Record coercion and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.media import quick_quality
from playbill.functions.numbers import coerce_double, coerce_int
from playbill.schemas import VIDEO_FILE
from playbill.session import computed

# Fields every record of a type must have.
REQUIRED_FIELDS = {
    "shows": ["url", "title_en"],
    "episodes": ["url", "show_url", "season_number", "episode_number"],
    "movies": ["url", "title_en"],
}
# Numeric fields and their types.
NUMERIC_FIELDS = {
    "rating": "double",
    "rating_count": "int",
    "social_shares": "int",
    "comments_count": "int",
    "season_count": "int",
    "episode_count": "int",
    "season_number": "int",
    "episode_number": "int",
    "year": "int",
    "is_new": "int",
    "api_id": "bigint",
}
# List fields held as text.
LIST_FIELDS = ["genres", "directors", "cast", "episode_urls"]


def _is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def coerce_list(c: Column) -> Column:
    """JSON text to a list of texts: a JSON list as it is, another truthy value as its only
    element, anything else as the empty list."""
    empty = F.expr("cast(array() as array<string>)")
    text = F.trim(c)
    scalar = F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]"))
    falsy = text.rlike(r'^(?:""|-?0+(?:\.0*)?(?:[eE][+-]?\d+)?|false|null|\{\s*\})$')
    return (
        F.when(c.isNull() | ~_is_json(text), empty)
        .when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), empty))
        .when(falsy, empty)
        .otherwise(F.array(F.coalesce(scalar, text)))
    )


def encode_json(c: Column, dtype) -> Column:
    """A list field as JSON text: nothing is ``[]``, valid JSON stays, other text is wrapped."""
    if dtype.typeName() in ("array", "map", "struct"):
        empty = F.size(c) == 0 if dtype.typeName() != "struct" else F.lit(False)
        return F.when(c.isNull() | empty, "[]").otherwise(F.to_json(c))
    if dtype.typeName() != "string":
        return F.when(c.isNull(), "[]").otherwise(F.concat(F.lit('"'), c.cast("string"), F.lit('"')))
    return F.when(F.coalesce(c, F.lit("")) == "", "[]").when(_is_json(c), c).otherwise(F.to_json(F.array(c)))


def normalize_videos(videos: Column, cdn_hosts: tuple[str, ...] = ()) -> Column:
    """Video entries with every field set: a missing or unknown quality is read from the URL."""

    def entry(v: Column) -> Column:
        known = ~F.coalesce(v["quality"], F.lit("")).isin("", "unknown")
        return F.struct(
            F.when(known, v["quality"]).otherwise(quick_quality(v["url"], cdn_hosts)).alias("quality"),
            F.coalesce(v["size"], F.lit("")).alias("size"),
            F.coalesce(v["url"], F.lit("")).alias("url"),
            v["mirror_url"].alias("mirror_url"),
        )

    kept = F.filter(F.coalesce(videos, F.array()), lambda v: v.isNotNull())
    return F.transform(kept, entry)


def parse_videos(c: Column) -> Column:
    """JSON text to video entries; bad text is the empty list, one object a list of one."""
    text = F.trim(c)
    text = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return F.coalesce(F.from_json(text, f"array<{VIDEO_FILE}>"), F.expr(f"cast(array() as array<{VIDEO_FILE}>)"))


def coerce_records(df: DataFrame) -> DataFrame:
    """List, video, numeric and flag fields brought to their types; other columns pass."""
    types = dict(df.dtypes)
    new = {}
    for name in LIST_FIELDS:
        if types.get(name) == "string":
            new[name] = coerce_list(F.col(name))
        elif name in types:
            new[name] = F.coalesce(name, F.array())
    for name, kind in NUMERIC_FIELDS.items():
        if name in types:
            c = coerce_double(F.col(name)) if kind == "double" else coerce_int(F.col(name)).try_cast(kind)
            new[name] = c
    if "is_new" in new:
        new["is_new"] = F.coalesce(new["is_new"], F.lit(1))
    if "video_files" in types:
        c = F.col("video_files")
        new["video_files"] = normalize_videos(parse_videos(c) if types["video_files"] == "string" else c)
        # Whoever takes the list apart filters by its size: that must not make it again.
        rows = computed(df.withColumns({n: x for n, x in new.items() if n != "video_files"}), {"video_files": new["video_files"]})
        return rows.select(*df.columns)
    return df.withColumns(new)


def item_type(df: DataFrame) -> Column:
    """The record type, from the fields it has and then from its URL."""

    def has(*names: str) -> Column:
        out = F.lit(False)
        for name in names:
            if name in df.columns:
                out = out | F.col(name).isNotNull()
        return out

    url = F.col("url")
    return (
        F.when(has("show_url") & has("episode_number"), "episodes")
        .when(has("seasons", "season_count"), "shows")
        .when(has("release_date", "year"), "movies")
        .when(url.contains("/episodes/"), "episodes")
        .when(url.contains("/tvshows/") | url.contains("/series"), "shows")
        .when(url.contains("/movies/"), "movies")
    )


def missing_fields(kind: str, types: dict[str, str]) -> Column:
    """Names of the required fields a record lacks."""
    checks = []
    for name in REQUIRED_FIELDS[kind]:
        if name not in types:
            checks.append(F.lit(name))
            continue
        empty = F.col(name).isNull()
        if types[name] == "string":
            empty = empty | (F.col(name) == "")
        checks.append(F.when(empty, name))
    return F.array_compact(F.array(*checks))


def require_fields(df: DataFrame, kind: str) -> DataFrame:
    """Records with their ``missing`` field names; those without a URL are dropped."""
    df = df.withColumn("missing", missing_fields(kind, dict(df.dtypes)))
    return df.filter(~F.array_contains("missing", "url"))


def _message(bad: Column, text: str) -> Column:
    return F.when(bad, text)


def _negative(name: str, label: str) -> Column:
    return _message(F.col(name) < 0, f"{label} must be a non-negative integer")


def validation_errors(kind: str) -> Column:
    """The messages a record of the given type earns, as an array."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rules = [
        _message(url == "", "URL is required"),
        _message((url != "") & ~url.rlike("^https?://"), "URL must start with http:// or https://"),
    ]
    if kind in ("shows", "movies"):
        rules += [
            _message(F.coalesce(F.col("title_en"), F.lit("")) == "", "English title is required"),
            _message((F.col("rating") < 0) | (F.col("rating") > 10), "Rating must be a number between 0 and 10"),
            _negative("rating_count", "Rating count"),
        ]
    if kind == "shows":
        rules += [_negative("season_count", "Season count"), _negative("episode_count", "Episode count")]
    if kind == "movies":
        rules.append(
            _message((F.col("year") < 1900) | (F.col("year") > 2100), "Year must be between 1900 and 2100")
        )
    if kind == "episodes":
        rules += [
            _message(F.coalesce(F.col("show_url"), F.lit("")) == "", "Show URL is required"),
            _negative("season_number", "Season number"),
            _negative("episode_number", "Episode number"),
        ]
    return F.array_compact(F.array(*rules))


def validate(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("errors", validation_errors(kind))


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("errors").alias("message")).groupBy("message").agg(F.count("*").alias("n"))


def clean_names(names: Column) -> Column:
    """Trimmed, non-empty, distinct names in order."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != ""))
