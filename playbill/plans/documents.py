"""Queries on nested documents, record quality, API posts and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from playbill.functions import urls
from playbill.operators import api, nesting, quality, upsert
from playbill.plans.registry import query
from playbill.plans.roles import (
    BLOCKS_SQL,
    EPISODES_SQL,
    PARTS_SQL,
    SHOWS_SQL,
    SITE,
    day,
    episodes,
    movies,
    shows,
    source,
    text,
    video_files,
)
from playbill.schemas import SEASON, conform
from playbill.session import table
from playbill.sources import landed

# --- nesting ---



def _nested(spark, sf, **options):
    stored = F.from_json(F.lit('[{"season_number": 9, "title": "Season 9", "episode_count": 0, "episodes": []}]'), f"array<{SEASON}>")
    return nesting.nest_seasons(shows(spark, sf).withColumn("seasons", stored), episodes(spark, sf), **options)


def _spelled(seasons):
    def episode(e):
        file = F.get(e["video_files"], F.lit(0))["url"]
        return F.concat_ws(":", e["episode_number"].cast("string"), e["title"], e["date"], e["url"], file)

    def season(s):
        head = F.concat_ws(":", s["season_number"].cast("string"), s["title"], s["episode_count"].cast("string"))
        return F.concat(head, F.lit("="), F.array_join(F.transform(s["episodes"], episode), ","))

    return F.array_join(F.transform(seasons, season), ";")


@query(f"""WITH {SHOWS_SQL}, {BLOCKS_SQL}, n AS (SELECT k, s, count(*) AS n FROM e GROUP BY k, s),
s AS (SELECT k, block, s, count(*) AS here, string_agg(episode_number || ':' || title || ':' || air_date || ':' || url || ':'
    || replace(url, '{SITE}/episodes/', 'https://cdn.example/') || '.mp4', ',' ORDER BY episode_number, url, air_date) AS eps FROM e GROUP BY k, block, s),
d AS (SELECT k, block, block = min(block) OVER (PARTITION BY k) AS lead, string_agg(s || ':Season ' || s || ':' || n || '=' || eps, ';' ORDER BY s) AS seasons, sum(here)::INT AS n
  FROM s JOIN n USING (k, s) GROUP BY k, block)
SELECT url, title_en, coalesce(block, 0) AS block, coalesce(lead, true) AS lead, coalesce(seasons, '9:Season 9:0=') AS seasons, coalesce(n, 0) AS full_count
FROM shows LEFT JOIN d ON rtrim(url, '/') = k""")
def nest_seasons(spark, sf):
    return _nested(spark, sf).select(
        "url",
        "title_en",
        "block",
        "lead",
        _spelled(F.col("seasons")).alias("seasons"),
        F.size("full_episodes").alias("full_count"),
    )


@query(f"""WITH {SHOWS_SQL}, {EPISODES_SQL} SELECT s.url AS show, CASE WHEN e.url IS NULL THEN 9 ELSE coalesce(season_number, 0) END AS season_number,
  episode_number, title, air_date AS date, e.url, e.lastmod
FROM shows s LEFT JOIN episodes e ON rtrim(s.url, '/') = rtrim(e.show_url, '/')""")
def flatten_seasons(spark, sf):
    rows = nesting.flatten_seasons(_nested(spark, sf).withColumnRenamed("url", "show"), ["show"])
    return rows.select("show", "season_number", "episode_number", "title", "date", "url", "lastmod")


@query(f"""WITH {SHOWS_SQL}, {PARTS_SQL}, d AS (SELECT k, part, string_agg(s || '/' || episode_number || '/' || url, ' ' ORDER BY s, episode_number, url) AS episodes
  FROM e GROUP BY k, part)
SELECT url, coalesce(episodes, '') AS episodes FROM shows LEFT JOIN d ON rtrim(url, '/') = k""")
def frontend_episodes(spark, sf):
    rows = nesting.frontend_episodes(_nested(spark, sf, most=20_000))
    spelled = F.transform(
        "episodes",
        lambda e: F.concat_ws("/", e["season"].cast("string"), e["episode_number"].cast("string"), e["url"]),
    )
    return rows.select("url", F.array_join(spelled, " ").alias("episodes"))


@query(f"""SELECT p_name AS title, '{SITE}/movies/' || max(p_partkey) AS url, arg_max(1950 + p_size, p_partkey) AS year FROM part GROUP BY 1""")
def title_map(spark, sf):
    maps = nesting.title_map(nesting.keyed_by_title(movies(spark, sf), "pos"))
    entries = maps.select(F.explode("entries").alias("title", "movie"))
    return entries.select("title", "movie.url", "movie.year")


# --- coercion and validation ---

_LIST_TEXT_SQL = """CASE event_type WHEN 'click' THEN '["a ' || user_id || '", "b", 3]' WHEN 'purchase' THEN '[not json' || user_id
  WHEN 'signup' THEN '"text ' || user_id || '"' WHEN 'view' THEN CASE WHEN value < 10 THEN '0' WHEN value < 20 THEN '' WHEN value < 30 THEN 'null'
  WHEN value < 40 THEN '7' ELSE '{}' END ELSE props END"""


def _list_text():
    kind, user, value = F.col("event_type"), F.col("user_id"), F.col("value")
    rest = (
        F.when(value < 10, "0").when(value < 20, "").when(value < 30, "null").when(value < 40, "7").otherwise("{}")
    )
    return (
        F.when(kind == "click", text('["a ', user, '", "b", 3]'))
        .when(kind == "purchase", text("[not json", user))
        .when(kind == "signup", text('"text ', user, '"'))
        .when(kind == "view", rest)
        .otherwise(F.col("props"))
    )


@query(f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'a ' || user_id || '|b|3' WHEN 'purchase' THEN '' WHEN 'signup' THEN 'text ' || user_id
  WHEN 'view' THEN CASE WHEN value >= 30 AND value < 40 THEN '7' ELSE '' END ELSE props END AS items,
  CASE event_type WHEN 'click' THEN 3 WHEN 'purchase' THEN 0 WHEN 'view' THEN CASE WHEN value >= 30 AND value < 40 THEN 1 ELSE 0 END
  ELSE 1 END AS n, ({_LIST_TEXT_SQL}) AS raw FROM events""")
def list_coercion(spark, sf):
    items = quality.coerce_list(F.col("raw"))
    rows = table(spark, sf, "events").select("event_id", _list_text().alias("raw"))
    return rows.select("event_id", F.array_join(items, "|").alias("items"), F.size(items).alias("n"), "raw")


@query(f"""WITH r AS (SELECT event_id, ({_LIST_TEXT_SQL}) AS raw FROM events)
SELECT event_id, CASE WHEN raw = '' THEN '[]' WHEN json_valid(raw) THEN raw ELSE '["' || raw || '"]' END AS stored FROM r""")
def json_encode(spark, sf):
    raw = _list_text()
    return table(spark, sf, "events").select("event_id", quality.encode_json(raw, StringType()).alias("stored"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0.0 ELSE o_totalprice END AS rating,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(floor(o_totalprice) AS INT) END AS rating_count,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(floor(o_totalprice) AS INT) END AS social_shares,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS is_new, o_orderkey AS api_id FROM orders""")
def numeric_coercion(spark, sf):
    status = F.col("o_orderstatus")
    grouped = F.format_number(F.floor("o_totalprice"), 0)
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("rating"),
        F.when(status != "F", grouped).alias("rating_count"),
        F.when(status == "P", "many").otherwise(F.concat(grouped, F.lit(".9"))).alias("social_shares"),
        F.when(status == "O", 0).alias("is_new"),
        F.col("o_orderkey").cast("string").alias("api_id"),
    )
    return quality.coerce_records(rows)


@query(f"""WITH r AS (SELECT '{SITE}/episodes/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS url,
    'https://cdn.example/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || CASE WHEN l_quantity > 25 THEN '-720p.mp4' ELSE '-sd.mp4' END AS first,
    CASE WHEN l_quantity > 40 THEN '' ELSE 'https://cdn.example/HD/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey END AS second,
    l_returnflag AS f, l_quantity::INT AS n FROM lineitem), v AS (
  SELECT url, 0 AS pos, f, first AS file, n || ' MB' AS size, CASE WHEN f = 'N' THEN '1080' END AS known FROM r
  UNION ALL SELECT url, 1, f, second, '', NULL FROM r WHERE f = 'R')
SELECT url, pos, size, file, coalesce(known, CASE WHEN file = '' THEN 'unknown' WHEN contains(file, '1080') THEN '1080'
  WHEN contains(file, '720') THEN '720' WHEN contains(lower(file), 'hd') THEN '720' ELSE '480' END) AS quality FROM v""")
def video_list_normalize(spark, sf):
    rows = quality.coerce_records(video_files(spark, sf))
    rows = rows.select("url", F.posexplode("video_files").alias("pos", "v"))
    return rows.select("url", "pos", "v.size", F.col("v.url").alias("file"), "v.quality")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'episodes' WHEN 'N' THEN 'shows'
  ELSE CASE l_linestatus WHEN 'O' THEN 'movies' ELSE CASE WHEN l_linenumber < 3 THEN 'shows' WHEN l_linenumber < 5 THEN 'movies' END END END AS kind FROM lineitem""")
def item_type(spark, sf):
    flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select(
        *keys,
        F.when(flag == "A", f"{SITE}/tvshows/x").alias("show_url"),
        F.when(flag == "A", line).alias("episode_number"),
        F.when(flag == "N", line).alias("season_count"),
        F.when(status == "O", 2001).alias("year"),
        F.when(line < 3, f"{SITE}/series-1/x").when(line < 5, f"{SITE}/movies/x").otherwise(SITE).alias("url"),
    )
    return rows.select(*keys, quality.item_type(rows).alias("kind"))


_MOVIE_CHECK_SQL = f"""m AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '' WHEN p_type = 'SMALL' THEN 'ftp://x/' || p_partkey
    ELSE '{SITE}/movies/' || p_partkey END AS url, CASE WHEN p_size > 5 THEN p_name END AS title_en, p_retailprice / 100 AS rating,
    (p_size - 3)::INT AS rating_count, (1880 + p_size)::INT AS year FROM part),
e AS (SELECT p_partkey, unnest(list_filter([
    CASE WHEN url = '' THEN 'URL is required' END,
    CASE WHEN url <> '' AND NOT starts_with(url, 'http') THEN 'URL must start with http:// or https://' END,
    CASE WHEN title_en IS NULL THEN 'English title is required' END,
    CASE WHEN rating > 10 OR rating < 0 THEN 'Rating must be a number between 0 and 10' END,
    CASE WHEN rating_count < 0 THEN 'Rating count must be a non-negative integer' END,
    CASE WHEN year < 1900 OR year > 2100 THEN 'Year must be between 1900 and 2100' END], lambda x: x IS NOT NULL)) AS message FROM m)"""


def _checked(spark, sf):
    kind, key = F.col("p_type"), F.col("p_partkey")
    url = F.when(kind == "PROMO", "").when(kind == "SMALL", text("ftp://x/", key)).otherwise(text(f"{SITE}/movies/", key))
    rows = table(spark, sf, "part").select(
        "p_partkey",
        url.alias("url"),
        F.when(F.col("p_size") > 5, F.col("p_name")).alias("title_en"),
        (F.col("p_retailprice") / 100).alias("rating"),
        (F.col("p_size") - 3).alias("rating_count"),
        (F.col("p_size") + 1880).alias("year"),
    )
    return quality.validate(rows, "movies")


@query(f"WITH {_MOVIE_CHECK_SQL} SELECT p_partkey, message FROM e")
def validation_report(spark, sf):
    return _checked(spark, sf).select("p_partkey", F.explode("errors").alias("message"))


@query(f"WITH {_MOVIE_CHECK_SQL} SELECT message, count(*) AS n FROM e GROUP BY 1")
def validation_summary(spark, sf):
    return quality.validation_summary(_checked(spark, sf))


@query(f"""WITH {EPISODES_SQL}, o AS (SELECT l_returnflag AS f, CASE WHEN l_linestatus = 'F' AND l_quantity > 30 THEN '' ELSE
  '{SITE}/episodes/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey END AS url FROM lineitem)
SELECT url, CASE WHEN f = 'R' THEN 'season_number' ELSE '' END AS missing FROM o WHERE url <> ''""")
def required_fields(spark, sf):
    item = table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    gone = (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 30)
    rows = item.select(
        F.when(gone, "").otherwise(text(f"{SITE}/episodes/", key)).alias("url"),
        text(f"{SITE}/tvshows/", F.col("l_orderkey")).alias("show_url"),
        F.when(F.col("l_returnflag") != "R", 1).alias("season_number"),
        F.col("l_linenumber").alias("episode_number"),
    )
    kept = quality.require_fields(rows, "episodes")
    return kept.select("url", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {SHOWS_SQL} SELECT url, 1 AS is_new, 0 AS is_modified, 'fa' AS language_code, NULL::VARCHAR AS title_fa, title_en, lastmod FROM shows""")
def schema_conform(spark, sf):
    old = shows(spark, sf).select("url", "title_en", "lastmod")
    layout = StructType.fromDDL("url string, title_en string, title_fa string, lastmod string, is_new int, is_modified int, language_code string")
    return conform(conform(old, layout), layout)


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN string_split(p_name, ' ')[1] || '|' || string_split(p_name, ' ')[2] || '|' || p_brand
  ELSE string_split(p_name, ' ')[1] || '|' || string_split(p_name, ' ')[2] END AS names FROM part""")
def name_cleaning(spark, sf):
    words = F.split("p_name", " ")
    extra = F.when(F.col("p_size") > 25, F.array(F.concat("p_brand", F.lit(" ")), F.lit(" "))).otherwise(F.array(F.lit("")))
    raw = F.concat(words, extra, F.transform(words, lambda w: F.concat(F.lit("  "), w)))
    return table(spark, sf, "part").select("p_partkey", F.array_join(quality.clean_names(raw), "|").alias("names"))


# --- API posts ---


def _post(number, link, modified, title, acf, terms, media):
    """A post as the JSON text an API returns."""
    return text(
        '{"id":', number, ',"link":"', link, '","modified_gmt":"', modified, '","title":', F.to_json(F.struct(title.alias("rendered"))),
        ',"content":{"rendered":"<p>text</p>"},"acf":', acf, ',"_embedded":{"wp:term":', terms, ',"wp:featuredmedia":', media, "}}",
    )


def movie_posts(spark, sf):
    p = source(spark, sf, "part")
    words = F.split("p_name", " ")
    key, size = F.col("p_partkey"), F.col("p_size")
    fields = F.to_json(
        F.struct(
            F.lit("نام").alias("title_fa"),
            text("Jan 1, ", F.lit(1950) + size).alias("release_date"),
            F.col("p_retailprice").cast("string").alias("rating"),
            F.when(size > 25, "many").otherwise(size.cast("string")).alias("rating_count"),
            F.array(F.struct(F.lit("720").alias("quality"), text("https://cdn.example/", key).alias("url"))).alias("video_files"),
        )
    )
    terms = F.to_json(
        F.array(
            F.transform(words, lambda w: F.struct(w.alias("name"), F.lit("genres").alias("taxonomy"))),
            F.array(F.struct(F.col("p_brand").alias("name"), F.lit("director").alias("taxonomy"))),
            F.array(F.struct(F.col("p_type").alias("name"), F.lit("cast").alias("taxonomy"))),
        )
    )
    changed = F.when(size > 40, "unknown").otherwise(text(F.lit(1950) + size, "-06-01T00:00:00"))
    acf = F.when(F.col("p_type") == "SMALL", "[]").otherwise(fields)
    media = F.when(F.col("p_type") == "LARGE", "[]").otherwise(text('[{"source_url":"https://img.example/', key, '.jpg"}]'))
    return p.select(_post(key, text(f"{SITE}/movies/", key), changed, F.col("p_name"), acf, terms, media).alias("body"))


@query(f"""SELECT p_partkey AS api_id, '{SITE}/movies/' || p_partkey AS url, p_name AS title_en, '<p>text</p>' AS description, 1 AS is_modified,
  CASE WHEN p_type <> 'SMALL' THEN 'نام' END AS title_fa, CASE WHEN p_type <> 'SMALL' THEN (1950 + p_size)::INT END AS year,
  CASE WHEN p_type <> 'SMALL' THEN p_retailprice END AS rating, CASE WHEN p_type <> 'SMALL' THEN CASE WHEN p_size > 25 THEN 0 ELSE p_size END END AS rating_count,
  replace(p_name, ' ', '|') AS genres, p_brand AS directors, p_type AS cast, CASE WHEN p_type <> 'SMALL' THEN 'https://cdn.example/' || p_partkey END AS video,
  CASE WHEN p_type <> 'LARGE' THEN 'https://img.example/' || p_partkey || '.jpg' END AS poster
FROM part WHERE p_size > 40 OR 1950 + p_size >= 1970""")
def api_mapping(spark, sf):
    posts = landed.parse_posts(movie_posts(spark, sf))
    since = F.lit("1970-01-01").cast("timestamp")
    rows = api.map_posts(posts, "movies", since)
    return rows.select(
        "api_id", "url", "title_en", "description", "is_modified", "title_fa", "year", "rating", "rating_count",
        *[F.array_join(n, "|").alias(n) for n in ("genres", "directors", "cast")],
        F.get("video_files", F.lit(0))["url"].alias("video"), "poster",
    )


@query("""SELECT p_partkey AS id, w AS name, 'genres' AS field FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)
UNION ALL SELECT p_partkey, p_brand, 'directors' FROM part UNION ALL SELECT p_partkey, p_type, 'cast' FROM part""")
def taxonomy_split(spark, sf):
    posts = landed.parse_posts(movie_posts(spark, sf)).withColumn("every", api.terms(F.col("_embedded")))
    lists = [F.struct(F.lit(f).alias("field"), api.term_names(F.col("every"), t).alias("names")) for f, t in api.TAXONOMIES.items()]
    rows = posts.select("id", F.explode(F.array(*lists)).alias("l"))
    return rows.select("id", F.explode("l.names").alias("name"), "l.field")


@query(f"""SELECT o_orderkey AS api_id, '{SITE}/tvshows/' || o_orderkey AS url, 'Show ' || o_custkey AS title_en, CASE o_orderstatus WHEN 'P' THEN 'نام' END AS title_fa,
  o_custkey::INT AS season_count, CASE WHEN o_orderstatus = 'P' THEN 0 END AS episode_count, strftime(o_orderdate, '%Y-%m-%d') AS first_air_date FROM orders
WHERE o_orderpriority <> '1-URGENT' AND (o_custkey <> 0 OR o_orderstatus = 'P')""")
def api_mapping_shows(spark, sf):
    o = source(spark, sf, "orders")
    key, partial = F.col("o_orderkey"), F.col("o_orderstatus") == "P"
    fields = F.to_json(
        F.struct(
            F.when(partial, "نام").alias("title_fa"),
            F.col("o_custkey").alias("season_count"),
            F.when(partial, "none").alias("episode_count"),
            day("o_orderdate").alias("first_air_date"),
        )
    )
    acf = F.when(F.col("o_orderpriority") == "1-URGENT", "[]").otherwise(fields)
    title = text("Show ", F.col("o_custkey"))
    posts = o.select(_post(key, text(f"{SITE}/tvshows/", key), day("o_orderdate"), title, acf, F.lit("[]"), F.lit("[]")).alias("body"))
    rows = api.map_posts(landed.parse_posts(posts), "shows")
    return rows.select("api_id", "url", "title_en", "title_fa", "season_count", "episode_count", "first_air_date")


@query(f"""SELECT '{SITE}/episodes/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS url, l_suppkey AS api_id,
  CASE l_returnflag WHEN 'A' THEN l_linenumber WHEN 'N' THEN 1 END AS season_number, l_linenumber AS episode_number,
  'https://img.example/' || CASE WHEN l_returnflag = 'A' THEN 'acf' ELSE 'media' END AS thumbnail,
  l_orderkey AS show_id, '{SITE}/tvshows/' || l_orderkey AS show_url FROM lineitem""")
def api_mapping_episodes(spark, sf):
    item = source(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    fields = F.to_json(
        F.struct(
            F.when(flag == "A", line.cast("string")).when(flag == "N", "first").alias("season_number"),
            line.alias("episode_number"),
            F.when(flag == "A", "https://img.example/acf").alias("thumbnail"),
        )
    )
    show = F.struct(
        F.col("l_orderkey").alias("id"),
        F.lit("tvshows").alias("taxonomy"),
        text(f"{SITE}/tvshows/", F.col("l_orderkey")).alias("link"),
    )
    other = F.struct(F.lit(0).cast("bigint").alias("id"), F.lit("tvshows").alias("taxonomy"), F.lit("x").alias("link"))
    terms = F.to_json(F.array(F.array(other), F.array(show)))
    media = F.lit('[{"source_url":"https://img.example/media"}]')
    body = _post(F.col("l_suppkey"), text(f"{SITE}/episodes/", key), day("l_shipdate"), text("Episode ", line), fields, terms, media)
    rows = api.map_posts(landed.parse_posts(item.select(body.alias("body"))), "episodes")
    return rows.select("url", "api_id", "season_number", "episode_number", "thumbnail", "show_id", "show_url")


@query("""SELECT p_partkey, p_size >= 10 AS complete, p_size >= 10 AND p_type <> 'SMALL' AND p_name <> 'red plate' AND p_brand <> 'Brand#1' AS complete_show FROM part""")
def api_completeness(spark, sf):
    acf = F.when(F.col("p_type") == "SMALL", "[]").when(F.col("p_brand") == "Brand#1", '{"season_count": 0}')
    posts = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") >= 10, "x").alias("link"),
        F.struct(F.when(F.col("p_name") != "red plate", F.col("p_name")).otherwise("").alias("rendered")).alias("title"),
        acf.otherwise('{"season_count": "2"}').alias("acf"),
    )
    return posts.select(
        "p_partkey", api.is_complete("movies").alias("complete"), api.is_complete("shows").alias("complete_show")
    )


@query("SELECT o_custkey AS page, strftime(max(o_orderdate) FILTER (o_orderstatus <> 'P'), '%Y-%m-%d') AS newest FROM orders GROUP BY 1")
def page_max_modified(spark, sf):
    changed = F.when(F.col("o_orderstatus") == "P", "?").otherwise(day("o_orderdate"))
    posts = table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), changed.alias("modified_gmt"))
    return api.newest_per_page(posts).withColumn("newest", day("newest"))


# --- upserts and flags ---

_UPSERT_SQL = f"""{SHOWS_SQL}, old AS (SELECT rtrim(url, '/') AS url, title_en, lastmod, source, is_new, api_id, 0 AS is_modified FROM shows WHERE lastmod < '2000-01-01'),
batch AS (SELECT '{SITE}/tvshows/' || l_orderkey AS url, arg_max(l_returnflag, place) AS source,
    CASE WHEN arg_max(l_returnflag, place) = 'R' THEN NULL WHEN arg_max(l_returnflag, place) = 'A' THEN arg_max(ordered, place)
    ELSE arg_max(shipped, place) END AS lastmod
  FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS shipped, strftime(o_orderdate, '%Y-%m-%d') AS ordered,
    strftime(l_shipdate, '%Y-%m-%d') || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS place
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY l_orderkey),
merged AS (SELECT url, o.title_en, CASE WHEN b.url IS NULL THEN o.lastmod ELSE b.lastmod END AS lastmod,
    CASE WHEN b.url IS NULL THEN o.source ELSE b.source END AS source, o.api_id, o.is_modified,
    CASE WHEN b.url IS NULL THEN o.is_new WHEN o.url IS NULL THEN 1 WHEN o.lastmod IS DISTINCT FROM b.lastmod THEN 1 ELSE o.is_new END AS is_new,
    CASE WHEN b.url IS NOT NULL THEN '2002-01-01' END AS last_scraped
  FROM old o FULL JOIN batch b USING (url))"""


def upsert_inputs(spark, sf):
    """Shows known before 2000, and a later batch with one record per order line."""
    old = shows(spark, sf).filter("lastmod < '2000-01-01'").withColumn("url", urls.strip_slash(F.col("url")))
    old = old.withColumn("is_modified", F.lit(0)).withColumn("last_scraped", F.lit(None).cast("string"))
    item = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = F.col("l_returnflag")
    batch = item.select(
        text(f"{SITE}/tvshows/", F.col("l_orderkey"), "/").alias("url"),
        flag.alias("source"),
        F.when(flag == "A", day("o_orderdate")).when(flag == "N", day("l_shipdate")).alias("lastmod"),
        F.lit(1).alias("is_new"),
        F.concat_ws("/", day("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey").alias("pos"),
    )
    return old, batch


def _merged(spark, sf):
    old, batch = upsert_inputs(spark, sf)
    return upsert.upsert(old, batch, F.lit("2002-01-01"))


@query(f"WITH {_UPSERT_SQL} SELECT url, title_en, lastmod, source, api_id, is_new, last_scraped FROM merged")
def upsert_change_flags(spark, sf):
    return _merged(spark, sf).drop("is_modified")


@query(f"""WITH {_UPSERT_SQL} SELECT url, is_new, (SELECT count(*) FROM lineitem WHERE url = '{SITE}/tvshows/' || l_orderkey)::INT AS episode_count FROM merged""")
def upsert_then_counts(spark, sf):
    rows = upsert.episode_counts(_merged(spark, sf), episodes(spark, sf).select("show_url"))
    return rows.select("url", "is_new", "episode_count")


@query(f"""WITH {_UPSERT_SQL} SELECT url, CASE WHEN source = 'A' THEN 0 ELSE is_new END AS is_new,
  CASE WHEN lastmod >= '2001-01-01' THEN 1 ELSE is_modified END AS is_modified FROM merged""")
def mark_flags(spark, sf):
    rows = _merged(spark, sf)
    marked = upsert.mark_processed(rows, rows.filter("source = 'A'"))
    marked = upsert.mark_modified(marked, rows.filter("lastmod >= '2001-01-01'"))
    same = upsert.set_flag(marked, rows, "no_such_flag", 1)
    return same.select("url", "is_new", "is_modified")


@query(f"WITH {SHOWS_SQL} SELECT url, lastmod FROM shows WHERE is_new = 1 ORDER BY url LIMIT 100")
def flag_scan(spark, sf):
    return upsert.flagged(shows(spark, sf), "is_new", 100).select("url", "lastmod")


@query(f"WITH {EPISODES_SQL} SELECT rtrim(show_url, '/') AS url, count(*)::INT AS episode_count FROM episodes GROUP BY 1 "
       f"UNION ALL SELECT '{SITE}/tvshows/' || o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")  # fmt: skip
def episode_counts(spark, sf):
    rows = upsert.episode_counts(shows(spark, sf), episodes(spark, sf).select("show_url"))
    return rows.select(urls.strip_slash(F.col("url")).alias("url"), "episode_count")
