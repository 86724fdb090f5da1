"""Queries on text, URL, media and number projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.functions import dates, media, numbers, urls
from playbill.functions import text as tx
from playbill.plans.registry import query
from playbill.plans.roles import (
    PAGE_URLS_SQL,
    PAGES_SQL,
    SITE,
    day,
    origin_sql,
    page_urls,
    pages,
    path_sql,
    persian,
    tail_sql,
    text,
)
from playbill.session import table
from playbill.sources import xml

_P, _L = tx.PERSIAN_DIGITS, tx.LATIN_DIGITS


@query(f"""WITH {PAGES_SQL}, r AS (
  SELECT page_id, {origin_sql('url')} AS o, {path_sql('url')} AS p, {tail_sql('url')} AS t,
    regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pg)
SELECT page_id, o || rtrim(lower(p), '/') || t AS full_url, rtrim(o || translate(p, '{_L}', '{_P}') || t, '/') AS plain_url,
  o || rtrim(p, '/') || t AS quoted_url, '{SITE}' || rtrim('/movies/' || lower(h1), '/') AS title_url FROM r""")
def url_normalize(spark, sf):
    df = pages(spark, sf)
    url = F.col("url")
    raw = F.concat(urls.url_origin(url), persian(urls.url_path(url)), urls.url_tail(url))
    h1 = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    titled = F.concat(F.lit("/Movies/"), urls.percent_encode(h1))
    return df.select(
        "page_id",
        urls.normalize_url(raw, nfkc=True, lower=True).alias("full_url"),
        urls.strip_slash(raw).alias("plain_url"),
        urls.normalize_url(raw, requote=True).alias("quoted_url"),
        urls.normalize_url(titled, base=SITE, nfkc=True, lower=True).alias("title_url"),
    )


def _type_sql(n: str) -> str:
    lists = f"string_split(lower({path_sql(n)}), '/')"
    return f"""CASE
  WHEN regexp_matches({n}, '^https?://[^/]+/(movies|movies-\\d{{4}}|old-iranian-movies)/[^/]+/?$') THEN 'movies'
  WHEN regexp_matches({n}, '^https?://[^/]+/[^/]+/?\\?post_type=movies') THEN 'movies'
  WHEN regexp_matches({n}, '^https?://[^/]+/(tvshows|series-\\d+|iranian-series)/[^/]+/?$') THEN 'shows'
  WHEN regexp_matches({n}, '^https?://[^/]+/[^/]+/?\\?post_type=tvshows') THEN 'shows'
  WHEN regexp_matches({n}, '^https?://[^/]+/episodes/[^/]+/?($|\\?)') THEN 'episodes'
  WHEN regexp_matches({n}, '^https?://[^/]+/[^/]+/?\\?post_type=episodes') THEN 'episodes'
  WHEN list_contains({lists}, 'movies') THEN 'movies'
  WHEN list_contains({lists}, 'tvshows') OR list_contains({lists}, 'series') THEN 'shows'
  WHEN list_contains({lists}, 'episodes') THEN 'episodes' END"""


def _category_sql(n: str) -> str:
    return f"""CASE
  WHEN regexp_matches({n}, '/(genres|dtcast|dtdirector|dtcreator|dtstudio|dtnetworks|dtyear)/') THEN NULL
  WHEN regexp_matches({n}, '/(movies|movies-\\d{{4}}|old-iranian-movies)/[^/]+/?$') THEN 'movies'
  WHEN regexp_matches({n}, '/(tvshows|series-22|iranian-series)/[^/]+/?$') THEN 'shows'
  WHEN regexp_matches({n}, '/episodes/[^/]+/?$') THEN 'episodes'
  WHEN contains({path_sql(n)}, '/movies/') THEN 'movies'
  WHEN contains({path_sql(n)}, '/tvshows/') THEN 'shows'
  WHEN contains({path_sql(n)}, '/episodes/') THEN 'episodes' END"""


@query(f"""WITH {PAGE_URLS_SQL}
SELECT page_id, {_category_sql('url')} AS category, {_type_sql('url')} AS content_type,
  CASE WHEN regexp_matches(url, '^https?://[^/]+/movies/[^/]+/?$') THEN 'movies'
    WHEN regexp_matches(url, '^https?://[^/]+/episodes/[^/]+/?$') THEN 'episodes'
    WHEN regexp_matches(url, '^https?://[^/]+/tvshows/[^/]+/?$') THEN 'shows'
    WHEN contains(lower(url), '/movies/') THEN 'movies' WHEN contains(lower(url), '/episodes/') THEN 'episodes'
    WHEN contains(lower(url), '/tvshows/') OR contains(lower(url), '/series') THEN 'shows' END AS start_type,
  contains(url, '/genres/') AS is_taxonomy FROM pu""")
def url_category(spark, sf):
    url = F.col("url")
    return page_urls(spark, sf).select(
        "page_id",
        urls.sitemap_category(url).alias("category"),
        urls.content_type(url).alias("content_type"),
        urls.start_url_type(url).alias("start_type"),
        urls.is_taxonomy_url(url).alias("is_taxonomy"),
    )


@query(f"""WITH {PAGE_URLS_SQL} SELECT page_id, coalesce(({_type_sql('url')}) = 'movies', false) AS is_movie,
  coalesce(({_type_sql('url')}) = 'shows', false) AS is_show,
  coalesce(({_type_sql('url')}) = 'episodes', false) AS is_episode FROM pu""")
def url_validity(spark, sf):
    url = F.col("url")
    return page_urls(spark, sf).select(
        "page_id",
        urls.is_content_url(url, F.lit("movies")).alias("is_movie"),
        urls.is_content_url(url, F.lit("shows")).alias("is_show"),
        urls.is_content_url(url, F.lit("episodes")).alias("is_episode"),
    )


@query(f"""WITH {PAGE_URLS_SQL} SELECT page_id, coalesce(
  nullif(regexp_extract(url, '^https?://[^/]+/movies/([^/]+)/?$', 1), ''),
  nullif(regexp_extract(url, '^https?://[^/]+/tvshows/([^/]+)/?$', 1), ''),
  nullif(regexp_extract(url, '^https?://[^/]+/episodes/([^/]+)/?$', 1), ''),
  nullif(string_split(trim({path_sql('url')}, '/'), '/')[-1], '')) AS slug FROM pu""")
def slug_extract(spark, sf):
    return page_urls(spark, sf).select("page_id", urls.slug_of(F.col("url")).alias("slug"))


@query(f"""SELECT doc_id, '{SITE}/' || CASE lang WHEN 'en' THEN 'movies/' WHEN 'fr' THEN 'tvshows/'
  WHEN 'de' THEN 'episodes/' ELSE '' END || replace(url_encode(text), '%2F', '/') AS url FROM documents""")
def url_build(spark, sf):
    lang = F.col("lang")
    kind = F.when(lang == "en", "movies").when(lang == "fr", "shows").when(lang == "de", "episodes").otherwise("")
    built = urls.build_url(kind, F.col("text"), SITE)
    return table(spark, sf, "documents").select("doc_id", built.alias("url"))


@query(f"""WITH {PAGES_SQL}, r AS (SELECT page_id, url, {origin_sql('url')} AS o, {path_sql('url')} AS p,
    regexp_extract(html, '<a href="([^"]*)"', 1) AS href FROM pg)
SELECT page_id, o || href AS from_root, o || regexp_replace(p, '[^/]*$', '') || 'rel/' || page_id || '?q=1' AS from_folder,
  o || regexp_replace(p, '[^/]*/[^/]*$', '') || page_id AS from_parent, o || p || '?q=1' AS from_query,
  regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example/' || page_id AS from_scheme FROM r""")
def absolute_url(spark, sf):
    url, page = F.col("url"), F.col("page_id")
    href = F.regexp_extract("html", '<a href="([^"]*)"', 1)
    return pages(spark, sf).select(
        "page_id",
        urls.absolute_url(href, url).alias("from_root"),
        urls.absolute_url(text("rel/", page, "?q=1"), url).alias("from_folder"),
        urls.absolute_url(text("./../", page), url).alias("from_parent"),
        urls.absolute_url(F.lit("?q=1"), url).alias("from_query"),
        urls.absolute_url(text("//cdn.example/", page), url).alias("from_scheme"),
    )


@query(f"""WITH {PAGES_SQL}, r AS (SELECT page_id, CASE lang WHEN 'en' THEN '/movies/film-' || page_id || '/'
    WHEN 'fr' THEN '/?p=' || page_id WHEN 'de' THEN '/film-' || page_id || '-end/' ELSE '/' || page_id || '/' END AS u,
    lang FROM pg)
SELECT page_id, CASE WHEN lang <> 'en' THEN page_id END AS api_post_id,
  CASE WHEN lang <> 'es' THEN page_id END AS sitemap_post_id, CASE WHEN lang <> 'en' THEN page_id END AS feed_post_id FROM r""")
def post_id_extract(spark, sf):
    page, lang = F.col("page_id"), F.col("lang")
    path = (
        F.when(lang == "en", text("/movies/film-", page, "/"))
        .when(lang == "fr", text("/?p=", page))
        .when(lang == "de", text("/film-", page, "-end/"))
        .otherwise(text("/", page, "/"))
    )
    url = F.concat(F.lit(SITE), path)
    return pages(spark, sf).select(
        "page_id",
        urls.post_id(url, "api").alias("api_post_id"),
        urls.post_id(url, "sitemap").alias("sitemap_post_id"),
        urls.feed_item_id(F.when(lang == "fr", url), url).alias("feed_post_id"),
    )


@query(f"""WITH {PAGES_SQL}, r AS (SELECT page_id, url, {path_sql('url')} AS p FROM pg)
SELECT page_id, regexp_replace(left(regexp_replace(regexp_extract(url, '://([^/:?#]*)', 1), '[^a-zA-Z0-9]', '_', 'g'), 20)
  || '_' || left(regexp_replace(trim(p, '/'), '[^a-zA-Z0-9]', '_', 'g'), 30) || '_' || left(md5(url), 12), '_+', '_', 'g') AS key
FROM r""")
def cache_slug_key(spark, sf):
    url = F.col("url")
    raw = F.concat(urls.url_origin(url), urls.percent_encode(persian(urls.url_path(url))), urls.url_tail(url))
    return pages(spark, sf).select("page_id", urls.cache_key(raw, nfkc=True).alias("key"))


_QUALITY_URL = """'https://cdn.example/' || replace(p_name, ' ', '_') || CASE p_type
    WHEN 'ECONOMY' THEN '/' || (p_size * 40) || 'p/x.mp4' WHEN 'MEDIUM' THEN '.' || (100 + p_size * 40) || 'p.mp4'
    WHEN 'STANDARD' THEN '_' || (100 + p_size * 90) || '_v.mp4' WHEN 'SMALL' THEN '/FullHD/v.mp4'
    WHEN 'PROMO' THEN '?quality=' || (90 * p_size + 99) ELSE '/' || p_partkey || '.mp4' END"""


def _bucket_sql(q: str) -> str:
    steps = " ".join(f"WHEN {q} <= {s} THEN '{s}'" for s in media.STANDARD_QUALITIES[:-1])
    return f"CASE WHEN {q} < 1 THEN NULL {steps} WHEN {q} IS NOT NULL THEN '4320' END"


_BUCKETS = ", ".join(
    _bucket_sql(f"TRY_CAST(nullif(regexp_extract(u, '{p}', 1), '') AS INT)") for p in media.QUALITY_PATTERNS
)


@query(f"""WITH r AS (SELECT p_partkey, p_type, {_QUALITY_URL} AS u FROM part)
SELECT p_partkey, coalesce({_BUCKETS},
  CASE WHEN contains(lower(u), 'ultrahd') THEN '2160' WHEN contains(lower(u), 'medium') THEN '720'
    WHEN contains(lower(u), 'fullhd') THEN '1080' WHEN contains(lower(u), 'high') THEN '1080'
    WHEN contains(lower(u), 'low') THEN '480' WHEN contains(lower(u), 'hd') THEN '720'
    WHEN contains(lower(u), '4k') THEN '2160' WHEN contains(lower(u), '8k') THEN '4320' END, 'unknown') AS quality,
  CASE WHEN contains(lower(u), '1080') THEN '1080' WHEN contains(lower(u), '720') THEN '720'
    WHEN contains(lower(u), 'hd') THEN '720' ELSE '480' END AS quick,
  CASE WHEN regexp_matches(lower(u), 'hd|720|1080') THEN '720' ELSE '480' END AS on_cdn FROM r""")
def quality_detect(spark, sf):
    size, kind = F.col("p_size"), F.col("p_type")
    tail = (
        F.when(kind == "ECONOMY", text("/", size * 40, "p/x.mp4"))
        .when(kind == "MEDIUM", text(".", size * 40 + 100, "p.mp4"))
        .when(kind == "STANDARD", text("_", size * 90 + 100, "_v.mp4"))
        .when(kind == "SMALL", F.lit("/FullHD/v.mp4"))
        .when(kind == "PROMO", text("?quality=", size * 90 + 99))
        .otherwise(text("/", F.col("p_partkey"), ".mp4"))
    )
    url = F.concat(F.lit("https://cdn.example/"), F.replace("p_name", F.lit(" "), F.lit("_")), tail)
    return table(spark, sf, "part").select(
        "p_partkey",
        media.quality_from_url(url).alias("quality"),
        media.quick_quality(url).alias("quick"),
        media.quality_from_url(url, ("cdn.example",)).alias("on_cdn"),
    )


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '480' WHEN 'MEDIUM' THEN '720' WHEN 'STANDARD' THEN '1080'
  WHEN 'SMALL' THEN '2160' WHEN 'PROMO' THEN CAST(p_size AS VARCHAR) ELSE 'best' END AS quality FROM part""")
def quality_labels(spark, sf):
    kind = F.col("p_type")
    label = (
        F.when(kind == "ECONOMY", "SD")
        .when(kind == "MEDIUM", "HD")
        .when(kind == "STANDARD", "FullHD")
        .when(kind == "SMALL", "4K")
        .when(kind == "PROMO", text(F.col("p_size"), "p"))
        .otherwise("best")
    )
    return table(spark, sf, "part").select("p_partkey", media.standard_quality(label).alias("quality"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate - INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M')
  ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS parsed,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate - INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M')
    WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS iso FROM orders""")
def date_multiformat(spark, sf):
    level, d = F.col("o_orderpriority"), F.col("o_orderdate")
    written = (
        F.when(level == "1-URGENT", day(d))
        .when(level == "2-HIGH", F.date_format(d, "yyyy/M/d"))
        .when(level == "3-MEDIUM", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'+00:30'"))
        .when(level == "4-NOT SPECIFIED", F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "dd-MM-yyyy"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format(dates.any_date(written), "yyyy-MM-dd HH:mm").alias("parsed"),
        F.date_format(dates.iso_timestamp(written), "yyyy-MM-dd HH:mm").alias("iso"),
    )


@query("""WITH r AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'G-Recaptcha ' WHEN 'fr' THEN 'h-captcha ' WHEN 'de'
    THEN 'Security Code ' ELSE '' END || text AS html FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(lower(html), 'google\\.com/recaptcha|g-recaptcha|grecaptcha|recaptcha/api\\.js') THEN 'recaptcha'
    WHEN regexp_matches(lower(html), 'hcaptcha\\.com|h-captcha|hcaptcha-widget') THEN 'hcaptcha'
    WHEN regexp_matches(lower(html), 'captcha|security code|security image|verify you are human|verification required') THEN 'simple'
    ELSE '' END AS label,
  regexp_matches(lower(html), 'captcha|verification required|verify you are human|security check|bot protection') AS blocked
FROM r""")
def blocked_page_labels(spark, sf):
    lang = F.col("lang")
    mark = F.when(lang == "en", "G-Recaptcha ").when(lang == "fr", "h-captcha ").when(lang == "de", "Security Code ")
    html = F.concat(mark.otherwise(""), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", tx.challenge_label(html).alias("label"), tx.is_blocked(html).alias("blocked")
    )


@query(f"""WITH r AS (SELECT p_partkey, replace(p_name, ' ', '-') AS s, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' ' || p_partkey AS title,
  '{SITE}/tvshows/' || w[1] AS parent FROM r""")
def title_and_parent_guess(spark, sf):
    url = F.concat_ws("-", text(f"{SITE}/episodes/", F.replace("p_name", F.lit(" "), F.lit("-"))), "p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", tx.title_from_slug(url).alias("title"), urls.guessed_parent(url).alias("parent")
    )


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'P' THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS INT) AS year,
  CAST(o_custkey AS DOUBLE) / 2 AS rating, CAST(floor(o_totalprice) AS INT) AS votes,
  CAST(o_custkey AS INT) AS comments, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(floor(o_totalprice) AS INT) END AS shares
FROM orders""")
def year_and_numbers(spark, sf):
    status, date = F.col("o_orderstatus"), F.col("o_orderdate")
    price = F.format_number(F.floor("o_totalprice"), 0)
    released = F.when(status != "P", F.date_format(date, "'Released on 'dd MMM yyyy"))
    url = text(f"{SITE}/movies-", F.year(date) + 1, "/x")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        numbers.release_year(released, url).alias("year"),
        numbers.first_number(text("Rated ", F.col("o_custkey") / 2, " of 10")).alias("rating"),
        numbers.counted(text("about ", price, " votes")).alias("votes"),
        numbers.parenthesised(text("Comments (", F.col("o_custkey"), ")")).alias("comments"),
        numbers.whole_number(F.when(status == "F", text(price, " shares")).otherwise(text(" ", price))).alias("shares"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber = 1 THEN 4 ELSE l_linenumber END ELSE 4 END AS season,
  CASE l_returnflag WHEN 'A' THEN CASE WHEN l_quantity = 1 THEN CASE WHEN l_linenumber = 1 THEN l_suppkey ELSE l_linenumber END
    ELSE l_quantity END WHEN 'N' THEN CASE WHEN l_linenumber = 1 THEN l_suppkey ELSE l_linenumber END ELSE l_suppkey END::INT AS episode
FROM lineitem""")
def numbering(spark, sf):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    label = F.when(flag == "A", text(line, " - ", F.col("l_quantity").cast("int"))).when(flag == "N", "Special - x - 2")
    crumbs = F.array(F.lit("Home"), F.lit("Season 9"), F.lit("season 4 of many"))
    url = F.when(flag == "R", F.lit(f"{SITE}/special")).otherwise(text(f"{SITE}/show-Ep", line))
    title = text("The Episode ", F.col("l_suppkey"))
    season, episode = numbers.episode_numbering(label, crumbs, url, title)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", season.alias("season"), episode.alias("episode")
    )


@query("""SELECT doc_id, text || ' ' || lang AS body, '["' || lang || '","' || source || '"]' AS tags, n_chars AS n_chars,
  '2024-01-02T03:04:05' AS seen FROM documents""")
def text_sanitize(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat("text", F.char(F.lit(0)), "lang").alias("body"),
        F.array("lang", "source").alias("tags"),
        "n_chars",
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("seen"),
    )
    return docs.select(
        *[tx.sanitize_value(F.col(f.name), f.dataType).alias(f.name) for f in docs.schema.fields]
    )


# Full-width letters and digits, which NFKC maps back to the plain ones.
_PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789"
_WIDE = "".join(chr(ord(ch) + 0xFEE0) for ch in _PLAIN)


@query("SELECT doc_id, lower(nfc_normalize(text)) || ' ' || n_chars AS body, nfc_normalize(text) AS kept FROM documents")
def nfkc_text(spark, sf):
    wide = F.translate("text", _PLAIN, _WIDE)
    return table(spark, sf, "documents").select(
        "doc_id",
        tx.normalize_text(F.concat(wide, F.lit(" "), persian(F.col("n_chars").cast("string"))), lower=True).alias("body"),
        tx.normalize_text(wide).alias("kept"),
    )


@query(f"""WITH {PAGES_SQL}, r AS (SELECT page_id, lang, {origin_sql('url')} AS o, url FROM pg), s AS (
  SELECT page_id, o || CASE lang WHEN 'en' THEN '/movies-sitemap' WHEN 'fr' THEN '/tvshows-sitemap' WHEN 'de' THEN '/post-sitemap'
    ELSE '/post_tag-sitemap' END || page_id || '.xml' AS url,
    CASE lang WHEN 'en' THEN 'movies' WHEN 'fr' THEN 'shows' WHEN 'de' THEN 'general' ELSE 'post_tag' END AS type,
    CASE WHEN ends_with(url, '/') THEN NULL ELSE '2024-01-01' END AS lastmod FROM r)
SELECT url, type, lastmod, CASE type WHEN 'movies' THEN 1 WHEN 'shows' THEN 2 WHEN 'general' THEN 4 ELSE 999 END AS priority,
  type IN ('movies', 'shows', 'episodes', 'general') AS has_content FROM s""")
def sitemap_type_priority(spark, sf):
    lang, url = F.col("lang"), F.col("url")
    name = (
        F.when(lang == "en", "/movies-sitemap")
        .when(lang == "fr", "/tvshows-sitemap")
        .when(lang == "de", "/post-sitemap")
        .otherwise("/post_tag-sitemap")
    )
    rows = pages(spark, sf).select(
        F.concat(urls.url_origin(url), name, F.col("page_id").cast("string"), F.lit(".xml")).alias("loc"),
        F.when(~url.endswith("/"), "2024-01-01").alias("lastmod"),
    )
    index = xml.sitemap_index(rows)
    kept = xml.content_sitemaps(index).select("url", F.lit(True).alias("has_content"))
    flagged = index.join(kept, "url", "left").withColumn("has_content", F.coalesce("has_content", F.lit(False)))
    return xml.in_priority_order(flagged)


