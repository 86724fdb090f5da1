"""Queries on the end-to-end flows and the table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.operators import flows, html, projections, stats
from playbill.plans.catalogue import ts
from playbill.plans.documents import movie_posts
from playbill.plans.landing import _SITEMAP_SQL, _sitemap_documents
from playbill.plans.registry import query
from playbill.plans.roles import EPISODES_SQL, PAGES_SQL, SHOWS_SQL, SITE, episodes, norm_sql, pages, path_sql, persian, shows, source, tail_sql, text
from playbill.schemas import conform, schema_of
from playbill.session import table
from playbill.sources import landed, xml


@query(f"""WITH {PAGES_SQL} SELECT page_id, {norm_sql('url')} AS clean_url, CASE lang WHEN 'en' THEN 'movies' WHEN 'fr' THEN 'shows' WHEN 'es' THEN 'episodes' END AS category,
  string_split(trim({path_sql('url')}, '/'), '/')[-1] || {tail_sql('url')} AS slug FROM pg WHERE lang <> 'de'""")
def clean_and_classify(spark, sf):
    rows = pages(spark, sf).select("page_id", "url")
    raw = F.concat(urls.url_origin(F.col("url")), persian(urls.url_path(F.col("url"))), urls.url_tail(F.col("url")))
    jobs = projections.classify_urls(projections.clean_urls(rows.withColumn("url", raw)))
    # On these URLs the slug of a content pattern runs to the end, query included.
    return jobs.filter(F.col("category").isNotNull()).select("page_id", "clean_url", "category", "slug")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS released, year(o_orderdate)::INT AS year, o_custkey / 10 AS rating_value,
  floor(o_totalprice)::INT AS vote_count, CASE WHEN o_orderstatus = 'P' THEN '1080' ELSE '480' END AS quality FROM orders""")
def derived_numbers(spark, sf):
    price = F.format_number(F.floor("o_totalprice"), 0)
    quality = F.when(F.col("o_orderstatus") == "P", "1080p").otherwise("480p")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        text("https://cdn.example/", quality, "/a.mp4").alias("url"),
        persian(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("released_text"),
        persian(text("IMDb ", F.col("o_custkey") / 10)).alias("rating_text"),
        persian(text(price, " votes")).alias("votes_text"),
    )
    rows = projections.derive_numbers(rows, "released_text", "rating_text", "votes_text")
    rows = projections.derive_media(rows)
    released = F.date_format("released_at", "yyyy-MM-dd").alias("released")
    return rows.select("o_orderkey", released, "year", "rating_value", "vote_count", "quality")


_LISTED_SQL = f"listed AS (SELECT {norm_sql('url')} AS url FROM pg WHERE length(html) > 2500)"


def _listed(spark, sf):
    return pages(spark, sf).filter(F.length("html") > 2500).select(urls.normalize_url(F.col("url")).alias("url"))


@query(f"""WITH {_SITEMAP_SQL}, {_LISTED_SQL}, kept AS (SELECT * FROM entries WHERE category IS NOT NULL AND url NOT IN (SELECT url FROM listed)),
lists AS (SELECT category, false AS is_modified, url, lastmod, page_id * 10 + pos AS pos FROM kept
  UNION ALL SELECT category, true, url, lastmod, page_id * 10 + pos FROM kept WHERE is_modified)
SELECT category, is_modified, url, arg_max(lastmod, (coalesce(lastmod, ''), -pos)) AS lastmod, arg_max(pos, (coalesce(lastmod, ''), -pos)) AS pos
FROM lists GROUP BY category, is_modified, url""")
def sitemap_refresh(spark, sf):
    rows = xml.document_entries(_sitemap_documents(spark, sf))
    rows = rows.withColumn("pos", F.col("page_id") * 10 + F.col("pos")).drop("page_id")
    parsed = flows.refresh_sitemaps(rows, _listed(spark, sf), ts("2005-01-01"))
    return parsed.drop("api_id")


@query(f"""WITH {_SITEMAP_SQL}, {_LISTED_SQL}, kept AS (SELECT DISTINCT category, url, is_modified FROM entries WHERE category IS NOT NULL AND url NOT IN (SELECT url FROM listed)),
c AS (SELECT category, count(DISTINCT url) AS total, count(DISTINCT url) FILTER (is_modified) AS modified FROM kept GROUP BY 1)
SELECT * FROM c UNION ALL SELECT 'all', sum(total)::BIGINT, sum(modified)::BIGINT FROM c""")
def sitemap_refresh_stats(spark, sf):
    rows = xml.document_entries(_sitemap_documents(spark, sf)).withColumn("pos", F.col("page_id") * 10 + F.col("pos"))
    parsed = flows.refresh_sitemaps(rows, _listed(spark, sf), ts("2005-01-01"))
    # A modified URL stands in both lists; its row in the full list carries the flag here.
    one = parsed.groupBy("category", "url").agg(F.bool_or("is_modified").alias("is_modified"), F.min("pos").alias("pos"))
    return stats.category_stats(one).drop("sample_urls")


@query(f"""WITH {_SITEMAP_SQL}, {_LISTED_SQL} SELECT count(*) FILTER (category IS NULL) AS url, count(*) FILTER (url IN (SELECT url FROM listed)) AS blacklisted,
  count(*) FILTER (bad_lastmod) AS lastmod FROM entries""")
def sitemap_counters(spark, sf):
    rows = xml.document_entries(_sitemap_documents(spark, sf))
    return flows.sitemap_counters(rows, _listed(spark, sf), ts("2005-01-01"))


@query(f"""WITH api AS (SELECT p_partkey AS k, p_name AS title_en, CASE WHEN p_size > 40 THEN 'unknown' ELSE (1950 + p_size) || '-06-01T00:00:00' END AS lastmod,
    CASE WHEN p_type <> 'SMALL' THEN p_retailprice END AS rating, 'api' AS source FROM part WHERE p_size > 40 OR 1950 + p_size >= 1970),
page AS (SELECT p_partkey AS k, 'Page of ' || p_name AS title_en, 'html_extraction' AS source FROM part),
old AS (SELECT DISTINCT l_partkey AS k, '1960-06-01T00:00:00' AS lastmod FROM lineitem)
SELECT '{SITE}/movies/' || page.k AS url, coalesce(api.title_en, page.title_en) AS title_en, coalesce(api.lastmod, every.lastmod) AS lastmod, rating,
  coalesce(api.source, page.source) AS source, CASE WHEN old.k IS NULL THEN 1 WHEN old.lastmod IS DISTINCT FROM api.lastmod THEN 1 ELSE 0 END AS is_new,
  '2024-01-01' AS last_scraped, CASE WHEN old.k IS NOT NULL THEN 'stored' END AS sitemap_url
FROM page LEFT JOIN api USING (k) LEFT JOIN old USING (k) LEFT JOIN (SELECT p_partkey AS k, (1950 + p_size) || '-06-01T00:00:00' AS lastmod FROM part) every USING (k)
WHERE api.k IS NOT NULL OR old.k IS NULL
UNION ALL SELECT '{SITE}/movies/' || k, NULL, lastmod, NULL, NULL, 0, NULL, 'stored' FROM old WHERE k NOT IN (SELECT k FROM api)""")
def catalogue_build(spark, sf):
    key = F.col("p_partkey")
    crawled = source(spark, sf, "part").select(
        text(f"{SITE}/movies/", key, "/").alias("url"), text("<div class=data><h1>Page of ", F.col("p_name"), "</h1></div>").alias("html")
    )
    records = html.extract(crawled, "movies", ["title_en", "poster", "genres"]).withColumn("source", F.lit("html_extraction"))
    old = table(spark, sf, "lineitem").select(text(f"{SITE}/movies/", F.col("l_partkey")).alias("url")).distinct()
    old = old.withColumns({"lastmod": F.lit("1960-06-01T00:00:00"), "is_new": F.lit(0), "sitemap_url": F.lit("stored")})
    existing = conform(old, schema_of("movies"), {})
    # Links with a slash, and every post twice, as API pages overlap.
    posts = landed.parse_posts(movie_posts(spark, sf)).withColumn("link", F.concat("link", F.lit("/")))
    posts = posts.unionAll(posts)
    built = flows.build_catalogue("movies", posts, records, existing, F.lit("2024-01-01"), ts("1970-01-01"))
    return built.select("url", "title_en", "lastmod", "rating", "source", "is_new", "last_scraped", "sitemap_url")


_ROUND_SQL = """marker AS (SELECT event_type AS feed, max(event_id) AS m FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1),
fresh AS (SELECT e.* FROM events e JOIN marker ON feed = event_type AND event_id > m),
todo AS (SELECT DISTINCT user_id AS id FROM fresh WHERE user_id <> 0 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  AND user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000))"""


@query(f"""WITH {_ROUND_SQL} SELECT 'record' AS what, p_partkey AS id, '{SITE}/movies/' || p_partkey AS name FROM part JOIN todo ON id = p_partkey
UNION ALL SELECT 'marker', coalesce((SELECT max(event_id) FROM fresh f WHERE f.event_type = feed), m), feed FROM marker""")
def feed_round(spark, sf):
    events = table(spark, sf, "events")
    link = text(SITE, "/?p=", F.col("user_id"))
    items = events.select(
        F.col("event_type").alias("feed"), text("g", F.col("event_id")).alias("guid"), link.alias("link"), (-F.col("event_id")).alias("pos")
    )
    early = events.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    state = early.groupBy(F.col("event_type").alias("feed")).agg(F.concat(F.lit("g"), F.max("event_id").cast("string")).alias("last_guid"))
    failed = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    done = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.lit("movies").alias("content_type"), F.col("s_suppkey").alias("id"))
    posts = landed.parse_posts(movie_posts(spark, sf))
    records, after = flows.feed_round(items, state, failed, done, posts, "movies")
    return records.select(F.lit("record").alias("what"), F.col("api_id").alias("id"), F.col("url").alias("name")).unionByName(
        after.select(F.lit("marker").alias("what"), F.substr("last_guid", F.lit(2)).cast("bigint").alias("id"), F.col("feed").alias("name"))
    )


@query(f"""WITH {SHOWS_SQL}, {EPISODES_SQL}, s AS (SELECT * FROM shows WHERE lastmod < '2000-01-01'), e AS (SELECT rtrim(show_url, '/') AS k, count(DISTINCT url)::INT AS n FROM episodes GROUP BY 1)
SELECT coalesce(rtrim(s.url, '/'), k) AS url, title_en, coalesce(n, 0) AS episode_count, CASE WHEN s.url IS NOT NULL THEN 1 END AS is_new FROM s FULL JOIN e ON rtrim(s.url, '/') = k""")
def series_build(spark, sf):
    # Early shows are delivered, of the others only the episodes: each gets a stub.
    layout = {kind: spark.createDataFrame([], schema_of(kind)) for kind in ("shows", "episodes")}
    delivered = shows(spark, sf).filter("lastmod < '2000-01-01'").select("url", "title_en", "lastmod", "source")
    children = episodes(spark, sf).select("url", "show_url", "season_number", "episode_number", "lastmod")
    built, _ = flows.build_series(delivered, children, layout["shows"], layout["episodes"], F.lit("2024-01-01"))
    return built.select("url", "title_en", "episode_count", "is_new")
