"""Queries on sources and sinks. Sinks write to the shared folder and the query reads back what
was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.operators import feeds, frontier
from playbill.plans.catalogue import ts
from playbill.plans.documents import movie_posts, upsert_inputs
from playbill.plans.registry import query
from playbill.plans.roles import (
    EPISODES_SQL,
    PAGES_SQL,
    PARSED_SQL,
    SHOWS_SQL,
    SITE,
    episodes,
    movies,
    norm_sql,
    origin_sql,
    pages,
    parsed_urls,
    shows,
    text,
)
from playbill.schemas import SITEMAP_ENTRY
from playbill.session import fresh_path, table
from playbill.sources import landed, sinks, xml
from playbill.sources.versioned import VersionedTable


@query("""WITH state AS (SELECT o_orderkey % 4 AS version, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 AND o_orderstatus = 'P' THEN NULL ELSE '2024-01-0' || (1 + o_orderkey % 4) END AS saved_at FROM orders),
marked AS (SELECT *, CASE WHEN id % 16 = 2 THEN 'unreadable' WHEN saved_at IS NULL THEN 'missing saved_at' END AS reason FROM state),
newest AS (SELECT max(version) AS v FROM (SELECT version FROM marked GROUP BY version HAVING count(reason) = 0))
SELECT 'state' AS side, version, id, saved_at, reason FROM marked, newest WHERE version = v
UNION ALL SELECT 'bad', version, CASE WHEN id % 16 <> 2 THEN id END, NULL, reason FROM marked, newest WHERE reason IS NOT NULL AND (v IS NULL OR version > v)""")
def state_fallback(spark, sf):
    # Four versions of a state file: of the newest rows lack a key, in the one before lines are cut off.
    version = F.col("o_orderkey") % 4
    key = (version == 3) & (F.col("o_orderstatus") == "P")
    saved = F.when(key, "").otherwise(text(',"saved_at":"2024-01-0', version + 1, '"'))
    line = text('{"id":', F.col("o_orderkey"), saved, "}")
    line = F.when(F.col("o_orderkey") % 16 == 2, F.left(line, F.length(line) - 4)).otherwise(line)
    path = fresh_path(spark, "state")
    table(spark, sf, "orders").select(version.alias("version"), line.alias("value")).write.partitionBy("version").text(path)
    rows = landed.read_versions(spark, path, "id bigint, saved_at string")
    good, bad = landed.newest_valid(rows, ["id", "saved_at"])
    columns = ["version", "id", "saved_at"]
    return good.select(F.lit("state").alias("side"), *columns, F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(F.lit("bad").alias("side"), "version", F.when(F.col("corrupt").isNull(), F.col("id")).alias("id"), F.lit(None).cast("string").alias("saved_at"), "reason")
    )


def _escaped(c):
    return F.replace(c, F.lit("&"), F.lit("&amp;"))


# --- sitemaps and feeds ---


def _sitemap_documents(spark, sf):
    """One urlset per page: the page, a dated copy, and an entry without a location."""
    # Pages of one type spell a letter of their path in full width.
    wide = F.concat(urls.url_origin(F.col("url")), F.translate(urls.url_path(F.col("url")), "oe", "ｏｅ"), urls.url_tail(F.col("url")))
    url = _escaped(F.when(F.col("lang") == "en", wide).otherwise(F.col("url")))
    date = F.when(F.col("lang") == "fr", "someday").otherwise(text(F.lit(1990) + F.least("page_id", F.lit(30)), "-05-01T00:00:00+00:00"))
    document = text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> ', url, "</loc></url><url><loc>",
                    url, "</loc><lastmod>", date, "</lastmod></url><url><lastmod>2020-01-01</lastmod></url></urlset>")
    return pages(spark, sf).select("page_id", document.alias("xml"))


_SITEMAP_SQL = f"""{PAGES_SQL}, s AS (SELECT page_id, {norm_sql('url')} AS url, lang, 0 AS pos, NULL AS lastmod FROM pg
  UNION ALL SELECT page_id, {norm_sql('url')}, lang, 1, CASE WHEN lang = 'fr' THEN 'someday' ELSE (1990 + least(page_id, 30)) || '-05-01T00:00:00+00:00' END FROM pg),
entries AS (SELECT *, coalesce(lang <> 'fr' AND lastmod > '2005-01-01', false) AS is_modified, coalesce(lang = 'fr' AND lastmod IS NOT NULL, false) AS bad_lastmod,
  CASE lang WHEN 'en' THEN 'movies' WHEN 'fr' THEN 'shows' WHEN 'es' THEN 'episodes' END AS category FROM s)"""


@query(f"WITH {_SITEMAP_SQL} SELECT page_id, pos, url, lastmod, is_modified, category, bad_lastmod FROM entries")
def xml_sitemap(spark, sf):
    rows = xml.document_entries(_sitemap_documents(spark, sf))
    return xml.sitemap_entries(rows, since=ts("2005-01-01"), nfkc=True).drop("api_id")


@query(f"WITH {_SITEMAP_SQL} SELECT url, lastmod, is_modified, category, bad_lastmod FROM entries")
def xml_sitemap_files(spark, sf):
    # One well-formed document per file: a share of the entries between its own start and end tag.
    path, files = fresh_path(spark, "sitemaps"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = F.regexp_replace(F.col("xml"), "<[?]xml[^>]*>|</?urlset[^>]*>", "")
    body = _sitemap_documents(spark, sf).select(
        F.pmod(F.xxhash64("page_id"), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("place"), entries.alias("value")
    )
    number = F.col("id").cast("int").alias("file")
    start = spark.range(files).select(number, F.lit(0).alias("place"), F.lit("<urlset>").alias("value"))
    end = spark.range(files).select(number, F.lit(2).alias("place"), F.lit("</urlset>").alias("value"))
    lines = body.unionByName(start).unionByName(end).repartitionById(files, F.col("file"))
    lines.sortWithinPartitions("place").select("value").write.text(path)
    rows = xml.read_rows(spark, path, "url", SITEMAP_ENTRY).drop("file")
    return xml.sitemap_entries(rows, since=ts("2005-01-01")).drop("api_id")


@query(f"""WITH {PAGES_SQL} SELECT {origin_sql('url')} || CASE lang WHEN 'en' THEN '/movies-sitemap' WHEN 'fr' THEN '/tvshows-sitemap' ELSE '/map' END || page_id || '.xml' AS url,
  CASE lang WHEN 'en' THEN 'movies' WHEN 'fr' THEN 'shows' ELSE 'other' END AS type, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 5 END AS priority,
  CASE WHEN lang = 'en' THEN '2024-01-01' END AS lastmod FROM pg""")
def xml_sitemap_index(spark, sf):
    lang = F.col("lang")
    name = F.when(lang == "en", "/movies-sitemap").when(lang == "fr", "/tvshows-sitemap").otherwise("/map")
    entry = text("<sitemap><loc>", urls.url_origin(F.col("url")), name, F.col("page_id"), ".xml</loc>",
                 F.when(lang == "en", "<lastmod>2024-01-01</lastmod>").otherwise(""), "</sitemap>")
    documents = pages(spark, sf).select(text("<sitemapindex>", entry, "<sitemap><lastmod>x</lastmod></sitemap></sitemapindex>").alias("xml"))
    return xml.sitemap_index(xml.document_entries(documents, tag="sitemap").drop("pos"))


def _feed_documents(spark, sf):
    """A feed per page; its items are the navigation links, newest first."""
    names = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))

    def item(name, i):
        number = F.col("page_id") * 1000 + i
        guid = F.when(i == 0, text('<guid isPermaLink="false">', SITE, "/?post=x&amp;p=", number, "</guid>")).when(
            i == 1, text("<guid>", SITE, "/?p=", number, "</guid>")
        )
        return text("<item><title>", _escaped(name), "</title><link>", SITE, "/x/", number, "/</link>", F.coalesce(guid, F.lit("")),
                    F.when(i == 2, "").otherwise("<pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate>"), "</item>")

    items = F.array_join(F.transform(names, item), "")
    head = "<rss><channel><title>t</title><lastBuildDate>Tue, 02 Jan 2024 10:00:00 +0000</lastBuildDate>"
    return pages(spark, sf).select(F.col("page_id").alias("feed"), text(head, items, "</channel></rss>").alias("xml"))


@query(f"""WITH {PAGES_SQL}, n AS (SELECT page_id AS feed, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS names FROM pg),
i AS (SELECT feed, names, unnest(range(0, len(names)))::INT AS pos FROM n)
SELECT feed, pos, trim(replace(replace(replace(names[pos + 1], '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title, feed * 1000 + pos AS id,
  CASE pos WHEN 0 THEN '{SITE}/?post=x&p=' || (feed * 1000) WHEN 1 THEN '{SITE}/?p=' || (feed * 1000 + 1) ELSE '' END AS guid,
  CASE WHEN pos = 2 THEN '' ELSE 'Tue, 02 Jan 2024 10:00:00 +0000' END AS published, 'rss' AS source
FROM i WHERE feed * 1000 + pos NOT IN (SELECT page_id * 1000 + 3 FROM pages) AND pos < 5""")
def xml_rss(spark, sf):
    documents = _feed_documents(spark, sf)
    items = xml.feed_items(documents)
    # The sixth item of a feed was the newest one at the last poll.
    marker = text(SITE, "/x/", F.col("feed") * 1000 + 5, "/")
    items = items.withColumn("guid", F.when(F.col("pos") == 5, F.col("link")).otherwise(F.col("guid")))
    state = documents.select("feed", marker.alias("last_guid"))
    failing = documents.select((F.col("feed") * 1000 + 3).alias("id"))
    fresh = feeds.with_item_ids(feeds.since_marker(items, state), failing)
    return fresh.select("feed", "pos", "title", "id", "guid", "published", "source")


@query("SELECT page_id AS feed, '2024-01-02 10:00' AS built FROM pages")
def feed_build_dates(spark, sf):
    dates = xml.feed_build_dates(_feed_documents(spark, sf))
    return dates.select("feed", F.date_format("built", "yyyy-MM-dd HH:mm").alias("built"))


# --- landed API pages and snapshots ---


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'unknown' ELSE (1950 + p_size) || '-06-01T00:00:00' END AS modified_gmt FROM part
WHERE p_size > 40 OR 1950 + p_size >= 1975""")
def api_pages(spark, sf):
    path = fresh_path(spark, "posts")
    movie_posts(spark, sf).withColumnRenamed("body", "value").write.text(path)
    posts = landed.read_posts(spark, path)
    return landed.modified_posts(posts, ts("1975-01-01")).select("id", "modified_gmt")


@query(f"""SELECT 'good' AS side, p_partkey AS id, '{SITE}/movies/' || p_partkey AS link FROM part WHERE p_size > 10 AND p_type <> 'SMALL'
UNION ALL SELECT 'bad', CASE WHEN p_type <> 'SMALL' THEN p_partkey END, NULL FROM part WHERE p_size <= 10 OR p_type = 'SMALL'""")
def corrupt_quarantine(spark, sf):
    key = F.col("p_partkey")
    whole = text('{"id":', key, ',"link":"', SITE, "/movies/", key, '"}')
    line = (
        F.when(F.col("p_type") == "SMALL", text('{"id":', key, ',"link"'))
        .when(F.col("p_size") > 10, whole)
        .otherwise(text('{"id":', key, "}"))
    )
    path = fresh_path(spark, "lines")
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    good, bad = landed.split_corrupt(landed.read_posts(spark, path), ["id", "link"])
    kept = good.select(F.lit("good").alias("side"), "id", "link")
    return kept.unionByName(bad.select(F.lit("bad").alias("side"), "id", "link"))


@query(f"""WITH {PAGES_SQL} SELECT page_id, html FROM pg""")
def snapshot_decode(spark, sf):
    rows = pages(spark, sf)
    latin = (F.col("lang") != "en") & ~F.col("html").rlike("[^\\x{00}-\\x{FF}]")
    stored = F.when(latin, F.encode(F.regexp_replace("html", "[^\\x{00}-\\x{FF}]", "?"), "ISO-8859-1")).otherwise(
        F.encode("html", "UTF-8")
    )
    # Two pages may have one URL, or URLs of one cache key; the name carries the page.
    file = F.concat_ws("-", "page_id", "file")
    snaps = landed.with_cache_file(rows.select("page_id", "url", landed.decode_page(stored).alias("html"))).withColumn("file", file).drop("page_id")
    wanted = landed.with_cache_file(rows.select("page_id", "url")).withColumn("file", file)
    return wanted.join(snaps.select("file", "html"), "file").select("page_id", "html")


@query(f"""WITH {PAGES_SQL} SELECT page_id, lang AS content_type, html FROM pg WHERE lang IN ('en', 'fr')""")
def snapshot_scan(spark, sf):
    # Pages as files in the folder of their type, in UTF-8 or, where it can hold the page, Latin-1; two types are read.
    rows, path = pages(spark, sf), fresh_path(spark, "cache")
    latin = (F.col("lang") == "fr") & ~F.col("html").rlike("[^\\x{00}-\\x{FF}]")
    stored = F.when(latin, F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    named = landed.with_cache_file(rows.select("page_id", "url", F.col("lang").alias("content_type"), stored.alias("content")))
    # Two pages may have one cache key; the name carries the page.
    landed.write_snapshots(named.withColumn("file", F.concat_ws("-", "page_id", "file")), path)
    scan = landed.read_snapshots(spark, path, kinds=["en", "fr"], since="2020-01-01")
    return scan.select(F.substring_index("file", "-", 1).cast("bigint").alias("page_id"), "content_type", "html")


# --- catalogue tables, documents and state ---


@query("""SELECT p_partkey, replace(p_name, ' ', '|') AS genres, CASE WHEN p_type = 'SMALL' THEN 0 ELSE 1 END AS n_directors,
  CASE WHEN p_type <> 'PROMO' THEN 'u' || p_partkey END AS video FROM part""")
def catalogue_scan(spark, sf):
    key = F.col("p_partkey")
    stored = table(spark, sf, "part").select(
        "p_partkey",
        F.to_json(F.split("p_name", " ")).alias("genres"),
        F.when(F.col("p_type") == "SMALL", "[broken").otherwise(F.to_json(F.array("p_brand"))).alias("directors"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(text('[{"quality":"720","url":"u', key, '"}]')).alias("video_files"),
    )
    rows = landed.decode_lists(stored, ["genres", "directors"], "video_files")
    return rows.select(
        "p_partkey",
        F.array_join("genres", "|").alias("genres"),
        F.size("directors").alias("n_directors"),
        F.get("video_files", F.lit(0))["url"].alias("video"),
    )


@query(f"""WITH {PAGES_SQL}, n AS (SELECT page_id, lang, url, 'u' || page_id AS extra FROM pg)
SELECT page_id, 'movies' AS category, false AS is_modified, 0 AS pos, url, CASE WHEN lang = 'en' THEN '2024-01-01' END AS lastmod, CASE WHEN lang = 'en' THEN page_id END AS api_id FROM n
UNION ALL SELECT page_id, 'movies', false, 1, extra, NULL, NULL FROM n
UNION ALL SELECT page_id, 'shows', lang = 'en', 0, extra, NULL, NULL FROM n""")
def parsed_url_document(spark, sf):
    url, page, extra = F.col("url"), F.col("page_id"), text("u", F.col("page_id"))
    new = text('{"metadata":{"total_count":3},"movies":[{"url":"', url, '","lastmod":"2024-01-01","api_id":', page, '},{"url":"', extra,
               '"}],"modified_shows":[{"url":"', extra, '"}]}')
    old = text('{"movies":["', url, '","', extra, '"],"series":["', extra, '"]}')
    body = F.when(F.col("lang") == "en", new).otherwise(old)
    return landed.parsed_url_documents(pages(spark, sf).select("page_id", body.alias("body")))


@query(f"""WITH {SHOWS_SQL}, {EPISODES_SQL} SELECT 'show' AS kind, s.url, count(e.url) AS n FROM shows s LEFT JOIN episodes e ON rtrim(s.url, '/') = rtrim(e.show_url, '/') GROUP BY s.url
UNION ALL SELECT 'movie', '{SITE}/movies/' || p_partkey, len(string_split(p_name, ' ')) FROM part
UNION ALL SELECT 'counts', '2024-01-01', (SELECT count(*) FROM part) + (SELECT count(*) FROM shows) + (SELECT count(*) FROM episodes)""")
def export_roundtrip(spark, sf):
    path = fresh_path(spark, "export")
    sinks.export_catalogue(movies(spark, sf), shows(spark, sf), episodes(spark, sf), path, F.lit("2024-01-01"), most=20_000)
    nested = spark.read.schema("url string, seasons array<struct<episodes array<struct<url string>>>>").json(f"{path}/shows")
    listed = F.flatten(F.transform("seasons", lambda s: s["episodes"]))
    films = spark.read.schema("url string, genres array<string>").json(f"{path}/movies")
    meta = spark.read.schema("exported_at string, movies_count bigint, shows_count bigint, episodes_count bigint").json(f"{path}/metadata")
    total = F.col("movies_count") + F.col("shows_count") + F.col("episodes_count")
    return (
        # A divided show has a document per part.
        nested.groupBy(F.lit("show").alias("kind"), "url").agg(F.sum(F.size(listed)).alias("n"))
        .unionByName(films.select(F.lit("movie").alias("kind"), "url", F.size("genres").cast("bigint").alias("n")))
        .unionByName(meta.select(F.lit("counts").alias("kind"), F.col("exported_at").alias("url"), total.alias("n")))
    )


@query(f"""WITH {SHOWS_SQL}, {EPISODES_SQL} , last AS (SELECT title_en, max(api_id) AS api_id FROM shows GROUP BY 1)
SELECT 'show' AS kind, s.title_en AS title, s.url, count(e.url) AS n FROM shows s JOIN last USING (title_en, api_id)
  LEFT JOIN episodes e ON rtrim(s.url, '/') = rtrim(e.show_url, '/') GROUP BY ALL
UNION ALL SELECT 'movie', p_name, '{SITE}/movies/' || max(p_partkey), 2 FROM part GROUP BY p_name""")
def frontend_sink(spark, sf):
    from playbill.operators.nesting import last_of_title, nest_seasons

    path = fresh_path(spark, "frontend")
    # Only the last show of a title is in the layout: the others are left out before anything is nested.
    kept = last_of_title(shows(spark, sf).withColumnRenamed("api_id", "pos"), "pos")
    nested = nest_seasons(kept, episodes(spark, sf))
    sinks.export_frontend(movies(spark, sf), nested, episodes(spark, sf), path, "pos")
    entry = "entries map<string, struct<url string, {} array<{}>>>"
    series = spark.read.schema(entry.format("episodes", "struct<url string>")).json(f"{path}/tv_shows")
    films = spark.read.schema(entry.format("genres", "string")).json(f"{path}/movies")

    def entries(df, kind, field):
        rows = df.select(F.explode("entries").alias("title", "v"))
        rows = rows.select("title", "v.url", F.size(f"v.{field}").alias("n"))
        return rows.groupBy(F.lit(kind).alias("kind"), "title", "url").agg(F.sum("n").alias("n"))

    return entries(series, "show", "episodes").unionByName(entries(films, "movie", "genres"))


@query(f"""WITH {PARSED_SQL}, run AS (SELECT count(*) FILTER (NOT is_modified) AS total_count, count(*) FILTER (is_modified) AS modified_count,
  count(*) FILTER (category = 'movies' AND NOT is_modified) AS movies_count, count(*) FILTER (category = 'shows' AND NOT is_modified) AS shows_count,
  count(*) FILTER (category = 'episodes' AND NOT is_modified) AS episodes_count FROM parsed)
SELECT 'second' AS run, '2024-01-02' AS generated_at, '2024-01-01' AS last_full_scan, * FROM run
UNION ALL SELECT 'first', '2024-01-01', '2024-01-01', total_count, 0, movies_count, shows_count, episodes_count FROM run""")
def parsed_url_sink(spark, sf):
    parsed = parsed_urls(spark, sf)
    first, second = fresh_path(spark, "parsed"), fresh_path(spark, "parsed")
    sinks.save_parsed_urls(parsed.filter("not is_modified"), None, first, F.lit("2024-01-01"))
    before = spark.read.parquet(f"{first}/metadata")
    sinks.save_parsed_urls(parsed, before, second, F.lit("2024-01-02"))
    after = spark.read.parquet(f"{second}/metadata")
    return before.withColumn("run", F.lit("first")).unionByName(after.withColumn("run", F.lit("second")))


@query(f"""SELECT 'shows' AS content_type, count(*) AS n, '2024-01-01' AS timestamp FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'movies', count(*), '2024-01-01' FROM part""")
def notification_summary(spark, sf):
    new = shows(spark, sf).filter("is_new = 1").select(F.lit("shows").alias("content_type"), "url", "title_en")
    new = new.unionByName(movies(spark, sf).select(F.lit("movies").alias("content_type"), "url", "title_en"))
    path = fresh_path(spark, "notify")
    sinks.notify(new, path, F.lit("2024-01-01"))
    return spark.read.schema("content_type string, n bigint, timestamp string").json(f"{path}/summary")


@query(f"""SELECT 'processed' AS state, '{SITE}/tvshows/' || o_orderkey AS url FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'pending', '{SITE}/tvshows/' || o_orderkey FROM orders WHERE o_orderstatus <> 'F'""")
def state_roundtrip(spark, sf):
    kind = F.lit("shows").alias("content_type")
    rows = table(spark, sf, "orders").select(kind, text(f"{SITE}/tvshows/", F.col("o_orderkey")).alias("url"), "o_orderstatus", F.col("o_orderkey").alias("pos"))
    processed = rows.filter("o_orderstatus = 'F'").select("content_type", "url")
    pending = frontier.add_pending(rows.limit(0), rows, processed)
    path = fresh_path(spark, "state")
    sinks.write_state(path, processed=processed, pending=pending, cleared=pending.limit(0))
    layout = "content_type string, url string"
    parts = [
        sinks.read_state(spark, path, name, layout).select(F.lit(name).alias("state"), "url")
        for name in ("processed", "pending", "cleared")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""SELECT '{SITE}/tvshows/' || l_orderkey AS url, arg_max(l_returnflag, strftime(l_shipdate, '%Y-%m-%d') || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey) AS source,
  CASE WHEN arg_max(l_returnflag, strftime(l_shipdate, '%Y-%m-%d') || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey) IN ('A', 'N', 'R') THEN 1 END AS is_new,
  '2002-01-02' AS last_scraped FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT '{SITE}/tvshows/' || o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 1 END, '2002-01-01' FROM orders
  WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def upsert_sink(spark, sf):
    old, batch = upsert_inputs(spark, sf)
    layout = "url string, title_en string, lastmod string, source string, is_new int, api_id bigint, is_modified int, last_scraped string"
    shows = VersionedTable.create(spark, fresh_path(spark, "shows"), layout, buckets=16)
    shows.upsert(old.withColumn("pos", F.col("api_id")), F.lit("2002-01-01"))
    shows.upsert(batch, F.lit("2002-01-02"))
    return shows.read().select("url", "source", "is_new", "last_scraped")
