"""Queries on filters, joins, windows, set operations and statistics of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.functions import dates, urls
from playbill.operators import feeds, frontier, grouping, joins, nesting, stats
from playbill.plans.registry import query
from playbill.plans.roles import (
    EPISODES_SQL,
    PAGES_SQL,
    PARSED_SQL,
    SHOWS_SQL,
    SITE,
    day,
    episodes,
    movies,
    pages,
    parsed_urls,
    shows,
    source,
    text,
)
from playbill.session import table
from playbill.sources import xml


def ts(value: str):
    return F.lit(value).cast("timestamp")


# --- filters ---


@query("""SELECT o_orderkey, o_orderstatus <> 'P' AS flagged FROM orders
  WHERE o_orderstatus = 'P' OR o_orderdate > TIMESTAMP '1999-01-01'""")
def modified_since(spark, sf):
    changed = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(text(day("o_orderdate"), "T00:00:00Z"))
    when = dates.iso_timestamp(changed)
    rows = table(spark, sf, "orders").filter(dates.modified_after(when, ts("1999-01-01"), on_unparsed=True))
    return rows.select("o_orderkey", dates.modified_after(when, ts("1999-01-01"), on_unparsed=False).alias("flagged"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 90 DAY""")
def modified_window(spark, sf):
    recent = dates.modified_within(F.col("o_orderdate"), F.lit("2001-08-01").cast("timestamp_ntz"), 90)
    return table(spark, sf, "orders").filter(recent).select("o_orderkey")


@query("""WITH state AS (SELECT event_type AS feed, CASE event_type WHEN 'view' THEN NULL WHEN 'signup' THEN -1
    ELSE max(event_id) END AS marker FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1),
fresh AS (SELECT event_type AS feed, 'g' || event_id AS guid, -event_id AS pos FROM events JOIN state ON feed = event_type
    WHERE marker IS NULL OR event_id > marker)
SELECT f.*, max(CAST(substr(guid, 2) AS BIGINT)) OVER (PARTITION BY feed) AS next_marker FROM fresh f""")
def feed_new_since_marker(spark, sf):
    events = table(spark, sf, "events")
    items = events.select(
        F.col("event_type").alias("feed"), text("g", F.col("event_id")).alias("guid"), (-F.col("event_id")).alias("pos")
    )
    state = (
        events.filter(F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz"))
        .groupBy(F.col("event_type").alias("feed"))
        .agg(F.max("event_id").alias("m"))
    )
    marker = F.when(F.col("feed") == "view", None).when(F.col("feed") == "signup", "gone").otherwise(text("g", F.col("m")))
    state = state.select("feed", marker.alias("last_guid"))
    fresh = feeds.since_marker(items, state)
    markers = feeds.next_markers(fresh, state)
    number = F.substr("last_guid", F.lit(2)).cast("bigint").alias("next_marker")
    return fresh.join(markers.select("feed", number), "feed")


@query(f"""WITH {PAGES_SQL}, b AS (SELECT page_id, url AS site, lang,
    TIMESTAMP '2024-01-01 10:00:00' + to_hours(least(page_id, 300)::INT) AS built FROM pg)
SELECT site, CASE WHEN lang <> 'es' THEN strftime(built, '%Y-%m-%d %H:%M') END AS built FROM b
WHERE lang IN ('es', 'de') OR built > TIMESTAMP '2024-01-05'""")
def changed_sites(spark, sf):
    lang = F.col("lang")
    built = F.timestamp_add("HOUR", F.least("page_id", F.lit(300)).cast("int"), ts("2024-01-01 10:00:00"))
    written = F.when(lang == "es", "unknown").otherwise(F.date_format(built, "EEE, dd MMM yyyy HH:mm:ss' GMT'"))
    document = text("<rss><channel><title>t</title><lastBuildDate>", written, "</lastBuildDate></channel></rss>")
    sites = pages(spark, sf).select(F.col("url").alias("site"), "lang", document.alias("xml"))
    state = sites.filter(lang != "de").select("site", ts("2024-01-05").alias("last_check"))
    changed = feeds.changed_sites(xml.feed_build_dates(sites.drop("lang")), state)
    return changed.select("site", F.date_format("built", "yyyy-MM-dd HH:mm").alias("built"))


_SNAPSHOTS_SQL = f"""snaps AS (SELECT '{SITE}/tvshows/' || l_orderkey AS url, max(l_shipdate) - INTERVAL 60 DAY AS fetched_at
  FROM lineitem GROUP BY 1)"""


def _snapshots(spark, sf):
    item = table(spark, sf, "lineitem")
    fetched = (F.max("l_shipdate") - F.expr("INTERVAL 60 DAYS")).cast("timestamp")
    return item.groupBy(text(f"{SITE}/tvshows/", F.col("l_orderkey")).alias("url")).agg(fetched.alias("fetched_at"))


@query(f"""WITH {_SNAPSHOTS_SQL}, f AS (SELECT '{SITE}/tvshows/' || o_orderkey AS url,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS changed FROM orders)
SELECT f.url, CASE WHEN fetched_at IS NULL THEN 'refetch' WHEN changed IS NULL OR fetched_at >= changed THEN 'use' ELSE 'refetch' END AS plain,
  CASE WHEN fetched_at IS NULL THEN 'refetch' WHEN fetched_at > TIMESTAMP '1998-01-01' THEN 'use'
    WHEN changed IS NULL OR fetched_at >= changed THEN 'use' ELSE 'refetch' END AS filtered
FROM f LEFT JOIN snaps USING (url)""")
def snapshot_freshness(spark, sf):
    lastmod = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(day("o_orderdate"))
    urls_ = table(spark, sf, "orders").select(
        text(f"{SITE}/tvshows/", F.col("o_orderkey")).alias("url"), lastmod.alias("lastmod")
    )
    rows = feeds.snapshot_decision(urls_, _snapshots(spark, sf)).withColumnRenamed("decision", "plain").drop("fetched_at")
    rows = feeds.snapshot_decision(rows, _snapshots(spark, sf), modified_after=ts("1998-01-01"))
    return rows.select("url", "plain", F.col("decision").alias("filtered"))


@query("""SELECT l_returnflag AS content_type, count(*) AS stored,
  count(*) FILTER (NOT (l_returnflag = 'A' AND l_shipdate < TIMESTAMP '1999-01-01')) AS live,
  count(*) FILTER (l_returnflag = 'A' AND l_shipdate < TIMESTAMP '1999-01-01') AS deleted FROM lineitem GROUP BY 1""")
def snapshot_expiry(spark, sf):
    snaps = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("content_type"), F.col("l_shipdate").cast("timestamp").alias("fetched_at")
    )
    live = feeds.live_snapshots(snaps, ts("1999-01-01"), "A").groupBy("content_type").agg(F.count("*").alias("live"))
    stored = snaps.groupBy("content_type").agg(F.count("*").alias("stored"))
    rows = stored.join(live, "content_type", "left").withColumn("live", F.coalesce("live", F.lit(0)))
    return rows.withColumn("deleted", F.col("stored") - F.col("live"))


_CONTENT_SQL = f"""content AS (SELECT 'shows' AS content_type, CASE WHEN o_totalprice > 1000 THEN '{SITE}/tvshows/' || o_orderkey END AS url
    FROM orders UNION ALL SELECT 'movies', '{SITE}/movies/' || p_partkey FROM part),
processed AS (SELECT DISTINCT 'shows' AS content_type, '{SITE}/tvshows/' || l_orderkey AS url FROM lineitem
    WHERE l_shipdate < TIMESTAMP '1998-01-01')"""


def _content(spark, sf):
    priced = F.when(F.col("o_totalprice") > 1000, text(f"{SITE}/tvshows/", F.col("o_orderkey")))
    return (
        table(spark, sf, "orders")
        .select(F.lit("shows").alias("content_type"), priced.alias("url"))
        .unionByName(movies(spark, sf).select(F.lit("movies").alias("content_type"), "url"))
    )


def _processed(spark, sf):
    early = table(spark, sf, "lineitem").filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return early.select(
        F.lit("shows").alias("content_type"), text(f"{SITE}/tvshows/", F.col("l_orderkey")).alias("url")
    ).distinct()


@query(f"""WITH {_CONTENT_SQL} SELECT content_type, url FROM content c WHERE url IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM processed p WHERE p.content_type = c.content_type AND p.url = c.url)""")
def unprocessed_content(spark, sf):
    return frontier.unprocessed(_content(spark, sf), _processed(spark, sf))


@query("""WITH items AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'shows' WHEN 'click' THEN 'movies'
    WHEN 'signup' THEN 'episodes' ELSE event_type END AS content_type, user_id AS id FROM events),
done AS (SELECT DISTINCT 'shows' AS content_type, user_id AS id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-10')
SELECT event_id, content_type, id FROM items i WHERE content_type IN ('movies', 'shows', 'episodes') AND id <> 0
  AND NOT EXISTS (SELECT 1 FROM done d WHERE d.content_type = i.content_type AND d.id = i.id)""")
def unprocessed_feed_items(spark, sf):
    events = table(spark, sf, "events")
    names = {"view": "tvshows", "click": "movies", "signup": "episodes"}
    kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    items = events.select(
        "event_id", F.coalesce(kind, "event_type").alias("content_type"), F.col("user_id").alias("id")
    )
    early = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    done = events.filter(early & (F.col("event_type") == "purchase"))
    done = done.select(F.lit("shows").alias("content_type"), F.col("user_id").alias("id")).distinct()
    return frontier.unprocessed_feed_items(items, done, ["movies", "shows", "episodes"])


# --- joins ---


@query(f"""WITH {SHOWS_SQL}, {EPISODES_SQL} SELECT s.url, s.title_en, e.url AS episode_url, e.season_number, e.episode_number
FROM shows s LEFT JOIN episodes e ON rtrim(s.url, '/') = rtrim(e.show_url, '/')""")
def show_episode_join(spark, sf):
    rows = joins.shows_with_episodes(shows(spark, sf), episodes(spark, sf).select("url", "show_url", "season_number", "episode_number"))
    return rows.select("url", "title_en", "episode_url", "season_number", "episode_number")


@query("""WITH probe AS (SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_name ELSE left(c_name, 17) END AS name FROM customer)
SELECT c_custkey, name, c_name AS matched, CASE WHEN name = c_name THEN 'exact' ELSE 'prefix' END AS match
FROM probe JOIN (SELECT c_name FROM customer) k ON k.c_name = probe.name
  OR (starts_with(k.c_name, probe.name) AND probe.name NOT IN (SELECT c_name FROM customer))""")
def prefix_lookup(spark, sf):
    customers = table(spark, sf, "customer")
    name = F.when(F.col("c_nationkey") < 12, F.col("c_name")).otherwise(F.substr("c_name", F.lit(1), F.lit(17)))
    probe = customers.select("c_custkey", name.alias("name"))
    return joins.prefix_lookup(probe, customers.select(F.col("c_name").alias("name")), "name")


@query(f"""WITH api AS (SELECT '{SITE}/movies/' || p_partkey AS url, CASE WHEN p_size > 10 THEN p_name END AS title_en,
    p_retailprice AS rating, CASE WHEN p_type = 'PROMO' THEN [p_type] ELSE [] END AS video_files, 'api' AS source
  FROM part WHERE p_brand <> 'Brand#1'),
html AS (SELECT '{SITE}/movies/' || l_partkey AS url, 'Part ' || l_partkey AS title_en,
    strftime(max(l_shipdate), '%Y-%m-%d') AS release_date, ['x'] AS video_files, 'html' AS source FROM lineitem GROUP BY l_partkey)
SELECT url, coalesce(a.title_en, h.title_en) AS title_en, rating, release_date, coalesce(a.source, h.source) AS source,
  array_to_string(CASE WHEN len(a.video_files) > 0 THEN a.video_files ELSE h.video_files END, ',') AS video_files
FROM html h FULL JOIN api a USING (url)""")
def api_html_merge(spark, sf):
    part, item = table(spark, sf, "part"), table(spark, sf, "lineitem")
    none = F.expr("cast(array() as array<string>)")
    api = part.filter(F.col("p_brand") != "Brand#1").select(
        text(f"{SITE}/movies/", F.col("p_partkey")).alias("url"),
        F.when(F.col("p_size") > 10, F.col("p_name")).alias("title_en"),
        F.col("p_retailprice").alias("rating"),
        F.when(F.col("p_type") == "PROMO", F.array("p_type")).otherwise(none).alias("video_files"),
        F.lit("api").alias("source"),
    )
    html = item.groupBy("l_partkey").agg(day(F.max("l_shipdate")).alias("release_date")).select(
        text(f"{SITE}/movies/", F.col("l_partkey")).alias("url"),
        text("Part ", F.col("l_partkey")).alias("title_en"),
        "release_date",
        F.array(F.lit("x")).alias("video_files"),
        F.lit("html").alias("source"),
    )
    return joins.merge_sources(api, html).withColumn("video_files", F.array_join("video_files", ","))


@query(f"""WITH {SHOWS_SQL}, {EPISODES_SQL}, parents AS (SELECT rtrim(url, '/') AS url, title_en FROM shows WHERE lastmod < '2000-01-01')
SELECT url, title_en FROM parents UNION ALL SELECT DISTINCT rtrim(show_url, '/'), NULL FROM episodes
WHERE rtrim(show_url, '/') NOT IN (SELECT url FROM parents)""")
def parent_stub(spark, sf):
    known = shows(spark, sf).filter("lastmod < '2000-01-01'").select(urls.strip_slash(F.col("url")).alias("url"), "title_en")
    children = episodes(spark, sf).select(urls.strip_slash(F.col("show_url")).alias("show_url"))
    return joins.add_missing_parents(children, known, "show_url")


@query(f"""WITH f AS (SELECT DISTINCT '{SITE}/tvshows/show-' || l_orderkey AS url, l_orderkey AS k FROM lineitem)
SELECT f.url, strftime(o_orderdate, '%Y-%m-%d') AS lastmod, f.k AS api_id FROM f LEFT JOIN orders ON o_orderkey = k""")
def frontier_enrichment(spark, sf):
    known = parsed_urls(spark, sf).filter("category = 'shows'")
    wanted = table(spark, sf, "lineitem").select(text(f"{SITE}/tvshows/show-", F.col("l_orderkey")).alias("url")).distinct()
    return frontier.enrich(wanted, known).select("url", "lastmod", "api_id")


@query("""SELECT p_partkey AS id, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01')""")
def batch_ids(spark, sf):
    posts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    late = table(spark, sf, "lineitem").filter(F.col("l_shipdate") >= F.lit("2001-10-01").cast("timestamp_ntz"))
    return joins.select_ids(posts, late.select(F.col("l_partkey").alias("id")))


@query(f"""WITH {SHOWS_SQL}, {EPISODES_SQL} SELECT url, show_url, season_number, episode_number FROM episodes
WHERE rtrim(show_url, '/') IN (SELECT rtrim(url, '/') FROM shows WHERE is_new = 1)""")
def children_of_parent(spark, sf):
    parents = shows(spark, sf).filter("is_new = 1")
    children = episodes(spark, sf).select("url", "show_url", "season_number", "episode_number")
    return joins.children_of(children, parents)


# --- windows and limits ---


@query("""SELECT event_type AS category, 'u' || user_id AS url, arg_max(lm, (coalesce(lm, ''), -event_id)) AS lastmod,
  arg_max(event_id, (coalesce(lm, ''), -event_id)) AS pos FROM (SELECT *, CASE WHEN value < 10 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS lm
  FROM events) GROUP BY ALL""")
def keep_latest(spark, sf):
    lastmod = F.when(F.col("value") < 10, "").otherwise(day("ts"))
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("category"),
        text("u", F.col("user_id")).alias("url"),
        lastmod.alias("lastmod"),
        F.col("event_id").alias("pos"),
    )
    return grouping.keep_latest(rows, ["category", "url"])


@query("""SELECT event_type AS category, event_id AS pos, user_id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 500""")
def cap_per_category(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("category"), F.col("event_id").alias("pos"), "user_id"
    )
    return grouping.cap_per_category(rows, 500)


@query(f"""WITH {PAGES_SQL}, l AS (SELECT page_id,
  list_append(regexp_extract_all(html, '<a href="/([^"]*)"', 1), 'Season ' || page_id) AS labels FROM pg)
SELECT page_id, i - 1 AS pos, labels[i] AS label,
  coalesce(TRY_CAST(nullif(regexp_extract(labels[i], '(\\d+)', 1), '') AS INT), i)::INT AS number
FROM (SELECT *, unnest(range(1, len(labels) + 1))::INT AS i FROM l)""")
def positional_numbers(spark, sf):
    labels = F.array_append(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)), text("Season ", F.col("page_id")))
    rows = pages(spark, sf).select("page_id", labels.alias("labels"))
    return nesting.numbered(rows, "labels")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS snapshot FROM orders
QUALIFY dense_rank() OVER (ORDER BY strftime(o_orderdate, '%Y-%m') DESC) <= 5""")
def snapshot_retention(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"))
    return grouping.newest_snapshots(rows, "snapshot", 5)


# --- set operations ---


@query("SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1")
def distinct_in_order(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return grouping.distinct_in_order(rows, ["l_partkey"])


@query(f"""WITH {_CONTENT_SQL} SELECT content_type, url FROM processed UNION SELECT content_type, url FROM content WHERE url IS NOT NULL""")
def processed_union(spark, sf):
    return frontier.mark_processed(_processed(spark, sf), _content(spark, sf).filter("url is not null"))


_QUEUE_SQL = f"""queue AS (SELECT 'shows' AS content_type, '{SITE}/tvshows/' || o_orderkey AS url, 0 AS wave, o_orderkey AS pos
    FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'shows', '{SITE}/tvshows/' || l_orderkey, 1, l_orderkey * 10 + l_linenumber FROM lineitem),
processed AS (SELECT DISTINCT '{SITE}/tvshows/' || l_orderkey AS url FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
pending AS (SELECT content_type, url, min(wave)::INT AS wave, arg_min(pos, (wave, pos)) AS pos FROM queue
  WHERE url NOT IN (SELECT url FROM processed) GROUP BY 1, 2)"""


def _pending(spark, sf):
    kind = F.lit("shows").alias("content_type")
    queued = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(
        kind, text(f"{SITE}/tvshows/", F.col("o_orderkey")).alias("url"), F.col("o_orderkey").alias("pos")
    )
    found = table(spark, sf, "lineitem").select(
        kind,
        text(f"{SITE}/tvshows/", F.col("l_orderkey")).alias("url"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return frontier.add_pending(queued, found, _processed(spark, sf))


@query(f"WITH {_QUEUE_SQL} SELECT content_type, url, wave, pos FROM pending")
def frontier_pending(spark, sf):
    return _pending(spark, sf)


@query(f"WITH {_QUEUE_SQL} SELECT url, wave, pos FROM pending ORDER BY wave, pos LIMIT 100")
def pending_limit(spark, sf):
    return frontier.pending_urls(_pending(spark, sf), "shows", 100).drop("content_type")


@query(f"WITH {PARSED_SQL} SELECT category, 'all' AS list, url, lastmod FROM parsed UNION ALL SELECT category, 'modified', url, lastmod FROM parsed WHERE is_modified")
def category_union(spark, sf):
    parsed = parsed_urls(spark, sf)
    every = parsed.select("category", F.lit("all").alias("list"), "url", "lastmod")
    return every.unionByName(parsed.filter("is_modified").select("category", F.lit("modified").alias("list"), "url", "lastmod"))


@query("""SELECT 'shows' AS content_type, o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01'
UNION ALL SELECT 'episodes', l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-06-01' OR l_returnflag = 'R'
UNION ALL SELECT 'movies', p_partkey FROM part""")
def modified_union(spark, sf):
    since = F.lit("2000-06-01").cast("timestamp_ntz")
    shipped = F.when(F.col("l_returnflag") != "R", F.col("l_shipdate"))
    tables = {
        "shows": table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("modified")),
        "episodes": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), shipped.alias("modified")),
        "movies": table(spark, sf, "part").select(
            F.col("p_partkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("modified")
        ),
    }
    return frontier.modified_union(tables, since).select("content_type", "id")


# --- statistics ---


@query("""SELECT 'movies' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'shows', count(*) FROM orders
UNION ALL SELECT 'episodes', count(*) FROM lineitem""")
def table_counts(spark, sf):
    names = {"movies": "part", "shows": "orders", "episodes": "lineitem"}
    return stats.table_counts({name: table(spark, sf, t) for name, t in names.items()})


@query(f"""WITH {PARSED_SQL}, c AS (SELECT category, count(*) AS total, count(*) FILTER (is_modified) AS modified FROM parsed GROUP BY 1),
s AS (SELECT category, string_agg(url, ' ' ORDER BY pos, url) AS sample_urls FROM (SELECT * FROM parsed
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY pos, url) <= 3) GROUP BY 1)
SELECT category, total, modified, sample_urls FROM c JOIN s USING (category)
UNION ALL SELECT 'all', sum(total)::BIGINT, sum(modified)::BIGINT, '' FROM c""")
def category_stats(spark, sf):
    rows = stats.category_stats(parsed_urls(spark, sf))
    return rows.withColumn("sample_urls", F.array_join("sample_urls", " "))


@query(f"""WITH {_QUEUE_SQL}, c AS (SELECT 'shows' AS content_type, (SELECT count(*) FROM processed) AS processed, (SELECT count(*) FROM pending) AS pending
  UNION ALL SELECT 'movies', 0, count(*) FROM part)
SELECT * FROM c UNION ALL SELECT 'all', sum(processed)::BIGINT, sum(pending)::BIGINT FROM c""")
def progress_stats(spark, sf):
    waiting = movies(spark, sf).select(F.lit("movies").alias("content_type"))
    pending = _pending(spark, sf).select("content_type").unionByName(waiting)
    return stats.progress_stats(_processed(spark, sf), pending)


@query(f"""WITH {_CONTENT_SQL} SELECT content_type, count(*) AS n FROM content WHERE url IS NOT NULL GROUP BY 1""")
def new_content_summary(spark, sf):
    return stats.content_summary(_content(spark, sf).filter("url is not null"))


@query(f"""WITH {EPISODES_SQL}, u AS (SELECT DISTINCT rtrim(show_url, '/') AS k, url FROM episodes), n AS (SELECT k, greatest(ceil(count(*) / 20000), 1)::INT AS parts FROM u GROUP BY k),
p AS (SELECT u.k, url, n.parts, CASE WHEN n.parts > 1 THEN coalesce(('0x' || substr(md5(url), 1, 8))::BIGINT % n.parts, 0) ELSE 0 END::INT AS part FROM u JOIN n ON u.k IS NOT DISTINCT FROM n.k)
SELECT k AS show_url, part, parts, string_agg(url, ' ' ORDER BY url) AS episode_urls FROM p GROUP BY k, part, parts""")
def episode_urls(spark, sf):
    eps = episodes(spark, sf).withColumn("show_url", urls.strip_slash(F.col("show_url")))
    rows = grouping.collect_in_parts(eps, ["show_url"], F.col("url"), 20_000, "episode_urls")
    return rows.withColumn("episode_urls", F.array_join("episode_urls", " "))


_FEED_SQL = f"""feeds AS (SELECT c_custkey AS feed, '{SITE}/u/' || c_custkey AS url FROM customer),
state AS (SELECT user_id AS feed, max(CASE WHEN event_type = 'view' THEN event_id END) AS g FROM events GROUP BY 1),
listed AS (SELECT DISTINCT '{SITE}/u/' || user_id AS url FROM events WHERE event_type = 'purchase' AND value > 50)"""


def _feed_flags(spark, sf):
    events = table(spark, sf, "events")
    known = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("feed"), text(f"{SITE}/u/", F.col("c_custkey")).alias("url")
    )
    seen = F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).cast("string")
    state = events.groupBy(F.col("user_id").alias("feed")).agg(seen.alias("last_guid"))
    listed = events.filter("event_type = 'purchase' and value > 50").select(text(f"{SITE}/u/", F.col("user_id")).alias("url"))
    return stats.feed_stats(known, state, listed)


@query(f"""WITH {_FEED_SQL} SELECT feed, s.feed IS NOT NULL AS seen, g IS NOT NULL AS has_guid, l.url IS NOT NULL AS blacklisted
FROM feeds f LEFT JOIN state s USING (feed) LEFT JOIN listed l USING (url)""")
def feed_stats(spark, sf):
    return _feed_flags(spark, sf)


@query(f"""WITH {_FEED_SQL} SELECT count(*) AS total_feeds, count(*) FILTER (l.url IS NULL) AS active_feeds, count(g) AS feeds_with_guid,
  count(l.url) AS blacklisted_feeds FROM feeds f LEFT JOIN state s USING (feed) LEFT JOIN listed l USING (url)""")
def feed_totals(spark, sf):
    return stats.feed_totals(_feed_flags(spark, sf))


@query(f"""WITH {PARSED_SQL}, i AS (SELECT category, is_modified, coalesce(api_id,
  TRY_CAST(nullif(regexp_extract(url, '-(\\d+)/?$', 1), '') AS BIGINT)) AS api_id FROM parsed)
SELECT 'all' AS id_list, category, api_id FROM i WHERE api_id IS NOT NULL
UNION ALL SELECT 'modified', category, api_id FROM i WHERE api_id IS NOT NULL AND is_modified""")
def id_lists(spark, sf):
    return stats.id_lists(parsed_urls(spark, sf))


@query(f"""WITH {PARSED_SQL} SELECT category, count(*) AS now, count(*) FILTER (lastmod < '2000-01-01') AS before,
  count(*) - count(*) FILTER (lastmod < '2000-01-01') AS drift FROM parsed GROUP BY 1""")
def count_drift(spark, sf):
    parsed = parsed_urls(spark, sf)

    def counts(df):
        return df.groupBy("category").agg(F.count("*").alias("n"))

    return stats.count_drift(counts(parsed), counts(parsed.filter("lastmod < '2000-01-01'")))


@query(f"""WITH {PARSED_SQL}, done AS (SELECT DISTINCT 'episodes' AS category,
    '{SITE}/episodes/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS url
    FROM lineitem WHERE l_returnflag = 'R'),
picked AS (SELECT category, url, min(pos) AS pos FROM parsed WHERE is_modified OR category = 'movies' GROUP BY 1, 2)
SELECT category, url, pos FROM picked p WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.category = p.category AND d.url = p.url)
  AND url NOT IN (SELECT '{SITE}/movies/film-' || p_partkey FROM part WHERE p_size = 1)
QUALIFY row_number() OVER (PARTITION BY category ORDER BY pos, url) <= 5000""")
def spider_frontier(spark, sf):
    item = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    done = item.select(F.lit("episodes").alias("content_type"), text(f"{SITE}/episodes/", key).alias("url"))
    listed = table(spark, sf, "part").filter("p_size = 1").select(text(f"{SITE}/movies/film-", F.col("p_partkey")).alias("url"))
    parsed = parsed_urls(spark, sf, source).withColumn("category", F.when(F.col("category") == "shows", "series").otherwise(F.col("category")))
    # Some films are spelled with a ligature; what is known of them is not.
    ligature = F.when((F.col("category") == "movies") & (F.col("pos") % 2 == 0), F.replace("url", F.lit("film-"), F.lit("\ufb01lm-"))).otherwise(F.col("url"))
    return frontier.start_urls(parsed.withColumn("url", ligature), done, listed, cap=5000)


@query(f"""SELECT '{SITE}/tvshows/' || o_orderkey AS url, o_orderstatus AS content_type FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def unseen_frontier(spark, sf):
    known = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(text(f"{SITE}/tvshows/", F.col("l_orderkey")).alias("url"))
    found = table(spark, sf, "orders").select(text(f"{SITE}/tvshows/", F.col("o_orderkey")).alias("url"), F.col("o_orderstatus").alias("content_type"))
    return frontier.exclude_seen(found, known, ["url"])
