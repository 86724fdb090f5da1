"""Operators against brute force, with one key holding a large share of the rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from playbill import schemas
from playbill.operators import api, errors, feeds, frontier, grouping, joins, nesting, quality, upsert


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def skewed(n=3000, keys=40, seed=7):
    """Rows ``(key, pos)`` of which a third share one key."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.34 else f"k{rnd.randrange(keys)}", i) for i in range(n)]


def test_first_n_per_group(spark):
    data = skewed()
    df = spark.createDataFrame(data, "key string, pos int").repartition(7)
    want = defaultdict(list)
    for key, pos in data:
        want[key].append(pos)
    want = sorted(((k, p) for k, v in want.items() for p in sorted(v)[:50]), key=repr)
    assert rows(grouping.first_n_per_group(df, ["key"], ["pos"], 50)) == want


def test_first_n_beyond_the_group_limit_rule(spark):
    df = spark.range(5000).select(F.lit("hot").alias("key"), F.col("id").alias("pos")).repartition(7)
    kept = grouping.first_n_per_group(df, ["key"], ["pos"], 1500)
    assert kept.agg(F.count("*"), F.max("pos")).first()[:] == (1500, 1499)


def test_keep_latest(spark):
    df = spark.createDataFrame(
        [("a", "u", "2024-01-01", 0, "x"), ("a", "u", "2024-01-02", 1, "y"), ("a", "u", "2024-01-02", 2, "z"), ("a", "v", None, 3, "n"), ("a", "v", "", 4, "m")],
        "category string, url string, lastmod string, pos int, note string",
    )
    assert rows(grouping.keep_latest(df, ["category", "url"]).select("url", "note")) == [("u", "y"), ("v", "n")]


def test_collect_in_blocks_is_whole(spark):
    data = skewed(900)
    df = spark.createDataFrame([(k, f"u{p}") for k, p in data] * 2, "key string, url string")
    blocks = grouping.collect_in_blocks(df, ["key"], F.col("url"), 8, "urls").collect()
    want = defaultdict(set)
    for k, p in data:
        want[k].add(f"u{p}")
    got, block_of = defaultdict(list), {}
    for r in blocks:
        assert r.urls == sorted(r.urls) and 0 <= r.block < 8
        got[r.key] += r.urls
        for u in r.urls:
            assert block_of.setdefault(u, r.block) == r.block
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert max(len(r.urls) for r in blocks) < 80 and len([r for r in blocks if r.key == "hot"]) == 8


def test_ranks_over_ranges(spark):
    data = [(x, i) for i, x in enumerate([5, 5, 5, 1, 9, None, 3, 3] * 40)]
    df = spark.createDataFrame(data, "x int, i int").repartition(5)
    got = grouping.ranked(df, [F.col("x").desc_nulls_last()], "place").collect()
    assert sorted(r.place for r in got) == list(range(1, len(data) + 1))
    in_order = [r.x for r in sorted(got, key=lambda r: r.place)]
    assert in_order == sorted((x for x, _ in data), key=lambda x: (x is None, -(x or 0)))
    assert grouping.ranked(df.limit(0), [F.col("x")], "place").count() == 0


def test_exclusion_by_filter_equals_the_anti_join(spark):
    rnd = random.Random(11)
    seen = spark.createDataFrame([(rnd.choice("ab"), f"u{rnd.randrange(4000)}") for _ in range(3000)] + [("a", None)], "kind string, url string")
    rows_ = [(rnd.choice("abc"), f"u{rnd.randrange(8000)}", i) for i in range(4000)] + [("a", None, 9999), (None, "u1", 10000)] + [("a", "u7", -1)] * 300
    df = spark.createDataFrame(rows_, "kind string, url string, n int")
    want = rows(frontier.exclude(df, seen, ["kind", "url"]))
    # A filter far too small for its keys tells less, not otherwise.
    for blocks in (64, 1):
        assert rows(frontier.exclude_seen(df, seen, ["kind", "url"], blocks=blocks)) == want
    assert rows(frontier.exclude_seen(df, seen.limit(0), ["kind", "url"])) == rows(df)
    told = frontier.seen_filter(seen, ["kind", "url"], 64)
    assert told.count() <= 64 and {len(r["_bits"]) for r in told.collect()} == {4096}


def test_prefixes_in_one_sweep(spark):
    rnd = random.Random(12)
    texts = sorted({"".join(rnd.choices("ab/ü", k=rnd.randrange(0, 9))) for _ in range(700)})
    probes = sorted({t[: rnd.randrange(len(t) + 1)] for t in texts for _ in range(2)})
    hot = [f"https://x/{i}" for i in range(3000)]
    texts += hot
    probes += ["https://x/", "https://x/2", "https://x/29", "https://x/299", "https://y"]
    left = spark.createDataFrame([(p,) for p in probes * 2] + [(None,)], "p string")
    right = spark.createDataFrame([(t,) for t in texts] + [(None,), (texts[0],)], "t string").repartition(7)
    want = sorted((t, p) for t in texts for p in probes if t.startswith(p))
    got = sorted(tuple(r) for r in joins.prefix_pairs(left, right).collect())
    assert got == want
    assert joins.prefix_pairs(left.limit(0), right).count() == 0 and joins.prefix_pairs(left, right.limit(0)).count() == 0

def reference_tracker(events, base):
    """The rule, one event at a time."""
    level = {"http_500": "medium", "my_api_404": "high", "db_integrity_error": "critical", "warning": "low", "odd": "medium"}
    limits = {"critical": max(1, base // 3), "high": max(1, base // 2), "medium": base, "low": base * 2}
    counts, last, listed = defaultdict(int), {}, {}
    for url, kind, ts, event_id in sorted(events, key=lambda e: (e[2], e[3])):
        url = url.rstrip("/")
        if not url or url in listed:
            continue
        counts[url, kind] += 1
        last[url, kind] = ts
        if counts[url, kind] >= limits[level[kind]]:
            listed[url] = event_id
    return counts, last, listed


def failure_events(n=4000):
    rnd = random.Random(3)
    kinds = ["http_500", "my_api_404", "db_integrity_error", "warning", "odd"]
    weights = [8, 1, 1, 10, 8]
    out = []
    for i in range(n):
        url = "https://x/hot" if rnd.random() < 0.34 else f"https://x/{rnd.randrange(300)}"
        kind = rnd.choices(kinds[:1] + kinds[3:], [1, 1, 1])[0] if url.endswith("hot") else rnd.choices(kinds, weights)[0]
        out.append((url + ("/" if rnd.random() < 0.2 else ""), kind, f"2024-01-{1 + i * 27 // n:02d} 10:00:00", i))
    return out + [("", "warning", "2024-01-01 00:00:00", n), (None, "warning", "2024-01-01 00:00:00", n + 1)]


def test_error_tracker_matches_one_by_one(spark):
    events = failure_events()
    df = spark.createDataFrame(events, "url string, error_type string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    for base in (1, 3, 10):
        counts, last, listed = reference_tracker([e for e in events if e[0]], base)
        counted = errors.counted_events(df.repartition(9), base)
        state = {(r.url, r.error_type): (r.n, str(r.last_ts)) for r in errors.tracked(counted).collect()}
        assert state == {k: (n, last[k]) for k, n in counts.items()}
        assert {r.url: r.event_id for r in errors.blacklist(counted).collect()} == listed


def test_severity_and_expiry(spark):
    df = spark.createDataFrame([("api_404",), ("x_db_save_error_y",), ("http_999",), ("minor_issue",)], "t string")
    found = [tuple(r) for r in df.select(errors.severity(F.col("t")), errors.threshold(F.col("t")), errors.expiry_days(F.col("t"))).collect()]
    assert found == [("high", 1, 14), ("high", 1, 14), ("medium", 3, 7), ("low", 6, 3)]
    state = spark.createDataFrame(
        [("a", "warning", 1, "2024-01-07 00:00:00"), ("a", "http_500", 1, "2024-01-02 23:59:59"), ("b", "warning", 9, "2024-01-06 23:59:59"), ("c", "api_404", 1, None)],
        "url string, error_type string, n long, ts string",
    ).select("url", "error_type", "n", F.to_timestamp("ts").alias("last_ts"))
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    live, kept = errors.expire(state, listed, F.lit("2024-01-10").cast("timestamp"))
    assert rows(live.select("url", "error_type")) == [("a", "warning")]
    assert rows(kept) == [("a",)]


def test_since_marker(spark):
    items = spark.createDataFrame(
        [(f, p, f"{f}{p}") for f in ("a", "b", "c", "d") for p in range(4)] + [("a", 9, "a2")], "feed string, pos int, guid string"
    )
    state = spark.createDataFrame([("a", "a2"), ("b", ""), ("c", "gone")], "feed string, last_guid string")
    fresh = feeds.since_marker(items, state)
    assert rows(fresh.groupBy("feed").count()) == [("a", 2), ("b", 4), ("c", 4), ("d", 4)]
    assert rows(feeds.next_markers(fresh, state).select("feed", "last_guid")) == [("a", "a0"), ("b", "b0"), ("c", "c0"), ("d", "d0")]


def test_pending_queue(spark):
    layout = "content_type string, url string, pos int"
    pending = spark.createDataFrame([("shows", "p1", 0), ("shows", "p2", 1)], layout)
    found = spark.createDataFrame([("shows", "p2", 0), ("shows", "n1", 1), ("shows", "done", 2), ("shows", "n1", 0)], layout)
    done = spark.createDataFrame([("shows", "done")], "content_type string, url string")
    queue = frontier.add_pending(pending, found, done)
    assert [r.url for r in queue.orderBy("wave", "pos").collect()] == ["p1", "p2", "n1"]
    assert [r.url for r in frontier.pending_urls(queue, "shows", 2).collect()] == ["p1", "p2"]
    again = frontier.mark_processed(done, done.unionByName(pending.select("content_type", "url")))
    assert rows(frontier.mark_processed(again, again)) == rows(again)


def test_start_urls(spark):
    parsed = spark.createDataFrame(
        [
            ("series", False, "https://x/tvshows/a/", 0),
            ("series", True, "https://x/tvshows/b/", 1),
            ("series", True, "https://x/tvshows/b", 2),
            ("series", True, "https://x/tvshows/c", 3),
            ("movies", False, "https://x/movies/m", 0),
            ("movies", False, "https://x/about", 1),
            ("movies", False, "https://x/movies/bad", 2),
        ],
        "category string, is_modified boolean, url string, pos int",
    )
    done = spark.createDataFrame([("shows", "https://x/tvshows/c")], "content_type string, url string")
    bad = spark.createDataFrame([("https://x/movies/bad",)], "url string")
    assert rows(frontier.start_urls(parsed, done, bad).select("url")) == [("https://x/movies/m",), ("https://x/tvshows/b",)]
    full = frontier.start_urls(parsed, done, bad, incremental=False, cap=1)
    assert rows(full.select("url")) == [("https://x/movies/m",), ("https://x/tvshows/a",)]


def test_prefix_lookup(spark):
    keyed = spark.createDataFrame([("https://x/show-1",), ("https://x/show-10",), ("https://x/Show-2/",)], "url string")
    probe = spark.createDataFrame([(1, "https://x/show-1"), (2, "https://x/show-"), (3, "https://x/show-2"), (4, "none")], "id int, url string")
    found = joins.prefix_lookup(probe, keyed, "url")
    assert rows(found.select("id", "matched", "match")) == [
        (1, "https://x/show-1", "exact"),
        (2, "https://x/show-1", "prefix"),
        (2, "https://x/show-10", "prefix"),
    ]
    loose = joins.prefix_lookup(probe, keyed, "url", ignore_case=True)
    assert (3, "https://x/Show-2/", "prefix") in rows(loose.select("id", "matched", "match"))


def test_upsert(spark):
    layout = "url string, title string, lastmod string, is_new int, last_scraped string"
    old = spark.createDataFrame([("a", "A", "1", 0, "t0"), ("b", "B", "1", 0, "t0"), ("c", "C", None, 0, "t0"), ("d", "D", "1", 1, "t0")], layout)
    batch = spark.createDataFrame(
        [("a/", "1", 1, 0), ("b", "2", 1, 1), ("c", None, 1, 2), ("e", "9", 0, 3), ("e", "8", 0, 4), ("", "8", 0, 5), (None, "8", 0, 6)],
        "url string, lastmod string, is_new int, pos int",
    )
    merged = upsert.upsert(old, batch, F.lit("t1"))
    want = [("a", "A", "1", 0, "t1"), ("b", "B", "2", 1, "t1"), ("c", "C", None, 0, "t1"), ("d", "D", "1", 1, "t0"), ("e", None, "8", 1, "t1")]
    assert rows(merged) == want
    again = upsert.upsert(merged, batch, F.lit("t1"))
    assert rows(again) == want


def test_missing_parents_keep_existing(spark):
    parents = spark.createDataFrame([("s1", "One")], "url string, title string")
    children = spark.createDataFrame([("s1",), ("s2",), ("s2",), ("",)], "show_url string")
    assert rows(joins.add_missing_parents(children, parents, "show_url")) == [("s1", "One"), ("s2", None)]


def episodes_of(spark, per_show):
    data = [
        (f"e{s}-{i}", f"https://x/{s}/", None if i % 7 == 0 else i % 3, i, f"T{i}", None, None, None, None)
        for s, n in per_show.items()
        for i in range(n)
    ]
    layout = f"url string, show_url string, season_number int, episode_number int, title string, air_date string, thumbnail string, lastmod string, video_files array<{schemas.VIDEO_FILE}>"
    return data, spark.createDataFrame(data, layout)


def test_nesting_divides_shows(spark):
    data, eps = episodes_of(spark, {"hot": 500, "a": 12, "b": 3})
    shows = spark.createDataFrame([("https://x/hot",), ("https://x/a/",), ("https://x/b",), ("https://x/none",)], "url string")
    docs = nesting.nest_seasons(shows, eps, blocks=8).collect()
    hot = [d for d in docs if d.url == "https://x/hot"]
    assert sorted(d.block for d in hot) == list(range(8)) and [d.block for d in hot if d.lead] == [0]
    assert max(len(d.full_episodes) for d in hot) < 100
    for url in ("https://x/hot", "https://x/a/", "https://x/b"):
        own = [d for d in docs if d.url == url]
        key = url.rstrip("/") + "/"
        found = [e.url for d in own for s in d.seasons for e in s.episodes]
        assert sorted(found) == sorted(r[0] for r in data if r[1] == key) and sum(d.lead for d in own) == 1
        for d in own:
            for s in d.seasons:
                assert s.episode_count == sum(1 for r in data if r[1] == key and (r[2] or 0) == s.season_number)
                assert [e.episode_number for e in s.episodes] == sorted(e.episode_number for e in s.episodes)
            assert len(d.full_episodes) == sum(len(s.episodes) for s in d.seasons)
    one = {d.url: d for d in nesting.nest_seasons(shows, eps, blocks=1).collect()}
    assert len(one) == 4 and all(d.lead and d.block == 0 for d in one.values())
    assert [(s.title, s.episode_count) for s in one["https://x/a/"].seasons] == [("Season 0", 5), ("Season 1", 3), ("Season 2", 4)]
    assert one["https://x/none"].seasons == []
    flat = nesting.flatten_seasons(nesting.nest_seasons(shows, eps, blocks=8).withColumnRenamed("url", "show"), ["show"])
    assert sorted(r.url for r in flat.collect() if r.url) == sorted(r[0] for r in data)


def test_frontend_maps(spark):
    movies = spark.createDataFrame([("A", 1), ("A", 2), ("", 3), (None, 4), ("B", 5)], "title_en string, pos int")
    maps = nesting.title_map(nesting.keyed_by_title(movies.withColumn("n", F.col("pos")), "pos")).collect()
    assert all(len(r.entries) == 1 for r in maps)
    assert {k: v.n for r in maps for k, v in r.entries.items()} == {"A": 2, "B": 5}


def test_list_coercion_and_encoding(evaluate):
    from pyspark.sql.types import StringType

    given = ['["a", "b"]', "[]", '"x"', "7", "0", '""', "null", "{}", '{"a": 1}', "plain", "[1, 2", "", None, "true", "false"]
    c = F.col("c")
    assert evaluate(given, quality.coerce_list(c)) == [["a", "b"], [], ["x"], ["7"], [], [], [], [], ['{"a": 1}'], [], [], [], [], ["true"], []]
    assert evaluate(["", None, "[1]", "x y"], quality.encode_json(c, StringType())) == ["[]", "[]", "[1]", '["x y"]']


def test_records(spark):
    df = spark.createDataFrame(
        [("https://x/movies/1", "8.5", "1,200", '[{"url":"https://c/a-720.mp4"}, {"quality":"unknown","url":"https://c/HD.mp4"}]', None, "1999.9"), ("ftp://x", "n/a", None, "broken", "0", "x")],
        "url string, rating string, rating_count string, video_files string, is_new string, year string",
    )
    a, b = quality.coerce_records(df).orderBy("url", ascending=False).collect()
    assert (a.rating, a.rating_count, a.is_new, a.year) == (8.5, 1200, 1, 1999)
    assert [(v.quality, v.size, v.mirror_url) for v in a.video_files] == [("720", "", None), ("720", "", None)]
    assert (b.rating, b.rating_count, b.is_new, b.year, b.video_files) == (0.0, None, 0, 0, [])
    checked = quality.validate(quality.coerce_records(df).withColumn("title_en", F.lit("")), "movies").orderBy("url").first()
    assert checked["errors"] == ["URL must start with http:// or https://", "English title is required", "Year must be between 1900 and 2100"]


def test_clean_names(spark):
    df = spark.createDataFrame([([" a", "b ", "", "a", "  "],)], "n array<string>")
    assert df.select(quality.clean_names(F.col("n"))).first()[0] == ["a", "b"]


def test_conform_twice(spark):
    layout = StructType.fromDDL("url string, is_new int, language_code string, rating double")
    once = schemas.conform(spark.createDataFrame([("u", "extra")], "url string, other string"), layout)
    assert once.columns == ["url", "other", "is_new", "language_code", "rating"]
    assert rows(schemas.conform(once, layout)) == [("u", "extra", 1, "fa", None)]


def test_incomplete_and_empty_custom_fields(spark):
    from playbill.sources.landed import parse_posts

    posts = [
        '{"id":1,"link":"u1","title":{"rendered":"T"},"acf":[],"modified_gmt":"2024-01-01T00:00:00"}',
        '{"id":2,"link":"u2","title":{"rendered":"T"},"acf":{"season_count":"3","rating":null},"modified_gmt":"2024-01-03T00:00:00"}',
        '{"id":3,"title":{"rendered":"T"},"acf":{"season_count":1}}',
        '{"id":4,"link":"u4","title":{"rendered":""},"acf":{"season_count":1}}',
        "not json",
    ]
    df = parse_posts(spark.createDataFrame([(p,) for p in posts], "body string"))
    assert [(r.api_id, r.season_count, r.rating, r.rating_count) for r in api.map_posts(df, "shows").collect()] == [(2, 3, 0.0, None)]
    movies = api.map_posts(df, "movies", F.lit("2024-01-02").cast("timestamp"))
    assert sorted((r.api_id, r.is_modified, r.genres) for r in movies.collect()) == [(2, 1, None), (4, 1, None)]


def test_whole_numbers_with_a_fraction(spark):
    from playbill.sources.landed import parse_posts

    posts = [f'{{"id":{i},"link":"u{i}","title":{{"rendered":"T"}},"acf":{{"season_number":{n},"episode_number":{n}}}}}' for i, n in enumerate(['12.0', '"7"', '"x"', '1e1', 'null', '99999999999'])]
    df = parse_posts(spark.createDataFrame([(p,) for p in posts], "body string"))
    assert [r.season_number for r in api.map_posts(df, "episodes").orderBy("api_id").collect()] == [12, 7, 1, 10, 1, 1]


def test_episode_counts_by_prefix(spark):
    shows = spark.createDataFrame([("https://x/a",), ("https://x/ab/",), ("https://x/c",), ("",)], "url string")
    eps = spark.createDataFrame([("https://x/ab",), ("https://x/ab/",), ("https://x/c-2",), ("https://x/c-2",), ("https://x/ab-3",), (None,)], "show_url string")
    assert rows(upsert.episode_counts(shows, eps)) == [("", 1), ("https://x/a", 0), ("https://x/ab/", 2), ("https://x/c", 0)]
    assert rows(upsert.episode_counts(shows, eps, by_prefix=True)) == [("", 1), ("https://x/a", 3), ("https://x/ab/", 2), ("https://x/c", 2)]


def test_series_from_a_batch(spark):
    from playbill.operators import flows
    from playbill.schemas import schema_of

    none = {k: spark.createDataFrame([], schema_of(k)) for k in ("shows", "episodes")}
    shows = spark.createDataFrame([("https://x/a", "A", "1")], "url string, title_en string, lastmod string")
    eps = spark.createDataFrame([("e1", "https://x/a/", 1), ("e2", "https://x/a", 2), ("e3", "https://x/b/", 1)], "url string, show_url string, episode_number int")
    built, children = flows.build_series(shows, eps, none["shows"], none["episodes"], F.lit("t"))
    assert rows(built.select("url", "title_en", "episode_count", "is_new")) == [("https://x/a", "A", 2, 1), ("https://x/b", None, 1, None)]
    assert built.columns == none["shows"].columns and rows(children.select("show_url").distinct()) == [("https://x/a",), ("https://x/b",)]
    again, _ = flows.build_series(shows.limit(0), eps.limit(0), built, children, F.lit("t2"))
    assert rows(again.select("url", "episode_count")) == [("https://x/a", 2), ("https://x/b", 1)]


def test_lastmod_comes_from_the_sitemap(spark):
    from playbill.operators import flows
    from playbill.sources.landed import parse_posts

    posts = parse_posts(spark.createDataFrame([('{"id":1,"link":"https://x/movies/a/","title":{"rendered":"A"},"modified_gmt":"2024-01-01T00:00:00"}',), ('{"id":2,"link":"https://x/movies/b","title":{"rendered":"B"},"modified_gmt":"2024-02-01T00:00:00"}',)], "body string"))
    pages = spark.createDataFrame([("https://x/movies/c-33", "C", None)], "url string, title_en string, lastmod string")
    listed = spark.createDataFrame([("https://x/movies/a", "2024-03-01", 1), ("https://x/movies/a", "2024-02-01", 1), ("https://x/movies/c-33/", "2024-04-01", None), ("", "x", 3)], "url string, lastmod string, api_id long")
    got = flows.catalogue_batch("movies", posts, pages, sitemap=listed)
    assert rows(got.select("url", "lastmod", "api_id")) == [("https://x/movies/a", "2024-03-01", 1), ("https://x/movies/b", "2024-02-01T00:00:00", 2), ("https://x/movies/c-33", "2024-04-01", 33)]
    assert rows(flows.catalogue_batch("movies", posts).select("url", "source")) == [("https://x/movies/a", "api"), ("https://x/movies/b", "api")]


def test_merge_sources(spark):
    api_side = spark.createDataFrame([("a", None, ["v"], "api"), ("b", "B", [], "api")], "url string, title string, video_files array<string>, source string")
    page = spark.createDataFrame([("a", "A", ["h"], "x", "html"), ("b", "Z", ["h"], "x", "html"), ("c", None, [], None, "html")], "url string, title string, video_files array<string>, poster string, source string")
    merged = joins.merge_sources(api_side, page, {"title": F.lit("Unknown Movie")})
    got = {r.url: (r.title, r.video_files, r.poster, r.source) for r in merged.collect()}
    assert got == {"a": ("A", ["v"], "x", "api"), "b": ("B", ["h"], "x", "api"), "c": ("Unknown Movie", None, None, "html")}
