from datetime import datetime

from pyspark.sql import functions as F

from playbill.functions import dates, media, numbers, text, urls

C = F.col("c")


def test_digits_and_text(evaluate):
    assert evaluate(["فصل ۱۲", "٣", None, ""], text.normalize_digits(C)) == ["فصل 12", "٣", "", ""]
    assert evaluate(["ＡＢＣ ۱", "ﬁn", None], text.normalize_text(C, lower=True)) == ["abc 1", "fin", ""]
    assert evaluate(["a\0b"], text.sanitize_text(C)) == ["a b"]


def test_challenge_labels(evaluate):
    pages = ["<div class='G-Recaptcha'>", "x h-captcha y", "Security code", "plain", "security check"]
    assert evaluate(pages, text.challenge_label(C), text.is_blocked(C)) == [
        ("recaptcha", True),
        ("hcaptcha", True),
        ("simple", False),
        ("", False),
        ("", True),
    ]


def test_normalize_url_options(evaluate):
    base = "https://b.example/dir/"
    given = ["https://h.example/A%20B+c%zz/?q=1/#x/", "/t/x/../y/", "z/", None, "", "https://h.example/", "//o.example/a/"]
    assert evaluate(given, urls.normalize_url(C, base=base)) == [
        "https://h.example/A B+c%zz?q=1/#x/",
        "https://b.example/t/y",
        "https://b.example/dir/z",
        "",
        "",
        "https://h.example",
        "https://o.example/a",
    ]
    fancy = ["https://h.example/%DB%B1%D9%81/", "https://h.example/ＡB", "https://h.example/a b"]
    assert evaluate(fancy, urls.normalize_url(C, nfkc=True)) == [
        "https://h.example/1ف",
        "https://h.example/AB",
        "https://h.example/a b",
    ]
    assert evaluate(fancy, urls.normalize_url(C, nfkc=True, requote=True)) == [
        "https://h.example/1%D9%81",
        "https://h.example/AB",
        "https://h.example/a%20b",
    ]
    assert evaluate(["https://H.example/ABC/"], urls.normalize_url(C, lower=True)) == ["https://H.example/abc"]


def test_normalize_url_is_idempotent(evaluate):
    given = ["https://h.example/a//", "https://h.example/%DB%B1/x/?a=/", "https://h.example/x/#f/", "https://h.example/a%2Fb/"]
    once = evaluate(given, urls.normalize_url(C))
    assert evaluate(once, urls.normalize_url(C)) == once


def test_absolute_url(evaluate):
    refs = ["http://x/y", "//x/y", "/a/../b?c", "d", "../d", "?q", "#f", "", "./e/./g", "../../../up"]
    assert evaluate(refs, urls.absolute_url(C, F.lit("https://h.example/one/two?x=1#y"))) == [
        "http://x/y",
        "https://x/y",
        "https://h.example/b?c",
        "https://h.example/one/d",
        "https://h.example/d",
        "https://h.example/one/two?q",
        "https://h.example/one/two?x=1#f",
        "https://h.example/one/two?x=1#y",
        "https://h.example/one/e/g",
        "https://h.example/up",
    ]


def test_classifiers(evaluate):
    given = {
        "https://h.example/movies/x": ("movies", "movies", "movies", "x"),
        "https://h.example/movies-2020/x": ("movies", None, "movies", "x"),
        "https://h.example/series-7/x": ("shows", "shows", None, "x"),
        "https://h.example/series-22/x": ("shows", "shows", "shows", "x"),
        "https://h.example/iranian-series/x": ("shows", None, "shows", "x"),
        "https://h.example/episodes/x?y=1": ("episodes", "episodes", "episodes", "x?y=1"),
        "https://h.example/x?post_type=tvshows": ("shows", None, None, "x"),
        "https://h.example/tvshows/?post_type=movies": ("movies", "shows", "shows", "tvshows"),
        "https://h.example/a/movies/b/c": ("movies", "movies", "movies", "c"),
        "https://h.example/genres/movies/x": ("movies", "movies", None, "x"),
        "https://h.example/about": (None, None, None, "about"),
        "https://h.example": (None, None, None, None),
    }
    found = evaluate(list(given), urls.content_type(C), urls.start_url_type(C), urls.sitemap_category(C), urls.slug_of(C))
    assert dict(zip(given, found)) == given


def test_post_ids(evaluate):
    given = ["https://h.example/?p=5", "https://h.example/?x=1&p=6", "https://h.example/77/", "https://h.example/a-8/",
             "https://h.example/a-9-b", "https://h-1.example/x", None, "https://h.example/99999999999999999999"]
    assert evaluate(given, urls.post_id(C, "api")) == [5, None, 77, None, 9, None, None, None]
    assert evaluate(given, urls.post_id(C, "sitemap")) == [5, 6, None, 8, 9, None, None, None]


def test_sitemap_names(evaluate):
    given = ["https://h/movies-sitemap.xml", "https://h/tvshows-sitemap12.xml", "https://h/post-sitemap.xml", "https://h/post_tag-sitemap.xml", "https://h/map.xml"]
    assert evaluate(given, urls.sitemap_type(C)) == ["movies", "shows", "general", "post_tag", "other"]
    assert evaluate(["movies", "other", "post_tag"], urls.sitemap_priority(C)) == [1, 5, 999]


def test_cache_key(evaluate):
    import hashlib

    long = "https://some-long-host-name.example.com:80/" + "path/" * 20
    keys = evaluate([long, "https://h.example/a%20b", "", None], urls.cache_key(C))
    assert keys[0] == "some_long_host_name__path_path_path_path_path_path__".replace("__", "_") + hashlib.md5(long.encode()).hexdigest()[:12]
    assert keys[1] == "h_example_a_b_" + hashlib.md5(b"https://h.example/a b").hexdigest()[:12]
    assert keys[2:] == ["empty_url", "empty_url"]


def test_quality(evaluate):
    given = ["/x/720p/a.mp4", "x.1080p.mp4", "?quality=500", "/a/fullhd.mp4", "/a/ultrahd.mp4", "-000-9999p-", "/a/hd.mp4", "", None, "zz", "/1081/"]
    assert evaluate(given, media.quality_from_url(C)) == [
        "720", "1080", "720", "1080", "2160", "4320", "720", "unknown", "unknown", "unknown", "1440",
    ]
    assert evaluate(["https://cdn.example/HD", "https://cdn.example/x"], media.quality_from_url(C, ("cdn.example",))) == ["720", "480"]
    assert evaluate(["SD", "4K", "720p", "best"], media.standard_quality(C)) == ["480", "2160", "720", "best"]


def test_dates(evaluate):
    day = datetime(2024, 1, 5)
    given = ["2024-1-5", "2024/01/05", "1/5/2024", "05-01-2024", "2024-01-05T00:00:00Z", "2024-01-05T03:30:00+03:30", "junk", None, "2024"]
    assert evaluate(given, dates.any_date(C)) == [day] * 6 + [None, None, None]
    feed = ["Fri, 05 Jan 2024 00:00:00 +0000", "Fri, 5 Jan 2024 00:00:00 GMT", "05 Jan 2024 03:30:00 +0330", "2024-01-05T00:00:00Z", "never"]
    assert evaluate(feed, dates.rfc822_timestamp(C)) == [day] * 4 + [None]
    after = dates.modified_after(dates.iso_timestamp(C), F.lit("2024-01-05").cast("timestamp"), on_unparsed=True)
    assert evaluate(["2024-01-05", "2024-01-06", "bad"], after) == [False, True, True]


def test_numbers(evaluate):
    assert evaluate(["Rated 7.5/10", "9", "none"], numbers.first_number(C)) == [7.5, 9.0, None]
    assert evaluate(["1,234 votes", "x"], numbers.counted(C)) == [1234, None]
    assert evaluate(["C (12)", "C 12"], numbers.parenthesised(C)) == [12, None]
    assert evaluate(["1,234.9", "-2.7", "x", None, "7"], numbers.coerce_int(C)) == [1234, -2, 0, None, 7]


def test_episode_numbering(spark):
    rows = [
        ("2 - 5", ["Season 9"], "u-ep7", "t", (2, 5)),
        ("1 - 1", ["Home", "Season 3", "season 4"], "u-episode_7", "t", (4, 7)),
        (None, None, "u", "Episode 9", (1, 9)),
        ("3 - x", [], "u", "", (3, 1)),
        ("x - 3", [], "u", None, (1, 1)),
        ("1 - 2 - 3", [], "u", None, (1, 1)),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, l string, c array<string>, u string, t string")
    season, episode = numbers.episode_numbering(*[F.col(x) for x in "lcut"])
    found = [tuple(r) for r in df.orderBy("i").select(season, episode).collect()]
    assert found == [r[4] for r in rows]
