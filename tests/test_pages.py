"""Page extraction and landed files."""

import pytest
from pyspark.sql import functions as F

from playbill.operators import html
from playbill.operators.page_parser import read_page
from playbill.session import fresh_path
from playbill.sources import landed, sinks, xml


def pages(spark, *texts, url="https://h.example/tvshows/my-show/"):
    return spark.createDataFrame([(url, t) for t in texts], "url string, html string")


@pytest.mark.parametrize(
    ("rule", "markup", "want"),
    [
        (".a b::text", "<p class='x a'><i><b>1</b></i><b>2<i>no</i>3</b></p><b>4</b>", ["1", "2", "3"]),
        (".a > b::text", "<p class=a><i><b>1</b></i><b>2</b></p>", ["2"]),
        ("li::text", "<ul><li>1<li>2<ul><li>3</ul></ul>", ["1", "2", "3"]),
        ("p::text", "<p>1<p>2<div>3</div><p>4", ["1", "2", "4"]),
        ("td:nth-child(2)::text", "<table><tr><td>1<td>2<tr><td>3<td>4</table>", ["2", "4"]),
        ("li:nth-last-child(2)::text", "<ul><li>1<li>2<li>3</ul>", ["2"]),
        ("span.d + span.d::text", "<span class=d>1</span><span class=d>2</span><b></b><span class=d>3</span>", ["2"]),
        ("a[href$='.mp4']::attr(href)", "<a href='x.mp4'></a><a href='y'></a><a></a>", ["x.mp4"]),
        ("a[href*='/s/']::attr(href)", "<a href='/s/1'><a href='/t'>", ["/s/1"]),
        ("form[id^='dl']::attr(id)", "<form id=dl1></form><form id=x></form>", ["dl1"]),
        ("#c [itemprop='d'] a::text", "<div id=c><p itemprop=d><a>1</a></p></div><p itemprop=d><a>2</a></p>", ["1"]),
        ("h1::text", "<script>var x = '<h1>no</h1>'</script><!-- <h1>no</h1> --><H1>A &amp; B</H1><h1>open", ["A & B", "open"]),
        ("img::attr(src)", "<div><img src=1><img src=2/></div>", ["1", "2/"]),
        ("b::text", "</p></div><b>1</b>", ["1"]),
    ],
)
def test_rules(rule, markup, want):
    assert read_page(markup, {"x": [rule]})["x"] == [want]


def test_empty_pages():
    assert read_page(None, {"x": ["a::text"]}) == {"x": [[]]}
    assert read_page("<<<>>> &", {"x": ["a::text"]}) == {"x": [[]]}


def test_show_page_fallbacks(spark):
    rich = """<div class=data><h1> A ۱ </h1><h2>ﻓ ۲</h2></div><div class=poster><img data-src="/p.jpg"></div>
      <meta name=description content=" m "><div class=sgeneros><a> x</a><a>x</a><a> </a></div>
      <span class=date> d1 </span><div class=imdb><span>IMDb ۷.۵</span><span class=votes>1,234 v</span></div>"""
    a, b = html.extract(pages(spark, rich, "<p>nothing"), "shows").collect()
    assert (a.title_en, a.title_fa, a.poster, a.description) == ("A 1", "ف 2", "https://h.example/p.jpg", "m")
    assert (a.genres, a.first_air_date, a.rating, a.rating_count) == (["x"], "d1", 7.5, 1234)
    assert (b.title_en, b.poster, b.genres, b.seasons, b.season_count, b.episode_count, b.episode_urls) == ("My Show", None, [], [], 0, 0, [])


def test_season_tree(spark):
    page = """<div class=temporadas><div><div class=se-q><span class=se-t>Season 2</span></div><div class=se-a><ul>
        <li><div class=numerando>2 - 3</div><div class=episodiotitle><a href=/episodes/c/>C</a></div>
        <li><a href="https://o.example/episodes/x-EP2">ignored</a>
        <li>no link<li><div class=numerando>2 - x</div><a href=/episodes/p>p</a></ul></div></div>
      <div><div class=se-q><span class=se-t>۱</span></div><div class=se-a><ul><li><a href=/episodes/q></a></ul></div></div><div></div></div>"""
    show = html.extract(pages(spark, page), "shows", ["seasons", "season_count", "episode_count", "episode_urls"]).first()
    assert [(s.season_number, [(e.episode_number, e.title, e.url) for e in s.episodes]) for s in show.seasons] == [
        (1, [(1, "Episode 1", "https://h.example/episodes/q")]),
        (2, [(2, "Episode 2", "https://o.example/episodes/x-EP2"), (3, "C", "https://h.example/episodes/c"), (3, "Episode 3", "https://h.example/episodes/p")]),
    ]
    assert (show.season_count, show.episode_count, len(show.episode_urls)) == (2, 4, 4)


def test_downloads_prefer_the_table(spark):
    table = "<div id=download><table><tr id=link-1><td><form><input name=fileid value=7></form><td> HD <td> 1 GB </table></div>"
    form = "<form id=dlform1><input name=fileid value=8></form><form id=dlform2></form>"
    a, b = html.extract(pages(spark, table + form, form + "<a href=v.720p.mp4>v</a>"), "movies", ["downloads", "video_files"]).collect()
    assert [tuple(d) for d in a.downloads] == [("7", "HD", "1 GB")]
    assert [tuple(d) for d in b.downloads] == [("8", "unknown", "")]
    assert [tuple(v) for v in b.video_files] == [("720", "", "v.720p.mp4", None)]


def test_links_are_composed():
    from playbill.operators.page_parser import composed_link

    same = ["/a b?x=\ufb01", "/plain%2Fpath", "/caf\u00e9#\uff41", "https://h/%E4%BD%A0", "/%ff%zz"]
    assert [composed_link(x) for x in same] == same
    assert composed_link("https://h/\uff46ilm?q=\ufb01") == "https://h/film?q=\ufb01" and composed_link("/%EF%AC%81lm/") == "/film/"
    assert composed_link("/cafe\u0301") == "/caf%C3%A9"


def test_composed_links_on_pages(spark):
    index = "<a href='/tvshows/\uff41'>a</a><a href='/tvshows/%EF%BD%81/'>a</a><a href=/tvshows/a>a</a>"
    assert [r.url for r in html.discovered_links(pages(spark, index, url="https://h.example/list/")).collect()] == ["https://h.example/tvshows/a"]
    show = "<div class=se-c><div class=se-a><ul class=episodios><li><a href='/episodes/\ufb01n-ep3'>x</a></ul></div></div>"
    tree = html.extract(pages(spark, show), "shows", ["seasons"]).first().seasons
    assert [(e.url, e.episode_number) for e in tree[0].episodes] == [("https://h.example/episodes/fin-ep3", 3)]


def test_rules_are_read_up_to_the_first_hit():
    rules = {"x": ["b::text", "i::text", "u::text"]}
    page = "<b> </b><i></i><u>1</u><b>2</b>"
    assert read_page(page, rules)["x"] == [[" ", "2"], [], ["1"]]
    assert read_page(page, rules, enough={"x": "first"})["x"] == [[" ", "2"]]
    assert read_page("<b> </b><u>1</u>", rules, enough={"x": "named"})["x"] == [[" "], [], ["1"]]
    assert read_page("<i>0</i><u>1</u>", rules, enough={"x": "any"})["x"] == [[], ["0"]]


def test_video_files(spark):
    records = spark.createDataFrame(
        [("u1", [("7", "HD", "1 GB"), ("8", "unknown", ""), ("9", "480", "")], [("720", "", "d1", None)]), ("u2", [("9", "480", "")], [("720", "", "d2", None)]), ("u3", [], None), ("u4", None, [])],
        "url string, downloads array<struct<fileid string, quality string, size string>>, video_files array<struct<quality string, size string, url string, mirror_url string>>",
    )
    links = spark.createDataFrame([("8", "p8", "m8", "1080"), ("7", "p7", None, "720"), ("7", "p7", "z", "720")], "fileid string, primary_url string, mirror_url string, quality string")
    got = {r.url: [tuple(v) for v in r.video_files] for r in html.video_files(records, links).collect()}
    assert got == {"u1": [("HD", "1 GB", "p7", None), ("1080", "", "p8", "m8")], "u2": [("720", "", "d2", None)], "u3": [], "u4": []}


def test_episode_without_show_link(spark):
    url = "https://h.example/episodes/show-one-ep4"
    a, b = html.extract(pages(spark, "<h1>x</h1>", "<a href='/series/old-9-x/'>s</a>", url=url), "episodes").collect()
    assert (a.show_url, a.season_number, a.episode_number) == ("https://h.example/tvshows/show", 1, 4)
    assert (b.show_url, b.show_id) == ("/series/old-9-x", 9)


def test_links(spark):
    index = """<a href=/tvshows/a/>a</a><a href="/series-7/b?x=1">b</a><div class=items><article><a href=/movies/c>c</a></article></div>
      <a class=next href="">here</a><a rel=next href="?page=2">2</a>"""
    df = pages(spark, index, index, url="https://h.example/list/")
    found = sorted(r.url for r in html.discovered_links(df).collect())
    assert found == ["https://h.example/series-7/b?x=1", "https://h.example/tvshows/a"]
    assert html.next_pages(df).first().next_page == "https://h.example/list?page=2"


def test_snapshot_files(spark, tmp_path):
    from playbill.functions.urls import cache_key

    folder = tmp_path / "movies"
    folder.mkdir()
    url = "https://h.example/movies/é"
    name = spark.range(1).select(cache_key(F.lit(url), nfkc=True)).first()[0]
    (folder / f"{name}.html").write_bytes("café".encode("latin-1"))
    (folder / "other.html").write_bytes("نام".encode())
    snaps = landed.read_snapshots(spark, str(tmp_path), plain=True)
    assert landed.read_snapshots(spark, str(tmp_path), kinds=["movies"], plain=True).count() == 2
    assert {r.file: (r.content_type, r.html) for r in snaps.collect()} == {f"{name}.html": ("movies", "café"), "other.html": ("movies", "نام")}
    wanted = landed.with_cache_file(spark.createDataFrame([(url,)], "url string"))
    assert wanted.join(snaps, "file").first().html == "café"


def test_xml_documents(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss xmlns:a='b'><channel><lastBuildDate>Tue, 02 Jan 2024 10:00:00 +0000</lastBuildDate>"
        "<item><title>N</title><link>https://h/n/5/</link><guid isPermaLink='false'>https://h/?p=9</guid></item><item><link>https://h/x</link></item></channel></rss>"
    )
    (tmp_path / "bad.xml").write_text("<rss><channel><item>")
    docs = xml.read_documents(spark, str(tmp_path))
    items = xml.feed_items(docs).select("pos", "title", "link", "guid").collect()
    assert [tuple(i) for i in items] == [(0, "N", "https://h/n/5/", "https://h/?p=9"), (1, "", "https://h/x", "")]
    built = {r.file.rsplit("/", 1)[1]: str(r.built) for r in xml.feed_build_dates(docs).collect()}
    assert built == {"f.xml": "2024-01-02 10:00:00", "bad.xml": "None"}


def test_notifications_can_be_repeated(spark):
    content = spark.createDataFrame([("movies", "u1"), ("movies", "u2"), ("shows", "u3")], "content_type string, url string")
    path = fresh_path(spark, "notify")
    for _ in range(2):
        sinks.notify(content, path, F.lit("t"))
    assert spark.read.json(f"{path}/content").count() == 3
    assert sorted((r.content_type, r.n) for r in spark.read.json(f"{path}/summary").collect()) == [("movies", 2), ("shows", 1)]


def test_plain_pages_read_like_all_others(spark):
    from playbill.operators.page_parser import _Page

    def shape(page):
        return [(n.tag, n.attrs, list(n.classes), n.texts, n.start, n.end, len(n.kids)) for n in page.nodes]

    class General(_Page):
        def _read_plain(self, html):
            return False

    plain = ["<ul><li class='a b'>x<li id=k>y &amp; z</ul><br/><P title>t", "<a href=x/>q</a>", "<table><tr><td>1<td>2<tr><th b=\"\">3</table>"]
    odd = ["a < b", "<script>x<y</script>", "<a href='/?a&amp;b'>c", "<!-- c --><b>d", "<title>a&b</title>"]
    for html_ in plain + odd:
        assert shape(_Page(html_, frozenset())) == shape(General(html_, frozenset()))
    assert _Page("", frozenset())._read_plain(plain[0]) and not any(_Page("", frozenset())._read_plain(h) for h in odd)


def test_pages_are_held_in_slices():
    import pyarrow as pa

    texts = pa.array(["x" * 700_000, None, "x" * 700_000, "x" * 2_000_000, "", "y"])
    assert list(html._in_slices(texts)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(html._in_slices(pa.array([], pa.string()))) == []


def test_pages_of_video_files_are_read_once(spark):
    import io
    from contextlib import redirect_stdout

    from playbill.plans import crawled, roles

    told = io.StringIO()
    with redirect_stdout(told):
        crawled.video_files(spark, "/root/testdata/sf0.001").explain()
    # Once for the records and once for the resolver pages.
    assert told.getvalue().count("MapInArrow") == 2
    rows, roles.TASK_ROWS = roles.TASK_ROWS, 50
    try:
        assert roles.source(spark, "/root/testdata/sf0.001", "orders").rdd.getNumPartitions() == 30
    finally:
        roles.TASK_ROWS = rows
