"""Work that must not grow faster than the rows, or be done twice for each of them."""

import json

import pyarrow as pa
from pyspark.sql import functions as F
from test_plans import plan

from playbill.operators import html, joins, page_parser
from playbill.plans import documents
from playbill.sources import versioned


def test_children_are_found_without_sorting_and_once(spark):
    episodes = spark.createDataFrame(
        [("e2", "https://x/a/", 1, 2), ("e1", "https://x/a", 1, 1), ("e3", "https://x/b", 1, 1), ("e4", None, 1, 1)],
        "url string, show_url string, season_number int, episode_number int",
    )
    parents = spark.createDataFrame([("https://x/a",), ("https://x/a/",)], "url string")
    assert "ShuffledHashJoin" in plan(joins.children_of(episodes, parents, number_order=False))
    ordered = joins.children_of(episodes, parents)
    assert "Join" not in plan(ordered)
    assert [r.url for r in ordered.collect()] == ["e1", "e2"]


def test_posts_are_rendered_without_patterns_and_in_compiled_code(spark):
    item = documents.source(spark, "/root/testdata/sf0.001", "lineitem")
    body = documents._post(F.lit(1), F.lit("u"), F.lit("m"), F.col("title"), F.lit("[]"), F.lit("[]"), F.lit("[]"))
    titles = item.limit(1).select(F.explode(F.array(F.lit('a "t"} \\'), F.lit(None).cast("string"))).alias("title"))
    rows = titles.select("title", body.alias("body"))
    assert "regexp_replace" not in plan(rows)
    got = [(r[0], json.loads(r.body)["title"]) for r in rows.collect()]
    assert got == [('a "t"} \\', {"rendered": 'a "t"} \\'}), (None, {})]
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_a_batch_is_spelled_once_and_after_its_repeats_are_gone(spark, tmp_path, monkeypatch):
    table = versioned.VersionedTable.create(spark, str(tmp_path / "t"), "url string, title string, lastmod string, is_new int, last_scraped string", buckets=2)
    rows = [("https://x/a/", "old", 1), ("https://x/a", "mid", 2), ("https://x/a/", "new", 3), (None, "none", 4)]
    incoming = spark.createDataFrame(rows, "url string, title string, pos int").withColumn("lastmod", F.lit("m"))
    plans, write = [], versioned.written
    monkeypatch.setattr(versioned, "written", lambda df, name: plans.append(plan(df)) or write(df, name))
    table.upsert(incoming, F.lit("now"))
    assert [(r.url, r.title) for r in table.read().collect()] == [("https://x/a", "new")]
    tree = plans[0].split("\n\n")[0]
    assert tree.count("ArrowEvalPython") == 1 and tree.rindex("ArrowEvalPython") < tree.rindex("Aggregate")


def test_equal_tags_are_read_once_and_only_what_lies_in_the_place_of_a_rule_is_tested(monkeypatch):
    page = '<div class="sgeneros"><a href="/g">x</a></div>' + '<ul><li><a href="/e">y</a></li></ul>' * 200
    rules = {"genres": [".sgeneros a::text", "#cast a::text"], "all": ["li a::attr(href)"]}
    calls = []
    for name in ("_read_tag", "_matches"):
        monkeypatch.setattr(page_parser, name, lambda *x, _n=name, _f=getattr(page_parser, name): calls.append(_n) or _f(*x))
    found = page_parser.read_page(page, rules)
    assert found == {"genres": [["x"], []], "all": [["/e"] * 200]}
    assert page_parser.read_page(page, rules) == found
    assert calls.count("_read_tag") < 20 and calls.count("_matches") <= 2 * 201
    # A nested place is not read twice, and one that lies around another is found too.
    nested = '<div class="a"><p><div class="a"><b>1</b></div></p><b>2</b></div><div><div class="a"><b>3</b></div></div><b>4</b>'
    assert page_parser.read_page(nested, {"x": [".a b::text", "div .a b::text", ".a > b::text"]})["x"] == [["1", "2", "3"], ["1", "3"], ["1", "2", "3"]]


def test_no_search_for_cycles_while_pages_are_read(spark, monkeypatch):
    import gc

    seen = []
    monkeypatch.setattr(html, "read_page", lambda *x: seen.append(gc.isenabled()) or page_parser.read_page(*x))
    taken = {}
    pages = spark.createDataFrame([("u", "<h1>t</h1>")], "url string, html string")
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, f, schema: taken.setdefault("f", f))
    html.candidates(pages, {"k": {"t": ["h1::text"]}})
    batch = pa.record_batch([pa.array(["u"]), pa.array(["<h1>t</h1>"])], names=["url", "html"])
    assert next(taken["f"](iter([batch]))).column("_t").to_pylist() == [[["t"]]]
    assert seen == [False] and gc.isenabled()
