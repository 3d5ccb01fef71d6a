"""Cases that reviews found, small."""

from html import unescape

from pyspark.sql import functions as F

from crawlframe.config import CrawlConfig
from crawlframe.functions import html, text
from crawlframe.operators import fetch
from crawlframe.operators.crawl import Crawl
from crawlframe.plans import catalog
from tests.helpers import assert_same

PAGE = '<!DOCTYPE html><html lang="en"><head><title>t</title></head><body><h1>{}</h1>{}</body></html>'


def pages_folder(spark, path, rows) -> str:
    """A folder of test tables that holds these (page_id, url, html)."""
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/all")
    next((path / "all").glob("part-*.parquet")).rename(path / "pages.parquet")
    return str(path)


def twins(spark, path) -> str:
    """Pages of which several have a url in common, with other markup, links, parsers and locks."""
    links = [(7, "/a"), (10, "/b"), (11, "/c"), (12, "/d"), (13, "/e")]
    same = [(n, "http://a.com/x", PAGE.format(n, f'<a href="{to}">{n}</a>')) for n, to in links]
    past = [(30_000 + n, "http://a.com/y", PAGE.format(n, f'<a href="/y{n}">{n}</a>' + "z" * n)) for n in range(12)]
    return pages_folder(spark, path, same + past + [(4, "http://a.com/y", PAGE.format("y", ""))])


def same(spark, name: str, folder: str) -> int:
    return assert_same(catalog.queries()[name](spark, folder), catalog.oracle_sql()[name], folder)


def test_segments_of_a_round_share_their_jobs(spark, tmp_path, monkeypatch):
    """Twelve segments of two urls are fetched by one reading of the pages, and each has its own parts, empty ones too."""
    asked, real = [], fetch.fetch_from
    monkeypatch.setattr(fetch, "fetch_from", lambda rows, pages: asked.append(1) or real(rows, pages))
    urls = [f"http://a.com/{n}" for n in range(23)]
    pages = spark.createDataFrame([(u, f'<a href="/{n}">x</a>' + (f'<a href="/none{n}">y</a>' if n == 3 else "")) for n, u in enumerate(urls[:20])], "url string, content string")
    crawl = Crawl(spark, f"file://{tmp_path}/c", CrawlConfig(increment_retries=True, urls_per_segment=2))
    crawl.inject(spark.createDataFrame([(f"{u}\tparse_class=article",) for u in urls], "line string"))
    assert crawl.run(pages=pages) == 2 and len(asked) == 2
    assert sorted((r.status, r.n) for r in crawl.store.read().groupBy("status").agg(F.count("*").alias("n")).collect()) == [(2, 20), (3, 4)]
    names = crawl.segments.names()
    assert len(names) == 13
    for part, total in (("crawl_generate", 24), ("crawl_fetch", 24), ("content", 20), ("crawl_parse", 21), ("app_info", 20)):
        counts = [crawl.segments.read(name, part).count() for name in names]
        assert sum(counts) == total and (part != "crawl_fetch" or max(counts) == 2), (part, counts)
    assert all(crawl.segments.marked(name, mark) for name in names for mark in ("generated", "fetched", "parsed"))
    crawl.parse(names[0])  # again, for one alone
    assert [crawl.segments.read(name, "app_info").count() for name in names[:1]] == [crawl.segments.read(names[0], "content").count()]


def test_crawl_of_urls_with_several_pages(spark, tmp_path):
    assert same(spark, "crawl_loop_offline", twins(spark, tmp_path)) == 2


def test_counters_of_urls_with_several_pages(spark, tmp_path):
    """Each row is fetched from its own page, and one whose page has no content is found all the same."""
    folder = twins(spark, tmp_path)
    assert same(spark, "fetch_counters", folder) == 1
    empty = pages_folder(spark, tmp_path / "e", [(1, "http://a.com/", None), (4, "http://a.com/", "ab"), (40, "http://a.com/", "b")])
    assert same(spark, "fetch_counters", empty) == 1
    rows = spark.createDataFrame([("u", 0, 0), ("v", 0, 0)], "url string, segment_no int, fetch_list int")
    pages = spark.createDataFrame([("u", "b"), ("u", "a"), ("u", "c")], "url string, content string").repartition(3)
    assert sorted((r.url, r.code, r.body) for r in fetch.fetch_from(rows, pages).collect()) == [("u", 200, b"a"), ("v", 404, None)]


def test_output_of_urls_with_several_pages(spark, tmp_path):
    assert same(spark, "fetch_output_split", twins(spark, tmp_path)) > 2


def test_lock_of_urls_with_several_rows(spark, tmp_path):
    """A row that is locked still keeps the time of its lock where another of its url is selected."""
    assert same(spark, "generate_writeback", twins(spark, tmp_path)) == 18


def test_records_of_urls_with_several_pages(spark, tmp_path):
    """Links of a url are counted together, the other records are one for each page."""
    assert same(spark, "parse_records", twins(spark, tmp_path)) == 2 + 18


def test_paths_keep_the_spelling_of_references(spark, tmp_path):
    """Cut references, others than the three that the SQL decodes, and bare signs; scripts and attributes as ever."""
    texts = ["a &amp;&am", "a &amp", "&quot;b &lt", "x > y &gt; z &amp;lt; &", " &eacute; &amp;", "&#60;&lt;"]
    folder = pages_folder(spark, tmp_path, [(n, "http://a.com/", PAGE.format(t, "")) for n, t in enumerate(texts)])
    assert same(spark, "xpath_values", folder) == len(texts)
    page = '<p title="&quot;&amp"><script>a &amp; b</script>c &eacute;&amp d</p>'
    rows = spark.createDataFrame([(page,), (None,)], "h string")
    ask = lambda column: [r[0] for r in rows.select(column).collect()]
    assert ask(html.xpath_text("h", "//p/@title", ("amp",))) == ['"&', ""] == ask(html.xpath_text("h", "//p/@title"))
    assert ask(html.xpath_text("h", "//p", ("eacute",))) == ["a &amp; bc é&amp d", ""] and ask(html.xpath_text("h", "//p")) == ["a &amp; bc é& d", ""]
    assert ask(html.xpath_html("h", "//p", spelled=True)) == ['<p title="&quot;&amp;"><script>a &amp; b</script>c &eacute;&amp d</p>', None]
    assert ask(html.xpath_html("h", "//p")) == ['<p title="&quot;&amp;"><script>a &amp; b</script>c é&amp; d</p>', None]


def test_entities_go_to_python_in_small_batches(spark):
    """The plan has no Arrow batches of ten thousand long texts; results are those of the standard library, nulls included."""
    signs = ["".join(map(chr, (*range(32, 127), *range(0xA0, 0x180)))), "\U0001f600 漢 & <b> \"", None, "plain", "&amp;&lt;&#65;&#x1F600;&no;&#1114112;&"]
    rows = spark.createDataFrame([(s,) for s in signs], "s string").select("s", text.entities_encode("s").alias("c"), text.entities_decode("s").alias("d")).withColumn("again", text.entities_decode("c"))
    shown = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in shown and "ArrowEvalPython" not in shown
    got = rows.collect()
    assert [r.again for r in got] == signs and [r.d for r in got][2:] == [None, "plain", "&<A\U0001f600&"]
    assert got[1].c == "&#128512; &#28450; &amp; &lt;b&gt; &quot;" and got[0].c.isascii() and unescape(got[0].c) == signs[0]
