"""Properties, plan shapes and storage of the crawl operators."""

import io
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from crawlframe import schema as S
from crawlframe.config import CrawlConfig
from crawlframe.functions import charset, html, url
from crawlframe.functions.schedule import MODIFIED, NOTMODIFIED, AdaptiveSchedule, schedule
from crawlframe.operators import fetch, generate, lookup, parse, update
from crawlframe.plans import fixtures as X
from crawlframe.sources import avro_pair, store
from crawlframe.streaming.update import update_stream

SF = "/root/testdata/sf0.001"


def plan(df, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_update_shuffles_once(spark):
    shown = plan(update.merge(X.records(spark, SF)), "simple")
    assert shown.count("Exchange hashpartitioning(url") == 1 and "Cartesian" not in shown


def test_select_pushes_filters(spark, tmp_path):
    X.state(spark, SF).write.parquet(f"{tmp_path}/state")
    rows = spark.read.parquet(f"{tmp_path}/state")
    assert "PushedFilters: [Not(In(status" in plan(generate.select(rows).select("url")) or "In(status, [2,3])" in plan(generate.select(rows).select("url"))
    assert "EqualTo(url,x)" in plan(lookup.get(rows, "x"))


def test_update_transitions(spark):
    old, rows = 1, []
    cases = {33: 2, 35: 4, 36: 5, 37: 3, 38: 6}
    for status, _ in cases.items():
        rows += [(f"http://a/{status}", old, 1, 0, 0, 1), (f"http://a/{status}", status, 2, 0, 0, 2)]
    rows += [("http://a/few", 34, 2, 2, 0, 3), ("http://a/many", 34, 2, 3, 0, 4), ("http://a/new", 67, 0, 0, 0, 5), ("http://a/seen", 3, 1, 0, 7, 6), ("http://a/seen", 67, 9, 0, 0, 7), ("http://a/odd", 65, 1, 0, 0, 8)]
    df = spark.createDataFrame(rows, "url string, status int, fetch_time long, retries int, modified_time long, seq long")
    got = {r.url.rpartition("/")[2]: r.status for r in update.merge(df).collect()}
    assert got == {**{str(k): v for k, v in cases.items()}, "few": 1, "many": 3, "new": 1, "seen": 3}
    with pytest.raises(Exception, match="Unknown status"):
        update.merge(df, CrawlConfig(compat="wired")).collect()


def test_update_is_idempotent_and_order_free(spark):
    rows = [tuple(r) for r in X.records(spark, SF).collect()]
    once = update.merge(X.records(spark, SF))
    kind = once.schema
    assert sorted(map(tuple, update.merge(once).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)
    random.Random(1).shuffle(rows)
    mixed = spark.createDataFrame(rows, X.records(spark, SF).schema).repartition(5)
    assert sorted(map(tuple, update.merge(mixed).select(*kind.names).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)


def test_segments_are_balanced(spark):
    rows = spark.range(1003).select(F.concat(F.lit("http://h/"), "id").alias("url"))
    config = CrawlConfig(urls_per_segment=100, fetch_lists=7)
    for seed in (None, 5):
        made = generate.segments(rows, config, seed).collect()
        assert len({r.url for r in made}) == len(made) == 1003
        for segment in range(1, 12):
            sizes = [sum(r.segment_no == segment and r.fetch_list == k for r in made) for k in range(7)]
            assert max(sizes) - min(sizes) <= 1 and sum(sizes) == (100 if segment < 11 else 3)
    assert generate.segments(rows.filter("false"), config).count() == 0


def test_normalize_is_idempotent(spark):
    rng = random.Random(2)
    parts = ["http://", "HTTP://", "https://", "A.com", ":80", "/", "//", "/../", "/./", "a", "?q=1", "#f", " ", "%", "é"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 8))),) for _ in range(400)] + [(None,)]
    df = spark.createDataFrame(rows, "u string").select(url.normalize("u").alias("a")).select("a", url.normalize("a").alias("b"))
    assert df.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_redirects(spark):
    cases = [
        ("http://a.com/", "http://b.com/x", True, "http://b.com/x"), ("http://a.com/", "http://a.com/xyz/index.html", False, "http://a.com/"),
        ("http://a.com/xyz/index.html", "http://a.com/", False, "http://a.com/"), ("http://a.com/xyz/index.html", "http://a.com/abc/page.html", False, "http://a.com/abc/page.html"),
        ("http://a.com/", "http://a.com/xyz/index.html", True, "http://a.com/"), ("http://a.com/xyz/index.html", "http://a.com/", True, "http://a.com/"),
        ("http://a.com/xyz/index.html", "http://a.com/abc/page.html", True, "http://a.com/abc/page.html"),
        ("http://www.a.com/xyz/index.html", "http://www.news.a.com/xyz/index.html", True, "http://www.a.com/xyz/index.html"), ("http://www.a.com/", "http://www.news.a.com/", True, "http://www.a.com/"),
    ]
    df = spark.createDataFrame(cases, "src string, dst string, temporary boolean, expected string")
    assert df.filter(url.choose_repr("src", "dst", F.col("temporary"), ["com"]) != F.col("expected")).count() == 0


def test_adaptive_schedule_follows_changes(spark):
    """A page that changes comes sooner, another later, within the bounds."""
    config = CrawlConfig(sync_delta=False, min_interval=3600)
    step = AdaptiveSchedule(config).fetched(F.lit(0).cast("long"), F.col("change"))
    df = spark.createDataFrame([(MODIFIED, 0, 1000000, 0), (NOTMODIFIED, 0, 1000000, 0), (MODIFIED, 0, 60, 0)], "change int, fetch_time long, fetch_interval int, retries int")
    assert [r.fetch_interval for r in df.withColumns(step).collect()] == [800000, 1200000, 3600]
    assert type(schedule("adaptive")) is AdaptiveSchedule


def test_fetch_once_and_errors(spark):
    def answer(u, modified):
        if u.endswith("x"):
            raise OSError("refused")
        return fetch.Response(200, u.encode(), {"A": ["b", "c"]})

    rows = spark.createDataFrame([("http://a/1", 7), ("http://a/x", 8)], "url string, seq long")
    got = {r.url: r for r in fetch.fetch(rows, answer, CrawlConfig(fetch_threads=2)).collect()}
    assert got["http://a/1"].body == b"http://a/1" and got["http://a/1"].headers == {"A": ["b", "c"]} and got["http://a/1"].seq == 7
    assert got["http://a/x"].code is None and "refused" in got["http://a/x"].message
    assert fetch.fetch(rows.filter("false"), answer).count() == 0


def test_stuck_requests_hold_no_place(spark, monkeypatch):
    """More stuck urls than threads: the rest is still fetched, and time runs from each request's start."""
    import time

    def answer(u, modified):
        time.sleep(30 if "stuck" in u else 0.05)
        return fetch.Response(200, b"x" * 1000)

    rows = spark.createDataFrame([(f"http://a/stuck{i}",) for i in range(6)] + [(f"http://a/{i}",) for i in range(30)], "url string").coalesce(1)
    began = time.monotonic()
    got = fetch.fetch(rows, answer, CrawlConfig(fetch_threads=3, fetch_timeout_s=1.0)).collect()
    assert sorted((r.message == "timeout", r.code) for r in got if "stuck" in r.url) == [(True, None)] * 6
    assert sum(r.code == 200 for r in got) == 30 and len(got) == 36 and time.monotonic() - began < 25
    monkeypatch.setattr(fetch, "FLUSH_BYTES", 1500)
    jobs = [(k, f"http://a/{k}", 0) for k in range(5)]
    assert sorted(k for k, _ in fetch._threaded(jobs, answer, 2, 5.0)) == list(range(5))


def test_http_fetcher_against_local_server():
    """Status, headers, packed bodies, the body limit, redirects, and conditional requests."""
    import gzip
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(301)
                self.send_header("Location", "/page")
                self.end_headers()
            elif self.headers.get("If-Modified-Since"):
                self.send_response(304)
                self.end_headers()
            elif self.path == "/none":
                self.send_error(404)
            else:
                body = gzip.compress(b"hello " * 100)
                self.send_response(200)
                self.send_header("Content-Encoding", "gzip")
                self.send_header("X-Agent", self.headers["User-Agent"])
                self.end_headers()
                self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        plain = fetch.HttpFetcher(agent="me/1")
        assert plain(f"{base}/page").body == b"hello " * 100 and plain(f"{base}/page").headers["X-Agent"] == ["me/1"]
        assert plain(f"{base}/moved").code == 200 and fetch.HttpFetcher(follow_redirects=False)(f"{base}/moved").code == 301
        assert plain(f"{base}/none").code == 404 and plain(f"{base}/page", 1_700_000_000_000).code == 304
        assert fetch.ByProtocol({"http": {"content_limit": 40}})(f"{base}/page").body == (b"hello " * 100)[:40]
        with pytest.raises(ValueError):
            fetch.ByProtocol()("gopher://a/")
    finally:
        server.shutdown()


def test_polite_waits_by_host():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    polite = fetch.Polite(lambda u, m: fetch.Response(200), 2.0, 1, lambda: now[0], sleep)
    assert [polite(u).code for u in ("http://a/1", "http://b/1", "http://a/2")] == [200] * 3 and slept == [2.0]
    blocked = fetch.Polite(lambda u, m: fetch.Response(200), 2.0, 0, lambda: now[0], lambda s: None)
    assert [blocked("http://a/1").code, blocked("http://a/1").code] == [200, 503]


def test_parse_unknown_and_failing_parsers(spark):
    def bad(u, h):
        raise ValueError("no")
        yield

    rows = spark.createDataFrame([("http://a/", b"<a href='/x'>t</a>", {"parse_class": c} if c else {}, {}) for c in ("links", "bad", "none", None)], S.CONTENT)
    records = parse.parse(rows, {"links": parse.page_links, "bad": bad})
    assert [(r.url, r.anchor) for r in parse.outlinks(records).collect()] == [("http://a/x", "t")]
    assert parse.errors(records).count() == 3


def test_html_and_charset_edges(spark):
    page = "<html><head><base href='/b/'></head><body><a href='c'>x<b>y</a><script><a href='no'></script><area href='?d'></body>"
    assert html.links(html.tree(page), "http://h/p") == [("http://h/b/c", "xy"), ("http://h/b/?d", "")]
    assert html.links(html.tree("<meta name=robots content=nofollow><a href=x>"), "http://h/") == []
    df = spark.createDataFrame([("漢字".encode("gb18030"), "gb18030"), (b"a\xff", "nonsense"), (None, "utf-8")], "b binary, c string")
    assert [r[0] for r in df.select(charset.decode("b", "c")).collect()] == ["漢字", "a�", None]


def test_state_survives_crashes(spark, tmp_path, monkeypatch):
    """A job that ends before or while a snapshot is put in force leaves the old state; leftovers go with the next install."""
    kept = store.StateStore(spark, f"file://{tmp_path}/s", spark.range(1).schema)
    kept.install(spark.range(3))

    def crash(*args):
        raise OSError("gone")

    for step in ("create", "rename"):
        with monkeypatch.context() as m:
            m.setattr(store.Files, step, crash)
            with pytest.raises(OSError):
                kept.install(spark.range(5))
        assert store.StateStore(spark, kept.root, kept.schema).read().count() == 3
    kept.install(spark.range(7))
    assert kept.read().count() == 7
    kept.install(spark.range(8))
    assert len(kept.files.children(f"{kept.root}/snapshots", True)) == 2 and len(kept._pointers()) == 2
    with kept.lock(), pytest.raises(store.Locked), kept.lock(wait_s=0.3):
        pass


def test_crawl_goes_on_to_the_end(spark, tmp_path):
    """A chain of pages deeper than a few rounds is fetched to its end; a link to nowhere ends as gone."""
    from crawlframe.operators.crawl import Crawl

    page = "<html><body><a href='/{}'>next</a></body></html>"
    pages = spark.createDataFrame([(f"http://a.com/{i}", page.format(i + 1)) for i in range(5)], "url string, content string")
    crawl = Crawl(spark, f"file://{tmp_path}/c", CrawlConfig(increment_retries=True))
    crawl.inject(spark.createDataFrame([("http://a.com/0\tparse_class=article",)], "line string"))
    assert crawl.run(pages=pages) == 6
    assert {(r.url[-1], r.status) for r in crawl.store.read().collect()} == {*((str(i), 2) for i in range(5)), ("5", 3)}


def test_suffix_table(spark, tmp_path):
    from crawlframe.sources import suffixes

    (tmp_path / "s.xml").write_text("<d><tlds><gtlds><tld domain='com'/></gtlds></tlds><suffixes><suffix domain='a.com'><boost>2</boost></suffix><suffix domain='com'/></suffixes></d>")
    table = suffixes.load(spark, f"file://{tmp_path}/s.xml")
    assert {tuple(r) for r in table.collect()} == {("com", "IN_USE", 1.0, "GENERIC", None), ("a.com", "IN_USE", 2.0, None, None)}
    rows = spark.createDataFrame([("http://x.a.com/",), ("http://com./",), ("http://1.2.3.4/",), ("bad",), (None,)], "url string")
    assert {(r.url, r.suffix and r.suffix.domain) for r in suffixes.with_suffix(rows, table).collect()} == {("http://x.a.com/", "a.com"), ("http://com./", "com"), ("http://1.2.3.4/", None), ("bad", None), (None, None)}
    for bad in ("<d><cctlds><tld domain='uk'/></cctlds></d>", "<d><gtlds><tld domain='x'><status>NO</status></tld></gtlds></d>"):
        with pytest.raises(ValueError):
            suffixes.parse(bad)


def test_segments_are_dealt_in_one_job(spark, tmp_path):
    parts = store.Segments(spark, f"file://{tmp_path}/g")
    rows = spark.range(50).selectExpr("id", "cast(id % 5 + 1 as int) as segment_no")
    made = parts.deal(rows, "segment_no", "b", "crawl_generate")
    assert made == [f"b-{n:04d}" for n in range(1, 6)] == parts.names()
    assert all(parts.read(n, "crawl_generate").count() == 10 for n in made)
    every, without = parts.inputs("crawl_generate", [*made, "b-9"], rows.schema)
    assert every.count() == 50 and without == ["b-9"] and sum("FileScan" in x for x in every._jdf.queryExecution().executedPlan().toString().split("\n")) == 1


def test_store_lock_and_router(spark, tmp_path):
    kept = store.StateStore(spark, f"file://{tmp_path}/s", spark.range(1).schema)
    assert kept.read().count() == 0
    with kept.lock():
        kept.install(spark.range(3))
        with pytest.raises(store.Locked), kept.lock():
            pass
    assert not store.remove_lock(spark, f"file://{tmp_path}/s/.locked")
    kept.install(kept.read().filter("id > 0"))
    kept.install(kept.read().filter("id > 1"))
    assert [r.id for r in kept.read().collect()] == [2]
    router = store.Router().add("a", F.lit(True), ["id"])
    for name in ("a", "not a name"):
        with pytest.raises(ValueError):
            router.add(name, F.lit(True), [])
    with pytest.raises(ValueError):
        router.write(spark.range(1), f"file://{tmp_path}/r", ["b"])


def test_avro_container(spark, tmp_path):
    rows = [{"key": f"k{i}", "value": None if i % 7 == 0 else {"n": i - 500, "b": b"x" * (i % 300), "m": {"a": 1.5}, "l": ["p", None]}} for i in range(5000)]
    value = {"type": "record", "name": "V", "fields": [{"name": "n", "type": "long"}, {"name": "b", "type": "bytes"}, {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "l", "type": {"type": "array", "items": ["null", "string"]}}]}
    schema = {"type": "record", "name": "Pair", "fields": [{"name": "key", "type": "string"}, {"name": "value", "type": ["null", value]}]}
    for codec in ("deflate", "null"):
        path = f"{tmp_path}/{codec}.avro"
        assert avro_pair.write_file(path, schema, rows, codec) == 5000
        assert list(avro_pair.read_range(path)) == rows
        cuts = [0, 1000, 33_333, 50_000, 10**9]
        assert [r for a, b in zip(cuts, cuts[1:]) for r in avro_pair.read_range(path, a, b)] == rows
    out = io.BytesIO()
    for n in (0, -1, 63, -64, 2**40, -(2**62)):
        avro_pair.put_long(out, n)
    out.seek(0)
    assert [avro_pair.get_long(out) for _ in range(6)] == [0, -1, 63, -64, 2**40, -(2**62)]


def test_stream_equals_batch(spark, tmp_path):
    names = S.CRAWL_DATUM.fieldNames()
    rows = X.records(spark, SF)
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.CRAWL_DATUM.fields])
    full.filter("status > 31").write.parquet(f"{tmp_path}/in")
    kept = store.StateStore(spark, f"file://{tmp_path}/state", S.CRAWL_DATUM)
    old = update.merge(full.filter("status <= 31")).select(*names)
    kept.install(old)
    stream = spark.readStream.schema(S.CRAWL_DATUM).parquet(f"{tmp_path}/in")
    update_stream(stream, kept, f"file://{tmp_path}/checkpoint").awaitTermination()
    cut = ["url", "status", "fetch_time", "retries", "seq"]
    expected = update.merge(old.unionByName(full.filter("status > 31").select(*names))).select(*cut)
    assert sorted(map(tuple, kept.read().select(*cut).collect())) == sorted(map(tuple, expected.collect()))


def test_config_from_session(spark):
    spark.conf.set("crawlframe.retry_max", "5")
    try:
        assert CrawlConfig.from_session(spark, fetch_lists=2) == replace(CrawlConfig(), retry_max=5, fetch_lists=2)
    finally:
        spark.conf.unset("crawlframe.retry_max")


def test_plain_links_of_all_documents(spark, tmp_path):
    """Links of every document against a search with re; a third of the ids, or made links alone, would not do."""
    import re

    from crawlframe.functions.html import URL_PATTERN
    from crawlframe.plans import catalog

    texts = [None, "", "none here", "see http://a.com/x?q=1 and HTTP://B.org/%7e#top", "ftp://c.net/f http://d.de/ http://d.de/", "(http://e.fr/a,b) mailto:me", "x\nhttps://g.io/1"]
    rows = list(enumerate(texts)) + [(10 + i, f"at http://h.com/{i} now") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["parse_plain_links"](spark, str(tmp_path)).collect()))
    want = sorted((i, m.group()) for i, t in rows for m in re.finditer(URL_PATTERN, t or "", re.ASCII))
    assert got == want and {i for i, _ in got} == {3, 4, 5, 6, *range(10, 16)}
