"""Indexes, credentials, plug-ins, paths, tries, encodings and records against simple versions of them."""

import base64
import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from crawlframe.functions import charset, html, text, url
from crawlframe.operators import fetch, lookup
from crawlframe.sources import credentials, store, xml


def test_tries_against_plain_search(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab.é\U0001f600$") for _ in range(rng.randint(0, n)))
    patterns, inputs = [word(5) for _ in range(300)], [word(9) for _ in range(300)]
    rows = spark.createDataFrame([(i,) for i in inputs] + [(None,)], "s string")
    got = rows.select("s", text.prefix_shortest("s", patterns), text.prefix_longest("s", patterns), text.suffix_shortest("s", patterns), text.suffix_longest("s", patterns), text.prefix_matches("s", patterns)).collect()
    for s, *found, some in got:
        starts = sorted((p for p in patterns if p and s is not None and s.startswith(p)), key=len)
        ends = sorted((p for p in patterns if p and s is not None and s.endswith(p)), key=len)
        assert found == [f(x) if x else None for x in (starts, ends) for f in (lambda x: x[0], lambda x: x[-1])] and some == bool(starts)
    assert rows.select(text.prefix_longest("s", ["", ""])).distinct().collect() == [(None,)]


def test_decode_utf8_in_the_jvm(spark):
    rng = random.Random(5)
    data = [bytes(rng.choice(b"a\xc3\xa9\xe6\xbc\xa2\xf0\x9f\x98\x80\xed\xa0\xff\xc0") for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    rows = spark.createDataFrame([(b, n) for b in data for n in ("UTF-8", "nonsense")] + [(b"\xe9", "windows-1252"), (b"\xe9", None), (None, "utf-8")], "b binary, n string")
    got = rows.select("b", "n", charset.decode("b", "n").alias("t")).collect()
    for r in got:
        assert r.t == (None if r.b is None else bytes(r.b).decode("cp1252" if r.n == "windows-1252" else "utf-8", "replace")), r


def test_index_of_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    keys = [f"{i:08d}" for i in range(150_000)]
    keys[65_536] = keys[70_000] = keys[80_000] = "0"  # at a block's begin and inside
    spark.createDataFrame([(k,) for k in keys], "url string").coalesce(1).write.parquet(path)
    lookup.write_sorted(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "url string"), f"{path}2")
    assert lookup.repair_index(spark, path, dry_run=True) == 150_000 and not (tmp_path / "t_index").exists()
    assert lookup.repair_index(spark, path) == 150_000 and lookup.repair_index(spark, path) == -1
    [entry] = spark.read.parquet(f"{path}_index").collect()
    assert (entry.first_key, entry.last_key, entry.out_of_order) == ("0", keys[-1], 3)
    with pytest.raises(ValueError, match="out of order"):
        lookup.check_order(spark, path)
    lookup.check_order(spark, f"{path}2")
    lookup.repair_index(spark, f"{path}2")
    assert lookup.get_indexed(spark, f"{path}2", "b").count() == 2 and lookup.get_indexed(spark, f"{path}2", "c").count() == 0
    with pytest.raises(FileNotFoundError):
        lookup.repair_index(spark, f"{path}3")
    next((tmp_path / "t2").glob("part-*.parquet")).write_bytes(b"PAR1 broken")
    assert lookup.index_entries(spark, f"{path}2").count() <= 1


def test_empty_index(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([], "url string").write.parquet(path)
    assert lookup.repair_index(spark, path) == 0 and lookup.get_indexed(spark, path, "x").count() == 0


def test_credentials_answer_a_challenge():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.headers.get("Authorization"))
            known = asked[-1] == "Basic " + base64.b64encode(b"ann:a:1").decode()
            self.send_response(200 if known else 401)
            if not known:
                self.send_header("WWW-Authenticate", f'{"NTLM" if self.path == "/ntlm" else "Basic"} realm="in side"')
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    conf = '<auth-configuration><credentials username="ann" password="a:1"><authscope host="127.0.0.1" port="{}" realm="{}"/></credentials></auth-configuration>'
    try:
        for path, realm, code, requests in (("/x", "in side", 200, 2), ("/x", "other", 401, 1), ("/ntlm", "in side", 401, 1)):
            asked.clear()
            got = fetch.Authenticated(fetch.HttpFetcher(), credentials.parse(conf.format(port, realm)))(f"http://127.0.0.1:{port}{path}")
            assert (got.code, len(asked)) == (code, requests)
    finally:
        server.shutdown()


def test_credentials_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<auth-configuration><credentials username="u" password="p"><default/></credentials></auth-configuration>')
    assert credentials.load(spark, f"file://{tmp_path}/a.xml") == [credentials.Scope("u", "p", default=True)]
    assert credentials.challenge("Digest qop=auth, realm=abc, nonce=1") == ("digest", "abc") and credentials.challenge("") == ("", None)
    for bad in ("<other/>", "<auth-configuration><credentials><what/></credentials></auth-configuration>", "<auth-configuration><credentials><default/><default/></credentials></auth-configuration>"):
        with pytest.raises(ValueError):
            credentials.parse(bad)
    rows = spark.createDataFrame([(None, None, None, None)], "h string, p int, r string, s string")
    ask = lambda scopes: rows.select(credentials.user_column(scopes, F.col("h"), F.col("p"), F.col("r"), F.col("s"))).first()[0]
    assert ask([]) is None and ask([credentials.Scope("u", "p", host="a")]) is None and ask([credentials.Scope("u", "p", default=True)]) == "u"


def test_paths_into_pages(spark):
    page = "<html><body><div><a href=' /x '>one<b>two</b>three</a><a>no</a><a href='http://[bad'>q</a></div><img src='i.png'></body></html>"
    rows = spark.createDataFrame([(page, "http://h/p"), (None, None), ("", "http://h/")], "h string, u string")
    ask = lambda column: [r[0] for r in rows.select(column).collect()]
    assert ask(html.xpath_text("h", "//a/text()")) == ["one\nthree\nno\nq", "", ""]
    assert ask(html.xpath_text("h", "//a")) == ["onetwothree\nno\nq", "", ""]
    assert ask(html.xpath_text("h", "//@src")) == ["i.png", "", ""] and ask(html.xpath_text("h", "/html/body/div/a[2]")) == ["no", "", ""]
    assert ask(html.xpath_links("h", "u", "//a")) == ask(html.xpath_links("h", "u", "//a/@href")) == [["http://h/x"], [], []]
    assert ask(html.xpath_html("h", "//b")) == ["<b>two</b>", None, None]
    for bad in ("//a[", "a[@]"):
        with pytest.raises(ValueError):
            html.xpath_text("h", bad)
    assert html.tree("a<p>b<script>c</script></p><p>d", drop=("script",)).text() == "abd"


def test_fetch_refuses_speculation(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return "true" if name == "spark.speculation" else default

    rows = spark.createDataFrame([("http://a/",)], "url string")
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: Conf())
    with pytest.raises(ValueError, match="speculation"):
        fetch.fetch(rows, lambda u, m: fetch.Response(200))


def test_records_with_versions(spark):
    rows = spark.createDataFrame([("a", "s", "t"), ("b", "s", None)], "url string, segment string, text string")
    kept = lookup.parse_text(rows)
    assert [r.text for r in lookup.read_parse_text(kept).orderBy("url").collect()] == ["t", ""]
    with pytest.raises(Exception, match="version of a text record"):
        lookup.read_parse_text(kept, 2).collect()


def test_xml_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, " a <b> & ]]> ", None), (2, "ü\n", 1.5)], "id long, t string, v double")
    xml.save(rows, f"file://{tmp_path}/x")
    assert sorted(map(tuple, xml.load(spark, f"file://{tmp_path}/x", rows.schema).collect())) == sorted(map(tuple, rows.collect()))


def test_shared_folder(spark, monkeypatch):
    assert store.shared_folder(spark, "k").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))

    class Conf:
        def get(self, name, default=None):
            return default

    class Elsewhere:
        master = "spark://far:7077"
        getConf, getCheckpointDir = (lambda self: Conf()), (lambda self: None)

    class Session:
        conf, sparkContext = Conf(), Elsewhere()

    with pytest.raises(RuntimeError):
        store.shared_folder(Session(), "k")


def test_avro_files_by_arrow_file_systems(spark, tmp_path, monkeypatch):
    """The same files through a store that is no mounted folder: nothing but its file system sees them."""
    from pyarrow import fs

    from crawlframe.sources import avro_pair

    far = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(avro_pair, "place", lambda path: (far, path.removeprefix("far://")))
    schema = spark.createDataFrame([], "key string, value long").schema
    rows = spark.createDataFrame([("a", 1), ("b", None)], schema).collect()

    def put(overwrite: bool) -> None:
        writer = avro_pair._Writer(schema, "far://d", overwrite, "deflate")
        writer.commit([writer.write(iter(rows)), None])

    reader = avro_pair._Reader(schema, "far://d")
    read = lambda: [r for part in reader.partitions() for r in reader.read(part)]
    put(False)
    put(False)
    assert sorted(read()) == [("a", 1), ("a", 1), ("b", None), ("b", None)] and avro_pair._Reader(schema, "far://d").partitions()[0].path.startswith("far://d/part-")
    put(True)
    assert sorted(read()) == [("a", 1), ("b", None)] and avro_pair.AvroPairSource({"path": "far://d"}).schema() == schema
    writer = avro_pair._Writer(schema, "far://d", False, "null")
    writer.abort([writer.write(iter(rows)), None])
    (tmp_path / "d" / "m").mkdir()
    (tmp_path / "d" / "m" / "index.avro").write_bytes(b"")
    next((tmp_path / "d").glob("part-*.avro")).rename(tmp_path / "d" / "m" / "data.avro")
    assert sorted(read()) == [("a", 1), ("b", None)] and avro_pair.files_of("far://none") == []


def test_canonical_urls_by_one_look(spark):
    """What the one look lets through is what the parts would give; and it lets plain urls through."""
    rng = random.Random(6)
    parts = ["http://", "https://", "ftp://", "file://", "HTTP://", "mailto:", "a.com", "B.com", "[::1]", "u@", ":80", ":81", "/", "//", "/../", "/..", "/x", "?q=1", "#f", " ", "\n", "é"]
    tail = lambda n: "".join(rng.choice(parts[6:]) for _ in range(rng.randint(0, n)))
    made = {rng.choice(parts[:6]) + tail(6) for _ in range(3000)} | {rng.choice(parts[:4]) + "a.com" + tail(5) for _ in range(3000)} | {"http://a.com/x", "https://a.com"}
    rows = spark.createDataFrame([(m,) for m in sorted(made)], "u string").select("u", F.col("u").rlike(url._CANONICAL).alias("plain"), url._rebuild(F.col("u")).alias("built"), url.normalize("u").alias("normal"))
    got = rows.collect()
    assert all(r.built == r.u for r in got if r.plain) and all(r.normal == r.built for r in got if r.u) and sum(r.plain for r in got) > 300
    assert {r.u for r in got if r.plain} >= {"http://a.com/x", "https://a.com"}


def test_domains_against_plain_search(spark):
    rng = random.Random(7)
    known = ["com", "uk", "co.uk", "a.co.uk", "b", "c.b", *[f"x{i}.y{i % 40}" for i in range(3000)]]
    hosts = [".".join(rng.choice(["com", "uk", "co", "a", "b", "c", "x7", "y7", "zuk"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", "."]) for _ in range(800)] + ["10.0.0.1", "com", "uk"]
    got = spark.createDataFrame([(f"http://{h}/",) for h in hosts], "u string").select(url.domain_suffix("u", known), url.domain_name("u", known), url.domain_name("u", [])).collect()
    for h, (suffix, name, last) in zip(hosts, got):
        labels = h.rstrip(".").split(".")
        fits = [i for i in range(len(labels)) if ".".join(labels[i:]) in set(known)]
        inner = [i for i in fits if i > 0]
        if h == "10.0.0.1":
            assert (suffix, name, last) == (None, h, h)
            continue
        assert suffix == (".".join(labels[fits[0] :]) if fits else None) and last == labels[-1], h
        assert name == (".".join(labels[inner[0] - 1 :]) if inner else labels[-1]), h
