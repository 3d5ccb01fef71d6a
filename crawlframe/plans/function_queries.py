"""Queries over the scalar functions: urls, strings, bytes, maps, dates and headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe.functions import html, text, url
from crawlframe.operators.update import filter_urls
from crawlframe.plans import fixtures as X
from crawlframe.plans.registry import query
from crawlframe.sources import suffixes

SUFFIXES = ("com", "net", "org")
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_DOMAIN = f"array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.')"
#: Canonical forms of urls.
_VECTORS = [
    ("", ""), (" http://A.Com ", "http://a.com/"), ("http://a.com:80/x#f", "http://a.com/x"), ("http://a.com/aa/bb/../../cc/../foo.html", "http://a.com/foo.html"),
    ("http://a.com/../x", "http://a.com/x"), ("http://a.com//x///y", "http://a.com/x/y"), ("http://a.com/p?u=http://b.com", "http://a.com/p?u=http:/b.com"),
    ("https://A.com/x#f", "https://A.com/x#f"), ("http://a.com/./../x", "http://a.com/./../x"), ("http://a.com/a/..", "http://a.com/a/.."), ("not a url", None),
]


def _values(rows, columns: str) -> str:
    cell = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") as v({columns})"


@query(f"select page_id, {X.PAGE_URL} as normal from pages")
def url_normalize(spark, sf_dir):
    return filter_urls(X.table(spark, sf_dir, "pages")).select("page_id", F.col("url").alias("normal"))


@query(_values(_VECTORS, "url, normal"))
def url_normalize_vectors(spark, sf_dir):
    return spark.createDataFrame([(u,) for u, _ in _VECTORS], "url string").select("url", url.normalize("url").alias("normal"))


@query(f"select page_id, {_HOST} as host from pages")
def url_host(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", url.host("url").alias("host"))


@query(r"select page_id, replace(lower(url), lower(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1)), '') as page from pages")
def url_page(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", url.page("url").alias("page"))


@query(f"select page_id, array_to_string(string_split({_HOST}, '.'), '|') as segments from pages")
def url_host_segments(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", F.array_join(url.host_segments("url"), "|").alias("segments"))


@query(f"select page_id, {_DOMAIN} as domain from pages")
def url_domain(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", url.domain_name("url", SUFFIXES).alias("domain"))


@query(f"select page_id, list_extract(string_split({_HOST}, '.'), -1) as suffix from pages")
def url_domain_suffix(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", url.domain_suffix("url", SUFFIXES).alias("suffix"))


_RECORDS = """<domains><tlds>
<itlds><tld domain="arpa"><status>INFRASTRUCTURE</status></tld></itlds>
<gtlds><tld domain="com"><status>UNSPONSORED</status><boost>1.5</boost></tld><tld domain="org"/></gtlds>
<cctlds><tld domain="uk"><country>United Kingdom</country></tld></cctlds>
</tlds><suffixes><suffix domain="co.uk"/></suffixes></domains>"""


@query("""with hosts as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host from pages),
urls as (select page_id, 'http://' || host || '/' as url, host from hosts union all select -page_id - 1, 'http://www.' || replace(host, '.', '-') || '.co.uk/', '.co.uk' from hosts union all select null, 'http://10.0.0.1/', '')
select page_id, r.domain, r.status, r.boost, r.type, r.country from urls left join (values ('.co.uk', 'co.uk', 'IN_USE', 1.0::double, null, null), ('.com', 'com', 'UNSPONSORED', 1.5::double, 'GENERIC', null),
  ('.org', 'org', 'IN_USE', 1.0::double, 'GENERIC', null)) as r(ending, domain, status, boost, type, country) on ends_with(host, ending)""")
def url_suffix_record(spark, sf_dir):
    """Record of the longest known suffix, from a table that was read from XML, by a join over the hosts."""
    table = spark.createDataFrame(suffixes.parse(_RECORDS), suffixes.SCHEMA)
    hosts = X.table(spark, sf_dir, "pages").select("page_id", url.host("url").alias("host"))
    rows = hosts.select("page_id", F.concat(F.lit("http://"), "host", F.lit("/")).alias("url"))
    other = hosts.select((-F.col("page_id") - 1).alias("page_id"), F.concat(F.lit("http://www."), F.replace("host", F.lit("."), F.lit("-")), F.lit(".co.uk/")).alias("url"))
    rows = rows.unionByName(other).unionByName(spark.createDataFrame([(None, "http://10.0.0.1/")], "page_id long, url string"))
    return suffixes.with_suffix(rows, table).select("page_id", "suffix.*")


_PAIRS = "a.page_id, a.url as src, b.url as dst from pages a join pages b on b.page_id = a.page_id + 1"


def _pairs(spark, sf_dir):
    a = X.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("src"))
    b = X.table(spark, sf_dir, "pages").select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("dst"))
    return a.join(b, "page_id")


@query(f"select page_id, {_DOMAIN.replace('url', 'src')} = {_DOMAIN.replace('url', 'dst')} as same from (select {_PAIRS})")
def url_same_domain(spark, sf_dir):
    return _pairs(spark, sf_dir).select("page_id", url.same_domain("src", "dst", SUFFIXES).alias("same"))


@query(f"""with p as (select {_PAIRS}), q as (
  select *, {_DOMAIN.replace('url', 'src')} as da, {_DOMAIN.replace('url', 'dst')} as db, {_HOST.replace('url', 'src')} as ha, {_HOST.replace('url', 'dst')} as hb,
    regexp_extract(src, '^[a-z]+://[^/?#]+([^#]*)', 1) as fa, regexp_extract(dst, '^[a-z]+://[^/?#]+([^#]*)', 1) as fb from p
), r as (select *, fa in ('', '/') as ra, fb in ('', '/') as rb, len(string_split(fa, '/')) as pa, len(string_split(fb, '/')) as pb,
  len(string_split(ha, '.')) as la, len(string_split(hb, '.')) as lb from q)
select page_id, case when da <> db then dst when page_id % 2 = 1 then case when ra then src else dst end
  when ra and not rb then src when not ra and rb then dst
  when not ra and not rb and ha = hb then case when pb < pa or (pb = pa and length(fb) < length(fa)) then dst else src end
  when lb < la then dst else src end as repr from r""")
def url_choose_repr(spark, sf_dir):
    return _pairs(spark, sf_dir).select("page_id", url.choose_repr("src", "dst", F.col("page_id") % 2 == 0, SUFFIXES).alias("repr"))


_EVENT = "event_id, event_type"


@query("select event_id, rpad(event_type, cast(greatest(6, length(event_type)) as int), ' ') as right_, lpad(event_type, cast(greatest(6, length(event_type)) as int), ' ') as left_ from events")
def str_pad(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", text.right_pad("event_type", 6).alias("right_"), text.left_pad("event_type", 6).alias("left_"))


@query("select event_id, lower(hex(encode(event_type))) as hex_ from events")
def str_hex(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", text.to_hex(F.col("event_type").cast("binary")).alias("hex_"))


@query("select event_id, event_type as again, cast(null as varchar) as bad from events")
def str_unhex(spark, sf_dir):
    packed = text.to_hex(F.col("event_type").cast("binary"))
    return X.table(spark, sf_dir, "events").select("event_id", text.from_hex(F.concat(F.lit(" "), packed)).cast("string").alias("again"), text.from_hex(F.lit("zz")).cast("string").alias("bad"))


@query(_values([("000102030405", "00:01:02:\n03:0405", 4)], "data, lines, n").replace("'00:01:02:\n03:0405'", "'00:01:02:03' || chr(10) || '0405'"))
def str_hex_lines(spark, sf_dir):
    rows = spark.createDataFrame([("000102030405", 4)], "data string, n int")
    return rows.select("data", text.to_hex_lines(F.unhex("data"), ":", 4).alias("lines"), "n")


@query("select doc_id, md5(text) as digest from documents")
def str_md5(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("select doc_id, coalesce(text, '') = '' as empty, regexp_full_match(coalesce(text, ''), '[ \\t\\r\\n]*') as blank from documents")
def str_is_empty(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", text.is_empty("text").alias("empty"), text.is_xml_space(F.coalesce("text", F.lit(""))).alias("blank"))


@query("select page_id, md5(html) as signature from pages")
def signature_md5(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", text.to_hex(text.signature(F.col("html").cast("binary"))).alias("signature"))


@query("select md5(text) as signature, count(*) as copies, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def signature_dedup(spark, sf_dir):
    rows = X.table(spark, sf_dir, "documents").filter("text is not null")
    return rows.groupBy(text.to_hex(text.signature(F.col("text").cast("binary"))).alias("signature")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(_values([(None, 1), ("7f", 4), ("80", 2), ("ff", 3), ("0000", 5)], "data, place").replace("null, 1", "cast(null as varchar), 1"))
def signature_order(spark, sf_dir):
    """Null first, shorter first, then signed bytes."""
    from pyspark.sql import Window

    rows = spark.createDataFrame([(None,), ("7f",), ("80",), ("ff",), ("0000",)], "data string")
    return rows.select("data", F.row_number().over(Window.orderBy(text.signature_order(F.unhex("data")))).alias("place"))


_PREFIX = ["abcd", "abc", "aac", "baz", "foo", "foobar"]
_SUFFIX = ["a", "abcd", "bcd", "bcdefg", "defg", "aac", "baz", "foo", "foobar"]
_INPUTS = ["a", "ab", "abc", "abcdefg", "apple", "aa", "aac", "aaccca", "abaz", "baz", "bazooka", "fo", "foobar", "kite"]


def _trie_sql(patterns, test) -> str:
    inputs = ", ".join(f"('{i}')" for i in [*_INPUTS])
    known = ", ".join(f"('{p}')" for p in patterns)
    return f"""select v.input, min_by(p.pattern, length(p.pattern)) as shortest, max_by(p.pattern, length(p.pattern)) as longest, count(p.pattern) > 0 as matches
      from (values {inputs}) v(input) left join (values {known}) p(pattern) on {test}(v.input, p.pattern) group by v.input"""


@query(_trie_sql(_PREFIX, "starts_with"))
def trie_prefix(spark, sf_dir):
    rows = spark.createDataFrame([(i,) for i in _INPUTS], "input string")
    return rows.select("input", text.prefix_shortest("input", _PREFIX).alias("shortest"), text.prefix_longest("input", _PREFIX).alias("longest"), text.prefix_matches("input", _PREFIX).alias("matches"))


@query(_trie_sql(_SUFFIX, "ends_with"))
def trie_suffix(spark, sf_dir):
    rows = spark.createDataFrame([(i,) for i in _INPUTS], "input string")
    return rows.select("input", text.suffix_shortest("input", _SUFFIX).alias("shortest"), text.suffix_longest("input", _SUFFIX).alias("longest"), text.suffix_matches("input", _SUFFIX).alias("matches"))


@query("select event_id, case when starts_with(event_type, 'pur') then 'pur' when starts_with(event_type, 'c') then 'c' end as prefix from events")
def trie_prefix_events(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", text.prefix_longest("event_type", ["pur", "c", "ck"]).alias("prefix"))


@query(_values([("content-type", "Content-Type"), ("Contnt-Type", "Content-Type"), ("X-Foo", "X-Foo"), ("LASTMODIFIED", "Last-Modified"), ("Lcation", "Location")], "name, canonical"))
def header_spellcheck(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n in ("content-type", "Contnt-Type", "X-Foo", "LASTMODIFIED", "Lcation")], "name string")
    return rows.select("name", text.header_name("name").alias("canonical"))


@query("""select event_id, 'text/html' as first_, case when event_id % 2 = 0 then 2 else 1 end as added, 'x' as set_, 0 as left_, 3 as appended from events""")
def header_multimap(spark, sf_dir):
    start = F.expr("map('Content-Type', array('text/html'))")
    second = F.when(F.col("event_id") % 2 == 0, "b").otherwise("text/html")
    added = text.multi_add(start, F.lit("content-type"), second)
    get = lambda m: text.multi_get(m, F.lit("Contnt-Type"))
    return X.table(spark, sf_dir, "events").select(
        "event_id", get(added).alias("first_"), F.size(F.element_at(added, "Content-Type")).alias("added"), get(text.multi_set(start, F.lit("content-type"), F.lit("x"))).alias("set_"),
        F.size(text.multi_remove(start, F.lit("content-type"))).alias("left_"), F.size(F.element_at(text.multi_append(start, F.lit("Content-Type"), F.expr("array('text/html', 'c')")), "Content-Type")).alias("appended"),
    )


@query("select event_id, strftime(date_trunc('second', ts), '%a, %d %b %Y %H:%M:%S') || ' GMT' as stamp from events")
def http_date_format(spark, sf_dir):
    return X.events(spark, sf_dir).select("event_id", text.http_date("ms").alias("stamp"))


@query("select event_id, epoch_us(ts) // 1000000 * 1000 as ms from events")
def http_date_parse(spark, sf_dir):
    return X.events(spark, sf_dir).select("event_id", text.http_date_ms(text.http_date("ms")).alias("ms"))


@query("""select event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":' || cast(to_json(props) as varchar) || '}' as record from events""")
def to_json_record(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", text.record_json("event_id", "event_type", "props").alias("record"))


@query("select doc_id, octet_length(encode(text)) as n, true as zipped, true as zlib_, true as raw from documents where text is not null")
def gzip_roundtrip(spark, sf_dir):
    """Text packed and unpacked again by each codec."""
    data = F.col("text").cast("binary")
    rows = X.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", data.alias("data"))
    raw = F.expr("substring(z, 3, octet_length(z) - 6)")
    packed = rows.select("*", text.gzip_pack("data").alias("g"), text.deflate("data").alias("z")).withColumn("r", raw)
    return packed.select("doc_id", F.octet_length("data").cast("long").alias("n"), (text.gunzip("g") == F.col("data")).alias("zipped"), (text.inflate("z") == F.col("data")).alias("zlib_"), (text.inflate_raw("r") == F.col("data")).alias("raw"))


@query("select doc_id, text, left(hex(encode(text)), 20) as head from documents where text is not null")
def gzip_cut(spark, sf_dir):
    """A stream without its last eight bytes still gives the whole text, and a limit the first bytes alone."""
    rows = X.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.gzip_pack(F.col("text").cast("binary")).alias("g"))
    cut = F.expr("substring(g, 1, octet_length(g) - 8)")
    return rows.select("doc_id", text.gunzip(cut).cast("string").alias("text"), F.hex(text.gunzip("g", 10)).alias("head"))


_ENTITIES = [("a < b & \"c\"", "a &lt; b &amp; &quot;c&quot;"), ("é ÿ", "&eacute; &yuml;"), ("漢", "&#28450;"), ("plain", "plain"), ("", "")]
_CODED = [("&lt;&amp;gt;", "<&gt;"), ("&#65;&#x42;&#X43;", "ABC"), ("&nothing;x", "x"), ("& ;&", "& ;&"), ("&euro;", "€"), ("&#1114112;", "")]


@query(_values([(a, b, a) for a, b in _ENTITIES], "plain, coded, again"))
def entity_encode(spark, sf_dir):
    rows = spark.createDataFrame([(a,) for a, _ in _ENTITIES], "plain string").withColumn("coded", text.entities_encode("plain"))
    return rows.withColumn("again", text.entities_decode("coded"))


@query(_values(_CODED, "coded, plain"))
def entity_decode(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in _CODED], "coded string").withColumn("plain", text.entities_decode("coded"))


@query("select doc_id, text from documents where text is not null")
def entity_codec(spark, sf_dir):
    """Text with its signs as entities, and back."""
    return X.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.entities_decode(text.entities_encode("text")).alias("text"))


@query("select event_id, cast(floor(cast(cast(value as float) + cast(0.5 as float) as float)) as int) as rounded from events")
def java_round(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", text.java_round(F.col("value")).alias("rounded"))


@query("select event_id, 'Authorization: Basic ' || to_base64(encode(event_type || ':' || user_id)) as header from events")
def basic_auth(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_id", text.basic_auth("event_type", F.col("user_id").cast("string")).alias("header"))


@query("select page_id, regexp_extract(html, '<title>', 0) <> '' as titled, 1 as bodies from pages")
def xpath_text(spark, sf_dir):
    """Nodes by path: every test page has one title and one body."""
    rows = X.table(spark, sf_dir, "pages")
    return rows.select("page_id", (html.xpath_text("html", ".//title") != "").alias("titled"), F.when(html.xpath_html("html", ".//body").isNotNull(), 1).otherwise(0).alias("bodies"))


@query(f"with {X.LINKS} select page_id, link, count(*) as n from links group by all")
def xpath_links(spark, sf_dir):
    rows = X.table(spark, sf_dir, "pages").select("page_id", F.explode(html.xpath_links("html", "url", ".//a")).alias("link"))
    return rows.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(_values([("crawler", "crawler/1.0 (desc; http://a.com; a@b.c)"), ("bare", "bare")], "name, agent"))
def agent_string(spark, sf_dir):
    made = [("crawler", text.agent_string("crawler", "1.0", "desc", "http://a.com", "a@b.c")), ("bare", text.agent_string("bare"))]
    return spark.createDataFrame(made, "name string, agent string")
