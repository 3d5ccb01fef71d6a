"""Queries over stored tables: lookups, snapshots, sinks and interchange files."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlframe import schema as S
from crawlframe.operators import lookup
from crawlframe.operators.update import filter_urls
from crawlframe.plans import fixtures as X
from crawlframe.plans.registry import query
from crawlframe.sources import store
from crawlframe.sources.avro_pair import AvroPairSource


def _sorted(spark, sf_dir):
    path = store.shared_folder(spark, "sorted")
    lookup.write_sorted(X.table(spark, sf_dir, "pages").select("url", "page_id"), path)
    return spark.read.parquet(path)


@query("select url, page_id from pages where url = (select min(url) from pages where page_id between 10 and 20)")
def lookup_get(spark, sf_dir):
    key = X.table(spark, sf_dir, "pages").filter("page_id between 10 and 20").agg(F.min("url")).first()[0]
    return lookup.get(_sorted(spark, sf_dir), key)


@query("select url, page_id from pages where page_id = 7")
def lookup_get_hashed(spark, sf_dir):
    rows, path = X.table(spark, sf_dir, "pages").select("url", "page_id"), store.shared_folder(spark, "hashed")
    lookup.write_hashed(rows, path, 4)
    return lookup.get_hashed(spark, path, rows.filter("page_id = 7").first()["url"], 4).select("url", "page_id")


@query("""select url as mid_key from (select url, row_number() over (order by url) - 1 as n, count(*) over () as total from pages)
  where n = greatest(((total + 15) // 16 - 1) // 2 * 16, 0)""")
def lookup_mid_key(spark, sf_dir):
    return lookup.mid_key(_sorted(spark, sf_dir), 16)


@query("select count(*) as size from pages")
def lookup_size(spark, sf_dir):
    return lookup.size(_sorted(spark, sf_dir))


@query("select max(url) as final_key from pages")
def lookup_final_key(spark, sf_dir):
    return lookup.final_key(_sorted(spark, sf_dir))


@query(f"with {X.RECORDS} select url, max_by(status, seq) as status, max(seq) as seq from records group by url")
def hash_lookup(spark, sf_dir):
    return lookup.last_values(X.records(spark, sf_dir).select("url", "status", "seq"))


@query(f"with {X.RECORDS} select count(distinct url) as size, max_by(url, seq) as final_key from records")
def hash_facts(spark, sf_dir):
    return lookup.hash_facts(X.records(spark, sf_dir))


@query("""select * from (values ('/s/20240101/content/part-00003/data', '20240101', 'part-00003'), ('/s/20240102/crawl_fetch/part-1', '20240102', 'part-1'), ('/nothing', null, null)) as v(path, segment, part)""")
def segment_part_resolve(spark, sf_dir):
    rows = spark.createDataFrame([("/s/20240101/content/part-00003/data",), ("/s/20240102/crawl_fetch/part-1",), ("/nothing",)], "path string")
    return rows.withColumn("p", store.segment_part(F.col("path"))).select("path", "p.segment", "p.part")


@query("select * from (values ('20240101/part-3', '20240101', 'part-3'), ('none', null, null)) as v(label, segment, part)")
def segment_part_parse(spark, sf_dir):
    rows = spark.createDataFrame([("20240101/part-3",), ("none",)], "label string")
    return rows.withColumn("p", store.parse_segment_part(F.col("label"))).select("label", "p.segment", "p.part")


@query("select page_id, url, octet_length(encode(html)) as bytes, md5(html) as digest from pages")
def pair_avro_roundtrip(spark, sf_dir):
    """Pages written as Avro container files and read again."""
    spark.dataSource.register(AvroPairSource)
    path = store.shared_folder(spark, "avro")
    rows = X.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("content"))
    rows.write.format("avro_pair").mode("append").save(path)
    again = spark.read.format("avro_pair").schema(rows.schema).load(path)
    return again.select("page_id", "url", F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


@query(f"select {X.PAGE_URL} as url, cast(page_id % 6 + 1 as int) as status from pages where page_id % 2 = 1")
def snapshot_install(spark, sf_dir):
    """The second of two snapshots is in force."""
    schema = X.state(spark, sf_dir).select("url", "status").schema
    kept = store.StateStore(spark, store.shared_folder(spark, "state"), schema)
    rows = X.state(spark, sf_dir)
    with kept.lock():
        kept.install(rows.filter("page_id % 2 = 0").select("url", "status"))
        kept.install(rows.filter("page_id % 2 = 1").select("url", "status"))
    return kept.read()


@query("select case when event_type = 'error' then 'bad' else 'good' end as sink, count(*) as n from events where event_type in ('error', 'view') group by 1")
def router_sinks(spark, sf_dir):
    base = store.shared_folder(spark, "router")
    router = store.Router().add("good", F.col("event_type") == "view", ["event_id"]).add("bad", F.col("event_type") == "error", ["event_id", "props"], "json")
    router.write(X.table(spark, sf_dir, "events"), base)
    good = spark.read.parquet(f"{base}/good").select(F.lit("good").alias("sink"))
    bad = spark.read.schema("event_id long, props string").json(f"{base}/bad").select(F.lit("bad").alias("sink"))
    return good.unionByName(bad).groupBy("sink").agg(F.count("*").alias("n"))


@query(f"with {X.RECORDS} select url from records group by url")
def key_order(spark, sf_dir):
    """Keys in the order of their UTF-8 bytes."""
    return filter_urls(X.records(spark, sf_dir).select("url")).distinct().orderBy("url")


_STATE = [
    ("url", "string"), ("status", "int"), ("fetch_time", "bigint"), ("modified_time", "bigint"), ("fetch_interval", "int"), ("retries", "int"), ("score", "float"),
    ("signature", "binary"), ("extend", "map<string,string>"), ("meta_data", "map<string,string>"), ("seq", "bigint"),
]


@query("select * from (values " + ", ".join(f"('{n}', '{k}')" for n, k in _STATE) + ") as v(name, kind)")
def state_schema(spark, sf_dir):
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in S.CRAWL_DATUM.fields], "name string, kind string")
