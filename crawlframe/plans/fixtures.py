"""Views over the test tables in the roles of crawl tables, as DataFrames and as the same tables in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_705_104_000_000
_EPOCH = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ms``, their time in milliseconds."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rows.withColumn("ms", F.expr(_EPOCH))


def records(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Events as state, fetch and link rows: (url, seq, status, fetch_time, retries) and further expressions."""
    status = F.expr("case event_type when 'signup' then 1 when 'purchase' then 2 when 'view' then 33 when 'error' then 34 else 67 end")
    url = F.expr("concat('http://h', user_id % 25, '.example.com/u/', user_id, '/', event_id % 7)")
    return events(spark, sf_dir).select(url.alias("url"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ms").alias("fetch_time"), F.expr("cast(event_id % 5 as int)").alias("retries"), *[F.expr(x) for x in more])


RECORDS = """records as (
  select 'http://h' || (user_id % 25) || '.example.com/u/' || user_id || '/' || (event_id % 7) as url, event_id as seq,
    case event_type when 'signup' then 1 when 'purchase' then 2 when 'view' then 33 when 'error' then 34 else 67 end as status,
    epoch_us(ts) // 1000 as fetch_time, cast(event_id % 5 as int) as retries, props, event_type
  from events
), ranked as (
  select *, row_number() over (partition by url, kind order by case when kind = 'linked' then 0 else fetch_time end desc, seq) as place
  from (select *, case when status <= 31 then 'db' when status <= 63 then 'fetch' when status = 67 then 'linked' end as kind from records)
  where kind is not null
), picked as (select * from ranked where place = 1)"""


def seeds(spark: SparkSession, sf_dir: str, reserved: bool = False) -> DataFrame:
    """Seed lines; every fifth is a bare url. ``reserved`` adds score and interval fields."""
    extra = F.concat(F.lit("\tscore=2.5\tfetchInterval="), F.col("page_id").cast("string")) if reserved else F.lit("")
    line = F.concat("url", F.lit("\tparse_class=article\tk="), F.col("page_id").cast("string"), F.lit("\tjunk"), extra)
    return table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(line).alias("line"))


#: Canonical url of a page; the test pages need no other rule.
PAGE_URL = "case when url like 'http://%' then regexp_replace(url, '#.*$', '') else url end"


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as state rows with the time of a lock in ``meta_data`` on three of four."""
    from crawlframe.functions.url import normalize

    lock = F.when(F.col("page_id") % 4 != 0, F.expr("map('_ngt_', cast(1704067200000 + page_id * 3600000 as string))")).otherwise(F.expr("cast(map() as map<string,string>)"))
    rows = table(spark, sf_dir, "pages")
    return rows.select(
        "page_id", normalize("url").alias("url"), (F.col("page_id") % 6 + 1).cast("int").alias("status"),
        F.lit(0).cast("long").alias("fetch_time"), F.lit(0).cast("long").alias("modified_time"), F.lit(0).alias("retries"),
        F.expr("map('parse_class', 'article')").alias("extend"), lock.alias("meta_data"), F.col("page_id").alias("seq"),
    )


STATE = f"""state as (
  select page_id, {PAGE_URL} as url, cast(page_id % 6 + 1 as int) as status,
    case when page_id % 4 = 0 then null else 1704067200000 + page_id * 3600000 end as ngt from pages
), chosen as (
  select * from state where status not in (2, 3) and (ngt is null or ngt + 604800000 <= {NOW})
), placed as (
  select *, row_number() over (order by md5(url), url) - 1 as position from chosen
)"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as content rows."""
    from crawlframe.functions.url import normalize

    headers = F.create_map(F.lit("Content-Type"), F.array(F.lit("text/html; charset=utf-8")))
    return table(spark, sf_dir, "pages").select(normalize("url").alias("url"), F.col("html").cast("binary").alias("content"), F.expr("map('parse_class', 'article')").alias("extend"), headers.alias("meta_data"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("cast(element_at(array(200, 200, 301, 302, 304, 400, 401, 404, 410, 500, 303, 307), cast(event_id % 12 as int) + 1) as int)")
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"))


CODES = "codes as (select event_id, ([200, 200, 301, 302, 304, 400, 401, 404, 410, 500, 303, 307])[event_id % 12 + 1] as code from events)"


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a schedule."""
    return events(spark, sf_dir).select(
        "event_id", F.lit(2).alias("status"), F.col("ms").alias("fetch_time"),
        F.expr("case event_id % 3 when 0 then 0 else ms - (event_id % 1000) * 60000 end").alias("modified_time"),
        F.expr("cast((event_id % 97) * 100000 as int)").alias("fetch_interval"), F.expr("cast(event_id % 4 as int)").alias("retries"),
        F.expr("cast(event_id % 3 as int)").alias("change"), F.expr("unhex(md5(props))").alias("signature"),
    )


SCHEDULES = """rows_ as (
  select event_id, 2 as status, epoch_us(ts) // 1000 as fetch_time,
    case event_id % 3 when 0 then 0 else epoch_us(ts) // 1000 - (event_id % 1000) * 60000 end as modified_time,
    cast((event_id % 97) * 100000 as int) as fetch_interval, cast(event_id % 4 as int) as retries, cast(event_id % 3 as int) as change
  from events)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, link): link targets of pages by pattern; all of them are root-relative."""
    from crawlframe.functions.url import resolve

    found = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)).alias("href"))
    return found.select("page_id", "url", resolve("url", "href").alias("link"))


LINKS = r"""links as (
  select page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as link from pages
)"""
