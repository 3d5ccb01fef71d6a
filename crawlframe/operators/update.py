"""Merge of fetch results and discovered links into the state table: one shuffle on the url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe import schema as S
from crawlframe.config import CrawlConfig
from crawlframe.functions.http import has_db_status, has_fetch_status
from crawlframe.functions.text import put_all
from crawlframe.functions.url import NORMALIZERS


def filter_urls(records: DataFrame, column: str = "url", normalizer: str = "basic") -> DataFrame:
    """Normalise the key and drop rows whose url is malformed."""
    return records.withColumn(column, NORMALIZERS[normalizer](column)).filter(F.col(column).isNotNull())


def _transition(f: Column, o: Column, config: CrawlConfig) -> Column:
    """New status for fetch or link row ``f``."""
    retries = f["retries"]
    unchanged = F.lit(S.DB_NOTMODIFIED) if config.compat == "intended" else F.raise_error(F.lit("Unknown status: fetch_notmodified")).cast("int")
    return (
        F.when(f["status"] == S.FETCH_SUCCESS, S.DB_FETCHED)
        .when(f["status"] == S.FETCH_REDIR_TEMP, S.DB_REDIR_TEMP)
        .when(f["status"] == S.FETCH_REDIR_PERM, S.DB_REDIR_PERM)
        .when((f["status"] == S.FETCH_RETRY) & (retries < config.retry_max), S.DB_UNFETCHED)
        .when(f["status"] == S.FETCH_RETRY, S.DB_GONE)
        .when(f["status"] == S.LINKED, S.DB_UNFETCHED)
        .when(f["status"] == S.FETCH_GONE, S.DB_GONE)
        .when(f["status"] == S.FETCH_NOTMODIFIED, unchanged)
    )


def merge(records: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """State rows after an update.

    ``records`` holds old state, fetch and link rows (url, status, fetch_time, retries, seq and any of modified_time,
    meta_data and further columns, which are carried along). Of each kind one row for a url counts: for state and fetch that of the latest
    fetch_time and then the smallest seq, for links that of the smallest seq. Rows of other kinds are ignored. A url with old state
    and without news keeps its row as it is.
    """
    row = F.struct(*[F.col(c) for c in records.columns if c != "url"])
    latest = F.struct(F.coalesce("fetch_time", F.lit(0)), -F.col("seq"))
    status = F.col("status")
    picked = records.groupBy("url").agg(
        F.max_by(row, F.when(has_db_status(status), latest)).alias("o"),
        F.max_by(row, F.when(has_fetch_status(status), latest)).alias("fetched"),
        F.min_by(row, F.when(status == S.LINKED, F.col("seq"))).alias("linked"),
    )
    news = picked.withColumn("f", F.coalesce("fetched", "linked")).filter("f is not null or o is not null")
    o, f = F.col("o"), F.col("f")
    as_old = f.isNull() | ((f["status"] == S.LINKED) & o.isNotNull())
    if not config.additions_allowed:
        news = news.filter(~(o.isNull() & (f["status"] == S.LINKED)))
    if config.increment_retries:
        more = F.when(f["status"] == S.FETCH_RETRY, f["retries"] + 1).otherwise(f["retries"])
        news = news.withColumn("f", F.when(f.isNotNull(), f.withField("retries", more.cast(records.schema["retries"].dataType))))
    columns = []
    for c in records.columns:
        if c == "url":
            columns.append(F.col("url"))
        elif c == "status":
            columns.append(F.when(as_old, o[c]).otherwise(_transition(F.col("f"), o, config)).alias(c))
        elif c == "modified_time":
            carried = F.when((o[c] > 0) & (f[c] == 0), o[c]).otherwise(f[c])
            columns.append(F.when(as_old, o[c]).otherwise(carried).alias(c))
        elif c == "meta_data":
            merged = F.when(o.isNull(), f[c]).otherwise(put_all(o[c], f[c]))
            cleared = F.map_filter(merged, lambda k, v: k != S.LOCK_KEY)
            old = F.when(f.isNull(), o[c]).otherwise(F.map_filter(o[c], lambda k, v: k != S.LOCK_KEY))
            columns.append(F.when(as_old, old).otherwise(cleared).alias(c))
        else:
            columns.append(F.when(as_old, o[c]).otherwise(f[c]).alias(c))
    return news.select(*columns)


def update(old: DataFrame, fetched: DataFrame, linked: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """State table after the fetch and link rows of segments have come in."""
    return merge(filter_urls(old.unionByName(fetched, True).unionByName(linked, True), normalizer=config.normalizer), config)
