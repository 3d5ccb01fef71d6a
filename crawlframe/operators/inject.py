"""Seeds: parsing of seed lines and their merge into the state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlframe import schema as S
from crawlframe.config import CrawlConfig
from crawlframe.functions.url import NORMALIZERS


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a seed file, as column ``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse(lines: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """State rows (status injected) of seed lines: a url, then ``key=value`` fields after tabs.

    ``parse_class`` goes to ``extend``, other keys to ``meta_data``; fields without = are skipped, of repeated keys the
    last stays. Malformed urls are dropped. As wired, so are lines without a tab.
    """
    fields = F.split("line", "\t")
    pairs = F.transform(F.filter(F.slice(fields, 2, F.size(fields)), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, r"(?s)^[^=]*=", "").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    every = F.map_from_entries(last)
    rows = lines if config.compat == "intended" else lines.filter(F.contains("line", F.lit("\t")))
    rows = rows.select(NORMALIZERS[config.normalizer](F.get(fields, F.lit(0))).alias("url"), every.alias("all")).filter("url is not null and url <> ''")
    given = lambda key, kind, default: F.coalesce(F.try_element_at("all", F.lit(key)).try_cast(kind), F.lit(default).cast(kind)) if config.honor_reserved_keys else F.lit(default).cast(kind)
    reserved = ("score", "fetchInterval") if config.honor_reserved_keys else ()
    return rows.select(
        "url",
        F.lit(S.INJECTED).alias("status"),
        F.lit(config.now_ms).cast("long").alias("fetch_time"),
        given("fetchInterval", "int", config.interval_default).alias("fetch_interval"),
        given("score", "float", config.score_injected).alias("score"),
        F.map_filter("all", lambda k, v: k == S.PARSE_KEY).alias("extend"),
        F.map_filter("all", lambda k, v: ~k.isin(S.PARSE_KEY, *reserved)).alias("meta_data"),
    )


def merge(existing: DataFrame, injected: DataFrame) -> DataFrame:
    """State rows after an injection: an existing row wins whole, else the injected one becomes unfetched; of several, that with the largest seq,
    and of those one that names a parser, then that whose fields come last."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(injected.withColumn("_new", F.lit(1)), True)
    ties = [F.desc(f(c)) for c in ("extend", "meta_data") if c in both.columns for f in (F.size, F.to_json)]
    first = Window.partitionBy("url").orderBy("_new", F.desc("seq"), *ties)
    chosen = both.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    status = F.when(F.col("_new") == 1, S.DB_UNFETCHED).otherwise(F.col("status"))
    return chosen.withColumn("status", status.cast("int")).drop("_new", "_rank")
