"""Fetch lists: selection with a time lock, segments with a quota, balanced lists, and the lock's write-back.

Positions in a global order come from buckets of a hash and a small table of their sizes, so no step gathers all rows
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe import schema as S
from crawlframe.config import DAY_MS, CrawlConfig
from crawlframe.functions.text import put_all


def select(state: DataFrame, config: CrawlConfig = CrawlConfig(), lock: Column | None = None) -> DataFrame:
    """Rows to fetch: neither fetched nor gone, not excluded by pattern, and not locked at present.

    ``lock`` is the time of the last selection in milliseconds, by default that in ``meta_data``.
    """
    locked = lock if lock is not None else F.try_element_at("meta_data", F.lit(S.LOCK_KEY)).try_cast("long")
    rows = state.filter(~F.col("status").isin(S.DB_FETCHED, S.DB_GONE))
    for pattern in config.url_exclude_patterns:
        rows = rows.filter(~F.col("url").rlike(f"^(?:{pattern})$"))
    return rows.filter(F.coalesce(locked + config.lock_days * DAY_MS <= config.now_ms, F.lit(True)))


def stamp(rows: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """Write the time of selection to the metadata."""
    return rows.withColumn("meta_data", put_all("meta_data", F.create_map(F.lit(S.LOCK_KEY), F.lit(str(config.now_ms)))))


def positions(rows: DataFrame, digest: Column, *ties: str) -> DataFrame:
    """``rows`` with a column ``position``, from 0, in the order of a hex digest and then of ``ties``.

    The first three digits deal rows evenly to 4096 buckets. Counts of the buckets, a table of bounded
    size, tell what stands before each; within a bucket a window numbers the rows. Both follow from the rows alone,
    so a task that runs again gives the same positions.
    """
    keyed = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 3))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", *ties)) - 1
    placed = keyed.withColumn("_in", inside).join(F.broadcast(starts), "_bucket")
    return placed.withColumn("position", F.col("_start") + F.col("_in")).drop("_digest", "_bucket", "_in", "_start")


def segments(selected: DataFrame, config: CrawlConfig = CrawlConfig(), seed: int | None = None) -> DataFrame:
    """Segment number and fetch list of each selected row, in the order of a hash of the url.

    A ``seed`` goes into the hash and gives another order. A segment has ``urls_per_segment`` rows, the last one fewer; lists
    of a segment differ by one row at most. Rows beyond ``max_segments`` are left for another time.
    """
    digest = F.md5("url") if seed is None else F.md5(F.concat(F.lit(f"{seed}:"), "url"))
    placed = positions(selected, digest, "url")
    segment = (F.floor(F.col("position") / config.urls_per_segment) + 1).cast("int")
    list_ = F.pmod(F.col("position"), F.lit(config.fetch_lists)).cast("int")
    out = placed.select(*selected.columns, segment.alias("segment_no"), list_.alias("fetch_list"))
    return out if config.max_segments is None else out.filter(F.col("segment_no") <= config.max_segments)


def segment_name(config: CrawlConfig, number: Column) -> Column:
    """Time of the batch in seconds, and the number of the segment."""
    return F.concat(F.date_format(F.timestamp_millis(F.lit(config.now_ms)), "yyyyMMddHHmmss"), F.lit("-"), F.lpad(number.cast("string"), 4, "0"))


def fetch_lists(generated: DataFrame) -> DataFrame:
    """One partition for each fetch list, sorted by url, so that a list is a task."""
    return generated.repartition("segment_no", "fetch_list").sortWithinPartitions("segment_no", "fetch_list", "url")


def write_back(state: DataFrame, generated: DataFrame, config: CrawlConfig = CrawlConfig(), key: str = "url") -> DataFrame:
    """State with the lock's time on generated rows, told by the url or another key; each keeps its one row."""
    marks = generated.select(key).distinct().withColumn("_locked", F.lit(True))
    joined = state.join(marks, key, "left")
    lock = F.create_map(F.lit(S.LOCK_KEY), F.lit(str(config.now_ms)))
    return joined.withColumn("meta_data", F.when(F.col("_locked"), put_all("meta_data", lock)).otherwise(F.col("meta_data"))).select(*state.columns)
