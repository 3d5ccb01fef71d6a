"""The crawl as a whole: inject, then generate, fetch, parse and update until nothing is left to fetch.

Every stage is written before the next one reads it, which cuts lineage and keeps each page from being requested twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe import schema as S
from crawlframe.config import DAY_MS, CrawlConfig
from crawlframe.operators import fetch as fetching
from crawlframe.operators import generate, inject, parse, update
from crawlframe.sources.store import SEGMENT, Segments, StateStore

#: A file of a segment's part is for so many of its urls.
FILE_URLS = 1000


class Crawl:
    """A crawl below a folder: state snapshots and segments."""

    def __init__(self, spark: SparkSession, root: str, config: CrawlConfig = CrawlConfig(), parsers=None):
        self.spark, self.config, self.parsers = spark, config, parsers
        self.store = StateStore(spark, f"{root}/crawldb", S.CRAWL_DATUM)
        self.segments = Segments(spark, f"{root}/segments")

    def _conform(self, df: DataFrame, *keep: str) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.CRAWL_DATUM.fields], *keep)

    def inject(self, lines: DataFrame, force: bool = False) -> None:
        with self.store.lock(force):
            seeds = inject.parse(lines, self.config).withColumn("seq", F.xxhash64("url")).withColumn("retries", F.lit(0)).withColumn("modified_time", F.lit(0).cast("long"))
            self.store.install(self._conform(inject.merge(self.store.read(), self._conform(seeds))))

    def generate(self, force: bool = False, seed: int | None = None) -> list[str]:
        """Names of the segments that were made; none when nothing is due."""
        with self.store.lock(force):
            state = self.store.read()
            chosen = generate.stamp(generate.segments(generate.select(state, self.config), self.config, seed), self.config)
            made = self.segments.deal(generate.fetch_lists(chosen), "segment_no", f"{self.config.now_ms:013d}", "crawl_generate")
            for name in made:
                self.segments.mark(name, "generated")
            if made:
                self.store.install(generate.write_back(state, self.segments.inputs("crawl_generate", made, chosen.schema)[0], self.config))
        return made

    def fetch(self, segments: str | list[str], fetcher: Callable | None = None, pages: DataFrame | None = None) -> None:
        """Fetch segments over a fetcher, or from a table of pages, which is read once for all of them."""
        names = [segments] if isinstance(segments, str) else segments
        rows = self.segments.gather("crawl_generate", names)
        got = fetching.fetch(rows, fetcher, self.config) if pages is None else fetching.fetch_from(rows, pages)
        with self.segments.draft(got) as got:
            self._spread(self._conform(fetching.status_rows(got, self.config), SEGMENT), names, "crawl_fetch")
            self._spread(fetching.contents(got, F.col(SEGMENT), self.config, (SEGMENT,)), names, "content")
        for name in names:
            self.segments.mark(name, "fetched")

    def parse(self, segments: str | list[str]) -> None:
        """Parse segments; earlier results of them are replaced."""
        names, keep = [segments] if isinstance(segments, str) else segments, (SEGMENT,)
        with self.segments.draft(parse.parse(self.segments.gather("content", names, S.CONTENT), self.parsers, self.config.default_charset, keep)) as records:
            self._spread(self._conform(parse.linked_rows(parse.outlinks(records, keep), keep=keep), SEGMENT), names, "crawl_parse")
            self._spread(parse.app_info(records, keep), names, "app_info")
        for name in names:
            self.segments.mark(name, "parsed")

    def _spread(self, df: DataFrame, names: list[str], part: str) -> None:
        self.segments.spread(df, names, part, -(-self.config.urls_per_segment // FILE_URLS))

    def update(self, segments: list[str], force: bool = False) -> list[str]:
        """Merge segments into the state; returns those that had no parsed links."""
        with self.store.lock(force):
            fetched, _ = self.segments.inputs("crawl_fetch", segments, S.CRAWL_DATUM)
            linked, without = self.segments.inputs("crawl_parse", segments, S.CRAWL_DATUM)
            none = self.spark.createDataFrame([], S.CRAWL_DATUM)
            merged = update.update(self.store.read(), fetched if fetched is not None else none, linked if linked is not None else none, self.config)
            self.store.install(self._conform(merged))
        return without

    def run(self, fetcher: Callable | None = None, pages: DataFrame | None = None, most_rounds: int | None = None) -> int:
        """Rounds until nothing is due. The clock goes on by the lock's length each round, so failed urls come again.

        The segments of a round share their jobs, so a round has as many of them however long the state is; over a fetcher a segment is
        fetched at a time, so that what it brought stays if a later one fails.
        """
        for n in count():
            made = self.generate() if n != most_rounds else []
            if not made:
                return n
            for names in [made] if pages is not None else [[name] for name in made]:
                self.fetch(names, fetcher, pages)
            self.parse(made)
            self.update(made)
            self.config = replace(self.config, now_ms=self.config.now_ms + self.config.lock_days * DAY_MS)

    def app_info(self) -> DataFrame | None:
        return self.segments.inputs("app_info")[0]
