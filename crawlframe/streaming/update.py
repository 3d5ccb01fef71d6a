"""Incremental update: a stream of fetch and link records is merged into the state, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from crawlframe import schema as S
from crawlframe.config import CrawlConfig
from crawlframe.operators import update
from crawlframe.sources.store import StateStore


def update_stream(records: DataFrame, store: StateStore, checkpoint: str, config: CrawlConfig = CrawlConfig(), once: bool = True, wait_s: float = 600.0) -> StreamingQuery:
    """Start a query that merges each batch of ``records`` (rows of the state's schema) and installs a snapshot.

    A batch that runs again after a failure gives the same state: of equal records one counts. Each batch holds the state's lock, for
    which it waits up to ``wait_s`` seconds, so no other update is lost. ``once`` ends the query when what is there has been merged.
    """
    names = S.CRAWL_DATUM.fieldNames()

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        with store.lock(wait_s=wait_s):
            both = store.read().select(*names).unionByName(batch.select(*names))
            store.install(update.merge(update.filter_urls(both, normalizer=config.normalizer), config).select(*names))

    writer = records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
