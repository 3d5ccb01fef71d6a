"""Settings of a crawl. The clock is a setting too: no operator reads the time itself."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

DAY_MS = 86_400_000


@dataclass(frozen=True)
class CrawlConfig:
    now_ms: int = 1_705_104_000_000
    #: "intended" repairs known defects of the behaviour that is reproduced, "wired" keeps them.
    compat: str = "intended"
    interval_default: int = 2_592_000
    interval_max: int = 7_776_000
    score_injected: float = 1.0
    honor_reserved_keys: bool = False
    retry_max: int = 3
    additions_allowed: bool = True
    increment_retries: bool = False
    lock_days: int = 7
    urls_per_segment: int = 1000
    fetch_lists: int = 4
    max_segments: int | None = None
    url_exclude_patterns: tuple[str, ...] = ()
    fetch_threads: int = 10
    fetch_timeout_s: float = 300.0
    content_limit: int = 2_097_152
    default_charset: str = "utf-8"
    #: Names in SIGNATURES and NORMALIZERS.
    signature: str = "md5"
    normalizer: str = "basic"
    inc_rate: float = 0.2
    dec_rate: float = 0.2
    min_interval: int = 60
    max_interval: int = 31_536_000
    sync_delta: bool = True
    sync_delta_rate: float = 0.2

    @classmethod
    def from_session(cls, spark: SparkSession, **given) -> CrawlConfig:
        """Defaults, overridden by ``crawlframe.<field>`` settings of the session, then by ``given``."""
        found = {}
        for f in fields(cls):
            text = spark.conf.get(f"crawlframe.{f.name}", None)
            if text is not None:
                kind = type(getattr(cls, f.name))
                found[f.name] = text.lower() == "true" if kind is bool else tuple(text.split(",")) if kind is tuple else int(text) if f.name == "max_segments" else kind(text)
        return replace(cls(**found), **given)
