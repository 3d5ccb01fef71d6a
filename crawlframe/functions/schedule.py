"""Refetch schedules: each step maps the columns of a state row to new columns.

A schedule is a class with the steps as methods; they return ``{column: expression}`` for ``withColumns``. Intervals
are seconds, times milliseconds, and interval arithmetic is in single precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe import schema as S
from crawlframe.config import DAY_MS, CrawlConfig
from crawlframe.functions.text import java_round

UNKNOWN, MODIFIED, NOTMODIFIED = 0, 1, 2


def _f(x) -> Column:
    return F.lit(x).cast("float")


def _ms(seconds: Column) -> Column:
    return seconds.cast("long") * 1000


class DefaultSchedule:
    """Every page comes again after its interval."""

    def __init__(self, config: CrawlConfig = CrawlConfig()):
        self.config = config

    def initialize(self) -> dict[str, Column]:
        return {"fetch_time": F.lit(self.config.now_ms).cast("long"), "fetch_interval": F.lit(self.config.interval_default).cast("int"), "retries": F.lit(0)}

    def fetched(self, modified: Column, state: Column, row: Callable[[str], Column] = F.col) -> dict[str, Column]:
        """After a fetch: ``modified`` is the page's time of change, ``state`` whether it changed; ``row`` gives a state column."""
        return {"retries": F.lit(0), "fetch_time": row("fetch_time") + _ms(row("fetch_interval")), "modified_time": modified, "fetch_interval": row("fetch_interval")}

    def gone(self) -> dict[str, Column]:
        """Half as long again; beyond the largest interval the page is due for a new start."""
        longer = java_round(F.col("fetch_interval").cast("float") * _f(1.5))
        next_ = F.col("fetch_time") + _ms(longer)
        over = longer > self.config.interval_max
        forced = self._restart(longer)
        return {"fetch_interval": F.when(over, forced["fetch_interval"]).otherwise(longer), "fetch_time": next_} | {k: F.when(over, forced[k]).otherwise(F.col(k)) for k in ("status", "retries", "modified_time")}

    def retry(self) -> dict[str, Column]:
        return {"fetch_time": F.col("fetch_time") + DAY_MS, "retries": F.col("retries") + 1}

    def last_fetch(self) -> Column:
        return F.col("fetch_time") - _ms(F.col("fetch_interval"))

    def should_fetch(self) -> dict[str, Column]:
        """Columns after the check, and ``due``. A time too far ahead is brought back to the present."""
        far = F.col("fetch_time") - self.config.now_ms > self.config.interval_max * 1000
        interval = F.col("fetch_interval")
        shorter = java_round(_f(self.config.interval_max) * _f(0.9))
        return {
            "fetch_interval": F.when(far & (interval > self.config.interval_max), shorter).otherwise(interval),
            "fetch_time": F.when(far, F.lit(self.config.now_ms)).otherwise(F.col("fetch_time")),
            "due": far | (F.col("fetch_time") <= self.config.now_ms),
        }

    def _restart(self, interval: Column) -> dict[str, Column]:
        capped = F.when(interval > self.config.interval_max, java_round(_f(self.config.interval_max) * _f(0.9))).otherwise(interval)
        return {"fetch_interval": capped, "status": F.lit(S.DB_UNFETCHED), "retries": F.lit(0), "modified_time": F.lit(0).cast("long")}

    def force(self, asap: bool = True) -> dict[str, Column]:
        """Forget what is known of a page; ``asap`` makes it due at once."""
        now = {"fetch_time": F.lit(self.config.now_ms).cast("long")} if asap else {}
        return self._restart(F.col("fetch_interval")) | {"signature": F.lit(None).cast("binary")} | now


class AdaptiveSchedule(DefaultSchedule):
    """Pages that change come again sooner, others later."""

    def fetched(self, modified: Column, state: Column, row: Callable[[str], Column] = F.col) -> dict[str, Column]:
        c = self.config
        fetch = row("fetch_time")
        changed = F.when(modified <= 0, fetch).otherwise(modified)
        interval = row("fetch_interval").cast("float")
        interval = F.when(state == MODIFIED, interval * (_f(1.0) - _f(c.dec_rate))).when(state == NOTMODIFIED, interval * (_f(1.0) + _f(c.inc_rate))).otherwise(interval)
        since = fetch
        if c.sync_delta:
            delta = F.floor((fetch - changed) / 1000)
            interval = F.when(delta.cast("float") > interval, delta.cast("float")).otherwise(interval)
            since = fetch - java_round_long(delta.cast("float") * _f(c.sync_delta_rate) * _f(1000.0))
        interval = F.least(F.greatest(interval, _f(c.min_interval)), _f(c.max_interval))
        return {"retries": F.lit(0), "modified_time": changed, "fetch_interval": java_round(interval), "fetch_time": since + java_round_long(interval * _f(1000.0))}


def java_round_long(x: Column) -> Column:
    """floor(x + 0.5) of a single-precision number, exactly."""
    return F.floor(x.cast("double") + 0.5).cast("long")


SCHEDULES = {"default": DefaultSchedule, "adaptive": AdaptiveSchedule}


def schedule(name: str, config: CrawlConfig = CrawlConfig()) -> DefaultSchedule:
    """The schedule of a name; more can be put into :data:`SCHEDULES`."""
    return SCHEDULES[name](config)


def simulate(rows: DataFrame, plan: DefaultSchedule, steps: int = 10_000, step_ms: int = DAY_MS, update_ms: int = 30 * DAY_MS) -> DataFrame:
    """``rows`` (with ``fetch_interval``) with a column ``run``: how a page fares that changes each ``update_ms``, from time 0 on.

    Each step looks whether the page is due. A fetch of an unchanged page is a miss, and so is each step that a changed one waits.
    ``run`` has fetches, changes, missed, most_missed, and the interval and time of the next fetch at the end.
    """
    long_ = lambda x: F.lit(x).cast("long")
    start = F.struct(
        F.lit(0).alias("fetches"), F.lit(0).alias("changes"), F.lit(0).alias("missed"), F.lit(0).alias("most_missed"), F.col("fetch_interval").cast("int").alias("fetch_interval"),
        long_(0).alias("fetch_time"), F.lit(0).alias("_miss"), F.lit(True).alias("_changed"), long_(0).alias("_last"),
    )

    def step(a: Column, i: Column) -> Column:
        now = i * step_ms
        updated = a["_last"] + update_ms < now
        changed, last = a["_changed"] | updated, F.when(updated, now).otherwise(a["_last"])
        due = a["fetch_time"] <= now
        missed = a["_miss"] + F.when(changed, 0).otherwise(1)
        after = plan.fetched(last, F.when(changed, MODIFIED).otherwise(NOTMODIFIED), lambda n: now if n == "fetch_time" else a[n])
        return F.struct(
            (a["fetches"] + due.cast("int")).alias("fetches"), (a["changes"] + updated.cast("int")).alias("changes"),
            F.when(due, a["missed"] + missed).otherwise(a["missed"]).alias("missed"), F.when(due, F.greatest(a["most_missed"], missed)).otherwise(a["most_missed"]).alias("most_missed"),
            F.when(due, after["fetch_interval"]).otherwise(a["fetch_interval"]).alias("fetch_interval"), F.when(due, after["fetch_time"]).otherwise(a["fetch_time"]).alias("fetch_time"),
            F.when(due, 0).otherwise(a["_miss"] + changed.cast("int")).alias("_miss"), (~due & changed).alias("_changed"), last.alias("_last"),
        )

    return rows.withColumn("run", F.aggregate(F.sequence(long_(0), long_(steps - 1)), start, step).dropFields("_miss", "_changed", "_last"))
