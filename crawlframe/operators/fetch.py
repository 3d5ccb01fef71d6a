"""Fetching: a pluggable fetcher runs in threads inside each task, and one table holds what it brought.

Rows of a fetch list stay together in a task (or, with ``by_host`` and for polite fetchers, rows of a host, so that waiting between requests
to a host is right across the cluster). The table is written before it is split, so no page is requested twice.
"""

from __future__ import annotations

import queue
import threading
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from email.utils import formatdate
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe import schema as S
from crawlframe.config import CrawlConfig
from crawlframe.functions.http import http_to_protocol, protocol_to_crawl
from crawlframe.functions.text import SIGNATURES, put_all
from crawlframe.functions.url import host
from crawlframe.sources import credentials


@dataclass
class Response:
    code: int | None  # None: an error was thrown
    body: bytes | None = None
    headers: dict[str, list[str]] = field(default_factory=dict)
    message: str | None = None


#: Gets the response for a url and the time of its last change in milliseconds. Must be picklable.
Fetcher = Callable[[str, int], Response]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


@dataclass
class HttpFetcher:
    """Plain HTTP and HTTPS with certificates checked; the body is cut at ``content_limit`` bytes."""

    agent: str = "crawlframe"
    timeout_s: float = 10.0
    content_limit: int = 2_097_152
    follow_redirects: bool = True
    headers: dict[str, str] = field(default_factory=dict)
    proxy: str | None = None

    def _request(self, url: str, modified_ms: int) -> urllib.request.Request:
        head = {"User-Agent": self.agent, "Accept-Encoding": "gzip, deflate", **self.headers}
        if modified_ms > 0:
            head["If-Modified-Since"] = formatdate(modified_ms / 1000, usegmt=True)
        return urllib.request.Request(url, headers=head)

    def _body(self, raw: bytes, encoding: str) -> bytes:
        bits = {"gzip": 31, "x-gzip": 31, "deflate": -15}.get(encoding)
        if bits is None:
            return raw[: self.content_limit]
        for way in (bits, 15):
            try:
                return zlib.decompressobj(way).decompress(raw, self.content_limit)
            except zlib.error:
                continue
        return raw[: self.content_limit]

    def __call__(self, url: str, modified_ms: int = 0) -> Response:
        handlers = [] if self.follow_redirects else [_NoRedirect()]
        if self.proxy:
            handlers.append(urllib.request.ProxyHandler({"http": self.proxy, "https": self.proxy}))
        opener = urllib.request.build_opener(*handlers)
        try:
            answer = opener.open(self._request(url, modified_ms), timeout=self.timeout_s)
        except urllib.error.HTTPError as e:
            answer = e
        headers: dict[str, list[str]] = {}
        for k, v in answer.headers.items():
            headers.setdefault(k, []).append(v)
        raw = answer.read(self.content_limit) if answer.status == 200 else b""
        return Response(answer.status, self._body(raw, (answer.headers.get("Content-Encoding") or "").lower()), headers)


@dataclass
class Authenticated:
    """Answers a Basic challenge (401) once, with the credentials of its scope; other challenges stay as they come.

    Certificates are checked as ever. Challenges of other schemes than Basic, NTLM among them, are not answered.
    """

    inner: HttpFetcher
    scopes: list[credentials.Scope] = field(default_factory=list)

    def __call__(self, url: str, modified_ms: int = 0) -> Response:
        first = self.inner(url, modified_ms)
        challenges = [v for k, vs in first.headers.items() if k.lower() == "www-authenticate" for v in vs] if first.code == 401 else []
        parts = urlsplit(url)
        port = parts.port or {"http": 80, "https": 443}.get(parts.scheme.lower())
        for scheme, realm in map(credentials.challenge, challenges):
            found = credentials.find(self.scopes, parts.hostname or "", port, realm, scheme)
            if scheme == "basic" and found is not None:
                return replace(self.inner, headers={**self.inner.headers, "Authorization": credentials.basic(found)})(url, modified_ms)
        return first


#: Bodies of so many bytes are handed on at once.
FLUSH_BYTES = 64 << 20
_HOSTS = threading.Lock()


@dataclass
class Polite:
    """Waits ``delay_s`` between requests to a host, ``max_waits`` times at most; the host is then blocked (503)."""

    inner: Fetcher
    delay_s: float = 1.0
    max_waits: int = 100
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self):
        self._next: dict[str, float] = {}

    def __call__(self, url: str, modified_ms: int = 0) -> Response:
        key = urlsplit(url).hostname or ""
        for _ in range(self.max_waits + 1):
            with _HOSTS:  # threads of a task share the times
                now = self.clock()
                free = self._next.get(key, 0.0)
                if free <= now:
                    self._next[key] = now + self.delay_s
            if free <= now:
                return self.inner(url, modified_ms)
            self.sleep(free - now)
        return Response(503, None, {}, "blocked")


@dataclass
class TableFetcher:
    """Pages from a small dictionary; unknown urls are 404. For tests and replays of single sites."""

    pages: dict[str, bytes]

    def __call__(self, url: str, modified_ms: int = 0) -> Response:
        body = self.pages.get(url)
        return Response(404) if body is None else Response(200, body, {"Content-Type": ["text/html; charset=utf-8"]})


#: Fetchers by scheme; more can be put in.
PROTOCOLS: dict[str, Callable[..., Fetcher]] = {"http": HttpFetcher, "https": HttpFetcher}


def protocol(url: str, protocols: dict[str, Callable[..., Fetcher]] | None = None) -> Callable[..., Fetcher]:
    """The fetcher for a url's scheme; ValueError if none is known."""
    known, scheme = PROTOCOLS if protocols is None else protocols, urlsplit(url).scheme.lower()
    if scheme not in known:
        raise ValueError(f"no protocol for {url!r}")
    return known[scheme]


@dataclass
class ByProtocol:
    """Hands each url to the fetcher of its scheme, made on first use; a url of an unknown scheme is an error of its row.

    ``protocols`` are those known where this is made, and go to the tasks with it.
    """

    settings: dict[str, dict] = field(default_factory=dict)
    protocols: dict[str, Callable[..., Fetcher]] = field(default_factory=lambda: dict(PROTOCOLS))

    def __post_init__(self):
        self._made: dict[str, Fetcher] = {}

    def __call__(self, url: str, modified_ms: int = 0) -> Response:
        scheme = urlsplit(url).scheme.lower()
        if scheme not in self._made:
            self._made[scheme] = protocol(url, self.protocols)(**self.settings.get(scheme, {}))
        return self._made[scheme](url, modified_ms)


_GOT = "code int, body binary, headers map<string,array<string>>, message string"


def _one(fetcher: Fetcher, url: str, modified: int) -> Response:
    try:
        return fetcher(url, modified)
    except Exception as e:  # a bad site must not end the task: the row becomes a retry
        return Response(None, None, {}, f"{type(e).__name__}: {e}")


def _threaded(jobs, fetcher: Fetcher, threads: int, limit: float):
    """(job, response) of each (job, url, modified), as they end; at most ``threads`` requests that still count run at a time.

    A request's time runs from its start. One that takes longer than ``limit`` seconds is given up: its thread can't be
    stopped, but holds no place any more, so rows after it go on.
    """
    done: queue.SimpleQueue = queue.SimpleQueue()
    started: dict[int, tuple[object, float]] = {}
    waiting, number = iter(jobs), 0
    while True:
        while len(started) < threads and (job := next(waiting, None)) is not None:
            key, url, modified = job
            number += 1
            started[number] = (key, time.monotonic() + limit)
            threading.Thread(target=lambda n=number, u=url, m=modified: done.put((n, _one(fetcher, u, m))), daemon=True).start()
        if not started:
            return
        try:
            n, response = done.get(timeout=max(0.0, min(t for _, t in started.values()) - time.monotonic()))
            if n in started:  # else it was given up
                yield started.pop(n)[0], response
        except queue.Empty:
            now = time.monotonic()
            for n in [n for n, (_, t) in started.items() if t <= now]:
                yield started.pop(n)[0], Response(None, None, {}, "timeout")


def fetch(rows: DataFrame, fetcher: Fetcher, config: CrawlConfig = CrawlConfig(), by_host: bool | None = None) -> DataFrame:
    """``rows`` with code, body, headers and message of each url's response.

    A request that takes longer than ``fetch_timeout_s`` counts as an error. Rows of a host go to one task with ``by_host``, which is so
    where none is given and the fetcher is polite; else a fetch list is a task. Bodies are handed on once they
    reach ``FLUSH_BYTES``. Write the result before it is used twice. Speculative copies of tasks would request pages twice, so a session that runs them is refused.
    """
    threads, limit = config.fetch_threads, config.fetch_timeout_s
    if rows.sparkSession.sparkContext.getConf().get("spark.speculation", "false").lower() == "true":
        raise ValueError("set spark.speculation to false: a copy of a task would request its pages again")

    def run(batches):
        import pyarrow as pa

        kinds = [("code", pa.int32()), ("body", pa.binary()), ("headers", pa.map_(pa.string(), pa.list_(pa.string()))), ("message", pa.string())]

        def table(batch, got):
            part = pa.Table.from_batches([batch]).drop_columns(["_modified"]).take([k for k, _ in got])
            answers = [r for _, r in got]
            values = [[r.code for r in answers], [r.body for r in answers], [list(r.headers.items()) for r in answers], [r.message for r in answers]]
            for (name, kind), value in zip(kinds, values):
                part = part.append_column(name, pa.array(value, kind))
            return part.combine_chunks().to_batches()

        for batch in batches:
            jobs = zip(range(batch.num_rows), batch["url"].to_pylist(), (m or 0 for m in batch["_modified"].to_pylist()))
            got, size = [], 0
            for k, response in _threaded(jobs, fetcher, threads, limit):
                got.append((k, response))
                size += len(response.body or b"")
                if size >= FLUSH_BYTES:
                    yield from table(batch, got)
                    got, size = [], 0
            if got:
                yield from table(batch, got)

    together = isinstance(fetcher, Polite) if by_host is None else by_host
    keys = [host("url")] if together or "fetch_list" not in rows.columns else ["segment_no", "fetch_list"]
    modified = F.col("modified_time") if "modified_time" in rows.columns else F.lit(0)
    dealt = rows.repartition(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.withColumn("_modified", modified.cast("long")).mapInArrow(run, f"{kinds}, {_GOT}")


def fetch_from(rows: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """The same columns as :func:`fetch`, from a table (key, content) of pages instead of the network; unknown keys are 404.

    The key is the url, or a column of both tables that tells pages of a url apart. Of several pages of a key the one with the
    smallest content counts; a page without content is found, and has a null body.
    """
    known = pages.groupBy(key).agg(F.min(F.col("content").cast("binary")).alias("body")).withColumn("_hit", F.lit(True))
    headers = F.create_map(F.lit("Content-Type"), F.array(F.lit("text/html; charset=utf-8")))
    found = rows.join(known, key, "left")
    hit = F.col("_hit").isNotNull()
    none = F.expr("cast(map() as map<string,array<string>>)")
    return found.select(*rows.columns, F.when(hit, 200).otherwise(404).alias("code"), "body", F.when(hit, headers).otherwise(none).alias("headers"), F.lit(None).cast("string").alias("message"))


def status_rows(fetched: DataFrame, config: CrawlConfig = CrawlConfig()) -> DataFrame:
    """State rows of a fetch: new status, time of the fetch, and the signature of the content."""
    extra = ("code", "body", "headers", "message", "segment_no", "fetch_list")
    status = protocol_to_crawl(http_to_protocol(F.col("code")), config.compat).cast("int")
    got = fetched.withColumn("status", status).withColumn("fetch_time", F.lit(config.now_ms).cast("long"))
    if config.compat == "intended":
        got = got.withColumn("signature", F.when(F.col("status") == S.FETCH_SUCCESS, SIGNATURES[config.signature]("body")))
    return got.drop(*extra)


def contents(fetched: DataFrame, segment: str | Column, config: CrawlConfig = CrawlConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Content rows of the pages that came, with the segment, the fetch status and the processing directives; columns that ``keep`` names come along."""
    got = fetched.filter(http_to_protocol(F.col("code")) == 1)
    marks = F.create_map(F.lit(S.SEGMENT_KEY), F.array(F.lit(segment)), F.lit(S.FETCH_STATUS_KEY), F.array(F.lit(str(S.FETCH_SUCCESS))))
    meta = F.map_zip_with(F.coalesce("headers", F.expr("cast(map() as map<string,array<string>>)")), marks, lambda k, a, b: F.coalesce(b, a))
    extend = put_all(F.expr("cast(map() as map<string,string>)"), F.col("extend")) if "extend" in fetched.columns else F.expr("cast(map() as map<string,string>)")
    return got.select("url", F.col("body").alias("content"), extend.alias("extend"), meta.alias("meta_data"), *keep)


def counters(fetched: DataFrame) -> DataFrame:
    """(pages, bytes, errors) of a fetch."""
    ok = http_to_protocol(F.col("code")) == 1
    return fetched.agg(
        F.count_if(ok).alias("pages"),
        F.coalesce(F.sum(F.when(ok, F.octet_length("body"))), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(~ok).alias("errors"),
    )
