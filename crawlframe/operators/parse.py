"""Parsing of contents: parsers chosen by row, typed records, and links as state rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe import schema as S
from crawlframe.functions.charset import decode, guess
from crawlframe.functions.html import links, tree

LINK, APP, ERROR = "outlink", "app_info", "error"
#: What a parser may yield: ("outlink", {"url", "anchor"[, "fetch_interval"]}) or ("app_info", four strings by name).
Parser = Callable[[str, str], Iterable[tuple[str, dict]]]


def page_links(url: str, html: str):
    """Links of a page, unless it says nofollow."""
    for target, anchor in links(tree(html), url):
        yield LINK, {"url": target, "anchor": anchor}


def article(url: str, html: str):
    """Title, heading and first paragraph of a page, and its links."""
    root = tree(html)
    texts: dict[str, str] = {}
    for node in root.walk():
        if node.tag in ("title", "h1", "p"):
            texts.setdefault(node.tag, " ".join(node.text().split()))
    yield APP, {"categories": texts.get("title", ""), "app_name": texts.get("h1", ""), "clear": "", "introduction": texts.get("p", "")}
    for target, anchor in links(root, url):
        yield LINK, {"url": target, "anchor": anchor}


PARSERS: dict[str, Parser] = {"links": page_links, "article": article}

_RECORD = "url string, kind string, link_url string, anchor string, fetch_interval int, categories string, app_name string, clear string, introduction string, extend map<string,string>, message string"
_FIELDS = [f.split()[0] for f in _RECORD.split(", ")]
#: Records of so many pages are handed on at once.
_PAGES = 500


def decoded(content: DataFrame, default: str = "utf-8") -> DataFrame:
    """``content`` with a column ``html``: bytes decoded by header, meta tag or default.

    The meta tag is looked for in the bytes as Latin-1, which never fails.
    """
    rough = F.decode("content", "ISO-8859-1")
    header = F.get(F.try_element_at("meta_data", F.lit("Content-Type")), F.lit(0))
    return content.withColumn("html", decode(F.col("content"), guess(header, rough, default)))


def parse(content: DataFrame, parsers: dict[str, Parser] | None = None, default_charset: str = "utf-8", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed records of each page, by the parser that ``extend['parse_class']`` names.

    A page without a known parser, or whose parser fails, gives one record of kind "error"; the others go on.
    Links inherit the page's ``extend``. Pages are decoded and parsed once. String columns that ``keep`` names come along.
    """
    known = dict(PARSERS if parsers is None else parsers)

    def run(batches):
        import pyarrow as pa

        text = ("url", "kind", "link_url", "anchor", "categories", "app_name", "clear", "introduction", "message", *keep)
        kinds = {"fetch_interval": pa.int32(), "extend": pa.map_(pa.string(), pa.string())} | dict.fromkeys(text, pa.string())
        schema = pa.schema([(f, kinds[f]) for f in (*_FIELDS, *keep)])
        for batch in (b.slice(k, _PAGES) for b in batches for k in range(0, b.num_rows, _PAGES)):
            out = []
            for url, html, extend, *kept in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "extend", *keep))):
                name = dict(extend or ()).get(S.PARSE_KEY)
                base = {"url": url, "extend": extend or [], **dict(zip(keep, kept))}
                if name not in known:
                    out.append(base | {"kind": ERROR, "message": f"no parser named {name}"})
                    continue
                try:
                    for kind, record in known[name](url or "", html or ""):
                        record = dict(record)
                        if kind == LINK:
                            record["link_url"] = record.pop("url")
                        out.append(base | {"kind": kind} | record)
                except Exception as e:
                    out.append(base | {"kind": ERROR, "message": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = decoded(content, default_charset).select("url", "html", "extend", *keep)
    return rows.mapInArrow(run, ", ".join([_RECORD, *(f"`{c}` string" for c in keep)]))


def outlinks(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page, url, anchor, fetch_interval, extend) of link records."""
    return records.filter(F.col("kind") == LINK).select(F.col("url").alias("page"), F.col("link_url").alias("url"), "anchor", "fetch_interval", "extend", *keep)


def linked_rows(links_: DataFrame, seq: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """State rows (status linked) keyed by the link's target.

    ``seq`` names the column that breaks ties; without it a hash of page and target does.
    """
    order = F.col(seq) if seq else F.xxhash64("page", "url", "anchor")
    return links_.select(
        "url",
        F.lit(S.LINKED).alias("status"),
        F.lit(0).cast("long").alias("fetch_time"),
        F.lit(0).cast("long").alias("modified_time"),
        F.coalesce("fetch_interval", F.lit(0)).cast("int").alias("fetch_interval"),
        F.lit(0).alias("retries"),
        F.lit(0.0).cast("float").alias("score"),
        F.lit(None).cast("binary").alias("signature"),
        "extend",
        F.expr("cast(map() as map<string,string>)").alias("meta_data"),
        order.cast("long").alias("seq"),
        *keep,
    )


def app_info(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return records.filter(F.col("kind") == APP).select("url", "categories", "app_name", "clear", "introduction", *keep)


def errors(records: DataFrame) -> DataFrame:
    return records.filter(F.col("kind") == ERROR).select("url", "message")


def content_text(content: DataFrame) -> DataFrame:
    """(url, text): bytes as UTF-8, bad ones as replacement signs, on one line."""
    text = F.expr("decode(content, 'UTF-8')") if content.schema["content"].dataType.typeName() == "binary" else F.col("content")
    return content.select("url", F.replace(text, F.lit("\n"), F.lit(" ")).alias("text"))
