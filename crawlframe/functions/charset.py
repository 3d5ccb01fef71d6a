"""Character encodings of pages: header, sniffed and default clues, aliases and decoding."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encodings that stand for a wider one they are often mistaken for.
WIDER = {"iso-8859-1": "windows-1252", "latin1": "windows-1252", "euc-kr": "x-windows-949", "x-euc-cn": "GB18030", "gb2312": "GB18030", "gbk": "GB18030"}
#: Names known without a change, by their lower case.
CANONICAL = {n.lower(): n for n in ("UTF-8", "UTF-16", "US-ASCII", "windows-1252", "windows-1251", "ISO-8859-2", "ISO-8859-15", "GB18030", "Big5", "Shift_JIS", "EUC-JP", "KOI8-R", "x-windows-949")}
_PYTHON = {"x-windows-949": "cp949"}


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def content_type_charset(header: Column | str) -> Column:
    """What follows ``charset=``, up to a semicolon, trimmed and without quotes; null if nothing does."""
    h = _c(header)
    rest = F.trim(F.regexp_extract(h, r"(?s)charset=([^;]*)", 1))
    bare = F.when((F.length(rest) > 2) & rest.startswith('"') & rest.endswith('"'), F.trim(F.substring(rest, F.lit(2), F.length(rest) - 2))).otherwise(rest)
    return F.when(F.contains(h, F.lit("charset=")), bare)


def sniff(html: Column | str) -> Column:
    """Charset that a content-type meta tag names; the whole page is looked at; null if none."""
    tag = F.regexp_extract(_c(html), r'(?i)<meta\s+([^>]*http-equiv="?content-type"?[^>]*)>', 1)
    return F.nullif(F.regexp_extract(tag, r"(?i)charset=\s*([a-z][_\-0-9a-z]*)", 1), F.lit(""))


def resolve_alias(name: Column | str) -> Column:
    """Canonical name, widened where the name is often used for a larger set; null if not known."""
    known = {**CANONICAL, **WIDER}
    return F.try_element_at(F.create_map(*[F.lit(x) for item in known.items() for x in item]), F.lower(_c(name)))


def detect(content: Column | str) -> Column:
    """struct(charset, confidence) that the bytes tell, confidence from 0 to 100; null where they tell nothing.

    A byte-order mark is sure. Bytes above ASCII that make up valid UTF-8 seldom do so by chance: each sequence of them halves the
    doubt. Plain ASCII fits nearly every encoding and is no clue.
    """
    b = _c(content)
    first = F.hex(F.substring(b, 1, 3))
    text = F.try_validate_utf8(b.cast("string"))
    high = F.regexp_count(text, F.lit(r"[^\x00-\x7F]+"))
    clue = lambda name, sure: F.struct(F.lit(name).alias("charset"), F.lit(sure).cast("double").alias("confidence") if isinstance(sure, int) else sure.alias("confidence"))
    return (
        F.when(first == "EFBBBF", clue("UTF-8", 100))
        .when(first.startswith("FFFE"), clue("UTF-16LE", 100))
        .when(first.startswith("FEFF"), clue("UTF-16BE", 100))
        .when(high > 0, clue("UTF-8", 100 - 100 * F.pow(F.lit(2.0), -high)))
    )


def guess(header: Column | str, html: Column | str, default: str = "utf-8", content: Column | str | None = None, min_confidence: int = -1) -> Column:
    """First clue that is known: of the bytes, of the header, then of the page; else the default. In lower case.

    The bytes are asked only with a ``min_confidence`` of 0 or more, and count only if they are as sure as that.
    """
    bytes_ = F.lit(None).cast("string")
    if content is not None and min_confidence >= 0:
        found = detect(content)
        bytes_ = F.when(found["confidence"] >= min_confidence, found["charset"])
    clue = F.coalesce(bytes_, resolve_alias(content_type_charset(header)), resolve_alias(sniff(html)), F.lit(default))
    return F.lower(clue)


def disagree(header: Column | str, html: Column | str) -> Column:
    """Whether the clues name different encodings."""
    clues = F.array_compact(F.array(F.lower(content_type_charset(header)), F.lower(sniff(html))))
    return F.size(F.array_distinct(clues)) > 1


def decode(content: Column | str, charset: Column | str) -> Column:
    """Text of bytes in a named encoding; bad bytes become replacement signs, unknown names count as UTF-8.

    UTF-8 is decoded in the JVM; only bytes of other encodings go to Python.
    """
    content, charset = _c(content), _c(charset)
    utf8 = F.coalesce(F.lower(charset).isin("utf-8", "utf8"), F.lit(True))

    def run(data: pd.Series, names: pd.Series) -> pd.Series:
        def one(b, n):
            if b is None:
                return None
            try:
                kind = codecs.lookup(_PYTHON.get(n, n or "utf-8")).name
            except LookupError:
                kind = "utf-8"
            return bytes(b).decode(kind, "replace")

        return pd.Series([one(b, n) for b, n in zip(data, names)])

    other = F.pandas_udf(run, "string")(F.when(~utf8, content), charset)
    return F.when(utf8, F.make_valid_utf8(content.cast("string"))).otherwise(other)
