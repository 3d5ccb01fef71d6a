"""String, binary, map and date functions."""

from __future__ import annotations

import gzip
import html.entities
import os
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.schema import HEADER_NAMES


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def right_pad(s: Column | str, n: Column | int) -> Column:
    """Spaces up to length ``n``; longer strings stay whole."""
    s, n = _c(s), F.lit(n) if isinstance(n, int) else n
    return F.rpad(s, F.greatest(n, F.length(s)), F.lit(" "))


def left_pad(s: Column | str, n: Column | int) -> Column:
    s, n = _c(s), F.lit(n) if isinstance(n, int) else n
    return F.lpad(s, F.greatest(n, F.length(s)), F.lit(" "))


def to_hex(data: Column | str) -> Column:
    return F.lower(F.hex(_c(data)))


def to_hex_lines(data: Column | str, separator: str, line: int) -> Column:
    """Hex with a separator after each byte of a line, up to its last, and a line end before each new line."""
    digits = F.regexp_extract_all(to_hex(data), F.lit("(..)"), 1)
    sep = lambda i: F.when((i > 0) & (i % line == 0), F.lit("\n")).otherwise(F.lit(""))
    return F.array_join(F.transform(digits, lambda d, i: F.concat(sep(i), d, F.when(i < line - 1, F.lit(separator)).otherwise(F.lit("")))), "")


def from_hex(text: Column | str) -> Column:
    """Bytes of a hex string, trimmed, odd lengths after a 0; null on a bad digit."""
    t = F.trim(_c(text))
    even = F.when(F.length(t) % 2 == 1, F.concat(F.lit("0"), t)).otherwise(t)
    return F.when(even.rlike("^[0-9A-Fa-f]*$"), F.unhex(even))


def is_empty(s: Column | str) -> Column:
    return F.coalesce(_c(s), F.lit("")) == ""


def signature(content: Column | str) -> Column:
    """Page signature: the 16 bytes of the MD5."""
    return F.unhex(F.md5(_c(content)))


#: Page signatures by name; more can be put in.
SIGNATURES = {"md5": signature}


def signature_order(data: Column | str) -> Column:
    """Sort key: null first, shorter first, then by signed bytes. Flipping the top bit of each byte makes signed order unsigned."""
    d = _c(data)
    flipped = F.unhex(F.array_join(F.transform(F.regexp_extract_all(F.hex(d), F.lit("(..)"), 1), lambda b: F.lpad(F.hex(F.conv(b, 16, 10).cast("int").bitwiseXOR(128)), 2, "0")), ""))
    return F.struct(F.coalesce(F.octet_length(d), F.lit(-1)), flipped)


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z\u0080-\U0010ffff])", r"\\\1", text)


def trie_pattern(patterns: list[str], longest: bool) -> str:
    """Regular expression of the prefix tree of patterns: each place has one way on, so a match costs one walk down the tree."""
    ways: dict[str, list[str]] = {}
    for p in sorted(set(patterns)):
        ways.setdefault(p[0], []).append(p)
    out = []
    for group in ways.values():
        head = os.path.commonprefix(group)
        rest = [p[len(head) :] for p in group if p != head]
        tail = f"(?:{trie_pattern(rest, longest)})" if rest and (longest or len(rest) == len(group)) else ""
        out.append(_quoted(head) + tail + ("?" if tail and len(rest) < len(group) else ""))
    return "|".join(out)


def _match(s: Column, patterns: list[str], longest: bool) -> Column:
    known = [p for p in patterns if p]
    return F.nullif(F.regexp_extract(s, f"^(?:{trie_pattern(known, longest)})", 0), F.lit("")) if known else F.lit(None).cast("string")


def _turned(patterns: list[str]) -> list[str]:
    return [p[::-1] for p in patterns]


def prefix_shortest(s: Column | str, patterns: list[str]) -> Column:
    """The shortest pattern that the string begins with; null if none does."""
    return _match(_c(s), patterns, False)


def prefix_longest(s: Column | str, patterns: list[str]) -> Column:
    return _match(_c(s), patterns, True)


def prefix_matches(s: Column | str, patterns: list[str]) -> Column:
    return prefix_shortest(s, patterns).isNotNull()


def suffix_shortest(s: Column | str, patterns: list[str]) -> Column:
    """The shortest pattern that the string ends with: a prefix of the string read backwards."""
    return F.reverse(_match(F.reverse(_c(s)), _turned(patterns), False))


def suffix_longest(s: Column | str, patterns: list[str]) -> Column:
    return F.reverse(_match(F.reverse(_c(s)), _turned(patterns), True))


def suffix_matches(s: Column | str, patterns: list[str]) -> Column:
    return suffix_shortest(s, patterns).isNotNull()


def header_name(name: Column | str) -> Column:
    """Canonical header name: exact letters, else the nearest within a third of the length, else the name itself.

    Ties go to the smaller distance, then to the name.
    """
    n = _c(name)
    letters = F.lower(F.regexp_replace(n, r"[^\p{L}]", ""))
    limit = F.floor(F.length(letters) / 3)
    scored = F.array(*[F.struct(F.levenshtein(letters, F.lit(re.sub("[^a-z]", "", h.lower()))).alias("d"), F.lit(h).alias("h")) for h in HEADER_NAMES])
    best = F.array_min(scored)
    return F.when((best["d"] == 0) | (best["d"] < limit), best["h"]).otherwise(n)


def put_all(left: Column | str, right: Column | str) -> Column:
    """Union of two maps; the right one wins. A null map counts as empty."""
    empty = F.expr("cast(map() as map<string,string>)")
    return F.map_zip_with(F.coalesce(_c(left), empty), F.coalesce(_c(right), empty), lambda k, a, b: F.coalesce(b, a))


def multi_add(m: Column | str, name: Column, value: Column) -> Column:
    """Add a value under the canonical name, unless it is there."""
    key = header_name(name)
    return F.map_zip_with(_c(m), F.create_map(key, F.array(value)), lambda k, a, b: F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def multi_append(m: Column | str, name: Column, values: Column) -> Column:
    """Append values under a name as it is given, repeated ones too."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(_c(m), F.create_map(name, values), lambda k, a, b: F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def multi_get(m: Column | str, name: Column) -> Column:
    """First value under the canonical name, or null."""
    return F.get(F.element_at(_c(m), header_name(name)), F.lit(0))


def multi_set(m: Column | str, name: Column, value: Column) -> Column:
    return F.map_zip_with(_c(m), F.create_map(header_name(name), F.array(value)), lambda k, a, b: F.coalesce(b, a))


def multi_remove(m: Column | str, name: Column) -> Column:
    return F.map_filter(_c(m), lambda k, v: k != header_name(name))


def map_text(m: Column | str) -> Column:
    """A map as sorted ``k=v`` pairs, for comparison and display."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(_c(m))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def http_date(ms: Column | str) -> Column:
    """Milliseconds as an HTTP date in GMT; the session's time zone must be UTC."""
    return F.concat(F.date_format(F.timestamp_millis(_c(ms)), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def if_modified_since(modified_ms: Column | str) -> Column:
    """Header of a conditional request; null where the time of the last change is not known."""
    m = _c(modified_ms)
    return F.when(m > 0, F.concat(F.lit("If-Modified-Since: "), http_date(m)))


def http_date_ms(text: Column | str) -> Column:
    """Milliseconds of an HTTP date; null where it is none."""
    return F.unix_millis(F.try_to_timestamp(F.substring(_c(text), 6, 20), F.lit("dd MMM yyyy HH:mm:ss")))


def java_round(x: Column) -> Column:
    """floor(x + 0.5) in single precision."""
    return F.floor(x.cast("float") + F.lit(0.5).cast("float")).cast("int")


def basic_auth(user: Column | str, password: Column | str) -> Column:
    return F.concat(F.lit("Authorization: Basic "), F.base64(F.concat_ws(":", _c(user), _c(password)).cast("binary")))


def agent_string(name: str, version: str | None = None, desc: str | None = None, url: str | None = None, email: str | None = None) -> str:
    """``name/version (desc; url; email)``; parts that are missing leave no separator behind."""
    inner = "; ".join(x for x in (desc, url, email) if x)
    return name + (f"/{version}" if version is not None else "") + (f" ({inner})" if inner else "")


def is_xml_space(s: Column | str) -> Column:
    return _c(s).rlike(r"^[ \t\r\n]*$")


def record_json(*columns: Column | str) -> Column:
    """A record as JSON, with proper escapes."""
    return F.to_json(F.struct(*columns))


def _codec(function):
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else function(bytes(b)))

    return F.pandas_udf(run, "binary")


def _inflate(wbits: int, limit: int | None):
    def run(data: bytes):
        try:
            machine = zlib.decompressobj(wbits)
            return machine.decompress(data, limit or 0)
        except zlib.error:
            return None

    return run


def gzip_pack(data: Column | str) -> Column:
    return _codec(lambda b: gzip.compress(b, mtime=0))(_c(data))


def gunzip(data: Column | str, limit: int | None = None) -> Column:
    """What can be read of a gzip stream, up to ``limit`` bytes; null where it is none."""
    return _codec(_inflate(31, limit))(_c(data))


def deflate(data: Column | str) -> Column:
    return _codec(zlib.compress)(_c(data))


def inflate(data: Column | str, limit: int | None = None) -> Column:
    return _codec(_inflate(15, limit))(_c(data))


def inflate_raw(data: Column | str, limit: int | None = None) -> Column:
    return _codec(_inflate(-15, limit))(_c(data))


_NAMED = {chr(c): f"&{n};" for c, n in html.entities.codepoint2name.items() if c < 0x100}


def decode_entity(m: re.Match) -> str:
    body = m.group(1)
    try:
        if body.startswith("#"):
            return chr(int(body[2:], 16) if body[1:2] in "xX" else int(body[1:]))
        return chr(html.entities.name2codepoint[body])
    except (KeyError, ValueError, OverflowError):
        return ""


def entities_decode(text: Column | str) -> Column:
    """Named and numbered HTML entities as signs; unknown ones vanish. Only texts with an ampersand go to Python."""
    t = _c(text)
    some = F.contains(t, F.lit("&"))
    return F.when(some, _by_rows(lambda t: re.sub(r"&(#?[0-9A-Za-z]+);", decode_entity, t))(F.when(some, t))).otherwise(t)


def entities_encode(text: Column | str) -> Column:
    """Signs below 256 by name where they have one, ASCII as it is, others by number. Only texts with such signs go to Python."""
    s = _c(text)
    some = s.rlike(r"[^\x00-\x7F]|[&<>\"]")
    sign = lambda m: _NAMED.get(m[0]) or f"&#{ord(m[0])};"
    return F.when(some, _by_rows(lambda t: re.sub(r"[^\x00-\x7F]|[&<>\"]", sign, t))(F.when(some, s))).otherwise(s)


def _by_rows(function):
    """A function of single strings as a UDF; null stays null.

    Rows go to Python in batches of a hundred. Arrow's are of ten thousand, which are long texts held several times over in each worker.
    """
    return F.udf(lambda t: None if t is None else function(t), "string", useArrow=False)
