"""URL functions as column expressions; they stay in the JVM and never fail on bad input."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe.functions.text import trie_pattern

_SCHEMES = r"(?i)^(https?|ftp|file|jar):"
_IP = r"^\d{1,3}(\.\d{1,3}){3}$"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _part(url: Column, group: int) -> Column:
    """1 scheme, 2 user-info with @, 3 host, 4 port, 5 path and query, 6 reference with #."""
    return F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::(\d*))?([^#]*)(#.*)?$", group)


def _well_formed(url: Column) -> Column:
    return url.rlike(r"(?is)^(https?|ftp|file)://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(:\d*)?([/?#].*)?$")


def clean_path(path: Column | str) -> Column:
    """Take out ``/segment/../``, leading ``/../`` and doubled slashes, one of each a round, until nothing changes.

    A segment goes only if it has a sign other than a dot. Each round that changes a path shortens its slashes, so the number of slashes bounds the rounds.
    """
    def once(p: Column, pattern: str) -> Column:
        return F.regexp_replace(p, rf"(?s)^(.*?){pattern}", "$1/")

    def step(p: Column, _: Column) -> Column:
        p = once(p, r"/[^/]*[^/.][^/]*/\.\./")
        p = F.regexp_replace(p, r"^(/\.\./)+", "/")
        return once(p, r"/{2,}")

    path = _c(path)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    rounds = F.sequence(F.lit(0), slashes)
    return F.when(path.rlike(r"//|/\.\./"), F.aggregate(rounds, path, step)).otherwise(path)


#: Urls that are their own canonical form, as one look tells; most of a state table's are.
_CANONICAL = r"(?s)^(?:(?:http|ftp)://[a-z0-9._\-]+(?=/)(?!.*?(?://|/\.\./))[^#]*|(?:https|file)://[a-z0-9._\-]+(?:[/?#].*)?)(?<![\x00-\x20])\z"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rebuild(url: Column) -> Column:
    def build(u: Column, p: Column, file: Column) -> Column:
        scheme, plain = F.lower(p["scheme"]), F.lower(p["scheme"]).isin("http", "ftp")
        default = F.when(scheme == "http", 80).when(scheme == "ftp", 21)
        host = F.when(plain, F.lower(p["host"])).otherwise(p["host"])
        port = F.when((p["port"] == "") | (plain & (p["port"].try_cast("int") == default)), "").otherwise(F.concat(F.lit(":"), p["port"]))
        changed = (p["scheme"] != scheme) | (plain & ((p["host"] != host) | ((p["port"] != "") & (port == "")) | (p["file"] != file) | (p["ref"] != "")))
        return F.when(changed, F.concat(scheme, F.lit("://"), host, port, file, F.when(plain, F.lit("")).otherwise(p["ref"]))).otherwise(u)

    def files(u: Column, p: Column) -> Column:
        plain = F.lower(p["scheme"]).isin("http", "ftp")
        return _let(F.when(plain, clean_path(F.when(p["file"] == "", "/").otherwise(p["file"]))).otherwise(p["file"]), lambda file: build(u, p, file))

    def parts(u: Column) -> Column:
        found = F.struct(*[_part(u, k).alias(n) for n, k in (("scheme", 1), ("host", 3), ("port", 4), ("file", 5), ("ref", 6))])
        return F.when(_well_formed(u), _let(found, lambda p: files(u, p)))

    return _let(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), parts)


def normalize(url: Column | str) -> Column:
    """Canonical form; null where the url is malformed.

    http and ftp: lower-case host, no default port, no reference, "/" for an empty file, clean path and query.
    Others stay as they are, trimmed, but for an upper-case scheme. An empty string stays empty.
    """
    u = _c(url)
    return F.when((u == "") | u.rlike(_CANONICAL), u).otherwise(_rebuild(u))


#: Canonical forms by name; more can be put in.
NORMALIZERS = {"basic": normalize}


def host(url: Column | str) -> Column:
    """Host in lower case; null on a malformed url."""
    return F.when(_well_formed(_c(url)), F.lower(_part(_c(url), 3)))


def page(url: Column | str) -> Column:
    """The url in lower case without its query; null on a malformed url."""
    u = _c(url)
    query = F.regexp_extract(u, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(_well_formed(u), F.when(query == "", F.lower(u)).otherwise(F.replace(F.lower(u), F.lower(query), F.lit(""))))


def host_segments(url: Column | str) -> Column:
    """Labels of the host; an IP address is one label."""
    h = host(url)
    return F.when(h.rlike(_IP), F.array(h)).otherwise(F.split(h, r"\."))


def _turned_suffixes(suffixes: Iterable[str]) -> str:
    """Pattern of the longest known suffix at the begin of a host that is read backwards."""
    return f"^(?:{trie_pattern([s[::-1] for s in suffixes], True)})"


def domain_suffix(url: Column | str, suffixes: Iterable[str]) -> Column:
    """The longest known suffix of the host; null for IP addresses or where none is known.

    The suffixes are one pattern in the shape of their tree, so their number hardly counts. For their records see
    :func:`crawlframe.sources.suffixes.with_suffix`.
    """
    h, known = F.rtrim(host(url), F.lit(".")), [s for s in suffixes if s]
    if not known:
        return F.lit(None).cast("string")
    found = F.regexp_extract(F.reverse(h), rf"{_turned_suffixes(known)}(?=\.|\z)", 0)
    return F.when(~h.rlike(_IP) & (found != ""), F.reverse(found))


def domain_name(url: Column | str, suffixes: Iterable[str]) -> Column:
    """Known suffix with the label before it; the last label where no suffix is known; an IP address as it is."""
    h, known = F.rtrim(host(url), F.lit(".")), [s for s in suffixes if s]
    last = F.substring_index(h, ".", -1)
    if known:
        found = F.regexp_extract(F.reverse(h), rf"{_turned_suffixes(known)}\.[^.]*(?=\.|\z)", 0)
        last = F.when(found != "", F.reverse(found)).otherwise(last)
    return F.when(h.rlike(_IP), h).otherwise(last)


def same_domain(a: Column | str, b: Column | str, suffixes: Iterable[str]) -> Column:
    return F.lower(domain_name(a, suffixes)) == F.lower(domain_name(b, suffixes))


def choose_repr(src: Column | str, dst: Column | str, temporary: Column, suffixes: Iterable[str]) -> Column:
    """The url that stands for a redirect from ``src`` to ``dst``."""
    a, b = _c(src), _c(dst)
    fa, fb = _part(a, 5), _part(b, 5)
    root_a, root_b = fa.isin("", "/"), fb.isin("", "/")
    parts = lambda f: F.size(F.split(f, "/"))
    same_host = host(a) == host(b)
    shorter = F.when(parts(fb) < parts(fa), b).when((parts(fb) == parts(fa)) & (F.length(fb) < F.length(fa)), b).otherwise(a)
    fewer = F.when(F.size(host_segments(b)) < F.size(host_segments(a)), b).otherwise(a)
    temp = F.when(root_a & ~root_b, a).when(~root_a & root_b, b).when(~root_a & ~root_b & same_host, shorter).otherwise(fewer)
    return (
        F.when(~_well_formed(a) | ~_well_formed(b), b)
        .when(~same_domain(a, b, suffixes), b)
        .when(~temporary, F.when(root_a, a).otherwise(b))
        .otherwise(temp)
    )


def remove_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments; what goes above the root stays at the root."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    empty = F.array().cast("array<string>")
    fold = F.aggregate(parts, empty, lambda kept, p: F.when(p == ".", kept).when((p == "..") & (F.size(kept) > 0), F.slice(kept, F.lit(1), F.size(kept) - 1)).when(p == "..", kept).otherwise(F.concat(kept, F.array(p))))
    folder = F.element_at(parts, -1).isin(".", "..")
    inner = F.array_join(fold, "/")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), inner, F.when(folder & (inner != ""), "/").otherwise(""))).otherwise(path)


def resolve(base: Column | str, href: Column | str) -> Column:
    """``href`` against ``base``: absolute, scheme-relative, root-relative, query, and relative to the folder of the base."""
    b, h = _c(base), F.trim(_c(href))
    file, rest = F.regexp_extract(h, r"(?s)^([^?#]*)", 1), F.regexp_extract(h, r"(?s)^[^?#]*(.*)", 1)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    path = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("/"), F.concat(origin, remove_dots(file), rest))
        .when(h == "", b)
        .when(h.startswith("#"), F.concat(F.regexp_replace(b, r"(?s)#.*$", ""), h))
        .when(h.startswith("?"), F.concat(origin, path, h))
        .otherwise(F.concat(origin, remove_dots(F.concat(folder, file)), rest))
    )
