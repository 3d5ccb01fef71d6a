"""HTML functions: a tolerant tree, meta tags, links, text and the structured extraction of list pages.

Real tag soup goes through one Arrow-batched parse; what regular expressions can do exactly stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LINKS = {"a": "href", "area": "href", "frame": "src", "iframe": "src"}
URL_PATTERN = r"(?i)[a-z][a-z0-9+.\-]{1,120}:[a-z0-9/](?:[a-z0-9$_.+!*,;/?:@&~=\-]|%[a-f0-9]{2}){1,333}(?:#[a-z0-9][a-z0-9$_.+!*,;/?:@&~=%\-]{0,1000})?"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings

    def walk(self, skip=lambda node: False):
        """Nodes in document order, without recursion; children of skipped nodes are left out."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if not skip(node):
                stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


#: Signs that stand for "&" and ">" while a page is read or written; a page that holds one of them gets others.
_PRIVATE = (*range(0xE000, 0xF900), *range(0xF0000, 0x10FFFE))


def _unused(html: str, n: int) -> list[str]:
    return list(islice((c for c in map(chr, _PRIVATE) if c not in html), n))


class _Spelled(_Tree):
    """A tree whose texts are made by a function of what the page says, references as they are spelled; in scripts and styles texts stay."""

    def __init__(self, amp: str, text: Callable[[str], str]):
        super().__init__()
        self.amp, self.text = amp, text

    def _node(self, tag, attrs):
        plain = lambda x: unescape(x.replace(self.amp, "&"))
        return tag.replace(self.amp, "&"), [(k.replace(self.amp, "&"), plain(v or "")) for k, v in attrs]

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(*self._node(tag, attrs))

    def handle_startendtag(self, tag, attrs):
        super().handle_startendtag(*self._node(tag, attrs))

    def handle_endtag(self, tag):
        super().handle_endtag(tag.replace(self.amp, "&"))

    def handle_data(self, data):
        data = data.replace(self.amp, "&")
        super().handle_data(data if self.cdata_elem else self.text(data))


def _spelled(html: str | None, text: Callable[[str], str]) -> Node:
    """Tree of a page by :class:`_Spelled`: the parser sees no references, so it doesn't decode them."""
    html = html or ""
    parser = _Spelled(_unused(html, 1)[0], text)
    parser.feed(html.replace("&", parser.amp))
    parser.close()
    return parser.root


def tree(html: str | None, drop: tuple[str, ...] = ()) -> Node:
    """Tree of a page or of a fragment, whatever its number of roots; elements named in ``drop`` are taken out with all they hold."""
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    if drop:
        for node in parser.root.walk():
            node.children = [c for c in node.children if not (isinstance(c, Node) and c.tag in drop)]
    return parser.root


def meta_tags(root: Node, url: str) -> dict:
    """Robots directives, pragma, refresh and base of the nodes outside the body."""
    out = {"no_index": False, "no_follow": False, "no_cache": False, "base_href": None, "refresh": False, "refresh_time": 0, "refresh_href": None, "general": {}, "http_equiv": {}}
    for node in root.walk(skip=lambda n: n.tag == "body"):
        if node.tag == "base" and "href" in node.attrs:
            out["base_href"] = urljoin(url, node.attrs["href"].strip())
        if node.tag != "meta" or "content" not in node.attrs:
            continue
        content = node.attrs["content"]
        if "name" in node.attrs:
            name = node.attrs["name"].lower()
            out["general"][name] = content
            if name == "robots":
                said = content.lower()
                out["no_index"] |= "none" in said or "noindex" in said
                out["no_follow"] |= "none" in said or "nofollow" in said
                out["no_cache"] |= "noarchive" in said
        if "http-equiv" in node.attrs:
            name = node.attrs["http-equiv"].lower()
            out["http_equiv"][name] = content
            if name == "pragma":
                out["no_cache"] |= "no-cache" in content.lower()
            elif name == "refresh":
                _refresh(out, content, url)
    return out


def _refresh(out: dict, content: str, url: str) -> None:
    time, _, rest = content.partition(";")
    if re.fullmatch(r"[+-]?\d+", time):
        out["refresh_time"], out["refresh"] = int(time), True
    if out["refresh"]:
        target = None
        if ";" in content:
            at = content.lower().find("url=")
            target = urljoin(url, content[at + 4 :].strip() if at != -1 else rest.strip())
        out["refresh_href"] = target or url


META_TYPE = "struct<no_index:boolean,no_follow:boolean,no_cache:boolean,base_href:string,refresh:boolean,refresh_time:int,refresh_href:string,general:map<string,string>,http_equiv:map<string,string>>"


def meta_column(html: Column | str, url: Column | str) -> Column:
    """Meta tags as a struct (:data:`META_TYPE`)."""
    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([meta_tags(tree(h), u or "") for h, u in zip(pages, urls)], columns=["no_index", "no_follow", "no_cache", "base_href", "refresh", "refresh_time", "refresh_href", "general", "http_equiv"])

    return F.pandas_udf(run, META_TYPE)(_c(html), _c(url))


def links(root: Node, url: str, pattern: str | None = None) -> list[tuple[str, str]]:
    """(url, anchor) of each link, against the base of the page; none where the page says nofollow."""
    meta = meta_tags(root, url)
    if meta["no_follow"]:
        return []
    base, out = meta["base_href"] or url, []
    for node in root.walk(skip=lambda n: n.tag in ("script", "style")):
        href = node.attrs.get(LINKS.get(node.tag, ""))
        if href:
            try:
                target = urljoin(base, href.strip())
            except ValueError:
                continue
            if pattern is None or re.fullmatch(pattern, target):
                out.append((target, " ".join(node.text().split())))
    return out


def links_column(html: Column | str, url: Column | str, pattern: str | None = None) -> Column:
    """Links of a page as an array of (url, anchor)."""
    def run(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([[{"url": a, "anchor": b} for a, b in links(tree(h), u or "", pattern)] for h, u in zip(pages, urls)])

    return F.pandas_udf(run, "array<struct<url:string,anchor:string>>")(_c(html), _c(url))


def plain_links(text: Column | str) -> Column:
    """Urls in plain text, by pattern."""
    return F.regexp_extract_all(_c(text), F.lit(URL_PATTERN), 0)


def first_text(html: Column | str, pattern: str) -> Column:
    """First match of a pattern without its tags, on one line, trimmed; "" where there is none."""
    return F.trim(F.replace(F.regexp_replace(F.regexp_extract(_c(html), rf"(?s){pattern}", 0), r"<[^\n]*?>", ""), F.lit("\n"), F.lit(" ")))


def xpath_text(html: Column | str, path: str, references: tuple[str, ...] | None = None) -> Column:
    """Values of a path, trimmed, the blank ones left out, joined by line ends.

    Paths are those of ElementTree, may begin at the root, and may end in ``/@name`` or ``/text()``. A path that is none fails at once, on the driver.
    With names of ``references``, texts have only these decoded, where a semicolon ends them; others stay as they are spelled.
    """
    values = _values(path, references)

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: "\n".join(t for t in (v.strip() for v in values(h)) if t))

    return F.pandas_udf(run, "string")(_c(html))


def xpath_links(html: Column | str, url: Column | str, path: str, attribute: str = "href") -> Column:
    """Attribute values of the nodes of a path, or its own values if it ends in ``/@name`` or ``/text()``, blanks left out, resolved against the url."""
    values = _values(path if _nodes(path)[1] else f"{path}/@{attribute}")

    def run(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([[t for t in (_target(u or "", v.strip()) for v in values(h) if v.strip()) if t] for h, u in zip(pages, urls)])

    return F.pandas_udf(run, "array<string>")(_c(html), _c(url))


def xpath_html(html: Column | str, path: str, spelled: bool = False) -> Column:
    """Serialised first node of a path; null where there is none. With ``spelled``, its texts have references, "&" and ">" as the page spells them."""
    nodes, _ = _nodes(path)

    def run(pages: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        def one(h):
            amp, more = _unused(h or "", 2) if spelled else "&>"
            root = _spelled(h, lambda t: t.replace("&", amp).replace(">", more)) if spelled else tree(h)
            found = next(iter(_element(root).findall(nodes)), None)
            if found is None:
                return None
            found.tail = None
            return ElementTree.tostring(found, encoding="unicode", method="html").replace(amp, "&").replace(more, ">")

        return pages.map(one)

    return F.pandas_udf(run, "string")(_c(html))


def _target(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def _nodes(path: str) -> tuple[str, str]:
    """(path of nodes from the root, what to take of each: "", "text()" or an attribute); ValueError where it is no path."""
    from xml.etree.ElementTree import Element

    nodes, _, last = path.rpartition("/")
    if last != "text()" and not last.startswith("@"):
        nodes, last = path, ""
    if not nodes or nodes.startswith("/"):
        nodes = f".{nodes}"
    if last and nodes.endswith("/"):  # of any node below
        nodes += "/*"
    try:
        Element("x").findall(nodes)
    except (SyntaxError, KeyError, TypeError) as e:  # what ElementTree raises, by the place of the fault
        raise ValueError(f"not a path: {path}") from e
    return nodes, last


def _values(path: str, references: tuple[str, ...] | None = None):
    nodes, last = _nodes(path)
    known = re.compile(rf"&(?:{'|'.join(map(re.escape, references or ()))});")

    def values(html: str | None) -> list[str]:
        root = tree(html) if references is None else _spelled(html, lambda t: known.sub(lambda m: unescape(m[0]), t))
        found = _element(root).findall(nodes)
        if last == "text()":
            return [t for e in found for t in (e.text, *(c.tail for c in e)) if t]
        if last:
            return [e.get(last[1:]) for e in found if e.get(last[1:]) is not None]
        return ["".join(e.itertext()) for e in found]

    return values


def _element(node: Node):
    from xml.etree.ElementTree import Element

    out = Element(node.tag, {k: v for k, v in node.attrs.items()})
    stack = [(node, out)]
    while stack:
        source, made = stack.pop()
        last = None
        for child in source.children:
            if isinstance(child, str):
                if last is None:
                    made.text = (made.text or "") + child
                else:
                    last.tail = (last.tail or "") + child
            else:
                last = Element(child.tag, dict(child.attrs))
                made.append(last)
                stack.append((child, last))
    return out
