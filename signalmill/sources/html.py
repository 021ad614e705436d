"""Web pages: blocks of text, links, and items by selectors; with the standard library's parser, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that are left out with all they hold; elements whose text is a block; elements without an end.
LEFT_OUT = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
BLOCKS = ("article", "p", "li", "blockquote")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MIN_CHARS, PREFIX = 80, 200


class _Node:
    __slots__ = ("tag", "attrs", "parts", "up")

    def __init__(self, tag: str, attrs: dict, up: "_Node | None"):
        self.tag, self.attrs, self.parts, self.up = tag, attrs, [], up

    def text(self) -> str:
        return " ".join(" ".join(p for p in self._parts() if isinstance(p, str)).split())

    def _parts(self) -> Iterator["str | _Node"]:
        """Texts and elements in the page's order, however deep they are."""
        stack = [iter(self.parts)]
        while stack:
            for p in stack[-1]:
                yield p
                if not isinstance(p, str):
                    stack.append(iter(p.parts))
                    break
            else:
                stack.pop()

    def walk(self) -> Iterator["_Node"]:
        return (p for p in self._parts() if not isinstance(p, str))


class _Tree(HTMLParser):
    """Elements in order; a p ends where the next block starts, and what is left out isn't kept."""

    def __init__(self, left_out):
        super().__init__(convert_charrefs=True)
        self.left_out = left_out
        self.root = self.top = _Node("", {}, None)
        self.out = 0
        self.open: Counter = Counter()

    def handle_starttag(self, tag, attrs):
        if self.out or tag in self.left_out:
            self.out += tag not in VOID
            return
        if tag in ("p", "article", "ul", "ol", "blockquote", "div", "h1", "h2", "h3", "table"):
            self._close("p", {"article", "li", "blockquote", "div", "td"})
        if tag == "li":
            self._close("li", {"ul", "ol"})
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.parts.append(node)
        if tag not in VOID:
            self.top = node
            self.open[tag] += 1

    def _close(self, tag, stops):
        if not self.open[tag]:
            return
        node, ended = self.top, Counter()
        while node.up is not None and node.tag not in stops:
            ended[node.tag] += 1
            if node.tag == tag:
                self.top = node.up
                self.open -= ended
                return
            node = node.up

    def handle_endtag(self, tag):
        if self.out:
            self.out -= tag not in VOID
            return
        self._close(tag, set())

    def handle_data(self, data):
        if not self.out:
            self.top.parts.append(data)


_UNCLOSED = re.compile(r"&(?=[A-Za-z#])(?!#?[0-9A-Za-z]+;)")


def parse(page: str | None, left_out=LEFT_OUT, unclosed: bool = True) -> _Node:
    """unclosed: whether references without a semicolon, as of a text that was cut, count as references; else they stay as they stand."""
    tree = _Tree(left_out)
    tree.feed((page or "") if unclosed else _UNCLOSED.sub("&amp;", page or ""))
    tree.close()
    return tree.root


def blocks(page: str | None, min_chars: int = MIN_CHARS, unclosed: bool = True) -> tuple[str, list[str]]:
    """The page's title and the texts of all its blocks, of those that begin alike the first."""
    root = parse(page, unclosed=unclosed)
    title = next((n.text() for n in root.walk() if n.tag == "title"), "")
    seen: dict[str, str] = {}
    for node in root.walk():
        if node.tag in BLOCKS:
            text = node.text()
            if len(text) >= min_chars:
                seen.setdefault(text[:PREFIX], text)
    return title, list(seen.values())


_BLOCK = T.ArrayType(T.StructType([T.StructField("nth", T.IntegerType()), T.StructField("external_id", T.StringType()), T.StructField("text", T.StringType())]))


def named_blocks(url: str, page: str | None, unclosed: bool = True) -> list[dict]:
    title, found = blocks(page, unclosed=unclosed)
    name = lambda k, t: "html:" + hashlib.sha1(f"{url}#{k}#{t[:80]}".encode()).hexdigest()[:16]
    return [{"nth": k, "external_id": name(k, t), "text": f"{title}\n\n{t}" if title else t} for k, t in enumerate(found)]


@F.pandas_udf(_BLOCK)
def _blocks_of(url: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([named_blocks(u, h) for u, h in zip(url, page)])


@F.pandas_udf(_BLOCK)
def _blocks_as_closed(url: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([named_blocks(u, h, unclosed=False) for u, h in zip(url, page)])


def page_blocks(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", unclosed: bool = True) -> DataFrame:
    """(page_id, url, nth, external_id, text): a record for each block of each page. unclosed: as parse()."""
    of = _blocks_of if unclosed else _blocks_as_closed
    return pages.select(page_id, url, F.explode(of(F.col(url), F.col(html))).alias("b")).select(page_id, url, "b.*")


def links(url: str, page: str | None, pattern: str | None = None, same_host: bool = True, most: int = 50) -> list[str]:
    """Absolute addresses that a page links to (its menus, too), each once, in order: of its host, with a path that the pattern finds."""
    host, path = urlsplit(url).netloc, re.compile(pattern) if pattern else None
    out: dict[str, None] = {}
    for node in parse(page, ()).walk():
        if node.tag == "a" and node.attrs.get("href") is not None:
            at = urljoin(url, node.attrs["href"])
            parts = urlsplit(at)
            if (not same_host or parts.netloc == host) and (path is None or path.search(parts.path)):
                out.setdefault(at)
        if len(out) >= most:
            break
    return list(out)


def sitemap(xml: str, host: str | None = None, most: int = 50) -> list[str]:
    found = (x.strip() for x in re.findall(r"<loc>\s*([^<]+?)\s*</loc>", xml))
    return list(dict.fromkeys(x for x in found if host is None or urlsplit(x).netloc == host))[:most]


def is_sitemap(url: str, text: str) -> bool:
    head = text[:2000].lower()
    return url.lower().endswith(".xml") or "<urlset" in head or "<sitemapindex" in head


def link_column(pattern: str | None = None, same_host: bool = True, most: int = 50):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(url: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([sitemap(h or "", urlsplit(u).netloc if same_host else None, most) if is_sitemap(u, h or "") else links(u, h, pattern, same_host, most) for u, h in zip(url, page)])

    return found


_STEP = re.compile(r"([a-zA-Z0-9*]*)((?:[#.][\w-]+|\[[^\]]+\])*)")
_MARK = re.compile(r"#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")
_HOLDS = {"=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__, "~=": lambda have, want: want in have.split(), "|=": lambda have, want: have == want or have.startswith(f"{want}-")}


def _matcher(step: str):
    m = _STEP.fullmatch(step)
    if not m or not step:
        raise ValueError(f"selectors are tag, *, #id, .class and [attribute]: {step}")
    tag, marks = m[1].lower(), _MARK.findall(m[2])

    def fits(node: _Node) -> bool:
        if tag not in ("", "*", node.tag):
            return False
        for ident, name, attr, how, want in marks:
            have = node.attrs.get("id" if ident else "class" if name else attr.lower())
            if have is None or ident and have != ident or name and name not in have.split() or how and not _HOLDS[how](have, want):
                return False
        return True

    return fits


def _parts(css: str, separators: str) -> list[str]:
    """Split outside brackets; separators stay as parts of their own."""
    return [p for p in re.findall(rf"(?:\[[^\]]*\]|[^\s{separators}\[])+|[{separators}]", css)]


def select(root: _Node, css: str) -> list[_Node]:
    """Nodes by selectors of tag, *, #id, .class and [attribute], with spaces for descendants, > for children, and commas for more than one."""
    out: list[_Node] = []
    for chain in re.split(r",(?![^\[]*\])", css):
        level, child = [root], False
        for step in _parts(chain, ">"):
            if step == ">":
                child = True
                continue
            fits = _matcher(step)
            below = lambda top: (p for p in top.parts if isinstance(p, _Node)) if child else top.walk()  # noqa: B023, E731
            level, child = list(dict.fromkeys(n for top in level for n in below(top) if fits(n))), False
        out += level
    return list(dict.fromkeys(out))


def items(url: str, page: str | None, listing: str, title: str | None = None, body: str | None = None, link: str | None = None, date: str | None = None, most: int = 100, hashed: bool = True) -> list[dict]:
    """Records of a page's list elements, by selectors. hashed: ids by a digest of link and place, and no empty texts;
    else by address and place, empty ones as "(empty)"."""
    out = []
    for k, node in enumerate(select(parse(page), listing)[:most]):
        pick = lambda css: next(iter(select(node, css)), None) if css else None
        parts = [n.text() for n in (pick(title), pick(body)) if n is not None] if title or body else [node.text()]
        text = "\n\n".join(p for p in parts if p)
        anchor = pick(link or "a")
        at = urljoin(url, anchor.attrs["href"]) if anchor is not None and anchor.attrs.get("href") else url
        if hashed and not text:
            continue
        when = pick(date)
        out.append({"external_id": "html:" + hashlib.sha1(f"{at}#{k}".encode()).hexdigest()[:16] if hashed else f"html:{url}#{k}", "url": at, "text": text or "(empty)", "date": when.text() if when is not None else None})
    return out


def external_id(url: Column, nth: Column, text: Column) -> Column:
    return F.concat(F.lit("html:"), F.substring(F.sha1(F.concat(url, F.lit("#"), nth.cast("string"), F.lit("#"), F.substring(text, 1, 80))), 1, 16))


def register(spark) -> None:
    """Table functions for SQL: html_blocks(url, html), html_links(url, html)."""

    @F.udtf(returnType="nth int, external_id string, text string")
    class HtmlBlocks:
        def eval(self, url: str, page: str):
            yield from ((b["nth"], b["external_id"], b["text"]) for b in named_blocks(url, page))

    @F.udtf(returnType="nth int, link string")
    class HtmlLinks:
        def eval(self, url: str, page: str):
            yield from enumerate(links(url, page))

    spark.udtf.register("html_blocks", HtmlBlocks)
    spark.udtf.register("html_links", HtmlLinks)
