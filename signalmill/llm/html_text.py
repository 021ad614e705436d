"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each under a path of tags from the root. For every path the characters outside links and the
punctuation marks of its blocks are summed; their ratios to the number of blocks are smoothed over neighbouring blocks, multiplied, and
fused with what marks say of the path: nothing is left of one that is marked as something else (menus, adverts, comments and so
on), one within an article or main counts more. Blocks whose fused ratio stands out over the page are the content nodes; the deepest
element that holds nearly all of their weight is the article, and all its blocks but the marked ones are the text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

# Element names by what they do to text.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu", "search", "select", "option", "button", "fieldset", "label", "legend", "head"}
ASIDE_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
# Words of class and id that mark something else than the article.
ASIDE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "sidebars", "widget", "widgets", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "disqus", "replies", "reply", "respond", "footer", "header", "masthead", "topbar", "toolbar", "search", "skip", "alert", "copyright", "legal", "disclaimer", "tags", "form"}
# Of these, the ones that an article may have itself; and words before which one is no mark ("no-sidebar").
HEADS, DENIED = {"header", "masthead"}, {"no", "not", "has", "with", "without", "hide"}
CLOSED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
# An open li, dt and so on is only closed by another of the same list or table.
SCOPES = {"ul", "ol", "dl", "menu", "table", "body", "article", "main", "section", "div"}
# Elements that can be an article; others are parts of one.
HOLDERS = {"", "html", "body", "div", "section", "article", "main", "td", "center"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟।]")


class Node:
    """An open element. path: a number for the tags (and marks) from the root to it; scope: the nearest of SCOPES that holds it, which
    counts its open elements of CLOSED_BY."""

    __slots__ = ("name", "aside", "up", "path", "depth", "inside", "scope", "open", "mass")

    def __init__(self, name: str, aside: bool, up: "Node | None", path: int):
        self.name, self.aside, self.up, self.path = name, aside, up, path
        self.depth = up.depth + 1 if up else 0
        self.inside = name in ("article", "main") or bool(up and up.inside)
        self.scope = self if up is None or name in SCOPES else up.scope
        self.open: dict[str, int] = {}
        self.mass = 0.0


@dataclass
class Block:
    node: Node
    text: str
    links: int  # characters in links
    weight: float = 0.0


def marked_aside(name: str, attrs: str, inside: bool) -> bool:
    """header counts as the page's own unless an article or main holds it (inside)."""
    if name in ASIDE or name == "header" and not inside:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ASIDE_ROLES:
            return True
        if key in ("class", "id"):
            own = [w.lower() for w in _WORD.findall(value)]
            if any(w in ASIDE_WORDS and not (inside and w in HEADS) and (k == 0 or own[k - 1] not in DENIED) for k, w in enumerate(own)):
                return True
    return False


class _Reader:
    """The blocks of a page in order, and its elements, each after the one that holds it. Time and memory are linear in the page, however deep its
    elements nest."""

    def __init__(self, page: str):
        self.root = Node("", False, None, 0)
        self.top, self.nodes, self.blocks = self.root, [self.root], []
        self.paths: dict[tuple, int] = {}
        self.opened: dict[str, int] = defaultdict(int)
        self.buffer: list[str] = []
        self.links, self.in_link = 0, False
        self.read(page)

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.blocks.append(Block(self.top, text, min(self.links, len(text))))
        self.buffer, self.links = [], 0

    def add(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.buffer.append(text)
            if self.in_link:
                self.links += len(text.strip())

    def leave(self, node: Node) -> None:
        """Closes node and all within it."""
        while self.top is not node.up:
            x, self.top = self.top, self.top.up
            self.opened[x.name] -= 1
            if x.name in CLOSED_BY and x.up:
                x.up.scope.open[x.name] -= 1

    def enter(self, name: str, attrs: str) -> None:
        if self.top.name == "p" and name in CLOSED_BY["p"]:
            self.leave(self.top)
        shuts = [k for k, by in CLOSED_BY.items() if k != "p" and name in by and self.top.scope.open.get(k)]
        if shuts:
            x = self.top
            while x.name not in shuts:
                x = x.up
            self.leave(x)
        if name in VOID:
            return
        up = self.top
        aside = up.aside or marked_aside(name, attrs, up.inside)
        path = self.paths.setdefault((up.path, name, aside), len(self.paths) + 1)
        self.top = Node(name, aside, up, path)
        self.nodes.append(self.top)
        self.opened[name] += 1
        if name in CLOSED_BY:
            up.scope.open[name] = up.scope.open.get(name, 0) + 1

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                self.add(page[at:])
                break
            self.add(page[at : m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if name is None:
                continue
            name, attrs = name.lower(), m["attrs"] or m["attrs2"] or ""
            if m["end"] or m["end2"]:
                if name == "a":
                    self.in_link = False
                elif name in BLOCKS and name not in VOID:
                    self.flush()
                    if self.opened[name]:
                        x = self.top
                        while x.name != name:
                            x = x.up
                        self.leave(x)
                        self.in_link = False
            elif name in RAW and not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            elif name == "br":
                self.buffer.append(" ")
            elif name == "a":
                self.in_link = True
            elif name in BLOCKS:
                self.flush()
                self.in_link = False
                self.enter(name, attrs)
        self.flush()


def smooth(values: list[float]) -> list[float]:
    """Over each place and its two neighbours."""
    return [sum(values[max(0, k - 1) : k + 2]) / len(values[max(0, k - 1) : k + 2]) for k in range(len(values))]


#: How much more text counts that an article or main element holds.
WITHIN = 10.0


def path_weights(blocks: list[Block]) -> None:
    """Gives each block the fused, smoothed ratio of its path; 0 to those of marked paths."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        chars[b.node.path] += len(b.text) - b.links
        marks[b.node.path] += len(_PUNCTUATION.findall(b.text))
        count[b.node.path] += 1
    length = smooth([1 + chars[b.node.path] / count[b.node.path] for b in blocks])
    punctuation = smooth([1 + marks[b.node.path] / count[b.node.path] for b in blocks])
    for b, x, y in zip(blocks, length, punctuation):
        b.weight = 0.0 if b.node.aside else x * y * (WITHIN if b.node.inside else 1.0)


#: A block stands out if its weight is above so many standard deviations of the page's weights; the least share of such blocks' weight that
#: the article's element holds.
SPREAD, SHARE = 0.5, 0.8


def main_blocks(page: str) -> list[str]:
    reader = _Reader(page)
    path_weights(reader.blocks)
    blocks = [b for b in reader.blocks if b.weight > 0]
    if not blocks:
        return []
    mean = sum(b.weight for b in blocks) / len(blocks)
    deviation = (sum((b.weight - mean) ** 2 for b in blocks) / len(blocks)) ** 0.5
    for b in blocks:
        if b.weight >= min(SPREAD * deviation, mean):
            b.node.mass += b.weight * (1 + len(b.text) - b.links)
    for node in reversed(reader.nodes[1:]):
        node.up.mass += node.mass
    holder = max((x for x in reader.nodes if x.name in HOLDERS and x.mass >= SHARE * reader.root.mass), key=lambda x: x.depth)
    outer = holder
    while outer is not None:  # an article is taken whole, and so is main
        if outer.name in ("article", "main"):
            holder = outer
        outer = outer.up
    within: set[int] = {id(holder)}
    for node in reader.nodes:
        if node.up is not None and id(node.up) in within:
            within.add(id(node))
    held = [b for b in blocks if id(b.node) in within]
    return [b.text for b in [*_heading(blocks, held), *held]]


def _heading(blocks: list[Block], held: list[Block]) -> list[Block]:
    """The main heading, where it is the block just before the article's element."""
    if not held or any(b.node.name == "h1" for b in held):
        return []
    first = next(k for k, b in enumerate(blocks) if b is held[0])
    return [b for b in blocks[max(0, first - 1) : first] if b.node.name == "h1"]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page or ""))


def extract(df: DataFrame, markup: str = "html", text: str = "text") -> DataFrame:
    """df with the main text of every whole page: blocks in page order, joined by empty lines; empty if there is none.

    Null pages count as empty. Character references are decoded and white space inside a block becomes one space. Pages of any
    length and depth are read whole, in linear time; an empty table gives an empty one. Of elements that hold the same, the
    deepest is taken. Rows are kept as they come, repeated ones alike; a column of df with the name of the new one is replaced.
    """
    (source,) = common.fresh(df, "_page_html")
    rows = df.withColumn(source, df[markup]).drop(*(c for c in df.columns if c.lower() == text.lower()))
    return common.map_rows(rows, [source], [(text, T.StringType())], lambda: lambda columns: [[main_text(p) for p in columns[0]]]).drop(source)
