"""Pages as Markdown or plain text, with the standard library's parser.

The contract: script, style, nav, footer and breadcrumb elements are dropped;
headings become # lines one level down (at most six), signatures and pre become
fenced code, list items "- " lines, table rows pipes with a rule after the first,
paragraphs lines. Blank, boilerplate and consecutive equal lines are dropped and
lines are joined by a blank line. Markup that isn't closed ends with its parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import CHROME

# Where the content of a page stands, first match wins; elements that are dropped.
ROOTS = ["#content-wrap", "#bodyContent", "main", "article"]
DROP = {"script", "style", "nav", "footer", "noscript", "template", "svg", "button", "select", "option", "iframe"}
DROP_IDS = {"sidebar", "header"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Open elements that a start tag ends, and elements beyond which it ends none.
ENDS = dict.fromkeys("p ul ol table div section article main pre h1 h2 h3 h4 h5 h6 blockquote dl".split(), {"p"}) | {"li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
HOLD = {"ul", "ol", "table", "div", "section", "article", "main", "body", "blockquote"}
_BOILER = re.compile("^(?:" + "|".join(f"(?:{p[4:]})" for p in CHROME) + ")$", re.I)


class Node:
    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.kids = name, attrs, []

    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.name not in DROP:
                todo += reversed(n.kids)
        return "".join(out)

    def inline(self) -> str:
        return " ".join(self.text().split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        cut = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in ENDS.get(tag, ()):
                cut = i
            elif self.open[i].name in HOLD:
                break
        if cut is not None:
            del self.open[cut:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parse(page: str) -> Node:
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


def content_root(root: Node) -> Node:
    """The element that holds the content; else the body, else everything."""
    nodes = list(root.walk())
    for want in [*ROOTS, "body"]:
        for n in nodes:
            if n.attrs.get("id") == want[1:] if want[0] == "#" else n.name == want:
                return n
    return root


def title_of(root: Node, prefix: str | None = None) -> str:
    """The title element's text without the site's prefix (a pattern), else the first h1's."""
    for want in ("title", "h1"):
        for n in root.walk():
            if n.name == want:
                said = n.inline()
                if want == "title" and prefix:
                    said = re.sub(rf"\A(?:{prefix})", "", said, flags=re.I).strip()
                if said:
                    return said
    return ""


def _lines(node: Node, depth: int, out: list[str]) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip() and len(kid) < 6000:
                out.append(" ".join(kid.split()))
            continue
        name = kid.name
        if name in DROP or name in ("head", "title") or kid.attrs.get("id") in DROP_IDS or "breadcrumb" in " ".join(kid.classes()):
            continue
        if "sig-block" in kid.classes() or name == "pre":
            out.append(f"```\n{kid.text().strip()}\n```")
        elif re.fullmatch("h[1-6]", name):
            out.append("#" * min(int(name[1]) + 1, 6) + " " + kid.inline())
        elif name in ("ul", "ol"):
            for item in kid.kids:
                if isinstance(item, Node):
                    out.append("  " * depth + "- " + item.inline())
        elif name == "table":
            rows = [[c.inline() for c in r.walk() if c.name in ("td", "th")] for r in kid.walk() if r.name == "tr"]
            for i, cells in enumerate(r for r in rows if r):
                out.append("| " + " | ".join(cells) + " |")
                if i == 0:
                    out.append("|" + " --- |" * len(cells))
        elif name in ("p", "b", "i", "em", "strong", "span", "a", "code", "blockquote", "dt", "dd", "figcaption"):
            if any(isinstance(k, Node) and k.name in ("p", "div", "ul", "ol", "table", "pre") for k in kid.walk() if k is not kid):
                _lines(kid, depth, out)
            elif kid.inline():
                out.append(kid.inline())
        elif name not in VOID:
            _lines(kid, depth + 1 if name in ("ul", "ol") else depth, out)


def render(page: str | None) -> str:
    """A page as Markdown."""
    out: list[str] = []
    _lines(content_root(parse(page or "")), 0, out)
    kept: list[str] = []
    for line in out:
        if line.strip() and not _BOILER.match(line.strip()) and (not kept or kept[-1] != line):
            kept.append(line)
    return "\n\n".join(kept)


def clean(page: str | None) -> str:
    """The text of headings, paragraphs, code, list items and cells outside page furniture."""
    out: list[str] = []

    def visit(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, Node) and k.name not in DROP | {"header", "aside"}:
                if k.name in ("h1", "h2", "h3", "h4", "p", "pre", "code", "li", "td") and k.inline():
                    out.append(k.inline())
                visit(k)

    visit(parse(page or ""))
    return "\n".join(out)


def extract(pages: DataFrame, key: str, html: str = "html", max_chars: int = 24000, least: int = 30, title_prefix: str | None = None) -> DataFrame:
    """(key, title, markdown, char_len) of pages with at least so many characters that aren't blank."""
    from palimpsest.sources.pages import cap

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            said = [h if isinstance(h, str) else "" for h in column]
            yield pd.DataFrame({"title": [title_of(parse(h), title_prefix) for h in said], "markdown": [render(h) for h in said]})

    out = pages.select(key, F.pandas_udf(run, "title string, markdown string")(html).alias("p")).select(key, "p.*")
    full = out.where(F.length(F.regexp_replace("markdown", r"\s", "")) >= least)
    return full.select(key, "title", cap(F.col("markdown"), max_chars).alias("markdown"), F.length("markdown").cast("long").alias("char_len"))
