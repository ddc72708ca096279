"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by
where they stand (menus, headers, footers, asides, forms and the like are out, an
article is in), by the share of stop words, by length and by the share of linked
text. Short or doubtful blocks stay open; the second pass gives them the label of
the nearest decided neighbours.

Defined cases: a null or empty page has an empty text; malformed markup is read
as far as it goes: an unclosed comment or script runs to the end of the page, an
unclosed tag is text; repeated rows are read one by one; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is never text.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "title", "annotation", "annotation-xml"}
# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that begin and end blocks.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements that hold other things than the main text.
OUT = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "address"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Of those, the ones that can stand around an article by mistake or habit.
AROUND = {"nav", "header", "form", "menu", "fieldset"}
# readers' comments, which are often marked up as articles.
COMMENT = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|respond|reply|replies)(?:$|[\s_-]|\d)", re.I)
# Words in class, id or role that say the same wherever they stand.
CLEAR = set("nav navbar navigation menu sidebar footer masthead advert advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments disqus respond reply replies breadcrumb breadcrumbs pagination pager toolbar newsletter contentinfo".split())
# Words that say so alone or beside words for parts of pages, but not in names such as related-work.
VAGUE = set("aside header banner ad ads promo notice alert popup modal share sharing social related recommended widget search login signup subscribe skip hidden complementary".split())
# Words for parts of pages.
PART = set("area article articles bar block blog body bottom box btn button buttons container content entry form global group icons inner item items left link links list main media outer page panel post posts primary right secondary section site slot stories story text to top unit wrap wrapper".split())
# Frequent words of four languages.
STOP = set(
    "the of and to in a is that it was for on are as with his they at be this from or had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into has"
    " der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei"
    " de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son cette ou ont mais comme nous elle leur aux ses tout fait été aussi bien peut"
    " el los las y del se por con una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les".split()
)
MAX_LINKS, SHORT, LONG = 0.2, 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
#: Words that a page's blocks must hold to tell that its language isn't one of STOP's, and
#: the share of stop words below which it isn't. Then words of SMALL letters count, too.
TELLING, FOREIGN, SMALL = 50, 0.25, 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_END = {n: re.compile(rf"</{n}\b[^>]*>|\Z", re.I) for n in RAW}


class Blk:
    __slots__ = ("label", "linked", "parts", "place", "text")

    def __init__(self, place: str):
        self.place, self.parts, self.linked, self.text, self.label = place, [], 0, "", ""


def _hints(value: str) -> bool:
    """A class, id or role says that an element isn't main text."""
    for token in value.lower().split():
        words = [w.rstrip("0123456789") for w in re.split(r"[_-]+", token)]
        words = [w for w in words if w]
        vague = any(w in VAGUE for w in words)
        if any(w in CLEAR for w in words) or (vague and all(w in VAGUE or w in PART for w in words)):
            return True
    return False


def _place(name: str, attrs: str, outer: str) -> str:
    """in, out, around, head or open: what an element says about the text in it.

    around is out too, but an article in it is in; head is the header of an article,
    of which headings are in.
    """
    hints, hidden = "", False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            hints += f" {value} "
        hidden |= key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower())
    page = name in ("html", "body")
    if hidden or outer == "out" or (COMMENT.search(hints) and not page):
        return "out"
    if name in ("article", "main"):
        return "in"
    if _hints(hints) and not page:
        return "out"
    if outer == "head":
        return "in" if name in HEADINGS else "head"
    if name == "header" and outer == "in":
        return "head"
    if name in OUT:
        return "around" if name in AROUND and outer == "open" else "out"
    if outer == "open" and ("articleBody" in attrs or re.search(r"\smain\s", hints)):
        return "in"
    return outer


def blocks_of(page: str) -> list[Blk]:
    """The blocks of a page with their text, linked characters and place."""
    found: list[Blk] = []
    stack: list[tuple[str, str]] = []
    now = Blk("open")
    links, breaks, at = 0, 0, 0
    open_names: Counter[str] = Counter()  # of the stack

    def flush() -> None:
        nonlocal now, breaks
        if now.parts:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                found.append(now)
        now = Blk(stack[-1][1] if stack else "open")
        breaks = 0

    def text(s: str) -> None:
        nonlocal breaks
        if s:
            if links:
                now.linked += len(s.strip())
            if not s.isspace():
                breaks = 0
            now.parts.append(s)

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                at = _END[name].search(page, at).end()
            continue
        if name == "br":
            breaks += 1
            now.parts.append(" ")
            if breaks > 1:
                flush()
            continue
        if name == "a":
            links = 0 if closing else 1
        if closing:
            if open_names[name]:
                if name in BLOCK:
                    flush()
                while stack:
                    open_names[top := stack.pop()[0]] -= 1
                    if top == name:
                        break
                now = _moved(now, stack)
            continue
        if name in BLOCK:
            for n in _close_paragraph(stack, name):
                open_names[n] -= 1
            flush()
        if name in VOID or m[3].endswith("/"):
            continue
        outer = stack[-1][1] if stack else "open"
        place = _place(name, m[3], outer)
        if name in BLOCK or place != outer:
            if place != outer:
                flush()
            stack.append((name, place))
            open_names[name] += 1
            now = _moved(now, stack)
            links = 0 if name in BLOCK else links
    text(page[at:])
    flush()
    return found


def _moved(now: Blk, stack: list[tuple[str, str]]) -> Blk:
    """The open block, for the element that is now on top."""
    place = stack[-1][1] if stack else "open"
    if not now.parts:
        now.place = place
    return now


def _close_paragraph(stack: list[tuple[str, str]], name: str) -> list[str]:
    """A block ends an open paragraph, and a list item the item before it; the names ended."""
    for i in range(len(stack) - 1, -1, -1):
        n = stack[i][0]
        if n == "p" or (n == name and name in ("li", "dt", "dd", "option", "tr", "td", "th")):
            ended = [x for x, _ in stack[i:]]
            del stack[i:]
            return ended
        if n in BLOCK:
            break
    return []


def _stop_words(found: list[Blk]) -> list[float]:
    """The share of stop words of each block.

    Where a page's language isn't known, short words count as stop words, and text
    without blanks between words passes.
    """
    words = [[w.strip(".,;:!?()\"'") for w in b.text.lower().split()] for b in found]
    known = [sum(w in STOP for w in ws) for ws in words]
    free = [k for k, b in enumerate(found) if b.place in ("open", "in")]
    total = sum(len(words[k]) for k in free)
    letters = sum(len(w) for k in free for w in words[k])
    unspaced = letters > 15 * max(1, total) and letters >= LONG
    if unspaced:
        return [1.0] * len(found)
    if total >= TELLING and sum(known[k] for k in free) < FOREIGN * total:
        known = [sum(0 < len(w) <= SMALL or w in STOP for w in ws) for ws in words]
    return [n / max(1, len(ws)) for n, ws in zip(known, words, strict=True)]


def classify(found: list[Blk]) -> list[Blk]:
    """Label all blocks good or bad, in two passes."""
    inside = any(b.place == "in" for b in found)
    for b, stop in zip(found, _stop_words(found), strict=True):
        links = b.linked / max(1, len(b.text))
        if b.place in ("out", "around", "head"):
            b.label = "bad"
        elif b.place == "in":
            b.label = "good" if links <= 0.9 else "short"
        elif inside or links > MAX_LINKS:
            b.label = "bad"
        elif len(b.text) < SHORT:
            b.label = "bad" if b.linked else "short"
        elif stop >= STOP_HIGH:
            b.label = "good" if len(b.text) > LONG else "near"
        else:
            b.label = "near" if stop >= STOP_LOW else "bad"
    decided = [b.label if b.label in ("good", "bad") else "" for b in found]
    before, last = [], "bad"
    for x in decided:
        before.append(last)
        last = x or last
    after, last = [], "bad"
    for x in reversed(decided):
        after.append(last)
        last = x or last
    for b, x, y in zip(found, before, reversed(after), strict=True):
        if b.label in ("short", "near"):
            one_good = "good" in (x, y)
            b.label = "good" if x == y == "good" or (one_good and (b.label == "near" or b.place == "in")) else "bad"
    return found


def extract(page: str | None) -> str:
    """The main text of a page, a line for each block."""
    if not page:
        return ""
    return "\n".join(b.text for b in classify(blocks_of(page)) if b.label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda h: extract(h if isinstance(h, str) else None))

    rows = pages.select("page_id", "url", F.pandas_udf(run, "string")("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
