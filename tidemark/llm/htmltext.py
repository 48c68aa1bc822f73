"""Main text of web pages from flat text blocks and a small decision tree.

A page is cut into blocks at the tags that break a line of text. Each block has its word count and
link density, those of its neighbours, and what encloses it; a tree fitted on a small labelled
table decides which blocks are main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, rows
from .trees import grow, predict

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(
    r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+))|([^\s=\"'/>]+)", re.S)
_SPACE = re.compile(r"\s+")

# Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "select"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em",
          "font", "i", "ins", "kbd", "mark", "q", "ruby", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label", "br",
          "math", "semantics", "mrow", "mi", "mo", "mn", "ms", "mtext", "msup", "msub", "msubsup",
          "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mspace", "mstyle"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "fieldset"}
MAIN = {"article", "main"}
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|popup|"
    r"modal|newsletter|subscribe|signup|login|menu|nav\w*|breadcrumbs?|side-?bar|footer|header|"
    r"masthead|comments?|replies|reply|disqus|respond|related|recommend\w*|share|sharing|social|"
    r"widget|pagination|pager|toolbar|copyright|disclaimer|tags|teaser)(?:$|[\s_-])", re.I)
# Names of a layout that has or lacks some part; the element is not that part.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|without|no)[_-]\S+", re.I)
_HEADING = re.compile(r"h\d")
_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert",
         "form", "menu", "menubar", "toolbar"}

#: Columns of the feature table.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "aside", "main", "list", "heading")


class Block:
    __slots__ = ("text", "words", "linked", "aside", "main", "list", "heading")

    def __init__(self, text, linked, aside, main, in_list, heading):
        self.text, self.words, self.linked = text, len(text.split()), linked
        self.aside, self.main, self.list, self.heading = aside, main, in_list, heading


def _apart(name: str, attributes: str) -> str:
    """What sets an element's inside apart: "sure", a "hint" of its class or id, or nothing."""
    if name in ASIDE:
        return "sure"
    if not attributes or name in ("html", "body", "article", "main"):
        return ""
    found = ""
    for m in _ATTRIBUTE.finditer(attributes):
        key = (m[1] or m[5] or "").lower()
        value = next((g for g in m.group(2, 3, 4) if g is not None), "")
        if key == "role" and value.lower() in _ROLE or \
                key == "hidden" or key == "aria-hidden" and value.lower() == "true" or \
                key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "sure"
        # The id of a heading or paragraph is a link target made from its words.
        if (key == "class" or key == "id" and name != "p" and not _HEADING.fullmatch(name)) and \
                _HINT.search(_LAYOUT.sub("", value)):
            found = "hint"
    return found


def blocks(html: str | None) -> list[Block]:
    """Text blocks of a page in their order; an unfinished tag at the end is dropped.

    The outermost article or main element ends what a class or id around it hints at.
    """
    found: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, str, bool]] = []  # name, apart, main
    depth = {"sure": 0, "hint": 0, "outside": 0, "main": 0, "a": 0, "list": 0, "heading": 0,
             "inside": 0}
    opened: Counter[str] = Counter()  # open elements by name
    html = html or ""

    def flush():
        joined = "".join(text)
        clean = _SPACE.sub(" ", entities.unescape(joined)).strip() if joined else ""
        if clean:
            aside = depth["sure"] > 0 or depth["hint"] > depth["outside"]
            found.append(Block(clean, len("".join(linked).split()), aside, depth["main"] > 0,
                               depth["list"] > 0, depth["heading"] > 0))
        text.clear()
        linked.clear()

    def shift(item, by):
        name, apart, main = item
        opened[name] += by
        if apart:
            depth[apart] += by
            depth["inside"] += by * (name in INLINE)
        depth["main"] += by * main
        if main and depth["main"] == max(by, 0):  # the outermost opens or closes
            depth["outside"] = depth["hint"] if by > 0 else 0
        depth["a"] += by * (name == "a")
        depth["list"] += by * (name in ("ul", "ol", "dl"))
        depth["heading"] += by * (len(name) == 2 and name[0] == "h" and name[1].isdigit())

    def say(part):
        if part and not depth["inside"]:  # an advert inside a line goes without its line
            text.append(part)
            if depth["a"]:
                linked.append(part + " ")

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                flush()
            # Close up to the matching element; a stray end tag closes nothing.
            while opened[name]:
                item = stack.pop()
                shift(item, -1)
                if item[0] == name:
                    break
            continue
        if name not in INLINE:
            flush()
        if name == "br":
            say(" ")
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            # A new one ends an open one of its kind, unless a container lies between.
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    while len(stack) > k:
                        shift(stack.pop(), -1)
                    break
                if stack[k][0] not in INLINE:
                    break
        item = (name, _apart(name, m[3]), name in MAIN)
        stack.append(item)
        shift(item, 1)
    flush()
    return found


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; missing neighbours count as blocks without words."""
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(min(1, b.linked / b.words) if b.words else 0 for b in found), 0], float)
    return np.column_stack([
        words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:],
        *([float(getattr(b, k)) for b in found] for k in ("aside", "main", "list", "heading")),
    ]).reshape(n, len(FEATURES))


#: Small labelled table: words, link density, the same of the block before and after, whether the
#: block lies in an aside, in the main element, in a list, in a heading; 1 for main text.
LABELLED = (
    (1, 1, 0, 0, 1, 1, 1, 0, 1, 0, 0), (2, 1, 1, 1, 1, 1, 1, 0, 1, 0, 0),
    (9, 0, 1, 1, 8, 0, 1, 0, 0, 0, 0), (12, 0, 40, 0, 0, 0, 1, 0, 0, 0, 0),
    (60, 0, 9, 0, 55, 0, 1, 1, 0, 0, 0), (30, 0.1, 70, 0, 20, 0, 1, 1, 0, 0, 0),
    (8, 0, 2, 1, 50, 0, 0, 1, 0, 1, 1), (45, 0, 8, 0, 60, 0, 0, 1, 0, 0, 1),
    (1, 0, 45, 0, 2, 0, 0, 1, 0, 0, 1), (2, 0, 1, 0, 12, 0, 0, 1, 0, 0, 1),
    (120, 0.05, 2, 0, 5, 0, 0, 1, 0, 0, 1), (5, 0, 120, 0, 9, 0, 0, 1, 1, 0, 1),
    (7, 0.3, 30, 0, 6, 0, 0, 1, 1, 0, 1), (6, 1, 30, 0, 40, 0, 0, 1, 0, 0, 1),
    (3, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1), (20, 0.2, 15, 0, 30, 0, 0, 1, 0, 0, 1),
    (70, 0, 10, 0, 60, 0, 0, 0, 0, 0, 1), (35, 0.05, 70, 0, 5, 0, 0, 0, 0, 0, 1),
    (55, 0, 8, 0, 40, 0.1, 0, 0, 0, 0, 1), (90, 0.1, 40, 0, 30, 0, 0, 0, 0, 0, 1),
    (16, 0, 60, 0, 70, 0, 0, 0, 0, 0, 1), (8, 0, 3, 1, 70, 0, 0, 0, 0, 1, 1),
    (3, 1, 2, 1, 2, 1, 0, 0, 1, 0, 0), (2, 1, 3, 1, 4, 1, 0, 0, 0, 0, 0),
    (5, 0.8, 4, 1, 60, 0, 0, 0, 0, 0, 0), (4, 0, 60, 0, 3, 1, 0, 0, 0, 0, 0),
    (7, 0.4, 5, 1, 2, 1, 0, 0, 0, 0, 0), (3, 0, 2, 1, 1, 1, 0, 0, 0, 1, 0),
    (12, 0.9, 9, 0.9, 10, 0.9, 0, 0, 1, 0, 0), (25, 0.7, 12, 1, 8, 1, 0, 0, 0, 0, 0),
    (2, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0), (6, 0, 4, 0, 3, 0, 0, 0, 0, 0, 0),
    (50, 0, 20, 0, 10, 0, 1, 0, 0, 0, 0), (18, 0.1, 80, 0, 0, 0, 1, 0, 0, 0, 0),
    (4, 0, 2, 0, 60, 0, 1, 1, 0, 1, 0), (2, 1, 60, 0, 3, 1, 1, 1, 1, 0, 0),
    # Text beside link blocks: menus, link lists, a footer of links; first in an article.
    (60, 0, 40, 0, 6, 1, 0, 1, 0, 0, 1), (35, 0.05, 30, 0, 1, 1, 0, 1, 0, 0, 1),
    (9, 0, 50, 0, 3, 1, 0, 1, 0, 0, 1), (4, 0, 30, 0, 2, 1, 0, 1, 0, 0, 1),
    (25, 0, 2, 1, 8, 1, 0, 1, 0, 0, 1), (90, 0.1, 5, 1, 70, 0, 0, 1, 0, 0, 1),
    (5, 0, 3, 1, 12, 1, 0, 1, 0, 1, 1), (14, 0.2, 6, 1, 4, 1, 0, 1, 0, 0, 1),
    (70, 0, 40, 0, 4, 1, 0, 0, 0, 0, 1), (40, 0, 50, 0, 2, 1, 0, 0, 0, 0, 1),
    (25, 0.1, 60, 0, 8, 1, 0, 0, 0, 0, 1), (55, 0.05, 3, 1, 1, 1, 0, 0, 0, 0, 1),
    (12, 0, 40, 0, 4, 1, 0, 0, 0, 0, 1), (9, 0, 12, 0, 30, 0, 0, 0, 0, 0, 1),
    (20, 0.1, 9, 0, 12, 0, 0, 0, 0, 0, 1), (14, 0, 4, 1, 25, 0, 0, 0, 0, 0, 1),
    (11, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), (30, 0.2, 25, 0, 9, 1, 0, 0, 0, 0, 1),
    # Nothing but the neighbours tells: short lines and headings between long paragraphs, between
    # link blocks, and between long link lists.
    (4, 0, 0, 0, 60, 0, 0, 0, 0, 1, 1), (1, 0, 45, 0, 70, 0, 0, 0, 0, 1, 1),
    (3, 0, 60, 0, 50, 0, 0, 0, 0, 0, 1), (5, 0, 35, 0, 90, 0.1, 0, 0, 0, 0, 1),
    (2, 0, 80, 0.1, 40, 0, 0, 0, 1, 0, 1), (6, 0, 25, 0, 30, 0, 0, 0, 1, 0, 1),
    (4, 0, 6, 0, 55, 0, 0, 0, 0, 1, 1), (3, 0, 30, 0, 28, 0.05, 0, 0, 0, 1, 1),
    (5, 0.2, 40, 0, 36, 0, 0, 0, 0, 0, 1), (2, 0, 22, 0, 120, 0, 0, 0, 0, 0, 1),
    (4, 0, 50, 1, 40, 1, 0, 0, 0, 0, 0), (3, 0, 30, 0.9, 45, 0.9, 0, 0, 0, 1, 0),
    (5, 0, 8, 1, 60, 1, 0, 0, 0, 0, 0), (2, 0, 60, 0, 40, 1, 0, 0, 0, 0, 0),
    (6, 0, 4, 0.8, 35, 0.9, 0, 0, 1, 0, 0), (3, 0, 0, 0, 30, 1, 0, 0, 0, 0, 0),
    (4, 0, 5, 0, 4, 0, 0, 0, 0, 0, 0), (2, 0, 3, 0, 2, 0, 0, 0, 0, 0, 0),
    (5, 0, 6, 1, 3, 0, 0, 0, 0, 0, 0), (3, 0, 40, 0, 2, 0, 0, 0, 0, 0, 0),
    # Link blocks: long ones outside the main element, paragraphs of one link in it, asides in it.
    (9, 1, 4, 1, 8, 1, 0, 0, 0, 0, 0), (15, 1, 30, 0, 20, 0, 0, 0, 0, 0, 0),
    (30, 0.95, 60, 0, 12, 0, 0, 0, 0, 0, 0), (12, 1, 9, 1, 0, 0, 0, 0, 0, 0, 0),
    (8, 1, 40, 0, 0, 0, 0, 0, 1, 0, 0), (10, 0.8, 2, 0, 45, 0, 0, 0, 0, 0, 0),
    (20, 0.9, 0, 0, 70, 0, 0, 0, 0, 0, 0), (11, 1, 12, 1, 10, 0, 0, 0, 1, 0, 0),
    (40, 1, 25, 0, 60, 0, 0, 0, 0, 0, 0), (70, 0.9, 9, 1, 0, 0, 0, 0, 1, 0, 0),
    (2, 1, 30, 0, 40, 0, 0, 1, 0, 0, 1), (4, 1, 50, 0, 9, 0, 0, 1, 0, 0, 1),
    (12, 1, 35, 0, 25, 0, 0, 1, 0, 0, 1), (9, 0.7, 20, 0, 0, 0, 0, 1, 0, 0, 1),
    (8, 1, 60, 0, 9, 1, 1, 1, 0, 0, 0), (14, 1, 8, 1, 40, 0, 1, 1, 1, 0, 0),
    (6, 0.9, 30, 0, 20, 0, 1, 1, 0, 0, 0), (20, 0.8, 5, 0, 50, 0, 1, 1, 0, 0, 0),
    (40, 0.1, 50, 0, 7, 1, 1, 1, 0, 0, 0), (10, 1, 3, 1, 2, 1, 1, 0, 1, 0, 0),
)


@lru_cache(maxsize=4)
def train(labelled: tuple = LABELLED, depth: int = 6):
    table = np.array(labelled, float)
    return grow(table[:, :-1], table[:, -1], depth)


def main_text(html: str | None, tree) -> str:
    found = blocks(html)
    if not found:
        return ""
    keep = predict(tree, features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep) if k)


_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
                   ("n_chars", pa.int64())])


def extract(pages: DataFrame, labelled: tuple = LABELLED) -> DataFrame:
    """page_id, url, text and n_chars of every page's main text, from the whole html.

    One row per input row, repeated ones and null ids included; null or empty html gives an empty
    text. White space inside a block is one space and blocks are joined by one line break.
    """
    tree = train(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, pages_ in rows(batches):
            texts = [main_text(h, tree) for h in pages_]
            yield record(_PAGE, [ids, urls, texts, [len(t) for t in texts]])

    return (pages.select(F.col("page_id").cast("bigint").alias("page_id"),
                         F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint"))
