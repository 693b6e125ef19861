"""Operator 2: main text of web pages by line-block distribution.

1. Markup is stripped to lines: every border of a block element and every
   line break ends a line. Text of elements that hold no article text
   (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
   styles, reader comments; by tag, role or the words of class and id) counts
   zero and leaves an empty line, so that it opens a gap. Lines of links only
   count zero too, and so do ``WINDOW`` blank lines between two texts, counted
   by element borders or by line ends of the page, whichever are more.
2. The length of a line block is the sum of the text lengths over a window of
   ``WINDOW`` lines. A surge is a line with text whose block is long enough
   and not followed by a gap at once; a dive is the next gap. The text from
   the first line after the last gap before a surge up to its dive is kept.
   An article or main element is one more signal: inside it element borders
   open no gap (its end does), and while a text inside has a surge, texts outside need a
   block ``OUTSIDE`` times as long.
   Short texts and lines of links belong to the kept text if they lie between
   kept runs (links only as an element of the same container), if their block
   stands in the container of a kept line, or if they head a kept run.
3. If no block is long enough, the run with most text is kept, text inside
   article or main counting ``OUTSIDE`` times. If there are links only, they are the text.

White space inside a line becomes one space, lines are trimmed and joined by
one line break; character references are decoded once, after the markup is
gone. Null html counts as empty: empty text. Paragraphs, list items and cells
end where the next begins, a paragraph also at any block; other unclosed
elements end with their container or the page. Repeated rows give repeated rows, extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from media_forecast.shipping import ship_package

WINDOW = 3  # lines in a block
SURGE = 60  # characters of a block at a surge
OUTSIDE = 4  # times as long a block beside an article with a surge

# Element names of HTML.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.DOTALL,
)
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "math", "canvas", "object", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr",
}
ASIDE = {"nav", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "fieldset", "datalist", "option"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Blocks of text; what holds them is the container.
TEXT_BLOCKS = HEADINGS | {"p", "pre", "blockquote", "li", "dt", "dd", "td", "th", "tr", "caption", "figcaption", "summary", "center"}
# Elements that end an open paragraph.
PARAGRAPH_ENDS = HEADINGS | {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dt", "dd", "fieldset", "figcaption", "figure",
    "footer", "form", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul",
}
# Elements that end an open one of these kinds in the same list or table.
SIBLING_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog"}
ASIDE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "topbar",
    "footer", "sidebar", "aside", "widget", "related", "recommended", "share", "sharing", "social", "cookie", "cookies",
    "consent", "notice", "popup", "modal", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form",
    "comment", "comments", "disqus", "respond", "replies",
}
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"\s+")


def is_aside(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in ASIDE or tag == "header" and not in_main:
        return True
    if not attributes or tag in MAIN or tag in ("html", "body", "h1"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        words = set(re.split(r"[^a-z]+", value)) - {""}
        # The id of a heading or section is often made of its title: a word of it says nothing.
        if name == "id" and (tag in HEADINGS or tag == "section" and not words <= ASIDE_WORDS):
            continue
        if name in ("class", "id") and ASIDE_WORDS & words:
            return True
        if name == "role" and value in ASIDE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Line(NamedTuple):
    """A line of the page; a gap has no text."""

    text: str
    size: int  # characters that count for blocks: none if there are links only
    inside: bool  # of article or main
    container: int = 0  # number of the element that holds the line's block
    block: str = ""  # name of the block, empty for text of the container itself


def lines(page: str) -> list[Line]:
    """The lines with text and the gaps between them."""
    out: list[Line] = []
    parts: list[str] = []
    plain: list[str] = []  # the parts outside links
    open_tags: list[str] = []
    numbers: list[int] = []  # of the open elements
    count = 0
    aside_at: int | None = None  # depth of the outermost masked element
    main_depth = links = 0
    borders = ends = 0  # element borders and line ends since the last text

    def gap() -> None:
        out.append(Line("", 0, main_depth > 0))

    def add(chunk: str) -> None:
        nonlocal borders, ends
        if chunk.isspace():
            ends += chunk.count("\n")
        else:
            before = chunk[: len(chunk) - len(chunk.lstrip())].count("\n")
            if max(0 if main_depth else borders, ends + before) > WINDOW:
                flush()
                gap()
            borders, ends = 0, chunk[len(chunk.rstrip()):].count("\n")
        parts.append(chunk)
        if not links:
            plain.append(chunk)

    def flush() -> None:
        text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            only_links = len(plain) < len(parts) and not any(c.isalnum() for c in html.unescape("".join(plain)))
            k, block = len(open_tags), ""
            while k and (open_tags[k - 1] in INLINE or open_tags[k - 1] in TEXT_BLOCKS or open_tags[k - 1] == "a href"):
                k -= 1
                block = open_tags[k] if open_tags[k] in TEXT_BLOCKS else block
            out.append(Line(text, 0 if only_links else len(text), main_depth > 0, numbers[k - 1] if k else 0, block))
        parts.clear()
        plain.clear()

    def close() -> str:
        nonlocal aside_at, main_depth, links
        last = open_tags.pop()
        numbers.pop()
        if last == "a href":
            links -= 1
            last = "a"
        if last in MAIN and aside_at is None:
            main_depth -= 1
            gap()
        if aside_at is not None and len(open_tags) <= aside_at:
            aside_at = None
            gap()
        return last

    def end_before(ended: set[str], across: set[str]) -> None:
        """End the last open element of ``ended`` unless one that is not in ``across`` lies over it."""
        k = len(open_tags)
        while k and (open_tags[k - 1] in across or open_tags[k - 1] == "a href"):
            k -= 1
        if k and open_tags[k - 1] in ended:
            while len(open_tags) >= k:
                close()

    pos, size = 0, len(page)
    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            at = size
        if at > pos and aside_at is None:
            add(page[pos:at])
        if at == size:
            break
        m = TOKEN.match(page, at)
        if m is None:  # a bare sign
            if aside_at is None:
                add("<")
            pos = at + 1
            continue
        pos = m.end()
        if m.group(2) is None:
            continue
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if tag not in INLINE and aside_at is None:
            flush()
            borders += 1
        if closing:
            if tag not in open_tags and (tag != "a" or "a href" not in open_tags):
                continue
            while close() != tag:
                pass
            continue
        if tag in PARAGRAPH_ENDS:
            end_before({"p"}, INLINE)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, pos)
            pos = end.end() if end else size
            continue
        if tag in SIBLING_ENDS:
            for _ in range(2 if tag == "tr" else 1):  # the cell, then its row
                end_before(SIBLING_ENDS[tag], INLINE | {"p"})
        count += 1
        numbers.append(count)
        if tag == "a" and re.search(r"(?i)\bhref\b", attributes):
            open_tags.append("a href")
            links += 1
        else:
            open_tags.append(tag)
        if aside_at is None:
            if is_aside(tag, attributes, main_depth > 0):
                flush()
                aside_at = len(open_tags) - 1
            elif tag in MAIN:
                main_depth += 1
    if aside_at is None:
        flush()
    return out


def surges(rows: list[Line]) -> list[tuple[int, int]]:
    """(first line, dive) of each run of lines that is kept."""
    runs, k = [], 0
    while k < len(rows):
        if not rows[k].size:
            k += 1
            continue
        dive = k
        while dive < len(rows) and rows[dive].size and rows[dive].inside == rows[k].inside:
            dive += 1
        sizes = [r.size for r in rows[k:dive]]
        runs.append((k, dive, max(sum(sizes[j: j + WINDOW]) for j in range(len(sizes))), sum(sizes), rows[k].inside))
        k = dive
    beside = any(inside and block >= SURGE for _, _, block, _, inside in runs)
    kept = [r for r in runs if r[2] >= SURGE * (OUTSIDE if beside and not r[4] else 1)]
    kept = kept or sorted(runs, key=lambda r: (-r[3] * (OUTSIDE if r[4] else 1), r[0]))[:1]
    return [r[:2] for r in kept]


def belonging(rows: list[Line], runs: list[tuple[int, int]]) -> list[int]:
    """The lines of the kept runs and the short ones that belong to them."""
    kept = {j for first, dive in runs for j in range(first, dive)}
    homes = {rows[j].container for j in kept}
    first, last = min(kept, default=0), max(kept, default=-1)
    for j, r in enumerate(rows):
        home = r.container in homes
        if r.text and (r.size and (home or first < j < last) or home and r.block):
            kept.add(j)
    heads = None  # next kept line, if only headings lie between
    for j in range(len(rows) - 1, -1, -1):
        if j in kept:
            heads = j
        elif rows[j].text:
            if heads is not None and rows[j].block in HEADINGS:
                kept.add(j)
            else:
                heads = None
    return sorted(kept)


def main_text(page: str | None) -> str:
    """Text between the surges and dives of the line-block distribution."""
    rows = lines(page or "")
    if not any(r.size for r in rows):  # links only
        rows = [r._replace(size=len(r.text)) for r in rows]
    return "\n".join(rows[j].text for j in belonging(rows, surges(rows)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    ship_package(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
