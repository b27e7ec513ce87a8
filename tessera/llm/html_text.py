"""Main text of web pages from streaming parser events.

The standard library's parser reports tags and text; nothing is kept of the page but a list of
lines (blocks of running text), each with its length, the tags in it and the elements around it.
The lines' text-to-tag ratios are smoothed by a Gaussian and cut at a threshold; the lines above
it form the content clusters.  The main element or the articles that hold most of the clusters'
text, else the innermost element around all clusters, are the content region: all of its lines and
all clusters beside it are kept that no menu, advert, form or the like encloses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option optgroup p pre section select summary table tbody td template tfoot th thead title tr ul".split()
)
#: Elements whose text is never part of the article.
OUTSIDE = frozenset("head title script style noscript template nav footer aside form button select option textarea input label fieldset iframe object svg canvas dialog menu audio video map".split())
#: Words of class, id and role that mark such elements.
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead banner footer foot contentinfo sidebar sidebars aside complementary widget widgets rail related recommended ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup signin login register search form comment comments commentlist disqus reply replies respond discussion share sharing social toolbar pagination pager skip hidden".split()
)
#: A head of a page, but not of an article.
HEADS = frozenset({"header"})
CLOSES_P = BLOCK - {"option", "optgroup", "legend", "summary", "caption"}
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table menu dir select html body article section div".split())
#: Elements that hold a line, not a region.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd a b i em strong span font".split())
SPACE = re.compile(r"\s+")


class PageLines(HTMLParser):
    """Turns parser events into lines: [text, tags, region path, kept]."""

    def __init__(self, wrappers: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.wrappers = wrappers  # numbers of elements whose marks don't count
        self.marked: set[int] = set()
        self.never: set[int] = set()  # elements whose text is not shown or never an article's
        self.open: list[tuple[str, int, bool]] = []  # tag, number, outside the article
        self.lines: list[tuple[str, int, tuple[int, ...], bool]] = []
        self.linked: list[bool] = []  # by line: nothing but links
        self.plain = False
        self.tag_of: list[str] = []  # by element number
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, tuple(n for _, n, _ in self.open), not (self.open and self.open[-1][2])))
            self.linked.append(not self.plain)
            self.tags = 0
        self.text, self.plain = [], False

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            if self.open[-1][0] in BLOCK:
                self.flush()
            self.open.pop()

    def is_outside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in OUTSIDE and tag != "form":
            self.never.add(len(self.tag_of))
            return True
        inside = any(t in ("article", "main") for t, _, _ in self.open)
        if tag in HEADS and not inside:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        mark = tag == "form"
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                self.never.add(len(self.tag_of))
                return True
            if name in ("class", "id", "role"):
                words = set(re.split(r"[^a-z0-9]+", value))
                if words & MARKS or words & HEADS and not inside and not words & {"article", "entry", "post", "content"}:
                    mark = True
        if mark:
            self.marked.add(len(self.tag_of))
        return mark and len(self.tag_of) not in self.wrappers

    def page_wrappers(self) -> frozenset[int]:
        """Marked elements that hold the page's text: half of it with a first heading or a main element,
        or four fifths of it with no heading, article or main element beside them."""
        mass: Counter = Counter()
        total = 0
        for text, _, path, _ in self.lines:
            if not self.never.intersection(path):
                total += len(text)
                mass.update(dict.fromkeys(path, len(text)))
        heads = {n for *_, path, _ in self.lines if any(self.tag_of[n] in ("h1", "main") for n in path) for n in path}
        own = [set(path) for *_, path, _ in self.lines if any(self.tag_of[n] in ("h1", "main", "article") for n in path)]
        return frozenset(n for n in self.marked if 2 * mass[n] >= total > 0 and n in heads or 5 * mass[n] >= 4 * total > 0 and all(n in path for path in own))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID:
            if tag in BLOCK:
                self.flush()
            return
        if tag in CLOSES_P:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    self.close_to(k)
                    break
                if self.open[k][0] in SCOPES:
                    break
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in SAME_LEVEL.get(tag, ()):
                self.close_to(k)
                break
            if self.open[k][0] in SCOPES:
                break
        if tag in BLOCK:
            self.flush()
        outside = bool(self.open and self.open[-1][2]) or self.is_outside(tag, attrs)
        self.open.append((tag, len(self.tag_of), outside))
        self.tag_of.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # browsers take <div/> as <div>; only void elements end at once
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.close_to(k)
                return
            if self.open[k][0] in ("article", "main", "body", "table") and tag in ("p", "li", "b", "i", "a", "span", "em", "strong"):
                break
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        # markup of elements left out must not count as text between blocks
        if not (self.open and self.open[-1][0] in ("script", "style")):
            self.plain = self.plain or bool(data.strip()) and not any(t == "a" for t, _, _ in self.open)
            if self.open and self.open[-1][2] and self.open[-1][0] not in BLOCK:
                self.skip_inline(data)
            else:
                self.text.append(data)

    def skip_inline(self, data: str) -> None:
        """An inline element left out (a button, a label) parts words, no more."""
        if not any(t in BLOCK and out for t, _, out in self.open):
            self.text.append(" ")
        else:
            self.text.append(data)


def content_lines(lines: list[tuple[str, int, tuple[int, ...], bool]], tag_of: list[str], linked: list[bool], sigma: float = 1.0) -> list[str]:
    """Lines of the content region, in page order.  Lines of links alone are no clusters."""
    if not any(kept for *_, kept in lines):
        return []
    # lines of enclosed menus and the like add nothing but their tags
    ratio = [len(text) / (tags + 1) if kept else 0.0 for text, tags, _, kept in lines]
    reach = max(1, math.ceil(3 * sigma))
    weight = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(ratio)):
        near = [(weight[j - i + reach], ratio[j]) for j in range(max(0, i - reach), min(len(ratio), i + reach + 1))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    threshold = min(spread, mean)
    clusters = [kept and s >= threshold and not link for (*_, kept), s, link in zip(lines, smooth, linked, strict=True)]
    paths = [path for (_, _, path, _), c in zip(lines, clusters, strict=True) if c]
    total, marked = 0, {"main": 0, "article": 0}
    for (text, _, path, _), c in zip(lines, clusters, strict=True):
        if c:
            total += len(text)
            for tag in {tag_of[n] for n in path} & marked.keys():
                marked[tag] += len(text)
    # main elements or articles with half of the text, else the innermost element around all clusters
    tag = next((t for t in marked if marked[t] and 2 * marked[t] >= total), None)
    around = [n for n in paths[0] if all(n in p for p in paths) and tag_of[n] not in LINES] if paths else []
    region = {n for p in paths for n in p if tag_of[n] == tag} if tag else set(around[-1:])
    # beside the element with four fifths of the text, lines of links alone are a menu
    mass: Counter = Counter()
    for (text, _, path, _), c in zip(lines, clusters, strict=True):
        if c:
            mass.update(dict.fromkeys(path, len(text)))
    core = max((n for n, m in mass.items() if 5 * m >= 4 * total and tag_of[n] not in LINES), default=None)
    return [
        text
        for (text, _, path, kept), c, link in zip(lines, clusters, linked, strict=True)
        if kept and (c or not region or region.intersection(path) and (tag or not link or core in path))
    ]


def main_text(html: str) -> str:
    """The article's blocks, with two line ends between them."""
    page = PageLines()
    while True:
        page.feed(html)
        page.close()
        page.close_to(0)
        page.flush()
        # a mark on what holds most of the page is no mark
        wrappers = page.page_wrappers()
        if wrappers <= page.wrappers:
            break
        page = PageLines(wrappers | page.wrappers)
    return "\n\n".join(content_lines(page.lines, page.tag_of, page.linked))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Returns ``id_col``, ``url_col`` and ``text``: the main text of each page's whole html.

    Character references are decoded, white space inside a block becomes one space, and blocks
    are joined by two line ends in page order.  Menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and reader comments are left out.  Pages pass through one map
    without a shuffle.  A null or empty page, and one without an article, gives an empty text; a
    null id or url stays null; repeated rows are answered alike; an empty table gives an empty
    result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({id_col: batch["id"], url_col: batch["url"], "text": [main_text(h) for h in batch["html"]]})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInPandas(run, f"`{id_col}` long, `{url_col}` string, text string")
