"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams a page's events; nothing of a tree is kept but the open
elements. Every block of text is a line with a ratio: its characters per tag. The
ratios are smoothed with a Gaussian over neighbouring lines and split into two clusters by a
threshold; lines above it are content. Content is then widened from lines to the regions they
stand in, so that a short paragraph or a heading among long ones stays: an article or main element if it
holds content, else the containers in which most text is content.

Elements that are never article text by their name or role (menus, headers, footers, asides,
forms, scripts, styles) are left out beforehand. Words of a class or id (sidebar, advert, comments) only
speak against an element: it stays if it holds an article or most of the text, or reads like the
article it is in. In an article they do not touch headings, paragraphs and parts of a line.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm.common import free_name

# Gaussian: standard deviation in lines, and how far it reaches
SIGMA = 1.0
REACH = 3

# Elements by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol option p pre search section select summary table tbody td tfoot th thead "
    "title tr ul".split())
DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form head header iframe "
    "input math menu nav noembed noframes noscript object optgroup option script search select style svg "
    "template textarea title video".split())
DROPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog directory form menu menubar "
    "navigation search status tablist toolbar".split())
# words of a class or id that mark what is not article text
DROPPED_WORDS = frozenset(
    "ad ads adbox adsense adslot adsbygoogle advert adverts advertisement advertisements advertising aside banner "
    "banners blogroll breadcrumb breadcrumbs byline captcha comment commentlist comments consent cookie "
    "cookies copyright disclaimer discussion disqus dropdown feedback flash follow footer foot form gdpr "
    "header hidden legal login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "notification outbrain overlay pager paging pagination paywall popular popup privacy promo "
    "promos promoted promotion rail recommend recommendations recommended register related replies reply respond "
    "responses search share sharing sidebar sidenav signup skip skyscraper social sponsor sponsored sponsors "
    "subscribe subscription taboola tagcloud teaser teasers toolbar topbar trending widget "
    "widgets".split())
# of these, the ones that mark other people's text, which may read like an article
COMMENT_WORDS = frozenset(
    "comment commentlist comments disqus replies reply respond responses".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# of these, the ones that also hold for an article or main element
DROPPED_ARTICLES = frozenset(
    "ad ads advert advertisement comment comments promo promoted related reply sponsored "
    "teaser".split())
MAIN_WORDS = frozenset(
    "article articlebody articlecontent articletext blogpost content entry maincontent main maintext post "
    "postbody postcontent story storybody".split())
# an open element that a new one of the group closes, unless a container of the third kind is between
CLOSES = {
    "li": ("li", "ol ul menu dir".split()), "dt": ("dt dd".split(), ["dl"]),
    "dd": ("dt dd".split(), ["dl"]), "tr": ("tr td th".split(), ["table"]),
    "td": ("td th".split(), ["tr", "table"]), "th": ("td th".split(), ["tr", "table"]),
    "option": (["option"], ["select", "datalist"]),
}

_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Element:
    __slots__ = ("tag", "dropped", "mute", "main", "rank", "region", "doubt")

    def __init__(self, tag, dropped, mute, main, rank, region, doubt):
        self.tag, self.dropped, self.mute = tag, dropped, mute
        self.main, self.rank, self.region, self.doubt = main, rank, region, doubt


class PageLines(HTMLParser):
    """Lines of a page: [text, tags, dropped, number and rank of the main element, region, doubt].

    A doubt is the number of the innermost element whose class or id speaks against it; ``doubts`` has
    for each (the doubt around it, the main element around it, whether for a comment word),
    the outer before the inner. ``doubted`` are the main elements that are in doubt themselves.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, int, int, int]] = []
        self.doubts: list[tuple[int, int, bool]] = [(0, 0, False)]
        self.doubted: set[int] = set()
        self._open = [_Element("", False, False, 0, 0, 0, 0)]
        self._owner = self._open[0]
        self._parts: list[str] = []
        self._tags = 1
        self._count = 0

    def read(self, html: str) -> list[tuple]:
        """Feed a whole page; a broken declaration is skipped, an open comment runs to the end."""
        comment = html.rfind("<!--")
        if comment >= 0 and not any(end in html[comment:] for end in ("-->", "</script")):
            html = html[:comment]
        while True:
            try:
                self.feed(html)
                self.close()
                break
            except AssertionError:
                rest = self.rawdata
                self.rawdata = ""
                html = rest[max(2, rest.find(">") + 1):]
        self._flush()
        return self.lines

    def _flush(self):
        text = " ".join("".join(self._parts).split())
        if text:
            e = self._owner
            self.lines.append((text, self._tags, e.dropped, e.main, e.rank, e.region, e.doubt))
        self._parts, self._tags = [], 1

    def _pop_to(self, index: int):
        if any(e.tag in BLOCK for e in self._open[index:]):
            self._flush()
        del self._open[index:]

    def _close_within(self, tags, barriers) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            tag = self._open[i].tag
            if tag in tags:
                self._pop_to(i)
                return
            if tag in barriers:
                return

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self._tags += 1
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag in CLOSES:
            self._close_within(*CLOSES[tag])
        if tag in BLOCK:
            if tag not in ("option", "select"):
                self._close_within(("p",), ("button", "td", "th", "caption", "object", "div",
                                            "section", "article", "main", "body", "li"))
            self._flush()
        self._tags += 1
        top = self._open[-1]
        dropped, rank, against = top.dropped, 0, frozenset()
        if not dropped:
            dropped, rank, against = self._judge(tag, attrs, top.main > 0)
        main, kept = top.main, top.rank
        # the outermost article or main element counts; a better one inside replaces a lesser one
        if rank > kept:
            self._count += 1
            main, kept = self._count, rank
        doubt = top.doubt
        if against:
            self.doubts.append((top.doubt, top.main, bool(against & COMMENT_WORDS)))
            doubt = len(self.doubts) - 1
            if main != top.main:
                self.doubted.add(main)
        region = top.region
        if tag in BLOCK and tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd",
                                        "blockquote", "pre", "tr", "td", "th", "tbody", "thead"):
            self._count += 1
            region = self._count
        # inside of a line, what is left out has no line of its own: its text is not read
        mute = top.mute or dropped and not top.dropped and tag not in BLOCK
        self._open.append(_Element(tag, dropped, mute, main, kept, region, doubt))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            # "/>" closes nothing in HTML but an element of another language
            if tag in ("svg", "math", "path", "use"):
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._tags += 1
        if tag == "br":
            self.handle_data(" ")
            return
        inline = tag not in BLOCK and tag not in DROPPED
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                self._pop_to(i)
                return
            if inline and self._open[i].tag in BLOCK:
                return
        if tag == "p":
            self._flush()

    def handle_data(self, data):
        top = self._open[-1]
        if not top.mute:
            if not self._parts:
                data = data.lstrip()
                self._owner = top
            if data:
                self._parts.append(data)

    def unknown_decl(self, data):
        pass

    @staticmethod
    def _judge(tag: str, attrs, within: bool) -> tuple[bool, int, frozenset | set]:
        """Whether an element is left out, its rank as a main element and the words against it.

        ``within``: it stands in a main element.
        """
        none = frozenset()
        if tag in DROPPED:
            return True, 0, none
        rank = {"article": 3, "main": 2}.get(tag, 0)
        if not attrs:
            return False, rank, none
        words: set[str] = set()
        heading = tag in HEADINGS
        for name, value in attrs:
            if name in ("class", "id"):
                # the id of a heading is made from its text
                if not (heading and name == "id"):
                    words.update(w.lower() for w in _WORDS.findall(value or ""))
            elif name == "role":
                roles = set((value or "").lower().split())
                if roles & DROPPED_ROLES:
                    return True, 0, none
                rank = max(rank, 3 * ("article" in roles), 2 * ("main" in roles))
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return True, 0, none
            elif name == "style" and _HIDDEN.search(value or ""):
                return True, 0, none
            elif name == "itemprop" and (value or "").lower() == "articlebody":
                rank = max(rank, 3)
        against = none
        if tag in BLOCK and tag not in ("html", "body") and not (
                within and (heading or tag == "p")):
            against = words & (DROPPED_ARTICLES if rank > 1 else DROPPED_WORDS)
        if not rank and not against and tag in ("div", "section", "td") and words & MAIN_WORDS:
            rank = 1
        return False, rank, against


def smooth(ratios: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    """A Gaussian mean over neighbouring lines; at the ends, over the lines there are."""
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratios)
    full = np.convolve(ratios, kernel)[reach:reach + n]
    return full / np.convolve(np.ones(n), kernel)[reach:reach + n]


def threshold(values: np.ndarray) -> float:
    """The border between two clusters of values: the midpoint of their means (two-means)."""
    border = float(values.mean())
    for _ in range(50):
        high = values >= border
        if high.all() or not high.any():
            break
        moved = float(values[high].mean() + values[~high].mean()) / 2
        if math.isclose(moved, border):
            break
        border = moved
    return border


def left_out(page: PageLines) -> list[bool]:
    """By doubt, whether its element is left out.

    An element stays if it holds an article or main element that is not much shorter than the longest, or
    most of the text. Inside a main element, it stays if it has half as many characters per tag
    as the rest of that has; comments go.
    """
    within: list[Counter] = [Counter() for _ in page.doubts]  # characters by main element
    tags, own_tags = [0] * len(page.doubts), Counter()
    articles, mains, total = Counter(), Counter(), 0
    for text, n_tags, dropped, main, rank, _, doubt in page.lines:
        if dropped:
            continue
        within[doubt][main] += len(text)
        tags[doubt] += n_tags
        own_tags[main] += n_tags
        mains[main] += len(text)
        total += len(text)
        if rank > 1 and main not in page.doubted:
            articles[main] += len(text)
    for d in range(len(page.doubts) - 1, 0, -1):  # the inner before the outer
        outer = page.doubts[d][0]
        within[outer].update(within[d])
        tags[outer] += tags[d]
    most = max(articles.values(), default=0)
    out = [False] * len(page.doubts)
    for d in range(1, len(page.doubts)):
        outer, main, comments = page.doubts[d]
        size = sum(within[d].values())
        held = any(m != main and 4 * articles[m] >= most for m in within[d] if m in articles)
        if held or 2 * size > total and not (comments and main):
            continue
        rest, rest_tags = mains[main] - within[d][main], own_tags[main] - tags[d]
        out[d] = out[outer] or comments or not main or 2 * size * rest_tags < rest * tags[d]
    for d in range(1, len(page.doubts)):
        out[d] = out[d] or out[page.doubts[d][0]]
    return out


def main_text(html: str | None) -> str:
    """The blocks of the main text joined by blank lines; empty if there is none."""
    page = PageLines()
    lines = page.read(html or "")
    if page.doubts[1:]:
        out = left_out(page)
        lines = [(*line[:2], line[2] or out[line[6]], *line[3:]) for line in lines]
    if not any(not line[2] for line in lines):
        return ""
    sizes = np.array([len(line[0]) for line in lines], float)
    ratios = smooth(sizes / np.array([line[1] for line in lines]))
    content = ratios >= threshold(ratios)
    open_lines = np.array([not line[2] for line in lines])
    content &= open_lines
    mains = np.array([line[3] for line in lines])
    ranks = np.array([line[4] for line in lines])
    total = sizes[open_lines].sum()
    for rank in (3, 2, 1):
        of_rank = open_lines & (ranks == rank)
        if not of_rank.any():
            continue
        inside = {m: sizes[of_rank & (mains == m)].sum() for m in set(mains[of_rank].tolist())}
        most = max(inside.values())
        # a main element counts if it has content lines; the one with the most text if it has half of all
        chosen = [m for m, size in inside.items()
                  if (content & (mains == m)).any() and 4 * size >= most
                  or size == most and 2 * size >= total]
        if chosen:
            keep = open_lines & np.isin(mains, chosen)
            break
    else:
        regions = np.array([line[5] for line in lines])
        keep = np.zeros(len(lines), bool)
        for r in set(regions[open_lines].tolist()):
            own = open_lines & (regions == r)
            if 2 * sizes[own & content].sum() >= sizes[own].sum():
                keep |= own
        if not keep.any():
            keep = open_lines
    return "\n\n".join(line[0] for line, kept in zip(lines, keep) if kept)


def extracted(html: Column) -> Column:
    """``main_text`` of a column of pages."""

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return texts(html)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of ``pages`` without the html but with their main ``text``.

    NULL and empty pages, and pages without text outside of what is left out, give an empty text. Each
    page is read as a whole and by itself: repeated rows give equal texts.
    """
    out = free_name(pages.drop(html), "text")
    return pages.withColumn(free_name(pages, "_main"), extracted(F.col(html))).select(
        *[c for c in pages.columns if c != html],
        F.col(free_name(pages, "_main")).alias(out))
