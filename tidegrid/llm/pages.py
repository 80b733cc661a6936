"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams events. A line is a block of the page: the text
between two block-level tags, with white space made one space. Each line has the ratio of
its text to its tags; ratios are smoothed by a Gaussian, and lines at or above the
threshold (the spread of the smoothed ratios) are clusters of content. The content region
is every article or main element where these hold 30 percent of the selected text, else the
innermost element that holds all selected lines and not only one line. All its lines stay,
short ones too, but for those in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments. No selected line is taken for an outlier: what tells a
stray line from a headline or a lead is its element, by the same list.

Defined results: null or empty html, and pages without such a line, give empty text;
broken markup is read as far as the parser goes, unclosed elements end with their parent;
a line break tag is white space. Pages are read whole and are independent of each other.
"""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import field, map_texts

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section
select summary table tbody td tfoot th thead title tr ul""".split())
SKIPPED = frozenset("""script style noscript template head title nav aside footer form button select textarea menu
dialog iframe object svg canvas audio video datalist fieldset""".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar "
                          "form tablist status".split())
SKIPPED_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted
nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer sidebar rail
widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
search social share sharing related recommended recommendations outbrain taboola comment comments reply replies respond
disqus copyright""".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
ENDS_P = BLOCK - {"option", "legend", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
          "th": {"tr", "table"}, "option": {"select"}}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names(value: str | None) -> list[str]:
    return [w.lower() for w in NAME.findall(value or "")]


class _Element:
    __slots__ = ("tag", "parent", "skipped", "article", "inline", "depth")

    def __init__(self, tag, parent, skipped, article):
        self.tag, self.parent, self.skipped, self.article = tag, parent, skipped, article
        # A skipped element inside a line leaves the line, without cutting it.
        self.inline = parent is not None and (parent.inline or skipped and not parent.skipped and tag not in BLOCK)
        self.depth = parent.depth + 1 if parent else 0


class Lines(HTMLParser):
    """Collects lines: (text, tags, element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = _Element("", None, False, False)
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, _Element]] = []

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.at))
                self.tags = 0
            self.parts.clear()

    def pop(self):
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag in BLOCK:
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK:
            self.flush()
            if tag in ENDS_P and self.open.get("p"):
                self._close("p", {"td", "th", "li", "article", "section", "div", "body"})
            if tag in SIBLINGS:
                for other in SIBLINGS[tag]:
                    if self.open.get(other):
                        self._close(other, LIMITS[tag])
        parent = self.at
        article = parent.article or tag in ("article", "main")
        skipped = parent.skipped or self._skips(tag, dict(attrs), parent)
        self.at = _Element(tag, parent, skipped, article)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _skips(self, tag, attrs, parent) -> bool:
        if tag in SKIPPED or tag == "header" and not parent.article:
            return True
        if not attrs:
            return False
        style = (attrs.get("style") or "").replace(" ", "").lower()
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in style:
            return True
        if (attrs.get("role") or "").lower() in SKIPPED_ROLES:
            return True
        words = COMMENT_WORDS if tag in ("article", "main") else SKIPPED_WORDS
        if tag in ("html", "body", "a", "span", "b", "i", "em", "strong", "h1"):
            return False
        for key in ("class", "id"):
            for name in (attrs.get(key) or "").split():
                found = _names(name)
                if any(w in words and not (i and found[i - 1] in ("has", "no", "with", "without", "article", "entry", "post")
                                           and w not in COMMENT_WORDS)
                       for i, w in enumerate(found)):
                    return True
        return False

    def _close(self, tag, limits):
        """End the nearest open ``tag`` unless one of ``limits`` lies between."""
        e = self.at
        while e.parent is not None and e.tag != tag:
            if e.tag in limits:
                return
            e = e.parent
        while self.at is not e:
            self.pop()
        if e.parent is not None:
            self.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if self.open.get(tag):
            while self.at.tag != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        if not self.at.inline:
            self.parts.append(data)


def smoothed(ratios: np.ndarray, radius: int) -> np.ndarray:
    """Gaussian smoothing over the lines; weights beyond an edge are left out."""
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-offsets ** 2 / (2 * max(radius / 2, 0.5) ** 2))
    whole = np.convolve(ratios, kernel)[radius:radius + len(ratios)]
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius:radius + len(ratios)]
    return whole / weight


def selected(lines, radius: int) -> np.ndarray:
    """Which lines the ratio takes for content."""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in lines], float)
    smooth = smoothed(ratios, radius)
    return smooth >= smooth.std()


def _article(e: _Element) -> _Element | None:
    """The outermost article or main element around ``e``."""
    found = None
    while e is not None:
        if e.tag in ("article", "main"):
            found = e
        e = e.parent
    return found


def _common(a: _Element, b: _Element) -> _Element:
    """The innermost element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def _region(lines, chosen):
    """The elements whose lines stay."""
    fine = [i for i, (_, _, e) in enumerate(lines) if not e.skipped]
    if not fine:
        return []
    picked = [i for i in fine if chosen[i]] or fine
    article = {i: _article(lines[i][2]) for i in fine}
    total = sum(len(lines[i][0]) for i in picked)
    if sum(len(lines[i][0]) for i in picked if article[i]) >= 0.3 * total:
        return [e for e in article.values() if e]
    region = reduce(_common, (lines[i][2] for i in picked))
    # One line is never a region: the heading and the paragraphs beside it belong to it.
    around = sorted((_common(lines[i][2], region) for i in fine), key=lambda e: e.depth)
    return [around[-2] if len(around) > 1 else region]


def main_text(html: str | None, radius: int = 2) -> str:
    """The main text of one page, one line per block."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    region = set(_region(lines, selected(lines, radius)))
    out = []
    for text, _, e in lines:
        if e.skipped:
            continue
        up = e
        while up is not None and up not in region:
            up = up.parent
        if up is not None:
            out.append(text)
    return "\n".join(out)


def extract(df: DataFrame, keep, html: str = "html", out: str = "text", radius: int = 2) -> DataFrame:
    """``keep`` plus the main text of every page."""
    def start():
        return lambda pages: [[main_text(p, radius) for p in pages]]
    return map_texts(df, keep, html, [field(out, "string")], start)


def page_texts(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(df, ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
