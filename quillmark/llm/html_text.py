"""Main text of web pages from text-to-tag ratios.

A page is fed in pieces to the standard library's HTML parser.  Its events form
lines, one per block element (or <br>): the line's text and the number of tags
met for it.  Lines of elements that cannot be content (navigation, headers,
footers, asides, forms, scripts, adverts, notices, reader comments, by element,
role, class or id) count as tags only.  A class or id word or a form leaves out
nothing by itself: once the page is read, its mark is dropped where it holds an
article or main element or at least half of the page's text.  A whole class or id
("comments"; "has-sidebar" is only a part) keeps its mark if the page has an
article or main element under no such mark.  The ratio of text to tags per line is
smoothed with a Gaussian; lines above a threshold (a share of the ratios'
standard deviation, by their own ratio and the smoothed one) form the content
cluster.  The regions with a line of that cluster are the main content, and all
their lines are kept, short ones too.  A region is the nearest section around a
line; an article or main element is one region with all it holds, which is the
only say these tags have in the choice.

Defined cases: null, empty or text-free html gives an empty text; unclosed
elements end with their parent; repeated rows and null ids are treated alone;
an empty table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_CHARS = 1 << 16
SIGMA = 1.0
THRESHOLD = 0.5
MAX_LINKS = 0.6

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre "
    "section select summary table tbody td textarea tfoot th thead title tr ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold no main text.
OUTSIDE = set(
    "head title nav footer aside script style noscript template button select option textarea input label "
    "fieldset iframe object svg canvas audio video dialog menu".split())
#: Roles of the same kind.
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words in a class or id that mark such an element.
OUTSIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login "
    "register paywall menu nav navbar navigation topbar toolbar breadcrumb breadcrumbs sidebar sidebars aside widget "
    "widgets footer masthead comment comments commentlist disqus reply replies respond share sharing social related "
    "recommended recommendations pagination pager search searchbox form skip copyright disclaimer hidden".split())
#: An element of these may be a page's header or an article's; only headings of the latter count.
HEADER_WORDS = {"header", "pageheader", "siteheader"}
ARTICLES = {"article", "main"}
SECTIONS = ARTICLES | {"section", "div", "td", "body"}
#: Starting one of these ends an open one of the same set.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WORD = re.compile(r"[a-z]+")
#: A class word or form that holds this share of the page's text does not leave it out.
MOST = 0.5


class Line:
    __slots__ = ("parts", "some", "tags", "link_chars", "region")

    def __init__(self):
        self.parts: list = []
        self.some = False
        self.tags = self.link_chars = 0
        self.region = 0


class Element:
    __slots__ = ("tag", "outside", "header", "region", "article", "link", "heading", "mark", "body_mark", "root_mark")

    def __init__(self, tag: str, parent: Element | None):
        self.tag = tag
        self.outside = parent.outside if parent else False
        self.header = parent.header if parent else False
        self.region = parent.region if parent else 0
        self.article = parent.article if parent else False
        self.link = parent.link if parent else False
        self.heading = parent.heading if parent else False
        #: Innermost mark; the same without header words; that of the outermost article, where it starts.
        self.mark = parent.mark if parent else 0
        self.body_mark = parent.body_mark if parent else 0
        self.root_mark = parent.root_mark if parent else -1


class LineReader(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Element("", None)]
        self.lines: list[Line] = []
        self.line = Line()
        self.regions = 0
        #: Per mark (0: none) the mark around it and whether a whole class or id made it.
        self.around, self.whole = [0], [False]

    def end_line(self) -> None:
        if self.line.some:
            self.lines.append(self.line)
            self.line = Line()
        else:
            self.line.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in CLOSES[tag]:
                    del self.stack[i:]
                    break
                if self.stack[i].tag in SECTIONS or self.stack[i].tag in ("ul", "ol", "dl", "table"):
                    break
        if tag in BLOCKS or tag == "br":
            self.end_line()
        self.line.tags += 1
        if tag in VOID:
            return
        e = Element(tag, self.stack[-1])
        self.mark(e, tag, attrs)
        self.stack.append(e)

    def mark(self, e: Element, tag: str, attrs) -> None:
        values = {k: v or "" for k, v in attrs}
        names = f"{values.get('class', '')} {values.get('id', '')}".lower()
        words = set(WORD.findall(names))
        if (tag in OUTSIDE or values.get("role", "").lower() in OUTSIDE_ROLES
                or "hidden" in values or values.get("aria-hidden") == "true"
                or "display:none" in values.get("style", "").replace(" ", "").lower()):
            e.outside = e.outside or tag not in ("html", "body")
        if tag == "header":
            e.header = True
        marked, header = tag == "form" or words & OUTSIDE_WORDS, words & HEADER_WORDS and tag not in ARTICLES
        whole = not set(names.split()).isdisjoint(OUTSIDE_WORDS | HEADER_WORDS if header else OUTSIDE_WORDS)
        if (marked or header) and tag not in ("html", "body"):
            self.around.append(e.mark)
            self.whole.append(whole)
            e.mark = len(self.around) - 1
            if marked:
                e.body_mark = e.mark
        if tag in ARTICLES or values.get("role") == "main" or values.get("itemprop") == "articleBody":
            if not e.article:
                e.root_mark = e.mark
            e.article = True
        if tag in SECTIONS and not (e.article and self.stack[-1].article):
            self.regions += 1
            e.region = self.regions
        e.link = e.link or tag == "a"
        e.heading = e.heading or tag in HEADINGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        self.line.tags += 1
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if self.stack[i].tag in SECTIONS and tag not in SECTIONS and tag not in BLOCKS:
                return  # a stray inline end tag does not close a section

    def handle_data(self, data):
        e = self.stack[-1]
        if e.outside or e.header and not (e.article and e.heading):
            return
        self.line.some = self.line.some or bool(data.strip())
        self.line.parts.append((data, e, e.body_mark if e.article and e.heading else e.mark))

    def finish(self) -> list[Line]:
        self.close()
        self.end_line()
        left_out = self.left_out()
        lines, tags = [], 0
        for line in self.lines:
            parts = [(data, e) for data, e, mark in line.parts if not left_out[mark]]
            first = next((e for data, e in parts if data.strip()), None)
            line.tags += tags
            tags = line.tags if first is None else 0
            if first is not None:
                line.region = first.region
                line.link_chars = sum(len(data.strip()) for data, e in parts if e.link)
                line.parts = [data for data, _ in parts]
                lines.append(line)
        return lines

    def left_out(self) -> list[bool]:
        """Per mark, whether it or one around it leaves its text out."""
        chars, holds, under = [0] * len(self.around), [False] * len(self.around), list(self.whole)
        for m in range(1, len(under)):
            under[m] = under[m] or under[self.around[m]]
        free = False  # whether an article is under no whole mark
        for line in self.lines:
            for data, e, mark in line.parts:
                n = len(data.strip())
                chars[mark] += n
                if n and e.root_mark == mark:
                    holds[mark] = True
                    free = free or not under[mark]
        for m in range(len(chars) - 1, 0, -1):  # marks are numbered from the outside in
            chars[self.around[m]] += chars[m]
            holds[self.around[m]] = holds[self.around[m]] or holds[m]
        out = [False] * len(chars)
        for m in range(1, len(out)):
            dropped = (holds[m] or chars[m] >= MOST * chars[0]) and not (free and self.whole[m])
            out[m] = out[self.around[m]] or not dropped
        return out


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends there is nothing (weights add up to 1)."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    ones = np.ones(len(ratios))
    return np.convolve(ratios, kernel)[reach:-reach] / np.convolve(ones, kernel)[reach:-reach]


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    reader = LineReader()
    for at in range(0, len(html or ""), FEED_CHARS):
        reader.feed(html[at:at + FEED_CHARS])
    lines = reader.finish()
    if not lines:
        return ""
    texts = [" ".join("".join(x.parts).split()) for x in lines]
    own = np.array([len(t) / max(1, x.tags) for t, x in zip(texts, lines)], dtype=float)
    ratios = smooth(own)
    dense = np.minimum(own, ratios) >= threshold * ratios.std()
    held: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        held.setdefault(x.region, []).append(i)

    def links(of: list[int]) -> float:
        return sum(lines[i].link_chars for i in of) / max(1, sum(len(texts[i]) for i in of))

    regions = {r for r, of in held.items() if dense[of].any() and links(of) <= MAX_LINKS}
    if not regions:
        regions = {max(held, key=lambda r: (sum(len(texts[i]) for i in held[r]), -r))}
    return "\n".join(t for t, x in zip(texts, lines) if x.region in regions)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, text, n_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
