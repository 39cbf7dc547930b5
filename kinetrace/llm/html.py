"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page into lines, one for each run of text inside a block, with its length without
links and the tags around it. The logarithms of these text-to-tag ratios are smoothed with a Gaussian and clustered around
two centres, one held at zero: lines nearest to that one and lines of links are frame, the others content.

Content lines select regions. Elements named as frame (menus, page heads and feet, sidebars, forms) are set aside. One whose
class or role speaks of frame and of nothing else is too, unless it holds nearly all content, so a wrapper with such a name
stays; one that speaks of other things as well (a section on share prices) goes only if it is links or form controls, or
lies outside the article. The article or main element that holds most content is kept whole, also where its text is links
alone. Without one the page is gone through from the top: an element without content lines goes, one that holds together is
kept whole, and any other is split into its children.

All steps are linear in the page, whatever it leaves open: open elements are found by name, a comment without an end lasts
to the end of the page, and so does a tag that is never finished.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm.text import quoted
from kinetrace.plans.shared import shipped

SMOOTHING = 1.0
#: An article or main that is the content region holds at least this share of the content.
REGION_SHARE = 0.8
#: An element whose class or role speaks of frame alone stays only if it holds this share of the content.
MARKED_SHARE = 0.9
LINK_SHARE = 0.6
ROUNDS = 50

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas object svg".split()
)
#: Elements whose text is never part of an article, and those that are the frame of a page or stand beside its text.
UNREAD = frozenset("audio button canvas head iframe noscript object optgroup option script select style svg template textarea title video".split())
FRAMING = frozenset("aside dialog footer menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in a class or id that speak of what is not the article.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promotion promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Which of these make up the frame of a page: an element around them is not the article alone. Others stand inside articles too.
PAGE_FRAME = frozenset("banner contentinfo footer header masthead menu menubar nav navbar navigation".split())
#: Words of layout and grammar, which say nothing about what an element holds.
NEUTRAL = frozenset(
    "a and area bar block body bottom box btn button buttons by card cards center cell col column container count desktop div element entry feed field fixed flex float for from group head heading holder icon icons id in inner is item items js layout left lg link links list lists md mobile module of on our outer page panel part post posts primary reader readers right row secondary section shell site sm small span the thread title to tool tools top ui user users view with wrap wrapper xs your".split()
)
#: Outside an article a head is the page's and a discussion its readers'; inside, both may be parts of it.
HEADS = frozenset(("header", "head", "discussion", "discussions"))
CONTROLS = frozenset("button input select textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | frozenset("blockquote dd dt figcaption li p pre".split())
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
#: An implied end does not reach out of these.
HOLDS = frozenset("article aside body div dl footer form header html main menu nav ol section table td th ul blockquote".split())


class Lines(HTMLParser):
    """Collects lines (text, tags, characters of links, block), and blocks by number: parent (a smaller number), tag, how much speaks for frame, from 0 to 1, and form controls."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.holds: list[int] = []
        self.parent, self.tag, self.mark, self.framing, self.controls = [0], ["html"], [0.0], [False], [0.0]
        self.block = 0
        self.unread = self.links = self.articles = self.tags = self.link_chars = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.words: list[str] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append((text, self.tags, self.link_chars, self.block))
            self.tags = 0
        self.words.clear()
        self.link_chars = 0

    def read(self, html: str) -> None:
        """A whole page. A tag that begins after the last > is never finished, and is no text either."""
        last = html.rfind(">") + 1
        unfinished = re.compile(r"<[a-zA-Z/!?]").search(html, last)
        self.feed(html[: unfinished.start()] if unfinished else html)
        self.close()
        self.end_line()

    def parse_comment(self, i: int, report: int = 1) -> int:
        """As browsers do: without an end, it lasts to the end of the page."""
        if short := re.compile(r"<!--+>").match(self.rawdata, i):
            return short.end()
        end = re.compile(r"--!?>").search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    @staticmethod
    def hidden(attrs: dict[str, str | None]) -> bool:
        return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style") or ""))

    def frame_of(self, tag: str, attrs: dict[str, str | None]) -> tuple[float, bool]:
        """How much of its tag, role and class speaks for frame, and whether for the frame of the page."""
        if tag in FRAMING or tag == "header" and not self.articles:
            return 1.0, tag in PAGE_FRAME
        if tag == "form":
            return 1.0, False
        if not attrs or tag in ("html", "body", "article", "main"):
            return 0.0, False
        role = (attrs.get("role") or "").lower()
        if role in ROLES:
            return 1.0, role in PAGE_FRAME
        known, best, framing = MARKS if self.articles else MARKS | HEADS, 0.0, False
        for k in ("class",) if tag in HEADINGS else ("class", "id"):  # a heading's id is an anchor
            words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", attrs.get(k) or "").lower()))
            if frame := words & known:
                best = max(best, len(frame) / len(frame | (words - NEUTRAL)))
                framing = framing or bool(frame & PAGE_FRAME or frame & HEADS)
        return best, framing

    def pop(self) -> None:
        tag, unread, block = self.open.pop()
        self.places[tag].pop()
        if tag in HOLDS:
            self.holds.pop()
        self.unread -= unread
        self.links -= tag == "a"
        self.articles -= tag in ("article", "main")
        if block:
            self.block = self.parent[self.block]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            k = max((self.places[name][-1] for name in CLOSES.get(tag, CLOSES["p"]) if self.places.get(name)), default=-1)
            if k >= 0 and (not self.holds or self.holds[-1] <= k):
                while len(self.open) > k:
                    self.pop()
        self.controls[self.block] += tag in CONTROLS
        if tag in VOID:
            return
        given = dict(attrs)
        mark, framing = self.frame_of(tag, given)
        block = tag in BLOCKS or mark > 0
        if block:
            self.end_line()
            self.parent.append(self.block)
            self.block = len(self.tag)
            self.tag.append(tag)
            self.mark.append(mark)
            self.framing.append(framing)
            self.controls.append(0.0)
        unread = tag in UNREAD or tag not in ("html", "body", "article", "main") and self.hidden(given)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in HOLDS:
            self.holds.append(len(self.open))
        self.open.append((tag, unread, block))
        self.unread += unread
        self.links += tag == "a"
        self.articles += tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        k = self.places[tag][-1] if self.places.get(tag) else -1
        if k >= 0 and (tag in BLOCKS or not self.holds or self.holds[-1] <= k):
            if tag in BLOCKS or self.open[k][2]:
                self.end_line()
            while len(self.open) > k:
                if self.open[-1][2]:
                    self.end_line()
                self.pop()
        if tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.words.append(data)
            if self.links:
                self.link_chars += len(data)


def smoothed(values: list[float], sigma: float) -> list[float]:
    reach = max(1, round(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[j - i + reach], values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def content_lines(ratios: list[float], sigma: float = SMOOTHING) -> list[bool]:
    """Which lines are content: by smoothed log ratio, those nearer to the mean of all such lines than to zero."""
    level = smoothed([math.log1p(r) for r in ratios], sigma)
    centre = sum(level) / len(level)
    for _ in range(ROUNDS):
        mine = [x for x in level if 2 * x >= centre]
        if centre == (centre := sum(mine) / len(mine)):
            break
    return [2 * x >= centre for x in level]


def sums(parser: Lines, of_lines: list[float]) -> list[float]:
    """By block, the sum over the lines in it and in the blocks inside it."""
    out = [0.0] * len(parser.parent)
    for (_, _, _, block), v in zip(parser.lines, of_lines, strict=True):
        out[block] += v
    for k in range(len(out) - 1, 0, -1):
        out[parser.parent[k]] += out[k]
    return out


def set_aside(parser: Lines, worth: list[float]) -> list[bool]:
    """By block: whether it, or one around it, is frame. worth: content characters of each line.

    First go framing elements and those that speak of frame alone, unless these hold nearly all content; then, of what is
    left, those that speak of it in part and are links or form controls themselves. Where an article or main has content, all go that hold none of it.
    """
    out = [False] * len(parser.parent)
    size, links = sums(parser, [len(line[0]) for line in parser.lines]), sums(parser, [min(line[2], len(line[0])) for line in parser.lines])
    controls = parser.controls[:]
    for k in range(len(out) - 1, 0, -1):
        controls[parser.parent[k]] += controls[k]
    named = [t in ("article", "main") for t in parser.tag]
    for k in range(1, len(named)):
        named[k] = named[k] or named[parser.parent[k]]
    of_article = sums(parser, [w * named[line[3]] for line, w in zip(parser.lines, worth, strict=True)])
    for k in range(1, len(out)):  # before shares are judged: what lies outside the article says nothing about the elements around it
        out[k] = out[parser.parent[k]] or parser.mark[k] > 0 and of_article[0] > of_article[k] == 0
    for least in (1.0, 0.0):
        held = sums(parser, [0.0 if out[line[3]] else w for line, w in zip(parser.lines, worth, strict=True)])
        for k in range(1, len(out)):
            mark, tag = parser.mark[k], parser.tag[k]
            framed = tag in FRAMING or tag == "header" and mark == 1
            small = held[k] < MARKED_SHARE * mark * held[0]
            alone = small if mark == 1 else small and (controls[k] > 0 or links[k] >= LINK_SHARE * size[k])
            out[k] = out[k] or out[parser.parent[k]] or mark > 0 and mark >= least and (framed or alone)
    return out


def main_text(html: str) -> str:
    """The article's blocks in page order, joined by a space; empty if there is none."""
    parser = Lines()
    parser.read(html)
    lines, n = parser.lines, len(parser.parent)
    if not lines:
        return ""
    near = content_lines([max(len(text) - links, 0) / max(tags, 1) for text, tags, links, _ in lines])
    content = [c and links < LINK_SHARE * len(text) for c, (text, _, links, _) in zip(near, lines, strict=True)]  # smoothing lifts a menu beside the text
    worth = [max(len(text) - links, 0) * c for (text, _, links, _), c in zip(lines, content, strict=True)]
    aside = set_aside(parser, worth)
    left = [not aside[block] for _, _, _, block in lines]
    held = sums(parser, [w * x for w, x in zip(worth, left, strict=True)])
    region = next((k for k in range(1, n) if parser.tag[k] in ("article", "main") and not aside[k] and held[k] >= REGION_SHARE * held[0] > 0), None)
    if not region and not held[0]:  # an article of links has no content lines
        size = sums(parser, [len(line[0]) * x for line, x in zip(lines, left, strict=True)])
        region = max((k for k in range(1, n) if parser.tag[k] in ("article", "main") and size[k] > 0), key=lambda k: (size[k], -k), default=None)
    kept = within(parser, region) if region else parts(parser, content, left, aside)
    return " ".join(line[0] for line, k, x in zip(lines, kept, left, strict=True) if k and x)


def within(parser: Lines, region: int) -> list[bool]:
    inside = [False] * len(parser.parent)
    for k in range(1, len(inside)):
        inside[k] = k == region or inside[parser.parent[k]]
    return [inside[block] for _, _, _, block in parser.lines]


def parts(parser: Lines, content: list[bool], left: list[bool], aside: list[bool]) -> list[bool]:
    """Lines of the parts with content of a page without article.

    A block is split if it is of the page rather than of its text: the page itself, one with menus or page heads and feet in
    it, one with a child of links without content beside children that hold content, or one around such a block without text
    of its own. Of a split block's children, and of its own lines, those with content stay, and headings right before what stays.
    """
    n, lines = len(parser.parent), parser.lines
    high = sums(parser, [float(c and x) for c, x in zip(content, left, strict=True)])
    size = sums(parser, [len(line[0]) * x for line, x in zip(lines, left, strict=True)])
    links = sums(parser, [min(line[2], len(line[0])) * x for line, x in zip(lines, left, strict=True)])
    there = sums(parser, [float(not x) for x in left])
    own_text, split = [False] * n, [parser.tag[k] in ("html", "body") for k in range(n)]
    for (_, _, _, block), c, x in zip(lines, content, left, strict=True):
        if c and x:
            own_text[parser.parent[block] if parser.tag[block] in TEXT_BLOCKS else block] = True
    framed = [aside[k] and parser.framing[k] and there[k] > 0 for k in range(n)]
    for k in range(n - 1, 0, -1):
        framed[parser.parent[k]] = framed[parser.parent[k]] or framed[k]
    for k in range(1, n):
        up = parser.parent[k]
        split[k] = split[k] or framed[k]
        if not aside[k] and not high[k] and size[k] and links[k] >= LINK_SHARE * size[k] and not own_text[up]:
            split[up] = True
    for k in range(n - 1, 0, -1):
        up = parser.parent[k]
        split[up] = split[up] or split[k] and not own_text[up]
    whole = [False] * n
    for k in range(1, n):
        up = parser.parent[k]
        whole[k] = whole[up] or (up == 0 or split[up]) and high[k] > 0 and not split[k]
        split[k] = split[k] and (up == 0 or split[up])
    kept = [x and (whole[line[3]] or c and (line[3] == 0 or split[line[3]])) for line, c, x in zip(lines, content, left, strict=True)]
    for i in range(len(lines) - 2, -1, -1):
        kept[i] = kept[i] or left[i] and kept[i + 1] and parser.tag[lines[i][3]] in HEADINGS
    return kept


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html to page_id, url, text, n_chars, one row for each row, in one pass.

    Defined cases: null or empty html gives an empty text; markup without end tags, or text without markup, is read as far
    as it goes; equal and null ids and urls are kept as they are; other columns are not looked at.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    mine = pages.select(quoted("page_id").cast("long").alias("page_id"), quoted("url").cast("string").alias("url"), quoted("html").cast("string").alias("html"))
    return shipped(mine).mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_main_text": op8_main_text}
ORACLE: dict[str, str] = {}
