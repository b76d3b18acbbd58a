"""Main text of web pages by line-block distribution.

Markup is stripped: comments, scripts, styles and the like go with their
content, block elements end a line, character references are decoded and white
space becomes one space. Each line weighs its characters outside links. The
distribution is the sum of weights over windows of ``WINDOW`` lines: text
begins where it surges to the threshold (at the first line with weight of that
window, in an article at the article's begin) and ends where it dives to zero.
The threshold is ``SURGE`` characters, or half the page's highest window if
that is less. All text between surges and dives is kept, lines in page order;
so are the heading above a surge and what stands between them, lines without
weight (lists of links) between two kept parts that nothing else parts, and a
short article with a sentence that follows a kept one directly.

Tags act beside the distribution in two ways. Lines inside <article> or <main>
weigh ``BONUS`` times, links and headings included, and blank lines stand where
the outermost one begins and ends. Regions whose tag, role or a whole class or
id token names a menu, header, footer, sidebar, notice, advert, form or reader
comments weigh a fraction (``_share``) and are left out, unless they hold the
page's <main>, its only <article>s (reader comments aside) or its highest
window; a mark that is wrong for the highest window counts for no region of the
page. What is left out leaves no blank lines, save a page's <nav> or <header>
before the first surge.

Defined results: a null or empty page and one without text give an empty text;
malformed or unclosed markup is read up to the end of the page, an unclosed
region ends where the next article, main, section, heading or footer begins;
repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
BONUS = 2
#: Regions within one another that are told apart.
NESTED = 64

_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select option datalist audio video xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead "
                   "tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("nav footer aside form menu dialog button fieldset".split())
_NAMED = frozenset("""ad ads advert adverts advertisement advertising adsbygoogle ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper sponsor sponsored promo
    banner nav navbar navigation menu main-menu main-nav main-navigation site-nav site-navigation nav-menu top-nav breadcrumb breadcrumbs
    header masthead topbar top-bar site-header page-header footer site-footer page-footer sidebar side-bar left-sidebar right-sidebar sidebar-left
    sidebar-right col-sidebar side aside widget widgets widget-area related recommended related-posts related-articles related-links share sharing social
    share-buttons social-share social-links social-icons cookie cookies consent cookie-banner cookie-bar cookie-consent cookie-notice gdpr gdpr-banner gdpr-notice privacy-notice consent-banner notice notices
    alert popup modal overlay newsletter newsletter-signup subscribe subscription signup login login-form search search-form searchform
    comment comments comment-list commentlist comments-area comment-body comment-form comments-section comment-section disqus disqus_thread
    respond replies pagination pager toolbar legal copyright""".split())
_REPLIES = re.compile(r"comment|disqus|respond$|replies$")
#: In an article these name its own head.
_HEAD = frozenset("header banner masthead page-header".split())
_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_RESUME = frozenset("article main section h1 h2 footer".split())
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[!?/][^>]*>)")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _mark(tag: str, attributes: str, in_article: bool) -> str | None:
    """What names the element as other than main text: its tag, a role or a class or id token."""
    if tag in _CHROME or tag == "header" and not in_article:
        return tag
    if tag in ("html", "body", "main") or "=" not in attributes or in_article and re.fullmatch(r"h[1-6]|p|header|hgroup", tag):
        return None
    for name, *values in _ATTRIBUTE.findall(attributes):
        named = _ROLE if name.lower() == "role" else _NAMED
        for token in next(filter(None, values), "").lower().split():
            if token in named and not (in_article and token in _HEAD):
                return f"{name.lower() == 'role'} {token}"
    return None


def _share(mark: str) -> int:
    """A line of a region counts for one in so many: forms may wrap a page, names may be chance, the other tags rarely err."""
    return 2 if mark in ("form", "fieldset") else 4 if " " in mark and not _REPLIES.match(mark.split()[1]) else 8


@dataclass
class Region:
    tag: str
    mark: str
    bounds: bool
    articles: int = 0
    main: bool = False
    depth: int = 1

    def holds_main(self, free: int) -> bool:
        """Whether it holds <main>, or <article>s that are not reader comments while the page has none outside regions."""
        return self.main or bool(self.articles and not free and not _REPLIES.match(self.mark.split()[-1]))


@dataclass
class Line:
    text: str
    weight: int
    article: bool = False
    regions: tuple[Region, ...] = ()
    bounds: bool = False
    heading: bool = False


def lines_of(page: str) -> tuple[list[Line], int]:
    """Lines, blank ones around articles and page-level <nav> and <header>; the number of articles outside regions."""
    lines: list[Line] = []
    words: list[str] = []
    weight, link, heading, article, free, headed = 0, 0, 0, 0, 0, False
    regions: tuple[Region, ...] = ()
    ends: dict[str, int] = {}
    at, n, low = 0, len(page), page.lower()
    if len(low) != n:  # lower-casing may change lengths outside ASCII
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), page)

    def end_line() -> None:
        nonlocal weight, headed
        text = " ".join("".join(words).split())
        if text:
            lines.append(Line(text, weight * (BONUS if article else 1), article > 0, regions, False, headed))
        words.clear()
        weight, headed = 0, False

    def gap(bounds: bool = False) -> None:
        lines.extend([Line("", 0, False, regions, bounds)] * WINDOW)

    def text_to(end: int) -> None:
        nonlocal weight, headed
        if end > at:
            headed = headed or heading > 0
            text = html.unescape(page[at:end])
            words.append(text)
            if not link or article or heading:
                weight += len(" ".join(text.split()))

    def leave(k: int) -> None:
        nonlocal regions
        end_line()
        left = regions[k]
        regions = regions[:k]
        if left.bounds:
            gap(True)

    while at < n:
        tag = _TAG.search(page, at)
        if tag is None:
            text_to(n)
            break
        text_to(tag.start())
        at = tag.end()
        if tag[2] is None:
            if tag[0] == "<!--":
                close = page.find("-->", at)
                at = n if close < 0 else close + 3
            continue
        name, closing, attributes = tag[2].lower(), bool(tag[1]), tag[3]
        if name in _RAW and not closing:
            if not attributes.endswith("/"):
                close = low.find(f"</{name}", at)
                if close >= 0:
                    stop = page.find(">", close)
                    at = n if stop < 0 else stop + 1
                elif name not in ("option", "select", "title"):
                    at = n
            if name not in ("svg", "math"):
                words.append(" ")
            continue
        opens = not closing and name not in _VOID and not attributes.endswith("/")
        if not closing and name in _RESUME:
            for k, region in enumerate(regions):
                if ends.setdefault(region.tag, low.rfind(f"</{region.tag}")) < at:
                    leave(k)
                    link = 0
                    break
        if name in _BLOCK:
            end_line()
        if opens or closing:
            k = next((k for k in reversed(range(len(regions))) if regions[k].tag == name), None)
            if k is not None:
                regions[k].depth += -1 if closing else 1
                if not regions[k].depth:
                    leave(k)
                    link = 0
        mark = _mark(name, attributes, article > 0) if opens and len(regions) < NESTED else None
        if name in _VOID or name not in _BLOCK:
            if name == "a":
                link = 0 if closing else 1
            if name in ("br", "hr", "img", "input"):
                words.append(" ")
            if name == "hr":
                end_line()
        elif name[0] == "h" and name[1:].isdigit():
            heading = 0 if closing else 1
        if mark is not None:
            end_line()
            bounds = not article and name in ("nav", "header")
            if bounds:
                gap(True)
            regions = (*regions, Region(name, mark, bounds))
        if name in ("article", "main"):
            if not closing and mark is None:
                free += not regions
                for region in regions:
                    region.articles += 1
                    region.main |= name == "main"
            if article + (not closing) == 1:  # the outermost
                gap()
            article = max(0, article + (-1 if closing else 1))
    end_line()
    return lines, free


def _windows(weights: list[float]) -> list[float]:
    return [sum(weights[i:i + WINDOW]) for i in range(len(weights))]


def _cleared(lines: list[Line], free: int) -> set[str]:
    """The marks of all regions that hold the heaviest line of the page's highest window."""
    weights = [line.weight / math.prod(_share(r.mark) for r in line.regions if not r.holds_main(free)) for line in lines]
    blocks = _windows(weights)
    top = max(range(len(lines)), key=blocks.__getitem__, default=None)
    if top is None or not blocks[top]:
        return set()
    heaviest = max(range(top, min(top + WINDOW, len(lines))), key=weights.__getitem__)
    return {r.mark for r in lines[heaviest].regions}


def main_text(page: str | None) -> str:
    """The text between surge and dive points of a whole page."""
    lines, free = lines_of(page or "")
    cleared = _cleared(lines, free)
    lines = [line for line in lines if all(r.holds_main(free) or r.mark in cleared for r in line.regions)]
    weights = [line.weight for line in lines]
    threshold = max(1, min(SURGE, max(_windows(weights), default=0) // 2))
    first = next((i for i, block in enumerate(_windows(weights)) if block >= threshold), 0)
    lines = [line for i, line in enumerate(lines) if i <= first or not line.bounds]
    weights = [line.weight for line in lines]
    blocks = _windows(weights)
    spans: list[tuple[int, int]] = []
    i = 0
    while i < len(lines):
        if blocks[i] < threshold:
            i += 1
            continue
        while not weights[i]:  # surge: the first line with text of the window
            i += 1
        begin = i = _begin(lines, i)
        while i < len(lines) and blocks[i]:  # dive: a window without text
            i += 1
        spans.append((begin, i))
    return "\n".join(line.text for a, b in _joined(lines, spans) for line in lines[a:b] if line.text)


def _begin(lines: list[Line], at: int) -> int:
    """Where the text that surges at a line begins: with its article, or with the heading above it, if only text stands between."""
    above = at
    while above and lines[above - 1].text and lines[above - 1].weight and lines[above - 1].article == lines[at].article:
        above -= 1
    if lines[at].article:
        while above and lines[above - 1].article and lines[above - 1].text:
            above -= 1
        return above
    return next((k for k in range(above, at) if lines[k].heading), at)


def _joined(lines: list[Line], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Kept spans, with the lines without weight (lists of links) that stand between two of them, and with a short article that
    follows a kept one directly and holds a sentence."""
    out: list[tuple[int, int]] = []
    for begin, end in spans:
        if out and all(line.text for line in lines[out[-1][1]:begin]):
            begin = min(begin, out[-1][1])
        out.append((begin, end))
    found: list[tuple[int, int]] = []
    for k, (begin, end) in enumerate(out):
        found.append((begin, end))
        limit = out[k + 1][0] if k + 1 < len(out) else len(lines)
        while lines[end - 1].article:
            low = next((j for j in range(end, limit) if lines[j].text), limit)
            high = next((j for j in range(low, limit) if not lines[j].text or not lines[j].article), limit)
            if low >= high or not any(line.weight and re.search(r"[.!?…]\W*$", line.text) for line in lines[low:high]):
                break
            found.append((low, high))
            end = high
    return found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
