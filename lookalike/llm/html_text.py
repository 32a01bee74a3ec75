"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events. A line is the text between two block-level boundaries;
its ratio is the number of its characters for each tag met in it. The lines' ratios are smoothed with
a Gaussian window and split by a threshold into two clusters. Lines of the upper cluster are the core
of the content. Regions are articles (article or main elements) or, in pages without one, innermost divisions;
a region is kept, with its short lines too, where the core has a good share of its own text, as a heading or a
one-word paragraph has a low ratio wherever it stands. An article is kept where it has any core, and all are if
none has. Text in elements that never hold content (scripts, styles, forms, menus, footers, asides) or
whose class, id or role is the name of such a part counts in the ratios but is in neither core nor regions. A
name counts if each of its parts names or places such a part, as in ``left-sidebar`` or ``comment-list``;
``has-sidebar``, ``share-price`` or ``tag-politics`` don't.

Defined results: null and empty pages give an empty text; a page without any markup gives its text; a
page whose lines are all set aside gives an empty text; unclosed elements end with their parent; declarations
that no standard knows are comments; rows equal in all columns give equal results; further columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
ASIDE = frozenset("script style noscript template head title nav footer aside form button select option textarea iframe svg canvas object audio video dialog menu".split())
ENDED_BY = {"p": BLOCKS - {"br", "html", "body"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Names of parts that are not content, and words that only place or shape such a part.
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets comment comments respond replies disqus skip hidden toolbar pagination pager tag tags legal copyright".split()
)
PLACING = frozenset("area article bar block body bottom box button buttons col column container entry global group holder inner item items left link links list main outer page panel post posts primary reader region right row secondary section site slot story sub text thread top unit user wrap wrapper".split())
#: Inside an article these are the article's own.
OWN = frozenset("header masthead tag tags legal".split())
#: Elements that are regions of their own outside articles.
DIVISIONS = frozenset("body div section table td dl details fieldset".split())
#: A region is kept where its core has this share of its text.
REGION_SHARE = 0.5
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WHITE = re.compile(r"\s+")


NAME_PARTS = re.compile(r"[A-Za-z]+")


def names_no_content(value: str, in_article: bool) -> bool:
    """Whether one of the names in a class or id attribute stands for a part that is not content."""
    for name in value.lower().split():
        parts = NAME_PARTS.findall(name)
        own = [x for x in parts if x in NOT_CONTENT and not (in_article and x in OWN)]
        if own and all(x in NOT_CONTENT or x in PLACING or len(x) == 1 for x in parts):
            return True
    return False


class Lines(HTMLParser):
    """Collects lines as (text, tags, region); region 0 is text that is set aside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.open: list[tuple[str, bool, bool]] = []
        self.text: list[str] = []
        self.regions, self.last = [1], 1
        self.article_regions: set[int] = set()
        self.n_open: Counter[str] = Counter()
        self.tags = self.off = self.articles = 0

    def _end_line(self) -> None:
        if self.text:
            line = WHITE.sub(" ", "".join(self.text)).strip()
            if line:
                self.lines.append((line, self.tags, 0 if self.off else self.regions[-1]))
            self.text.clear()
        self.tags = 0

    def _pop(self) -> None:
        tag, off, article = self.open.pop()
        self.n_open[tag] -= 1
        self.off -= off
        self.articles -= article
        if article or tag in DIVISIONS and not self.articles:
            self.regions.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        while self.open and tag in ENDED_BY.get(self.open[-1][0], ()):
            self._pop()
        if tag == "p" and self.n_open["p"]:  # a paragraph ends an open one, whatever inline elements are still open in it
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    while len(self.open) > k:
                        self._pop()
                    break
                if self.open[k][0] in BLOCKS:
                    break
        if tag in VOID:
            return
        off = tag in ASIDE
        if not off and attrs:
            for name, value in attrs:
                if not value:
                    off = off or name == "hidden"
                elif name in ("class", "id"):
                    off = off or tag not in ("html", "body", "article", "main") and names_no_content(value, self.articles > 0)
                elif name == "role":
                    off = off or value.lower() in ROLES
                elif name == "aria-hidden":
                    off = off or value.lower() == "true"
        if tag == "header" and not self.articles:
            off = True
        article = tag in ("article", "main") and not off
        self.open.append((tag, off, article))
        self.n_open[tag] += 1
        if article and not self.articles or not article and tag in DIVISIONS and not self.articles:
            self.last += 1
            self.regions.append(self.last)
            if article:
                self.article_regions.add(self.last)
        elif article:
            self.regions.append(self.regions[-1])
        self.off += off
        self.articles += article

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "a"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if not self.n_open[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if tag not in BLOCKS and self.open[k][0] in BLOCKS:
                return  # a stray inline end tag closes no block

    def handle_data(self, data):
        if not self.dropped():
            self.text.append(data)

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # a keyword that no standard knows
            return self.parse_bogus_comment(i)

    def unknown_decl(self, data):
        pass

    def dropped(self) -> bool:
        return bool(self.open) and self.open[-1][0] in ("script", "style", "noscript", "template", "title", "option", "textarea")

    def finish(self) -> list[tuple[str, int, int]]:
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, with the window's weights renormalised at the ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The boundary of two clusters of log(1 + value), by one-dimensional 2-means from the extremes."""
    logs = np.log1p(values)
    low, high = logs.min(), logs.max()
    if high - low < 1.0:  # one cluster: all lines are alike
        return -1.0
    for _ in range(50):
        cut = (low + high) / 2
        upper = logs > cut
        new = logs[~upper].mean(), logs[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return float(np.expm1((low + high) / 2))


def main_text(html: str | None) -> str:
    """The page's main text: kept lines joined by one space."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    soft = smoothed(np.array([len(text) / max(1, tags) for text, tags, _ in lines]))
    limit = threshold(soft)
    core, size = Counter(), Counter()
    for (text, _, region), value in zip(lines, soft, strict=True):
        if region:
            core[region] += len(text) * bool(value > limit)
            size[region] += len(text)
    if articles := [x for x in size if x in parser.article_regions]:
        kept = {x for x in articles if core[x]} or set(articles)
    else:
        kept = {x for x in size if core[x] >= REGION_SHARE * size[x]} or {x for x in size if core[x] == max(core.values())}
    return " ".join(text for text, _, region in lines if region in kept)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(x.as_py()) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; rows are independent, nothing is shuffled."""
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
