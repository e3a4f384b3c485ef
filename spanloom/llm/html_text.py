"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events.  Block elements cut the page into lines; each
line knows its text, the tags in it and the element it stands in.  A line's ratio is its
characters per tag.  Ratios are smoothed with a Gaussian over neighbouring lines, and lines
whose smoothed ratio reaches the threshold (a share of the mean or the standard deviation of the
page's ratios, the lesser) form the content cluster.  The cluster selects what is given: the lines
from its first to its last one that stand in its region, the innermost container that holds nearly
all its text (widened to its article or main element); where it has no such element, the cluster's
other lines are kept too, with the containers that are mostly cluster.  Inside this selection,
elements, roles and class names only tell menus, forms, notices, adverts and comments apart.
A name never marks an article or main element, nor, as long as no other article or
main stands clear of such names, an element that holds one or most of the cluster's text.

Work follows the length of the page, however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video button select textarea datalist".split())
APART = frozenset("nav footer aside form menu dialog".split())
ARTICLES = frozenset("article main".split())
CONTAINERS = frozenset("html body article main section div td center".split())
CLOSES_P = BLOCKS - {"html", "body", "title", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "option", "optgroup", "legend"}
#: Words in class, id and role that name what is not the article.
APART_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar "
    "comment comments commentlist reply replies respond discussion disqus menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related "
    "recommended newsletter subscribe subscription signup popup modal overlay widget login toolbar pagination pager skip contentinfo complementary search "
    "masthead topbar".split()
)
_NAME = re.compile(r"[^a-z0-9]+")

SIGMA = 2.0
#: Chosen on the given pages, where it keeps an article's short first and last lines; 0.25 lost some on 8 pages of 1500, 0.1 on 1 of 2500.
THRESHOLD = 0.05
#: Outside an article element, lines that smoothing alone has lifted must have so many characters a tag to be a first or last one.
EDGE = 0.5
SHARE = 0.9


class Lines(HTMLParser):
    """Lines of one page, in order: text, ratio, element, whether it stands apart by element or as hidden.

    ``named`` are the elements whose names say that they are not the article, ``hidden`` those apart whatever they hold.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, element number, silent, apart
        self.open: Counter = Counter()  # tags on the stack
        self.elements: list[tuple[str, int]] = []  # tag and parent of each element
        self.named: set[int] = set()
        self.hidden: set[int] = set()
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, float, int, bool]] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.cut()
            if tag in CLOSES_P:
                self._close_p()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._close_same(tag)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append("\n")
            return
        _, _, silent, apart = self.stack[-1] if self.stack else ("", -1, False, False)
        number = len(self.elements)
        self.elements.append((tag, self.stack[-1][1] if self.stack else -1))
        if tag not in ("html", "body") and self._hidden(attrs) or tag in APART or (tag == "header" and not self._inside("article", "main")):
            apart = True
            self.hidden.add(number)
        elif tag not in ("html", "body") and tag not in ARTICLES and self._named_apart(attrs):
            self.named.add(number)
        self.stack.append((tag, number, silent or tag in SILENT, apart))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.tags += 1
        for i in range(len(self.stack) - 1 if self.open[tag] else -1, -1, -1):
            if self.stack[i][0] == tag:
                self._drop(i)
                break
            if self.stack[i][0] in BLOCKS and tag not in BLOCKS:
                break  # an inline end tag does not close blocks

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            self.text.append(data)

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            at, apart = (self.stack[-1][1], self.stack[-1][3]) if self.stack else (-1, False)
            self.lines.append((text, len(text) / max(1, self.tags), at, apart))
            self.tags = 0
        self.text = []

    def close(self) -> None:
        super().close()
        self.cut()

    def _drop(self, i: int) -> None:
        self.open.subtract(x[0] for x in self.stack[i:])
        del self.stack[i:]

    def _inside(self, *tags: str) -> bool:
        return any(self.open[t] for t in tags)

    def _close_p(self) -> None:
        for i in range(len(self.stack) - 1 if self.open["p"] else -1, -1, -1):
            if self.stack[i][0] == "p":
                self._drop(i)
                return
            if self.stack[i][0] in BLOCKS:
                return

    def _close_same(self, tag: str) -> None:
        for i in range(len(self.stack) - 1 if self.open[tag] else -1, -1, -1):
            if self.stack[i][0] == tag:
                self._drop(i)
                return
            if self.stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                return

    @staticmethod
    def _named_apart(attrs: list[tuple[str, str | None]]) -> bool:
        return any(name in ("class", "id", "role") and not APART_NAMES.isdisjoint(_NAME.split((value or "").lower())) for name, value in attrs)

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        return any(name == "hidden" or name == "style" and "display:none" in (value or "").lower().replace(" ", "") for name, value in attrs)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average over neighbouring lines, out to three sigma; the edges weigh what is there."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    part = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return part(ratios) / part(np.ones(len(ratios)))


def _weights(cluster: list[tuple[str, float, int, bool]], elements: list[tuple[str, int]]) -> tuple[dict[int, int], int]:
    """Characters of the lines by element that holds them, and in all."""
    own = [0] * (len(elements) + 1)  # the last place is the page
    for text, _, at, _ in cluster:
        own[at] += len(text)
    for e in range(len(elements) - 1, -1, -1):  # children have higher numbers
        own[elements[e][1]] += own[e]
    return {e: w for e, w in enumerate(own[:-1]) if w}, own[-1]


def _apart_by_name(named: set[int], hidden: set[int], elements: list[tuple[str, int]], filled: set[int], weight: dict[int, int], total: int) -> tuple[set[int], set[int]]:
    """The named elements that are apart: beside a clear article, and for holding a minor part only."""
    inner = [0] * (len(elements) + 1)  # articles with text in each element; the last place is the page
    clear = [0] * (len(elements) + 1)  # those with no named element between
    own = [elements[e][0] in ARTICLES and e in filled for e in range(len(elements))]
    for e in range(len(elements) - 1, -1, -1):
        if e not in hidden:
            inner[elements[e][1]] += inner[e] + own[e]
            clear[elements[e][1]] += 0 if e in named else clear[e] + own[e]
    # whether a clear article stands beside the element or beside one around it
    other = [False] * (len(elements) + 1)
    for e, (_, parent) in enumerate(elements):
        part = 0 if e in named or e in hidden else clear[e] + own[e]
        other[e] = other[parent] or clear[parent] > part
    beside = {e for e in named if other[e]}
    return beside, {e for e in named if not other[e] and not inner[e] and 2 * weight.get(e, 0) <= total}


def _under(apart: set[int], elements: list[tuple[str, int]]) -> list[bool]:
    """Whether each element is or stands in one of ``apart``; the last place is the page."""
    under = [False] * (len(elements) + 1)
    for e, (_, parent) in enumerate(elements):
        under[e] = under[parent] or e in apart
    return under


def content_lines(lines: list[tuple[str, float, int, bool]], elements: list[tuple[str, int]], named: set[int], hidden: set[int], sigma: float = SIGMA, threshold: float = THRESHOLD, share: float = SHARE) -> list[str]:
    """Texts of the lines that the cluster selects; without any in the body the whole body counts as cluster."""
    body = [x for x in lines if not x[3]]
    if not body:
        return []
    ratios = np.array([x[1] for x in lines])
    high = smoothed(ratios, sigma) >= threshold * min(ratios.std(), ratios.mean())
    high_lines = [x for x, ok in zip(lines, high, strict=True) if ok and not x[3]] or body
    weight, total = _weights(high_lines, elements)
    filled = set(_weights(body, elements)[0])
    beside, minor = _apart_by_name(named, hidden, elements, filled, weight, total) if named else (set(), set())
    under = _under(beside | minor, elements)
    if sum(len(x[0]) for x in high_lines if under[x[2]]) >= share * total:  # together they hold nearly all of the cluster
        under = _under(beside | {e for e in minor if weight.get(e, 0) < (1 - share) * total}, elements)
    body = [x for x in body if not under[x[2]]] or body
    cluster = [x for x in high_lines if not under[x[2]]] or body

    weight, total = _weights(cluster, elements)
    inside = [e for e, w in weight.items() if w >= share * total and elements[e][0] in CONTAINERS]
    region = max(inside, default=-1)  # elements are numbered in order, so the innermost is the latest
    around, at = [], region
    while at >= 0:
        around.append(at)
        at = elements[at][1]
    region = next((e for e in around if elements[e][0] in ARTICLES), region)
    held = _under({region}, elements) if region >= 0 else [True] * (len(elements) + 1)

    chosen = {id(x) for x in cluster}
    if region < 0 or elements[region][0] in ARTICLES:
        found = [x for x in body if held[x[2]]]
    else:
        filled, _ = _weights(body, elements)
        also = _under({e for e, w in weight.items() if e not in around and elements[e][0] in CONTAINERS and 2 * w > filled[e]}, elements)
        found = [x for x in body if held[x[2]] or id(x) in chosen or also[x[2]]]
    # the cluster bounds what is given
    free = region < 0 or elements[region][0] not in ARTICLES
    places = [i for i, x in enumerate(found) if id(x) in chosen and (not free or x[1] >= EDGE)] or [i for i, x in enumerate(found) if id(x) in chosen]
    return [x[0] for x in found[places[0] : places[-1] + 1]] if places else []


def main_text(html: str | None) -> str:
    page = Lines()
    page.feed(html or "")
    page.close()
    return "\n".join(content_lines(page.lines, page.elements, page.named, page.hidden))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages``.

    Null, empty and text-free pages give an empty text; broken markup is read as far as it
    makes sense; repeated rows give equal results; an empty table gives an empty result; other
    columns are ignored, whatever their names; very long pages are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col(html).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
