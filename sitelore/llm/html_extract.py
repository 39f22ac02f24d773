"""Main text of web pages from the event stream of the standard-library parser.

A page is read once as events. Text between two block boundaries is a line; each line has its text-to-tag
ratio, the number of its characters over the number of tags in it, those of its block included. The ratios are smoothed with a Gaussian; lines at or
above a threshold (the smaller of standard deviation and mean of the ratios) form the clusters, and a line of a cluster whose own
ratio reaches the threshold is a core. The cores and the headline (h1) decide what is content:

* Where article or main elements hold half of the cores' text or more, the content is all of those elements that hold a core or the headline.
* Else it is the smallest container around all cores and the headline. A list, table or container inside of it that has neither a core nor the headline
  stays out if half of its text is in links, or if it has no line of a cluster and stands before the first or behind the last line that has.

All other lines of the content belong to the text, short ones too. Boilerplate elements (menus, headers, footers, sidebars, forms,
scripts, styles, hidden parts) and reader comments never do, wherever they stand. A class or id whose words all
speak of boilerplate (``ad``, ``cookie-banner``, ``share_buttons``; not ``share-price`` or ``ad-hoc``) and a form lower
the weight of the text beneath to a quarter (``DISCOUNT``): the element stays out unless it weighs as much as all unmarked text of clusters even
so and holds the headline, if there is one, or unless the heaviest article or main element is in it.

Time and memory are linear in the length of the page, however deep its elements are nested: an element knows its parent, and
weights are summed from the last element to the first.

Cases: null and empty pages and pages without content give an empty text. Cut-off pages end all open elements; a
tag that is cut off is no text. Character references are decoded; white space within a line, and a line break element, is one
space. Repeated pages are read one by one. Other columns are carried along; own columns named text or n_chars are replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that are never content.
BOILERPLATE = frozenset("head script style noscript template svg math iframe object canvas audio video nav header footer aside button select textarea input label dialog menu".split())
#: Elements that hold a region.
CONTAINER = frozenset("html body main article section div form".split())
#: Elements that may be a menu or a list of links as a whole.
GROUP = CONTAINER | frozenset("ul ol dl table center details fieldset".split())
#: Words of a class or id that mark boilerplate.
MARKS = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login widget widgets pagination pager toolbar topbar skip".split())
#: Words that say where or what kind of a part something is; a mark beside them still marks.
NEUTRAL = frozenset("area bar block box button buttons card cards col column container content div frame group holder icon icons id inner item items js left link links list main outer panel part post posts articles right row section site slot small large top bottom side thread unit wrap wrapper page body global primary secondary mobile desktop media us the and form on of by to".split())
#: Marks that no weight of the text outweighs.
SURE = frozenset("comment comments disqus respond replies role hidden".split())
#: Marks of an article element that is not the page's own.
FOREIGN = frozenset("ad ads advert advertisement sponsored promo comment replies related recommended hidden".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: A start tag on the left ends an open element on the right.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = BLOCK - {"body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements that an implied end doesn't reach through.
WALLS = tuple("table ul ol dl article section main div body html aside nav header footer form blockquote".split())
#: Weight of text under a mark, against text without.
DISCOUNT = 0.25
WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")


def marks(attrs: list[tuple[str, str | None]]) -> set[str]:
    """The words of a start tag that mark boilerplate: those of class and id names that have no other words than marks, neutral ones and numbers."""
    found: set[str] = set()
    for name, value in attrs:
        if name in ("class", "id") and value:
            for token in value.split():
                words = {w.lower() for w in WORD.findall(token) if not w.isdigit()}
                own = words & MARKS
                if own and words <= MARKS | NEUTRAL:
                    found |= own
        elif name == "role":
            if value and value.lower() in ROLES:
                found.add("role")
            elif value and value.lower() == "form":
                found.add("form")
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            found.add("hidden")
        elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found.add("hidden")
    return found


class Piece(NamedTuple):
    text: str
    #: Number of the innermost marked element around it, 0 for none.
    mark: int
    linked: bool


class Line(NamedTuple):
    text: str
    tags: int
    #: Number of the innermost element around it.
    at: int
    linked: int
    marked: bool


class Page(HTMLParser):
    """The elements of a page, each with its parent, and its lines. Elements are numbered as they begin, so a parent has a smaller number."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names: list[str] = [""]
        self.parent: list[int] = [0]
        #: The innermost marked element that an element is in, itself included.
        self.mark: list[int] = [0]
        #: The marked element around a marked one.
        self.outer: dict[int, int] = {}
        self.out: list[bool] = [False]
        self.kinds: list[int] = []
        self.stack: list[int] = [0]
        #: Places in the stack of the open elements of a name, and of all blocks.
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.raw: list[tuple[list[Piece], int, int]] = []
        self.part: list[Piece] = []
        self.tags = 0

    def updatepos(self, i, j):
        """Line numbers aren't asked for, and counting them takes a tenth of the time."""
        return j

    def line(self) -> None:
        if self.part:
            self.raw.append((self.part, self.tags, self.stack[-1]))
            self.part = []
        self.tags = 0

    def _put(self, text: str) -> None:
        self.part.append(Piece(text, self.mark[self.stack[-1]], bool(self.where.get("a"))))

    def _cut(self, depth: int) -> None:
        """Ends all open elements from that place of the stack on."""
        for k in range(len(self.stack) - 1, depth - 1, -1):
            name = self.names[self.stack.pop()]
            self.where[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def _last(self, names) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def _implied(self, names, walls=WALLS) -> None:
        """Ends the innermost open element of ``names`` unless a wall stands before it."""
        place = self._last(names)
        if place and place > self._last(walls):
            self.line()
            self._cut(place)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._implied(ENDS[tag])
        elif tag in CLOSES_P:
            self._implied(("p",))
        elif tag == "body":
            self._implied(("head",), ())
        if tag in BLOCK:
            self.line()
        self.tags += 1
        if tag == "br" and not self.out[self.stack[-1]]:
            self._put(" ")
        if tag in VOID:
            return
        above, number = self.stack[-1], len(self.names)
        found = marks(attrs) if attrs else set()
        out, mark = self.out[above], self.mark[above]
        if tag in ("article", "main"):
            out = out or bool(found & FOREIGN)
        elif tag not in ("html", "body"):
            out = out or bool(found & SURE) or tag in BOILERPLATE
            if found - SURE or tag == "form":
                self.outer[number] = mark
                mark = number
        if not out and (tag in ("article", "main") or any(n == "role" and v == "main" for n, v in attrs)):
            self.kinds.append(number)
        self.names.append(tag)
        self.parent.append(above)
        self.mark.append(mark)
        self.out.append(out)
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(number)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.line()
        place = self._last((tag,))
        if place and (tag in BLOCK or not self.blocks or place > self.blocks[-1]):
            self._cut(place)

    def handle_data(self, data):
        if not self.out[self.stack[-1]]:
            self._put(data)

    def lines(self, wrappers: set[int] | None) -> list[Line]:
        """The lines that have text, without what is in marked elements other than ``wrappers``; None: with all."""
        inside = {0: True}
        for k, outer in self.outer.items():
            inside[k] = wrappers is None or (k in wrappers and inside[outer])
        out = []
        for part, tags, at in self.raw:
            kept = [x for x in part if inside[x.mark]]
            text = " ".join("".join(x.text for x in kept).split())
            if text:
                out.append(Line(text, tags, at, sum(len(x.text) for x in kept if x.linked), any(x.mark for x in kept if x.text.strip())))
        return out

    def sums(self, weights: dict[int, int]) -> list[int]:
        """The weight of each element with all elements beneath."""
        total = [0] * len(self.names)
        for k, w in weights.items():
            total[k] += w
        for k in range(len(total) - 1, 0, -1):
            total[self.parent[k]] += total[k]
        return total

    def beneath(self, tops) -> list[bool]:
        """Whether an element is one of ``tops`` or beneath one."""
        found = [False] * len(self.names)
        for k in tops:
            found[k] = True
        for k in range(1, len(found)):
            found[k] = found[k] or found[self.parent[k]]
        return found


def smooth(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """The ratios under a Gaussian over three sigmas on either side; at the ends over what there is."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    around = np.convolve(ratio, kernel, "full")[reach : reach + len(ratio)]
    return around / np.convolve(np.ones(len(ratio)), kernel, "full")[reach : reach + len(ratio)]


def clusters(lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line belongs to a cluster, and whether it is a core of it."""
    ratio = np.array([len(x.text) for x in lines], float) / np.array([max(1, x.tags) for x in lines], float)
    least = min(float(ratio.std()), float(ratio.mean()))
    near = smooth(ratio) >= least
    core = near & (ratio >= least)
    return near, core if core.any() else ratio == ratio.max()


def _add(pairs) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in pairs:
        out[k] = out.get(k, 0) + w
    return out


def _wrappers(page: Page, headline: list[bool]) -> set[int]:
    """The marked elements that are around the page's content."""
    lines = page.lines(None)
    if not any(x.marked for x in lines):
        return set()
    yes = clusters(lines)[0]
    weight = page.sums(_add((x.at, len(x.text)) for x, y in zip(lines, yes) if y))
    plain = sum(len(x.text) for x, y in zip(lines, yes) if y and not x.marked)
    headed = page.sums(_add((x.at, 1) for x in lines if headline[x.at]))
    found: set[int] = set()
    lead = max((k for k in page.kinds if weight[k]), key=lambda k: (weight[k], -k), default=None)
    if lead is not None and weight[lead] >= plain:
        k = page.mark[lead]
        while k:
            found.add(k)
            k = page.outer[k]
    for k in page.outer:
        beside = max(plain, weight[0] - weight[k])
        if weight[k] and DISCOUNT * weight[k] >= beside and (headed[k] or not (headed[0] or page.kinds or plain)):
            found.add(k)
    return found


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page()
    page.feed(html)
    # what is left unread at the end: a tag that is cut off, or text
    if page.rawdata and not page.rawdata.startswith("<"):
        page.close()
    page.line()
    headline = page.beneath(k for k, name in enumerate(page.names) if name == "h1")
    lines = page.lines(_wrappers(page, headline))
    if not lines:
        return ""
    near, core = clusters(lines)
    # article and main elements, if half of the cores' text is in them
    own = page.beneath(page.kinds)
    weight = sum(len(x.text) for x, c in zip(lines, core) if c)
    if page.kinds and 2 * sum(len(x.text) for x, c in zip(lines, core) if c and own[x.at]) >= weight:
        says = page.sums(_add((x.at, 1) for x, c in zip(lines, core) if c or headline[x.at]))
        inside = page.beneath(k for k in page.kinds if says[k])
        return "\n".join(x.text for x in lines if inside[x.at])
    says = page.sums(_add((x.at, 1) for x, c in zip(lines, core) if c or headline[x.at]))
    region = max(k for k, n in enumerate(says) if n == says[0] and (k == 0 or page.names[k] in CONTAINER))
    return "\n".join(_trimmed(page, lines, near, core, headline, region))


def _trimmed(page: Page, lines: list[Line], near: np.ndarray, core: np.ndarray, headline: list[bool], region: int) -> list[str]:
    """The lines of a region, without the groups that no cluster speaks for."""
    # the child of the region that an element is beneath
    child = [-1] * len(page.names)
    child[region] = region
    for k in range(1, len(child)):
        up = page.parent[k]
        if k != region and child[up] >= 0:
            child[k] = k if up == region else child[up]
    rows = [(x, child[x.at], bool(y or c) or headline[x.at], bool(c) or headline[x.at]) for x, y, c in zip(lines, near, core) if child[x.at] >= 0]
    text, linked = _add((c, len(x.text)) for x, c, *_ in rows), _add((c, x.linked) for x, c, *_ in rows)
    places = [i for i, (_, _, y, _) in enumerate(rows) if y]
    first, last = places[0], places[-1]
    sure = {c for _, c, _, z in rows if z} | {c for c in text if c == region or page.names[c] not in GROUP}
    near_ = {c for i, (_, c, y, _) in enumerate(rows) if y or first < i < last}
    return [x.text for x, c, *_ in rows if c in sure or (c in near_ and 2 * linked[c] < text[c])]


def extract(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """The rows of ``pages`` without their html, with text and n_chars."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [main_text(x.as_py()) for x in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return small_batches(pages).select(*[f"`{f.name}`" for f in kept], f"`{html}`").mapInArrow(run, schema)
