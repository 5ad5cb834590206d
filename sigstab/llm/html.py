"""Main-text extraction: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's HTML parser streams events. Text is gathered into lines, which end at block-level tags. A line's
ratio is its characters outside links over the tags met since the line before. Names weigh in by a factor only: a line
inside an element that is boilerplate by its name or class (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments) has NAMED times less, one inside an article or main element ARTICLE times more. A named element that
holds WRAPS of the text that no whole name marks, and at least FLOOR characters, is a wrapper of the page's content and
not boilerplate, unless the page has an article outside: ``no-sidebar`` or ``tag-news`` say nothing then. Where nothing
else is left, that goes for an element with a whole name (``sidebar``) too.

Per page, and on every page, the ratios are smoothed over neighbouring lines with a Gaussian, and the logarithms of the
smoothed ratios are split in two clusters by an exact one-dimensional two-means; a split whose clusters lie not clearly
apart (APART of the variance, and FACTOR, a threefold ratio, between their means) is none. Lines of the upper cluster are the core. The content region is the innermost
element that holds SHARE of the core's characters, found by going down from the root, and no deeper than an article or
main element; where the core is spread over several articles, all that hold a part of it. Text of named boilerplate is
never given back, so it has no say in the choice unless a page has nothing else. What lies in a chosen region is kept
whole, short lines too; a region that is no article loses lines that are mostly link, and the body as a region is
trimmed to its first and last core line.

Defined results: null and empty pages, and pages without text, give the empty string; unknown marked sections
(``<![``) are comments up to the next ``>``; an unclosed comment, declaration, processing instruction, start tag or
attribute ends with the page; misnested and unclosed tags cost no
more than others. Rows are never merged or dropped.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: Fixed values of HTML: elements that never have an end tag, that start a new block, and whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template head title svg math object iframe canvas audio video textarea select button option datalist".split())
BOILER = frozenset("nav header footer aside menu dialog".split())
#: Elements that can be a content region, and those whose end closes open items or paragraphs.
CONTAINER = frozenset("article main section div body td center form".split())
LIST = frozenset("ul ol table dl select menu".split())
ITEM = frozenset("li td th tr dd dt option".split())
ARTICLES = frozenset(("article", "main"))
#: Words of class, id and role values that mark boilerplate; of an article element, only whole names of comments and adverts do.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|notices?|gdpr|newsletter|subscribe|signup|"
    r"nav(?:bar|igation)?|menus?|breadcrumbs?|sidebar|side|widget|related|recommended|share|sharing|social|footer|header|masthead|toolbar|pagination|pager|"
    r"comments?|disqus|reply|replies|respond|popup|modal|overlay|hidden|login|search|skip|copyright|tags?)(?:$|[\s_-])",
    re.I,
)
ARTICLE_MARKS = re.compile(r"(?:^|\s)(?:comments?|repl(?:y|ies)|(?:comment|reply)[_-]\S*|ads?|adverts?|advertisement|sponsored|promo)(?:$|\s)", re.I)
#: A whole name of MARKS.
WHOLE = re.compile(rf"(?:^|\s){MARKS.pattern.split(')', 1)[1].rsplit('(?:$', 1)[0]}(?:$|\s)", re.I)
#: How surely a name marks boilerplate: by a part of a name, by a whole name, by the element itself.
PART, NAME, ELEMENT = range(3)
SPACE = re.compile(r"\s+")
SIGMA, RADIUS = 1.0, 2
NAMED, ARTICLE, APART, FACTOR, SHARE = 16.0, 4.0, 0.8, 1.1, 0.6
WRAPS, FLOOR = 0.8, 200


class _Lines(HTMLParser):
    """Lines (text, tags, characters in links, mark, node) of a page, its marks and its container nodes, from parser events.

    Nodes and marks are lists of (parent, ...) in page order; -1 is none. Every event costs a bounded time, and ending
    elements costs one step for each that is open: positions of open elements are kept by name.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []
        self.at: dict[str, list[int]] = {}
        self.blocks_at: list[int] = []
        self.lists_at: list[int] = []
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.marks: list[list] = []
        self.nodes: list[tuple[int, str, int]] = [(-1, "", -1)]
        self.mark, self.node = -1, 0
        self.text: list[str] = []
        self.tags = self.linked = self.hidden = self.links = 0

    def _ended(self, end: int) -> int:
        return end if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self._ended(self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i))

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self._ended(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self._ended(super().parse_pi(i))

    def parse_starttag(self, i: int) -> int:
        return self._ended(super().parse_starttag(i) if self.rawdata.find(">", i) >= 0 else -1)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, min(self.linked, len(text)), self.mark, self.node))
            self.tags = 0
        self.text, self.linked = [], 0

    def _marked(self, tag: str, attrs: list) -> int | None:
        """How surely the element is boilerplate by its name; None: not at all."""
        in_article = self.nodes[self.node][2] >= 0
        if tag in BOILER and not (tag == "header" and in_article):  # an article's own header may hold its headline
            return ELEMENT
        if any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            return ELEMENT
        names = [] if tag in ("html", "body") else [v for k, v in attrs if k in ("class", "id", "role") and v]
        if tag in ARTICLES:
            return NAME if any(map(ARTICLE_MARKS.search, names)) else None
        if any(map(WHOLE.search, names)):
            return NAME
        return PART if tag == "form" or any(map(MARKS.search, names)) else None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "p":
            self._close("p", self.blocks_at)
        elif tag in ITEM:
            self._close(tag, self.lists_at)
        before = (self.mark, self.node)
        sure = self._marked(tag, attrs)
        if sure is not None:
            # a wrapper of a whole page: a form around a main or article element, or any marked element around main
            self.marks.append([self.mark, tag, tag not in BOILER, sure])
            self.mark = len(self.marks) - 1
        elif tag in ARTICLES:
            k = self.mark
            while k >= 0 and self.marks[k][1] and self.marks[k][2] and (tag == "main" or self.marks[k][1] == "form"):
                self.marks[k][1], k = "", self.marks[k][0]
        if tag in CONTAINER:
            article = self.nodes[self.node][2]
            if article < 0 and tag in ARTICLES and sure is None:
                article = len(self.nodes)
            self.nodes.append((self.node, tag, article))
            self.node = len(self.nodes) - 1
        where = len(self.open)
        self.at.setdefault(tag, []).append(where)
        if tag in BLOCK and tag != "p":
            self.blocks_at.append(where)
        if tag in LIST:
            self.lists_at.append(where)
        self.open.append((tag, *before))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def _pop(self) -> None:
        tag, mark, node = self.open.pop()
        if not tag:
            return
        where = len(self.open)
        self.at[tag].pop()
        for places in (self.blocks_at, self.lists_at):
            if places and places[-1] == where:
                places.pop()
        self.mark, self.node = mark, node
        self.hidden -= tag in HIDDEN
        self.links -= tag == "a"

    def _close(self, tag: str, barrier: list[int]) -> None:
        """End the innermost open element of that name, and what is open in it, unless the barrier's last element is between.

        An inline element behind a barrier ends alone, and what is open in it goes on.
        """
        places = self.at.get(tag)
        if not places:
            return
        where = places[-1]
        if barrier and barrier[-1] > where:
            if tag not in BLOCK:
                places.pop()
                self.open[where] = ("", -1, 0)
                self.hidden -= tag in HIDDEN
                self.links -= tag == "a"
            return
        while len(self.open) > where:
            self._pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag not in VOID:
            self._close(tag, self.lists_at if tag in ITEM else () if tag in BLOCK and tag != "p" else self.blocks_at)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def marked(self) -> np.ndarray:
        """Which lines lie in marked elements that are no wrappers."""
        own = [len(text) - linked for text, _, linked, _, _ in self.lines]
        real = self._real()
        if not any(n and not real[m] and self.nodes[node][2] >= 0 for n, (*_, m, node) in zip(own, self.lines, strict=True)):
            for sure in (PART, NAME):
                self._unwrap(own, sure)
                real = self._real()
                if not real[[line[3] for line in self.lines]].all():
                    break
        return real[[line[3] for line in self.lines]]

    def _real(self, least: int = PART) -> np.ndarray:
        """By mark: whether it, or one around it, marks boilerplate at least so surely; the last is that of mark -1."""
        real = np.zeros(len(self.marks) + 1, bool)
        for k, (parent, tag, _, sure) in enumerate(self.marks):
            real[k] = tag != "" and sure >= least or real[parent]
        return real

    def _unwrap(self, own: list[int], most: int) -> None:
        """Let the marks that are no surer than ``most`` go, if they hold nearly all the text that surer ones don't hold."""
        surer = self._real(most + 1)
        held = np.zeros(len(self.marks) + 1)
        for n, line in zip(own, self.lines, strict=True):
            held[line[3]] += 0 if surer[line[3]] else n
        whole = held.sum()
        for k in range(len(self.marks) - 1, -1, -1):
            if self.marks[k][0] >= 0:
                held[self.marks[k][0]] += held[k]
            if held[k] >= FLOOR and held[k] >= WRAPS * whole and self.marks[k][3] <= most:
                self.marks[k][1] = ""


def parse(html: str) -> _Lines:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def smooth(raw: np.ndarray) -> np.ndarray:
    """Gaussian mean over the neighbouring lines that there are."""
    k = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(raw)), k, "full")[RADIUS : RADIUS + len(raw)]
    return np.convolve(raw, k, "full")[RADIUS : RADIUS + len(raw)] / weight


def upper_cluster(x: np.ndarray) -> np.ndarray:
    """Which values belong to the upper of two clusters; all of them where the clusters aren't clearly apart."""
    s = np.sort(x)
    total = ((s - s.mean()) ** 2).sum()
    if len(s) < 2 or total <= 1e-12:
        return np.ones(len(x), bool)
    n = np.arange(1, len(s))
    left = np.cumsum(s)[:-1]
    between = left**2 / n + (s.sum() - left) ** 2 / (len(s) - n) - s.sum() ** 2 / len(s)
    k = int(np.argmax(between))
    near = s[k + 1 :].mean() - s[: k + 1].mean() < FACTOR
    if (near or between[k] < APART * total) and s[0] > 0:
        return np.ones(len(x), bool)
    return x >= (s[k] + s[k + 1]) / 2


def choose(page: _Lines) -> tuple[np.ndarray, np.ndarray]:
    """(core, kept): lines of the upper cluster, and lines of the page's main text."""
    lines, named = page.lines, page.marked()
    node = np.array([line[4] for line in lines])
    own = np.array([len(text) - linked for text, _, linked, _, _ in lines], float)
    article = np.array([page.nodes[k][2] for k in node])
    weight = np.where(named, 1 / NAMED, np.where(article >= 0, ARTICLE, 1.0))
    ratio = np.log1p(smooth(own * weight / (1 + np.array([line[1] for line in lines]))))
    core = upper_cluster(ratio)
    if named.all():
        return core, np.zeros(len(lines), bool)
    if not (core & ~named).any():  # the cluster holds nothing that may be given back: split the rest again
        core = np.zeros(len(lines), bool)
        core[~named] = upper_cluster(ratio[~named])
    votes = np.where(core & ~named, np.maximum(own, 1e-3) * weight, 0.0)
    parents = [parent for parent, _, _ in page.nodes]
    sums = np.zeros(len(parents))
    np.add.at(sums, node, votes)
    for k in range(len(parents) - 1, 0, -1):
        sums[parents[k]] += sums[k]
    here = 0
    for k in range(1, len(parents)):
        if parents[k] == here and sums[k] >= SHARE * sums[0] and page.nodes[here][2] != here:
            here = k
    inside = np.zeros(len(parents), bool)
    inside[here] = True
    for k in range(here + 1, len(parents)):
        inside[k] = inside[parents[k]]
    if page.nodes[here][2] >= 0:
        return core, inside[node] & ~named
    if votes[article >= 0].sum() >= SHARE * sums[0]:
        return core, np.isin(article, article[(votes > 0) & (article >= 0)]) & ~named
    kept = inside[node] & ~named & (2 * own > [len(line[0]) for line in lines])
    if page.nodes[here][1] in ("", "body") and (kept & core).any():
        place = np.flatnonzero(kept & core)
        kept[: place[0]] = kept[place[-1] + 1 :] = False
    return core, kept


def main_text(html: str | None) -> str:
    """The main text of one page: its content lines in page order, joined by newlines."""
    page = parse(html) if html else None
    if page is None or not page.lines:
        return ""
    return "\n".join(line[0] for line, keep in zip(page.lines, choose(page)[1], strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the kept columns, text and n_chars (code points) for every page; one pass, nothing is shuffled."""

    def run(pages: list) -> list:
        text = [main_text(h) for h in pages]
        return [text, [len(t) for t in text]]

    return map_texts(pages, (id_col, *keep), html_col, run, "text string, n_chars long")
