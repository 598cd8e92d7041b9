"""Main text of web pages from parser events: text-to-tag ratios per line, smoothed, clustered by a threshold.

A page is read once as events of the standard library's parser. Block-level tags end a line, so a line is a block of
running text whatever the line feeds of the source. Each line has a ratio of text outside links to tags; a Gaussian
smooths the ratios, and lines from their standard deviation on form the content cluster. The cluster then elects a
region, the element that holds it, and the region gives all its lines but those in parts that are no article by their
element, role or name (menus, adverts, comments ...), so short paragraphs inside an article stay.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# lines on each side that a line's ratio is smoothed with, and the deviation of the Gaussian
RADIUS, SIGMA = 2, 1.0
# share of the cluster's text that an article element, or any other element, must hold to be the region
ARTICLE_SHARE, ELEMENT_SHARE = 0.2, 0.9
# a form or an element named like a part beside the article is the frame of the page if it holds this share of its text
FRAME_SHARE = 0.7

# elements by the role that the markup standard gives them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "script style title noscript template iframe svg math canvas object audio video map select option datalist button "
    "textarea label fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF = HEADING | {"p", "pre", "blockquote", "figcaption", "caption", "summary", "address"}
BLOCK = frozenset(
    "html body div main article section nav header footer aside form ul ol dl menu li dt dd table thead tbody tfoot tr td "
    "th figure details dialog center hgroup search".split())
ARTICLE = frozenset(["article", "main"])
APART = frozenset("nav footer aside form dialog menu search".split())
APART_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
# an element of the key ends when one of these begins beside it
SIBLINGS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
}
# words in class names and ids that name a part beside the article
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe "
    "subscription signup signin login register paywall nav navbar navigation menu menubar submenu breadcrumb breadcrumbs "
    "sidebar aside footer copyright masthead header topbar toolbar comment comments disqus reply replies respond related "
    "recommended recommendations share sharing social pagination pager search widget widgets form skip".split())
NEGATED = frozenset("has no not with without hide".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_TAG = re.compile(r"<[A-Za-z/!?]")


def _names(value: str | None) -> list[list[str]]:
    return [[w.lower() for w in _NAME.findall(name)] for name in (value or "").split()]


def _apart_by_name(attrs: dict) -> str:
    """The word in class or id that names a part beside the article, or an empty string."""
    for names in _names(attrs.get("class")) + _names(attrs.get("id")):
        for before, word in zip(["", *names], names):
            if word in APART_NAMES and before not in NEGATED:
                return word
    return ""


class Lines(HTMLParser):
    """Lines of a page and the tree of its block elements, in flat lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # elements: tag, parent, whether what is below stands apart, and by what name it may; 0 is the page
        self.tags, self.parents, self.apart, self.soft = ["page"], [-1], [False], [""]
        self.lines = []  # (text, tags, link characters, element, kind, apart)
        self.title = ""
        self._open = [0]
        self._names = Counter()
        self._silent_tag, self._silent_inside = "", 0  # element whose text is no text, and how often it is open
        self._link = 0  # depth of the stack at an open link, 0: none
        self._parts, self._linked, self._count = [], 0, 0
        self._kind, self._leaf_apart = "", False
        self._no_comment_end = -1

    # a page comes in one piece; what is not closed in it never will be, so it is settled at once and in linear time
    def parse_comment(self, i, report=1):
        if self._no_comment_end < 0:
            end = self.rawdata.find("-->", i + 2)
            if end >= 0:
                return end + 3
            self._no_comment_end = i
        return len(self.rawdata)

    def parse_html_declaration(self, i):
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata)

    def _flush(self):
        text = " ".join("".join(self._parts).split())
        if text:
            apart = self._leaf_apart
            self.lines.append((text, max(self._count, 1), min(self._linked, len(text)), self._open[-1], self._kind, apart))
            self._count = 0
        self._parts, self._linked = [], 0

    def _end_leaf(self):
        self._flush()
        self._kind, self._leaf_apart = "", False

    def _pop(self):
        tag = self.tags[self._open.pop()]
        self._names[tag] -= 1
        if self._link > len(self._open):
            self._link = 0

    def _close(self, tags, until=()):
        """Close the innermost open element of these tags, with all inside it, unless one of ``until`` comes first."""
        if not any(self._names[t] for t in tags):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[depth]]
            if tag in tags:
                while len(self._open) > depth:
                    self._pop()
                return
            if tag in until:
                return

    def handle_starttag(self, tag, attrs):
        self._count += 1
        if self._silent_tag:
            if tag == self._silent_tag and tag not in VOID:
                self._silent_inside += 1
            return
        if tag in SILENT:
            self._silent_tag, self._silent_inside = tag, 1
            return
        if tag == "a":
            self._link = len(self._open)
        elif tag in LEAF:
            self._end_leaf()
            if tag == "h1":
                self._keep_above(("name",))
            self._kind, self._leaf_apart = tag, bool(_apart_by_name(dict(attrs))) or self._hidden(dict(attrs))
        elif tag in BLOCK:
            self._end_leaf()
            if tag in SIBLINGS:
                names, until = SIBLINGS[tag]
                self._close(names.split(), until)
            self._push(tag, dict(attrs))
        elif tag == "br":
            self._parts.append(" ")
        elif tag == "hr":
            self._end_leaf()

    @staticmethod
    def _hidden(attrs: dict) -> bool:
        style = (attrs.get("style") or "").replace(" ", "").lower()
        return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style

    def _push(self, tag: str, attrs: dict):
        role = (attrs.get("role") or "").lower()
        named = "" if tag in ("html", "body", "main") else _apart_by_name(attrs)
        if role == "main" or attrs.get("itemprop") == "articleBody":
            tag = "main"
        inside = any(self._names[t] for t in ARTICLE)
        if tag in ARTICLE and not inside:
            self._keep_above(("name", "header"))
        if named in COMMENT_NAMES:
            soft = "comment"
        elif tag == "header" or named == "header":
            soft = "" if inside else "header"  # the header of an article belongs to it
        elif tag in ARTICLE:
            soft = "name" if named and inside else ""
        else:
            soft = "name" if named or tag == "form" else ""
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.apart.append(tag in APART and tag != "form" or role in APART_ROLES or self._hidden(attrs))
        self.soft.append(soft)
        self._open.append(len(self.tags) - 1)
        self._names[tag] += 1

    def _keep_above(self, kinds: tuple[str, ...]):
        """Elements around an article, or around the main heading, do not stand apart by their name alone."""
        for e in self._open:
            if self.soft[e] in kinds:
                self.soft[e] = ""

    def handle_endtag(self, tag):
        self._count += 1
        if self._silent_tag:
            if tag == self._silent_tag:
                self._silent_inside -= 1
                if not self._silent_inside:
                    self._silent_tag = ""
                return
            if tag not in BLOCK or not self._names[tag] or self._silent_tag in ("script", "style", "title"):
                return
            self._silent_tag = ""  # an element around it ends, so it was never closed
        if tag == "a":
            self._link = 0
        elif tag in LEAF:
            self._end_leaf()
        elif tag in BLOCK:
            self._end_leaf()
            self._close((tag,))

    def handle_data(self, data):
        if self._silent_tag:
            if self._silent_tag == "title" and not self.title and len(self._open) < 4:
                self.title = " ".join(data.split())
            return
        self._parts.append(data)
        if self._link:
            self._linked += len(data.strip())

    def read(self, html: str) -> "Lines":
        # no tag begins behind the last ">"; of such a rest only the text in front of a cut tag counts
        end = html.rfind(">") + 1
        rest = html[end:]
        cut = _TAG.search(rest)
        self.feed(html[:end])
        self.close()
        if (cut is None or cut.start()) and self._no_comment_end < 0:
            self.feed(rest[:cut.start()] if cut else rest)
            self.close()
        self._end_leaf()
        return self


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean over RADIUS neighbours on each side; at the ends over those there are."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    whole = np.convolve(ratios, kernel, "full")[RADIUS:RADIUS + len(ratios)]
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[RADIUS:RADIUS + len(ratios)]
    return whole / weight


def content_lines(page: Lines) -> np.ndarray:
    """Mask of the lines that make up the main text."""
    count = len(page.lines)
    if not count:
        return np.zeros(0, bool)
    element = np.array([x[3] for x in page.lines])
    length = np.array([len(x[0]) for x in page.lines], np.float64)
    linked = np.array([x[2] for x in page.lines], np.float64)
    parents = page.parents
    text = np.zeros(len(parents))
    np.add.at(text, element, np.maximum(length - linked, 0))
    for e in range(len(parents) - 1, 0, -1):
        text[parents[e]] += text[e]
    apart = [False] * len(parents)
    for e in range(1, len(parents)):  # parents come first
        named = page.soft[e] == "comment" or page.soft[e] and text[e] < FRAME_SHARE * text[0]
        apart[e] = apart[parents[e]] or page.apart[e] or bool(named)
    beside = np.array([x[5] for x in page.lines]) | np.array(apart)[element]
    plain = np.where(beside, 0, np.maximum(length - linked, 0))
    smoothed = smooth(plain / np.array([x[1] for x in page.lines]))
    cluster = (smoothed >= smoothed.std()) & (plain > 0)
    if not cluster.any():
        cluster = plain > 0
    if not cluster.any():
        return cluster
    below = np.zeros(len(parents))
    np.add.at(below, element, np.where(cluster, plain, 0))
    for e in range(len(parents) - 1, 0, -1):
        below[parents[e]] += below[e]
    # an article element with enough of the text, the innermost that still holds most of it; else the tightest element
    articles = [e for e in range(1, len(parents)) if page.tags[e] in ARTICLE and not apart[e] and below[e] >= ARTICLE_SHARE * below[0]]
    region, inside = 0, bool(articles)
    if articles:
        most = max(below[e] for e in articles)
        region = [e for e in articles if below[e] >= ELEMENT_SHARE * most][-1]
    else:
        for e in range(1, len(parents)):
            if parents[e] == region and below[e] >= ELEMENT_SHARE * below[0] and page.tags[e] not in ("li", "td", "tr"):
                region = e
    within = [False] * len(parents)
    within[region] = True
    for e in range(region + 1, len(parents)):
        within[e] = within[parents[e]]
    kept = np.array(within)[element] & ~beside & ~_menus(page, element, length, linked)
    if inside:
        return kept
    # without an article element: from the first to the last line of the cluster, and on over paragraphs and headings
    mostly_links = 2 * linked >= length
    hits = np.flatnonzero(kept & cluster)
    first, last = int(hits[0]), int(hits[-1])
    while first > 0 and kept[first - 1] and not mostly_links[first - 1] and page.lines[first - 1][4]:
        first -= 1
    while last + 1 < count and kept[last + 1] and not mostly_links[last + 1] and page.lines[last + 1][4] and page.lines[last + 1][4] not in HEADING:
        last += 1
    span = np.zeros(count, bool)
    span[first:last + 1] = True
    return kept & span & (cluster | ~mostly_links)


def _menus(page: Lines, element: np.ndarray, length: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Lines of lists with two items or more that hold nothing but links."""
    lists = [-1] * len(page.parents)
    for e in range(1, len(lists)):
        lists[e] = e if page.tags[e] in ("ul", "ol", "dl") else lists[page.parents[e]]
    of = np.array(lists)[element]
    text, links, lines = np.zeros(len(lists)), np.zeros(len(lists)), np.zeros(len(lists))
    listed = of >= 0
    np.add.at(text, of[listed], length[listed])
    np.add.at(links, of[listed], linked[listed])
    np.add.at(lines, of[listed], 1)
    return listed & (lines[of] >= 2) & (links[of] >= 0.9 * text[of])


def main_text(html: str | None) -> tuple[str, str]:
    """(main text, title) of one page."""
    if not html:
        return "", ""
    page = Lines().read(html)
    return "\n\n".join(x[0] for x, keep in zip(page.lines, content_lines(page)) if keep), page.title


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, title) for every row of ``pages``.

    A text is made of blocks joined by an empty line; inside a block white space is one blank and character references
    are decoded. n_chars counts code points. Null and empty pages, and pages without an article, have an empty text;
    null keys and urls stay, repeated rows stay, an empty table gives no rows, other columns are ignored. Pages are read
    whole, one at a time, and no row moves between tasks.
    """
    small_batches(pages)
    narrow = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [main_text(h.as_py()) for h in batch.column("html")]
            # a lone surrogate from a character reference has no UTF-8 form
            text = [t.encode("utf-8", "replace").decode("utf-8") for t, _ in found]
            title = [t.encode("utf-8", "replace").decode("utf-8") for _, t in found]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
                pa.array([len(t) for t in text], pa.int64()), pa.array(title, pa.string()),
            ], ["page_id", "url", "text", "n_chars", "title"])

    return narrow.mapInArrow(
        run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long, title string")
