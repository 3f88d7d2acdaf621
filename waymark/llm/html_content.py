"""Main text of web pages: parser events become lines, lines have a ratio of text to tags, the ratio is smoothed and cut by a
threshold, and the region that holds what is above it is the article."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure_text

# Elements of HTML.
#: Their content is no text of the page.
UNSEEN = frozenset("script style head title noscript template svg math canvas iframe object audio video select datalist textarea button".split())
#: Have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Begin and end a line and may hold others.
BOXES = frozenset("html body article section main div nav aside header footer form fieldset dialog menu ul ol dl table thead tbody tfoot tr td th "
                  "details figure blockquote address hgroup search center".split())
#: Begin and end a line.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd caption figcaption pre summary legend option".split())
#: Boxes beside the article.
BESIDE = frozenset("nav aside footer header form dialog menu search".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Opening one of these closes an open one of the second kind that no box separates from it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
#: An end tag or implied end does not reach beyond these.
WALLS = frozenset("html body article section main div td th table nav aside header footer form ul ol dl blockquote figure details".split())
#: Words of class and id that name what is beside the article, and those that name the article.
BESIDE_NAMES = frozenset("ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars aside nav "
                         "navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert "
                         "popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus share sharing "
                         "social related recommended recommendations widget widgets pagination pager copyright disclaimer search searchbox form hidden".split())
ARTICLE_NAMES = frozenset("article content post entry story articlebody postbody maincontent".split())
#: Tags of a whole page.
PAGE = frozenset(("html", "body"))

#: Width of the smoothing in lines, and reach of its kernel.
SIGMA, REACH = 1.0, 3
#: Share of what is above the threshold that a part must hold to stand for the whole.
SHARE = 0.7
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Box:
    """An element that holds lines: its place in the tree and what its tag, role, class and id say of it."""

    __slots__ = ("tag", "parent", "beside", "article", "titled")

    def __init__(self, tag: str, parent: int, attrs: dict[str, str | None]):
        names = {w.lower() for key in ("class", "id") for w in NAME.findall(attrs.get(key) or "")}
        role = (attrs.get("role") or "").lower()
        style = (attrs.get("style") or "").replace(" ", "").lower()
        named = names & ARTICLE_NAMES or role in ("main", "article") or "articleBody" in (attrs.get("itemprop") or "")
        self.tag, self.parent, self.titled = tag, parent, False
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style
        self.beside = tag not in PAGE and bool(hidden or tag in BESIDE or role in BESIDE_ROLES or names & BESIDE_NAMES)
        self.article = 3 if tag == "article" else 2 if tag == "main" or role == "main" else 1 if named and tag in BOXES else 0


class Lines(HTMLParser):
    """Parser events as boxes and lines: (box, text, tags, characters in links, heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.boxes = [Box("html", -1, {})]
        self.lines: list[tuple[int, str, int, int, bool]] = []
        self.open: list[tuple[str, int]] = []  # tag, box or -1
        self.unseen, self.links = 0, 0
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.heading = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            box = next((b for _, b in reversed(self.open) if b >= 0), 0)
            self.lines.append((box, text, self.tags, self.linked, self.heading))
            self.boxes[box].titled |= self.heading
        self.parts, self.tags, self.linked, self.heading = [], 0, 0, False

    def close_to(self, at: int) -> None:
        """Ends all elements from place `at` of the open ones on."""
        for tag, box in reversed(self.open[at:]):
            if tag in BOXES or tag in LINES:
                self.flush()
            self.open.pop()
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"

    def place(self, tags: tuple[str, ...], walls: frozenset[str]) -> int:
        """Place of the innermost open element of one of the tags before a wall, or -1."""
        for at in range(len(self.open) - 1, -1, -1):
            tag = self.open[at][0]
            if tag in tags:
                return at
            if tag in walls:
                break
        return -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag == "body" and self.unseen:  # an unclosed head
            self.close_to(0)
        box, block = -1, tag in BOXES or tag in LINES
        if block:
            if tag in ("html", "body") and any(t == tag for t, _ in self.open):
                return
            if tag in CLOSES:
                if (at := self.place(CLOSES[tag], WALLS - {"td", "th"} if tag in ("td", "th", "tr") else WALLS)) >= 0:
                    self.close_to(at)
            if tag not in ("td", "th", "tr") and (at := self.place(("p", "h1", "h2", "h3", "h4", "h5", "h6"), WALLS | {"li", "dd", "dt"})) >= 0:
                self.close_to(at)
            self.flush()
            self.tags = 1
        known = {k: v for k, v in reversed(attrs)}
        if tag in BOXES or block and (known.get("class") or known.get("id") or known.get("role") or known.get("style") or "hidden" in known):
            parent = next((b for _, b in reversed(self.open) if b >= 0), 0)
            self.boxes.append(Box(tag, parent, known))
            box = len(self.boxes) - 1
        self.open.append((tag, box))
        self.heading = self.heading or tag in ("h1", "h2")
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in UNSEEN:  # such as an empty drawing; other elements stay open, as browsers do
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in PAGE:  # what follows the end of the page still belongs to it
            self.flush()
            return
        inline = tag not in BOXES and tag not in UNSEEN
        at = self.place((tag,), (WALLS if tag not in ("td", "th") else WALLS - {"td", "th"}) - {tag} if inline else PAGE)
        if at >= 0:
            if inline and tag not in LINES:  # an inline element ends alone
                self.open.pop(at)
                self.links -= tag == "a"
            else:
                self.close_to(at)
        elif tag in LINES:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.unseen and data:
            self.parts.append(data)
            if self.links:
                self.linked += len(data) - data.count(" ")

    def read(self, html: str) -> None:
        last = html.rfind("<")
        if last >= 0 and ">" not in html[last:] and re.match(r"<[A-Za-z/!?]", html[last:last + 2]):
            html = html[:last]  # a tag that is cut off
        self.feed(html)
        self.close()
        self.close_to(0)
        self.flush()


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Gaussian mean over neighbouring lines."""
    kernel = np.exp(-np.arange(-REACH, REACH + 1) ** 2 / (2 * SIGMA * SIGMA))
    ones = np.convolve(np.ones(len(ratio)), kernel)[REACH:REACH + len(ratio)]
    return np.convolve(ratio, kernel)[REACH:REACH + len(ratio)] / ones


def content(page: Lines) -> list[str]:
    """Texts of the lines of the article, in page order."""
    lines, boxes = page.lines, page.boxes
    if not lines:
        return []
    box = np.array([x[0] for x in lines])
    chars = np.array([len(x[1]) - x[1].count(" ") for x in lines], float)
    ratio = smoothed(chars / np.maximum([x[2] for x in lines], 1))
    high = ratio >= ratio.std()  # clustered by one threshold: content above, the rest below
    linked = np.array([x[3] for x in lines]) > 0.6 * chars
    # of each box: whether something beside the article is above it, and its nearest article
    beside, inner = np.zeros(len(boxes), bool), np.full(len(boxes), -1)
    for i, b in enumerate(boxes):
        up = b.parent
        # the head of an article is part of it
        own = b.beside and not (b.tag == "header" and up >= 0 and inner[up] >= 0) and b.article < 2
        beside[i] = own or up >= 0 and beside[up]
        inner[i] = i if b.article == 3 else inner[up] if up >= 0 else -1
    weight = np.where(high & ~linked, chars, 0.0)
    free = ~beside[box]

    def within(root: int) -> np.ndarray:
        """Whether each box is root or below it."""
        out = np.zeros(len(boxes), bool)
        out[root] = True
        for i in range(root + 1, len(boxes)):
            out[i] = out[boxes[i].parent]
        return out

    articles = sorted(set(inner[box].tolist()) - {-1})
    for allowed in (free, np.ones(len(lines), bool)):  # articles inside what looks like a form or a banner only where no other is
        best = max(((weight[own].sum(), chars[own].sum(), -a) for a in articles if (own := (inner[box] == a) & allowed).any()), default=None)
        if best:
            root = -best[2]
            clear = _clear_below(boxes, root)
            return [x[1] for x, i in zip(lines, box) if inner[i] == root and clear[i]]
    # no article element: down from the page, the main element or a box named like the article, to the box that holds most
    roots = sorted((i for i, b in enumerate(boxes) if b.article), key=lambda i: (-boxes[i].article, i))
    root = max(((boxes[i].article == 2, (weight * free)[within(i)[box]].sum(), -i) for i in roots), default=None)
    root = -root[2] if root and root[1] > 0 else 0
    if not (free & within(root)[box]).any():
        free = np.ones(len(lines), bool)
    mass = np.zeros(len(boxes))
    np.add.at(mass, box[free], weight[free])
    for i in range(len(boxes) - 1, 0, -1):
        mass[boxes[i].parent] += mass[i]
    titled = [False] * len(boxes)
    for i in set(box[free].tolist()):
        titled[i] = boxes[i].titled
    while True:
        below = max(((mass[i], -i) for i in range(root + 1, len(boxes)) if boxes[i].parent == root), default=(0, 0))
        if not mass[root] or below[0] < SHARE * mass[root] or titled[root]:
            break
        root = -below[1]
    clear, inside = _clear_below(boxes, root) | (not free.any()), within(root)
    # boxes of the region of which no line is above the threshold and most are links are lists of links
    poor = {i for i in set(box.tolist()) if not (high & ~linked)[box == i].any() and linked[box == i].mean() > 0.5}
    return [x[1] for x, i in zip(lines, box) if inside[i] and clear[i] and i not in poor]


def _clear_below(boxes: list[Box], root: int) -> np.ndarray:
    """Whether each box is root, or below it with nothing beside the article between."""
    out = np.zeros(len(boxes), bool)
    out[root] = True
    for i in range(root + 1, len(boxes)):
        b = boxes[i]
        out[i] = out[b.parent] and not (b.beside and not (b.tag == "header" and not b.article))
    return out


def main_text(html: str | None) -> tuple[str, int, int]:
    """The article's text, and how many lines the page and the article have."""
    page = Lines()
    page.read(html or "")
    kept = content(page)
    return "\n".join(kept), len(page.lines), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text), n_lines, n_kept of every row of pages (page_id, url, html).

    The text is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
    reader comments. Character references are decoded, white space inside a block (any that Unicode calls so, and line
    breaks) is one space, blocks are joined by one newline. An article element is taken whole but for what is beside it;
    without one, the box that holds most of the text above the threshold.

    NULL, empty and text-less pages: the empty string. Plain text without tags is one block. Very long pages are parsed
    whole, one at a time. Cut-off pages end where they end. Rows that repeat, NULL ids and urls stay as they are; other
    columns are not read. Empty table: no rows.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(html.as_py()) for html in b.column("html")]
            texts = [x[0] for x in found]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                                   pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())],
                                  ["page_id", "url", "text", "n_chars", "n_lines", "n_kept"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_lines long, n_kept long")


def op11_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = configure_text(spark).read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return extract(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).select("page_id", "url", "text", "n_chars")
