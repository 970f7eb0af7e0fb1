"""Main text of HTML pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, in_batches, text_batches, texts_of

# HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
OPEN_ENDED = set("svg math template noscript".split())
BLOCK = set(
    "html body article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset blockquote pre figure figcaption address details summary hr center dialog menu search hgroup legend optgroup option select button".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = set("ul ol dl table tbody thead tfoot select div article section main body".split())
# Parts that aren't the article, by element, role and word of a class or id.
ASIDE = set("nav footer aside button select option menu dialog search head".split())
#: Like a listed role or word, these mark a part only if it isn't the one with most of the page's prose.
ASIDE_MAYBE = set("form fieldset".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottombar cookie cookies consent gdpr notice notification popup modal overlay toolbar newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus reply replies respond skip pagination pager widget".split()
)
#: Words that say of what shape a part is; a name that has others too, such as market-share, is no mark.
SHAPE_WORDS = set("area bar block bottom box btn button buttons col column container content div area form group head heading icon icons inner item items left link links list main outer page panel placeholder post posts right row section site slot small text thread title top unit widgets wrap wrapper".split())
ROOT_TAGS = ("article", "main")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements whose own id is an anchor, and those in which classes say how code is coloured.
ANCHORED, CODE = HEADINGS | {"p"}, set("pre code kbd samp".split())
#: What belongs to an article by its kind, short as it may be.
MATTER = set("table pre blockquote figcaption caption dl".split())
#: Elements that can hold an article.
HOLDERS = set("body div article main section td form center".split())
#: Elements that are a part of the page, not a piece of a list, table or figure.
PARTS = HOLDERS - {"td"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟،]")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: A path's ratio counts as content from this share of the page's mean deviation on.
THRESHOLD = 0.8
#: Half the width of the smoothing window over the page's blocks.
SPAN = 1
#: Prior of a block inside an article or main element, outside if the page has one, and in a part that is marked as standing aside.
INSIDE, OUTSIDE, MARKED = 2.0, 0.5, 0.1


class Page:
    """A page's text blocks in order, without what is no text of its body: text, path, enclosing element, whether most of it is links, whether it is in a marked part.

    A block's path has the block elements only, and tells blocks that are links, or in marked parts, from others.
    """

    def __init__(self, html: str):
        self.text: list[str] = []
        self.path: list[int] = []
        self.inside: list[int] = []
        self.linked: list[bool] = []
        self.marked: list[bool] = []
        self.parent = [0]
        self.root_tag = [False]
        self.tag_of = ["body"]
        # Of each element: None, "" if it stands aside for sure, or the marks for which it may.
        self._mark: list[str | None] = [None]
        self._paths: dict[tuple[int, str], int] = {}
        # Open elements: tag, path, element, whether in a link.
        self._open: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self._count: dict[str, int] = {}
        self._parts: list[tuple[str, int, bool]] = []
        self._blocks: list[tuple[int, int, list[tuple[str, int, bool]]]] = []
        self._read(html)
        self._settle()

    def _flush(self) -> None:
        if self._parts:
            _, path, element, _ = next(x for x in reversed(self._open) if x[0] in BLOCK or not x[0])
            self._blocks.append((path, element, self._parts))
            self._parts = []

    def _settle(self) -> None:
        """Drops the pieces that stand aside by their element, or inside a block by a mark, and joins the others to blocks."""
        n = len(self.parent)
        # The nearest marked element of each, and whether any stands aside for sure.
        near, gone = [0] * n, [False] * n
        for e in range(1, n):
            up, mark = self.parent[e], self._mark[e]
            near[e] = e if mark else near[up]
            gone[e] = gone[up] or mark == ""
        prose = [0.0] * n
        named = 0.0
        in_root = [False] * n
        for e in range(1, n):
            in_root[e] = in_root[self.parent[e]] or self.root_tag[e]
        for _, _, parts in self._blocks:
            for piece, e, link in parts:
                if not gone[e] and (size := len(piece.strip())):
                    size *= 0.1 if link or not _PUNCTUATION.search(piece) else 1
                    prose[near[e]] += size
                    named += size if in_root[e] and not near[e] else 0
        # A marked part with most of the page's prose is the article; so are its like, and what holds it.
        real = set()
        best = max(range(n), key=lambda e: (prose[e], -e))
        if best and prose[best] >= 2 * prose[0] and named < 0.2 * sum(prose):
            for e in range(1, n):
                if e == best or (self._mark[e] == self._mark[best] and self.parent[e] == self.parent[best]):
                    while e:
                        real.add(e)
                        e = self.parent[e]
        # Gone: by its element, or a marked piece inside a block. Faint: a marked block.
        faint = [False] * n
        gone = [False] * n
        for e in range(1, n):
            mark = bool(self._mark[e]) and e not in real
            gone[e] = gone[self.parent[e]] or self._mark[e] == "" or (mark and self.tag_of[e] not in BLOCK)
            faint[e] = faint[self.parent[e]] or (mark and self.tag_of[e] in BLOCK)
        for e in range(n):
            self.root_tag[e] = self.root_tag[e] and not gone[e] and not faint[e]
        for path, element, parts in self._blocks:
            parts = [x for x in parts if not gone[x[1]]]
            text = " ".join("".join([x[0] for x in parts]).split())
            if text:
                linked = 2 * sum(len(x[0]) for x in parts if x[2]) > len(text)
                for kind, holds in (("a", linked), ("mark", faint[element])):
                    path = self._paths.setdefault((path, kind), len(self._paths) + 1) if holds else path
                self.text.append(text)
                self.path.append(path)
                self.inside.append(element)
                self.linked.append(linked)
                self.marked.append(faint[element])

    def _pop(self, n: int) -> None:
        for tag, *_ in self._open[n:]:
            self._count[tag] -= 1
        del self._open[n:]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Closes the innermost of these elements, unless one of stop is nearer."""
        if any(self._count.get(t) for t in tags):
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k][0] in tags:
                    self._pop(k)
                    return
                if self._open[k][0] in stop:
                    return

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            start = m.start() if m else n
            if start > at:
                self._say(html[at:start])
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._end(tag)
                continue
            at = self._start(tag, m[3] or m[6] or "", html, at)
        self._flush()

    def _say(self, raw: str) -> None:
        _, _, element, link = self._open[-1]
        self._parts.append((unescape(raw) if "&" in raw else raw, element, link))

    def _end(self, tag: str) -> None:
        if tag in BLOCK or tag == "br":
            self._flush() if tag != "br" else self._say(" ")
        if self._count.get(tag):
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k][0] == tag:
                    self._pop(k)
                    break

    def _start(self, tag: str, attributes: str, html: str, at: int) -> int:
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            if attributes.endswith("/") and tag in ("svg", "math"):
                return at
            if not end:  # the others end with the page only where browsers read them as text
                return at if tag in OPEN_ENDED else len(html)
            close = html.find(">", end.end())
            return close + 1 if close >= 0 else len(html)
        if tag == "br":
            self._say(" ")
            return at
        if tag in BLOCK:
            self._flush()
            self._close({"p"}, {"button", "table", "td", "th"})
            if tag in CLOSED_BY:
                self._close(CLOSED_BY[tag], CONTAINERS)
        if tag in VOID:
            return at
        _, path, element, link = self._open[-1]
        root = tag in ROOT_TAGS
        inside = any(self._count.get(t) for t in ROOT_TAGS)
        sure, marks = tag in ASIDE or (tag == "header" and not inside), [tag] if tag in ASIDE_MAYBE else []
        if attributes:
            for name, *value in _NAMED.findall(attributes):
                name, value = name.lower(), "".join(value)
                if name in ("class", "id"):
                    if tag in ("html", "body") or (name == "id" and tag in ANCHORED) or tag in CODE or any(self._count.get(t) for t in CODE):
                        continue
                    for one in value.split():
                        words = [w.lower() for w in _WORDS.findall(one) if not w.isdigit()]
                        said = [w for w in words if w in ASIDE_WORDS and not (inside and w == "header")]
                        marks += said if all(w in ASIDE_WORDS or (w in SHAPE_WORDS and tag not in ANCHORED) for w in words) else []
                elif name == "role":
                    root = root or value.lower() in ROOT_TAGS
                    marks += [value.lower()] if value.lower() in ASIDE_ROLES else []
                elif name == "itemprop":
                    root = root or value.lower() == "articlebody"
                elif name == "hidden" or value.lower() == "true":
                    sure = True
        if tag in BLOCK:
            path = self._paths.setdefault((path, tag), len(self._paths) + 1)
        if tag in BLOCK or sure or marks or root:
            self.parent.append(element)
            element = len(self.parent) - 1
            self.root_tag.append(root and not sure)
            self.tag_of.append(tag)
            self._mark.append("" if sure else " ".join(marks) or None)
        self._open.append((tag, path, element, link or tag == "a"))
        self._count[tag] = self._count.get(tag, 0) + 1
        return at


def path_scores(length: np.ndarray, marks: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block's fused ratio as a geometric mean: text length and punctuation per node of its path, as they are and smoothed over the page."""
    _, at, nodes = np.unique(path, return_inverse=True, return_counts=True)
    plain, smooth = np.ones(len(path)), np.ones(len(path))
    for x in (length, marks):
        ratio = (np.bincount(at, x) / nodes)[at]
        plain *= ratio + 1
        smooth *= np.convolve(np.pad(ratio, SPAN, mode="edge"), np.full(2 * SPAN + 1, 1 / (2 * SPAN + 1)), mode="valid") + 1
    return np.sqrt(plain), np.sqrt(smooth)


def main_text(html: str) -> str:
    """The article's blocks, joined by line ends.

    Scripts, menus, footers, forms' controls and hidden parts aren't text of the body, nor are marked pieces inside a
    block. Of all other blocks the tag paths' ratios tell content: a path is content if its mean score reaches the
    threshold, where article and main elements, and marks of notices, adverts, sidebars, comments and such, are priors; a
    mark doesn't count if its part has most of the page's prose. What lies between content in the same part stays with
    it, short as it may be, unless it is links or marked; so do tables, code, quotes, captions and definitions inside an
    article element. Headings stay with something of their section.
    """
    if not html:
        return ""
    page = Page(html)
    n = len(page.text)
    if not n:
        return ""
    length = np.array([len(t) for t in page.text], np.float64)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in page.text], np.float64)
    path, inside, linked, faint = np.array(page.path), np.array(page.inside), np.array(page.linked), np.array(page.marked)
    named = np.array(page.root_tag)
    for e in range(1, len(named)):
        named[e] = named[e] or named[page.parent[e]]
    in_root = named[inside]
    has_root = bool(in_root.any())
    prior = np.where(faint, MARKED, 1.0) * (np.where(in_root, INSIDE, OUTSIDE) if has_root else 1.0)
    plain, score = (x * prior for x in path_scores(length, marks, path))
    least = THRESHOLD * score.std()
    _, at, nodes = np.unique(path, return_inverse=True, return_counts=True)
    content = ((np.bincount(at, score) / nodes)[at] >= least) & (2 * plain >= least)
    if not content.any():
        return ""
    area = _area(page, content, in_root, has_root)
    keep = area & (content | ~linked & ~faint & (_between(page, content & area) | _matter(page, content & area, in_root)))
    # A heading stays if something of its section does; above the article's part if it stands just before what stays.
    rank, held = [int(page.tag_of[e][1]) if page.tag_of[e] in HEADINGS else 7 for e in page.inside], 0
    for k in range(n - 1, -1, -1):
        if rank[k] < 7:
            keep[k] = not faint[k] and (held > rank[k] if area[k] else not has_root and k + 1 < n and keep[k + 1])
            held = min(held, rank[k])
        elif keep[k]:
            held = 7
    return "\n".join(t for t, kept in zip(page.text, keep, strict=True) if kept)


def _area(page: Page, content: np.ndarray, in_root: np.ndarray, has_root: bool) -> np.ndarray:
    """The blocks among which the article is: those in article elements if any of these is content, else those of the innermost element that holds all content, which must be one that can hold several blocks."""
    if has_root and (content & in_root).any():
        return in_root
    n = len(page.parent)
    held, blocks = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(held, page.inside, content)
    np.add.at(blocks, page.inside, 1)
    # Elements come after those that enclose them.
    for e in range(n - 1, 0, -1):
        held[page.parent[e]] += held[e]
        blocks[page.parent[e]] += blocks[e]
    holder = max(e for e in range(n) if held[e] == held[0] and (not e or (page.tag_of[e] in HOLDERS and blocks[e] > 1)))
    within = np.zeros(n, bool)
    for e in range(n):
        within[e] = e == holder or (e > 0 and within[page.parent[e]])
    return within[page.inside]


def _parts(page: Page) -> list[int]:
    """Of each element the nearest one around it, or itself, that isn't a piece of a list, table or figure."""
    part = [0] * len(page.parent)
    for e in range(1, len(part)):
        part[e] = e if page.tag_of[e] in PARTS else part[page.parent[e]]
    return part


def _between(page: Page, content: np.ndarray) -> np.ndarray:
    """Blocks with content before and after them in their part."""
    part, n = _parts(page), len(page.text)
    first, last = [n] * len(part), [-1] * len(part)
    for k in np.flatnonzero(content).tolist():
        e = part[page.inside[k]]
        first[e], last[e] = min(first[e], k), max(last[e], k)
    for e in range(len(part) - 1, 0, -1):
        up = page.parent[e]
        first[up], last[up] = min(first[up], first[e]), max(last[up], last[e])
    return np.array([first[part[e]] < k < last[part[e]] for k, e in enumerate(page.inside)], bool)


def _matter(page: Page, content: np.ndarray, in_root: np.ndarray) -> np.ndarray:
    """Blocks of tables, code, quotes and such inside an article element, or beside content in a part; a table around the content is layout."""
    part, n = _parts(page), len(page.parent)
    around, beside = [False] * n, {part[page.inside[k]] for k in np.flatnonzero(content).tolist()}
    for k in np.flatnonzero(content).tolist():
        around[page.inside[k]] = True
    for e in range(n - 1, 0, -1):
        around[page.parent[e]] |= around[e]
    held, layout = [False] * n, [False] * n
    for e in range(1, n):
        own = page.tag_of[e] in MATTER
        held[e], layout[e] = held[page.parent[e]] or own, layout[page.parent[e]] or (own and around[e])
    return np.array([held[e] and (bool(in_root[k]) or (part[e] in beside and not layout[e])) for k, e in enumerate(page.inside)], bool)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Main text of every whole page: page_id, url, text, n_chars (code points). A map over the rows: no shuffle.

    A null or empty html, and a page without an article, give an empty text; null ids and urls stay null; repeated rows
    each have a row; an empty table gives no rows; a very long page is read whole; other columns are ignored.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "html"):
            texts = [main_text(h) for h in texts_of(batch, "html")]
            yield emit(schema, page_id=batch.column(0), url=batch.column(1).cast(pa.string()), text=texts, n_chars=[len(t) for t in texts])

    return in_batches(src, run, "page_id long, url string, text string, n_chars long")
