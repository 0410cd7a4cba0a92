"""Main text of web pages: flat text blocks, judged by a decision tree.

A page is cut into blocks at block-level tags. Each block is described by its word count, its link
density, the same two figures of its neighbours, the kind of region it stands in and whether it is
a heading. A classification tree, trained when the job starts on the small labelled table below,
decides which blocks are main text. Where a page marks neither article nor frame, the figures of a
block and of its neighbours decide: a short line between menu links goes, one between paragraphs stays. Pages are handled one by one inside Arrow batches, so the work
is spread as the page table is and nothing is shuffled.

Defined results: a null or empty page gives an empty text; pages without any tag are one block;
unclosed tags end with the element around them; repeated rows are extracted one by one; blocks of
any length stay whole; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import small_batches

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>|[^>]*>)", re.S)
CUT_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")  # a tag that the end of the page cuts off
HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# never part of the text: code, styles, form values, drawings, inert or foreign documents, the page's name
RAW = {"script", "style", "template", "textarea", "select", "svg", "iframe", "title"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "source", "area", "base", "col", "embed", "param", "track"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT, PLAIN, FRAME = 2, 1, 0  # regions: inside an article, neither, page frame
FRAME_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button", "header", "label", "fieldset"}
FRAME_WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disclaimer", "footer", "header", "login", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "related", "reply", "replies", "share",
    "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "navigation",
    "contentinfo", "complementary", "search", "disqus", "gdpr", "skip",
}
# words that may stand beside a frame word in a compound class such as `site-footer`; others (`no-sidebar`,
# `article-header`, `has-banner`) give the compound another meaning
BESIDE = {
    "area", "bar", "block", "bottom", "box", "container", "content", "global", "inner", "item", "left", "link", "links",
    "list", "main", "mobile", "outer", "page", "panel", "post", "primary", "reader", "right", "secondary", "section", "site",
    "slot", "top", "user", "wrap", "wrapper",
}
COMMENT_WORDS = {"comment", "comments", "reply", "replies"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    region: int
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _class_words(rest: str, allowed: set[str]) -> bool:
    """Whether a class, id or role names one of the `allowed` words, whole or beside neutral words."""
    for match in HINT.finditer(rest):
        for name in (match[1] or match[2] or match[3] or "").lower().split():
            parts = {w for w in re.split(r"[^a-z]+", name) if w}
            if not parts.isdisjoint(allowed) and parts <= allowed | BESIDE:
                return True
    return False


def _region(tag: str, rest: str, outer: int) -> int:
    named = "=" in rest
    if tag in ("article", "main"):
        return CONTENT if outer != FRAME and not (named and _class_words(rest, COMMENT_WORDS)) else FRAME
    if tag in FRAME_TAGS and not (tag == "header" and outer == CONTENT):
        return FRAME
    if tag == "noscript" and outer != CONTENT:
        return FRAME
    if tag not in ("html", "body", *HEADINGS) and named:
        if _class_words(rest, FRAME_WORDS - {"header"} if outer == CONTENT else FRAME_WORDS):
            return FRAME
    return outer


def page_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space folded, character references decoded."""
    blocks: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = links = heading = 0
    region = PLAIN

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                words = text.count(" ") + 1
                blocks.append(Block(text, words, min(linked, words), region, heading > 0))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.split())

    at, end = 0, page.rfind(">") + 1
    while True:
        found = TAG.search(page, at, end) if at < end else None
        if found is None:
            add(CUT_TAG.sub("", page[at:]))
            break
        add(page[at:found.start()])
        at = found.end()
        if found[2] is None:
            continue
        closing, tag, rest = found[1] == "/", found[2].lower(), found[3]
        if not closing and tag in RAW:
            if not rest.endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    for name, _ in stack[i:]:
                        heading -= name in HEADINGS
                    del stack[i:]
                    links = 0 if tag in BLOCKS else links
                    break
        else:
            if tag in BLOCKS and stack and stack[-1][0] == "p":
                stack.pop()
            if tag == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            if tag == "body":
                stack.clear()
                heading = 0
            outer = stack[-1][1] if stack else PLAIN
            inner = _region(tag, rest, outer)
            if tag in BLOCKS or inner != outer:
                if inner != outer:
                    flush()
                stack.append((tag, inner))
                heading += tag in HEADINGS
        region = stack[-1][1] if stack else PLAIN
    flush()
    return blocks


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "region", "heading")


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """The figures of every block, with those of its neighbours; zeros beyond the page."""
    figures = [(0.0, 0.0), *[(float(b.words), b.density) for b in blocks], (0.0, 0.0)]
    return [
        (*figures[i + 1], *figures[i], *figures[i + 2], float(b.region), float(b.heading)) for i, b in enumerate(blocks)
    ]


# labelled blocks, in the order of FEATURES with the label last (1: main text)
LABELLED = [
    # inside an article: prose, headings, short lines, linked lines, first and last blocks
    (60, 0.0, 45, 0.0, 80, 0.0, 2, 0, 1), (8, 0.0, 1, 1.0, 60, 0.0, 2, 1, 1), (1, 0.0, 40, 0.0, 30, 0.0, 2, 0, 1),
    (3, 0.0, 6, 0.0, 0, 0.0, 2, 0, 1), (25, 0.2, 70, 0.0, 55, 0.0, 2, 0, 1), (5, 1.0, 33, 0.0, 20, 0.0, 2, 0, 1),
    (2, 0.0, 2, 0.0, 2, 0.0, 2, 0, 1), (12, 0.0, 1, 1.0, 0, 0.0, 2, 1, 1), (400, 0.0, 10, 0.0, 12, 0.0, 2, 0, 1),
    (7, 0.0, 9, 0.0, 14, 0.0, 2, 0, 1), (1, 0.0, 14, 0.0, 9, 0.0, 2, 1, 1), (18, 0.5, 4, 1.0, 6, 0.0, 2, 0, 1),
    # the frame of a page: menus, adverts, notices, footers, forms, comments, long and short
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (9, 0.0, 1, 1.0, 12, 0.0, 0, 0, 0),
    (40, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), (14, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0), (120, 0.0, 90, 0.0, 70, 0.0, 0, 0, 0),
    (3, 0.0, 2, 0.0, 50, 0.0, 0, 1, 0), (22, 0.1, 8, 0.0, 8, 0.0, 0, 0, 0), (6, 0.5, 6, 0.5, 6, 0.5, 0, 0, 0),
    (2, 0.0, 0, 0.0, 5, 0.0, 0, 0, 0), (75, 0.0, 11, 0.0, 1, 1.0, 0, 0, 0), (5, 1.0, 33, 0.0, 20, 0.0, 0, 0, 0),
    # pages without marked regions: prose and its headings stay, link rows and lone short lines go
    (55, 0.0, 4, 0.0, 60, 0.0, 1, 0, 1), (30, 0.1, 45, 0.0, 12, 0.0, 1, 0, 1), (90, 0.0, 1, 1.0, 3, 0.0, 1, 0, 1),
    (20, 0.0, 2, 1.0, 35, 0.0, 1, 0, 1), (16, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (140, 0.05, 6, 0.0, 2, 1.0, 1, 0, 1),
    (6, 0.0, 2, 1.0, 50, 0.0, 1, 1, 1), (9, 0.0, 40, 0.0, 70, 0.0, 1, 1, 1), (8, 0.0, 60, 0.0, 42, 0.0, 1, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (2, 1.0, 3, 1.0, 2, 1.0, 1, 0, 0), (12, 0.9, 4, 1.0, 8, 0.8, 1, 0, 0),
    (25, 0.8, 2, 1.0, 30, 0.9, 1, 0, 0), (4, 1.0, 30, 0.0, 60, 0.0, 1, 0, 0), (3, 0.5, 1, 1.0, 2, 1.0, 1, 0, 0),
    # without marked regions, told by the neighbours: captions and notes of link rows go, lines between prose stay
    (3, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0), (1, 0.0, 0, 0.0, 1, 1.0, 1, 0, 0), (2, 0.0, 1, 1.0, 2, 1.0, 1, 1, 0),
    (5, 0.0, 3, 1.0, 0, 0.0, 1, 0, 0), (8, 0.0, 2, 1.0, 0, 0.0, 1, 0, 0), (4, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0),
    (6, 0.0, 4, 0.9, 2, 1.0, 1, 1, 0), (2, 0.0, 0, 0.0, 1, 1.0, 1, 1, 0), (7, 0.0, 1, 1.0, 3, 1.0, 1, 0, 0),
    (10, 0.0, 5, 1.0, 4, 1.0, 1, 0, 0), (3, 0.0, 1, 1.0, 0, 0.0, 1, 0, 0), (9, 0.0, 2, 0.8, 0, 0.0, 1, 0, 0),
    (4, 0.0, 50, 0.0, 60, 0.0, 1, 0, 1), (2, 0.0, 30, 0.0, 45, 0.0, 1, 1, 1), (3, 0.0, 1, 1.0, 40, 0.0, 1, 1, 1),
    (5, 0.0, 25, 0.0, 0, 0.0, 1, 0, 1), (1, 0.0, 20, 0.0, 30, 0.0, 1, 0, 1), (7, 0.0, 80, 0.0, 12, 0.0, 1, 0, 1),
    (9, 0.0, 35, 0.0, 2, 1.0, 1, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (4, 0.0, 0, 0.0, 25, 0.0, 1, 1, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (7, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (3, 0.0, 22, 0.0, 4, 0.0, 1, 0, 1),
    (6, 0.0, 1, 1.0, 28, 0.0, 1, 0, 1), (45, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1), (70, 0.1, 3, 1.0, 0, 0.0, 1, 0, 1),
    # the same figures inside an article stay
    (3, 0.0, 2, 1.0, 3, 1.0, 2, 0, 1), (1, 0.0, 0, 0.0, 1, 1.0, 2, 0, 1), (2, 0.0, 1, 1.0, 2, 1.0, 2, 1, 1),
    (5, 0.0, 3, 1.0, 0, 0.0, 2, 0, 1), (4, 0.0, 1, 1.0, 1, 1.0, 2, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 2, 0, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 2, 0, 1), (12, 0.9, 4, 1.0, 8, 0.8, 2, 0, 1), (10, 0.7, 15, 0.0, 1, 1.0, 2, 0, 1),
    (15, 1.0, 50, 0.0, 12, 1.0, 1, 0, 0), (2, 0.6, 2, 0.6, 40, 0.0, 1, 0, 0), (10, 0.7, 15, 0.0, 1, 1.0, 1, 0, 0),
]


def _gini(labels: list[int]) -> float:
    share = sum(labels) / len(labels)
    return 2 * share * (1 - share) * len(labels)


def fit_tree(rows: list[tuple], depth: int = 8, least: int = 2):
    """A classification tree on rows with the label last: a label, or (feature, threshold, low, high)."""
    labels = [r[-1] for r in rows]
    majority = int(2 * sum(labels) >= len(labels))
    best = None
    if depth and 0 < sum(labels) < len(labels):
        for k in range(len(rows[0]) - 1):
            values = sorted({r[k] for r in rows})
            for low, high in zip(values, values[1:], strict=False):
                cut = (low + high) / 2
                left, right = [r[-1] for r in rows if r[k] <= cut], [r[-1] for r in rows if r[k] > cut]
                if min(len(left), len(right)) >= least:
                    impurity = _gini(left) + _gini(right)
                    if best is None or impurity < best[0] - 1e-12:
                        best = impurity, k, cut
    if best is None or best[0] >= _gini(labels) - 1e-12:
        return majority
    _, k, cut = best
    return k, cut, fit_tree([r for r in rows if r[k] <= cut], depth - 1, least), fit_tree(
        [r for r in rows if r[k] > cut], depth - 1, least)


def decide(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        k, cut, low, high = tree
        tree = low if row[k] <= cut else high
    return tree


def main_text(page: str | None, tree) -> str:
    if not page:
        return ""
    blocks = page_blocks(page)
    return " ".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if decide(tree, row))


def extract(pages: DataFrame, labelled: list[tuple] | None = None, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = fit_tree(labelled or LABELLED)
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ids = pages.select("page_id", "url", F.col(html_col).alias("html"))
    types = dict(ids.dtypes)
    return ids.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
