"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into text blocks at block-level tags. A block's features are its word count and link density, those of
its neighbours, and what the text says of the boxes around it: how much of the page's text the article holds, and for the
nearest box that calls itself furniture, by tag or by class, id and role, how strong that claim is, its share of the page's text, its link density
and its words a block. A name alone decides nothing: a wrapper called ``has-sidebar`` that holds the prose of the page is
told from a sidebar by those numbers. A decision tree marks blocks as content or not. It is grown, once a process, on the
blocks of the short pages in ``WRITTEN``, whose texts carry their labels. Content blocks are joined in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import table
from .batches import slices

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "object", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FURNITURE = {"nav", "aside", "footer", "header", "form", "menu", "button", "select", "option", "dialog", "head", "search", "label"}
# Names that boxes without main text give themselves; whole names count more than parts of one.
_HINTS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter "
    "notice notices outbrain pager pagination paywall popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "adsbygoogle taboola tags toolbar topbar widget widgets alert contentinfo complementary search form".split()
)

# Words that say where a box is or how it is built. A name made of hints and these (``left-sidebar``, ``ad-slot``) says as much
# as the hint alone; with other words in it (``has-sidebar``, ``notice-of-motion``) it may be about anything.
_PLAIN = frozenset(
    "area bar bars block blocks body bottom box boxes btn btns button buttons center cell col column container content feed fixed global group grid holder icons inner item items large left link links list "
    "main mobile outer page panel placeholder posts primary region right row rail secondary section site slot small stack sticky strip thread top unit wrap wrapper zone".split()
)

FEATURES = (
    "article", "article_share", "claim", "box_share", "box_links", "box_words", "links", "links_both", "links_either", "links_before", "links_after", "words", "words_before", "words_after", "heading",
)


class Box:
    """An open element: its furniture tag or name, and the words, linked words and blocks inside.

    ``clearest`` is, of the box and those around it, the one that says furniture most clearly, the smallest of these.
    """

    __slots__ = ("blocks", "clearest", "linked", "name", "tagged", "up", "words")

    def __init__(self, tagged: bool, name: int, up: Box | None) -> None:
        self.tagged, self.name, self.up = tagged, name, up
        self.words = self.linked = self.blocks = 0
        self.clearest = self if up is None or self.claim >= up.clearest.claim else up.clearest

    @property
    def claim(self) -> int:
        return 2 * self.tagged + self.name

    def add(self, words: int, linked: int, blocks: int) -> None:
        self.words += words
        self.linked += linked
        self.blocks += blocks


class Block:
    __slots__ = ("article", "box", "heading", "linked", "text", "words")

    def __init__(self, text: str, words: int, linked: int, article: bool, box: Box | None, heading: bool) -> None:
        self.text, self.words, self.linked = text, words, linked
        self.article, self.box, self.heading = article, box, heading
        if box:
            box.add(words, linked, 1)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; markup that is never shown as text is gone, references are decoded."""
    found: list[Block] = []
    stack: list[tuple[str, Box | None, bool, bool]] = []  # tag, furniture around it, in an article, hidden
    boxes: list[Box] = []
    run: list[str] = []
    linked = 0
    links = within = 0  # whether a link is open, and how many elements were when it began
    inline: dict[str, int] = {}
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        words = "".join(run).split()
        top = stack[-1] if stack else ("", None, False, False)
        if words and not top[3]:
            head = any(t[0] in _HEADS for t in stack[-2:])
            found.append(Block(" ".join(words), len(words), min(linked, len(words)), top[2], top[1], head))
        run.clear()
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            run.append(text)
            if links:
                linked += len(text.split())

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not closing and tag in _RAW:
            if tag not in {"svg", "math"}:
                flush()
            if not attrs.rstrip().endswith("/"):
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                # of what is never closed only scripts and styles take the rest of the page with them
                at = end.end() if end else n if tag in {"script", "style"} else at
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag == "a":
            links, within = 0 if closing else 1, len(stack)
            continue
        if tag not in _BLOCK and tag not in _FURNITURE:
            # an inline element that calls itself furniture is a block of its own, with those of its name inside it
            if tag in _VOID or not inline.get(tag) and (closing or not any(_named(attrs))):
                continue
            inline[tag] = inline.get(tag, 0) + (-1 if closing else 1)
        elif tag in _BLOCK:
            flush()
        if closing:
            if opened[tag]:
                flush()
                while stack[-1][0] != tag:
                    if (left := stack.pop()[0]) in inline:
                        inline[left] -= 1
                    opened[left] -= 1
                stack.pop()
                opened[tag] -= 1
                links = links if len(stack) >= within else 0  # a link ends with what it began in
            continue
        if tag in _VOID:
            continue
        if tag in {"p", *_HEADS, "li", "dt", "dd", "option", "tr", "td", "th"}:
            # these end at the next of their kind, closed or not
            while stack and stack[-1][0] in ({"p", *_HEADS} if tag not in {"li", "dt", "dd", "tr", "td", "th", "option"} else {"p", tag}):
                opened[stack.pop()[0]] -= 1
            links = links if len(stack) >= within else 0
        up = stack[-1] if stack else ("", None, False, False)
        name, hidden = _named(attrs)
        main = tag in ("article", "main")
        tagged = tag in _FURNITURE and not (tag == "header" and up[2])
        around = None if main and up[1] and not name else up[1]  # an article begins anew, whatever was left open before it
        if tagged or name:
            around = Box(tagged, name, around)
            boxes.append(around)
        if tag not in _BLOCK:
            flush()
        stack.append((tag, around, up[2] or main, up[3] or hidden))
        opened[tag] += 1
    flush()
    for box in reversed(boxes):
        if box.up:
            box.up.add(box.words, box.linked, box.blocks)
    return found


def _named(attrs: str) -> tuple[int, bool]:
    """Whether an element calls itself furniture (2 by a whole name, 1 by a part of one), and whether it is hidden."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return 0, False
    level, hidden = 0, False
    for m in _ATTR.finditer(attrs):
        attr, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if attr == "hidden" or attr == "aria-hidden" and value == "true":
            hidden = True
        elif attr == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif attr != "aria-hidden":
            for word in value.split():
                parts = [p for p in re.split(r"[-_:.\d]+", word) if p]
                hints = sum(p in _HINTS for p in parts)
                if word in _HINTS or hints and all(p in _HINTS or p in _PLAIN for p in parts):
                    level = 2
                elif hints:
                    level = max(level, 1)
    return level, hidden


def features(found: list[Block]) -> list[tuple[float, ...]]:
    density = [b.linked / b.words for b in found]
    total = sum(b.words for b in found) or 1
    share = sum(b.words - b.linked for b in found if b.article) / total
    last = len(found) - 1
    rows = []
    for i, b in enumerate(found):
        # of the boxes around it the one that says furniture most clearly, the smallest of these
        box = b.box.clearest if b.box else None
        before, after = (found[i - 1].words, density[i - 1]) if i else (0, 0.0), (found[i + 1].words, density[i + 1]) if i < last else (0, 0.0)
        # a block in no such box has the page around it
        inside = (box.words / total, box.linked / box.words, box.words / box.blocks) if box else (1.0, 0.0, total / len(found))
        rows.append((float(b.article), share, float(box.claim if box else 0), *inside, density[i], min(before[1], after[1]), max(before[1], after[1]), before[1], after[1], b.words, before[0], after[0], float(b.heading)))
    return rows


#: Written pages. A text begins with + if it is content and with - if not; {n} stands for n words.
WRITTEN = (
    # an article among menus, adverts and a footer; link lists right after its last paragraph
    '<nav><ul><li><a>-{1}</a><li><a>-{1}</a><li><a>-{2}</a></ul></nav><div class="ad">-{6}</div><article><h1>+{9}</h1><p>+{84}</p><p>+{61}<p>+{2}<p>+{40}</p></article><nav><a>-{1}</a> <a>{1}</a></nav><footer>-{14}</footer>',
    '<nav><a>-{3}</a></nav><div class="ad">-{12}</div><article><h1>+{5}</h1><p>+{3}</p></article><footer>-{11}</footer>',
    '<header><a>-{2}</a><p>-{6}</p></header><article><h1>+{12}</h1><p>+{30}</p><p><a>+{6}</a></p><p>+{55}</p><h2>+{3}</h2><p>+{25}</p></article><div class="ads">-{30}</div><footer>-{20} <a>{4}</a></footer>',
    '<nav><li><a>-{1}</a><li><a>-{1}</a></nav><article><h1>+{7}</h1><p>+{45}</p><blockquote>+{18}</blockquote><ul><li>+{4}<li>+{6}<li>+{5}</ul><p>+{22} <a>{3}</a></p></article><p>-{6}</p><footer>-{9}</footer>',
    '<div class="ad">-{4}</div><article><h1>+{6}</h1><p>+{1}</p><p>+{150}</p><div class="ad">-{8}</div><p>+{70}</p><table><tr><td>+{2}<td>+{1}</table></article><aside>-{25}</aside><footer>-{7}</footer>',
    # furniture inside and after the article: related links, shares, comments, forms
    '<article><header><h1>+{8}</h1></header><p>+{60}</p><p>+{48}</p><div class="share"><a>-{1}</a> <a>{1}</a></div><ul><li><a>-{5}</a><li><a>-{6}</a><li><a>-{4}</a><li><a>-{7}</a></ul></article><section class="comments"><h2>-{2}</h2><p>-{35}</p><p>-{22}</p></section>',
    '<article><h1>+{5}</h1><p>+{90}</p><aside><p>-{20}</p></aside><p>+{31}</p><form><label>-{2}</label><button>-{1}</button></form></article><div id="comments"><p>-{60}</p><p>-{48}</p></div>',
    '<div class="cookie-notice">-{22}</div><article><h1>+{10}</h1><p>+{52}</p><p>+{64}</p><div class="comment-list"><p>-{18}</p><p>-{9}</p></div></article><div class="newsletter">-{16}<form>-{2}</form></div>',
    '<article><h1>+{6}</h1><p>+{44}</p><p>+{58}</p><div class="notice-of-motion"><p>+{46}</p><p>+{38}</p></div><p>+{27}</p></article><footer><p>-{24}</p><p>-{15}</p></footer>',
    '<div class="notice">-{28}</div><main><h1>+{7}</h1><p>+{120}</p><p>+{14}</p></main><div class="sidebar"><h3>-{2}</h3><p>-{30}</p><a>-{3}</a></div>',
    # no article: wrappers whose names sound like furniture hold the prose
    '<ul><li><a>-{1}</a><li><a>-{2}</a></ul><div class="has-sidebar"><h1>+{6}</h1><p>+{72}</p><p>+{64}</p><p>+{9}</p></div><div class="sidebar"><p>-{20}</p><a>-{2}</a></div><footer>-{12}</footer>',
    '<div class="page-header-fixed"><h1>+{5}</h1><p>+{35}</p><p>+{41}</p></div><footer>-{8}</footer>',
    '<div class="widget-area"><p>+{56}</p><p>+{33}</p><p>+{4}</p></div>', '<div class="post-share"><p>+{18}</p><p>+{66}</p></div><footer>-{5}</footer>', '<div class="entry-alert"><p>+{25}</p></div>', '<div class="sidebar-layout"><p>+{12}</p></div>',
    '<div><h1>+{8}</h1><p>+{72}</p><p>+{15}</p><p>+{41} <a>{3}</a></p></div><ul><li><a>-{3}</a><li><a>-{4}</a><li><a>-{6}</a></ul><div class="ad">-{14}</div>',
    '<p>+{26}</p><p>+{5}</p><p>+{37}</p>', '<p>+{9}</p>', '<h1>+{6}</h1><p>+{80}</p>', '<p>+{64}</p><p>+{3}</p><p><a>+{5}</a></p><p>+{33}</p>',
    # articles shorter than what stands around them
    '<nav><a>-{1}</a></nav><div class="ad">-{10}</div><article><h1>+{3}</h1><p>+{3}</p></article><footer>-{19}</footer>', '<div class="ad">-{14}</div><article><h1>+{4}</h1><p>+{4}</p></article>', '<article><p>+{5}</p></article><footer>-{22}</footer>',
    '<aside>-{30}</aside><article><h1>+{5}</h1><p>+{9}</p></article><div class="sidebar">-{26}</div>', '<article><h1>+{2}</h1></article><footer>-{40}</footer>', '<article><p>+{3}</p></article><section class="comments"><p>-{12}</p><p>-{30}</p></section>',
    # long furniture inside an article, and lists of links there
    '<article><p>+{90}</p><div class="ad">-{45}</div><p>+{80}</p><aside><p>-{50}</p><p>-{44}</p></aside><p>+{70}</p><div class="notice-to-residents"><p>+{40}</p><p>+{52}</p></div></article>', '<article><p>+{60}</p><aside>-{70}</aside><p>+{40}</p><div class="promo">-{64}</div></article>',
    '<article><p>+{200}</p><p>+{150}</p><ul><li><a>-{5}</a><li><a>-{6}</a><li><a>-{4}</a></ul></article>', '<article><p>+{90}</p><ul><li><a>-{4}</a><li><a>-{3}</a><li><a>-{5}</a></ul><p>+{120}</p><p><a>+{7}</a></p><p>+{30}</p></article>',
    '<article><p>+{100}</p><p><a>+{2}</a></p><p>+{70}</p><p><a>+{12}</a></p><p>+{5}</p><p><a>+{6}</a></p><p>+{26}</p></article>', '<article><p>+{33}</p><p><a>-{9}</a></p><p><a>-{3}</a></p><p>+{64}</p><ul><li><a>-{2}</a><li><a>-{2}</a></ul><p>+{4}</p></article>',
    '<article><p>+{90}</p><aside>-{40}</aside><p>+{70}</p><div class="widget-hall"><p>+{70}</p><p>+{95}</p></div><footer>-{42}</footer></article><footer>-{38}</footer>', '<article><p>+{99}</p><p>+{70}</p><div class="share-prices"><p>+{66}</p><p>+{48}</p></div></article><aside><p>-{36}</p><p>-{44}</p></aside><div class="related">-{39}</div>',
    # comments longer than the article; prose beside it; links among prose; short texts among links
    '<article><h1>+{6}</h1><p>+{50}</p></article><section class="comments"><p>-{80}</p><p>-{66}</p><p>-{40}</p></section>', '<article><p>+{40}</p></article><div id="comments"><p>-{64}</p><p>-{90}</p></div>',
    '<article><h1>+{5}</h1><p>+{70}</p><p>+{12}</p></article><div>-{30}</div><p>-{18}</p>', '<p>-{25}</p><main><h1>+{4}</h1><p>+{66}</p></main><p>-{44}</p>', '<p>-{9}</p><article><p>+{80}</p><p>+{75}</p></article>',
    '<article><p>+{10}</p><p><a>+{3}</a></p><p>+{9}</p><p>+{6} <a>{5}</a></p><p>+{12}</p><p><a>+{8}</a> {1}</p><p>+{60}</p></article>', '<div><p>+{50}</p><p><a>+{4}</a></p><p>+{8}</p><p>+{9} <a>{9}</a></p><p>+{31}</p></div>',
    '<article><h2>+{3}</h2><p>+{14} <a>{8}</a></p><p>+{20}</p><div class="notice-of-motion"><p>+{9}</p><p>+{60}</p><p>+{50}</p></div></article><aside>-{50}</aside><footer><p>-{60}</p></footer>',
    '<article><p>+{120}</p><p>+{90}</p><div class="related-posts"><p>-{7}</p><p>-{9}</p><p>-{6}</p></div><div class="cookie-consent"><p>-{24}</p></div><p>+{33}</p></article><div class="sponsored">-{45}</div>',
    '<a>-{1}</a><div>-{3}</div><a>-{2}</a><div>-{2}</div><a>-{1}</a><div><h1>+{7}</h1><p>+{80}</p><p>+{6}</p><p>+{52}</p></div>', '<a>-{2}</a><p>-{4}</p><a>-{1}</a><p>-{5}</p><a>-{1}</a><div><p>+{61}</p><p>+{44}</p></div><a>-{3}</a><p>-{3}</p><a>-{2}</a>',
    '<div id="menu"><a>-{1}</a> <a>{1}</a></div><div><h1>+{3}</h1><p>+{13}</p><p>+{2}</p></div><div class="sidebar">-{2}</div>', '<div><h1>+{4}</h1><p>+{11}</p><p>+{3}</p><p>+{17}</p></div>', '<p>+{3}</p><p>+{8}</p><p>+{4}</p>',
    '<form><h1>+{6}</h1><p>+{80}</p><p>+{60}</p><p>+{7}</p></form>', '<div class="widget"><p>+{70}</p><p>+{45}</p></div><footer>-{9}</footer>', '<form><p>+{33}</p><p>+{52}</p><ul><li><a>-{2}</a><li><a>-{3}</a></ul></form>',
    # lists of links and nothing else; teasers in article tags beside prose that stands outside them
    '<a>-{1}</a><p><a>-{3}</a></p><p><a>-{7}</a></p><p><a>-{4}</a> {1}</p>', '<nav><a>-{2}</a></nav><ul><li><a>-{24}</a><li><a>-{10}</a></ul>',
    '<div><h1>+{7}</h1><p>+{95}</p><p>+{110}</p><p>+{60}</p></div><article><a>-{6}</a></article><article><a>-{7}</a> {2}</article><footer>-{10}</footer>',
    '<div><p>+{88}</p><p>+{130}</p></div><article><h3><a>-{5}</a></h3></article><article><h3><a>-{8}</a></h3></article><article><h3><a>-{4}</a></h3></article>',
)
# boxes of many sizes, N and about N words a block: furniture, and prose whose box has a part of such a name
WRITTEN += tuple(
    page.replace("{N}", f"{{{n}}}").replace("{M}", f"{{{n + n // 3}}}")
    for n in (36, 43, 52, 66, 90)
    for page in (
        '<article><p>+{150}</p><aside>-{N}</aside><p>+{M}</p></article><footer>-{N}</footer>',
        '<article><p>+{70}</p><div class="ad">-{M}</div><p>+{110}</p><div class="related">-{N}</div></article><div class="newsletter">-{N}</div>',
        '<article><h1>+{6}</h1><p>+{N}</p><div class="notice-of-change"><p>+{M}</p><p>+{N}</p></div></article>',
        '<article><p>+{120}</p><p>+{190}</p><div class="social-history"><p>+{N}</p></div><p>+{60}</p></article><aside><p>-{M}</p></aside>',
    )
)


def _labelled() -> list[tuple[float, ...]]:
    """The feature rows of all written blocks, each with its label."""
    rows = []
    for page in WRITTEN:
        found = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))
        rows += [(*row, int(b.text[0] == "+")) for b, row in zip(found, features(found), strict=True)]
    return rows


def grow(rows: list[tuple[float, ...]], depth: int = 9):
    """A tree of (feature, threshold, low, high) by Gini impurity; leaves are 0 or 1, ties 1."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            t = (low + high) / 2
            left = [r[-1] for r in rows if r[f] <= t]
            right = [r[-1] for r in rows if r[f] > t]
            cost = sum(sum(s) * (len(s) - sum(s)) / len(s) for s in (left, right))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, t = best
    return f, t, grow([r for r in rows if r[f] <= t], depth - 1), grow([r for r in rows if r[f] > t], depth - 1)


@lru_cache(maxsize=1)
def decision_tree():
    return grow(_labelled())


def is_content(row: tuple[float, ...], tree=None) -> bool:
    tree = decision_tree() if tree is None else tree
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return bool(tree)


def main_text(page: str | None) -> str:
    """Content blocks of a page joined by newlines; empty for null, empty or contentless pages. Never raises."""
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if is_content(row))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row, ``n_chars`` in code points.

    Null html is empty and gives an empty text. Repeated rows are all answered; other columns are not read. A very long
    page is a slice of its own and is read in one pass; what it takes is in proportion to its length.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
