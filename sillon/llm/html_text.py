"""Main text of web pages: flat text blocks classified by a decision tree.

The markup is read once into a flat sequence of text blocks; block-level tags part them, inline tags don't. A block is
described by its words and link density, those of its neighbours before and after, and where it stands: in an article
element, in page furniture (by tag, role, class or id), in an element whose name may mean either, or elsewhere. Names
only propose furniture: an element that holds an article, or nearly all of the page's text, is none whatever its name. A
small decision tree, trained at start on the labelled table below, keeps or drops each block. Kept blocks are joined in
page order. Reading takes time in proportion to the page, whatever tags it leaves open.

Cases: null, empty or text-free html gives an empty text; unclosed tags, quotes, comments and scripts end where the
page ends; character references are decoded once, after tags are taken out; white space of any kind inside a block
becomes one space; equal pages give equal texts; an empty table gives an empty result; clashing extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

#: Elements by what they do to the text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg iframe textarea select button object canvas audio video head title math".split())
FURNITURE_TAGS = frozenset("nav header footer aside menu dialog fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status note".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Words in class and id names that mark furniture, by their beginnings or whole; those that mark readers' comments, and
#: lists of them; words that may also name a part of an article, for which the tree decides; words that name articles.
FURNITURE_STEMS = ("advert", "sponsor", "promo", "cookie", "breadcrumb", "recommend", "newsletter", "subscri", "disclaim", "consent", "sidebar", "navigation", "navbar", "pagination", "masthead", "notice", "notif")
FURNITURE_WORDS = frozenset("ad ads adv banner menu nav footer aside share sharing popup modal overlay alert gdpr widget widgets toolbar pager login signup respond skip topbar bottombar".split())
COMMENT_STEMS = ("comment", "disqus")
COMMENT_WORDS = frozenset(("replies",))
COMMENT_LISTS = frozenset("reply responses discussion discuss".split())
SUSPECT_WORDS = frozenset("discussion discuss header side social related search reply responses form forms".split())
ARTICLE_WORDS = frozenset("article content main post entry story body text".split())
#: Names that begin with one of the first, or end with one of the second, tell of a state or a layout and mark nothing
#: (has-sidebar, share-enabled); names that hide their element.
MODIFIERS = frozenset("has have no non not is with without js can use overflow show hide".split())
STATES = frozenset("enabled disabled visible open opened closed active inactive ready loaded on off true false allowed supported present free".split())
HIDDEN_NAMES = frozenset(("hidden", "is-hidden", "visually-hidden"))
#: A marked element that has more than this many times the words of all the page outside of it is the page, not furniture.
WHOLE_PAGE = 9
#: Elements that an opening tag of the same kind closes.
SELF_CLOSING = frozenset("p li dt dd td th tr option".split())

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HEADING = re.compile("h[1-6]").fullmatch
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Where a block stands. ``NAMED`` (in an element that bears an article's name) becomes one of the others once a page is read.
ARTICLE, PLAIN, OUTSIDE, FURNITURE, SUSPECT, NAMED = "article", "plain", "outside", "furniture", "suspect", "named"


@lru_cache(maxsize=len(SKIPPED))
def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: str
    heading: bool
    item: bool
    marks: tuple[int, ...] = ()

    @property
    def link_density(self) -> float:
        return self.linked / self.words if self.words else 0.0


_NONE = Block("", 0, 0, PLAIN, False, False)


@dataclass
class Mark:
    """An element that its names, or being a form, mark as furniture; what it holds may show that it is none."""

    kind: str
    words: int = 0
    holds_article: bool = False


def _mark(names: list[list[str]], tag: str) -> str:
    """What the names of an element (each a list of words) mark it as: comment, name, or nothing."""
    kind = ""
    for words in names:
        if len(words) > 1 and (words[0] in MODIFIERS or words[-1] in STATES):
            continue
        if any(w.startswith(COMMENT_STEMS) or w in COMMENT_WORDS for w in words) or tag in ("ol", "ul") and not COMMENT_LISTS.isdisjoint(words):
            return "comment"
        if any(w.startswith(FURNITURE_STEMS) or w in FURNITURE_WORDS for w in words):
            kind = "name"
    return kind


def _place(tag: str, rest: str, outer: str) -> tuple[str, str]:
    """Where the text of an element stands, from its tag, its attributes and where the element stands; and how it is marked."""
    if outer == FURNITURE:
        return FURNITURE, ""
    marks: dict[str, str] = {}
    if rest:
        for name, *values in _ATTRIBUTE.findall(rest):
            marks[name.lower()] = "".join(values)
    tokens = [t for k in ("class", "id") if k in marks for t in html.unescape(marks[k]).split()]
    names = [words for t in tokens if (words := [x.lower() for x in _NAME.findall(t)])]
    role = marks.get("role", "").strip().lower()
    if "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", marks.get("style", ""), re.I):
        return FURNITURE, ""
    if any(t.lower() in HIDDEN_NAMES for t in tokens):
        return FURNITURE, ""
    mark = _mark(names, tag)
    if role == "main" or tag in ARTICLE_TAGS:
        return ARTICLE, mark
    if tag == "header" and outer == ARTICLE:
        return ARTICLE, ""
    if tag in FURNITURE_TAGS or role in FURNITURE_ROLES:
        return FURNITURE, ""
    if tag in ("body", "html") or _HEADING(tag):  # a heading's id names its section, a body's class the page
        return outer, ""
    if tag == "form" or role == "form":
        mark = mark or "form"
    found = {w for words in names for w in words}
    if not mark and found & SUSPECT_WORDS and not found & ARTICLE_WORDS:
        return SUSPECT, ""
    if outer == PLAIN and tag not in ("p", "li", "td", "th", "tr") and found & ARTICLE_WORDS:
        return NAMED, mark
    return outer, mark


def _settled(blocks: list[Block], marks: list[Mark]) -> list[Block]:
    """The blocks of a page, doubtful places decided.

    A marked element is furniture unless it holds an article or, comments apart, is the page; an element with an article's
    name is the article if it holds most of the text.
    """
    total = 0
    for b in blocks:
        if b.place != FURNITURE:
            total += b.words
            for i in b.marks:
                marks[i].words += b.words
    furniture = [not m.holds_article and (m.kind == "comment" or m.words <= WHOLE_PAGE * (total - m.words)) for m in marks]
    words = dict.fromkeys((ARTICLE, PLAIN, OUTSIDE, FURNITURE, SUSPECT, NAMED), 0)
    for b in blocks:
        if any(furniture[i] for i in b.marks):
            b.place = FURNITURE
        words[b.place] += b.words
    by_name = words[NAMED] > max(words[ARTICLE], words[PLAIN])
    plain = OUTSIDE if words[ARTICLE] or by_name else PLAIN
    places = {PLAIN: plain, NAMED: ARTICLE if by_name else plain}
    for b in blocks:
        b.place = places.get(b.place, b.place)
    return blocks


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page."""
    out: list[Block] = []
    stack: list[tuple[str, str, tuple[int, ...]]] = []  # open block-level elements, where their text stands, marked elements around it
    marks: list[Mark] = []
    parts: list[str] = []
    linked: list[str] = []
    anchors = 0
    skip_to = ""
    opened: Counter[str] = Counter()  # how often each tag is in the stack
    unclosed: set[str] = set()  # skipped elements that no end tag follows

    def end_block() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                tags = [t for t, *_ in stack[-3:]]
                _, place, around = stack[-1] if stack else ("", PLAIN, ())
                out.append(Block(" ".join(words), len(words), min(len(words), len("".join(linked).split())), place, any(map(_HEADING, tags)), "li" in tags, around))
            parts.clear()
            linked.clear()

    def text(raw: str) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        parts.append(raw)
        if anchors:
            linked.append(raw)

    at = 0
    for m in _MARKUP.finditer(page):
        begin, stop = m.span()
        tag = m["tag"]
        if skip_to:
            if tag and m["end"] and tag.lower() == skip_to:
                skip_to, at = "", stop
            continue
        if begin < at:  # markup inside what a skipped element held
            continue
        if begin > at:
            text(page[at:begin])
        at = stop
        if not tag:
            continue
        tag = tag.lower()
        ends = bool(m["end"])
        if tag in SKIPPED:
            if not ends and not m["rest"].rstrip().endswith("/"):
                close = None if tag in unclosed else _close(tag).search(page, stop)
                if close is None:
                    unclosed.add(tag)
                if tag in ("script", "style", "textarea", "title", "iframe"):  # text, whatever it looks like
                    if close is None:
                        at = len(page)
                        break
                    at = page.find(">", close.end()) + 1 or len(page)
                elif close is None:
                    if tag != "head":
                        continue
                else:
                    skip_to = tag
                if tag not in ("svg", "math", "button", "select", "canvas"):
                    end_block()
                else:
                    parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                anchors = max(0, anchors - 1) if ends else 1
            elif tag == "br":
                text("\n")
        else:
            end_block()
            anchors = 0
            if ends:
                while opened[tag]:  # an end tag that nothing has opened closes nothing
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == tag:
                        break
            elif tag not in VOID:
                if stack and (tag in SELF_CLOSING and stack[-1][0] == tag or stack[-1][0] == "p"):
                    opened[stack.pop()[0]] -= 1
                _, outer, around = stack[-1] if stack else ("", PLAIN, ())
                place, mark = _place(tag, m["rest"], outer)
                if mark:
                    around = (*around, len(marks))
                    marks.append(Mark(mark))
                elif place == ARTICLE and outer != ARTICLE:
                    for i in around:
                        marks[i].holds_article = True
                stack.append((tag, place, around))
                opened[tag] += 1
    if at < len(page) and not skip_to:
        text(page[at:])
    end_block()
    return _settled(out, marks)


#: The labelled table: blocks of pages, in page order, so that neighbours are the blocks beside. A block is its place (A in
#: an article, P plain, O outside of a page's article, F furniture, S in an element whose name may mean furniture), its
#: words, h for a heading or i for a list item, l and its link density in tenths, and + to keep or - to drop it.
TABLE = """
F1il10- F2il10- F1il10- F12- A9h+ A60+ A45+ A80+ F8-
F2l10- A60+ A7+ A90+ F5- F60-
F1il10- A70+ A30l10+ A55+ A1+ F3l10-
F4h- F70- F30- A5h+ A3+ A4+ A2+ F40-
A3+ A4l10+ A3+
A12+ A10l10+ A9l10+ A60+
A6h+ A40l2+ A20l5+ A15l8+ A35+ A2l10+
A8h+ A4l10+ A50+ A6il4+ A5i+ A12i+ A3il10+ A25+
A90+ A4h+ A3il10- A2il10- A4il10- A2il10- F9-
A50+ A1l10+ A2l10- A1l10- A3l10- A2l10+
A20i+ A12il3+ A15il10+ A9i+ A3h+ A60l1+
O4- O30- A60+ A20+ O60- O9h- O45-
O8h- O70- F3il10- A4h+ A45+ O2il10- O3il10- O5-
O40l2- O6i- A12+ O1- A7l10+ O80- O50i-
F60- F55- F2h- F90- O60- O70l1-
F8l3- A80+ F12i- F9i- F3h- F2il10- F80l2- F1l10-
F20- P60+ F5- P45+ F60- F3h- F70-
P1h+ P7+ P2h+ P30+
P3h+ P60+ P45+ P8+ P70+
P2il10- P3il10- P1il10- P6h+ P60+ P50l1+ P4+ P3il10- P2il10-
P3l10- P4l10- P9h+ P25+ P30+ P3- P2l10- P3l10-
P12+ P11+ P10l2+ P9+
P18+
P40+ P15l10+ P35+ P9l10+ P50+ P2h- P4l10- P3l10-
P6l10- P8l9- P4h- P9il9- P7l10- P60+
P30+ P6+ P5+ P4+ P28+
P5i+ P8i+ P12i+ P4h+ P16il2+ P9i+
P2- P3l10- P1- P2l10- P60+ P3il10- P2il10-
P50+ P4l10- P3l10-
P20l8- P9l10- P30l4+ P60l3+ P12l8-
S40+ S60+ S8l10- S3-
S4h+ S45+ S3h- S2il10- S5il10-
S6- S9- A60+ S10- S4l10- S50+
S12l7- S30l6- S28+ S20l1+ S3h+ S70+ S2-
S22l9- S40l8- A20+
"""
_PLACES = {"A": ARTICLE, "P": PLAIN, "O": OUTSIDE, "F": FURNITURE, "S": SUSPECT}
_CELL = re.compile(r"([APOFS])([0-9]+)(h?)(i?)(?:l([0-9]+))?([+-])")


def features(blocks: list[Block], at: int) -> list[float]:
    """A block's features: its place, one by one; heading; list item; words and link density of it, of the block before it and of the one after it (0 words: none)."""
    b = blocks[at]
    beside = [blocks[k] if 0 <= k < len(blocks) else _NONE for k in (at - 1, at + 1)]
    return [*(float(b.place == p) for p in _PLACES.values()), float(b.heading), float(b.item), *(float(v) for x in (b, *beside) for v in (x.words, x.link_density))]


def labelled(line: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page of the table, and whether to keep each."""
    cells = [_CELL.fullmatch(c).groups() for c in line.split()]
    return [Block("", int(w), round(int(w) * int(d or 0) / 10), _PLACES[p], bool(h), bool(i)) for p, w, h, i, d, _ in cells], [int(c[-1] == "+") for c in cells]


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.value = float(y.mean()) if len(y) else 0.0
        self.feature = -1
        if not 0 < self.value < 1:
            return
        best = (np.inf, 0, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] < cut
                p, q = y[left].mean(), y[~left].mean()
                impurity = left.sum() * p * (1 - p) + (~left).sum() * q * (1 - q)
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut))
        if best[0] == np.inf:
            return
        _, self.feature, self.cut = best
        left = x[:, self.feature] < self.cut
        self.low, self.high = Tree(x[left], y[left]), Tree(x[~left], y[~left])

    def predict(self, row: list[float]) -> float:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] < node.cut else node.high
        return node.value


@lru_cache(maxsize=1)
def tree() -> Tree:
    """The tree of the labelled table."""
    x, y = [], []
    for line in TABLE.strip().splitlines():
        blocks, keep = labelled(line)
        x += [features(blocks, i) for i in range(len(blocks))]
        y += keep
    return Tree(np.array(x), np.array(y, dtype=float))


def main_blocks(page: str) -> list[str]:
    """The texts of the blocks that the tree keeps."""
    found, grown = blocks_of(page), tree()
    return [b.text for i, b in enumerate(found) if grown.predict(features(found, i)) >= 0.5]


def main_text(page: str) -> str:
    return "\n".join(main_blocks(page))


def extract(pages: DataFrame, page: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Columns ``key``, ``url``, text and n_chars of each page."""
    types = dict(pages.dtypes)

    def run(batch):
        texts = [main_text(x) for x in texts_of(batch, page)]
        return {key: batch.column(key), url: batch.column(url), "text": texts, "n_chars": [len(x) for x in texts]}

    return map_batches(pages.select(key, url, page), run, f"{key} {types[key]}, {url} {types[url]}, text string, n_chars long")
