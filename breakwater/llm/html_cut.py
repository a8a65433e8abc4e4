"""Operator 9: main text of web pages by a minimum cut.

A page is cut into blocks of text at its block elements. A linear classifier over a block's features (length, links, kind of element, what it
stands in) gives a log odds for content; the costs of labelling the block content or boilerplate are its negative log likelihoods and
become the capacities from the source and to the sink. Neighbours in page order, and blocks under one parent, are tied by smoothness
edges that are stronger the closer they are in the tree. The maximum flow (blocking flows over level graphs) separates content from
boilerplate, and the content blocks in page order are the text.

Every page is a task row of its own: no shuffle, and memory is bounded by the longest page. Scripts, styles, form controls and the head give no
blocks at all. Character references are decoded, white space in a block becomes one space.

Edge cases: null and empty pages, and pages without a content block, give the empty text; unclosed and stray tags are handled as they
come (a new block ends an open paragraph; an end tag without a start is skipped); an unclosed script or comment takes the rest of the
page; repeated rows each give a row; null ids stay null; an empty table gives no rows; only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
UNQUOTED = re.compile(r"""[^>"']*+""")
MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style noscript template textarea title iframe object svg select option button canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What a start tag closes: these elements, as far out as the nearest of those. Any block closes "p".
CLOSES = {
    "p": (("p",), ("table", "td", "th", "button")), "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
}
CLOSED_BY = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4}  # their numbers in CLOSES
NAMED = frozenset(x for own, stops in CLOSES.values() for x in (*own, *stops))
BAD_WORDS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice alert popup modal nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer foot masthead toolbar share sharing social related recommended comment comments disqus respond reply replies subscribe newsletter signup login search pagination pager complementary contentinfo banner".split())
GOOD_WORDS = frozenset("article content entry post story main body text".split())
WORD = re.compile(r"[a-z]+")
STATES = frozenset("has no not is with without free less open closed enabled disabled".split())  # such a name says what the page has, not what the element is
WHOLE = frozenset("html body article main".split())  # what they are called is no reason to drop what they hold

# What an ancestor adds to the log odds; the strongest of each sign counts.
INSIDE = {"nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "header": -4.0, "article": 5.0, "main": 4.0}
BAD, GOOD = -9.0, 2.0


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    leaf: int  # the innermost block element it stands in
    odds: float  # from its ancestors
    name: str


@dataclass(slots=True)
class Open:
    """An open element, with what its ancestors hand down: every step of the parser is then free of their number."""

    name: str
    low: float  # odds so far
    high: float
    suspect: int  # innermost element around called by a bad word
    over: int  # landmarks around
    leaf: int  # innermost block element
    closes: tuple[int, ...]  # by CLOSES: where in the stack the outermost element stands that such a tag would close, or 0
    article: bool


class Tags:
    """The tags of a page, one after the other. A tag ends at the first > outside quotation marks or, where these don't close, at the first of all. A mark from
    which no such end was found is remembered, so that the page is searched once, however many tags leave their quotations open."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.open = page, page.rfind(">"), set()

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at `at`, which has a > behind it."""
        page, pos, seen = self.page, at, []
        while (pos := UNQUOTED.match(page, pos).end()) < len(page):
            if page[pos] == ">":
                return pos
            if pos in self.open:
                break
            seen.append(pos)
            closing = page.find(page[pos], pos + 1)
            if closing < 0:
                break
            pos = closing + 1
        self.open.update(seen)
        return page.find(">", at)

    def following(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """From `at` on the next tag: where it begins and ends, whether it closes an element, its name (none of declarations and comments) and attributes. A tag
        that the page's end cuts off goes to there."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                return at, len(page) if end < 0 else end + 3, False, "", ""
            m = NAME.match(page, at)
            if m or page.startswith(("<!", "<?", "</"), at):
                start = m.end() if m else at + 2
                if start > self.last:
                    return at, len(page), False, "", ""
                end = self.end(start) if m else page.find(">", start)
                return at, end + 1, bool(m and m[1]), m[2].lower() if m else "", page[start:end] if m else ""
            at += 1
        return None


def _standing(name: str, attributes: str) -> tuple[float, bool]:
    """The log odds that an element gives to what it holds, and whether it is called by a bad word."""
    odds = INSIDE.get(name, 0.0)
    if attributes:
        tokens = [set(WORD.findall(t)) for m in MARKS.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split()]
        if name not in WHOLE and any(t & BAD_WORDS and not t & STATES for t in tokens):
            return odds, True
        if any(t & GOOD_WORDS for t in tokens):
            odds = max(odds, GOOD)
    return odds, False


def blocks(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """The page's blocks of text, in order, and of each block element its parent and depth. An element called by a bad word spoils what it
    holds, unless that is most of the page's text and no article, main or element called by a good word stands elsewhere."""
    out: list[Block] = []
    tree: list[tuple[int, int]] = [(0, 0)]
    kinds = [""]
    stack = [Open("", 0.0, 0.0, 0, 0, 0, (0,) * len(CLOSES), False)]
    open_names: Counter[str] = Counter()
    around: list[int] = [0]  # of each suspect the suspect around it
    over: list[int] = [0]  # of each suspect the landmarks around it
    inside: list[int] = [0]  # of each suspect the landmarks in it, but not in a suspect within
    suspects: list[int] = []  # of each block
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            e = stack[-1]
            name = kinds[e.leaf]
            low = 0.0 if e.low == INSIDE["header"] and e.article and name[0:1] == "h" and name[1:].isdigit() else e.low  # the article's title
            suspects.append(e.suspect)
            out.append(Block(text, min(linked, len(text)), e.leaf, low if low < 0 else e.high, name))
        linked = 0

    def pop(size: int) -> None:
        nonlocal links
        for e in stack[size:]:
            links -= e.name == "a"
            open_names[e.name] -= 1
        del stack[size:]

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    size, tags = len(page), Tags(page)
    while at < size:
        tag = tags.following(at)
        if tag is None:
            say(page[at:])
            break
        start, end, closing, name, attributes = tag
        if start > at:
            say(page[at:start])
        at = end
        if not name:
            continue
        if closing:
            if name in BLOCKS:
                flush()
            if open_names[name]:
                pop(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if name in SILENT:
            if not attributes.endswith("/") or name != "svg":
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = size if close < 0 else close + 1
            if name not in ("script", "style"):
                parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            for closer in (0, CLOSED_BY.get(name)):
                if closer is not None and stack[-1].closes[closer]:
                    pop(stack[-1].closes[closer])
        elif name == "br":
            parts.append("\n")
        if name not in VOID:
            e = stack[-1]
            odds, bad = _standing(name, attributes)
            suspect, landmarks_over, leaf, closes = e.suspect, e.over, e.leaf, e.closes
            if bad:
                around.append(suspect)
                over.append(landmarks_over)
                inside.append(0)
                suspect = len(around) - 1
            elif odds > 0:
                landmarks_over += 1
                inside[suspect] += 1
            if name in BLOCKS:
                tree.append((leaf, tree[leaf][1] + 1))
                kinds.append(name)
                leaf = len(tree) - 1
            if name in NAMED:
                closes = tuple(0 if name in stops else held or (len(stack) if name in own else 0) for held, (own, stops) in zip(closes, CLOSES.values(), strict=True))
            stack.append(Open(name, min(e.low, odds), max(e.high, odds), suspect, landmarks_over, leaf, closes, e.article or name == "article"))
            open_names[name] += 1
            links += name == "a"
    flush()
    held = [0] * len(around)
    for b, k in zip(out, suspects, strict=True):
        held[k] += len(b.text)
    for k in range(len(around) - 1, 0, -1):  # a suspect comes after those around it
        held[around[k]] += held[k]
        inside[around[k]] += inside[k]
    spoils = [False] * len(around)
    for k in range(1, len(around)):
        spoils[k] = spoils[around[k]] or held[k] <= held[0] / 2 or over[k] + inside[k] < inside[0]
    for b, k in zip(out, suspects, strict=True):
        if spoils[k]:
            b.odds = min(b.odds, BAD)
    return out, tree


def log_odds(b: Block) -> float:
    """The classifier's log odds for content."""
    n = len(b.text)
    odds = 0.9 * math.log1p(n) - 3.2 - 5.0 * b.linked / n + b.odds
    if b.name[0:1] == "h" and b.name[1:].isdigit():
        odds += 1.5
    elif b.name == "li":
        odds -= 0.7
    elif b.name in ("p", "blockquote", "pre"):
        odds += 0.7
    if b.text[-1] in ".!?:;\"')":
        odds += 0.5
    return odds


def _links(found: list[Block], tree: list[tuple[int, int]], adjacent: float, sibling: float) -> list[tuple[int, int, float]]:
    """Neighbours in page order, weaker the more elements lie between them, and the next block under one parent."""
    out, last = [], {}
    for k, b in enumerate(found):
        if k:
            x, y, apart = found[k - 1].leaf, b.leaf, 0
            while x != y:  # as many steps as elements open or close between the two
                if tree[x][1] >= tree[y][1]:
                    x = tree[x][0]
                else:
                    y = tree[y][0]
                apart += 1
            out.append((k - 1, k, adjacent / (1 + apart)))
        parent = tree[b.leaf][0]
        if parent in last and last[parent] < k - 1:
            out.append((last[parent], k, sibling))
        last[parent] = k
    return out


UNITS = 1 << 20  # capacities are whole numbers of this part


def minimum_cut(costs: list[tuple[float, float]], links: list[tuple[int, int, float]]) -> list[bool]:
    """costs: of labelling each node False and True. links: two nodes, cost of labelling them differently. The labels with the least sum."""
    excess = [round((a - b) * UNITS) for a, b in costs]  # what both terminals share passes straight through
    arcs: list[list[int]] = [[] for _ in costs]
    to: list[int] = []
    room: list[int] = []
    for i, j, c in links:
        arcs[i].append(len(to))
        arcs[j].append(len(to) + 1)
        to += [j, i]
        room += [round(c * UNITS)] * 2
    while True:
        level = [0 if e > 0 else -1 for e in excess]
        wave, goal = [i for i, e in enumerate(excess) if e > 0], False
        starts = wave
        while wave and not goal:
            following = []
            for i in wave:
                for a in arcs[i]:
                    j = to[a]
                    if room[a] and level[j] < 0:
                        level[j] = level[i] + 1
                        following.append(j)
                        goal = goal or excess[j] < 0
            wave = following
        if not goal:
            return [x >= 0 for x in level]
        tried = [0] * len(costs)
        for s in starts:
            path: list[int] = []
            i = s
            while excess[s] > 0:
                if excess[i] < 0:
                    flow = min(excess[s], -excess[i], *(room[a] for a in path))
                    for a in path:
                        room[a] -= flow
                        room[a ^ 1] += flow
                    excess[s] -= flow
                    excess[i] += flow
                    path, i = [], s
                    continue
                while tried[i] < len(arcs[i]):
                    a = arcs[i][tried[i]]
                    if room[a] and level[to[a]] == level[i] + 1:
                        break
                    tried[i] += 1
                else:
                    if not path:
                        break
                    i = to[path.pop() ^ 1]
                    tried[i] += 1
                    continue
                path.append(a)
                i = to[a]


def main_text(page: str | None, adjacent: float = 1.0, sibling: float = 0.5) -> str:
    """The main text of one page."""
    found, tree = blocks(page) if page else ([], [])
    if not found:
        return ""
    odds = [log_odds(b) for b in found]
    # -log(1 - p) is the cost of calling it boilerplate, -log(p) that of calling it content
    costs = [(math.log1p(math.exp(min(x, 30))), math.log1p(math.exp(min(-x, 30)))) for x in odds]
    labels = minimum_cut(costs, _links(found, tree, adjacent, sibling))
    return "\n".join(b.text for b, keep in zip(found, labels, strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(of, "page_id long, url string, text string, n_chars long")
