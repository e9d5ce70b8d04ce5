"""HTML extraction by minimum-cut labelling."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

# Element names, by what they do to the text around them.
HIDDEN = set("head title object canvas audio video select option datalist".split())
#: Their content is not markup.
RAW = set("script style textarea title iframe noscript template".split())
INLINE = set(
    "a abbr acronym audio b bdi bdo big br button canvas cite code data datalist del dfn em font i img input ins kbd label link mark math meta "
    "nobr object option q rp rt ruby s samp select small span strike strong sub sup svg time tt u var video wbr "
    "annotation mfrac mi mn mo mover mrow ms mspace msqrt mstyle msub msubsup msup mtext munder semantics "
    "circle defs desc ellipse g line path polygon polyline rect stop text tspan use".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words in these count as linked.
LINKS = {"a", "button"}
#: An element of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_EDGES = {"li", "dt", "dd", "tr", "td", "th", "ul", "ol", "dl", "table", "tbody", "thead", ""}

# What elements and names say for content (positive) or boilerplate, in natural logarithms of the odds.
TAG_SAYS = {"article": 5.0, "main": 3.0, "nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0, "header": -6.0}
ROLE_SAYS = {
    "navigation": -12.0, "banner": -8.0, "contentinfo": -12.0, "complementary": -12.0, "search": -12.0, "form": -12.0,
    "dialog": -12.0, "alertdialog": -12.0, "menu": -12.0, "menubar": -12.0, "main": 3.0, "article": 5.0,
}
NAME_SAYS = dict.fromkeys(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments "
    "commentlist disqus respond reply replies share sharing social related recommended subscribe subscription newsletter "
    "signup login popup modal overlay widget widgets toolbar skip masthead topbar".split(),
    -12.0,
) | dict.fromkeys("article content post entry story main maincontent".split(), 2.0)
NAME_SAYS["header"] = -6.0
#: Names that may as well speak of what a text says, and what they say on a single paragraph, and on any
#: other element as a part of a longer name (expert-comment, notice-board), but for plurals.
VAGUE, VAGUE_SAYS = set("comment comments reply replies respond notice notices alert header related menu widget skip".split()), -1.0
VAGUE_PART = dict.fromkeys("comment reply respond notice alert header related menu widget skip".split(), -4.0)
#: What speaks against a block less than this is weighed together with what speaks for it.
DECIDED = -6.0
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th".split())
#: What a block outside all articles says on a page that has one with text.
ELSEWHERE = -3.0
SMOOTH_NEXT, SMOOTH_SIBLING = 1.2, 0.8
#: Blocks further apart in the tree than this do not pull at each other.
FAR = 48

# What a block's own text and neighbours say: a logistic model.  These are the weights it has before any page speaks.
KINDS = {"p": 0, "blockquote": 0, "pre": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "h5": 1, "h6": 1, "li": 2, "dt": 2, "dd": 2, "td": 3, "th": 3}
TRAITS = ("bias", "paragraph", "heading", "list item", "cell", "other", "log2 of words", "share linked", "sentence", "prose about it", "small print")
PRIOR = (-1.0, 1.5, 1.0, -0.3, -0.2, -0.3, 0.4, -4.0, 1.0, 0.7, -3.0)
#: Pages weigh as much as so many blocks at most against these weights, each of which is right to about this.
EVIDENCE = 500.0
SURE = (0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.1, 0.5, 0.5, 0.25, 0.5)
TRAIN_PAGES = 2_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?P<close>>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+")
_RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_STOPS = ".!?…:。！？\"”»)"
_SMALL_PRINT = re.compile(r"©|\(c\)|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bterms of (?:use|service)\b", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)


class Node:
    """A block element; what it and the elements around it say is summed up on the way down."""

    __slots__ = ("against", "article", "depth", "edge", "hidden", "name", "pro", "parent")

    def __init__(self, name: str, parent: Node | None, says: float = 0.0, hidden: bool = False) -> None:
        self.name, self.parent = name, parent
        if parent is None:
            self.depth, self.against, self.pro, self.article, self.hidden, self.edge = 0, 0.0, 0.0, False, False, self
            return
        self.depth, self.article = parent.depth + 1, parent.article or name == "article"
        self.hidden = parent.hidden or hidden
        # A header inside an article belongs to it.
        against = says < 0 and not (name == "header" and parent.article)
        self.against = parent.against + (says if against else 0.0)
        self.pro = max(parent.pro, says)
        self.edge = self if name in _EDGES else parent.edge


@dataclass
class Block:
    text: str
    words: int
    linked: int
    node: Node


def _says(name: str, rest: str) -> float:
    said = TAG_SAYS.get(name, 0.0)
    for m in _NAMED.finditer(rest) if "=" in rest else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            said += ROLE_SAYS.get(value.strip(), 0.0)
        else:
            told = _named(value, name in PARAGRAPHS)
            worst, best = min(told, default=0.0), max(told, default=0.0)
            said += worst if worst <= DECIDED else min(worst, 0.0) + max(best, 0.0)
    return said


def _named(value: str, paragraph: bool) -> list[float]:
    """What the parts of a class or id say."""
    out = []
    for whole in value.split():
        parts = set(_PART.findall(whole))
        for part in parts & NAME_SAYS.keys():
            vague = VAGUE_SAYS if paragraph and part in VAGUE else VAGUE_PART.get(part) if len(parts) > 1 else None
            out.append(NAME_SAYS[part] if vague is None else max(vague, NAME_SAYS[part]))
    return out


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order, each with its place in the tree of block elements.

    Tolerant of unclosed and stray tags.  Inline elements and line breaks do not part blocks, nor
    do scripts and form controls inside a block.  Linear in the page: each element is closed once,
    and no step walks up to the root.
    """
    root = Node("", None)
    at, links, unseen, out = root, 0, 0, []
    open_now: Counter[str] = Counter()
    piece: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if piece:
            words = unescape("".join(piece)).split()
            if words and not at.hidden:
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), at))
            piece.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not unseen and not at.hidden:
            piece.append(text)
            if links:
                linked += len(text.split())

    def close(node: Node) -> None:
        """Leave node and all that is open in it."""
        nonlocal at
        while at is not node.parent:
            open_now[at.name] -= 1
            at = at.parent

    place = 0
    while m := _TOKEN.search(html, place):
        say(html[place : m.start()])
        place = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name in LINKS:
                links = 0
            elif name in INLINE:
                unseen = max(0, unseen - (name in HIDDEN))
            elif open_now[name] > 0:
                flush()
                node = at
                while node.name != name:
                    node = node.parent
                close(node)
            continue
        rest = m["rest"] or ""
        if name in RAW:
            # Raw text up to its own end tag, whatever the start tag ends with; noscript and template are
            # skipped the same way.  One that says it is empty, and has no end tag, is.
            end = _RAW_ENDS[name].search(html, place)
            place = end.end() if end else place if rest.endswith("/") else len(html)
            continue
        if name in INLINE:
            if name in LINKS:
                links = 1
            elif name == "br":
                say(" ")
            elif name in HIDDEN and name != "option" and not rest.endswith("/"):
                unseen += 1
            continue
        flush()
        unseen = 0
        if at.name == "p":
            close(at)
        old = ENDS.get(name)
        node = at.edge if old else root
        while node is not root and node.name not in ("ul", "ol", "dl", "table", "tbody", "thead"):
            if node.name in old:
                up = node.parent
                close(node)
                node = up.edge if name == "tr" else root
            else:
                node = node.parent.edge
        if name in VOID:
            continue
        open_now[name] += 1
        at = Node(name, at, _says(name, rest), name in HIDDEN or bool(rest and _UNSEEN.search(rest)))
        links = 0
    say(html[place:])
    flush()
    return out


def traits(blocks: list[Block]) -> np.ndarray:
    """What the classifier sees of each block, one column for each of TRAITS: nothing of the elements
    and names that _says() knows.  All values are small whole numbers or quarters, so blocks can be
    counted by them."""
    out = np.zeros((len(blocks), len(TRAITS)))
    out[:, 0] = 1
    for i, block in enumerate(blocks):
        out[i, 1 + KINDS.get(block.node.name, 4)] = 1
        out[i, 6] = min(block.words.bit_length() - 4, 5)
        out[i, 7] = round(4 * block.linked / block.words) / 4
        out[i, 8] = block.text[-1] in _STOPS
        out[i, 10] = bool(_SMALL_PRINT.search(block.text[:400] + block.text[-400:]))
    prose = (out[:, 7] < 0.5) & (out[:, 8] > 0) & (out[:, 6] >= -1)
    out[1:, 9] += prose[:-1]
    out[:-1, 9] += prose[1:]
    return out


def labels(blocks: list[Block]) -> np.ndarray:
    """What semantic elements and names say of each block: 1 content, 0 boilerplate, -1 nothing."""
    any_article = any(b.node.pro >= 3.0 and not b.node.against for b in blocks)
    return np.array([0 if b.node.against else 1 if b.node.pro >= 3.0 else 0 if any_article else -1 for b in blocks], int)


def fitted(rows: np.ndarray, label: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weights of the logistic model: the likeliest given the counted blocks and PRIOR (Newton's method)."""
    prior, stiff = np.array(PRIOR), 1.0 / np.square(SURE)
    weight = prior.copy()
    if not len(rows):
        return weight
    share = count * min(1.0, EVIDENCE / count.sum())
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-(rows @ weight)))
        slope = rows.T @ (share * (p - label)) + (weight - prior) * stiff
        curve = (rows.T * (share * p * (1 - p))) @ rows + np.diag(stiff)
        weight = weight - np.linalg.solve(curve, slope)
    return weight


def log_odds(blocks: list[Block], weight: np.ndarray) -> list[float]:
    """The classifier's word on each block, and that of the elements around it."""
    any_article = any(b.node.article and not b.node.against for b in blocks)
    around = []
    for b in blocks:
        against, pro = b.node.against, b.node.pro
        outside = ELSEWHERE if any_article and not pro else 0.0
        around.append(against if against <= DECIDED else against + pro + outside)
    return (traits(blocks) @ weight + np.array(around)).tolist()


def _distance(a: Node, b: Node) -> int:
    """Steps between two nodes through their nearest common ancestor; FAR if there are more."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut: the labelling with the least cost.

    A node labelled content costs log(1 + e**-odds), otherwise log(1 + e**odds), as capacities to
    sink and source; an edge between different labels costs its weight, either way.  Dinic's
    algorithm; a node's own source-to-sink flow is taken at once.
    """
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: float, back: float) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)

    for i, x in enumerate(odds):  # log(1+e**x) - log(1+e**-x) = x
        link(source, i, x, 0.0) if x > 0 else link(i, sink, -x, 0.0)
    for a, b, weight in edges:
        link(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, x = [], source
                continue
            while nxt[x] < len(out[x]):
                e = out[x][nxt[x]]
                if room[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                nxt[x] += 1
            if nxt[x] < len(out[x]):
                path.append(out[x][nxt[x]])
                x = to[path[-1]]
            elif path:
                e = path.pop()
                x = to[e ^ 1]
                nxt[x] += 1
            else:
                break


def main_text(html: str, weight: np.ndarray | None = None) -> str:
    """The main text of one page: blocks that the minimum cut labels as content, one a line."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    edges = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i and (apart := _distance(blocks[i - 1].node, block.node)) < FAR:
            edges.append((i - 1, i, SMOOTH_NEXT / (1 + apart)))
        group = id(block.node.parent)
        if group in last:
            edges.append((last[group], i, SMOOTH_SIBLING))
        last[group] = i
    kept = min_cut(log_odds(blocks, np.array(PRIOR) if weight is None else weight), edges)
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def learn(pages: DataFrame, id_col: str, html_col: str, train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """Fit the classifier on the blocks of about `train_pages` pages at most, those with the smallest hash
    of id and html: semantic elements and names label them, and are hidden from it.  Only counts of
    equal blocks come to the driver."""
    rows = pages.count()
    html = text_or_empty(html_col)
    drawn = pages.select(html.alias("html"), F.pmod(F.xxhash64(id_col, html, F.lit(5)), F.lit(1 << 30)).alias("h"))
    if rows > train_pages:
        drawn = drawn.where(F.col("h") < int(train_pages / rows * (1 << 30)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            seen: Counter = Counter()
            for page in batch.column(0).to_pylist():
                blocks = blocks_of(page)
                seen.update((int(y), *x) for x, y in zip(traits(blocks).tolist(), labels(blocks)) if y >= 0)
            flat = [[k[0] for k in seen], [list(k[1:]) for k in seen], list(seen.values())]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.list_(pa.float64())), pa.array(flat[2], pa.int64())], ["label", "traits", "n"])

    counted = drawn.select("html").mapInArrow(work, "label int, traits array<double>, n long").groupBy("label", "traits").agg(F.sum("n").alias("n"))
    got = counted.orderBy("label", "traits").collect()
    return fitted(np.array([r.traits for r in got]).reshape(-1, len(TRAITS)), np.array([r.label for r in got]), np.array([r.n for r in got], float))


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES
) -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points of the text).

    A block's label costs what a logistic model of its text and neighbours and the elements around
    it say against it; the model is fitted on `train_pages` of the pages, by their semantic
    elements, and without any of these its prior weights hold.  Null or empty html, and pages
    without content, give the empty text.  Character references are decoded; white space inside a
    block becomes one space; blocks are joined by a line feed.  Rows that repeat are treated one by
    one; other columns are ignored.
    """
    weight = learn(pages, id_col, html_col, train_pages)
    rows = pages.select(F.col(id_col), F.col(url_col), text_or_empty(html_col).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x, weight) for x in batch.column(2).to_pylist()]
            lengths = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), lengths], [id_col, url_col, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return rows.mapInArrow(work, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars long")
