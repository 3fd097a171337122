"""Main text of web pages by a minimum cut between content and boilerplate.

A page becomes a row of text blocks.  A logistic classifier of the blocks' shape gives what it
costs to call a block content or boilerplate: the capacities from the source and to the sink.
Neighbouring blocks, and neighbours below one parent element, are joined by edges, the weaker
the further apart they are in the document tree.  The maximum flow then finds the cheapest
labelling.  Elements that say what they are (article, nav, class="cookie-banner" ...) are fixed:
they cost more than all edges of a block together.  The same elements label the blocks that the
classifier learns from, on a bounded sample of pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import annotate, trim

#: Pages and blocks of a page that the classifier is fitted on, at most.
SAMPLE_PAGES, SAMPLE_BLOCKS = 2_000, 64
#: Capacities of the edges between neighbours, and between neighbours below one parent.
ADJACENT, NEAR = 1.0, 0.75
FIXED = 1e9
#: What a block loses that lies beside the page's article.
BESIDE = 4.0

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript "
    "object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
NOT_CONTENT = set("aside button dialog footer menu nav noscript object search select svg template".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words in class and id.
BOILERPLATE = set(
    "ad ads adsense advert advertisement advertising advertorial adverts alert banner breadcrumb breadcrumbs consent "
    "cookie cookies copyright disclaimer footer gdpr hidden legal login masthead menu modal nav navbar navigation "
    "newsletter notice overlay pager pagination popup promo promoted promotion recommended related search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
COMMENTS = set("comment comments commentlist discussion disqus replies respond".split())
CONTENT = set("article articlebody body content entry main page post story text".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|(?![\"'\s])))*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+|[A-Z]+[a-z0-9]*")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_STOPS = re.compile(r"[.!?,;:]")
_ENDED = (".", "!", "?", "…", "”", '"', ":")


@dataclass
class Block:
    tag: str
    parent: int  # element above the one that holds the text
    mark: int  # 1 content, -1 boilerplate, 0 unknown
    named: bool  # an element above is named like content
    steps: int  # way through the tree from the block before
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class _Element:
    name: str
    number: int
    mark: int
    lasting: bool  # no element within can be content again
    named: bool
    article: bool


def _marked(name: str, rest: str, above: _Element) -> tuple[int, bool, bool]:
    """Mark of an element, whether it lasts, and whether it is named like content."""
    if above.lasting:
        return -1, True, False
    found: dict[str, str] = {}
    for attribute, *values in _ATTRIBUTE.findall(rest):
        found.setdefault(attribute.lower(), "".join(values))
    labels = [[w.lower() for w in _WORD.findall(label)] for label in f"{found.get('class', '')} {found.get('id', '')}".split()]
    role = found.get("role", "").lower()
    if any(COMMENTS.intersection(words) for words in labels) or "hidden" in found:
        return -1, True, False
    if found.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(found.get("style", "")) or name in NOT_CONTENT:
        return -1, True, False
    if name in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        # An article within an article is a comment on it or a teaser of another.
        return (-1, True, False) if name == "article" and above.article else (1, False, True)
    if name in ("html", "body"):
        return above.mark, False, above.named
    if role in ROLES or name == "form" or any(_is(words, BOILERPLATE) for words in labels):
        return -1, False, False
    own = any(words and words[-1] in CONTENT for words in labels)
    if above.mark <= 0 and (name == "header" or any(_is(words, {"header"}) and words[0] not in CONTENT - {"page", "main"} for words in labels)):
        return -1, False, False
    return above.mark, False, above.named or own


def _is(words: list[str], kinds: set[str]) -> bool:
    """Does a name such as cookie-banner or page-footer begin or end with one of ``kinds``?"""
    if not words:
        return False
    return words[0] in kinds or (words[-1] in kinds and not {"has", "with", "no"}.intersection(words))


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, whatever is wrong with its markup."""
    stack = [_Element("", 0, 0, False, False, False)]
    opened: Counter[str] = Counter()
    out: list[Block] = []
    current: Block | None = None
    low, links, number, at, last_depth = 0, 0, 0, 0, 0

    def text(piece: str) -> None:
        nonlocal current, low, last_depth
        if not piece:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        if current is None:
            if piece.isspace():
                return
            top = stack[-1]
            depth = len(stack)
            current = Block(top.name, stack[-2].number if depth > 1 else -1, top.mark, top.named, depth + last_depth - 2 * min(low, depth))
            out.append(current)
            low = last_depth = depth
        current.pieces.append(piece)
        if links:
            current.linked += len(piece)

    def close(name: str) -> None:
        nonlocal low
        while True:
            gone = stack.pop().name
            opened[gone] -= 1
            if gone == name:
                break
        low = min(low, len(stack))

    while at < len(page):
        tag = _TAG.search(page, at)
        if tag is None:
            text(page[at:])
            break
        text(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            continue
        if tag["end"] or tag["end2"]:
            if name == "a":
                links = 0
            if opened[name]:
                close(name)
                current = None
            elif name in BLOCKS:
                current = None
            continue
        rest = tag["rest"] or tag["rest2"] or ""
        if name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = stop.start() if stop else len(page)
            continue
        if name in VOID:
            if name == "br" and current is not None:
                current.pieces.append(" ")
            if name == "hr":
                current = None
            continue
        if name == "a":
            links = 1
        block = name in BLOCKS
        if block:
            current = None
            while stack[-1].name == "p" or stack[-1].name in CLOSES.get(name, ()):
                close(stack[-1].name)
        elif not rest and not opened[name]:
            continue
        mark, lasting, named = _marked(name, rest, stack[-1])
        if rest.endswith("/") and not block:
            continue
        if block or opened[name] or mark < 0 <= stack[-1].mark:
            current = None
            number += 1
            stack.append(_Element(name, number, mark, lasting, named, stack[-1].article or name == "article"))
            opened[name] += 1
    for block in out:
        block.text = " ".join("".join(block.pieces).split())
    return [b for b in out if b.text]


# -- classifier -----------------------------------------------------------------------------

FEATURES = ("bias", "words", "links", "stops", "heading", "item", "paragraph", "named", "ended", "copyright")
#: What the weights are drawn to, which decides alone where no page can be learned from.
PRIOR = np.array([-1.5, 0.8, -4.0, 1.0, 1.0, -0.5, 1.5, 2.0, 0.5, -4.0])
DRAW = 2.0


def features(blocks: list[Block]) -> np.ndarray:
    rows = np.zeros((len(blocks), len(FEATURES)))
    for row, b in zip(rows, blocks):
        words = b.text.count(" ") + 1
        raw = sum(map(len, b.pieces))
        row[:] = (
            1.0, np.log1p(words), min(1.0, b.linked / max(raw, 1)), min(1.0, len(_STOPS.findall(b.text)) / words),
            len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit(), b.tag in ("li", "td", "th", "dd", "dt", "option"),
            b.tag in ("p", "blockquote", "pre"), b.named and b.mark == 0, b.text.endswith(_ENDED),
            "©" in b.text or "copyright" in b.text.lower(),
        )
    return rows


def learn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression around PRIOR by Newton steps; both classes weigh alike."""
    weights = PRIOR.copy()
    if not len(y):
        return weights
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * min(len(y), 1_000)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(share @ (np.logaddexp(0, z) - y * z) + DRAW / 2 * (w - PRIOR) @ (w - PRIOR))

    now = loss(weights)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - y)) + DRAW * (weights - PRIOR)
        curve = (x.T * (share * p * (1 - p))) @ x + DRAW * np.eye(len(PRIOR))
        step = np.linalg.solve(curve, slope)
        while loss(weights - step) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        weights = weights - step
        now = loss(weights)
        if np.abs(step).max() < 1e-9:
            break
    return weights


def fit(pages: DataFrame, column: str = "html") -> np.ndarray:
    """Weights learned from the marked blocks of SAMPLE_PAGES distinct pages, the first by a hash."""
    keyed = pages.select(F.xxhash64(F.col(f"`{column}`")).alias("key"), F.col(f"`{column}`").alias("html")).where("html is not null")
    keys = [r.key for r in keyed.select("key").distinct().orderBy("key").limit(SAMPLE_PAGES).collect()]
    if not keys:
        return PRIOR.copy()
    sample = keyed.where(F.col("key") <= max(keys)).groupBy("key").agg(F.min("html").alias("html")).select("html")

    def run(batches):
        for batch in batches:
            x, y = [], []
            for page in batch.column(0):
                marked = [b for b in blocks_of(page.as_py()) if b.mark]
                marked = marked[:: -(-len(marked) // SAMPLE_BLOCKS) or 1]
                x += features(marked).tolist()
                y += [b.mark > 0 for b in marked]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.bool_())], names=["x", "y"])
        trim()

    rows = sorted((r.x, r.y) for r in sample.mapInArrow(run, "x array<double>, y boolean").collect())
    return learn(np.array([r[0] for r in rows]).reshape(-1, len(PRIOR)), np.array([r[1] for r in rows], float))


# -- cut ------------------------------------------------------------------------------------


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges = [(i, i + 1, ADJACENT / (1 + blocks[i + 1].steps)) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in last:
            edges.append((last[b.parent], i, NEAR))
        last[b.parent] = i
    return edges


def cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; where two are, the larger side.

    ``gain`` is the capacity from the source less that to the sink.  A node that gains or loses
    more than all its edges together has its side before any flow; it then pulls its neighbours.
    """
    gain = list(gain)
    beside: list[dict[int, float]] = [{} for _ in gain]
    for a, b, capacity in edges:
        if a != b and capacity > 0:
            beside[a][b] = beside[a].get(b, 0.0) + capacity
            beside[b][a] = beside[b].get(a, 0.0) + capacity
    held = [sum(n.values()) for n in beside]
    side: list[bool | None] = [None] * len(gain)
    waiting = deque(range(len(gain)))
    while waiting:
        i = waiting.popleft()
        if side[i] is not None or abs(gain[i]) < held[i]:
            continue
        side[i] = gain[i] >= 0
        for j, capacity in beside[i].items():
            if side[j] is None:
                held[j] -= capacity
                gain[j] += capacity if side[i] else -capacity
                waiting.append(j)
    open_ = [i for i, s in enumerate(side) if s is None]
    if open_:
        place = {i: k for k, i in enumerate(open_)}
        inner = [{place[j]: c for j, c in beside[i].items() if j in place} for i in open_]
        for k, kept in enumerate(_flow([gain[i] for i in open_], inner)):
            side[open_[k]] = kept
    return [bool(s) for s in side]


def _flow(gain: list[float], room: list[dict[int, float]]) -> list[bool]:
    """Dinic's maximum flow; True for nodes that cannot reach the sink any more."""
    supply, demand, tiny = [max(g, 0.0) for g in gain], [max(-g, 0.0) for g in gain], 1e-12
    while True:
        # Levels from the sink backwards, so that a search only goes where the sink is nearer.
        level = [-1] * len(gain)
        queue = deque(i for i, d in enumerate(demand) if d > tiny)
        for i in queue:
            level[i] = 0
        while queue:
            j = queue.popleft()
            for i in room[j]:
                if level[i] < 0 and room[i][j] > tiny:
                    level[i] = level[j] + 1
                    queue.append(i)
        begins = [i for i, s in enumerate(supply) if s > tiny and level[i] >= 0]
        if not begins:
            return [x < 0 for x in level]
        untried = [iter(list(r)) for r in room]
        for start in begins:
            path = [start]
            while path:
                i = path[-1]
                if demand[i] > tiny:
                    amount = min(supply[start], demand[i], *(room[a][b] for a, b in zip(path, path[1:])))
                    supply[start] -= amount
                    demand[i] -= amount
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= amount
                        room[b][a] += amount
                    if supply[start] <= tiny:
                        break
                    path = [start]
                    untried[start] = iter(list(room[start]))
                    continue
                for j in untried[i]:
                    if 0 <= level[j] == level[i] - 1 and room[i][j] > tiny:
                        path.append(j)
                        break
                else:
                    path.pop()


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page or "")
    gain = [FIXED * b.mark for b in blocks]
    unknown = [i for i, b in enumerate(blocks) if not b.mark]
    if unknown:
        # log p - log(1 - p): what boilerplate costs less what content costs.
        beside = BESIDE * any(b.mark > 0 for b in blocks)
        score = np.clip(features([blocks[i] for i in unknown]) @ weights - beside, -9, 9)
        for i, s in zip(unknown, score.tolist()):
            gain[i] = s
    return " ".join(b.text for b, kept in zip(blocks, cut(gain, edges_of(blocks))) if kept)


def extract(pages: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``pages`` (all but ``column`` by default) with text and n_chars.

    A null or empty page has an empty text; a page of any length is read whole.  Repeated rows
    stay, with equal texts.  In an empty table, or one where no element says what it is, the
    classifier's prior decides.  A kept column called text or n_chars is an error.
    """
    weights = fit(pages, column)

    def start():
        def work(column):
            texts = [main_text(page.as_py(), weights) for page in column]
            return pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())

        return work

    return annotate(pages, [column], "text string, n_chars bigint", start, keep or [c for c in pages.columns if c != column])
