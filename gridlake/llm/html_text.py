"""Main text of web pages by minimum cut.

A page is read once into blocks, runs of text between tags that break lines. Each block gets a cost for being
called boilerplate and one for being called content: the log-odds of a small linear classifier over what the
block looks like (words, links, sentence marks) and where it stands (names of the elements and classes around
it). These costs are the capacities from source and to sink. Edges between neighbouring blocks, and between
following blocks of the same parent or grandparent element, make it costly to call blocks that stand together
differently. The minimum cut, found by augmenting paths, separates content from boilerplate; blocks on the
source's side, in page order, are the text.

A block whose own costs outweigh all its edges lies on the same side in every minimum cut, so it is settled
first and its edges become costs of its neighbours. What remains is small, and only that goes to max-flow.

Each page is worked on alone, inside Arrow batches; nothing is shuffled.

Cases: a null page is empty and has no text. Unclosed, crossed and truncated tags are read as far as they go.
Scripts, styles, comments and the head are never text. Whole pages are read, whatever their length; repeated
pages give repeated rows; an empty table gives an empty one. Of the input only id, url and html are used.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by what they do, and name parts of classes and ids.
HIDDEN = frozenset("script style noscript template svg math iframe object head title select option textarea button canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BREAKING = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the second kind ends an open element of the first.
ENDS_P = BREAKING - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li", "legend", "summary", "figcaption"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article aside div section nav header footer main form body html".split())
NEVER = frozenset("nav footer aside form menu dialog fieldset".split())
GOOD = frozenset("article main".split())
BAD_NAME = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar|widget\w*|footer|header|masthead|"
    r"cookies?\w*|consent|notices?|popup|modal|newsletter|subscri\w*|signup|login|social|shar(?:e|ing)\w*|related|recommend\w*|"
    r"comments?\w*|repl(?:y|ies)|disqus|respond|toolbar|pagination|pager|copyright|legal|disclaimer|skip\w*|tags?|toc)(?:$|[^a-z])"
)
GOOD_NAME = re.compile(r"(?:^|[^a-z])(?:article\w*|main|content|post-?(?:body|content|text)?|entry\w*|story\w*|body-?text|prose)(?:$|[^a-z])")
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE_RUN = re.compile(r"\s+")
WORD = re.compile(r"\w+")

# Weights of the classifier, in log-odds of content.
BIAS, BY_LOG_WORDS, BY_MARKS, BY_LINKS = -1.0, 0.9, 1.2, -4.5
IN_GOOD, NAMED_GOOD, IN_NEVER, NAMED_BAD, IN_HEADER, PARAGRAPH, HEADING, LIST_ITEM = 3.0, 1.2, -9.0, -7.0, -5.0, 1.0, 0.8, -0.6
#: Capacities of the edges between neighbours, and between following blocks of one parent or grandparent.
NEXT_EDGE, PARENT_EDGE, GRANDPARENT_EDGE = 0.3, 0.8, 0.3


@dataclass
class Block:
    text: str
    linked: int
    score: float
    parent: int
    grandparent: int


@dataclass
class Element:
    name: str
    key: int
    score: float
    hidden: bool
    in_good: bool


@dataclass
class Page:
    """Reads tags and text in page order; holds the open elements and the block that is being gathered."""

    blocks: list[Block] = field(default_factory=list)
    open: list[Element] = field(default_factory=lambda: [Element("", 0, 0.0, False, False)])
    breaking: list[int] = field(default_factory=lambda: [0])  # places in `open` of those that end a block
    named: Counter = field(default_factory=Counter)  # how many elements of each name are open
    text: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    keys: int = 0

    def end_block(self) -> None:
        if self.text:
            text = SPACE_RUN.sub(" ", html.unescape("".join(self.text))).strip()
            if text:
                self.blocks.append(self.scored(text))
        self.text, self.linked = [], 0

    def scored(self, text: str) -> Block:
        k = self.breaking[-1]
        at = self.open[k]
        words = len(WORD.findall(text))
        marks = sum(map(text.count, ".!?"))
        link_share = min(1.0, self.linked / max(1, len(text)))
        score = BIAS + BY_LOG_WORDS * min(4.0, max(words, 1).bit_length() * 0.7) + BY_MARKS * min(1.0, marks) + BY_LINKS * link_share
        if at.name == "p":
            score += PARAGRAPH
        elif at.name[:1] == "h" and at.name[1:].isdigit():
            score += HEADING
        elif at.name == "li":
            score += LIST_ITEM
        return Block(text, self.linked, score + at.score, self.open[max(k - 1, 0)].key, self.open[max(k - 2, 0)].key)

    def start(self, name: str, attributes: str) -> None:
        if name in BREAKING:
            self.end_block()
        if name in ENDS_P:
            self.close("p", BREAKING - {"p"} - set(SIBLINGS))
        if name in SIBLINGS:
            self.close_first(SIBLINGS[name])
        if name in VOID:
            if name == "br":
                self.text.append(" ")
            return
        if name == "a":
            self.links += 1
        up = self.open[-1]
        score, good = up.score, up.in_good
        named = " ".join(m[1] or m[2] or m[3] or "" for m in NAMES.finditer(attributes)).lower() if "=" in attributes else ""
        if name in NEVER:
            score += IN_NEVER
        elif name == "header":
            score += 0.0 if good else IN_HEADER
        elif name in GOOD and not good:
            score, good = score + IN_GOOD, True
        if named:
            if BAD_NAME.search(named) or not BAD_ROLE.isdisjoint(named.split()):
                score += NAMED_BAD
            elif GOOD_NAME.search(named):
                score += NAMED_GOOD
        hidden = up.hidden or name in HIDDEN or " hidden" in f" {attributes.lower()} ".replace("/", " ") and "=" not in attributes
        self.keys += 1
        self.open.append(Element(name, self.keys, score, hidden, good))
        self.named[name] += 1
        if name in BREAKING:
            self.breaking.append(len(self.open) - 1)

    def leave(self, k: int) -> None:
        """Closes the open elements from place k on."""
        while len(self.open) > k:
            self.named[self.open.pop().name] -= 1
        while self.breaking[-1] >= k:
            self.breaking.pop()

    def close(self, name: str, stop: frozenset | set) -> None:
        if not self.named[name]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == name:
                self.end_block()
                self.leave(k)
                return
            if self.open[k].name in stop:
                return

    def close_first(self, names: tuple[str, ...]) -> None:
        if not any(self.named[n] for n in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                self.end_block()
                self.leave(k)
                return
            if self.open[k].name in SCOPE:
                return

    def end(self, name: str) -> None:
        if name in BREAKING:
            self.end_block()
        if name == "a":
            self.links = max(0, self.links - 1)
        if not self.named[name]:
            return
        # An inline end tag does not reach out of the breaking element it stands in.
        stop = frozenset() if name in BREAKING else BREAKING
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == name:
                self.leave(k)
                return
            if self.open[k].name in stop:
                return

    def add(self, text: str) -> None:
        if not self.open[-1].hidden:
            self.text.append(text)
            if self.links:
                self.linked += len(text)


def blocks_of(source: str) -> list[Block]:
    page, at = Page(), 0
    while at < len(source):
        m = TAG.search(source, at)
        if not m:
            page.add(source[at:])
            break
        if m.start() > at:
            page.add(source[at : m.start()])
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                page.end(name)
            else:
                page.start(name, m[3])
                if name in RAW and not m[3].endswith("/"):
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    body_end, at = (close.start(), close.end()) if close else (len(source), len(source))
                    page.end(name)
                    del body_end
    page.end_block()
    return page.blocks


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    last_parent: dict[int, int] = {}
    last_grandparent: dict[int, int] = {}
    for k, b in enumerate(blocks):
        pairs = [(k - 1, NEXT_EDGE)] if k else []
        pairs += [(last_parent[b.parent], PARENT_EDGE)] if b.parent in last_parent else []
        pairs += [(last_grandparent[b.grandparent], GRANDPARENT_EDGE)] if b.grandparent in last_grandparent else []
        for other, capacity in pairs:
            edges[other, k] = edges.get((other, k), 0.0) + capacity
        last_parent[b.parent] = last_grandparent[b.grandparent] = k
    return edges


#: Differences of costs below this are ties.
TIE = 1e-9


def source_side(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut. A positive score is the capacity from the source,
    a negative one that to the sink; edges go both ways.

    Nodes are settled where the terminals outweigh all edges. A node with at most two edges is taken out: what it costs at best for
    each placing of its neighbours is again a score for each and an edge between them, so the cut of the rest is that of the whole,
    and the node's own side follows from its neighbours'. Pages are sequences with few other edges, of which this leaves little or nothing;
    only that goes through max-flow."""
    n = len(scores)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        around[a][b] = around[a].get(b, 0.0) + c
        around[b][a] = around[b].get(a, 0.0) + c
    scores, side, out = list(scores), [None] * n, [False] * n
    later: list[tuple[int, float, list[tuple[int, float]]]] = []
    left = deque(range(n))
    while left:
        k = left.popleft()
        if out[k]:
            continue
        near = around[k]
        if abs(scores[k]) >= sum(near.values()):
            side[k] = scores[k] > 0
            for j, c in near.items():
                del around[j][k]
                scores[j] += c if side[k] else -c
        elif len(near) <= 2:
            later.append((k, scores[k], list(near.items())))
            _take_out(k, scores, around)
        else:
            continue
        out[k] = True
        left.extend(near)
        around[k] = {}
    rest = [k for k in range(n) if not out[k]]
    if rest:
        reached = _max_flow_side(rest, scores, around)
        for k in rest:
            side[k] = k in reached
    for k, score, near in reversed(later):
        side[k] = sum(c if side[j] else -c for j, c in near) + score > TIE
    return side


def _take_out(k: int, scores: list[float], around: list[dict[int, float]]) -> None:
    """Puts the least cost of a node with one or two edges, as a function of its neighbours' sides, in its place."""
    near = [(j, around[k][j]) for j in around[k]]
    cost = lambda *sides: min(sum(c for (_, c), s in zip(near, sides, strict=True) if s), -scores[k] + sum(c for (_, c), s in zip(near, sides, strict=True) if not s))
    if len(near) == 1:
        ((a, _),) = near
        scores[a] -= cost(True) - cost(False)
    else:
        (a, _), (b, _) = near
        none, first, second, both = cost(False, False), cost(True, False), cost(False, True), cost(True, True)
        edge = (first + second - none - both) / 2
        scores[a] -= first - none - edge
        scores[b] -= second - none - edge
        if edge > 0:
            around[a][b] = around[a].get(b, 0.0) + edge
            around[b][a] = around[b].get(a, 0.0) + edge
    for j, _ in near:
        del around[j][k]


def _max_flow_side(rest: list[int], scores: list[float], around: list[dict[int, float]]) -> set[int]:
    """Max-flow by blocking flows in levels; the nodes that the source still reaches."""
    place = {k: i for i, k in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    heads: list[list[int]] = [[] for _ in range(len(rest) + 2)]
    to, room = [], []

    def link(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for k in rest:
        i = place[k]
        if scores[k] > 0:
            link(source, i, scores[k], 0.0)
        elif scores[k] < 0:
            link(i, sink, -scores[k], 0.0)
        for j, c in around[k].items():
            if k < j:
                link(i, place[j], c, c)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > TIE and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            return {rest[i] for i in level if i < source}
        next_, path, a = [0] * len(heads), [], source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(i for i, e in enumerate(path) if room[e] <= TIE)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while next_[a] < len(heads[a]):
                e = heads[a][next_[a]]
                if room[e] > TIE and level.get(to[e]) == level[a] + 1:
                    break
                next_[a] += 1
            if next_[a] < len(heads[a]):
                path.append(e)
                a = to[e]
            elif path:
                a = to[path.pop() ^ 1]
                next_[a] += 1
            else:
                break


def main_text(source: str | None) -> str:
    blocks = blocks_of(source or "")
    side = source_side([b.score for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, content in zip(blocks, side, strict=True) if content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            counts = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col], pages[url_col], pages[html_col])
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
