"""Main text of web pages by minimum-cut labelling.

A page becomes a graph of its text blocks and of the elements that hold them.  A linear classifier turns
the text of a block alone (length, links, sentences, headings) into a terminal capacity; elements whose
tag, role or names say what they are have capacities of their own.  Edges tie a block to its element,
elements to the ones around them in the same marked region (DOM proximity), and blocks that follow each
other or share a container (adjacency).  The labelling of least total cost is a minimum cut between the
terminals "content" and "boilerplate": short lines of an article are kept by their surroundings, long
notices are dropped by theirs, and a layout name around a whole article is outvoted by its paragraphs.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from journalsieve.llm.common import own_columns

# Elements whose text is never shown as text of the page.
HIDDEN = {"head", "title", "script", "style", "template", "textarea", "select", "button", "iframe", "canvas",
          "audio", "video"}
RAW = {"script", "style", "textarea", "title", "iframe", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
         "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# A start tag of the first kind ends an open element of the second, up to the nearest third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CONTENT_TAGS, AROUND_TAGS = {"article", "main"}, {"nav", "footer", "aside", "form", "menu", "dialog", "search"}
AROUND_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "menu", "menubar",
                "alert", "alertdialog", "form"}
# Words of class names and ids, after splitting at signs.
CONTENT_WORDS = {"article", "articlebody", "content", "entry", "main", "post", "story"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "discussion"}
AROUND_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb",
                "breadcrumbs", "consent", "cookie", "cookies", "copyright", "footer", "gdpr", "header", "login",
                "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager",
                "pagination", "popup", "promo", "promotion", "recommended", "related", "search", "share",
                "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar",
                "topbar", "widget"}
# Of these, names that themes also give to wrappers of the text; and words that begin the name of a setting.
LAYOUT_WORDS = {"banner", "header", "modal", "promo", "promotion", "share", "sharing", "social", "widget"}
SETTING_WORDS = {"has", "no", "with", "without"}


@dataclass(frozen=True)
class Costs:
    """Weights of the classifier (positive: content) and of the edges."""

    bias: float = -1.0
    heading: float = 0.5
    words: float = 1 / 15  # for each of up to 45 words
    sentence: float = 0.5
    links: float = -3.0
    list_item: float = -0.5
    content_tag: float = 4.0  # ties of a block to its element, by the region that it lies in
    content_word: float = 2.0
    around: float = 9.0
    layout: float = 4.0
    layout_base: float = 6.0  # what the blocks under a layout name must outweigh, and more for each block
    layout_block: float = 1.0
    nested: float = 0.5  # of a marked element to the region around it, for each block
    following: float = 0.9  # divided by the containers between two blocks, plus one
    same_container: float = 0.5


@dataclass
class Block:
    text: str
    score: float
    path: tuple[int, ...]  # containers from the outermost
    home: int  # element that holds it


@dataclass
class Element:
    """An element of the graph: the one around it, its mark, and the strength of ties within its region."""

    parent: int
    mark: str  # "", content, around or layout
    tie: float
    blocks: int = 0  # inside it, at any depth


@dataclass(frozen=True)
class State:
    """What holds inside an open element; ``around`` is 0, 1 (by a layout name) or 2."""

    name: str = ""
    number: int = 0
    weight: float = 0.0
    around: int = 0
    comments: bool = False
    hidden: bool = False
    home: int = 0


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
                        re.I)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): text, start and end tags; comments and raw elements are left out."""
    at, size, raw = 0, len(page), None
    while at < size:
        if raw:
            end = _RAW_END[raw].search(page, at)
            at, raw = (end.start() if end else size), None
            continue
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
        elif page[start + 1:start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
        else:
            tag = _TAG.match(page, start) or _LOOSE_TAG.match(page, start)
            if not tag:
                if re.match(r"</?[a-zA-Z]", page[start:start + 3]):
                    return  # a tag cut off at the end of the page
                yield "text", "<", ""
                at = start + 1
                continue
            name = tag[2].lower()
            yield ("end" if tag[1] else "start"), name, tag[3]
            at = tag.end()
            if not tag[1] and name in RAW and not tag[3].endswith("/"):
                raw = name


def _about(named: list[set[str]], article: bool) -> set[str]:
    """Words that say what an element is, from the words of each of its names.

    Beside a name of content words alone (``post category-social``), and on an article, other names tell of
    its category, layout or settings.  An article is a comment only if that is a whole name of it.  Of a name
    of both kinds the rest counts (``post-comments``), but the header of content holds its title.
    """
    content = any(n and n <= CONTENT_WORDS for n in named)
    if article:
        return set() if content else {w for n in named if len(n) == 1 for w in n & COMMENT_WORDS}
    if content:
        named = [n for n in named if n & CONTENT_WORDS]
    return {w for n in named for w in n if w != "header" or not n & CONTENT_WORDS}


class _Reader:
    """Collects the blocks and elements of a page with the state of its open elements."""

    def __init__(self, costs: Costs):
        self.costs, self.blocks, self.opened = costs, [], 0
        self.elements = {0: Element(-1, "", 0.0)}
        self.open = [State()]
        self.parts: list[str] = []
        self.linked = 0

    def _state(self, name: str, attributes: str) -> State:
        outer = self.open[-1]
        weight, around, comments, hidden = outer.weight, outer.around, outer.comments, outer.hidden
        self.opened += 1
        words, named, role = set(), [], ""
        if attributes and name not in ("html", "body"):
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value.strip("\"'").lower()
                if key in ("class", "id", "itemprop"):
                    words.update(_WORD.findall(value))
                    each = [_WORD.findall(v) for v in value.split()]
                    named += [set(n) for n in each if not n or n[0] not in SETTING_WORDS]
                elif key == "role":
                    role = value
                elif key == "hidden" and name != "input" or key == "aria-hidden" and value == "true":
                    hidden = True
        article = name in CONTENT_TAGS or role in ("main", "article")
        if article:
            weight = self.costs.content_tag
            around = 2 if comments else 0  # what lies around the article does not count inside it
        elif words & CONTENT_WORDS:
            weight = max(weight, self.costs.content_word)
        about = _about(named, article)
        if about & COMMENT_WORDS:
            around, comments = 2, True
        elif name in AROUND_TAGS or role in AROUND_ROLES or name == "header" and weight != self.costs.content_tag:
            around = 2
        elif name in BLOCK and about & AROUND_WORDS:
            around = max(around, 1 if about & AROUND_WORDS <= LAYOUT_WORDS else 2)
        mark = ""
        if around > outer.around:
            mark = "layout" if around == 1 else "around"
        elif not around and (outer.around or weight > outer.weight):
            mark = "content"
        home = outer.home
        if mark or name in BLOCK and name != "p":
            tie = (weight, self.costs.layout, self.costs.around)[around]
            self.elements[self.opened] = Element(home, mark, tie)
            home = self.opened
        return State(name, self.opened, weight, around, comments, hidden or name in HIDDEN, home)

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join(html.unescape("".join(self.parts)).split())
        linked, self.parts, self.linked = self.linked, [], 0
        if not text:
            return
        costs, names = self.costs, [o.name for o in self.open[-4:]]
        score = costs.bias + costs.words * min(45, text.count(" ") + 1)
        score += costs.links * min(1.0, linked / len(text))
        if any(n in ("h1", "h2", "h3", "h4", "h5", "h6") for n in names):
            score += costs.heading
        if "li" in names:
            score += costs.list_item
        if _SENTENCE.search(text):
            score += costs.sentence
        path = tuple(o.number for o in self.open if o.name in BLOCK and o.name != "p")
        self.blocks.append(Block(text, score, path, self.open[-1].home))

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.flush()
            while self.open[-1].name and self.open[-1].name not in BLOCK or self.open[-1].name == "p":
                if self.open[-1].name in HIDDEN:
                    break
                self.open.pop()
            if name in IMPLIED:
                ends, within = IMPLIED[name]
                for k in range(len(self.open) - 1, 0, -1):
                    if self.open[k].name in within:
                        break
                    if self.open[k].name in ends:
                        del self.open[k:]
                        break
        elif name == "br":
            self.parts.append(" ")
        if name not in VOID and not attributes.endswith("/") or name in BLOCK and name != "hr":
            self.open.append(self._state(name, attributes))

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == name:
                del self.open[k:]
                return
            if name not in BLOCK and self.open[k].name in BLOCK:
                return

    def text(self, text: str) -> None:
        if not self.open[-1].hidden:
            self.parts.append(text)
            if any(o.name == "a" for o in self.open[-4:]):
                self.linked += len(text.strip())


def read_page(page: str, costs: Costs = Costs()) -> tuple[list[Block], dict[int, Element]]:
    """The blocks of a page, and the elements that hold them by number."""
    reader = _Reader(costs)
    for kind, value, attributes in tokens(page):
        if kind == "text":
            reader.text(value)
        elif kind == "start":
            reader.start(value, attributes)
        else:
            reader.end(value)
    reader.flush()
    elements = reader.elements
    for block in reader.blocks:
        elements[block.home].blocks += 1
    for number in sorted(elements, reverse=True):  # an element is opened after those around it
        if number:
            elements[elements[number].parent].blocks += elements[number].blocks
    return reader.blocks, elements


def ties(blocks: list[Block], costs: Costs = Costs()) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours by the containers between them, and the next block of a container."""
    edges = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            before = blocks[i - 1].path
            shared = 0
            for a, b in zip(before, block.path):
                if a != b:
                    break
                shared += 1
            between = len(before) + len(block.path) - 2 * shared
            edges.append((i - 1, i, costs.following / (1 + between)))
        home = block.path[-1] if block.path else 0
        if last.get(home, i - 1) != i - 1:
            edges.append((last[home], i, costs.same_container))
        last[home] = i
    return edges


def graph(blocks: list[Block], elements: dict[int, Element],
          costs: Costs = Costs()) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal capacities and edges of the blocks, followed by those of the elements in marked regions.

    An element outside every marked region ties nothing: there blocks stand by their text and their
    neighbours.  A mark but a layout name outweighs all blocks inside its element, and an element without
    a mark follows its region; a block leaves it where its own cost outweighs the region's tie.
    """
    scores, edges = [b.score for b in blocks], ties(blocks, costs)
    place = {}
    for number, e in elements.items():
        if e.tie and e.blocks:
            place[number] = len(scores)
            scores.append({"": 0.0, "content": 2 * e.tie * e.blocks + 10, "around": -2 * e.tie * e.blocks - 10,
                           "layout": -costs.layout_base - costs.layout_block * e.blocks}[e.mark])
            if e.parent in place:
                edges.append((place[e.parent], place[number], costs.nested * e.blocks if e.mark else e.tie * (e.blocks + 1)))
    edges += [(i, place[b.home], elements[b.home].tie) for i, b in enumerate(blocks) if b.home in place]
    return scores, edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where the cut leaves a node with the source (content).

    A node whose terminal outweighs all its ties keeps its side in every minimum cut; its ties become
    terminal capacity of its neighbours.  The rest is solved by augmenting along shortest paths.
    """
    n = len(scores)
    weight, label = list(scores), [None] * n
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        around[a][b] = around[a].get(b, 0.0) + c
        around[b][a] = around[b].get(a, 0.0) + c
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is None and abs(weight[i]) > sum(around[i].values()):
            label[i] = weight[i] > 0
            for j, c in around[i].items():
                weight[j] += c if label[i] else -c
                del around[j][i]
                waiting.append(j)
            around[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        side = _source_side({i: weight[i] for i in left}, around)
        for i in left:
            label[i] = i in side
    return label


def _source_side(weight: dict[int, float], around: list[dict[int, float]]) -> set[int]:
    """Nodes the source still reaches after a maximum flow."""
    source, sink, tiny = -1, -2, 1e-9
    room: dict[int, dict[int, float]] = {i: dict(around[i]) for i in weight}
    room[source] = {i: w for i, w in weight.items() if w > 0}
    room[sink] = {}
    for i, w in weight.items():
        if w > 0:
            room[i][source] = 0.0
        elif w < 0:
            room[i][sink] = -w
            room[sink][i] = 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level) - {source}
        ahead = {i: iter(list(room[i])) for i in level}
        path = [source]
        while path:  # a blocking flow by depth-first search
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:]))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                full = next(k for k, (a, b) in enumerate(steps) if room[a][b] <= tiny)
                del path[full + 1:]
                continue
            for j in ahead[i]:
                if level.get(j) == level[i] + 1 and room[i][j] > tiny:
                    path.append(j)
                    break
            else:
                path.pop()


def extract(page: str | None, costs: Costs = Costs()) -> tuple[str, int, int, int]:
    """(text, blocks, blocks kept, blocks whose label the edges turned against their own cost) of a whole page."""
    blocks, elements = read_page(page or "", costs)
    kept = minimum_cut(*graph(blocks, elements, costs))
    texts = [b.text for b, k in zip(blocks, kept) if k]
    return "\n\n".join(texts), len(blocks), len(texts), sum((b.score > 0) != k for b, k in zip(blocks, kept))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  costs: Costs = Costs()) -> DataFrame:
    """Id, url, text, n_chars (code points), n_blocks, n_kept and n_turned of every page, from its whole html.

    Null or empty html, or a page without content, gives an empty text.  Null ids and urls and repeated
    rows pass through; extra columns are left out; an empty table gives an empty table.  Pages are
    independent, so there is no shuffle; a page's memory is a few times its length.
    """
    source = own_columns(pages, **{id_col: id_col, url_col: url_col}, __html=html_col).withColumn(
        "__html", F.col("__html").cast("string"))
    types = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(p.as_py(), costs) for p in batch.column(2)]
            texts = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array([f[1] for f in found], pa.int32()),
                 pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())],
                names=[id_col, url_col, "text", "n_chars", "n_blocks", "n_kept", "n_turned"])

    return source.mapInArrow(run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, "
                                  "n_chars long, n_blocks int, n_kept int, n_turned int")
