"""Main-text extraction by tag-path ratios.

A page is cut into text blocks, each with the path of tags from the root to it; paths are numbers, interned as (parent
path, step), so deep pages cost no more than flat ones.  For every path the text length, the punctuation and the share of
link text are aggregated; their sequences over the page are smoothed, fused into one score, and a block is kept where the
score reaches a share of the page's mean.  A list, table, quotation or preformatted text is one node: its items and cells stand or
fall together, by the text of all of them.  Short blocks that the score passes over stay where blocks of the same parent
before and after them stay (in a marked article: where any does).  Elements that never hold an article's text (navigation, forms, scripts and so
on) take no part.  Where a page marks an article or main element, only blocks inside it do.  Class names are weights:
a name that often means boilerplate leaves a block to its own path's ratios, without its neighbours'; names of reader
comments and adverts weigh nothing.  An id is less: headings carry any, and of others only those of comments weigh nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tables import map_arrow

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder mstyle".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOILER_TAGS = frozenset("nav footer aside form script style noscript template iframe svg button select option textarea input dialog menu head title".split())
# Words in class and id names; what weighs nothing, and what leaves a block to its own path's ratios.
DROPPED_NAMES = re.compile(
    r"(?i)(^|[\s_-])(comments|comment-(list|section|area|form)|disqus|respond|replies|ads?|advert\w*|promo\w*|sponsor(ed)?|cookies?|consent|popup|modal|newsletter|subscribe|signup|login)($|[\s_-])"
)
COMMENT_NAMES = re.compile(r"(?i)(^|[\s_-])(comments|comment-(list|section|area|form)|disqus\w*|respond|replies)($|[\s_-])")
DOUBTFUL_NAMES = re.compile(
    r"(?i)(^|[\s_-])(nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|sidebar|side-bar|aside|banner|notice|comment|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|"
    r"pager|tags?|copyright|legal|disclaimer|search|skip-link|toc)($|[\s_-])"
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?¿¡…。，！？]")
_ATTR = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)(?:>|\Z)""", re.S)
#: Elements that end an open one of the second set when they begin, unless one of the third is nearer.
ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",)),
}
PLAIN, CALLED, DOUBTFUL, DROPPED = 0, 1, 2, 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("ul ol dl table pre blockquote".split())
CELLS = frozenset("td th caption tr table".split())  # a table with blocks of other kinds in it lays a page out
CALLED_WEIGHT = 0.35  # of a block whose id alone is one of boilerplate
MOST_LINKS = 0.5  # above it a run of short blocks is a menu wherever it stands, unless it is a list or table
#: Share of the mean score, weight of a doubtful name, weight of links (they are menus, unless the page says that they are
#: content): without and with a marked article.
LIMITS = {False: (0.25, 0.15, 1.0), True: (0.15, 0.35, 0.5)}


class Block:
    """path: number of its tag path; rank: what its elements' names say; article: inside a marked element; tag and parent: its
    block element's name and the number of the element around that; container: the list, table or such it is in,
    as (number of the element, its path, its tag, the number of the element around it), or None."""

    __slots__ = ("path", "text", "links", "rank", "article", "tag", "parent", "container")

    def __init__(self, path: int, rank: int, article: bool, tag: str, parent: int, container: tuple | None):
        self.path, self.rank, self.article, self.tag, self.parent, self.container = path, rank, article, tag, parent, container
        self.text: list[str] = []
        self.links = 0


def _rank(tag: str, attrs: str, inside_article: bool) -> tuple[int, str]:
    """What an element's name and attributes say of the text in it, and the doubtful class or id, which is then part of
    the path, as its text is of another kind than that of other elements there."""
    if tag in BOILER_TAGS or tag == "header" and not inside_article:
        return DROPPED, ""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower() or tag in ("html", "body"):
        return PLAIN, ""
    rank, doubtful = PLAIN, ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return DROPPED, ""
        if name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return DROPPED, ""
        if name == "role" and value.lower() in BOILER_ROLES:
            return DROPPED, ""
        if name == "class" and tag not in ("article", "main", "h1"):
            if DROPPED_NAMES.search(value):
                return DROPPED, ""
            if DOUBTFUL_NAMES.search(value):
                rank, doubtful = DOUBTFUL, value
        if name == "id" and tag not in ("article", "main") and tag not in HEADINGS:
            if COMMENT_NAMES.search(value):
                return DROPPED, ""
            if DROPPED_NAMES.search(value) and rank < CALLED:
                rank, doubtful = CALLED, value
            elif DOUBTFUL_NAMES.search(value):
                rank, doubtful = DOUBTFUL, value
    return rank, doubtful


class Stack:
    """Open elements, with the places of each tag and of the block elements among them, so that every question about the
    elements above costs the same however deep the page is."""

    def __init__(self):
        self.tags, self.ranks, self.articles, self.paths = [""], [PLAIN], [False], [0]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]
        self.numbers, self.made = [0], 0
        self.containers: list[tuple | None] = [None]
        self.paths_by_step: dict[tuple[int, str, str], int] = {}

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element with one of ``tags``; 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, tag: str, rank: int, name: str, article: bool) -> None:
        path = self.paths[-1]
        if tag not in INLINE:
            path = self.paths_by_step.setdefault((path, tag, name), len(self.paths_by_step) + 1)
            self.blocks.append(len(self.tags))
        self.places.setdefault(tag, []).append(len(self.tags))
        self.made += 1
        self.numbers.append(self.made)
        self.containers.append(self.containers[-1] or ((self.made, path, tag, self.numbers[-2]) if tag in CONTAINERS else None))
        self.tags.append(tag)
        self.ranks.append(rank)
        self.articles.append(article)
        self.paths.append(path)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all in it."""
        while len(self.tags) > place:
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.ranks.pop()
            self.numbers.pop()
            self.containers.pop()
            self.articles.pop()
            self.paths.pop()


def blocks(html: str) -> list[Block]:
    """The page's text blocks in page order; badly nested markup is closed as browsers do, and never loses text."""
    out: list[Block] = []
    stack = Stack()
    now: Block | None = None

    def text(s: str) -> None:
        nonlocal now
        block = stack.blocks[-1]
        if not s or stack.ranks[-1] > stack.ranks[block]:
            return  # boilerplate within a line goes; the rest of its block stays
        if now is None:
            if s.isspace():
                return
            around = stack.blocks[-2] if len(stack.blocks) > 1 else 0
            now = Block(stack.paths[block], stack.ranks[block], stack.articles[block], stack.tags[block], stack.numbers[around], stack.containers[block])
            out.append(now)
        now.text.append(s)
        if stack.places.get("a"):
            now.links += len(s)

    at, n = 0, len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        if m is None:
            text(unescape(html[at:]))
            break
        if m.start() > at:
            text(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if html.startswith("<![CDATA[", m.start()):
                text(html[m.start() + 9 : at - 3])
            continue
        close, tag, attrs = m[1] == "/", m[2].lower(), m[3]
        if tag not in INLINE and tag != "br":
            now = None
        if close:
            place = stack.last((tag,))
            if place and not (tag in INLINE and stack.blocks[-1] > place):
                stack.cut(place)  # a stray inline end tag closes nothing outside its block
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
        elif tag == "br":
            text(" ")
        elif tag not in VOID and not attrs.endswith("/"):
            if tag in CLOSES_P and stack.last(("p",)):
                stack.cut(stack.last(("p",)))
            if tag in ENDS:
                own, scope = (stack.last(x) for x in ENDS[tag])
                if own > scope:
                    stack.cut(stack.places[next(t for t in ENDS[tag][0] if stack.last((t,)) == own)][-1])
            article = stack.articles[-1] or tag in ("article", "main")
            rank, name = _rank(tag, attrs, article)
            stack.push(tag, max(stack.ranks[-1], rank), name, article)
    return out


def smooth(values: list[float], radius: int = 1) -> list[float]:
    """Means over a window of 2 * radius + 1 places, shorter at the ends."""
    sums = [0.0]
    for v in values:
        sums.append(sums[-1] + v)
    n = len(values)
    return [(sums[min(n, i + radius + 1)] - sums[max(0, i - radius)]) / (min(n, i + radius + 1) - max(0, i - radius)) for i in range(n)]


class Node:
    """A block, or all blocks of one container."""

    __slots__ = ("path", "parent", "rank", "whole", "texts", "length", "punct", "linked")

    def __init__(self, path: object, parent: int, rank: int, whole: bool):
        self.path, self.parent, self.rank, self.whole = path, parent, rank, whole
        self.texts: list[str] = []
        self.length = self.punct = self.linked = 0

    def add(self, block: Block, text: str) -> None:
        self.texts.append(text)
        self.rank = max(self.rank, block.rank)
        self.length += len(text)
        self.punct += len(_PUNCT.findall(text))
        self.linked += min(block.links, len(text))


def nodes_of(pool: list[tuple[Block, str]]) -> list[Node]:
    layout = {b.container[0] for b, _ in pool if b.container and b.container[2] == "table" and b.tag not in CELLS}
    out: list[Node] = []
    now = None
    for b, t in pool:
        container = b.container[0] if b.container and b.container[0] not in layout else None
        if container is None or container != now:
            # the path of a container is told from that of text right in such an element
            out.append(Node(b.path, b.parent, b.rank, False) if container is None else Node(("whole", b.container[1]), b.container[3], b.rank, True))
        now = container
        out[-1].add(b, t)
    return out


def scores(nodes: list[Node], marked: bool) -> list[float]:
    """The fused, smoothed ratios of each node's path; a container's text counts at most as much as the longest path's mean."""
    length, punct, linked, count = (defaultdict(int) for _ in range(4))
    for x in nodes:
        length[x.path] += x.length
        punct[x.path] += x.punct
        linked[x.path] += x.linked
        count[x.path] += 1
    single = {x.path for x in nodes if not x.whole} or set(length)
    most_t, most_p = max(length[p] / count[p] for p in single), max(punct[p] / count[p] for p in single) or 1.0
    own = {p: 0.5 * min(1.0, length[p] / count[p] / most_t) + 0.5 * min(1.0, punct[p] / count[p] / most_p) for p in length}
    around = smooth([own[x.path] for x in nodes])
    _, doubt, links = LIMITS[marked]
    weight = {CALLED: CALLED_WEIGHT, DOUBTFUL: doubt}
    out = []
    for x, near in zip(nodes, around, strict=True):
        named = x.rank in weight
        out.append((weight[x.rank] * own[x.path] if named else near) * (1 - (1.0 if named else links) * linked[x.path] / length[x.path]))
    return out


def with_siblings(nodes: list[Node], kept: list[bool], marked: bool) -> list[bool]:
    """``kept`` and the runs of plain nodes between kept ones of one parent, or, in a marked article, beside any kept one."""
    n = len(nodes)
    before, after = [None] * n, [None] * n  # the parent of the nearest kept node on either side
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            side[i] = last
            if kept[i]:
                last = nodes[i].parent
    homes = {x.parent for x, k in zip(nodes, kept, strict=True) if k} if marked else set()

    def stays(i: int) -> bool:
        x = nodes[i]
        if kept[i] or x.rank != PLAIN or x.linked > MOST_LINKS * x.length and not x.whole:
            return kept[i]
        return before[i] is not None and before[i] == after[i] or x.parent in homes

    out = [stays(i) for i in range(n)]
    # an unmarked page may end in a run of one kind: three or more without links, such as lines of code, are no footer
    end = max((i for i in range(n) if out[i]), default=n - 1) + 1
    alike = {(x.path, x.parent, x.rank, x.linked) for x in nodes[end:]}
    if n - end >= 3 and len(alike) == 1 and nodes[end].rank == PLAIN and not nodes[end].linked and nodes[end].parent == nodes[end - 1].parent:
        out[end:] = [True] * (n - end)
    return out


def main_blocks(html: str) -> list[str]:
    """The texts of the content blocks, white space within a block turned into one space."""
    found = [(b, _SPACE.sub(" ", "".join(b.text)).strip()) for b in blocks(html)]
    pool = [(b, t) for b, t in found if t and b.rank != DROPPED]
    inside = [(b, t) for b, t in pool if b.article]
    marked = bool(inside)
    nodes = nodes_of(inside or pool)
    if not nodes:
        return []
    score = scores(nodes, marked)
    limit = LIMITS[marked][0] * sum(score) / len(score)
    kept = with_siblings(nodes, [s > 0 and s >= limit for s in score], marked)
    return [t for x, k in zip(nodes, kept, strict=True) if k for t in x.texts]


def main_text(html: str) -> str:
    return "\n\n".join(main_blocks(html))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) for every row of ``pages``.

    Null or empty html, and pages without content, give an empty text; repeated rows give equal rows; a page is read
    whole whatever its length or depth, in time that grows with its length; blocks of equal scores are kept or dropped
    together; an empty table gives an empty table; other columns, clashing ones too, are not read."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return map_arrow(rows, _extract, "page_id long, url string, text string, n_chars long")
