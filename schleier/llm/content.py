"""Main text of web pages by tag-path ratios.

A page is tokenised into blocks: runs of text between block-level tags, with character references decoded and white
space turned into single spaces. A block belongs to a unit: the nearest paragraph, heading, list, table or the like, or
the container that it stands in directly. Each unit has the root-to-leaf path of the elements around it, with their classes
(inline tags don't count; end tags that HTML lets one leave out are implied).

*Aggregate.* For each path, text length, punctuation and the share of linked text are summed over the page; a path's ratio
is log(1 + mean length x (1 + mean punctuation)). Containers have the same ratio of all that they hold.
*Smooth.* A unit's ratio is raised by those of the units beside it in the same container, or in one around or inside it.
*Fuse.* To it come the ratios of the containers around it, each ``FADE`` as much as the one inside it, but for containers that hold
the whole page; the sum is multiplied by the share outside links, and by a prior from names.
*Threshold.* Paths whose mean is at least ``SHARE`` of the page's mean (by length of text) are content, and all of their blocks
are the main text. No tag is kept or dropped by its kind alone, short paragraphs, lists, tables and headings neither.

What HTML itself defines as something else (navigation, forms, scripts, asides, a footer, a header outside an article) is never
content. Names are only a prior: a class that names a menu, advert, comment or the like lowers the score; one that tells a
state (``has-sidebar``), that stands beside a name of content, or whose element holds an article or four fifths of the page does
not. Where articles or main elements hold a quarter of the text or more, what is outside them scores less. So several articles stay.

Null and empty pages have the text ''; an empty table gives an empty one; equal pages, ties and repeated rows give equal texts. Broken tags
and missing end tags are taken as browsers do, by and large; nothing is cut off or limited. New columns replace those of the same name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)(?:>|(?=<)|\Z)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CAMEL = re.compile(r"([a-z])([A-Z])")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。、，；：！？]")

# Names of HTML elements by what they do to text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes svg math".split())
NEVER = frozenset("head script style noscript template textarea title iframe nav footer aside form button select option dialog menu object canvas audio video fieldset".split())
UNITS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure address details".split())
PARTS = frozenset("li dd dt tr td th tbody thead tfoot caption figcaption summary colgroup".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table article section div main body html aside nav footer header form blockquote".split())
NAMES = frozenset("nav navbar navigation menu sidebar footer header masthead ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments reply replies respond disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar search complementary contentinfo".split())
CONTENT = frozenset("content article post entry hentry story main layout page body text".split())
STATES = frozenset("has no with without is not hide show".split())
WHOLE = frozenset("html body main".split())
#: A path is content from this share of the page's mean score on; what a container adds to what it holds; weights of units beside a unit, and
#: of those beside these.
SHARE, FADE, BESIDE, FURTHER = 0.5, 0.6, 0.6, 0.8
#: Priors of what is named as something else, of what is outside articles but inside main, and of what is outside both.
NAMED_PRIOR, MAIN_PRIOR, OUTSIDE_PRIOR = 0.1, 0.8, 0.3


@dataclass(slots=True)
class Node:
    """A block-level element; ``path`` numbers its root-to-leaf path, ``held`` has characters, punctuation and linked characters of all in it."""

    tag: str
    parent: Node | None
    path: int
    excluded: bool
    inside: bool
    named: bool
    held: list[int]


@dataclass(slots=True)
class Block:
    node: Node
    unit: Node
    text: str
    counts: tuple[int, int, int]


class Paths:
    """Paths by number; a path is its parent's number and a step."""

    def __init__(self) -> None:
        self.steps: list[tuple[int, str]] = [(0, "")]
        self.number: dict[tuple[int, str], int] = {}

    def below(self, path: int, step: str) -> int:
        if (path, step) not in self.number:
            self.number[path, step] = len(self.steps)
            self.steps.append((path, step))
        return self.number[path, step]

    def name(self, path: int) -> str:
        out = []
        while path:
            path, step = self.steps[path]
            out.append(step)
        return "/" + "/".join(reversed(out))


def _excluded(tag: str, parent: Node) -> bool:
    return parent.excluded or tag in NEVER or tag == "header" and not parent.inside


def _names(attributes: str) -> tuple[str, bool]:
    """The classes as part of a path, and whether the names tell of something that isn't content."""
    tokens = [t for m in NAMED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split()]
    words = [[w for w in re.split(r"[^a-z]+", CAMEL.sub(r"\1 \2", t).lower()) if w] for t in tokens]
    words = [w for w in words if w and w[0] not in STATES]
    own = any(all(x in CONTENT for x in w) for w in words)
    other = any(x in NAMES and not (x == "header" and w[0] in CONTENT) for w in words for x in w)
    return "".join(f".{'-'.join(w)}" for w in words[:3]), other and not own


def blocks(page: str) -> tuple[list[Block], list[Node], Paths]:
    """The blocks, the elements in the order in which they begin, and their paths."""
    out: list[Block] = []
    paths = Paths()
    root = Node("", None, 0, False, False, False, [0, 0, 0])
    node, nodes = root, [root]
    is_open: Counter[str] = Counter()
    parts: list[str] = []
    linked, links = 0, 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text and not node.excluded:
                # the unit: the nearest paragraph, heading, list, table or the like, or the container itself
                unit = node
                while unit.tag in PARTS and unit.parent is not None:
                    unit = unit.parent
                out.append(Block(node, unit, text, (len(text), len(PUNCTUATION.findall(text)), min(linked, len(text)))))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not node.excluded:
            text = html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text)

    def close(n: Node) -> None:
        """Closes an element and all in it."""
        nonlocal node
        while node is not n:
            is_open[node.tag] -= 1
            node = node.parent
        is_open[n.tag] -= 1
        node = n.parent

    def leave(tags: tuple[str, ...]) -> None:
        """Closes the nearest of the elements, or for parts of tables all of them, unless an element that holds its own is nearer."""
        n = node
        while n is not root and any(is_open[t] for t in tags):
            if n.tag in tags:
                close(n)
                if len(tags) <= 2:
                    return
                n = node
            elif n.tag in SCOPE:
                return
            else:
                n = n.parent

    at = 0
    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if m[1] else 1))
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        if m[1]:
            close_block()
            if is_open[tag]:
                n = node
                while n.tag != tag:
                    n = n.parent
                close(n)
            continue
        close_block()
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at) if not m[3].endswith("/") else None
            at = stop.end() if stop else at if m[3].endswith("/") else end
            continue
        if tag in VOID:
            continue
        if tag in UNITS or tag in SCOPE or tag in ("hr", "summary"):
            leave(("p",))
        if tag in CLOSES:
            leave(CLOSES[tag])
        inside = node.inside or tag in ("article", "main")
        classes, named = _names(m[3]) if m[3] and tag not in WHOLE else ("", False)
        node = Node(tag, node, paths.below(node.path, tag + classes), _excluded(tag, node), inside, named, [0, 0, 0])
        nodes.append(node)
        is_open[tag] += 1
        links = 0
    close_block()
    return out, nodes, paths


def _ratio(length: float, marks: float) -> float:
    return math.log1p(length * (1 + marks))


def content(page: str) -> tuple[list[Block], Paths]:
    """The blocks of the main text, in page order, and the page's paths."""
    every, nodes, paths = blocks(page)
    if not every:
        return [], paths
    runs: list[tuple[Node, list[int]]] = []
    for b in every:
        # a container's own text is a unit each time that other units break it off
        if not runs or runs[-1][0] is not b.unit:
            runs.append((b.unit, [0, 0, 0]))
        for k, x in enumerate(b.counts):
            b.node.held[k] += x
            runs[-1][1][k] += x
    for n in reversed(nodes[1:]):
        for k, x in enumerate(n.held):
            n.parent.held[k] += x
    size = nodes[0].held[0]
    # aggregate: by path
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for unit, own in runs:
        for k, x in enumerate((*own, 1)):
            sums[unit.path][k] += x
    ratio = {p: _ratio(s[0] / s[3], s[1] / s[3]) for p, s in sums.items()}
    # the prior: names, but not of elements with an article or most of the page; articles and main elements
    with_article: set[int] = set()
    for n in reversed(nodes[1:]):
        if id(n) in with_article or n.tag in ("article", "main") and not n.named and n.held[0]:
            with_article.add(id(n.parent))
    low, article, main, around = {id(nodes[0]): False}, {id(nodes[0]): False}, {id(nodes[0]): False}, {id(nodes[0]): 0.0}
    for n in nodes[1:]:
        up, me = id(n.parent), id(n)
        low[me] = low[up] or n.named and me not in with_article and 5 * n.held[0] < 4 * size
        article[me], main[me] = article[up] or n.tag == "article", main[up] or n.tag == "main"
        # fuse: what the containers add to what they hold
        around[me] = around[up]
        if n.tag not in PARTS and 0 < n.held[0] < size:
            around[me] = FADE * (_ratio(n.held[0], n.held[1]) * _apart(n.held) + around[up])
    plain = [b for b in every if not low[id(b.node)]]
    total = sum(b.counts[0] for b in plain)
    marked = next((kind for kind in (article, main) if 4 * (n := sum(b.counts[0] for b in plain if kind[id(b.node)])) >= total and n), None)

    def prior(n: Node) -> float:
        place = 1.0 if marked is None or marked[id(n)] else MAIN_PRIOR if main[id(n)] else OUTSIDE_PRIOR
        return place * (NAMED_PRIOR if low[id(n)] else 1.0)

    # smooth: on each side with the best of two units near it, which never lowers a ratio
    smooth: list[float] = []
    for i, (unit, _) in enumerate(runs):
        sides = [[FURTHER ** (abs(d) - 1) * ratio[runs[i + d][0].path] for d in side if 0 <= i + d < len(runs) and _near(runs[i + d][0], unit)] for side in ((-1, -2), (1, 2))]
        best = [max(side) for side in sides if side]
        smooth.append(max(ratio[unit.path], (ratio[unit.path] + BESIDE * sum(best)) / (1 + BESIDE * len(best))))
    scores, at, last = [], -1, None
    for b in every:
        if b.unit is not last:
            at, last = at + 1, b.unit
        up = around[id(b.unit.parent)] if b.unit.parent is not None else 0.0
        scores.append((smooth[at] + up) * _apart(sums[b.unit.path]) * prior(b.node))
    # threshold: paths by their mean
    cut = SHARE * sum(s * b.counts[0] for s, b in zip(scores, every)) / size
    means: dict[tuple[int, bool], list[float]] = defaultdict(list)
    for b, s in zip(every, scores):
        means[b.unit.path, low[id(b.node)]].append(s)
    good = {k for k, s in means.items() if 0 < sum(s) / len(s) >= cut}
    return [b for b in every if (b.unit.path, low[id(b.node)]) in good], paths


def _near(a: Node, b: Node) -> bool:
    """Whether two units are in the same container, or one's is around or inside the other's."""
    mine = [n for n in (a, a.parent, a.parent and a.parent.parent) if n is not None]
    return any(x is y for x in mine for y in (b, b.parent, b.parent and b.parent.parent))


def _apart(counts: list[int]) -> float:
    """1 where at most half of the text is linked, then falling to 0."""
    return min(1.0, 2 * (1 - counts[2] / counts[0]))


def extract(df: DataFrame, page: str = "html", text: str = "text", paths: str | None = "content_paths") -> DataFrame:
    """``df`` with the main text of each page, and the distinct paths it comes from."""
    fields = [T.StructField(text, T.StringType())] + ([T.StructField(paths, T.ArrayType(T.StringType()))] if paths else [])

    def start():
        def step(columns: list[pa.Array]) -> list[pa.Array]:
            found = [content(p.as_py() or "") for p in columns[0]]
            out = [pa.array([" ".join(b.text for b in f) for f, _ in found], pa.string())]
            return out + ([pa.array([list(map(tree.name, dict.fromkeys(b.node.path for b in f))) for f, tree in found], pa.list_(pa.string()))] if paths else [])

        return step

    return map_batches(df, [page], fields, start)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the main text of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), paths=None)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
