"""Main text of web pages by composite text density (operator 6).

Every DOM node has characters C and tags T below it, and among them link characters LC and link tags
LT. Its composite density is C/T times a logarithm of C/LC * T/LT whose base grows with the share
of link text, so menus fall to zero. A node's density sum adds up its children's densities. The node
with the largest sum marks the article; the smallest density on its path from the body is the
threshold. The subtree to keep is the article or main element around that node or else grows from it to an ancestor whose
other children are as dense as the threshold and hold a good part of the text, or look the same.

What HTML itself sets apart (scripts, forms, nav, footer and the like) counts nothing. Names given by a class, id or
role don't bear on densities. They only keep a block such as reader comments from being taken for the
article, and leave out such blocks within it; where that would leave nothing of a page, a block that holds most of it stays, whatever its name. In a
subtree other than an article or main element, blocks that are mostly links are left out as well where they lie before or after all of the
body text, but for those under a heading such as References at the end.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, rows, table

# Tags by the part they play in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head script style noscript template nav footer aside button select option input textarea iframe object embed svg canvas dialog menu audio video map".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("html body table ul ol dl div section article main td th select blockquote".split())
INLINE_REOPENED = frozenset("a b strong i em u s small big code font tt span".split())
# Words in class, id or role that name what isn't the article, and words for states and for parts.
AROUND = frozenset("ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar comment comments reply replies disqus respond cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager contentinfo complementary search".split())
STATES = frozenset("has with without no is in show hide".split())
PARTS = frozenset("area bar block body box button buttons container content form group inner item items link links list main panel row section slot text thread title unit wrap wrapper".split())

# Words in a heading over the sources of an article, which are part of it though they are links.
SOURCES = frozenset("bibliography bibliografía bibliographie citations fuentes fußnoten footnotes literatur literature literaturverzeichnis notes quellen quellenangaben references referencias références reading sources".split())

_ATTRIBUTES = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)*+)"
_TOKEN = re.compile(r"([^<]+)|<(/?)([A-Za-z][^\s/>]*+)(?:>|" + _ATTRIBUTES + r"(?:>|\Z))|<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|(<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*)))?")
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
_NO_DISPLAY = re.compile(r"display\s*:\s*none")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_SOURCE_WORD = re.compile(r"\w+")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "never", "named", "look", "out")

    def __init__(self, tag: str, parent: Node | None, never: bool = False, named: bool = False, look: str = ""):
        self.tag, self.parent, self.never, self.named, self.look, self.out = tag, parent, never, named, look, False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _names_furniture(name: str) -> bool:
    """Whether one name, such as ``site-header`` or ``comment-list``, means what isn't the article; ``has-sidebar`` and ``share-enabled`` don't."""
    words = _NAME.findall(name)
    words = [w for w in words if not w.isdigit()]
    if not words or words[0] in STATES:
        return False
    return words[-1] in AROUND or words[0] in AROUND and words[-1] in PARTS


def _attributes(tag: str, text: str) -> tuple[bool, bool, str]:
    """Whether an element is hidden, whether its class, id or role names furniture, and its class."""
    hidden = named = False
    look = ""
    for m in _ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _NO_DISPLAY.search(value):
            hidden = True
        elif name in ("class", "id", "role"):
            named = named or any(map(_names_furniture, value.split()))
            look = value if name == "class" else look
    return hidden, named and tag not in ("html", "body", "article", "main"), look


def _is_never(node: Node) -> bool:
    """A form of the size of the page is judged later; a header in an article belongs to it, any other is the page's."""
    if node.tag != "header":
        return node.tag in NEVER
    at = node.parent
    while at is not None and at.tag not in ("article", "main"):
        at = at.parent
    return at is None or at.tag == "main"


def parse(page: str) -> Node:
    """A tree of the whole page. Unclosed and stray tags are repaired as far as blocks need it."""
    root = Node("#root", None)
    at, depth_of = root, {}
    position, size = 0, len(page)
    while position < size:
        m = _TOKEN.match(page, position)
        position = m.end()
        text, closing, tag, attributes, lone = m.groups()
        if text or lone:
            at.children.append(html.unescape(text) if text else lone)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag in VOID and tag != "br":
                continue
            if depth_of.get(tag):
                while at.tag != tag:
                    depth_of[at.tag] -= 1
                    at = at.parent
                depth_of[tag] -= 1
                at = at.parent
            continue
        if tag in VOID:
            at.children.append(Node(tag, at))
            continue
        if tag in RAW:
            end = close.start() if (close := _RAW_END[tag].search(page, position)) else -1
            position = size if end < 0 else end
            at.children.append(Node(tag, at, True))
            if end >= 0:
                position = m.end() if (m := _TOKEN.match(page, end)) else size
            continue
        if tag in BLOCK:
            at = _close(at, {"p"}, depth_of)
        if tag in CLOSES:
            at = _close(at, CLOSES[tag], depth_of)
        hidden, named, look = _attributes(tag, attributes) if attributes and _TELLING.search(attributes) else (False, False, "")
        node = Node(tag, at, hidden, named or tag == "form", look)
        node.never = hidden or _is_never(node)
        at.children.append(node)
        depth_of[tag] = depth_of.get(tag, 0) + 1
        at = node
    return root


def _close(at: Node, tags: set[str], depth_of: dict[str, int]) -> Node:
    """Close the nearest open element of ``tags``, unless a container lies between."""
    if not any(depth_of.get(t) for t in tags):
        return at
    node = at
    while node.tag not in tags:
        if node.tag in SCOPE or node.parent is None:
            return at
        node = node.parent
    while at is not node.parent:
        depth_of[at.tag] -= 1
        at = at.parent
    # A list item can hold an open paragraph, a row an open cell: close those as well.
    return _close(at, tags, depth_of)


def measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes, children first. What HTML sets apart counts nothing."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.never:
            continue
        order.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    order.reverse()
    for node in order:
        link = node.tag == "a"
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            elif not c.never:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if link:
            node.link_chars = node.chars
    body_chars, body_links = max(1, root.chars), root.link_chars
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, body_links / body_chars)
        # Text that stands directly in a node counts as a child of its own.
        own = sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        node.total = own + sum(x.density for x in node.children if not isinstance(x, str) and not x.never)
    return order


def density(c: int, t: int, lc: int, lt: int, links_of_body: float) -> float:
    """Composite text density of c characters and t tags, lc and lt of them in links; no tag, link or link tag counts as one."""
    if not c:
        return 0.0
    t = max(1, t)
    inside = c / max(1, lc) * t / max(1, lt)
    base = math.log(c / max(1, c - lc) * lc + links_of_body * c + math.e)
    return c / t * max(0.0, math.log(inside) / (math.log(base) if base > 1 else 1.0))


def _wraps(node: Node, root: Node, bare: bool = False) -> bool:
    """Whether an element is the frame of the page whatever its name: it holds most of the text that is no link, and the title or the main element, which a ``bare`` frame need not, nor a form of paragraphs."""
    if 2 * (node.chars - node.link_chars) <= root.chars - root.link_chars:
        return False
    if bare:
        return True
    stack, prose = [node], 0
    while stack:
        at = stack.pop()
        if at.tag in ("h1", "main", "article") and not (at is node or at.named):
            return True
        if at.tag == "p" and node.tag == "form":
            prose += at.chars - at.link_chars
            if 2 * prose > node.chars - node.link_chars:
                return True
            continue
        stack += [c for c in at.children if not isinstance(c, str) and not c.never]
    return False


#: An ancestor is kept for its other dense children if they have this share of the text kept so far, or look like what is kept: the same class, or both sections or paragraphs.
SHARE = 0.2
ALIKE = frozenset("section p li dd tr blockquote pre".split())  # look the same without a class


def article(root: Node) -> tuple[Node, Node | None]:
    """The subtree to keep, and the title if the page has a single one and it stands before that.

    Where names leave no text at all, they are mistaken: then a named block with most of the text is the frame of the page, or else no name counts.
    """
    order = measure(root)
    if not root.chars:
        return root, None
    frames = [lambda n: _wraps(n, root), lambda n: _wraps(n, root, bare=True), lambda n: True]
    if not any(_leave_out(order, f, links=False) for f in frames):
        # A page of nothing but links.
        any(_leave_out(order, f, links=True) for f in frames)
    best = max((n for n in order if (n.tag in BLOCK or n is root) and not n.out), key=lambda n: n.total)
    path = [best]
    while path[-1].parent is not None and path[-1].tag != "body":
        path.append(path[-1].parent)
    threshold, keep = min(n.density for n in path), best
    for node, child in zip(path, [None, *path]):
        if node.tag in ("article", "main"):
            return node, _title(order, node)
        others = [x for x in node.children if child and not isinstance(x, str) and x is not child and not x.never and not x.out and 2 * x.link_chars < x.chars]
        if sum(x.chars for x in others if x.density >= threshold) >= SHARE * keep.chars or any((x.tag, x.look) == (child.tag, child.look) and (x.look or x.tag in ALIKE) for x in others):
            keep = node
    return keep, _title(order, keep)


def _leave_out(order: list[Node], framed: Callable[[Node], bool], links: bool) -> bool:
    """Mark as out the named blocks that aren't frames, and what is in them; whether text is left, other than ``links`` if these don't count."""
    left, linked = False, set()
    for node in reversed(order):  # parents first
        node.out = node.parent is not None and node.parent.out or node.named and not framed(node)
        if not links and (node.tag == "a" or id(node.parent) in linked):
            linked.add(id(node))
        elif not node.out:
            left = left or any(isinstance(c, str) and c.strip() for c in node.children)
    return left


def _title(order: list[Node], keep: Node) -> Node | None:
    titles = [n for n in order if n.tag == "h1" and not n.out and n.chars]
    if len(titles) != 1:
        return None
    at = titles[0]
    while at is not None and at is not keep:
        at = at.parent
    # ``order`` is in page order, children first.
    return titles[0] if at is None and order.index(titles[0]) < order.index(keep) else None


def blocks_of(top: Node) -> list[str]:
    """The texts of the blocks in page order; inline elements run on, a line break is white space."""
    out, run = [], []
    # Of each block: its text, whether it is among links, and whether it is a heading.
    within = {"links": 0, "heading": 0}  # how many open elements are mostly links, or headings

    def kind(node: Node) -> str | None:
        if node is not top and node.tag in ("ul", "div", "section", "table", "dl") and node.chars and 2 * node.link_chars > node.chars:
            return "links"
        return "heading" if node.tag in HEADINGS else None

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append((text, within["links"] > 0, within["heading"] > 0))

    stack: list[tuple[Node | str, bool]] = [(top, False)]
    while stack:
        node, done = stack.pop()
        if isinstance(node, str):
            run.append(node)
        elif done:
            flush()
            if kind(node):
                within[kind(node)] -= 1
        elif (node.never or node.out) and node is not top:
            continue
        elif node.tag == "br":
            run.append(" ")
        else:
            if node.tag in BLOCK:
                flush()
                stack.append((node, True))
                if kind(node):
                    within[kind(node)] += 1
            stack += [(c, False) for c in reversed(node.children)]
    flush()
    body = [i for i, (_, links, heading) in enumerate(out) if not links and not heading]
    first, last = (body[0], body[-1]) if body else (len(out), -1)
    inside, sources, kept = top.tag in ("article", "main"), False, []
    for i, (text, links, heading) in enumerate(out):
        if heading or not links:
            sources = heading and not SOURCES.isdisjoint(_SOURCE_WORD.findall(text.lower()))
        if not links or inside or first < i < last or sources and i > last:
            kept.append(text)
    return kept


def main_text(page: str | None) -> str:
    """Blocks joined by a line feed; empty for a null or empty page, or one without text."""
    if not page:
        return ""
    keep, title = article(parse(page))
    return "\n".join([*(blocks_of(title) if title else []), *blocks_of(keep)])


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars.

    A null html counts as empty and gives an empty text. Repeated rows get the same answer; an empty
    table gives no rows; other columns are ignored. Nothing is cut off, however long the page.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows(batches):
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                yield page_id, url, main_text(page)

    found = map_rows(pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")), run, "page_id long, url string, text string", schema)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars; see ``extract``."""
    return extract(table(spark, sf_dir, "pages"))
