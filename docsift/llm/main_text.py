"""Main text of web pages, by scoring the tree of block elements."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML and words that name page furniture.
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul button svg math template object audio video canvas".split()
)
FURNITURE = frozenset(
    "aside button canvas audio video dialog footer form head menu math nav object optgroup option search select svg template fieldset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice|notices|notification\w*|alert|"
    r"nav|navbar|navigation|menu\w*|submenu|breadcrumb\w*|sidebar\w*|rail|footer\w*|foot|header|masthead|topbar|toolbar|"
    r"comment\w*|disqus|respond|reply|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|"
    r"signup|login|popup|modal|overlay|widget\w*|pagination|pager|paywall|tags|byline-links|skip)(?=$|[\s_-])",
    re.I,
)
#: Words beside a hint that leave a name one of furniture; any other ('no-sidebar', 'related-work') makes it weak.
BESIDE = frozenset(
    "area bar block body bottom box btn button buttons center column container content desktop entry float form global group icon icons inner "
    "inline item items left link links list main mobile more outer page panel post posts primary right row secondary section site slot text "
    "thread title top unit wrap wrapper zone".split()
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|commentform|disqus|respond|reply|replies)(?=$|[\s_-])", re.I)
WEAK, SURE, OF_READERS = 1, 2, 3  # how surely a name is one of furniture; comments are prose, so only their name tells
OF_MAIN, OF_ARTICLE = 1, 2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names are left aside where less text than the first is kept and more than the second is lost by them.
LITTLE, MUCH = 200, 500
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What an open element of the key is closed by when one of the values begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table menu dir article section main body div".split())
PARAGRAPHS = frozenset("p pre td li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:@][^\s=/>]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "hinted", "semantic", "score", "chars", "link_chars", "links")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []  # children: nodes and texts, in page order
        self.dropped = False
        self.hinted = self.semantic = 0
        self.score = 0.0
        self.chars = self.link_chars = self.links = 0


@lru_cache(1 << 16)
def _hint(name: str) -> int:
    """How surely one class or id names furniture; 0 if no word of it does."""
    if HINTS.search(name) is None:
        return 0
    beside = [w for w in re.split(r"[\s_-]+", HINTS.sub(" ", name).lower()) if w and not w[0].isdigit()]
    if not BESIDE.issuperset(beside):
        return WEAK
    return OF_READERS if COMMENTS.search(name) else SURE


def _marks(node: Node, attrs: str, inside: bool) -> None:
    """Set whether the element is furniture for certain (dropped) or by its name (hinted)."""
    tag = node.tag
    node.semantic = OF_ARTICLE if tag == "article" else OF_MAIN if tag == "main" else 0
    node.dropped = tag in FURNITURE or (tag == "header" and not inside)
    if not attrs or tag in ("html", "body"):
        return
    names = []
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names += [(key, name) for name in value.split()]
        elif key == "role":
            node.dropped |= value.strip().lower() in ROLES and not (value.strip().lower() == "banner" and inside)
            node.semantic = max(node.semantic, {"main": OF_MAIN, "article": OF_ARTICLE}.get(value.strip().lower(), 0))
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
            node.dropped = True
    if tag == "article" and any(_hint(name) == OF_READERS for _, name in names):
        up = node.parent
        while up is not None and up.hinted != OF_READERS:
            up = up.parent
        node.semantic *= up is None  # one comment in a list of them
    if node.semantic or tag in HEADINGS:
        return
    for key, name in names:
        if inside:
            name = re.sub(r"(?i)(?:^|(?<=[\s_-]))header(?=$|[\s_-])", "", name)
        hint = _hint(name)
        if hint == SURE and inside and key == "id" and tag not in ("div", "ul", "ol"):
            hint = WEAK  # the id is that of a section to link to
        node.hinted = max(node.hinted, hint)


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree of block elements, and the blocks of text: (element, text, characters in links)."""
    root = node = Node("html", None)
    blocks: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = 0
    link: Node | None = None
    inside = 0  # open article and main elements

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append((node, text, min(linked, len(text))))
        linked = 0

    def close(until: Node) -> None:
        nonlocal node, link, inside
        while node is not until:
            inside -= node.semantic
            if link is node:
                link = None
            node = node.parent

    at = 0
    find = _TOKEN.search
    while at < len(page):
        m = find(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if link is not None:
                linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, ends = tag.lower(), m["end"] or m["end2"]
        if tag == "br" or tag == "hr":
            parts.append(" ")
        elif tag == "a":
            link = None if ends else node
            if not ends:
                node.links += 1
        elif tag in RAW and not ends:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif tag in BLOCKS:
            flush()
            if ends:
                open_ = node
                while open_ is not root and open_.tag != tag:
                    open_ = open_.parent
                if open_ is not root:
                    close(open_.parent)
                continue
            if tag not in ("html", "body"):
                open_ = node
                while open_ is not root and open_.tag not in SCOPE:
                    if open_.tag == "p" or tag in CLOSES.get(open_.tag, ()):
                        close(open_.parent)
                        break
                    open_ = open_.parent
            child = Node(tag, node)
            _marks(child, m["attrs"] or m["attrs2"] or "", inside > 0)
            node.children.append(child)
            inside += child.semantic
            node = child
    flush()
    return root, blocks


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by blank lines; empty if there is none."""
    if not page:
        return ""
    root, blocks = parse(page)
    order = [root]
    for n in order:
        order += n.children
    holds = set()  # elements with an article or main element below
    for n in order:
        if n.semantic:
            p = n.parent
            while p is not None and id(p) not in holds:
                holds.add(id(p))
                p = p.parent
    for n in order:
        n.dropped = n.dropped or (n.parent is not None and n.parent.dropped)
    kept = [b for b in blocks if not b[0].dropped]
    if any(n.hinted for n in order):
        kept = _without_named(order, kept, holds)
    _count(order, kept)
    for n in reversed(order):
        if n.parent is not None and not n.dropped:
            n.parent.links += n.links
    menus = {id(n) for n in order if n.tag in ("ul", "ol", "dl", "div", "table") and n.links >= 3 and n.link_chars > 0.6 * n.chars}
    kept = [b for b in kept if not _under(b[0], menus)]
    if not kept:
        return ""
    for n, text, _ in kept:
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        up, share = (n.parent if n.tag in PARAGRAPHS and n.parent is not None else n), 1.0
        while up is not None:
            up.score += points * share
            share = share / 2 if share == 1.0 else share * 2 / 3
            up = up.parent
    for n in order:
        if n.score:
            bonus = 1.5 if n.semantic else 0.5 if n.tag in ("ul", "ol", "form", "table") else 1.0
            if n.hinted and id(n) not in holds and 2 * n.chars < root.chars:
                bonus /= 2
            n.score *= bonus * (1 - n.link_chars / max(1, n.chars))
    best = max(order, key=lambda n: n.score)
    if best.score <= 0:
        return "\n\n".join(text for _, text, _ in kept)
    whole = _container(best, root)
    take = {id(whole)}
    if whole.parent is not None:
        for n in whole.parent.children:
            density = n.link_chars / max(1, n.chars)
            wide = n.tag in PARAGRAPHS and n.chars >= 80 and density < 0.25
            title = n.tag in ("h1", "h2", "hgroup", "header") and density < 0.25
            if not n.dropped and (n.score >= max(10, 0.2 * best.score) or wide or title):
                take.add(id(n))
    parent = whole.parent
    return "\n\n".join(text for n, text, _ in kept if _under(n, take) or (n is parent and len(text) >= 80))


def _container(best: Node, root: Node) -> Node:
    """The element to take whole: the outermost article around best, else its main element.

    Without either, the outermost element of few links around it below the one that lays out
    the page, which is the body or has a header, footer or navigation of its own.
    """
    found = main = None
    n: Node | None = best
    while n is not None:
        if n.semantic:
            if n.semantic == OF_MAIN:
                main = main or n
            else:
                found = n
        n = n.parent
    if found or main:
        return found or main
    n = best
    while n.parent is not None and n.parent is not root and n.parent.tag not in ("html", "body"):
        up = n.parent
        if up.link_chars >= 0.25 * up.chars or any(c.dropped and c.tag in ("header", "footer", "nav") for c in up.children):
            break
        n = up
    return n


def _count(order: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Set each element's characters, and those in links, to what blocks hold in it and below."""
    for n in order:
        n.chars = n.link_chars = 0
    for n, text, linked in blocks:
        n.chars += len(text)
        n.link_chars += linked
    for n in reversed(order):
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.link_chars += n.link_chars


def _without_named(order: list[Node], blocks: list[tuple[Node, str, int]], holds: set[int]) -> list[tuple[Node, str, int]]:
    """The blocks outside furniture by name, whose elements are marked as dropped.

    An element with an article or main element below, or with most of the page's text, wraps
    the page whatever its name; a weak name needs text that is mostly links. If little is
    left so and much is lost, only comments are furniture.
    """
    _count(order, blocks)
    readers: set[int] = set()
    for n in order:
        if (n.hinted == OF_READERS and id(n) not in holds) or id(n.parent) in readers:
            readers.add(id(n))
    rest = [b for b in blocks if id(b[0]) not in readers]
    most = sum(len(text) for _, text, _ in rest) / 2
    named = set(readers)
    for n in order:
        if id(n.parent) in named:
            named.add(id(n))
        elif n.hinted and id(n) not in holds:
            links = n.link_chars > 0.5 * n.chars
            if links or (n.hinted == SURE and (n.chars <= most or n.chars < MUCH)):
                named.add(id(n))
    kept = [b for b in rest if id(b[0]) not in named]
    left = sum(len(text) for _, text, _ in kept)
    if left < LITTLE and 2 * most - left > MUCH:
        kept, named = rest, readers
    for n in order:
        n.dropped |= id(n) in named
    return kept


def _under(n: Node | None, marked: set[int]) -> bool:
    while n is not None:
        if id(n) in marked:
            return True
        n = n.parent
    return False


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) per page.

    Block elements form a tree; each paragraph passes points for its length and commas to
    its ancestors, less with distance; an element's points are discounted by the share of its
    text in links. The article around the best element, and content-like siblings of it, are
    kept whole but for menus, headers, footers, sidebars, notices, adverts, forms, scripts and
    comments. Names (class, id) tell furniture only where the text doesn't speak against it. A
    null or empty page, or one of furniture alone, gives an empty text; broken markup is closed as
    browsers do; repeated rows are extracted each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [main_text(x) for x in some.column("html").to_pylist()]
                yield pa.record_batch(
                    [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
