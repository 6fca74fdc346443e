"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to the elements above them,
less with each level; points are discounted by the share of text inside links.
The best container and those of its siblings that read like text are kept.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are taken out of the tree before; so is a headline inside a ``header`` of the
article. A class, id or role that names such a thing marks an element; a marked
element stays where it holds nearly all the text that reads like an article,
and its name is passed over where it only tells of a thing that is (not) there.
Time grows with the length of a page, however deep its elements are nested.
"""

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*$)"
    r"|<!\[CDATA\[(?P<cdata>.*?)\]\]>"
    r"|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
# A tag that the end of the page cuts off.
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Never text of the article.
_DROP = frozenset(
    "script style noscript template nav header footer aside form button select textarea input iframe object "
    "embed svg canvas dialog menu head title map applet audio video fieldset datalist".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
_PARAGRAPH = frozenset("p pre td li dd blockquote figcaption".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag ends an open element of these kinds.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NOT_INLINE = _BLOCK - {"option"}
# Words in class, id or role that mark what is not the article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar side aside complementary widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs toc "
    "footer foot contentinfo header masthead topbar toolbar comment comments disqus respond replies reply social "
    "share sharing related recommended recommendations pagination pager skip search dialog hidden".split()
)
# Marks of what readers wrote, which may be longer than the article.
_READERS = frozenset("comment comments disqus respond replies reply".split())
# A name with one of these words tells of a thing that is there or is not: has-sidebar, ad-free, comments-open.
_TELLING = frozenset("no not non without with has free enabled disabled by on off open closed".split())
_PROTECTED = frozenset("html body main".split())
# Elements whose links alone are no text of the article.
_LISTS = frozenset("ul ol menu dl table div section".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
# A sibling stays with this share of the best score, or as a paragraph of this length.
SIBLING_SHARE, SIBLING_LENGTH, LINK_LIMIT = 0.2, 80, 0.25
# A marked element stays with this many characters, if all unmarked paragraphs have less than this share of them.
STAYS_LENGTH, STAYS_SHARE = 400, 0.25
# Inside a named container, lists with this share of text in two links or more are left out.
LIST_LINKS = 0.9
# Elements above a paragraph that get points of it.
LEVELS = 32


@dataclass
class Node:
    tag: str
    parent: "Node | None" = None
    children: list = field(default_factory=list)
    drop: bool = False
    marks: frozenset = frozenset()
    score: float = 0.0
    scored: bool = False
    text: int = 0
    linked: int = 0
    links: int = 0
    commas: int = 0


def _unwanted(tag: str, attrs: str) -> tuple[bool, frozenset]:
    """Whether an element goes whatever it holds, and the marks in its names."""
    if tag in _DROP:
        return True, frozenset()
    marks: set[str] = set()
    if not attrs or tag in _PROTECTED:
        return False, frozenset()
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, frozenset()
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, frozenset()
        if name in ("class", "id", "role"):
            names = value.split()
            if tag == "article":
                # An article may be named after what it has; a comment is one.
                names = names[:1]
            for part in names:
                words = _SPLIT.split(_CAMEL.sub("-", part).lower())
                if _TELLING.isdisjoint(words):
                    marks.update(_MARKS.intersection(words[:1] if tag == "article" else words))
    return False, frozenset(marks)


def parse(source: str) -> Node:
    """Element tree of a page; missing and wrong end tags are put up with."""
    root = Node("html")
    # Open elements, the places of those of each tag, and of those that are not inline.
    opened, places, blocks = [root], defaultdict(list, html=[0]), [0]

    def end_from(place: int) -> None:
        while len(opened) > place:
            places[opened.pop().tag].pop()
        while blocks[-1] >= place:
            blocks.pop()

    at, end = 0, len(source)
    while at < end:
        match = _TOKEN.search(source, at)
        if match is None:
            opened[-1].children.append(_CUT_OFF.sub("", source[at:]))
            break
        if match.start() > at:
            opened[-1].children.append(source[at : match.start()])
        at = match.end()
        if match["cdata"] is not None:
            opened[-1].children.append(html.escape(match["cdata"]))
        tag = match["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["close"]:
            if places[tag] and tag != "html":
                end_from(places[tag][-1])
            continue
        if tag in _RAW:
            finish = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = finish.end() if finish else end
            continue
        if tag in ("html", "body") and places[tag]:
            continue
        if tag in _NOT_INLINE and opened[blocks[-1]].tag == "p":
            # A block ends an open paragraph.
            end_from(blocks[-1])
        if tag in _ENDS:
            ended, scope = _ENDS[tag]
            inner = max((places[t][-1] for t in scope if places[t]), default=-1)
            # The outermost of the kind inside the innermost scope.
            found = [p[i] for p in map(places.__getitem__, ended) if (i := bisect_right(p, inner)) < len(p)]
            if found:
                end_from(min(found))
        drop, marks = _unwanted(tag, match["attrs"])
        new = Node(tag, opened[-1], drop=drop, marks=marks)
        opened[-1].children.append(new)
        if tag not in _VOID and not match["attrs"].rstrip().endswith("/") or tag in _BLOCK and tag != "hr":
            if tag in _NOT_INLINE:
                blocks.append(len(opened))
            places[tag].append(len(opened))
            opened.append(new)
    return root


def _up(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _walk(root: Node):
    """Nodes in page order without what is dropped."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.drop)


def _measure(order: list[Node]) -> None:
    """Lengths of text and of linked text, links and commas below every node."""
    for node in order:
        strings = [c for c in node.children if isinstance(c, str)]
        node.text = sum(len(" ".join(c.split())) for c in strings)
        node.commas = sum(c.count(",") for c in strings)
        node.linked = node.links = 0
    for node in reversed(order):
        if node.tag == "a":
            node.linked, node.links = node.text, 1
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked
            node.parent.links += node.links
            node.parent.commas += node.commas


def _drop_marked(order: list[Node]) -> None:
    """Drop marked elements, but for those that hold what reads like the article.

    One stays if it has ``STAYS_LENGTH`` characters or a headline, article or main of its
    own, few links, and if the paragraphs outside all marked elements are short beside it;
    one that is named after readers' comments only with a headline or main.
    """
    if not any(node.marks for node in order):
        return
    _measure(order)
    outside, below, titled = 0, set(), {}
    for node in order:
        if node.marks or id(node.parent) in below:
            below.add(id(node))
        elif _is_paragraph(node) and id(node.parent) not in below:
            outside += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
    for node in reversed(order):
        held = titled.get(id(node), 0)
        own = 2 if node.tag in ("h1", "main") else 1 if node.tag == "article" and not node.marks else 0
        if node.parent is not None:
            above = id(node.parent)
            titled[above] = max(titled.get(above, 0), held, own)
    for node in order:
        if node.marks:
            held = titled.get(id(node), 0)
            if node.tag == "article":
                held = max(held, 1)
            long = node.text >= STAYS_LENGTH or held
            reads = held == 2 if node.marks & _READERS else long
            stays = reads and _links(node) < LINK_LIMIT and outside < STAYS_SHARE * node.text
            node.drop = not stays


def _links(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _is_paragraph(node: Node) -> bool:
    return node.tag in _PARAGRAPH or node.tag == "div" and not any(
        isinstance(c, Node) and c.tag in _BLOCK for c in node.children
    )


def _best(order: list[Node]) -> Node | None:
    """The container with most points."""
    for node in order:
        if not node.text or node.parent is None or not _is_paragraph(node):
            continue
        points = (1.0 + node.commas + min(node.text / 100.0, 3.0)) * (1.0 - _links(node))
        above, level = node.parent, 0
        while above is not None and level < LEVELS:
            above.score += points / (1.0, 2.0)[level] if level < 2 else points / (3.0 * level)
            above.scored = True
            above, level = above.parent, level + 1
    best = None
    for node in order:
        if node.scored and (best is None or node.score * (1 - _links(node)) > best.score * (1 - _links(best))):
            best = node
    return best


def _texts(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space as one space, none empty."""
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    for top in nodes:
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                held.append(html.unescape(item))
            elif not item.drop:
                if item.tag in ("br", "hr", "wbr", "img"):
                    held.append("" if item.tag == "wbr" else " ")
                if item.tag in _BLOCK:
                    close()
                    stack.append(None)
                stack.extend(reversed(item.children))
        close()
    return blocks


def main_text(source: str | None) -> str:
    """The article of a page; empty for NULL, empty and textless pages."""
    if not source:
        return ""
    root = parse(source)
    _drop_marked(list(_walk(root)))
    order = list(_walk(root))
    _measure(order)
    best = _best(order)
    if best is None:
        # No paragraph at all: whatever text is left.
        best = next((n for n in order if n.tag in ("article", "main")), root)
    named = next((n for n in _up(best) if n.tag in ("article", "main")), None)
    if named is not None and named is not best:
        # Link density counts inside a named container too: its lists of links go.
        for node in _walk(named):
            if node.tag in _LISTS and node.links >= 2 and _links(node) >= LIST_LINKS:
                node.drop = True
    best = named or best
    kept = [best]
    if best.parent is not None:
        limit = max(10.0, SIBLING_SHARE * best.score)
        kept = []
        for other in best.parent.children:
            if not isinstance(other, Node) or other.drop:
                continue
            reads = other.tag in _HEADING or other.tag == "p" and other.text >= SIBLING_LENGTH
            text = other.scored and other.score * (1 - _links(other)) >= limit
            if other is best or (reads or text) and other.text and _links(other) < LINK_LIMIT:
                kept.append(other)
    return "\n".join(_texts(kept))


def extracted(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, in one pass without a shuffle.

    NULL and empty pages have an empty text; repeated rows are read each; an empty
    table gives no rows.
    """

    @F.arrow_udf("string")
    def text_of(sources: pa.Array) -> pa.Array:
        return pa.array([main_text(s.as_py()) for s in sources], pa.string())

    return pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"), F.col("url"), text_of(F.col(f"`{source}`")).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))
