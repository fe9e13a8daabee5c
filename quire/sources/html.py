"""HTML reader: a lenient tree, then elements in reading order.

Implied end tags are handled for p, li, dt, dd, tr, td, th and option; void elements
have no content; formatting elements that are left open end with their block.  Text
that stands directly in a container isn't an element.  Old character references count
without their semicolon too, as in HTML, unless `bare` is off.
"""

from __future__ import annotations

import re
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from quire.schema import ITEM, PARAGRAPH, TITLE, element, table
from quire.sources.reader import read_elements

HIDDEN = frozenset("script style noscript template svg head nav iframe canvas form".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACED = frozenset("br td th li p div".split())
_BLOCKS = frozenset("p pre blockquote figcaption dd dt".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
_FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_HEADING = re.compile(r"h([1-6])\Z")
_GAP = re.compile(r"\s+")
_AMPERSAND = re.compile(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def _end(self, tags, fences=frozenset()) -> None:
        """Closes the innermost open element of `tags`, unless a fence lies inside it."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in fences:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._end({"p"}, {"table", "td", "th", "li", "button"})
        if tag in _CLOSES:
            for _ in range(3):
                before = len(self.open)
                self._end(_CLOSES[tag], _FENCES[tag])
                if len(self.open) == before:
                    break
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p"))
        elif tag not in _VOID:
            self._end({tag}, {"table"} if tag in ("p", "li") else frozenset())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _closed_only(source: str) -> str:
    """Ampersands that begin no reference closed by a semicolon, written as references."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), source)


def tree(source: str, bare: bool = True) -> Node:
    parser = _Tree()
    parser.feed(source if bare else _closed_only(source))
    parser.close()
    return parser.root


def _gather(node: Node, out: list[str], anchors: list[tuple[int, int, str]], spaced=_SPACED, stop=frozenset()) -> None:
    """Appends the node's text to `out`, and its anchors' ranges.  `spaced` None: a blank before every child.

    A stack instead of recursion: pages may be nested as deep as they like.
    """
    size = 0
    todo: list = [iter(node.children)]
    opened: list[tuple[int, str | None]] = [(0, None)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            start, href = opened.pop()
            if href:
                anchors.append((start, size, href))
        elif isinstance(child, str):
            out.append(child)
            size += len(child)
        elif child.tag not in HIDDEN and child.tag not in stop:
            if spaced is None or child.tag in spaced:
                out.append(" ")
                size += 1
            href = child.attrs.get("href") if child.tag == "a" else None
            todo.append(iter(child.children))
            opened.append((size, href if href and href.strip() else None))


def squeezed(raw: str, anchors: list[tuple[int, int, str]]) -> tuple[str, list[dict]]:
    """Single spaces and trimmed ends, the anchors' ranges carried along; ranges are sorted and disjoint."""
    text = _GAP.sub(" ", raw).strip()
    if not anchors:
        return text, []
    place, size, gap = [], 0, True  # where each raw character lands
    for ch in raw:
        if ch.isspace():
            place.append(size)
            gap = True
        else:
            if gap and size:
                size += 1
            gap = False
            place.append(size)
            size += 1
    links, floor = [], 0
    for start, end, uri in sorted(anchors, key=lambda a: (a[0], -a[1])):
        inside = [i for i in range(start, end) if not raw[i].isspace()]
        if inside and place[inside[0]] >= floor:
            floor = place[inside[-1]] + 1
            links.append({"uri": uri, "begin": place[inside[0]], "end": floor})
    return text, links


def text_of(node: Node, item: bool = False) -> tuple[str, list[dict]]:
    out: list[str] = []
    anchors: list[tuple[int, int, str]] = []
    if item:
        _gather(node, out, anchors, None, frozenset(("ul", "ol", "table")))
    else:
        _gather(node, out, anchors)
    return squeezed("".join(out), anchors)


def _rows(node: Node) -> list[Node]:
    found, todo = [], [iter(node.children)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif not isinstance(child, str) and child.tag != "table":
            if child.tag == "tr":
                found.append(child)
            else:
                todo.append(iter(child.children))
    return found


#: Browsers' bounds of colspan and rowspan.
MOST_SPAN = {"colspan": 1_000, "rowspan": 65_534}


def _span(node: Node, name: str) -> int:
    value = (node.attrs.get(name) or "").strip()
    return min(max(int(value), 1), MOST_SPAN[name]) if re.fullmatch(r"\+?[0-9]{1,9}", value) else 1


def table_of(node: Node) -> dict | None:
    """A table laid out with its spans; rows of th alone at its head are header rows."""
    rows, header, body = [], 0, False
    for tr in _rows(node):
        cells = [c for c in tr.children if not isinstance(c, str) and c.tag in ("td", "th")]
        if not cells:
            continue
        body = body or any(c.tag == "td" for c in cells)
        header += not body
        rows.append([(text_of(c)[0], _span(c, "colspan"), _span(c, "rowspan")) for c in cells])
    if not rows:
        return None
    height, width = len(rows), max(1, *(sum(c[1] for c in r) for r in rows))
    grid = [[""] * width for _ in rows]
    taken, down, left = ([False] * (height * width) for _ in range(3))
    for r, cells in enumerate(rows):
        at = 0
        for text, across, deep in cells:
            while at < width and taken[r * width + at]:
                at += 1
            if at >= width:
                break
            grid[r][at] = text
            across, deep = min(across, width - at), min(deep, height - r)
            for i in range(deep):
                for j in range(across):
                    spot = (r + i) * width + at + j
                    taken[spot] = True
                    left[spot], down[spot] = left[spot] or j > 0, down[spot] or i > 0
            at += across
    return table(grid, header, down, left)


def _walk(root: Node, out: list[dict]) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        tag = node.tag
        if tag in HIDDEN:
            continue
        if tag == "table":
            found = table_of(node)
            out += [found] if found else []
            continue
        heading = _HEADING.match(tag)
        if heading or tag in _BLOCKS:
            text, links = text_of(node)
            if text:
                out.append(element(TITLE, text, int(heading[1]), links) if heading else element(PARAGRAPH, text, None, links))
            continue
        if tag == "li":
            text, links = text_of(node, item=True)
            if text:
                out.append(element(ITEM, text, None, links))
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and (tag != "li" or c.tag in ("ul", "ol", "table"))]


def parse(source: str, bare: bool = True) -> list[dict]:
    out: list[dict] = []
    _walk(tree(source, bare), out)
    return out


def read_html(pages: DataFrame, html: str = "html", doc_id: str = "page_id", keep_empty: bool = False, bare: bool = True) -> DataFrame:
    """`bare`: whether references without a semicolon, such as `&amp` before a tag, are resolved."""
    return read_elements(pages, html, doc_id, partial(parse, bare=bare), "html", keep_empty=keep_empty)
