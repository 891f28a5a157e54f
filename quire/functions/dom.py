"""A small forgiving document tree on the standard library, and its rows.

What says that it is XHTML and is well-formed is read as XML. All else goes through one pass of
``html.parser``: void elements never hold children, and an opening tag
that cannot stand inside the open one (``p``, ``li``, ``dt``/``dd``, table parts, ``option``) closes
it first. Nothing is fetched and no entity is expanded beyond characters. On malformed markup the
tree is this builder's own; other parsers recover in other ways.
"""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from html.entities import html5 as NAMED
from html.parser import HTMLParser
from xml.parsers import expat

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Opening tag -> open tags it closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
#: What tells XHTML from HTML; names that XML itself knows; a declaration's encoding, void once text is decoded.
XHTML = re.compile(r"""<\?xml\s|xmlns\s*=\s*["']http://www\.w3\.org/1999/xhtml""")
XML_NAMES = frozenset({"amp", "lt", "gt", "quot", "apos"})
DECLARED = re.compile(r"^\s*<\?xml[^>]*\?>")
#: Tags past which implied closing does not look.
SCOPES = frozenset("ul ol dl table body html div section article td th".split())


class Node:
    """An element: tag, attributes, children (nodes and text in order)."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def elements(self) -> Iterator[Node]:
        """This element and all below, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def first(self, tag: str) -> Node | None:
        return next((n for n in self.elements() if n.tag == tag), None)

    def tokens(self, *names: str) -> set[str]:
        """Words of the named attributes, in lower case."""
        return {w for n in names for w in (self.attrs.get(n) or "").lower().split()}

    def drop(self, keep_children: bool = False) -> None:
        """Leave the parent; the text that follows stays."""
        if self.parent is not None:
            at = next(i for i, c in enumerate(self.parent.children) if c is self)
            inside = self.children if keep_children else []
            for c in inside:
                if isinstance(c, Node):
                    c.parent = self.parent
            self.parent.children[at : at + 1] = inside

    def replace(self, new: Node | str) -> None:
        at = next(i for i, c in enumerate(self.parent.children) if c is self)
        self.parent.children[at] = new
        if isinstance(new, Node):
            new.parent = self.parent


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = CLOSES.get(tag, set())
        if tag in BLOCKS:
            closes = closes | {"p"}
        for at in range(len(self.open) - 1, 0, -1) if closes else ():
            if self.open[at].tag in closes:
                del self.open[at:]
            elif self.open[at].tag in SCOPES:
                break
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        depth = len(self.open)
        self.handle_starttag(tag, attrs)
        if tag not in VOID and len(self.open) > 1 and self.open[-1].tag == tag and len(self.open) >= min(depth, 2):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(markup: str | bytes | None) -> Node:
    if isinstance(markup, (bytes, bytearray)):
        markup = bytes(markup).decode("utf-8", "replace")
    if markup and XHTML.search(markup):
        tree = parse_xml(markup)
        if tree is not None:
            return tree
    try:
        return built(markup or "")
    except AssertionError:  # the library gives up on some declarations; as text they harm nobody
        return built((markup or "").replace("<!", "&lt;!"))


def parse_xml(markup: str | bytes) -> Node | None:
    """The tree of well-formed XML, or null: local tag names, attributes as written. Named characters of
    HTML are known; entities that a document declares are refused, so nothing outside is ever read."""
    root = Node("#document")
    open_nodes = [root]
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(tag: str, attrs: dict) -> None:
        node = Node(tag.rpartition(":")[2], dict(attrs), open_nodes[-1])
        open_nodes[-1].children.append(node)
        open_nodes.append(node)

    def refused(*_: object) -> None:
        raise ValueError("entity declarations are refused")

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda tag: open_nodes.pop()
    parser.CharacterDataHandler = lambda data: open_nodes[-1].children.append(data)
    parser.EntityDeclHandler = refused
    if isinstance(markup, str):
        known = lambda m: m[0] if m[1] in XML_NAMES else NAMED.get(m[1] + ";", m[0])
        markup = DECLARED.sub("", re.sub(r"&([A-Za-z][A-Za-z0-9]*);", known, markup)).encode("utf-8", "replace")
    try:
        parser.Parse(markup, True)
    except (expat.ExpatError, ValueError, LookupError):
        return None
    return root


def built(markup: str) -> Node:
    builder = Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def unrolled(walk: Generator):
    """The result of a generator that yields generators it waits for, however deep they go."""
    stack, value = [walk], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


def body_of(root: Node) -> Node:
    return root.first("body") or root
