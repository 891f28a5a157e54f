"""Sanitising, table and note rules on document trees."""

from __future__ import annotations

import html
import re

from .dom import VOID, Node

# Tags and attributes the sanitiser knows.
RICH_TAGS = frozenset({"math", "ruby", "rb", "rt", "rp", "bdi", "bdo"})
UNSAFE_TAGS = frozenset({"script", "iframe", "object", "embed", "form", "base", "applet", "portal", "svg"})
ACTIVE_TAGS = frozenset({"script", "iframe", "object", "embed", "form"})
URL_ATTRIBUTES = frozenset({"href", "src", "action", "formaction", "xlink:href", "poster", "cite", "background"})
SAFE_SCHEMES = frozenset({"", "http", "https", "mailto"})
SAFE_DIRECTIONS = frozenset({"ltr", "rtl", "auto"})
# What a table cell may and may not hold.
CELL_BLOCKS = frozenset({
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
})
CELL_INLINE = frozenset({
    "a", "abbr", "b", "br", "cite", "code", "del", "em", "i", "ins", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var",
})
CAPTION_CLASSES = frozenset({"Caption", "caption", "TableCaption"})
# Words that mark note references and definitions.
NOTE_REFERENCES = frozenset({"noteref", "doc-noteref"})
NOTE_DEFINITIONS = frozenset({"footnote", "doc-footnote", "endnote", "doc-endnote"})
NOTE_BLOCKS = frozenset({
    "address", "blockquote", "div", "dl", "fieldset", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "ol", "p", "pre", "table", "ul", "math", "ruby",
})
NOTE_HOLDERS = frozenset({"aside", "div", "li", "p", "section"})


def markup_of(node: Node | str) -> str:
    """A tree as markup, without recursion: ``None`` on the stack closes the last open tag."""
    out: list[str] = []
    opened: list[str] = []
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append(f"</{opened.pop()}>")
        elif isinstance(x, str):
            out.append(html.escape(x, quote=False))
        else:
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in x.attrs.items())
            if x.tag in VOID:
                out.append(f"<{x.tag}{attrs}/>")
                continue
            out.append(f"<{x.tag}{attrs}>")
            opened.append(x.tag)
            stack += [None, *reversed(x.children)]
    return "".join(out)


def url_is_safe(value: str) -> bool:
    value = value.strip()
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", value)
    return not re.search(r"[\r\n\t]", value[:32]) and (scheme is None or scheme[1].lower() in SAFE_SCHEMES)


def sanitise(root: Node) -> Node:
    """Unsafe elements go (what follows them stays), as do event handlers, styles and unsafe URLs."""
    for node in list(root.elements()):
        if node.tag in UNSAFE_TAGS:
            node.drop()
            continue
        for name in list(node.attrs):
            low, value = name.lower(), node.attrs[name]
            bad = low.startswith("on") or low in {"style", "srcdoc"}
            bad = bad or (low == "dir" and value.lower() not in SAFE_DIRECTIONS)
            if bad or (low in URL_ATTRIBUTES and not url_is_safe(value)):
                del node.attrs[name]
    return root


def rows_of(table: Node) -> list[Node]:
    return [n for n in table.elements() if n.tag == "tr"]


def cells_of(row: Node) -> list[Node]:
    return [c for c in row.children if isinstance(c, Node) and c.tag in {"td", "th"}]


def cell_is_inline(cell: Node) -> bool:
    for n in cell.elements():
        if n is cell:
            continue
        if n.tag in CELL_BLOCKS:
            if "SimplePara" not in n.attrs.get("class", "").split():
                return False
        elif n.tag not in CELL_INLINE:
            return False
    return True


def table_reason(table: Node) -> str:
    """Why a table must stay markup, or ``rectangular-inline-safe``."""
    rows = rows_of(table)
    cells = [cells_of(r) for r in rows]
    widths = {len(c) for c in cells}
    checks = (
        ("missing-rows", lambda: not rows),
        ("nested-table", lambda: any(n.tag == "table" for n in table.elements() if n is not table)),
        ("rowspan-or-colspan", lambda: any("rowspan" in c.attrs or "colspan" in c.attrs for r in cells for c in r)),
        ("non-rectangular", lambda: len(widths) != 1 or 0 in widths),
        ("missing-predictable-header", lambda: any(c.tag != "th" for c in cells[0])),
        ("ambiguous-header", lambda: any(c.tag == "th" for r in cells[1:] for c in r)),
        ("non-inline-safe-cell-content", lambda: not all(cell_is_inline(c) for r in cells for c in r)),
    )
    return next((name for name, holds in checks if holds()), "rectangular-inline-safe")


def caption_of(table: Node) -> tuple[str, Node | None]:
    """A table's caption text and the neighbour that held it, if it was one."""
    own = next((c for c in table.children if isinstance(c, Node) and c.tag == "caption"), None)
    if own is not None:
        return " ".join(own.text().split()), None
    near = [c for c in table.parent.children if isinstance(c, Node)] if table.parent else []
    at = next((i for i, c in enumerate(near) if c is table), 0)
    for c in (*near[max(0, at - 1) : at], *near[at + 1 : at + 2]):
        if CAPTION_CLASSES & set(c.attrs.get("class", "").split()):
            return " ".join(c.text().split()), c
    return "", None


def note_label(source: str, identity: str) -> str:
    """A stable footnote label of a source and an id."""
    text = f"{source}--{identity or 'fallback'}" if source else identity or "fallback"
    words = re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)*", text.lower().replace("%", " percent "))
    return "note-" + ("-".join(words)[:80] if words else "fallback")


def is_reference(n: Node) -> bool:
    return bool(n.tokens("epub:type", "role") & NOTE_REFERENCES) or (n.tag == "a" and any(x.tag == "sup" for x in n.elements()))


def is_definition(n: Node) -> bool:
    if n.tokens("epub:type", "role") & NOTE_DEFINITIONS:
        return True
    if n.tag not in NOTE_HOLDERS or not n.attrs.get("id"):
        return False
    inner = [x for x in n.elements() if x is not n]
    return not any(map(is_reference, inner)) and any(x.tag == "a" and "#" in x.attrs.get("href", "") for x in inner)


def notes_of(root: Node, source: str) -> list[tuple[Node, Node | None, str, str]]:
    """(reference, definition, label, class) of every note reference.

    Classes: cross_document, then ambiguous (not exactly one definition, or a target that several
    references share), then complex (block content), else simple_local.
    """
    nodes = list(root.elements())
    references, definitions = [n for n in nodes if is_reference(n)], [n for n in nodes if is_definition(n)]
    by_id = {n.attrs["id"]: n for n in definitions if n.attrs.get("id")}
    target_of = {id(r): r.attrs.get("href", "").partition("#")[2] for r in references}
    shared = [t for t in target_of.values() if t]
    out = []
    for r in references:
        file, target = r.attrs.get("href", "").partition("#")[0], target_of[id(r)]
        found = by_id.get(target) if target else None
        if file and file.split("?")[0] != source.partition("#")[0]:
            kind = "cross_document"
        elif found is None or shared.count(target) > 1:
            kind = "ambiguous"
        elif any(x.tag in NOTE_BLOCKS for x in found.elements() if x is not found):
            kind = "complex"
        else:
            kind = "simple_local"
        label = note_label(source, r.attrs.get("id") or target or r.text().strip())
        out.append((r, found, label, kind))
    return out
