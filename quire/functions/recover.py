"""Recovered image content inside documents: an image gives way to the text, formula or table found in it."""

from __future__ import annotations

from .dom import Node, parse
from .markup import CELL_INLINE

# What recovered tables may hold, and what goes with all its content.
TABLE_TAGS = frozenset("table thead tbody tfoot tr th td caption colgroup col b strong i em br code sub sup math".split())
DANGEROUS_TAGS = frozenset("script style iframe object embed form svg".split())
CAPTION_LABELS = frozenset({"figure_title", "figure_caption", "table_title", "table_caption", "figure_table_title"})
LARGEST_SPAN = 1000
#: Parents that hold phrases only.
PHRASING = CELL_INLINE | {"h1", "h2", "h3", "h4", "h5", "h6", "ruby"}


def safe_table(markup: str) -> Node | None:
    """The first table of ``markup`` without anything but table structure and plain emphasis; null if there is none."""
    table = parse(markup).first("table")
    if table is None:
        return None
    table.parent = None
    for n in list(table.elements()):
        above, at = False, n.parent
        while at is not None:
            above, at = above or at.tag == "math", at.parent
        if n is table:
            n.attrs = {}
        elif above:
            continue
        elif n.tag in DANGEROUS_TAGS:
            n.drop()
        elif n.tag not in TABLE_TAGS:
            n.drop(keep_children=True)
        elif n.tag != "math":
            spans = {k: v.strip() for k, v in n.attrs.items() if k in {"rowspan", "colspan"} and n.tag in {"th", "td"}}
            n.attrs = {k: v for k, v in spans.items() if v.isdigit() and 1 <= int(v) <= LARGEST_SPAN}
    return table


def nodes_of(items: list[dict]) -> list[Node] | None:
    """Elements of recovered items (kind, content); null if a table cannot be made safe."""
    out = []
    for x in items:
        if x["kind"] == "table":
            node = safe_table(x["content"])
            if node is None:
                return None
        else:
            node = Node("p")
            node.children.append(x["content"] if x["kind"] == "text" else f"$${x['content']}$$")
        out.append(node)
    return out or None


def alone(n: Node) -> bool:
    """Whether a node is its parent's only content."""
    return all(c is n or (isinstance(c, str) and not c.strip()) for c in n.parent.children)


def recover(body: Node, found: dict[str, list[dict]]) -> list[tuple[str, str]]:
    """Replace images of ``body`` whose source has recovered items; (source, code) of what was done.

    An image between other words gives way to a single formula only. A figure with its own caption
    keeps that instead of recovered captions. An id moves to the first new element.
    """
    done = []
    for image in [n for n in body.elements() if n.tag == "img"]:
        source, parent = image.attrs.get("src", ""), image.parent
        items = [x for x in found.get(source) or () if x["kind"] in {"text", "formula", "table"}]
        if parent.tag == "figure" and any(isinstance(c, Node) and c.tag == "figcaption" for c in parent.children):
            items = [x for x in items if x.get("label") not in CAPTION_LABELS]
        if not items:
            continue
        inline = parent.tag in PHRASING or (parent.tag != "figure" and not alone(image))
        if inline:
            if len(items) > 1 or items[0]["kind"] != "formula":
                done.append((source, "IMAGE_PRESERVED_CONTEXT"))
                continue
            new = Node("span")
            new.children.append(f"${items[0]['content']}$")
            made = [new]
        else:
            made = nodes_of(items)
            if made is None:
                done.append((source, "IMAGE_CONVERSION_UNSAFE"))
                continue
        old = parent if parent.tag == "p" and alone(image) and parent.parent is not None else image
        if old.attrs.get("id"):
            made[0].attrs.setdefault("id", old.attrs["id"])
        at = next(i for i, c in enumerate(old.parent.children) if c is old)
        for n in made:
            n.parent = old.parent
        old.parent.children[at : at + 1] = made
        done.append((source, "IMAGE_CONVERTED"))
    return done
