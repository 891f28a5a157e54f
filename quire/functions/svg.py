"""Cleaning SVG on its event stream: what runs or reaches outside goes, all else is written as it was read."""

from __future__ import annotations

import re
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from .dom import Node, parse
from .markup import markup_of

# Elements that go with their content, and the reference attribute.
ACTIVE = frozenset({"script", "foreignobject"})
REFERENCE = "href"
OUTSIDE = re.compile(r"\s*(?:https?|javascript|data):", re.I)


def local(name: str) -> str:
    return name.rpartition(":")[2].lower()


def is_active(name: str, value: str) -> bool:
    """Whether an attribute runs code or leaves the book."""
    short = local(name)
    return short.startswith("on") or short == "handler" or (short == REFERENCE and OUTSIDE.match(value) is not None)


class Cleaner:
    def __init__(self) -> None:
        self.out: list[str] = []
        self.removed, self.skipping, self.unclosed = 0, 0, False

    def put(self, text: str) -> None:
        if self.unclosed:
            self.out.append(">")
            self.unclosed = False
        self.out.append(text)

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if self.skipping or local(name) in ACTIVE:
            self.removed += not self.skipping
            self.skipping += 1
            return
        good = {k: v for k, v in attrs.items() if not is_active(k, v)}
        self.removed += len(attrs) - len(good)
        self.put(f"<{name}" + "".join(f" {k}={quoteattr(v)}" for k, v in good.items()))
        self.unclosed = True

    def end(self, name: str) -> None:
        if self.skipping:
            self.skipping -= 1
        elif self.unclosed:
            self.out.append("/>")
            self.unclosed = False
        else:
            self.out.append(f"</{name}>")

    def text(self, data: str) -> None:
        if not self.skipping:
            self.put(escape(data))


def cleaned(svg: bytes) -> tuple[bytes, int]:
    """An SVG without active content, and the number of pieces that went; nothing to remove leaves it untouched.

    What is no XML is read by the forgiving parser and cleaned as a tree. Declared entities are not expanded.
    """
    cleaner = Cleaner()
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = cleaner.start, cleaner.end, cleaner.text

    def refused(*_: object) -> None:
        raise ValueError("entity declarations are refused")

    parser.EntityDeclHandler = refused
    try:
        parser.Parse(svg, True)
    except (expat.ExpatError, ValueError):
        return cleaned_tree(svg)
    return ("".join(cleaner.out).encode(), cleaner.removed) if cleaner.removed else (svg, 0)


def cleaned_tree(svg: bytes) -> tuple[bytes, int]:
    root, removed = parse(svg), 0
    for n in list(root.elements()):
        if local(n.tag) in ACTIVE:
            n.drop()
            removed += 1
            continue
        bad = [k for k, v in n.attrs.items() if is_active(k, v)]
        removed += len(bad)
        for k in bad:
            del n.attrs[k]
    return "".join(markup_of(c) for c in root.children if isinstance(c, Node) or c.strip()).encode("utf-8", "replace"), max(removed, 1)
