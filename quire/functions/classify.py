"""Section types by ranked evidence, as one CASE ladder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title rules in order of trial (pattern, type, confidence).
RULES = (
    (r"\bcover\b", "cover", 0.6),
    (r"\btable\s+of\s+contents\b", "other", 0.55),
    (r"\b(title\s*page|titlepage)\b", "title-page", 0.55),
    (r"\b(copyright)\b", "copyright-page", 0.55),
    (r"\b(dedication)\b", "dedication", 0.5),
    (r"\b(foreword)\b", "foreword", 0.5),
    (r"\b(preface)\b", "preface", 0.5),
    (r"\b(acknowledgments?|acknowledgements?)\b", "acknowledgments", 0.5),
    (r"\b(introduction)\b", "introduction", 0.5),
    (r"\b(appendix)\b", "appendix", 0.5),
    (r"\b(glossary)\b", "glossary", 0.5),
    (r"\b(bibliography|works cited)\b", "bibliography", 0.5),
    (r"\bindex\b", "index", 0.45),
    (r"\b(colophon)\b", "colophon", 0.5),
    (r"\babout\s+the\s+author\b", "about-author", 0.55),
    (r"\b(books\s+by|also\s+available)\b", "other", 0.45),
    (r"\b(chapter|ch\.?)\s*\d+\b", "chapter", 0.45),
    (r"\bpart\s+\d+\b", "part", 0.4),
)
# Property tokens and the types they name.
PROPERTY_TYPES = {
    "titlepage": "title-page",
    "title-page": "title-page",
    "copyright-page": "copyright-page",
    "dedication": "dedication",
    "foreword": "foreword",
    "preface": "preface",
    "acknowledgments": "acknowledgments",
    "acknowledgements": "acknowledgments",
    "introduction": "introduction",
    "appendix": "appendix",
    "glossary": "glossary",
    "bibliography": "bibliography",
    "index": "index",
    "colophon": "colophon",
    "chapter": "chapter",
    "part": "part",
    "cover": "cover",
    "cover-image": "cover",
    "about-author": "about-author",
    "other": "other",
}
# Whole labels that mean a cover.
COVER_LABELS = ("cover", "other.ms-coverimage-standard", "other.ms-coverimage")
# Fixed value: a numbered title.
NUMBERED = r"(?i)^\s*(?:chapter\s+)?(?:\d+|[IVXLCDM]+)(?:\s*[-–—:.)]\s*|\s+|$)"
# File name forms in order of trial (pattern, type, confidence).
EDGE, STOP = r"(?:^|[._\-\s])", r"(?:[._\-\s]|$)"
COVER_NAME = EDGE + "cover" + STOP
FILE_NAMES = (
    (r"about[-_ ]?the[-_ ]?author|" + EDGE + "ata" + STOP, "about-author", 0.65),
    (r"books[-_ ]?by|also[-_ ]?available|" + EDGE + r"bm\d+" + STOP, "other", 0.6),
    (EDGE + "(?:toc|contents)" + STOP, "other", 0.6),
    (EDGE + r"(?:prf|fm\d+)" + STOP, "preface", 0.6),
)
INDEX_NAME = EDGE + r"in\d+_b" + STOP
# Confidence of each source of evidence.
SOURCES = (("landmark", 0.9), ("nav", 0.8), ("guide", 0.75), ("ncx", 0.7))

EVIDENCE = "struct<type:string,source:string,confidence:double>"


def evidence(kind: Column | str, source: str, confidence: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("type"), F.lit(source).alias("source"), lit(confidence).cast("double").alias("confidence"))


def first_of(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, null if none does."""
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0]))


def rule(text: Column) -> Column:
    """The first rule that a text matches: struct(type, confidence)."""
    return first_of([(text.rlike("(?i)" + p), F.struct(F.lit(k).alias("type"), F.lit(float(c)).alias("confidence"))) for p, k, c in RULES])


def ruled(text: Column, source: str, base: float | None = None) -> Column:
    """The first rule that a text matches as evidence, null if none does: one ladder, tried once. With
    ``base`` a source's confidence counts first and the rule's only among equals."""
    return first_of([(text.rlike("(?i)" + p), evidence(k, source, float(c) if base is None else base + c / 100)) for p, k, c in RULES])


def last_token(text: Column) -> Column:
    return F.substring_index(F.substring_index(F.lower(text), "#", -1), ":", -1)


def property_type(token: Column) -> Column:
    """The type of a property token, else null."""
    table = F.create_map(*(F.lit(x) for pair in PROPERTY_TYPES.items() for x in pair))
    return F.try_element_at(table, token)


def label_type(label: Column) -> Column:
    """The type that a landmark, navigation or guide label names exactly, else null."""
    low = F.lower(label)
    return F.when(low.isin(*COVER_LABELS), "cover").otherwise(F.coalesce(property_type(low), property_type(last_token(label))))


def numbered(text: Column) -> Column:
    return text.rlike(NUMBERED)


def file_name_evidence(item_id: Column, href: Column, title: Column, index_before: Column) -> Column:
    """What the file name says; an index part needs an index section before it."""
    name = F.concat(item_id, F.lit(" "), href)
    low = F.lower(name)
    cases = [(low.rlike(COVER_NAME) | (F.trim(title) == "."), evidence("cover", "filename", 0.65))]
    cases += [(low.rlike(p), evidence(k, "filename", c)) for p, k, c in FILE_NAMES]
    cases += [(low.rlike(INDEX_NAME) & index_before, evidence("index", "filename", 0.6))]
    return F.coalesce(first_of(cases), ruled(name, "filename"))


def classified(title: Column, item_id: Column, href: Column, properties: Column, landmark: Column, nav: Column, guide: Column, ncx: Column, heading: Column, book_title: Column, index_before: Column) -> Column:
    """struct(type, source, confidence) of a section: the strongest evidence decides.

    Of several known properties the alphabetically first type wins, as properties have no order.
    """
    by_property = F.array_min(F.filter(F.transform(properties, lambda p: property_type(last_token(p))), lambda x: x.isNotNull()))
    labels = {"landmark": landmark, "nav": nav, "guide": guide, "ncx": ncx}
    clean = F.trim(title)
    unnamed = (clean == "") | (clean == ".") | (F.lower(clean) == F.lower(F.trim(book_title)))
    told = [F.when(by_property.isNotNull(), evidence(by_property, "epub:type", 0.95))]
    told += [F.when(label_type(labels[s]).isNotNull(), evidence(label_type(labels[s]), s, c)) for s, c in SOURCES]
    told += [F.when(numbered(x), evidence("chapter", s, 0.82)) for s, x in (("nav", nav), ("ncx", ncx), ("title", title), ("heading", heading))]
    told += [ruled(labels[s], s, c) for s, c in SOURCES]
    told += [ruled(x, "heading") for x in (title, heading)]
    told += [file_name_evidence(item_id, href, title, index_before), F.when(unnamed, evidence("other", "filename", 0.35))]
    return F.coalesce(*told, evidence("chapter", "spine", 0.4))
