"""What a book directory holds besides its sections: manifests, contents, report, index."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.paths import ref_fragment, ref_path
from ..runtime import TOOL, VERSION

# What book.json says of a book besides its sections and assets, absent values as null.
BOOK_FIELDS = ("title", "subtitle", "language", "publisher", "date", "rights", "description", "epub_version", "source_filename", "package_path")
COVER = "struct<path:string,source_href:string,media_type:string>"
SOURCES = "array<struct<href:string,fragment:string>>"


@F.pandas_udf(StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys, two spaces, ASCII only and a last line break."""
    return text.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=2, sort_keys=True) + "\n")


def json_of(value: Column) -> Column:
    """Indented JSON of a struct, nulls included."""
    return pretty_json(F.to_json(value, {"ignoreNullFields": "false"}))


def given(rows: DataFrame, name: str, kind: str) -> Column:
    """A column, or null of that type where there is none."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind).alias(name)


def book_manifest(books: DataFrame, sections: DataFrame, assets: DataFrame | None = None, book: str = "book_id") -> DataFrame:
    """book, book_json: a book's metadata, its sections in order and its assets.

    books: book, title, and as far as there are: authors, identifiers, cover and what else
    ``BOOK_FIELDS`` names. sections: book, order, section_id, type, title, path, and role, toc_path,
    sources, confidence. assets: book, href, path, media_type.
    """
    extra = {"role": "string", "toc_path": "array<string>", "sources": SOURCES, "confidence": "double"}
    every = sections.select(book, "order", "section_id", "type", "title", "path", *(given(sections, c, k) for c, k in extra.items()))
    names = ["order", "section_id", "type", "title", "path", *extra]
    listed = every.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(*names)), lambda a, b: (a["order"] - b["order"]).cast("int")).alias("sections"))
    one = F.transform("sections", lambda s: F.struct(
        s["section_id"].alias("id"), s["order"].alias("order"), s["type"].alias("type"), s["title"].alias("title"), s["path"].alias("path"), F.coalesce(s["role"], F.lit("file")).alias("role"),
        F.coalesce(s["toc_path"], F.array().cast("array<string>")).alias("toc_path"), F.coalesce(s["sources"], F.array().cast(SOURCES)).alias("sources"), s["confidence"].alias("confidence"),
    ))
    joined = books.join(listed, book, "left")
    held = F.array().cast("array<struct<source_href:string,path:string,media_type:string>>")
    if assets is not None:
        entry = F.struct(F.col("href").alias("source_href"), F.regexp_replace("path", r"^\.\./", "").alias("path"), "media_type")
        joined = joined.join(assets.groupBy(book).agg(F.sort_array(F.collect_list(entry)).alias("held")), book, "left")
        held = F.coalesce("held", held)
    lists = [F.coalesce(given(books, c, "array<string>"), F.array().cast("array<string>")).alias(c) for c in ("authors", "identifiers")]
    whole = F.struct(
        F.lit(1).alias("schema_version"), *(given(books, c, "string") for c in BOOK_FIELDS), *lists, given(books, "cover", COVER),
        F.coalesce(one, F.array()).alias("sections"), held.alias("assets"), F.struct(F.lit(TOOL).alias("tool"), F.lit(VERSION).alias("tool_version")).alias("conversion"),
    )
    return joined.select(book, json_of(whole).alias("book_json"))


def toc_nodes(nodes: DataFrame, sections: DataFrame, targets: DataFrame, book: str = "book_id") -> DataFrame:
    """Nodes with section_id, type, target: by (path, fragment) of a section's first source; the target
    falls back from the fragment to the document, then to the section's file. Later sections win ties."""
    own = sections.select(book, ref_path(F.col("source")).alias("p"), F.coalesce(ref_fragment(F.col("source")), F.lit("")).alias("f"), "section_id", "type", "output_path", "order")
    own = own.groupBy(book, "p", "f").agg(F.max_by(F.struct("section_id", "type", "output_path"), "order").alias("s"))
    keyed = nodes.withColumn("p", ref_path(F.col("href"))).withColumn("f", F.coalesce(ref_fragment(F.col("href")), F.lit("")))
    exact = targets.where("fragment IS NOT NULL").select(book, F.col("path").alias("p"), F.col("fragment").alias("f"), F.concat_ws("#", "out_path", "anchor").alias("t1"))
    whole = targets.where("fragment IS NULL").select(book, F.col("path").alias("p"), F.col("out_path").alias("t2"))
    joined = keyed.join(own, [book, "p", "f"], "left").join(exact, [book, "p", "f"], "left").join(whole, [book, "p"], "left")
    return joined.withColumn("section_id", F.col("s.section_id")).withColumn("target", F.coalesce("t1", "t2", "s.output_path")).withColumn("type", F.coalesce("semantic_type", "s.type")).drop("s", "t1", "t2", "p", "f")


def toc_lines(nodes: DataFrame, book: str = "book_id") -> DataFrame:
    """book, ord, line of the contents as Markdown."""
    label = F.when(F.col("target").isNull(), F.col("title")).otherwise(F.concat(F.lit("["), "title", F.lit("]("), "target", F.lit(")")))
    return nodes.select(book, "ord", F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int") - 1), F.lit("- "), label).alias("line"))


def toc_files(rows: list[dict]) -> tuple[str, str]:
    """toc.md and toc.json of a book's nodes (key, parent_key, title, type, section_id, target, provenance), in order.

    Nodes are written in pre-order from a stack, however deep they lie; a node that would come again
    below the same parent is written without what is below it.
    """
    below: dict[str, list[dict]] = {}
    for r in rows:
        below.setdefault(r["parent_key"], []).append(r)
    lines, out, seen = ["# Contents", ""], [], set()
    #: What is still to be written: text, or nodes of one parent with the place of the next.
    stack: list = ["\n  ],\n  \"schema_version\": 1\n}\n", ("", 0)]
    out.append('{\n  "nodes": [')
    open_parents: list[str] = []
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
            continue
        if top is None:
            open_parents.pop()
            continue
        parent, at = top
        nodes = below.get(parent, [])
        if at == len(nodes):
            continue
        r, depth = nodes[at], len(open_parents)
        stack.append((parent, at + 1))
        lines.append("  " * depth + (f"- [{r['title']}]({r['target']})" if r["target"] else f"- {r['title']}"))
        pad = "  " * (2 + 2 * depth)
        own = {k: json.dumps(r[v]) for k, v in (("href", "target"), ("provenance", "provenance"), ("section_id", "section_id"), ("title", "title"), ("type", "type"))}
        tail = "".join(f',\n{pad}  "{k}": {v}' for k, v in own.items()) + f"\n{pad}}}"
        head = ("," if at else "") + f'\n{pad}{{\n{pad}  "children": ['
        again = r["key"] == parent or r["key"] in open_parents or (parent, r["key"]) in seen
        seen.add((parent, r["key"]))
        if again or not below.get(r["key"]):
            out.append(head + "]" + tail)
            continue
        out.append(head)
        stack += [f"\n{pad}  ]" + tail, None, (r["key"], 0)]
        open_parents.append(r["key"])
    return "\n".join(lines) + "\n", "".join(out).replace('"nodes": [\n  ]', '"nodes": []')


def index_markdown(title: Column, authors: Column, description: Column, cover: Column, first_title: Column, first_path: Column) -> Column:
    part = lambda c, *around: F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(around[0], c, around[1]))
    start = F.when(first_path.isNull(), "").otherwise(F.concat(F.lit("Start: ["), first_title, F.lit("]("), first_path, F.lit(")\n\n")))
    none, gap = F.lit(""), F.lit("\n\n")
    return F.concat(F.lit("# "), title, gap, part(authors, none, gap), part(description, none, gap), part(cover, F.lit("\n![Cover]("), F.lit(")\n")), start, F.lit("See [toc.md](toc.md) for the full contents.\n"))
