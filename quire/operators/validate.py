"""Checking book directories: one row per issue.

files: book_id, path, text (null for files that are no text). What a book says of itself is read from
its own JSON files; all else is joins and aggregates on (book, path). No file is opened and nothing is
collected.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normal_path

# Files that every book has, and the keys of its manifest.
REQUIRED_FILES = ("book.json", "conversion-report.json", "index.md", "toc.json", "toc.md")
SECTION_KEYS = ("id", "order", "path", "role", "sources", "title", "type")
FILE_KEYS = {
    "book.json": ("assets", "conversion", "schema_version", "sections", "title"),
    "conversion-report.json": ("issues", "source_validation", "stats", "status", "tool_version"),
    "toc.json": ("nodes", "schema_version"),
}
PART_KEYS = {
    ("book.json", "conversion"): ("tool", "tool_version"),
    ("conversion-report.json", "stats"): ("assets_skipped", "generated_files", "images_copied", "source_documents", "unresolved_links"),
}
LINK = r"\[[^\]]*\]\(([^)\s]+)\)"
HREF = r"""(?:href|src)=["']([^"']+)["']"""
ANCHOR = r"""id=["']([^"']+)["']"""


def issue(rows: DataFrame, severity: str, code: str, where: str, book: str = "book_id") -> DataFrame:
    return rows.select(book, F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(where).alias("at"))


def links(files: DataFrame, book: str = "book_id") -> DataFrame:
    """Every local link of every file: book, path, href, target (resolved, null if it leaves the book), fragment."""
    found = F.concat(F.regexp_extract_all("text", F.lit(LINK), F.lit(1)), F.regexp_extract_all("text", F.lit(HREF), F.lit(1)))
    rows = files.select(book, "path", F.explode(found).alias("href")).where(~F.col("href").rlike("^(https?://|mailto:)"))
    file = F.substring_index("href", "#", 1)
    fragment = F.when(F.instr("href", "#") > 0, F.nullif(F.expr("substring(href, instr(href, '#') + 1)"), F.lit("")))
    seen = F.concat(F.regexp_replace("path", "[^/]*$", ""), file)
    target = F.when(file == "", F.col("path")).when(~escapes(seen), normal_path(seen))
    return rows.withColumn("target", target).withColumn("fragment", fragment)


def escapes(path: Column) -> Column:
    """Whether a path climbs above its root anywhere on the way."""
    return F.aggregate(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out")),
        lambda acc, s: F.struct(
            (acc["depth"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("depth"),
            (acc["out"] | ((s == "..") & (acc["depth"] == 0))).alias("out"),
        ),
        lambda acc: acc["out"],
    ) | path.startswith("/")


def anchors(files: DataFrame, book: str = "book_id") -> DataFrame:
    return files.select(book, "path", F.explode(F.regexp_extract_all("text", F.lit(ANCHOR), F.lit(1))).alias("anchor"))


def link_issues(files: DataFrame, book: str = "book_id", sources: DataFrame | None = None) -> DataFrame:
    """Links of ``sources`` (by default all files) that leave the book, or point at no file or no anchor."""
    found = links(files if sources is None else sources, book)
    there = files.select(book, F.col("path").alias("target"))
    inside = found.where("target IS NOT NULL")
    missing = inside.join(there, [book, "target"], "left_anti")
    marks = anchors(files, book).select(book, F.col("path").alias("target"), F.col("anchor").alias("fragment"))
    present = inside.join(there, [book, "target"], "left_semi").where("fragment IS NOT NULL")
    return (
        issue(found.where("target IS NULL"), "error", "VALIDATE_LINK_ESCAPE", "path", book)
        .unionByName(issue(missing, "warning", "VALIDATE_LINK_MISSING", "path", book))
        .unionByName(issue(present.join(marks, [book, "target", "fragment"], "left_anti"), "warning", "VALIDATE_ANCHOR_MISSING", "path", book))
    )


def repeated(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Every row of a key after its first."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n > 1").drop("__n")


def absent(rows: DataFrame, files: DataFrame, book: str = "book_id") -> DataFrame:
    """Rows whose path is no file of the book."""
    return rows.join(files.select(book, "path"), [book, "path"], "left_anti")


def missing_required(books: DataFrame, files: DataFrame, book: str = "book_id") -> DataFrame:
    wanted = books.select(book, F.explode(F.array(*map(F.lit, REQUIRED_FILES))).alias("path"))
    return issue(absent(wanted, files, book), "error", "VALIDATE_MISSING_FILE", "path", book)


def front_matter_mismatch(sections: DataFrame, files: DataFrame, book: str = "book_id") -> DataFrame:
    """Sections whose file names another id; files or manifests without one are left alone."""
    own = F.nullif(F.regexp_extract("text", r"(?m)^id:\s*(\S+)", 1), F.lit(""))
    joined = sections.join(files.select(book, "path", own.alias("own_id")), [book, "path"])
    return issue(joined.where(F.col("own_id") != F.col("section_id")), "warning", "VALIDATE_ID_MISMATCH", "path", book)


def footnotes(files: DataFrame, book: str = "book_id") -> tuple[DataFrame, DataFrame]:
    """(references, definitions): book, path, label."""
    refs = F.regexp_extract_all("text", F.lit(r"(?<!!)\[\^([^\]]+)\]"), F.lit(1))
    defs = F.regexp_extract_all("text", F.lit(r"(?m)^\[\^([^\]]+)\]:"), F.lit(1))
    return files.select(book, "path", F.explode(refs).alias("label")), files.select(book, "path", F.explode(defs).alias("label"))


def footnote_missing(files: DataFrame, book: str = "book_id") -> DataFrame:
    refs, defs = footnotes(files, book)
    return refs.distinct().join(defs, [book, "path", "label"], "left_anti")


def footnote_duplicates(files: DataFrame, book: str = "book_id") -> DataFrame:
    _, defs = footnotes(files, book)
    return defs.groupBy(book, "path", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def json_issues(files: DataFrame, keys: Sequence[str], book: str = "book_id") -> DataFrame:
    """Unreadable JSON files, and required keys that an object lacks: code and key."""
    kind = F.json_object_keys("text")
    valid = F.try_parse_json("text").isNotNull()
    checked = files.withColumn("valid", valid).withColumn("keys", kind)
    broken = checked.where(~F.col("valid")).select(book, "path", F.lit("VALIDATE_JSON").alias("code"), F.lit(None).cast("string").alias("key"))
    lacking = F.explode(F.array_except(F.array(*map(F.lit, keys)), F.coalesce("keys", F.array().cast("array<string>"))))
    return broken.unionByName(checked.where("valid").select(book, "path", F.lit("VALIDATE_SCHEMA").alias("code"), lacking.alias("key")))


def whole_json(files: DataFrame, book: str = "book_id") -> tuple[DataFrame, DataFrame]:
    """The JSON files that hold an object, and issues of those that don't."""
    own = files.where(F.col("path").isin(*FILE_KEYS)).withColumn("parsed", F.try_parse_json("text"))
    good = F.col("parsed").isNotNull() & F.try_variant_get("parsed", "$", "map<string,variant>").isNotNull()
    own = own.withColumn("good", F.coalesce(good, F.lit(False)))
    return own.where("good").select(book, "path", "text"), issue(own.where("NOT good"), "error", "VALIDATE_JSON", "path", book)


def lacking(rows: DataFrame, text: str, keys: Sequence[str], where: str, book: str = "book_id") -> DataFrame:
    """An issue for each object (JSON in ``text``) that lacks some of ``keys``."""
    missing = F.array_except(F.array(*map(F.lit, keys)), F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")))
    return issue(rows.where(F.size(missing) > 0), "error", "VALIDATE_SCHEMA", where, book)


def entries(objects: DataFrame, file: str, field: str, book: str = "book_id") -> DataFrame:
    """book, n, entry (JSON) and whether it is an object, of a list in one of a book's files."""
    listed = F.from_json(F.get_json_object("text", f"$.{field}"), "array<string>")
    rows = objects.where(F.col("path") == file).select(book, F.posexplode(listed).alias("n", "entry"))
    return rows.withColumn("is_object", F.coalesce(F.trim("entry").startswith("{"), F.lit(False)))


TOC_ROWS = "href string, is_object boolean"


def toc_hrefs(objects: DataFrame, book: str = "book_id") -> DataFrame:
    """href of every node of a book's contents, however deep; is_object is false for a node that is none."""
    from .documents import per_document

    def rows(text: str | None):
        stack = list(json.loads(text or "{}").get("nodes") or [])
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                yield node.get("href"), True
                stack.extend(node.get("children") or [])
            else:
                yield None, False

    return per_document(objects.where("path = 'toc.json'"), book, "text", TOC_ROWS, rows)


def toc_issues(hrefs: DataFrame, files: DataFrame, book: str = "book_id") -> DataFrame:
    """Contents entries that leave the book, or point at no file or no anchor."""
    target = F.substring_index("href", "#", 1)
    fragment = F.when(F.instr("href", "#") > 0, F.nullif(F.expr("substring(href, instr(href, '#') + 1)"), F.lit("")))
    rows = hrefs.where(F.coalesce("href", F.lit("")) != "").withColumn("target", target).withColumn("fragment", fragment).where("target <> ''")
    inside = rows.where(~escapes(F.col("target"))).withColumn("target", normal_path(F.col("target")))
    there = files.select(book, F.col("path").alias("target"))
    marks = anchors(files, book).select(book, F.col("path").alias("target"), F.col("anchor").alias("fragment"))
    present = inside.join(there, [book, "target"], "left_semi").where("fragment IS NOT NULL")
    return (
        issue(rows.where(escapes(F.col("target"))), "error", "VALIDATE_TOC_ESCAPE", "href", book)
        .unionByName(issue(inside.join(there, [book, "target"], "left_anti"), "warning", "VALIDATE_TOC_MISSING", "href", book))
        .unionByName(issue(present.join(marks, [book, "target", "fragment"], "left_anti"), "warning", "VALIDATE_TOC_ANCHOR_MISSING", "href", book))
    )


def anchor_duplicates(files: DataFrame, book: str = "book_id") -> DataFrame:
    """Every anchor of a file after its first."""
    n = F.posexplode(F.regexp_extract_all("text", F.lit(ANCHOR), F.lit(1))).alias("n", "anchor")
    return repeated(files.select(book, "path", n), [book, "path", "anchor"], "n")


def validate(books: DataFrame, files: DataFrame, book: str = "book_id") -> DataFrame:
    """All issues of book directories."""
    objects, out = whole_json(files, book)
    listed, held, nodes = entries(objects, "book.json", "sections", book), entries(objects, "book.json", "assets", book), toc_hrefs(objects, book)
    of = lambda rows, name: F.get_json_object("entry", f"$.{name}").alias(name)
    sections = listed.where("is_object").select(book, "n", "entry", F.get_json_object("entry", "$.id").alias("section_id"), of(listed, "path"))
    with_path = sections.where("coalesce(path, '') <> ''")
    assets = held.where("is_object").select(book, of(held, "path")).where("coalesce(path, '') <> ''")
    own = files.join(with_path.select(book, "path").distinct(), [book, "path"], "left_semi")
    for more in (
        missing_required(books, files, book),
        *(lacking(objects.where(F.col("path") == name), "text", keys, "path", book) for name, keys in FILE_KEYS.items()),
        *(
            lacking(objects.where(F.col("path") == name).withColumn("part", F.get_json_object("text", f"$.{part}")).where("part LIKE '{%'").withColumn("at_part", F.concat("path", F.lit(f"#{part}"))), "part", keys, "at_part", book)
            for (name, part), keys in PART_KEYS.items()
        ),
        lacking(sections.withColumn("at_entry", F.concat(F.lit("book.json#sections/"), F.coalesce("section_id", F.lit("?")))), "entry", SECTION_KEYS, "at_entry", book),
        issue(listed.unionByName(held).where("NOT is_object").withColumn("file", F.lit("book.json")), "error", "VALIDATE_SCHEMA", "file", book),
        issue(nodes.where("NOT is_object").withColumn("file", F.lit("toc.json")), "error", "VALIDATE_SCHEMA", "file", book),
        issue(repeated(sections.where("coalesce(section_id, '') <> ''"), [book, "section_id"], "n"), "error", "VALIDATE_DUP_SECTION", "section_id", book),
        issue(repeated(with_path, [book, "path"], "n"), "error", "VALIDATE_DUP_PATH", "path", book),
        issue(absent(with_path, files, book), "error", "VALIDATE_MISSING_SECTION", "path", book),
        front_matter_mismatch(with_path.where("coalesce(section_id, '') <> ''"), files, book),
        issue(anchor_duplicates(own, book), "error", "VALIDATE_DUP_ANCHOR", "path", book),
        link_issues(files, book, own),
        issue(footnote_missing(own, book), "error", "VALIDATE_FOOTNOTE_MISSING", "path", book),
        issue(footnote_duplicates(own, book), "error", "VALIDATE_FOOTNOTE_DUPLICATE", "path", book),
        toc_issues(nodes, files, book),
        issue(absent(assets, files, book), "error", "VALIDATE_MISSING_ASSET", "path", book),
    ):
        out = out.unionByName(more)
    return out
