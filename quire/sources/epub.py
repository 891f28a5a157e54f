"""Publications as rows: archives are read as binary files and opened in the workers.

One bad archive gives issue rows, never a failed job. Nothing is extracted to disk or fetched.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dom import Node, parse, parse_xml

MEMBERS = "book_id string, pos int, member string, content binary, readable boolean"
#: Names of members that are neither text nor SVG.
MEDIA = re.compile(r"(?i)\.(jpe?g|png|gif|webp|bmp|tiff?|mp[34]|m4[av]|ogg|wav|ttf|otf|woff2?|css|js)$")
PACKAGE = "book_id string, kind string, pos int, item_id string, href string, media_type string, properties array<string>, name string, value string, linear boolean"
NAV = "book_id string, tree string, node_id int, parent_id int, ord int, depth int, title string, href string, semantic_type string"
ISSUES = "book_id string, severity string, code string, message string"
NCX_TYPE = "application/x-dtbncx+xml"
DRM = "META-INF/encryption.xml"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """book_id (the file's path) and content of archives; a stream can be read the same way."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("book_id"), "content")


def schema_of(df: DataFrame, ddl: str):
    return df.sparkSession.createDataFrame([], ddl).schema


def by_row(df: DataFrame, ddl: str, make) -> DataFrame:
    """Rows that ``make(row)`` yields for each row, a few archives at a time."""
    wanted = schema_of(df, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(wanted)
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(make(batch.slice(i, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return df.mapInArrow(run, wanted)


def members(archives: DataFrame, media: bool | None = None) -> DataFrame:
    """Members of archives: book_id, pos, member, content, readable.

    Each archive also has a row of its own, at pos -1 with no member: readable is null if there is no
    file, false if it is no archive. A damaged member is a row that is not readable; the others stay.
    media: False leaves out the bytes of pictures, sound, fonts and styles (so that what is kept
    between steps is text), True gives those members alone, None gives everything. An archive is
    opened whole in memory, as is each member; binary files end at 2 GB.
    """
    broken = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, OSError, ValueError, EOFError)

    def opened(row: dict):
        book, content = row["book_id"], row["content"]
        try:
            z = zipfile.ZipFile(io.BytesIO(content or b""))
        except broken:
            if not media:
                yield book, -1, None, None, None if content is None else False
            return
        with z:
            if not media:
                yield book, -1, None, None, True
            for i, info in enumerate(z.infolist()):
                is_media = MEDIA.search(info.filename) is not None
                if media and not is_media:
                    continue
                held, good = None, True
                try:
                    held = b"" if info.is_dir() else z.read(info)
                except broken:
                    good = False
                yield book, i, info.filename, None if media is False and is_media else held, good

    return by_row(archives, MEMBERS, opened)


def issue_rows(rows: DataFrame, severity: str, code, message="''") -> DataFrame:
    return rows.select("book_id", F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), F.expr(message).cast("string").alias("message"))


def archive_issues(found: DataFrame) -> DataFrame:
    """What is wrong with archives: absent, unreadable, protected, or a missing or wrong media type."""
    clean = F.regexp_replace(F.replace("member", F.lit("\\"), F.lit("/")), "/+$", "")
    own = F.col("pos") == -1
    state = found.groupBy("book_id").agg(
        F.bool_or(F.when(own, F.col("readable"))).alias("opened"), F.coalesce(F.bool_or(clean == DRM), F.lit(False)).alias("drm"),
        F.min(F.when(F.col("member") == "mimetype", F.trim(F.decode("content", "UTF-8")))).alias("mimetype"),
    )
    code = (
        F.when(F.col("opened").isNull(), "INGEST_MISSING")
        .when(~F.col("opened"), "INGEST_NOT_ZIP")
        .when(F.col("drm"), "INGEST_DRM")
        .when(F.col("mimetype").isNull(), "INGEST_NO_MIMETYPE")
        .when(F.col("mimetype") != "application/epub+zip", "INGEST_MIMETYPE")
    )
    severity = F.when(F.col("code").isin("INGEST_MISSING", "INGEST_NOT_ZIP", "INGEST_DRM"), "fatal").otherwise("warning")
    return state.withColumn("code", code).where("code IS NOT NULL").select("book_id", severity.alias("severity"), "code", F.lit("").alias("message"))


def package_issues(found: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """What is wrong with the packages of readable archives: the first fault that ends a book, and items that are incomplete or absent."""
    books = found.where("pos = -1 AND readable").select("book_id")
    container = found.where("member = 'META-INF/container.xml'").groupBy("book_id").agg(F.lit(True).alias("container"))
    paths = package_paths(found).groupBy("book_id").agg(F.lit(True).alias("path"))
    package = rows.groupBy("book_id").agg(F.bool_or(F.col("kind") == "package").alias("package"), F.bool_or(F.col("kind") == "itemref").alias("spine"))
    state = books.join(container, "book_id", "left").join(paths, "book_id", "left").join(package, "book_id", "left")
    code = F.when(F.col("container").isNull(), "PARSE_NO_CONTAINER").when(F.col("path").isNull(), "PARSE_NO_ROOTFILE").when(F.col("package").isNull(), "PARSE_NO_PACKAGE").when(~F.col("spine"), "PARSE_EMPTY_SPINE")
    fatal = issue_rows(state.withColumn("code", code).where("code IS NOT NULL"), "fatal", F.col("code"))
    absent = items.select("book_id", F.col("href").alias("member"), "item_id").join(found.where("readable").select("book_id", "member"), ["book_id", "member"], "left_anti")
    incomplete = issue_rows(rows.where("kind = 'incomplete'"), "warning", "PARSE_ITEM_INCOMPLETE", "href")
    return fatal.unionByName(incomplete).unionByName(issue_rows(absent, "warning", "PARSE_MISSING_ITEM", "item_id"))


def navigation_issues(found: DataFrame, rows: DataFrame, items: DataFrame, nav: DataFrame) -> DataFrame:
    """What is wrong with the navigation; ``nav`` has what was read, and rows of tree ``issue`` for what could not be."""
    version = rows.where("kind = 'package'").select("book_id", F.col("value").alias("version"), F.col("href").alias("package"))
    wanted = nav_resources(items)
    held = found.where("readable").select("book_id", F.col("member").alias("href"))
    missing = version.where("version LIKE '3%'").join(wanted.where("role = 'nav'"), "book_id", "left_anti")
    no_bytes = wanted.join(held, ["book_id", "href"], "left_anti").withColumn("code", F.concat(F.upper("role"), F.lit("_MISSING_BYTES")))
    empty = wanted.where("role = 'nav'").join(held, ["book_id", "href"], "left_semi").join(nav.where("tree = 'nav'"), "book_id", "left_anti")
    return (
        issue_rows(missing, "warning", "NAV_MISSING", "package")
        .unionByName(issue_rows(no_bytes, "warning", F.col("code"), "href"))
        .unionByName(issue_rows(empty, "warning", "NAV_EMPTY_TOC", "href"))
        .unionByName(issue_rows(nav.where("tree = 'issue'"), "warning", F.col("title"), "href"))
    )


def without_drm(found: DataFrame) -> DataFrame:
    clean = F.regexp_replace(F.replace("member", F.lit("\\"), F.lit("/")), "/+$", "")
    return found.join(found.where(clean == DRM).select("book_id").distinct(), "book_id", "left_anti")


def xml_tree(content: bytes) -> Node:
    """A tree of local names; broken XML falls back to the forgiving parser. Entity declarations are refused."""
    root = parse_xml(content)
    if root is None:
        root = parse(content)
        for n in root.elements():
            n.tag = n.tag.rpartition(":")[2]
    return root


def joined(base: str, href: str) -> str:
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), href))
    return path.lstrip("./") if path.startswith("../") else path


def package_paths(found: DataFrame) -> DataFrame:
    """book_id, package_path: the first root file that has a path."""

    def read(row: dict):
        for n in xml_tree(row["content"]).elements():
            if n.tag == "rootfile" and n.attrs.get("full-path"):
                yield row["book_id"], n.attrs["full-path"]
                return

    return by_row(found.where("member = 'META-INF/container.xml' AND content IS NOT NULL"), "book_id string, package_path string", read)


def packages(found: DataFrame) -> DataFrame:
    """Tagged rows of every package document: metadata, item, itemref, guide, in document order."""
    paths = package_paths(found)
    docs = found.where("content IS NOT NULL").join(paths, "book_id").where("member = package_path")

    def read(row: dict):
        empty = (None, None, None, None, None, None, None)
        tree = xml_tree(row["content"])
        package = next((n for n in tree.elements() if n.tag == "package"), None)
        yield row["book_id"], "package", -1, None, row["package_path"], None, None, None, (package.attrs.get("version") if package is not None else None) or "2.0", None
        for pos, n in enumerate(tree.elements()):
            a = n.attrs
            if n.parent is not None and n.parent.tag == "metadata":
                if n.tag == "meta":
                    yield row["book_id"], "meta", pos, *empty[:4], a.get("name") or a.get("property"), a.get("content") or n.text().strip(), None
                else:
                    yield row["book_id"], "metadata", pos, *empty[:4], n.tag, n.text().strip(), None
            elif n.tag == "item" and a.get("id") and a.get("href"):
                yield row["book_id"], "item", pos, a["id"], joined(row["package_path"], a["href"]), a.get("media-type") or "application/octet-stream", a.get("properties", "").split(), None, None, None
            elif n.tag == "item":
                yield row["book_id"], "incomplete", pos, None, row["package_path"], None, None, None, None, None
            elif n.tag == "itemref" and a.get("idref"):
                yield row["book_id"], "itemref", pos, a["idref"], None, None, None, None, None, a.get("linear") != "no"
            elif n.tag == "reference" and a.get("href"):
                yield row["book_id"], "guide", pos, None, joined(row["package_path"], a.get("href", "")), a.get("type", ""), None, a.get("title", ""), None, None

    return by_row(docs.select("book_id", "package_path", "content"), PACKAGE, read)


def manifest(rows: DataFrame) -> DataFrame:
    """Items; of equal ids the last counts, in the first one's place."""
    items = rows.where("kind = 'item'")
    return items.groupBy("book_id", "item_id").agg(F.min("pos").alias("pos"), *(F.max_by(c, "pos").alias(c) for c in ("href", "media_type", "properties")))


def spine(rows: DataFrame) -> DataFrame:
    """Entries with their item's href, if the item stands before; else the idref."""
    refs = rows.where("kind = 'itemref'").select("book_id", F.col("pos").alias("ref_pos"), F.col("item_id").alias("idref"), "linear")
    items = rows.where("kind = 'item'").select("book_id", F.col("item_id").alias("idref"), "pos", "href")
    met = refs.join(items, ["book_id", "idref"], "left")
    href = F.max_by("href", F.when(F.col("pos") < F.col("ref_pos"), F.col("pos")))
    return met.groupBy("book_id", "ref_pos", "idref", "linear").agg(href.alias("href")).select("book_id", F.col("ref_pos").alias("pos"), "idref", "linear", F.coalesce("href", "idref").alias("href"))


def metadata(rows: DataFrame) -> DataFrame:
    """One row per book: first non-empty single values, all authors and identifiers in order."""
    m = rows.where("kind IN ('metadata', 'meta') AND coalesce(value, '') <> ''")
    first = lambda *names: F.min_by(F.when(F.col("name").isin(*names), F.col("value")), F.when(F.col("name").isin(*names), F.col("pos")))
    every = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("name") == name, F.struct("pos", "value")))), lambda x: x["value"])
    books = rows.select("book_id").distinct()
    found = m.groupBy("book_id").agg(
        first("title").alias("title"), first("language").alias("language"), every("creator").alias("authors"), every("identifier").alias("identifiers"),
        first("publisher").alias("publisher"), first("date", "dcterms:modified").alias("date"), first("rights").alias("rights"), first("description").alias("description"),
    )
    return books.join(found, "book_id", "left").withColumn("title", F.coalesce("title", F.lit("Untitled")))


def guide(rows: DataFrame) -> DataFrame:
    """Guide references as nodes; the title falls back to the type, then the target."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.where("kind = 'guide'").select("book_id", F.col("pos").alias("ord"), F.coalesce(given("name"), given("media_type"), F.col("href")).alias("title"), "href", F.col("media_type").alias("type"))


def nav_resources(items: DataFrame) -> DataFrame:
    """The first item with property ``nav`` and the first of the NCX type, per book."""
    flagged = items.withColumn("role", F.when(F.array_contains("properties", "nav"), "nav").when(F.col("media_type") == NCX_TYPE, "ncx")).where("role IS NOT NULL")
    return flagged.groupBy("book_id", "role").agg(F.min_by("item_id", "pos").alias("item_id"), F.min_by("href", "pos").alias("href"))


def nav_rows(row: dict):
    """Rows of a nav document or NCX, pre-order."""
    base, book, ncx = row["member"], row["book_id"], row["role"] == "ncx"
    tree = xml_tree(row["content"])
    counter = 0

    def target(href: str | None) -> str | None:
        if not href:
            return None
        path, mark, fragment = href.partition("#")
        return (joined(base, path) if path else base) + mark + fragment

    def children(n: Node, *tags: str) -> list[Node]:
        return [c for c in n.children if isinstance(c, Node) and c.tag in tags]

    def words(n: Node) -> str:
        return " ".join(n.text().split())

    def walk(items: list[Node], kind: str):
        """Pre-order on a stack, however deep the lists are nested. An NCX entry without label and target goes with all below it."""
        nonlocal counter
        stack = [(item, -1, 1) for item in reversed(items)]
        while stack:
            item, parent, depth = stack.pop()
            if ncx:
                label = next((words(c) for c in children(item, "navLabel")), "")
                href = next((c.attrs.get("src") for c in children(item, "content")), None)
                below, semantic = children(item, "navPoint"), None
                if not label and not href:
                    continue
            else:
                head = next(iter(children(item, "a", "span")), None)
                label, href = (words(head), head.attrs.get("href")) if head is not None else (words(item), None)
                semantic = (head.attrs.get("epub:type") if head is not None else None) or None
                below = [li for ol in children(item, "ol")[:1] for li in children(ol, "li")]
            number, counter = counter, counter + 1
            yield book, kind, number, parent, number, depth, label or "Untitled", target(href), semantic
            stack.extend((c, number, depth + 1) for c in reversed(below))

    if ncx:
        root = tree.first("navMap")
        if root is None:
            yield book, "issue", -1, -1, -1, 0, "NCX_EMPTY" if row["content"].strip() else "NCX_MALFORMED", base, None
            return
        yield from walk(children(root, "navPoint"), "ncx")
        return
    for nav in (n for n in tree.elements() if n.tag == "nav"):
        kinds = nav.tokens("epub:type", "class")
        if "page-list" in kinds:
            continue
        lists = children(nav, "ol")
        if lists:
            yield from walk(children(lists[0], "li"), "landmark" if "landmarks" in kinds else "nav")


def navigation(found: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of nav documents and NCX files; tree ``issue`` names what could not be read."""
    wanted = nav_resources(items).select("book_id", "role", F.col("href").alias("member"))
    docs = found.where("content IS NOT NULL").join(wanted, ["book_id", "member"])
    return by_row(docs.select("book_id", "member", "role", "content"), NAV, nav_rows)
