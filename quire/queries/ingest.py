"""Queries on archives: every five pages become a book, written as EPUB bytes and read back."""

import io
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators.inspection import inspected
from ..sources import epub as E

PAGES = 5


def built(rows: pd.DataFrame, fault: int = 0) -> bytes:
    """A book of pages: a chapter for each, nav and NCX with a group of even and one of odd pages, a guide.

    fault: 0 none; 1 no container, 2 no root file, 3 no package, 4 empty spine, 5 an incomplete and an
    absent item, 6 no nav, 7 its file absent, 8 empty, 9 NCX without map.
    """
    rows = rows.sort_values("page_id")
    ids, book = rows["page_id"].tolist(), int(rows["page_id"].iloc[0]) // PAGES
    items = "".join(f'<item id="n{k}" href="text/n{k}.xhtml" media-type="application/xhtml+xml"/>' for k in ids)
    refs = "" if fault == 4 else "".join(f'<itemref idref="n{k}"{" linear=\"no\"" if k % 4 == 0 else ""}/>' for k in ids) + '<itemref idref="gone"/>'
    groups = [(g, [k for k in ids if k % 2 == g]) for g in (0, 1)]
    points = "".join(f'<li><span>Group {g}</span><ol>{"".join(f"<li><a href=\"text/n{k}.xhtml\">Page  {k}</a></li>" for k in own)}</ol></li>' for g, own in groups if own)
    ncx = "".join(f'<navPoint><navLabel><text>Group {g}</text></navLabel>{"".join(f"<navPoint><navLabel><text>N {k}</text></navLabel><content src=\"text/n{k}.xhtml#x\"/></navPoint>" for k in own)}</navPoint>' for g, own in groups if own)
    nav = "" if fault == 6 else '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
    odd = '<item href="y.xhtml"/><item id="x" href="x.xhtml" media-type="text/plain"/>' if fault == 5 else ""
    opf = (
        f'<?xml version="1.0"?><package version="3.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book {book}</dc:title><dc:title>Other</dc:title>'
        f'<dc:language>en</dc:language><dc:creator>B {book}</dc:creator><dc:creator>A</dc:creator><dc:identifier>id-{book}</dc:identifier></metadata>'
        f'<manifest>{nav}<item id="ncx" href="toc.ncx" media-type="{E.NCX_TYPE}"/>{items}{odd}</manifest>'
        f'<spine>{refs}</spine><guide><reference type="cover" title="" href="text/n{ids[0]}.xhtml"/></guide></package>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        if fault != 1:
            z.writestr("META-INF/container.xml", f"<container><rootfiles><rootfile{'' if fault == 2 else ' full-path=\"EPUB/content.opf\"'}/></rootfiles></container>")
        if fault != 3:
            z.writestr("EPUB/content.opf", opf)
        if fault not in (6, 7):
            z.writestr("EPUB/nav.xhtml", f'<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc">{"" if fault == 8 else f"<ol>{points}</ol>"}</nav><nav epub:type="page-list"><ol><li><a href="p">1</a></li></ol></nav></body></html>')
        z.writestr("EPUB/toc.ncx", "<ncx/>" if fault == 9 else f"<ncx><navMap>{ncx}</navMap></ncx>")
        if not fault and book % 3 == 1:
            z.writestr("META-INF\\encryption.xml", "x")
        for k, text in zip(ids, rows["html"], strict=True):
            z.writestr(f"EPUB/text/n{k}.xhtml", text)
    return out.getvalue()


def archives(t, faulty: bool = False):
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        book = int(pdf["page_id"].iloc[0]) // PAGES
        return pd.DataFrame({"book_id": [f"b{book}"], "content": [built(pdf, book % 10 if faulty else 0)]})

    return t["pages"].select("page_id", "html").groupBy(F.floor(F.col("page_id") / PAGES)).applyInPandas(make, "book_id string, content binary")


def packages(t):
    return E.packages(E.members(archives(t)))


BOOK = f"page_id // {PAGES}"
KEY = f"'b' || CAST({BOOK} AS varchar)"
CHAPTER = "'EPUB/text/n' || CAST(page_id AS varchar) || '.xhtml'"


@query("epub_member_scan", f"""
SELECT {KEY} AS book_id, {CHAPTER} AS member, CAST(strlen(html) AS BIGINT) AS bytes FROM pages
UNION ALL SELECT DISTINCT {KEY}, 'mimetype', CAST(20 AS BIGINT) FROM pages
""")  # fmt: skip
def epub_member_scan(t):
    found = E.members(archives(t)).where("member = 'mimetype' OR member LIKE 'EPUB/text/%'")
    return found.select("book_id", "member", F.length("content").cast("long").alias("bytes"))


@query("epub_drm_filter", f"SELECT DISTINCT {KEY} AS book_id FROM pages WHERE {BOOK} % 3 <> 1")
def epub_drm_filter(t):
    return E.without_drm(E.members(archives(t))).select("book_id").distinct()


@query("opf_manifest", f"""
SELECT {KEY} AS book_id, 'n' || CAST(page_id AS varchar) AS item_id, {CHAPTER} AS href, 'application/xhtml+xml' AS media_type FROM pages
UNION ALL SELECT DISTINCT {KEY}, 'nav', 'EPUB/nav.xhtml', 'application/xhtml+xml' FROM pages UNION ALL SELECT DISTINCT {KEY}, 'ncx', 'EPUB/toc.ncx', '{E.NCX_TYPE}' FROM pages
""")  # fmt: skip
def opf_manifest(t):
    return E.manifest(packages(t)).select("book_id", "item_id", "href", "media_type")


@query("opf_spine", f"""
SELECT {KEY} AS book_id, row_number() OVER (PARTITION BY {BOOK} ORDER BY page_id) AS i, 'n' || CAST(page_id AS varchar) AS idref, page_id % 4 <> 0 AS linear, {CHAPTER} AS href FROM pages
UNION ALL SELECT {KEY}, count(*) + 1, 'gone', true, 'gone' FROM pages GROUP BY {KEY}
""")  # fmt: skip
def opf_spine(t):
    i = F.row_number().over(Window.partitionBy("book_id").orderBy("pos")).cast("long")
    return E.spine(packages(t)).select("book_id", i.alias("i"), "idref", "linear", "href")


@query("opf_metadata", f"SELECT DISTINCT {KEY} AS book_id, 'Book ' || CAST({BOOK} AS varchar) AS title, 'en' AS language, 'B ' || CAST({BOOK} AS varchar) || ', A' AS authors, 'id-' || CAST({BOOK} AS varchar) AS identifier FROM pages")
def opf_metadata(t):
    return E.metadata(packages(t)).select("book_id", "title", "language", F.array_join("authors", ", ").alias("authors"), F.get("identifiers", F.lit(0)).alias("identifier"))


@query("first_nav_resource", f"SELECT DISTINCT {KEY} AS book_id, role, item_id FROM pages, (VALUES ('nav', 'nav'), ('ncx', 'ncx')) v(role, item_id)")
def first_nav_resource(t):
    return E.nav_resources(E.manifest(packages(t))).select("book_id", "role", "item_id")


@query("guide_nodes", f"SELECT {KEY} AS book_id, 'cover' AS title, 'EPUB/text/n' || CAST(min(page_id) AS varchar) || '.xhtml' AS href FROM pages GROUP BY {KEY}")
def guide_nodes(t):
    return E.guide(packages(t)).select("book_id", "title", "href")


@query("nav_document_rows", f"""
WITH n AS (
  SELECT DISTINCT {BOOK} AS b, page_id % 2 AS g, CAST(-1 AS BIGINT) AS p FROM pages UNION ALL SELECT {BOOK}, page_id % 2, page_id FROM pages
), o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY g, p) - 1 AS ord FROM n), t AS (SELECT * FROM o, (VALUES ('nav'), ('ncx')) v(tree))
SELECT 'b' || CAST(b AS varchar) AS book_id, tree, CAST(ord AS INTEGER) AS ord, CAST(CASE WHEN p < 0 THEN 1 ELSE 2 END AS INTEGER) AS depth,
  CAST(CASE WHEN p < 0 THEN -1 ELSE min(ord) OVER (PARTITION BY b, tree, g) END AS INTEGER) AS parent_id,
  CASE WHEN p < 0 THEN 'Group ' || CAST(g AS varchar) WHEN tree = 'nav' THEN 'Page ' || CAST(p AS varchar) ELSE 'N ' || CAST(p AS varchar) END AS title,
  CASE WHEN p >= 0 THEN 'EPUB/text/n' || CAST(p AS varchar) || '.xhtml' || CASE WHEN tree = 'ncx' THEN '#x' ELSE '' END END AS href
FROM t
""")  # fmt: skip
def nav_document_rows(t):
    """Nested nav documents and NCX files, as the parser reads them."""
    found = E.members(archives(t))
    return E.navigation(found, E.manifest(E.packages(found))).select("book_id", "tree", "ord", "depth", "parent_id", "title", "href")


@query("archive_issues", f"SELECT DISTINCT {KEY} AS book_id, 'fatal' AS severity, 'INGEST_DRM' AS code FROM pages WHERE {BOOK} % 3 = 1 UNION ALL SELECT 'bad', 'fatal', 'INGEST_NOT_ZIP' UNION ALL SELECT 'none', 'fatal', 'INGEST_MISSING'")
def archive_issues(t):
    bad = t.spark.createDataFrame([("bad", bytearray(b"no archive")), ("none", None)], "book_id string, content binary")
    return E.archive_issues(E.members(archives(t).unionByName(bad))).select("book_id", "severity", "code")


FAULTS = ((1, "fatal", "PARSE_NO_CONTAINER"), (2, "fatal", "PARSE_NO_ROOTFILE"), (3, "fatal", "PARSE_NO_PACKAGE"), (4, "fatal", "PARSE_EMPTY_SPINE"), (5, "warning", "PARSE_ITEM_INCOMPLETE"), (5, "warning", "PARSE_MISSING_ITEM"), (6, "warning", "NAV_MISSING"), (7, "warning", "NAV_MISSING_BYTES"), (7, "warning", "PARSE_MISSING_ITEM"), (8, "warning", "NAV_EMPTY_TOC"), (9, "warning", "NCX_EMPTY"))


@query("package_issues", f"SELECT DISTINCT {KEY} AS book_id, severity, code FROM pages JOIN (VALUES {', '.join(map(str, FAULTS))}) v(fault, severity, code) ON {BOOK} % 10 = fault")
def package_issues(t):
    found = E.members(archives(t, faulty=True))
    rows = E.packages(found)
    items = E.manifest(rows)
    issues = E.package_issues(found, rows, items).unionByName(E.navigation_issues(found, rows, items, E.navigation(found, items)))
    return issues.select("book_id", "severity", "code")


@query("inspect_summary", f"""
WITH b AS (SELECT {BOOK} AS b, count(*) AS n, count(DISTINCT page_id % 2) AS g FROM pages GROUP BY 1)
SELECT 'b' || CAST(b AS varchar) AS book_id, CASE WHEN b % 3 = 1 THEN 'fatal' ELSE 'ok' END AS status, CASE WHEN b % 3 <> 1 THEN 'Book ' || CAST(b AS varchar) END AS title, CASE WHEN b % 3 <> 1 THEN '3.0' END AS version,
  CAST(CASE WHEN b % 3 = 1 THEN 0 ELSE n + 1 END AS BIGINT) AS spine, CAST(CASE WHEN b % 3 = 1 THEN 0 ELSE n + g END AS BIGINT) AS nav, CAST(CASE WHEN b % 3 = 1 THEN 0 ELSE n + g END AS BIGINT) AS ncx, CAST(CASE WHEN b % 3 = 1 THEN 0 ELSE n + 2 END AS BIGINT) AS resources FROM b
""")  # fmt: skip
def inspect_summary(t):
    read = F.from_json("payload", "struct<title:string,epub_version:string,spine:array<string>,nav_toc:array<string>,ncx_toc:array<string>,resources:bigint>")
    size = lambda name: F.size(read[name]).cast("long").alias(name.removesuffix("_toc"))
    return inspected(archives(t)).select("book_id", "status", read["title"].alias("title"), read["epub_version"].alias("version"), size("spine"), size("nav_toc"), size("ncx_toc"), read["resources"].alias("resources"))
