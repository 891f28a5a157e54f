"""Queries of the validator: pages are the files of a book."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import validate as V

FILES = """
SELECT page_id % 15 AS book_id, page_id, concat('content/', cast(page_id AS {s}), '.md') AS path, concat('---', chr(10), 'id: sec-', cast(CASE WHEN page_id % 6 = 5 THEN 0 ELSE page_id END AS {s}), chr(10), '---', chr(10),
  CASE page_id % 7 WHEN 0 THEN concat('[x](', cast(page_id + 15 AS {s}), '.md#a)') WHEN 1 THEN concat('![i](', cast(page_id + 15 AS {s}), '.md)') WHEN 2 THEN '[x](../../../etc)' WHEN 3 THEN '[x](#a)' WHEN 4 THEN '<a href="nope.md">n</a>'
    WHEN 5 THEN concat('[x](https://e.org) <img src="./', cast(page_id + 15 AS {s}), '.md#zz">') ELSE '[m](mailto:x)' END,
  chr(10), '<a id="a"></a> [^n1] ![^pic]', chr(10), CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '[^n1]: once' ELSE concat('[^n1]: once', chr(10), '[^n1]: twice') END, chr(10)) AS text
FROM pages
"""
SPARK, DUCK = FILES.format(s="string"), FILES.format(s="varchar")
TOP = "(SELECT max(page_id) FROM pages)"


def files(t):
    return t.sql(SPARK)


LINKS = f"""
SELECT book_id, path, page_id, CASE k WHEN 0 THEN CAST(page_id + 15 AS varchar) || '.md#a' WHEN 1 THEN CAST(page_id + 15 AS varchar) || '.md' WHEN 2 THEN '../../../etc' WHEN 3 THEN '#a' WHEN 4 THEN 'nope.md' ELSE './' || CAST(page_id + 15 AS varchar) || '.md#zz' END AS href,
  CASE k WHEN 2 THEN NULL WHEN 3 THEN path WHEN 4 THEN 'content/nope.md' ELSE 'content/' || CAST(page_id + 15 AS varchar) || '.md' END AS target, CASE k WHEN 0 THEN 'a' WHEN 3 THEN 'a' WHEN 5 THEN 'zz' END AS fragment
FROM (SELECT *, page_id % 7 AS k FROM ({DUCK})) WHERE k < 6
"""


@query("extract_links", f"SELECT book_id, path, href, target, fragment FROM ({LINKS})")
def extract_links(t):
    return V.links(files(t))


@query("validate_links", f"""
WITH l AS (SELECT l.*, f.path IS NOT NULL AS there FROM ({LINKS}) l LEFT JOIN ({DUCK}) f ON f.book_id = l.book_id AND f.path = l.target)
SELECT book_id, CASE WHEN target IS NULL THEN 'error' ELSE 'warning' END AS severity, CASE WHEN target IS NULL THEN 'VALIDATE_LINK_ESCAPE' WHEN NOT there THEN 'VALIDATE_LINK_MISSING' ELSE 'VALIDATE_ANCHOR_MISSING' END AS code, path AS at
FROM l WHERE target IS NULL OR NOT there OR fragment = 'zz'
""")  # fmt: skip
def validate_links(t):
    return V.link_issues(files(t))


PATHS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a/../../x' WHEN 1 THEN 'a/b/../../x' WHEN 2 THEN '/abs' WHEN 3 THEN '../x/..' WHEN 4 THEN './a//./..' ELSE concat('a', chr(92), '..', chr(92), '..') END AS path FROM pages"


@query("link_escape", f"SELECT page_id, page_id % 6 IN (0, 2, 3, 5) AS escapes FROM ({PATHS})")
def link_escape(t):
    return t.sql(PATHS).select("page_id", V.escapes(F.col("path")).alias("escapes"))


@query("frontmatter_id_check", f"SELECT book_id, 'warning' AS severity, 'VALIDATE_ID_MISMATCH' AS code, path AS at FROM ({DUCK}) WHERE page_id % 6 = 5")
def frontmatter_id_check(t):
    sections = files(t).select("book_id", "path", F.concat(F.lit("sec-"), "page_id").alias("section_id"))
    return V.front_matter_mismatch(sections, files(t))


@query("footnote_missing", f"SELECT book_id, path, 'n1' AS label FROM ({DUCK}) WHERE page_id % 4 = 0")
def footnote_missing(t):
    return V.footnote_missing(files(t))


@query("footnote_duplicates", f"SELECT book_id, path, 'n1' AS label, CAST(2 AS BIGINT) AS n FROM ({DUCK}) WHERE page_id % 4 IN (2, 3)")
def footnote_duplicates(t):
    return V.footnote_duplicates(files(t))


SECTIONS = "SELECT o_custkey AS book_id, o_orderkey AS n, concat('sec-', cast(o_orderkey % 5 AS {s})) AS section_id, concat('content/', cast(o_orderkey % 7 AS {s}), '.md') AS path FROM orders"
HELD = "SELECT DISTINCT o_custkey AS book_id, concat('content/', cast(o_orderkey % 6 AS {s}), '.md') AS path FROM orders"


def spark(x):
    return x.format(s="string")


def duck(x):
    return x.format(s="varchar")


@query("validate_sections", f"SELECT s.book_id, s.n, s.path FROM ({duck(SECTIONS)}) s ANTI JOIN ({duck(HELD)}) h ON h.book_id = s.book_id AND h.path = s.path")
def validate_sections(t):
    return V.absent(t.sql(spark(SECTIONS)), t.sql(spark(HELD))).select("book_id", "n", "path")


@query("validate_dup_paths", f"SELECT book_id, n, path FROM (SELECT *, row_number() OVER (PARTITION BY book_id, path ORDER BY n) AS k FROM ({duck(SECTIONS)})) WHERE k > 1")
def validate_dup_paths(t):
    return V.repeated(t.sql(spark(SECTIONS)), ["book_id", "path"], "n").select("book_id", "n", "path")


@query("validate_dup_sections", f"SELECT book_id, n, section_id FROM (SELECT *, row_number() OVER (PARTITION BY book_id, section_id ORDER BY n) AS k FROM ({duck(SECTIONS)})) WHERE k > 1")
def validate_dup_sections(t):
    return V.repeated(t.sql(spark(SECTIONS)), ["book_id", "section_id"], "n").select("book_id", "n", "section_id")


TWICE = "SELECT page_id AS book_id, concat('content/', cast(page_id AS {s}), '.md') AS path, concat('<a id=\"a\"></a> ', repeat('<b id=\"b\">x</b>', cast(page_id % 4 AS int)), '<i id=\"a', cast(page_id % 2 AS {s}), '\">') AS text FROM pages"


@query("validate_dup_anchors", f"SELECT book_id, 'b' AS anchor, book_id % 4 - 1 AS extra FROM ({duck(TWICE)}) WHERE book_id % 4 > 1")
def validate_dup_anchors(t):
    return V.anchor_duplicates(t.sql(spark(TWICE))).groupBy("book_id", "anchor").agg(F.count(F.lit(1)).alias("extra"))


@query("validate_assets", "SELECT page_id % 15 AS book_id, 'assets/images/' || CAST(page_id AS varchar) || '.png' AS path FROM pages WHERE page_id % 3 = 1")
def validate_assets(t):
    book, path = (F.col("page_id") % 15).alias("book_id"), F.concat(F.lit("assets/images/"), "page_id", F.lit(".png")).alias("path")
    return V.absent(t["pages"].select(book, path), t["pages"].where("page_id % 3 <> 1").select(book, path))


@query("validate_toc", f"""
SELECT n.page_id, CASE WHEN f.path IS NULL THEN 'VALIDATE_TOC_MISSING' ELSE 'VALIDATE_TOC_ANCHOR_MISSING' END AS code FROM (SELECT page_id, page_id % 15 AS book_id, 'content/' || CAST(page_id + 30 * (page_id % 2) AS varchar) || '.md' AS path, page_id % 4 = 0 AS bad FROM pages) n
LEFT JOIN ({DUCK}) f ON f.book_id = n.book_id AND f.path = n.path WHERE f.path IS NULL OR n.bad
""")  # fmt: skip
def validate_toc(t):
    path = F.concat(F.lit("content/"), F.col("page_id") + 30 * (F.col("page_id") % 2), F.lit(".md"))
    nodes = t["pages"].select("page_id", (F.col("page_id") % 15).alias("book_id"), path.alias("path"), F.when(F.col("page_id") % 4 == 0, "zz").otherwise("a").alias("anchor"))
    missing = V.absent(nodes, files(t)).select("page_id", F.lit("VALIDATE_TOC_MISSING").alias("code"))
    there = nodes.join(files(t).select("book_id", "path"), ["book_id", "path"], "left_semi")
    return missing.unionByName(there.join(V.anchors(files(t)), ["book_id", "path", "anchor"], "left_anti").select("page_id", F.lit("VALIDATE_TOC_ANCHOR_MISSING").alias("code")))


JSON = """
SELECT page_id AS book_id, 'book.json' AS path, CASE page_id % 4 WHEN 0 THEN '{"id": 1, "order": 2, "path": "x", "role": "file", "sources": [], "title": "t", "type": "c"}' WHEN 1 THEN '{"id": 1, "title": "t"}' WHEN 2 THEN '{broken' ELSE '[1]' END AS text FROM pages
"""


@query("validate_json", f"SELECT book_id, path FROM ({JSON}) WHERE book_id % 4 = 2")
def validate_json(t):
    return V.json_issues(t.sql(JSON), V.SECTION_KEYS).where("code = 'VALIDATE_JSON'").select("book_id", "path")


@query("validate_schema", f"SELECT book_id, key FROM ({JSON}), (VALUES ('id'), ('order'), ('path'), ('role'), ('sources'), ('title'), ('type')) v(key) WHERE book_id % 4 = 3 OR (book_id % 4 = 1 AND key NOT IN ('id', 'title'))")
def validate_schema(t):
    return V.json_issues(t.sql(JSON), V.SECTION_KEYS).where("code = 'VALIDATE_SCHEMA'").select("book_id", "key")


@query("required_files", "SELECT c_custkey AS book_id, path AS at FROM customer, (VALUES ('book.json', 2), ('conversion-report.json', 3), ('index.md', 5), ('toc.json', 7), ('toc.md', 11)) v(path, k) WHERE c_custkey % k = 0")
def required_files(t):
    every = t["customer"].select(F.col("c_custkey").alias("book_id"), F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(k).alias("k")) for p, k in zip(V.REQUIRED_FILES, (2, 3, 5, 7, 11), strict=True)))).alias("v"))
    held = every.where(F.col("book_id") % F.col("v.k") != 0).select("book_id", "v.path")
    return V.missing_required(t["customer"].select(F.col("c_custkey").alias("book_id")), held).select("book_id", "at")


BOOKS = """
SELECT page_id AS book_id, path, text FROM (
  SELECT page_id, concat('content/', cast(page_id AS {s}), '.md') AS path, concat('---', chr(10), 'id: sec-', cast(CASE WHEN page_id % 13 = 1 THEN 0 ELSE page_id END AS {s}), chr(10), '---', chr(10), '<a id="a"></a>', CASE WHEN page_id % 13 = 2 THEN '<a id="a"></a>' ELSE '' END,
    CASE page_id % 13 WHEN 3 THEN '[x](../../x)' WHEN 4 THEN '[x](no.md)' WHEN 5 THEN '[x](#no)' WHEN 6 THEN ' [^n]' ELSE '[x](#a) ![i](../assets/images/i.png)' END) AS text FROM pages
  UNION ALL SELECT page_id, 'index.md', 'See [toc.md](toc.md)' FROM pages UNION ALL SELECT page_id, 'toc.md', '# Contents' FROM pages WHERE page_id % 11 <> 1
  UNION ALL SELECT page_id, 'assets/images/i.png', CAST(NULL AS {s}) FROM pages WHERE page_id % 11 <> 2
  UNION ALL SELECT page_id, 'conversion-report.json', CASE page_id % 11 WHEN 3 THEN '[]' WHEN 4 THEN '{{"status": "ok", "tool_version": "1", "source_validation": 1, "issues": [], "stats": {{"images_copied": 1}}}}'
    ELSE '{{"status": "ok", "tool_version": "1", "source_validation": 1, "issues": [], "stats": {{"source_documents": 1, "generated_files": 1, "images_copied": 1, "unresolved_links": 0, "assets_skipped": 0}}}}' END FROM pages
  UNION ALL SELECT page_id, 'toc.json', concat('{{"schema_version": 1, "nodes": [{{"href": null, "children": [{{"href": "', CASE page_id % 11 WHEN 5 THEN '../x' WHEN 6 THEN 'gone.md' ELSE concat('content/', cast(page_id AS {s}), '.md#', CASE page_id % 11 WHEN 7 THEN 'no' ELSE 'a' END) END, '"}}', CASE page_id % 11 WHEN 8 THEN ', 5' ELSE '' END, ']}}]}}') FROM pages
  UNION ALL SELECT page_id, 'book.json', concat(CASE WHEN page_id % 7 = 1 THEN '{{' ELSE '' END, '{{"schema_version": 1, ', CASE WHEN page_id % 7 = 2 THEN '' ELSE '"title": "t", ' END, '"conversion": {{"tool": "q"', CASE WHEN page_id % 7 = 3 THEN '' ELSE ', "tool_version": "1"' END, '}}, "assets": [{{"path": "assets/images/i.png"}}], "sections": [{{"id": "sec-',
    cast(page_id AS {s}), '", "order": 1, "type": "c", "title": "t", "role": "file", ', CASE WHEN page_id % 7 = 4 THEN '' ELSE '"sources": [], ' END, '"path": "content/', cast(page_id AS {s}), '.md"}}', CASE page_id % 7 WHEN 5 THEN concat(', {{"id": "sec-', cast(page_id AS {s}), '", "order": 2, "type": "c", "title": "u", "role": "file", "sources": [], "path": "content/gone.md"}}') WHEN 6 THEN ', "x"' ELSE '' END, ']}}') FROM pages
) f
"""
#: What each remainder of a page's number plants; what is planted in a book that has no readable manifest is not looked at.
PLANTED = """
SELECT page_id AS book_id, 'warning' AS severity, 'VALIDATE_ID_MISMATCH' AS code, s AS at FROM p WHERE page_id % 13 = 1 AND page_id % 7 <> 1
UNION ALL SELECT page_id, 'error', 'VALIDATE_DUP_ANCHOR', s FROM p WHERE page_id % 13 = 2 AND page_id % 7 <> 1
UNION ALL SELECT page_id, 'error', 'VALIDATE_LINK_ESCAPE', s FROM p WHERE page_id % 13 = 3 AND page_id % 7 <> 1
UNION ALL SELECT page_id, 'warning', 'VALIDATE_LINK_MISSING', s FROM p WHERE (page_id % 13 = 4 OR (page_id % 13 NOT IN (3, 5, 6) AND page_id % 11 = 2)) AND page_id % 7 <> 1
UNION ALL SELECT page_id, 'warning', 'VALIDATE_ANCHOR_MISSING', s FROM p WHERE page_id % 13 = 5 AND page_id % 7 <> 1
UNION ALL SELECT page_id, 'error', 'VALIDATE_FOOTNOTE_MISSING', s FROM p WHERE page_id % 13 = 6 AND page_id % 7 <> 1
UNION ALL SELECT page_id, 'error', 'VALIDATE_MISSING_FILE', 'toc.md' FROM p WHERE page_id % 11 = 1
UNION ALL SELECT page_id, 'error', 'VALIDATE_MISSING_ASSET', 'assets/images/i.png' FROM p WHERE page_id % 11 = 2 AND page_id % 7 <> 1
UNION ALL SELECT page_id, 'error', 'VALIDATE_JSON', 'conversion-report.json' FROM p WHERE page_id % 11 = 3
UNION ALL SELECT page_id, 'error', 'VALIDATE_SCHEMA', 'conversion-report.json#stats' FROM p WHERE page_id % 11 = 4
UNION ALL SELECT page_id, 'error', 'VALIDATE_TOC_ESCAPE', '../x' FROM p WHERE page_id % 11 = 5
UNION ALL SELECT page_id, 'warning', 'VALIDATE_TOC_MISSING', 'gone.md' FROM p WHERE page_id % 11 = 6
UNION ALL SELECT page_id, 'warning', 'VALIDATE_TOC_ANCHOR_MISSING', s || '#no' FROM p WHERE page_id % 11 = 7
UNION ALL SELECT page_id, 'error', 'VALIDATE_SCHEMA', 'toc.json' FROM p WHERE page_id % 11 = 8
UNION ALL SELECT page_id, 'error', 'VALIDATE_JSON', 'book.json' FROM p WHERE page_id % 7 = 1
UNION ALL SELECT page_id, 'error', 'VALIDATE_SCHEMA', 'book.json' FROM p WHERE page_id % 7 IN (2, 6)
UNION ALL SELECT page_id, 'error', 'VALIDATE_SCHEMA', 'book.json#conversion' FROM p WHERE page_id % 7 = 3
UNION ALL SELECT page_id, 'error', 'VALIDATE_SCHEMA', 'book.json#sections/sec-' || CAST(page_id AS varchar) FROM p WHERE page_id % 7 = 4
UNION ALL SELECT page_id, 'error', 'VALIDATE_DUP_SECTION', 'sec-' || CAST(page_id AS varchar) FROM p WHERE page_id % 7 = 5
UNION ALL SELECT page_id, 'error', 'VALIDATE_MISSING_SECTION', 'content/gone.md' FROM p WHERE page_id % 7 = 5
"""


@query("validate_books", f"WITH p AS (SELECT page_id, 'content/' || CAST(page_id AS varchar) || '.md' AS s FROM pages) {PLANTED}")
def validate_books(t):
    """The whole validator over books that each have some faults."""
    return V.validate(t["pages"].select(F.col("page_id").alias("book_id")), t.sql(BOOKS.format(s="string")))
