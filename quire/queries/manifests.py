"""Queries on manifests, contents and index: customers are books, orders their sections."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import manifests as M

SECTIONS = "SELECT o_custkey AS book_id, o_orderkey AS `order`, concat('sec-', cast(o_orderkey AS string)) AS section_id, 'chapter' AS type, o_orderpriority AS title, concat('content/', cast(o_orderkey AS string), '.md') AS path FROM orders"


@query("book_manifest", """
WITH s AS (SELECT o_custkey, count(*) AS n, string_agg('sec-' || CAST(o_orderkey AS varchar), ',' ORDER BY o_orderkey) AS ids, string_agg('content/' || CAST(o_orderkey AS varchar) || '.md', ',' ORDER BY o_orderkey) AS paths, sum(o_orderkey % 10) AS tenths FROM orders GROUP BY 1),
a AS (SELECT o_custkey, string_agg(href, ',' ORDER BY href) AS held FROM (SELECT DISTINCT o_custkey, 'i/' || CAST(o_orderkey % 3 AS varchar) || '.png' AS href FROM orders) GROUP BY 1)
SELECT c_custkey AS book_id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'en' END AS language, c_mktsegment AS authors, 'urn:' || CAST(c_custkey AS varchar) AS identifiers, CASE WHEN c_custkey % 3 = 0 THEN 'i/0.png' END AS cover, '3.0' AS version, coalesce(n, 0) AS sections,
  coalesce(ids, '') AS ids, coalesce(paths, '') AS paths, CAST(coalesce(tenths, 0) AS BIGINT) AS tenths, coalesce(held, '') AS assets, 'assets,authors,conversion,cover,date,description,epub_version,identifiers,language,package_path,publisher,rights,schema_version,sections,source_filename,subtitle,title' AS keys
FROM customer LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN a ON a.o_custkey = c_custkey
""")  # fmt: skip
def book_manifest(t):
    k = F.col("c_custkey")
    cover = F.when(k % 3 == 0, F.struct(F.lit("assets/images/0.png").alias("path"), F.lit("i/0.png").alias("source_href"), F.lit("image/png").alias("media_type")))
    books = t["customer"].select(
        k.alias("book_id"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("authors"), F.when(k % 2 == 0, "en").alias("language"), F.array(F.concat(F.lit("urn:"), k)).alias("identifiers"), F.lit("3.0").alias("epub_version"), cover.alias("cover"),
    )
    sections = t.sql(SECTIONS).withColumn("confidence", (F.col("order") % 10) / 10)
    href = F.concat(F.lit("i/"), F.col("o_orderkey") % 3, F.lit(".png"))
    assets = t["orders"].select(F.col("o_custkey").alias("book_id"), href.alias("href")).distinct().withColumn("path", F.concat(F.lit("../assets/"), "href")).withColumn("media_type", F.lit("image/png"))
    made = M.book_manifest(books, sections, assets)
    read = F.from_json("book_json", "struct<title:string,language:string,authors:array<string>,identifiers:array<string>,epub_version:string,cover:struct<source_href:string>,sections:array<struct<id:string,path:string,confidence:double>>,assets:array<struct<source_href:string,path:string>>>")
    tenths = F.aggregate(read["sections"], F.lit(0).cast("long"), lambda n, x: n + F.round(x["confidence"] * 10).cast("long"))
    return made.select(
        "book_id", read["title"].alias("title"), read["language"].alias("language"), F.array_join(read["authors"], ",").alias("authors"), F.array_join(read["identifiers"], ",").alias("identifiers"), read["cover"]["source_href"].alias("cover"), read["epub_version"].alias("version"),
        F.size(read["sections"]).cast("long").alias("sections"), F.array_join(read["sections"]["id"], ",").alias("ids"), F.array_join(read["sections"]["path"], ",").alias("paths"), tenths.alias("tenths"), F.array_join(read["assets"]["source_href"], ",").alias("assets"),
        F.array_join(F.array_sort(F.json_object_keys("book_json")), ",").alias("keys"),
    )


@query("index_markdown", """
WITH f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT c_custkey AS book_id, '# ' || c_name || chr(10) || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || chr(10) || chr(10) ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || '![Cover](assets/images/c.png)' || chr(10) ELSE '' END
  || CASE WHEN k IS NULL THEN '' ELSE 'Start: [T](content/' || CAST(k AS varchar) || '.md)' || chr(10) || chr(10) END || 'See [toc.md](toc.md) for the full contents.' || chr(10) AS text
FROM customer LEFT JOIN f ON o_custkey = c_custkey
""")  # fmt: skip
def index_markdown(t):
    first = t["orders"].groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    rows = t["customer"].join(first, F.col("o_custkey") == F.col("c_custkey"), "left")
    k = F.col("c_custkey")
    path = F.concat(F.lit("content/"), "k", F.lit(".md"))
    text = M.index_markdown(F.col("c_name"), F.when(k % 2 == 0, F.col("c_mktsegment")), F.lit(None).cast("string"), F.when(k % 3 == 0, "assets/images/c.png"), F.lit("T"), path)
    return rows.select(k.alias("book_id"), text.alias("text"))


NODES = """
SELECT page_id % 12 AS book_id, page_id AS ord, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS depth, concat('Node ', cast(page_id AS {s})) AS title, CAST(NULL AS {s}) AS semantic_type,
  CASE page_id % 5 WHEN 0 THEN concat('p', cast(page_id AS {s}), '.xhtml#f') WHEN 1 THEN concat('p', cast(page_id AS {s}), '.xhtml') WHEN 2 THEN concat('p', cast(page_id - 1 AS {s}), '.xhtml#none') WHEN 3 THEN 'part.xhtml' END AS href
FROM pages
"""
PLANS = "SELECT page_id % 12 AS book_id, concat('p', cast(page_id AS {s}), '.xhtml', CASE page_id % 5 WHEN 0 THEN '#f' ELSE '' END) AS source, concat('sec-', cast(page_id AS {s})) AS section_id, 'chapter' AS type, concat('content/', cast(page_id AS {s}), '.md') AS output_path, page_id AS {o} FROM pages WHERE page_id % 5 IN (0, 1)"
MADE = """
SELECT book_id, ord, depth, title, CASE ord % 5 WHEN 0 THEN 'sec-' || CAST(ord AS varchar) WHEN 1 THEN 'sec-' || CAST(ord AS varchar) END AS section_id,
  CASE ord % 5 WHEN 0 THEN 'content/' || CAST(ord AS varchar) || '.md#src-f' WHEN 1 THEN 'content/' || CAST(ord AS varchar) || '.md' END AS target FROM (
""" + NODES.format(s="varchar") + ")"  # fmt: skip


def toc(t):
    plans = t.sql(PLANS.format(s="string", o="`order`"))
    path = F.substring_index("source", "#", 1).alias("path")
    whole = plans.select("book_id", path, F.lit(None).cast("string").alias("fragment"), F.col("output_path").alias("out_path"), F.lit(None).cast("string").alias("anchor"))
    exact = plans.where("source LIKE '%#f'").select("book_id", path, F.lit("f").alias("fragment"), F.col("output_path").alias("out_path"), F.lit("src-f").alias("anchor"))
    return M.toc_nodes(t.sql(NODES.format(s="string")), plans, whole.unionByName(exact))


@query("toc_nodes", f"SELECT book_id, ord, title, section_id, target FROM ({MADE})")
def toc_nodes(t):
    return toc(t).select("book_id", "ord", "title", "section_id", "target")


@query("toc_markdown_lines", f"SELECT book_id, ord, repeat('  ', depth - 1) || '- ' || CASE WHEN target IS NULL THEN title ELSE '[' || title || '](' || target || ')' END AS line FROM ({MADE})")
def toc_markdown_lines(t):
    return M.toc_lines(toc(t))
