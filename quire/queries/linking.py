"""Queries on links, anchors, assets and covers."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import assets as A
from ..operators import ocr as O
from ..plans import targets as T

LINKS = """
SELECT page_id % 20 AS book_id, page_id, concat('t/p', cast(page_id AS {s}), '.xhtml') AS source,
  CASE page_id % 8 WHEN 0 THEN concat('p', cast(page_id + 20 AS {s}), '.xhtml#a') WHEN 1 THEN '#a' WHEN 2 THEN '#none' WHEN 3 THEN concat('p', cast(page_id - 20 AS {s}), '.xhtml#zz')
    WHEN 4 THEN 'https://x.org/' WHEN 5 THEN 'javascript:x' WHEN 6 THEN '../t/missing.xhtml' ELSE concat('../t/p', cast(page_id AS {s}), '.xhtml') END AS href
FROM pages
"""
TARGETS = """
SELECT page_id % 20 AS book_id, concat('t/p', cast(page_id AS {s}), '.xhtml') AS path, CASE WHEN k = 0 THEN NULL ELSE 'a' END AS fragment,
  concat('content/', cast(page_id AS {s}), '.md') AS out_path, CASE WHEN k = 0 THEN NULL ELSE concat('src-p', cast(page_id AS {s}), '-a') END AS anchor
FROM pages, (SELECT 0 AS k UNION ALL SELECT 1 AS k) v
"""


def spark(x):
    return x.format(s="string")


def duck(x):
    return x.format(s="varchar")


@query("link_resolve", f"""
WITH l AS (SELECT *, page_id % 8 AS k FROM ({duck(LINKS)})),
a AS (SELECT *, CASE k WHEN 0 THEN 't/' || split_part(href, '#', 1) WHEN 3 THEN 't/' || split_part(href, '#', 1) WHEN 1 THEN source WHEN 2 THEN source WHEN 6 THEN 't/missing.xhtml' WHEN 7 THEN source END AS path,
       CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'a' WHEN 2 THEN 'none' WHEN 3 THEN 'zz' END AS fragment FROM l),
t AS (SELECT * FROM ({duck(TARGETS)}))
SELECT a.page_id, CASE WHEN k IN (4, 5) THEN NULL ELSE coalesce(e.out_path, CASE WHEN a.href[1] <> '#' THEN d.out_path END) END AS out_path, CASE WHEN k NOT IN (4, 5) THEN e.anchor END AS anchor,
  CASE WHEN k = 4 THEN 'kept' WHEN k = 5 THEN 'LINK_SCHEME_DROPPED' WHEN coalesce(e.out_path, CASE WHEN a.href[1] <> '#' THEN d.out_path END) IS NULL THEN 'LINK_UNRESOLVED' ELSE 'resolved' END AS status
FROM a LEFT JOIN t e ON e.book_id = a.book_id AND e.path = a.path AND e.fragment = a.fragment LEFT JOIN t d ON d.book_id = a.book_id AND d.path = a.path AND d.fragment IS NULL
""")  # fmt: skip
def link_resolve(t):
    return T.resolve_links(t.sql(spark(LINKS)), t.sql(spark(TARGETS))).select("page_id", "out_path", "anchor", "status")


IMAGES = "SELECT page_id % 20 AS book_id, page_id, concat('t/p', cast(page_id AS {s}), '.xhtml') AS source, CASE page_id % 4 WHEN 0 THEN 'https://x.org/i.png' WHEN 1 THEN concat('../img/', cast(page_id % 11 AS {s}), '.png') WHEN 2 THEN '../img/none.png' ELSE 'data:x' END AS src FROM pages"
ASSETS = "SELECT DISTINCT page_id % 20 AS book_id, concat('img/', cast(page_id % 11 AS {s}), '.png') AS href, concat('../assets/images/', cast(page_id % 11 AS {s}), '.png') AS path FROM pages"


@query("asset_resolve", f"""
SELECT i.page_id, a.path AS asset, CASE WHEN page_id % 4 IN (0, 3) THEN 'ASSET_REMOTE' WHEN a.path IS NULL THEN 'ASSET_MISSING' ELSE 'resolved' END AS status
FROM ({duck(IMAGES)}) i LEFT JOIN ({duck(ASSETS)}) a ON a.book_id = i.book_id AND i.src = '../' || a.href
""")  # fmt: skip
def asset_resolve(t):
    return T.resolve_assets(t.sql(spark(IMAGES)), t.sql(spark(ASSETS))).select("page_id", "asset", "status")


RESOURCES = "SELECT o_custkey AS book_id, o_orderkey AS pos, concat('i', cast(o_orderkey AS {s})) AS item_id, concat('f', cast(o_orderkey % 5 AS {s})) AS href, CASE o_orderkey % 3 WHEN 0 THEN 'image/png' ELSE 'application/xhtml+xml' END AS media_type FROM orders"


@query("resource_by_href", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY book_id, href ORDER BY pos) AS n FROM ({duck(RESOURCES)}))
SELECT s.c_custkey AS book_id, s.href, r.item_id FROM (SELECT c_custkey, 'f' || CAST(c_custkey % 6 AS varchar) AS href FROM customer) s LEFT JOIN r ON r.book_id = s.c_custkey AND r.href = s.href AND r.n = 1
""")  # fmt: skip
def resource_by_href(t):
    sources = t["customer"].select(F.col("c_custkey").alias("book_id"), F.concat(F.lit("f"), F.col("c_custkey") % 6).alias("href"))
    return T.resource_by_href(sources, t.sql(spark(RESOURCES))).select("book_id", "href", "item_id")


@query("cover_pick", f"""
WITH r AS (SELECT * FROM ({duck(RESOURCES)})), f AS (SELECT *, row_number() OVER (PARTITION BY book_id, href ORDER BY pos) AS n FROM r),
c AS (
  SELECT book_id, 0 AS rank, 0 AS k, 'i' || CAST(min(pos) AS varchar) AS item_id FROM r WHERE book_id % 3 = 0 GROUP BY book_id
  UNION ALL SELECT book_id, 1, 0, 'i' || CAST(max(pos) AS varchar) FROM r WHERE book_id % 4 = 0 GROUP BY book_id
  UNION ALL SELECT f.book_id, 2, CAST(g.ord AS INTEGER), f.item_id FROM f JOIN (VALUES (1, 'f3'), (2, 'f1')) g(ord, href) ON f.href = g.href AND f.n = 1
), t AS (SELECT c.*, CASE WHEN r.media_type = 'image/png' THEN c.item_id WHEN r.pos % 2 = 0 THEN 'img-' || c.item_id END AS image FROM c JOIN r ON r.book_id = c.book_id AND r.item_id = c.item_id)
SELECT book_id, arg_min(image, rank * 100 + k) AS item_id FROM t WHERE image IS NOT NULL GROUP BY book_id
""")  # fmt: skip
def cover_pick(t):
    r = t.sql(spark(RESOURCES))
    ends = r.groupBy("book_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    hints = ends.where("book_id % 3 = 0").select("book_id", F.lit(0).alias("rank"), F.concat(F.lit("i"), "a").alias("item_id"))
    hints = hints.unionByName(ends.where("book_id % 4 = 0").select("book_id", F.lit(1).alias("rank"), F.concat(F.lit("i"), "b").alias("item_id")))
    guide = ends.select("book_id", F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(h).alias("href"), F.lit(x).alias("title"), F.lit(y).alias("type")) for i, h, x, y in ((1, "f3#x", "Cover", "text"), (2, "f1", "x", "COVER"), (3, "f2", "x", "toc"))))).alias("g")).select("book_id", "g.*")
    pages = r.where("media_type <> 'image/png' AND pos % 2 = 0").select("book_id", "item_id", F.concat(F.lit("img-"), "item_id").alias("image_id"))
    return T.covers(r, hints, guide, pages)


@query("image_analysis_join", f"""
SELECT i.page_id, CASE WHEN i.page_id % 4 = 1 AND i.page_id % 11 < 6 THEN 'replace' END AS decision, CASE WHEN i.page_id % 4 <> 1 OR i.page_id % 11 >= 6 THEN 'IMAGE_ANALYSIS_MISSING' END AS code FROM ({duck(IMAGES)}) i
""")  # fmt: skip
def image_analysis_join(t):
    images = t.sql(spark(IMAGES))
    # Which images the analyser read is a property of the made-up analyses, not of the images looked up.
    found = images.where("page_id % 4 = 1 AND page_id % 11 < 6").select("book_id", "src").distinct().withColumn("decision", F.lit("replace"))
    return O.with_analyses(images, found).select("page_id", "decision", "code")


IDS = "SELECT p_size AS book_id, p_partkey AS ord, concat('d/c', cast(p_partkey % 4 AS {s}), '.xhtml') AS path, CASE p_partkey % 5 WHEN 0 THEN concat('X ', cast(p_partkey % 3 AS {s})) WHEN 1 THEN concat('x-', cast(p_partkey % 3 AS {s})) ELSE p_brand END AS id FROM part"


@query("source_id_dups", f"SELECT book_id, path, id, ord FROM (SELECT *, row_number() OVER (PARTITION BY book_id, path, id ORDER BY ord) AS n FROM ({duck(IDS)})) WHERE n > 1")
def source_id_dups(t):
    return T.source_ids(t.sql(spark(IDS))).where("NOT first").select("book_id", "path", "id", "ord")


@query("anchor_disambiguate", f"""
WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, path, id ORDER BY ord) AS n FROM ({duck(IDS)})) WHERE n = 1),
b AS (SELECT *, 'src-' || regexp_extract(path, '(c\\d+)', 1) || '-' || trim(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM f)
SELECT book_id, path, id, base || CASE WHEN k = 1 THEN '' ELSE '-' || CAST(k AS varchar) END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY book_id, base ORDER BY ord) AS k FROM b)
""")  # fmt: skip
def anchor_disambiguate(t):
    return T.anchors(t.sql(spark(IDS))).select("book_id", "path", "id", "anchor")


FILES = "SELECT p_size AS book_id, concat('d', cast(p_partkey AS {s}), '/', CASE p_partkey % 4 WHEN 0 THEN 'Big Image.PNG' WHEN 1 THEN concat('i', cast(p_partkey AS {s}), '.jpg') WHEN 2 THEN '' ELSE '???.svg' END) AS href, concat('id', cast(p_partkey % 3 AS {s})) AS item_id FROM part"


@query("asset_names", f"""
WITH n AS (SELECT *, CASE split_part(href, '/', -1) WHEN 'Big Image.PNG' THEN 'big-image.png' WHEN '' THEN item_id || '.bin' WHEN '???.svg' THEN item_id || '.svg' ELSE split_part(href, '/', -1) END AS name FROM ({duck(FILES)})),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id, name ORDER BY href) AS k FROM n)
SELECT book_id, href, '../assets/images/' || CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '\\.', '-' || CAST(k AS varchar) || '.') END AS path FROM k
""")  # fmt: skip
def asset_names(t):
    return A.asset_paths(t.sql(spark(FILES)))


@query("asset_select", """
WITH w AS (SELECT DISTINCT page_id % 10 AS book_id, page_id % 16 AS k FROM pages)
SELECT book_id, 'h' || CAST(k AS varchar) AS href, CASE WHEN k >= 12 THEN 'missing' WHEN k % 4 = 1 THEN 'skip' ELSE 'copy' END AS decision FROM w
""")  # fmt: skip
def asset_select(t):
    pages = t["pages"].select((F.col("page_id") % 10).alias("book_id"), F.concat(F.lit("h"), F.col("page_id") % 16).alias("src"), (F.col("page_id") % 3).alias("k"))
    images = pages.select("book_id", F.explode(F.array("src", F.when(F.col("k") > 1, "https://x/y.png").otherwise(F.col("src")))).alias("src"))
    types = F.array(F.lit("image/png"), F.lit("text/css"), F.lit("image/gif"), F.lit("image/svg+xml"))
    resources = pages.select("book_id").distinct().withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(11))))
    resources = resources.select("book_id", F.concat(F.lit("h"), "id").alias("href"), F.concat(F.lit("i"), "id").alias("item_id"), F.get(types, F.col("id") % 4).alias("media_type"))
    no_covers = pages.select("book_id", F.col("src").alias("href")).where(F.lit(False))
    return A.selected(images, resources, no_covers).select("book_id", "href", "decision")


@query("image_eligible", """
SELECT p_partkey, (p_partkey % 4 = 0 OR p_partkey % 6 = 1) AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS eligible FROM part
""")  # fmt: skip
def image_eligible(t):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "image/webp").otherwise("image/gif")
    href = F.when(k % 6 == 1, F.lit("a/b.JPEG")).otherwise(F.lit("a/b.gif"))
    path = F.when(k % 7 == 0, F.lit("../x.png")).otherwise(F.lit("a/x.png"))
    return t["part"].select("p_partkey", A.eligible_for_ocr(kind, href, k % 5 == 0, path).alias("eligible"))
