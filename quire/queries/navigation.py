"""Queries on navigation trees: regions, nations and customers as a tree of three levels."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..plans import sections as S

NODES = """
SELECT * FROM (
  SELECT r_regionkey % 2 AS book_id, 'nav' AS tree, cast(r_regionkey AS bigint) AS node_id, cast(-1 AS bigint) AS parent_id, r_name AS title, concat('r', cast(r_regionkey AS {s}), '.xhtml') AS href FROM region
  UNION ALL SELECT n_regionkey % 2, 'nav', cast(100 + n_nationkey AS bigint), cast(n_regionkey AS bigint), n_name, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat('r', cast(n_regionkey AS {s}), '.xhtml#n', cast(n_nationkey % 7 AS {s})) END FROM nation
  UNION ALL SELECT n_regionkey % 2, 'nav', 1000 + c_custkey, cast(100 + n_nationkey AS bigint), c_name, concat('c', cast(c_custkey % 40 AS {s}), '.xhtml', CASE WHEN c_custkey % 3 = 0 THEN '#x' ELSE '' END) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT r_regionkey % 2, 'ncx', cast(r_regionkey AS bigint), cast(-1 AS bigint), concat('ncx ', r_name), concat('r', cast(r_regionkey + 1 AS {s}), '.xhtml') FROM region
) q
"""
SPARK, DUCK = NODES.format(s="string"), NODES.format(s="varchar")
TREE = f"""
n AS (SELECT * FROM ({DUCK})),
w AS (
  SELECT book_id, tree, node_id, title, href, parent_id, CAST(1 AS BIGINT) AS depth, [node_id] AS path FROM n WHERE parent_id = -1
  UNION ALL SELECT n.book_id, n.tree, n.node_id, n.title, n.href, n.parent_id, w.depth + 1, list_append(w.path, n.node_id) FROM n JOIN w ON n.book_id = w.book_id AND n.tree = w.tree AND n.parent_id = w.node_id
)
"""


def tree(t):
    """The tree with depth and path, level by level (three levels)."""
    nodes = t.sql(SPARK)
    level = nodes.where("parent_id = -1").withColumn("depth", F.lit(1).cast("long")).withColumn("path", F.array("node_id"))
    out = level
    for _ in range(2):
        up = level.select("book_id", "tree", F.col("node_id").alias("parent_id"), "depth", "path")
        level = nodes.join(up, ["book_id", "tree", "parent_id"]).withColumn("depth", F.col("depth") + 1).withColumn("path", F.concat("path", F.array("node_id"))).select(*out.columns)
        out = out.unionByName(level)
    return out


@query("nav_tree_rows", f"WITH RECURSIVE {TREE} SELECT book_id, tree, node_id, parent_id, depth, title FROM w")
def nav_tree_rows(t):
    return tree(t).select("book_id", "tree", "node_id", "parent_id", "depth", "title")


@query("nav_flatten", f"WITH RECURSIVE {TREE} SELECT book_id, tree, node_id, row_number() OVER (PARTITION BY book_id, tree ORDER BY path) AS ord FROM w")
def nav_flatten(t):
    return S.flattened(tree(t)).select("book_id", "tree", "node_id", F.col("ord").cast("long").alias("ord"))


INFOS = f"""
{TREE}, o AS (SELECT *, row_number() OVER (PARTITION BY book_id, tree ORDER BY path) AS ord FROM w),
i AS (SELECT * FROM (
  SELECT book_id, tree, ord, title, split_part(href, '#', 1) AS path_ref, CASE WHEN instr(href, '#') > 0 THEN nullif(substr(href, instr(href, '#') + 1), '') END AS fragment,
         row_number() OVER (PARTITION BY book_id, split_part(href, '#', 1), CASE WHEN instr(href, '#') > 0 THEN nullif(substr(href, instr(href, '#') + 1), '') END ORDER BY CASE tree WHEN 'nav' THEN 0 ELSE 1 END, ord) AS n
  FROM o WHERE href <> '') WHERE n = 1)
"""


@query("nav_union_dedup", f"WITH RECURSIVE {INFOS} SELECT book_id, tree, ord, title, path_ref, fragment FROM i")
def nav_union_dedup(t):
    return S.nav_infos(S.flattened(tree(t))).select("book_id", "tree", F.col("ord").cast("long").alias("ord"), "title", "path_ref", "fragment")


@query("nav_by_path", f"WITH RECURSIVE {INFOS} SELECT book_id, path_ref, count(*) AS n, string_agg(title, ',' ORDER BY CASE tree WHEN 'nav' THEN 0 ELSE 1 END, ord) AS titles FROM i GROUP BY book_id, path_ref")
def nav_by_path(t):
    grouped = S.by_path(S.nav_infos(S.flattened(tree(t))))
    return grouped.select("book_id", "path_ref", F.size("entries").cast("long").alias("n"), F.array_join(F.transform("entries", lambda e: e["title"]), ",").alias("titles"))


@query("toc_union", f"""
WITH k AS (SELECT *, CASE WHEN href = '' THEN 't:' || title ELSE 'h:' || href END AS key FROM ({DUCK})),
u AS (SELECT k.*, coalesce(p.key, '') AS parent_key FROM k LEFT JOIN k p ON p.book_id = k.book_id AND p.tree = k.tree AND p.node_id = k.parent_id)
SELECT book_id, tree, node_id, title, parent_key FROM (SELECT *, row_number() OVER (PARTITION BY book_id, parent_key, key ORDER BY CASE tree WHEN 'nav' THEN 0 ELSE 1 END, node_id) AS n FROM u) WHERE n = 1
""")  # fmt: skip
def toc_union(t):
    return S.toc_union(t.sql(SPARK).withColumn("ord", F.col("node_id"))).select("book_id", "tree", "node_id", "title", "parent_key")


LINKS = """
SELECT page_id % 9 AS book_id, 'toc.xhtml' AS document, page_id AS ord, CASE page_id % 5 WHEN 0 THEN 'https://x.org' WHEN 1 THEN '' ELSE 'c.xhtml' END AS href,
  concat('t', cast(page_id % 6 AS {s}), '.xhtml', CASE page_id % 4 WHEN 1 THEN '#a' WHEN 2 THEN '#' ELSE '' END) AS target, CASE page_id % 7 WHEN 3 THEN ' ' ELSE 'Label' END AS text
FROM pages
"""


@query("html_toc_links", f"""
SELECT book_id, ord, path, fragment FROM (
  SELECT *, row_number() OVER (PARTITION BY book_id, path, fragment ORDER BY ord) AS n FROM (
    SELECT book_id, ord, split_part(target, '#', 1) AS path, nullif(split_part(target, '#', 2), '') AS fragment FROM ({LINKS.format(s='varchar')}) WHERE href = 'c.xhtml' AND trim(text) <> '')) WHERE n = 1
""")  # fmt: skip
def html_toc_links(t):
    return S.html_toc_links(t.sql(LINKS.format(s="string"))).select("book_id", "ord", "path", "fragment")


ITEMS = """
SELECT o_custkey AS book_id, concat('i', cast(o_orderkey % 4 AS {s}), CASE WHEN o_orderkey % 3 = 0 THEN '-toc' ELSE '' END) AS item_id,
  concat('p', cast(o_orderkey AS {s}), CASE o_orderkey % 4 WHEN 1 THEN '_contents' WHEN 2 THEN 'toc' ELSE '' END, '.xhtml') AS href
FROM orders
"""


@query("html_toc_candidate_rank", f"""
WITH s AS (SELECT *, CAST(CASE WHEN list_contains(regexp_split_to_array(lower(item_id || ' ' || href), '[^a-z0-9]+'), 'toc') THEN 2 ELSE 0 END + CASE WHEN contains(lower(item_id || ' ' || href), 'contents') THEN 1 ELSE 0 END AS INTEGER) AS score FROM ({ITEMS.format(s='varchar')}))
SELECT book_id, href, score, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, href) AS rank FROM s WHERE score > 0
""")  # fmt: skip
def html_toc_candidate_rank(t):
    return S.toc_candidates(t.sql(ITEMS.format(s="string"))).select("book_id", "href", "score", F.col("rank").cast("long").alias("rank"))
