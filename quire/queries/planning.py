"""Queries of the planner: orders are books, their lines are the spine."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..plans import sections as S

SPINE = """
SELECT l_orderkey AS book_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS bigint) AS pos, concat('it', cast(l_partkey % 50 AS {s})) AS idref, l_suppkey % 10 <> 0 AS linear,
  CASE WHEN l_suppkey % 4 = 0 THEN cast(1 AS bigint) ELSE cast(0 AS bigint) END AS nav_entries,
  concat('t/c', CASE WHEN l_orderkey % 2 = 0 THEN '1' ELSE cast(l_suppkey % 2 AS {s}) END, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '_a' WHEN 3 THEN '_b' WHEN 4 THEN '_part4' WHEN 5 THEN '-5' ELSE '_6' END, '.xhtml') AS href
FROM lineitem
"""
MANIFEST = "SELECT o_orderkey AS book_id, concat('it', cast(o_custkey % 50 AS {s})) AS item_id, concat('x', cast(o_orderkey AS {s}), CASE o_orderkey % 4 WHEN 0 THEN '.css' ELSE '.xhtml' END) AS href, CASE o_orderkey % 4 WHEN 0 THEN 'text/css' WHEN 1 THEN 'application/xhtml+xml' ELSE 'x/y' END AS media_type FROM orders"


def spark(x):
    return x.format(s="string")


def duck(x):
    return x.format(s="varchar")


RESOLVED = f"SELECT s.book_id, s.pos, s.idref, s.linear, m.href, m.media_type FROM ({duck(SPINE)}) s LEFT JOIN ({duck(MANIFEST)}) m ON m.book_id = s.book_id AND m.item_id = s.idref"


def resolved(t):
    return S.resolved_spine(t.sql(spark(SPINE)), t.sql(spark(MANIFEST)))


@query("spine_resolve", f"SELECT book_id, pos, idref, href FROM ({RESOLVED}) WHERE href IS NOT NULL AND (media_type = 'application/xhtml+xml' OR href LIKE '%.xhtml')")
def spine_resolve(t):
    return resolved(t).where(F.col("href").isNotNull() & S.convertible(F.col("media_type"), F.col("href"))).select("book_id", "pos", "idref", "href")


@query("spine_missing", f"SELECT book_id, pos, 'error' AS severity, 'PLAN_MISSING_SPINE_ITEM' AS code FROM ({RESOLVED}) WHERE href IS NULL")
def spine_missing(t):
    return resolved(t).where("href IS NULL").select("book_id", "pos", F.lit("error").alias("severity"), F.lit("PLAN_MISSING_SPINE_ITEM").alias("code"))


@query("spine_nonlinear", f"SELECT book_id, pos, 'info' AS severity, 'PLAN_NONLINEAR' AS code FROM ({RESOLVED}) WHERE href IS NOT NULL AND NOT linear")
def spine_nonlinear(t):
    return resolved(t).where("href IS NOT NULL AND NOT linear").select("book_id", "pos", F.lit("info").alias("severity"), F.lit("PLAN_NONLINEAR").alias("code"))


@query("spine_convertible", f"SELECT book_id, item_id, media_type = 'application/xhtml+xml' OR href LIKE '%.xhtml' AS convertible FROM ({duck(MANIFEST)})")
def spine_convertible(t):
    return t.sql(spark(MANIFEST)).select("book_id", "item_id", S.convertible(F.col("media_type"), F.col("href")).alias("convertible"))


HREFS = "SELECT p_partkey, concat('d.x/', CASE p_partkey % 9 WHEN 0 THEN 'In1_b' WHEN 1 THEN 'ch-part2' WHEN 2 THEN 'ch_12' WHEN 3 THEN 'intro' WHEN 4 THEN 'partb' WHEN 5 THEN 'x_c' WHEN 6 THEN 'y-part_3' WHEN 7 THEN '12' ELSE 'a1' END, '.xhtml') AS href FROM part"
SPLIT_DUCK = "^(.+?)([_-](?:part[-_]?)?\\d+|[_-][ab]|[ab])$"


@query("split_identity", f"""
WITH s AS (SELECT p_partkey, lower(regexp_replace(split_part(href, '/', -1), '\\.[^.]*$', '')) AS stem FROM ({HREFS}))
SELECT p_partkey, CASE WHEN regexp_matches(stem, '{SPLIT_DUCK}') THEN regexp_extract(stem, '{SPLIT_DUCK}', 1) ELSE stem END AS base, regexp_extract(stem, '{SPLIT_DUCK}', 2) AS suffix FROM s
""")  # fmt: skip
def split_identity(t):
    made = S.split_identity(F.col("href"))
    return t.sql(HREFS).select("p_partkey", made["base"].alias("base"), made["suffix"].alias("suffix"))


INFOS = "SELECT l_orderkey AS book_id, concat('f', cast(l_suppkey % 3 AS {s}), '.xhtml') AS path_ref, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE concat('h', cast(l_linenumber AS {s})) END AS fragment, concat('T', cast(l_linenumber AS {s})) AS title FROM lineitem"
HEADS = "SELECT l_orderkey AS book_id, concat('f', cast(l_suppkey % 3 AS {s}), '.xhtml') AS path, concat(CASE WHEN l_quantity > 10 THEN 'h' ELSE 'other' END, cast(l_linenumber AS {s})) AS id, cast(l_linenumber AS bigint) AS ord FROM lineitem"


@query("plan_split", f"""
WITH i AS (SELECT * FROM ({duck(INFOS)})), h AS (SELECT * FROM ({duck(HEADS)})),
m AS (SELECT book_id, path_ref FROM i GROUP BY ALL HAVING count(*) > 1 AND count(fragment) = count(*)),
c AS (SELECT i.*, h.ord, count(*) OVER (PARTITION BY i.book_id, i.path_ref) AS chosen FROM i JOIN m USING (book_id, path_ref) JOIN h ON h.book_id = i.book_id AND h.path = i.path_ref AND h.id = i.fragment)
SELECT book_id, path_ref, title, fragment AS start_id, lead(fragment) OVER (PARTITION BY book_id, path_ref ORDER BY ord) AS end_id FROM c WHERE chosen > 1
""")  # fmt: skip
def plan_split(t):
    return S.split_plan(t.sql(spark(INFOS)), t.sql(spark(HEADS))).drop("place")


@query("plan_merge", f"""
WITH RECURSIVE s AS (
  SELECT *, lower(regexp_replace(split_part(href, '/', -1), '\\.[^.]*$', '')) AS stem, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS i FROM ({duck(SPINE)})
), k AS (
  SELECT book_id, pos, i, linear, nav_entries, CASE WHEN regexp_matches(stem, '{SPLIT_DUCK}') THEN regexp_extract(stem, '{SPLIT_DUCK}', 1) ELSE stem END AS base,
         regexp_replace(regexp_extract(stem, '{SPLIT_DUCK}', 2), '^[_-]+', '') AS token FROM s
), n AS (
  SELECT *, CASE WHEN token IN ('a', 'b') THEN 'letter' WHEN regexp_matches(token, '\\d') THEN 'number' END AS kind,
         CASE WHEN token IN ('a', 'b') THEN ascii(token) - 97 ELSE TRY_CAST(regexp_extract(token, '(\\d+)$', 1) AS INTEGER) END AS num FROM k
), r AS (
  SELECT book_id, i, pos, pos AS head_pos, base, kind, num, linear, nav_entries FROM n WHERE i = 1
  UNION ALL
  SELECT n.book_id, n.i, n.pos, CASE WHEN j THEN r.head_pos ELSE n.pos END, CASE WHEN j THEN r.base ELSE n.base END, CASE WHEN j THEN r.kind ELSE n.kind END,
         CASE WHEN j THEN r.num ELSE n.num END, CASE WHEN j THEN r.linear ELSE n.linear END, CASE WHEN j THEN r.nav_entries ELSE n.nav_entries END
  FROM r JOIN n ON n.book_id = r.book_id AND n.i = r.i + 1,
  LATERAL (SELECT coalesce(r.nav_entries <= 1 AND r.linear AND n.linear AND n.nav_entries = 0 AND n.base = r.base AND n.kind IS NOT NULL AND (r.kind IS NULL OR (n.kind = r.kind AND n.num = r.num + 1)), false) AS j) x
)
SELECT book_id, pos, head_pos FROM r
""")  # fmt: skip
def plan_merge(t):
    return S.merged(t.sql(spark(SPINE)))


TITLES = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Nav' WHEN 1 THEN '' END AS nav, CASE p_partkey % 5 WHEN 0 THEN 'cover' WHEN 1 THEN 'my-toc' ELSE 'id7' END AS item_id, 'a/b.xhtml' AS href, CASE p_partkey % 3 WHEN 0 THEN 'Heading' WHEN 1 THEN '' END AS heading FROM part"


@query("plan_titles", f"""
SELECT p_partkey, coalesce(nullif(nav, ''), CASE item_id WHEN 'cover' THEN 'Cover' WHEN 'my-toc' THEN 'Table of Contents' END, nullif(heading, ''), item_id) AS title FROM ({TITLES})
""")  # fmt: skip
def plan_titles(t):
    return t.sql(TITLES).select("p_partkey", S.section_title(F.col("nav"), F.col("item_id"), F.col("href"), F.col("heading")).alias("title"))


@query("section_filenames", """
WITH s AS (SELECT p_size AS book_id, p_partkey, p_name, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part), f AS (SELECT *, CASE WHEN n < 1000 THEN lpad(CAST(n AS varchar), 3, '0') ELSE CAST(n AS varchar) END AS no FROM s)
SELECT book_id, p_partkey, n AS order_no, 'sec-' || no AS section_id, 'content/' || no || '-chapter-' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS output_path FROM f
""")  # fmt: skip
def section_filenames(t):
    parts = t["part"].select(F.col("p_size").alias("book_id"), "p_partkey", F.lit("chapter").alias("kind"), "p_name")
    out = S.numbered_sections(parts, "book_id", "p_partkey", "kind", "p_name")
    return out.select("book_id", "p_partkey", F.col("order_no").cast("long").alias("order_no"), "section_id", "output_path")


