"""Queries on tables (an order's lines as cells) and notes (turns that refer to turns)."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import documents as D

ROW = "concat('<tr><td>', cast(l_partkey AS {s}), '</td><td>a|b ', cast(l_suppkey AS {s}), '</td></tr>')"
SPARK_CELLS = f"SELECT l_orderkey AS page_id, l_orderkey % 8 AS k, count(*) AS n, array_join(array_sort(collect_list({ROW.format(s='string')})), '') AS body FROM lineitem GROUP BY l_orderkey"
DUCK_CELLS = f"SELECT l_orderkey AS page_id, l_orderkey % 8 AS k, count(*) AS n, string_agg({ROW.format(s='varchar')}, '' ORDER BY {ROW.format(s='varchar')}) AS body FROM lineitem GROUP BY l_orderkey"

MARKUP = """
SELECT page_id, k, n, concat('<html><body><table>', CASE k WHEN 0 THEN '' WHEN 1 THEN '<tr><th>A</th></tr>' WHEN 2 THEN '<tr><td>A</td><td>B</td></tr>' ELSE '<tr><th>A</th><th>B</th></tr>' END,
  CASE k WHEN 0 THEN '' ELSE body END, CASE k WHEN 3 THEN '<tr><th>x</th><td>y</td></tr>' WHEN 4 THEN '<tr><td colspan="2">x</td></tr>' WHEN 5 THEN '<tr><td><p>x</p></td><td>y</td></tr>' WHEN 6 THEN '<tr><td><table><tr><td>z</td></tr></table></td><td>q</td></tr>' ELSE '' END,
  '</table></body></html>') AS html FROM ({cells}) c
"""
SPARK = MARKUP.format(cells=SPARK_CELLS)
DUCK = MARKUP.format(cells=DUCK_CELLS)


@query("table_classify", f"""
SELECT page_id, CASE k WHEN 0 THEN 'missing-rows' WHEN 1 THEN 'non-rectangular' WHEN 2 THEN 'missing-predictable-header' WHEN 3 THEN 'ambiguous-header' WHEN 4 THEN 'rowspan-or-colspan'
  WHEN 5 THEN 'non-inline-safe-cell-content' WHEN 6 THEN 'nested-table' ELSE 'rectangular-inline-safe' END AS reason FROM ({DUCK_CELLS})
""")  # fmt: skip
def table_classify(t):
    return D.tables(t.sql(SPARK), "page_id", "html").where("table_no = 0").select("page_id", "reason")


@query("table_shape", f"""
SELECT page_id, CAST(CASE k WHEN 0 THEN 0 ELSE n + 1 + CASE WHEN k IN (3, 4, 5) THEN 1 WHEN k = 6 THEN 2 ELSE 0 END END AS INTEGER) AS rows, CAST(CASE k WHEN 0 THEN 0 ELSE 2 END AS INTEGER) AS columns FROM ({DUCK_CELLS})
""")  # fmt: skip
def table_shape(t):
    return D.tables(t.sql(SPARK), "page_id", "html").where("table_no = 0").select("page_id", "rows", "columns")


CELLS = "'<tr><td>' || CAST(l_partkey AS varchar) || '</td><td>a|b ' || CAST(l_suppkey AS varchar) || '</td></tr>'"
PIPES = "'| ' || CAST(l_partkey AS varchar) || ' | a\\|b ' || CAST(l_suppkey AS varchar) || ' |'"


@query("gfm_table", f"""
WITH r AS (SELECT l_orderkey AS page_id, l_orderkey % 8 AS k, string_agg({CELLS}, '' ORDER BY {CELLS}) AS body, string_agg({PIPES}, chr(10) ORDER BY {CELLS}) AS lines FROM lineitem GROUP BY l_orderkey)
SELECT page_id, CASE k WHEN 7 THEN '| A | B |' || chr(10) || '| --- | --- |' || chr(10) || lines
  ELSE '<table>' || CASE k WHEN 0 THEN '' WHEN 1 THEN '<tr><th>A</th></tr>' WHEN 2 THEN '<tr><td>A</td><td>B</td></tr>' ELSE '<tr><th>A</th><th>B</th></tr>' END || CASE k WHEN 0 THEN '' ELSE body END
    || CASE k WHEN 3 THEN '<tr><th>x</th><td>y</td></tr>' WHEN 4 THEN '<tr><td colspan="2">x</td></tr>' WHEN 5 THEN '<tr><td><p>x</p></td><td>y</td></tr>' WHEN 6 THEN '<tr><td><table><tr><td>z</td></tr></table></td><td>q</td></tr>' ELSE '' END || '</table>' END || chr(10) AS markdown FROM r
""")  # fmt: skip
def gfm_table(t):
    """Every order's table: the rectangular ones as pipes, the other shapes as markup."""
    return D.markdown(t.sql(SPARK), "page_id", "html")


NOTES = """
SELECT conv_id * 100 + turn AS page_id, conv_id, turn, concat('<html><body><p>x <a id="r', cast(turn AS {s}), '" epub:type="noteref" href="', CASE turn % 5 WHEN 3 THEN 'other.xhtml' ELSE '' END, '#', CASE turn % 5 WHEN 4 THEN 'gone' ELSE 'n1' END, '">1</a>',
  CASE turn % 5 WHEN 1 THEN '<a id="q" role="doc-noteref" href="#n1">2</a>' ELSE '' END, '</p><aside id="n1" epub:type="footnote">', CASE turn % 5 WHEN 2 THEN '<p>Block</p>' ELSE 'Plain' END, '</aside></body></html>') AS html
FROM conversations
"""


@query("note_classify", """
SELECT conv_id * 100 + turn AS page_id, 'r' || CAST(turn AS varchar) AS reference, CASE turn % 5 WHEN 0 THEN 'simple_local' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'complex' WHEN 3 THEN 'cross_document' ELSE 'ambiguous' END AS class FROM conversations
UNION ALL SELECT conv_id * 100 + turn, 'q', 'ambiguous' FROM conversations WHERE turn % 5 = 1
""")  # fmt: skip
def note_classify(t):
    return D.notes(t.sql(NOTES.format(s="string")), "page_id", "html").select("page_id", "reference", "class")


@query("note_tokens", """
SELECT conv_id, turn, role <> 'user' OR turn % 3 = 0 AS is_note FROM conversations
""")  # fmt: skip
def note_tokens(t):
    from ..functions.markup import NOTE_DEFINITIONS

    words = F.split(F.lower(F.concat(F.when(F.col("role") == "user", "bodymatter").otherwise("x FootNote"), F.lit(" "), F.when(F.col("turn") % 3 == 0, "doc-endnote").otherwise("y"))), r"\s+")
    return t["conversations"].select("conv_id", "turn", F.arrays_overlap(words, F.array(*map(F.lit, sorted(NOTE_DEFINITIONS)))).alias("is_note"))


LABELS = "SELECT page_id, concat('Text/Chapter 1%_', cast(page_id AS {s}), '.XHTML') AS source, CASE page_id % 3 WHEN 0 THEN 'N_01' WHEN 1 THEN 'fn--x' ELSE concat('long', repeat('abc', 30)) END AS identity FROM pages"


@query("footnote_label", f"""
WITH v AS (SELECT page_id, replace(lower(source || '--' || identity), '%', ' percent ') AS v FROM ({LABELS.format(s='varchar')}))
SELECT page_id, 'note-' || substr(array_to_string(regexp_extract_all(v, '[a-z0-9]+(?:-[a-z0-9]+)*'), '-'), 1, 80) AS label FROM v
""")  # fmt: skip
def footnote_label(t):
    value = F.replace(F.lower(F.concat("source", F.lit("--"), "identity")), F.lit("%"), F.lit(" percent "))
    words = F.array_join(F.regexp_extract_all(value, F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0)), "-")
    return t.sql(LABELS.format(s="string")).select("page_id", F.concat(F.lit("note-"), F.substring(words, 1, 80)).alias("label"))
