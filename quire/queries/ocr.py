"""Queries on results of an image analyser, made from events."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import ocr as O

RESULTS = """
SELECT event_id, CASE event_id % 6
  WHEN 0 THEN '{"res": {"parsing_res_list": [{"block_label": "Doc Title", "block_content": " Head "}, {"block_label": "text", "block_content": "Body"}]}}'
  WHEN 1 THEN '{"parsing_res_list": [{"block_label": "chart", "block_content": ""}, {"block_label": "text", "block_content": "x"}]}'
  WHEN 2 THEN '{"parsing_res_list": [{"block_label": "stamp", "block_content": "x"}]}'
  WHEN 3 THEN '{"parsing_res_list": [{"block_label": "page-x", "block_content": ""}, {"block_label": "formula", "block_content": "$$ a+b $$"}]}'
  WHEN 4 THEN '{"parsing_res_list": [{"block_label": "formula", "block_content": " $c$ "}, {"block_label": "number", "block_content": "7"}, {"block_label": "table", "block_content": "<table><tr><td>1</td></tr></table>"}]}'
  ELSE '{"other": 1}' END AS json
FROM events
"""


@query("ocr_decision", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'replace' WHEN 4 THEN 'replace' ELSE 'preserve' END AS decision,
  CASE event_id % 6 WHEN 0 THEN 'markdown-representable' WHEN 1 THEN 'visual-content-present' WHEN 2 THEN 'unsupported-labels' WHEN 3 THEN 'unsupported-labels' WHEN 4 THEN 'markdown-representable' ELSE 'missing-parsing-results' END AS reason
FROM events
""")  # fmt: skip
def ocr_decision(t):
    return O.decided(O.blocks(t.sql(RESULTS))).select("event_id", "decision", "reason")


@query("ocr_blocks", """
SELECT e.event_id, v.i, v.label, v.content, v.kind FROM events e JOIN (VALUES
  (0, 0, 'doc_title', 'Head', 'text'), (0, 1, 'text', 'Body', 'text'), (1, 0, 'chart', '', 'visual'), (1, 1, 'text', 'x', 'text'), (2, 0, 'stamp', 'x', 'unknown'),
  (3, 0, 'page_x', '', 'unknown'), (3, 1, 'formula', 'a+b', 'formula'), (4, 0, 'formula', 'c', 'formula'), (4, 1, 'number', '7', 'ignored'), (4, 2, 'table', '<table><tr><td>1</td></tr></table>', 'table')
) v(k, i, label, content, kind) ON e.event_id % 6 = v.k
""")  # fmt: skip
def ocr_blocks(t):
    return O.blocks(t.sql(RESULTS)).select("event_id", F.posexplode("items").alias("i", "x")).select("event_id", "i", "x.*")


@query("image_analyser_fail_open", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'preserve' END AS decision FROM events")
def image_analyser_fail_open(t):
    """An analyser that fails keeps every image of its batch."""

    def broken(_):
        raise RuntimeError("no analyser here")

    images = t["events"].select(F.col("event_id").cast("string").alias("href"), F.lit("x").cast("binary").alias("content"))
    found = O.analysed(images, broken).where("error IS NOT NULL")
    k = F.col("href").cast("long")
    return found.select(k.alias("event_id"), F.when(k % 2 == 0, "preserve").alias("decision"))
