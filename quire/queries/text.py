"""Queries on text repairs, over whole texts. Real texts are clean, so stimuli are put in, alike in both engines."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import text as T


def stimulus(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d"


WHITE = stimulus("concat(chr(9), ' ', text, chr(10), chr(10), chr(160), ' x')")
MOJIBAKE = stimulus("concat('CafÃ© ', text, ' donâ€™t Tarâscon Â© ', cast(doc_id AS {s}))")
CAPS_MD = stimulus("concat('**T**hen ', text, ' _O_nce a*b*c ***X***yz ', cast(doc_id AS {s}))")
CAPS_HTML = stimulus("concat('<b>T</b>hen <span class=\"x dropcap\">O</span>nce <span class=\"y\">A</span>b <strong id=\"s\">Z</strong>z ', text)")
HYPHENS = stimulus("concat('inter-', chr(10), 'national pre- and PART- one Zodiac- sign a- b ', text, ' ', cast(doc_id AS {s}), ' wrap-  ped')")
BOLD = stimulus("CASE doc_id % 3 WHEN 0 THEN concat('**Title ', cast(doc_id AS {s}), '**', chr(10), chr(10), text) WHEN 1 THEN concat('**Bold**', chr(10), '## Has heading', chr(10), text) ELSE text END")
DESCRIPTION = stimulus("concat('<p>First <i>word</i> &amp; <b>more</b></p><p class=\"x\">', text, '<br/>  next   line</p><div>', cast(doc_id AS {s}), '</div>')")


def spark(text: str) -> str:
    return text.format(s="string") if "{s}" in text else text


def duck(text: str) -> str:
    return text.format(s="varchar") if "{s}" in text else text


@query("collapse_ws", f"SELECT doc_id, regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g') AS text FROM ({WHITE})")
def collapse_ws(t):
    return t.sql(WHITE).select("doc_id", T.collapsed(F.col("text")).alias("text"))


@query("repair_mojibake", f"SELECT doc_id, replace(replace(replace(text, 'Ã©', 'é'), 'â€™', '’'), 'Â©', '©') AS text FROM ({duck(MOJIBAKE)})")
def repair_mojibake(t):
    return t.sql(spark(MOJIBAKE)).select("doc_id", T.repaired(F.col("text")).alias("text"))


@query("drop_caps_md", rf"""
SELECT doc_id, regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_*])(?:\*{{1,3}}|_{{1,3}})([A-Za-z])(?:\*{{1,3}}|_{{1,3}})([A-Za-z])', '\1\2\3', 'g') AS text FROM ({duck(CAPS_MD)})
""")  # fmt: skip
def drop_caps_md(t):
    return t.sql(spark(CAPS_MD)).select("doc_id", T.drop_caps_markdown(F.col("text")).alias("text"))


@query("drop_caps_html", f"""
SELECT doc_id, replace(replace(replace(text, '<b>T</b>hen', 'Then'), '<span class="x dropcap">O</span>nce', 'Once'), '<strong id="s">Z</strong>z', 'Zz') AS text FROM ({CAPS_HTML})
""")  # fmt: skip
def drop_caps_html(t):
    return t.sql(CAPS_HTML).select("doc_id", T.drop_caps_html(F.col("text")).alias("text"))


@query("join_hyphens", """
SELECT doc_id, concat('international preand PART- one Zodiac- sign a- b ', coalesce(text, ''), ' ', CAST(doc_id AS varchar), ' wrapped') AS text FROM documents
""")  # fmt: skip
def join_hyphens(t):
    return t.sql(spark(HYPHENS)).select("doc_id", T.joined_hyphens(F.col("text")).alias("text"))


@query("promote_bold_title", f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# ' || substr(text, 3, instr(substr(text, 3), '**') - 1) || chr(10) || chr(10) || substr(text, instr(text, chr(10)) + 2) ELSE text END AS text
FROM ({duck(BOLD)})
""")  # fmt: skip
def promote_bold_title(t):
    return t.sql(spark(BOLD)).select("doc_id", T.promoted_title(F.col("text")).alias("text"))


@query("description_md", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, trim('First *word* & **more**' || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_replace(trim(body), '<[^>]*>', '', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g') || chr(10) || 'next line' || CAST(doc_id AS varchar)) AS text
FROM d
""")  # fmt: skip
def description_md(t):
    return t.sql(spark(DESCRIPTION)).select("doc_id", T.description_markdown(F.col("text")).alias("text"))
