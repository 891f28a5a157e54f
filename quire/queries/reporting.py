"""Queries on reports: users are books, events their issues."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import report as R

ISSUES = """
SELECT user_id AS book_id, event_id, CASE event_type WHEN 'error' THEN CASE event_id % 9 WHEN 0 THEN 'fatal' ELSE 'error' END WHEN 'click' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'debug' END AS severity,
  CASE event_id % 3 WHEN 0 THEN 'LINK_UNRESOLVED' WHEN 1 THEN 'ASSET_MISSING' ELSE 'NAV_MISSING' END AS code
FROM events
"""
RANK = "CASE severity WHEN 'fatal' THEN 5 WHEN 'error' THEN 4 WHEN 'warning' THEN 3 WHEN 'info' THEN 2 ELSE 1 END"
STATUS = f"CASE max({RANK}) WHEN 5 THEN 'fatal' WHEN 4 THEN 'completed_with_errors' WHEN 3 THEN 'completed_with_warnings' ELSE 'ok' END"


@query("report_rollup", f"SELECT book_id, count(*) AS issues, {STATUS} AS status FROM ({ISSUES}) GROUP BY book_id")
def report_rollup(t):
    return R.rolled_up(t.sql(ISSUES))


@query("exit_code", f"SELECT book_id, CASE status WHEN 'fatal' THEN 2 WHEN 'completed_with_errors' THEN 1 ELSE 0 END AS code FROM (SELECT book_id, {STATUS} AS status FROM ({ISSUES}) GROUP BY book_id)")
def exit_code(t):
    return R.rolled_up(t.sql(ISSUES)).select("book_id", R.exit_code(F.col("status")).alias("code"))


@query("strict_promotion", f"SELECT event_id, CASE WHEN severity = 'warning' AND code IN ('LINK_UNRESOLVED', 'ASSET_MISSING') THEN 'error' ELSE severity END AS severity FROM ({ISSUES})")
def strict_promotion(t):
    return R.strict(t.sql(ISSUES)).select("event_id", "severity")


SHOWN = (("plain", False, False), ("verbose", True, False), ("debug", False, True))


@query("visible_issues", f"SELECT event_id, shown FROM ({ISSUES}), (VALUES ('plain'), ('verbose'), ('debug')) v(shown) WHERE {RANK} >= 4 OR (shown = 'verbose' AND {RANK} = 3) OR (shown = 'debug' AND {RANK} < 3)")
def visible_issues(t):
    return reduce(DataFrame.unionByName, (R.visible(t.sql(ISSUES), verbose, debug).select("event_id", F.lit(name).alias("shown")) for name, verbose, debug in SHOWN))


KINDS = "SELECT user_id AS book_id, CASE event_id % 6 WHEN 0 THEN 'document' WHEN 1 THEN 'file' WHEN 2 THEN 'image' WHEN 3 THEN 'unresolved' WHEN 4 THEN 'skipped' ELSE 'x' END AS kind FROM events"


@query("conversion_stats", f"""
SELECT book_id, count(*) FILTER (WHERE kind = 'document') AS source_documents, count(*) FILTER (WHERE kind = 'file') AS generated_files, count(*) FILTER (WHERE kind = 'image') AS images_copied,
  count(*) FILTER (WHERE kind = 'unresolved') AS unresolved_links, count(*) FILTER (WHERE kind = 'skipped') AS assets_skipped FROM ({KINDS}) GROUP BY book_id
""")  # fmt: skip
def conversion_stats(t):
    return R.stats(t.sql(KINDS))
