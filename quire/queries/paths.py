"""Queries on references and paths."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import paths as P

#: References of many forms, seen from a page's path; the same text runs in both engines.
HREFS = """
SELECT page_id, base, href FROM (
  SELECT page_id, base, CASE page_id % 14
    WHEN 0 THEN concat('../', base, '#top') WHEN 1 THEN '#frag' WHEN 2 THEN 'https://x.example.org/a?b#c'
    WHEN 3 THEN '/abs/../one//two/./x.xhtml#' WHEN 4 THEN 'a%20b/./c.xhtml?q=1#s#t' WHEN 5 THEN 'mailto:x@example.org'
    WHEN 6 THEN 'ch:1.xhtml' WHEN 7 THEN '../../../../up.xhtml' WHEN 8 THEN concat('notes', chr(92), '..', chr(92), base)
    WHEN 9 THEN 'Chapter 1: Intro.xhtml' WHEN 10 THEN 'dir/sub/../../c++.html' WHEN 11 THEN 'JavaScript:alert(1)'
    WHEN 12 THEN 'a/b:c' ELSE concat('sub/', base, '/./end.html#', cast(page_id AS string)) END AS href
  FROM (SELECT page_id, concat('OEBPS/', substring(url, length(url) - 5, 6), '/text/p', cast(page_id AS string), '.xhtml') AS base FROM pages) p
) q
"""
HREFS_DUCK = HREFS.replace("AS string", "AS varchar")


@query("split_fragment", f"""
SELECT page_id, split_part(href, '#', 1) AS path,
       CASE WHEN instr(href, '#') > 0 THEN nullif(substr(href, instr(href, '#') + 1), '') END AS fragment
FROM ({HREFS_DUCK})
""")  # fmt: skip
def split_fragment(t):
    return t.sql(HREFS).select("page_id", P.ref_path(F.col("href")).alias("path"), P.ref_fragment(F.col("href")).alias("fragment"))


def fold_sql(segments: str, start: str) -> str:
    return (
        f"list_reduce(list_concat([{start}], {segments}), lambda acc, s: CASE WHEN s IN ('', '.') THEN acc "
        "WHEN s = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN acc = '' THEN s ELSE acc || '/' || s END)"
    )


NORM_SQL = fold_sql("string_split(replace({x}, chr(92), '/'), '/')", "''")


@query("posix_norm", f"SELECT page_id, {NORM_SQL.format(x='href')} AS path FROM ({HREFS_DUCK})")
def posix_norm(t):
    return t.sql(HREFS).select("page_id", P.normal_path(F.col("href")).alias("path"))


@query("posix_join", f"""
WITH h AS (
  SELECT page_id, base, href, url_decode(split_part(href, '#', 1)) AS path,
         CASE WHEN instr(href, '#') > 0 THEN nullif(substr(href, instr(href, '#') + 1), '') END AS fragment,
         list_filter(string_split(regexp_replace(base, '/[^/]*$', ''), '/'), lambda s: s <> '') AS folder
  FROM ({HREFS_DUCK})
), j AS (
  SELECT *, CASE WHEN path = '' THEN {NORM_SQL.format(x='base')} WHEN path[1] = '/' THEN {NORM_SQL.format(x='path')}
                 ELSE {fold_sql("string_split(path, '/')", "array_to_string(folder, '/')")} END AS joined FROM h
)
SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
                     WHEN fragment IS NOT NULL THEN joined || '#' || fragment ELSE joined END AS joined FROM j
""")  # fmt: skip
def posix_join(t):
    return t.sql(HREFS).select("page_id", P.joined_path(F.col("base"), F.col("href")).alias("joined"))


SCHEME_SQL = "lower(regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


@query("uri_scheme", f"SELECT page_id, {SCHEME_SQL} AS scheme FROM ({HREFS_DUCK})")
def uri_scheme(t):
    return t.sql(HREFS).select("page_id", P.uri_scheme(F.col("href")).alias("scheme"))


@query("link_scheme_policy", f"""
SELECT page_id, CASE WHEN {SCHEME_SQL} = '' THEN 'resolve' WHEN {SCHEME_SQL} IN ('http', 'https', 'mailto') THEN 'keep' ELSE 'drop' END AS policy
FROM ({HREFS_DUCK})
""")  # fmt: skip
def link_scheme_policy(t):
    return t.sql(HREFS).select("page_id", P.link_policy(F.col("href")).alias("policy"))


PAIRS = """
SELECT page_id, concat('content/', cast(page_id % 3 AS string), '/a/', cast(page_id AS string), '.md') AS source,
       CASE page_id % 4 WHEN 0 THEN concat('content/', cast(page_id % 2 AS string), '/a/b/x.md') WHEN 1 THEN 'assets/images/i.png'
            WHEN 2 THEN 'content/x.md' ELSE concat('content/', cast(page_id % 3 AS string), '/a/', cast(page_id + 1 AS string), '.md') END AS target
FROM pages
"""


@query("relative_path", f"""
WITH s AS (
  SELECT page_id, list_slice(string_split(source, '/'), 1, len(string_split(source, '/')) - 1) AS here, string_split(target, '/') AS there
  FROM ({PAIRS.replace('AS string', 'AS varchar')})
), n AS (
  SELECT *, len(list_filter(range(1, CAST(least(len(here), len(there)) AS BIGINT) + 1), lambda i: array_to_string(here[1:i], '/') = array_to_string(there[1:i], '/'))) AS same FROM s
)
SELECT page_id, repeat('../', CAST(len(here) - same AS INTEGER)) || array_to_string(there[same + 1:], '/') AS relative FROM n
""")  # fmt: skip
def relative_path(t):
    return t.sql(PAIRS).select("page_id", P.relative_path(F.col("source"), F.col("target")).alias("relative"))


URLS = """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN concat(' ', url) WHEN 1 THEN concat('java', chr(10), 'script:x') WHEN 2 THEN 'JAVASCRIPT:x'
  WHEN 3 THEN 'data:text/html,x' WHEN 4 THEN 'a/b:c' WHEN 5 THEN concat(url, chr(9)) ELSE concat(url, '/aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa', chr(9), 'x') END AS value
FROM pages
"""


@query("safe_url", f"""
WITH v AS (SELECT page_id, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS v FROM ({URLS}))
SELECT page_id, NOT regexp_matches(substr(v, 1, 32), '[\\r\\n\\t]')
   AND lower(regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'http', 'https', 'mailto') AS safe FROM v
""")  # fmt: skip
def safe_url(t):
    return t.sql(URLS).select("page_id", P.safe_url(F.col("value")).alias("safe"))


TITLES = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN concat('?? ', coalesce(text, '')) ELSE coalesce(text, '') END AS title FROM documents UNION ALL SELECT -doc_id - 1, '??' FROM documents"


@query("slugify", f"""
WITH s AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(title), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM ({TITLES}))
SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM s
""")  # fmt: skip
def slugify(t):
    return t.sql(TITLES).select("doc_id", P.slug(F.col("title")).alias("slug"))


NAMES = """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'cover' WHEN 1 THEN 'x-toc' WHEN 2 THEN 'discover' ELSE 'id1' END AS item_id,
       CASE p_partkey % 3 WHEN 0 THEN 'text/TOC.xhtml' WHEN 1 THEN 'covers/a.xhtml' ELSE concat('p', cast(p_partkey AS string), '_cover.xhtml') END AS href
FROM part
"""


@query("name_tokens", f"""
WITH n AS (SELECT p_partkey, regexp_split_to_array(lower(concat(item_id, ' ', href)), '[^a-z0-9]+') AS t FROM ({NAMES.replace('AS string', 'AS varchar')}))
SELECT p_partkey, list_contains(t, 'cover') AS cover_like, list_contains(t, 'toc') AS toc_like FROM n
""")  # fmt: skip
def name_tokens(t):
    tokens = P.name_tokens(F.col("item_id"), F.col("href"))
    return t.sql(NAMES).select("p_partkey", F.array_contains(tokens, "cover").alias("cover_like"), F.array_contains(tokens, "toc").alias("toc_like"))
