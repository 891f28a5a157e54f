"""Queries on pages as documents."""

from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import documents as D

BUILT = """
SELECT page_id, concat('<html><body><script>x()</script><div id="a"><h1 id="h', cast(page_id AS {s}), '">Title ', cast(page_id AS {s}), ' &amp; more</h1><p>One<br>two</p></div>',
  CASE WHEN page_id % 2 = 0 THEN '<section><h2 id="s2">Second</h2><p>Text <b>bold</b></p><iframe src="x"></iframe></section>' ELSE '' END,
  '<p id="p3">Third ', cast(page_id % 7 AS {s}), '</p><ul><li>x</li><li id="last">y</li></ul></body></html>') AS html
FROM pages
"""
SPARK, DUCK = BUILT.format(s="string"), BUILT.format(s="varchar")


@query("page_markdown")
def page_markdown(t):
    rows = D.titled_markdown(t["pages"], "page_id", "html", carry=("url",))
    title = F.coalesce("title", F.col("url"))
    order = F.format_string("sec-%03d", F.col("page_id"))
    matter = D.front_matter(order, title, F.lit("chapter"), F.col("page_id"), F.array(F.struct(F.col("url").alias("href"), F.lit(None).cast("string").alias("fragment"))))
    return rows.select("page_id", title.alias("title"), F.concat(matter, "markdown").alias("markdown"))


@query("dom_node_rows")
def dom_node_rows(t):
    return D.dom_nodes(t["pages"], "page_id", "html").select("page_id", "node_id", "parent_id", "depth", "block", "tag", "text")


@query("dom_tag_counts", """
SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(a|h1|li|article|footer)[ >]', 1)) AS tag FROM pages) GROUP BY page_id, tag
""")  # fmt: skip
def dom_tag_counts(t):
    nodes = D.dom_nodes(t["pages"], "page_id", "html")
    return nodes.where(F.col("tag").isin("a", "h1", "li", "article", "footer")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("heading_extract", f"""
SELECT page_id, CAST(1 AS INTEGER) AS level, 'h' || CAST(page_id AS varchar) AS id, 'Title ' || CAST(page_id AS varchar) || ' & more' AS text FROM ({DUCK})
UNION ALL SELECT page_id, CAST(2 AS INTEGER), 's2', 'Second' FROM ({DUCK}) WHERE page_id % 2 = 0
""")  # fmt: skip
def heading_extract(t):
    return D.headings(t.sql(SPARK), "page_id", "html").select("page_id", "level", "id", "text")


@query("heading_markdown", f"SELECT page_id, '# Title ' || CAST(page_id AS varchar) || ' & more' || chr(10) || chr(10) || 'One  ' || chr(10) || 'two' AS head FROM ({DUCK})")
def heading_markdown(t):
    text = D.markdown(t.sql(SPARK), "page_id", "html")
    return text.select("page_id", F.regexp_extract("markdown", r"(?s)\A(#.*?\n\n.*?)\n\n", 1).alias("head"))


@query("active_content_counts", f"SELECT page_id, CAST(1 + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS active FROM ({DUCK})")
def active_content_counts(t):
    return D.active_counts(D.dom_nodes(t.sql(SPARK), "page_id", "html"), "page_id")


@query("slice_blocks", f"""
SELECT page_id, section, block, tag FROM (
  SELECT page_id, 'middle' AS section, CAST(3 AS INTEGER) AS block, 'section' AS tag FROM ({DUCK}) WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, 'middle', CAST(2 AS INTEGER), 'div' FROM ({DUCK}) WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, 'middle', CAST(1 AS INTEGER), 'script' FROM ({DUCK}) WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, 'rest', CAST(b + CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER), tag FROM ({DUCK}), (VALUES (3, 'p'), (4, 'ul')) v(b, tag)
)
""")  # fmt: skip
def slice_blocks(t):
    nodes = D.dom_nodes(t.sql(SPARK), "page_id", "html")
    bounds = nodes.select("page_id").distinct().select("page_id", F.explode(F.array(
        F.struct(F.lit("middle").alias("section"), F.lit("s2").alias("start_id"), F.lit("p3").alias("end_id")),
        F.struct(F.lit("rest").alias("section"), F.lit("p3").alias("start_id"), F.lit(None).cast("string").alias("end_id")),
    )).alias("b")).select("page_id", "b.*")
    return D.sliced(nodes, "page_id", bounds).select("page_id", "section", "block", "tag")


@query("merge_blocks", f"""
SELECT page_id - page_id % 2 AS book, string_agg(text, ' | ' ORDER BY page_id) AS text FROM (SELECT page_id, 'Third ' || CAST(page_id % 7 AS varchar) AS text FROM ({DUCK})) GROUP BY 1
""")  # fmt: skip
def merge_blocks(t):
    """Blocks of consecutive documents of a book, in order of source, then place."""
    nodes = D.dom_nodes(t.sql(SPARK), "page_id", "html").where("depth = 1 AND tag = 'p'")
    book = nodes.withColumn("book", F.col("page_id") - F.col("page_id") % 2)
    return book.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "ord", "text"))), lambda x: x["text"]), " | ").alias("text"))


@query("frontmatter", """
SELECT page_id, '---' || chr(10) || 'id: sec-' || CASE WHEN page_id < 1000 THEN lpad(CAST(page_id AS varchar), 3, '0') ELSE CAST(page_id AS varchar) END || chr(10)
  || 'title: "' || replace(replace('A "quoted" ' || chr(92) || ' title', chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' || chr(10) || 'type: chapter' || chr(10) || 'order: ' || CAST(page_id AS varchar) || chr(10)
  || 'source:' || chr(10) || '  - href: "' || url || '"' || CASE WHEN page_id % 3 = 0 THEN chr(10) || '    fragment: f1' ELSE '' END || chr(10) || '---' || chr(10) || chr(10) AS frontmatter
FROM pages
""")  # fmt: skip
def frontmatter(t):
    source = F.struct(F.col("url").alias("href"), F.when(F.col("page_id") % 3 == 0, "f1").alias("fragment"))
    made = D.front_matter(F.format_string("sec-%03d", F.col("page_id")), F.lit('A "quoted" \\ title'), F.lit("chapter"), F.col("page_id"), F.array(source))
    return t["pages"].select("page_id", made.alias("frontmatter"))


NL = "chr(10)"
PARTS = f"""
'# Title ' || CAST(page_id AS varchar) || ' & more' || {NL} || {NL} || 'One  ' || {NL} || 'two' || {NL} || {NL} || CASE WHEN page_id % 2 = 0 THEN '%s## Second' || {NL} || {NL} || 'Text **bold**' || {NL} || {NL} ELSE '' END
  || 'Third ' || CAST(page_id % 7 AS varchar) || {NL} || {NL} || '- x' || {NL} || '- y' || {NL}
"""


@query("template_markdown", f"SELECT page_id, 'Title ' || CAST(page_id AS varchar) || ' & more' AS title, {PARTS.replace('%s', '')} AS markdown FROM ({DUCK})")
def template_markdown(t):
    return D.titled_markdown(t.sql(SPARK), "page_id", "html")


ODD = ((1, -1, 1, 1, "script", "x()"), (2, -1, 1, 2, "div", "T & moreOnetwo"), (3, 2, 2, 2, "h1", "T & more"), (4, 2, 2, 2, "p", "Onetwo"), (5, 4, 3, 2, "br", ""))
EVEN = ((6, -1, 1, 3, "section", "SecondText bold"), (7, 6, 2, 3, "h2", "Second"), (8, 6, 2, 3, "p", "Text bold"), (9, 8, 3, 3, "b", "bold"), (10, 6, 2, 3, "iframe", ""))
LAST = ((6, -1, 1, 3, "p", "Third k"), (7, -1, 1, 4, "ul", "xy"), (8, 7, 2, 4, "li", "x"), (9, 7, 2, 4, "li", "y"))
VALUES = lambda rows: ", ".join(map(str, rows))
TEXT = "replace(replace(text, 'T &', 'Title ' || CAST(page_id AS varchar) || ' &'), 'Third k', 'Third ' || CAST(page_id % 7 AS varchar))"


@query("template_nodes", f"""
WITH r AS (
  SELECT page_id, v.* FROM ({DUCK}), (VALUES {VALUES(ODD)}) v(node_id, parent_id, depth, block, tag, text)
  UNION ALL SELECT page_id, v.* FROM ({DUCK}), (VALUES {VALUES(EVEN)}) v(node_id, parent_id, depth, block, tag, text) WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, node_id + m, CASE parent_id WHEN -1 THEN -1 ELSE parent_id + m END, depth, block + m // 5, tag, text
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 5 ELSE 0 END AS m FROM ({DUCK})), (VALUES {VALUES(LAST)}) v(node_id, parent_id, depth, block, tag, text)
) SELECT page_id, CAST(node_id AS INTEGER) AS node_id, CAST(parent_id AS INTEGER) AS parent_id, CAST(depth AS INTEGER) AS depth, CAST(block AS INTEGER) AS block, tag, {TEXT} AS text FROM r
""")  # fmt: skip
def template_nodes(t):
    return D.dom_nodes(t.sql(SPARK), "page_id", "html").select("page_id", "node_id", "parent_id", "depth", "block", "tag", "text")


@query("page_anchors", f"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'src-p-a,src-p-s2' ELSE 'src-p-a' END AS anchors, '<a id="src-p-a"></a>' || {NL} || {NL} || {PARTS.replace('%s', '<a id="src-p-s2"></a>')} AS markdown FROM ({DUCK})
""")  # fmt: skip
def page_anchors(t):
    from ..functions.render import render

    anchored = D.per_document(t.sql(SPARK), "page_id", "html", "markdown string", lambda m: [(render(m, "p.xhtml", {"a": "src-p-a", "s2": "src-p-s2"}),)])
    return anchored.select("page_id", F.array_join(F.regexp_extract_all("markdown", F.lit('<a id="([^"]*)"></a>'), F.lit(1)), ",").alias("anchors"), "markdown")


@query("sanitize_rich", """
SELECT page_id, '<p>a <a>' || CAST(page_id AS varchar) || '</a> tail<b dir="rtl">x &lt; y</b></p><ruby>z<rt>r</rt></ruby><img src="i.png"/><a href="mailto:q@r">m</a>' AS html FROM pages
""")  # fmt: skip
def sanitize_rich(t):
    markup = F.concat(F.lit('<body><p onclick="x()" style="s">a <a href="javascript:x">'), F.col("page_id").cast("string"), F.lit('</a><script>x</script> tail<b dir="rtl">x &lt; y</b></p><applet>gone</applet><ruby onload="o">z<rt dir="up">r</rt></ruby><img src="i.png"><a href="mailto:q@r" srcdoc="s">m</a></body>'))
    return D.sanitised(t["pages"].select("page_id", markup.alias("html")), "page_id", "html")


@query("svg_sanitize", """
SELECT page_id, '<svg><g>' || CAST(page_id AS varchar) || '</g><a href="#x"/></svg>' AS svg FROM pages
""")  # fmt: skip
def svg_sanitize(t):
    from ..operators.assets import cleaned_svg

    raw = F.concat(F.lit('<svg onload="x()"><script>a\n</script><g>'), F.col("page_id").cast("string"), F.lit('</g><foreignObject><p/></foreignObject><a href="#x" xlink:href="https://e.org" handler=\'h\'/></svg>'))
    return t["pages"].select("page_id", cleaned_svg(raw.cast("binary")).cast("string").alias("svg"))


@query("footnote_render", """
SELECT page_id, 'Text [^note-r' || CAST(page_id AS varchar) || '].' || chr(10) || chr(10) || '[^note-r' || CAST(page_id AS varchar) || ']: Note ' || CAST(page_id AS varchar) || chr(10) AS markdown FROM pages
""")  # fmt: skip
def footnote_render(t):
    doc = F.concat(F.lit('<p>Text <a id="r'), F.col("page_id"), F.lit('" epub:type="noteref" href="#n">1</a>.</p><aside id="n" epub:type="footnote">Note '), F.col("page_id"), F.lit("</aside>"))
    return D.markdown(t["pages"].select("page_id", doc.alias("html")), "page_id", "html")
