"""Planning sections: navigation, spine, splits, merges, titles, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import file_stem, ref_fragment, ref_path, slug

# Media types and suffixes of content documents.
CONTENT_TYPES = ("application/xhtml+xml", "text/html", "application/xml", "text/xml")
CONTENT_SUFFIX = r"\.(xhtml|html|htm|xml)$"
# Fixed value: the suffix of a file that continues another.
SPLIT_SUFFIX = r"^(.+?)([_-](?:part[-_]?)?\d+|[_-][ab]|[ab])$"


def convertible(media_type: Column, href: Column) -> Column:
    return media_type.isin(*CONTENT_TYPES) | href.rlike(CONTENT_SUFFIX)


def flattened(nodes: DataFrame, book: str = "book_id") -> DataFrame:
    """Navigation nodes in pre-order: ord follows the path of positions from the root."""
    return nodes.withColumn("ord", F.row_number().over(Window.partitionBy(book, "tree").orderBy("path")))


def nav_infos(nodes: DataFrame, book: str = "book_id") -> DataFrame:
    """Targets of nav, then ncx: the first of each (path, fragment) stays; nodes without target go."""
    keyed = nodes.where(F.coalesce("href", F.lit("")) != "").withColumn("path_ref", ref_path(F.col("href"))).withColumn("fragment", ref_fragment(F.col("href")))
    rank = F.when(F.col("tree") == "nav", 0).otherwise(1)
    first = Window.partitionBy(book, "path_ref", "fragment").orderBy(rank, "ord")
    return keyed.where(F.col("tree").isin("nav", "ncx")).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumn("rank", rank)


def by_path(infos: DataFrame, book: str = "book_id") -> DataFrame:
    """Per file: its targets in order."""
    return infos.groupBy(book, "path_ref").agg(F.sort_array(F.collect_list(F.struct("rank", "ord", "title", "fragment"))).alias("entries"))


def resolved_spine(spine: DataFrame, manifest: DataFrame, book: str = "book_id") -> DataFrame:
    """Spine entries with their manifest items; href and media_type are null where none is found."""
    items = manifest.select(book, F.col("item_id").alias("idref"), "href", "media_type")
    return spine.select(book, "pos", "idref", "linear").join(items, [book, "idref"], "left")


def split_plan(infos: DataFrame, heading_ids: DataFrame, book: str = "book_id") -> DataFrame:
    """Slices of files that several fragments point into, all of them with fragments and more than
    one at a heading's id: start_id and end_id (the next chosen) in order of the document."""
    per_path = infos.groupBy(book, "path_ref").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("fragment").isNotNull()).alias("all_fragments"))
    many = per_path.where("n > 1 AND all_fragments").select(book, "path_ref")
    ids = heading_ids.select(F.col(book), F.col("path").alias("path_ref"), F.col("id").alias("fragment"), F.col("ord").alias("place"))
    chosen = infos.join(many, [book, "path_ref"], "left_semi").join(ids, [book, "path_ref", "fragment"])
    w = Window.partitionBy(book, "path_ref")
    chosen = chosen.withColumn("chosen", F.count(F.lit(1)).over(w)).where("chosen > 1")
    return chosen.select(book, "path_ref", "title", F.col("fragment").alias("start_id"), F.lead("fragment").over(w.orderBy("place")).alias("end_id"), "place")


def split_identity(href: Column) -> Column:
    """struct(base, suffix) of a file name; the suffix is empty if the name continues nothing."""
    stem = file_stem(href)
    suffix = F.regexp_extract(stem, SPLIT_SUFFIX, 2)
    return F.struct(F.when(suffix == "", stem).otherwise(F.regexp_extract(stem, SPLIT_SUFFIX, 1)).alias("base"), suffix.alias("suffix"))


def suffix_kind(suffix: Column) -> Column:
    """struct(kind, number) of a suffix, null if it has none."""
    token = F.regexp_replace(suffix, "^[_-]+", "")
    number = F.regexp_extract(token, r"^(?:part[-_]?)?(\d+)$", 1)
    return F.when(token.isin("a", "b"), F.struct(F.lit("letter").alias("kind"), (F.ascii(token) - 97).alias("number"))).when(
        number != "", F.struct(F.lit("number").alias("kind"), number.cast("int").alias("number"))
    )


def merged(spine: DataFrame, book: str = "book_id") -> DataFrame:
    """head_pos of every spine entry: a head absorbs the entries after it that continue it.

    spine: book, pos, href, linear, nav_entries (targets into the file). Continuation is judged
    against the head of the group, so the groups of a book are found by a fold over its spine.
    """
    identity, kind = split_identity(F.col("href")), suffix_kind(split_identity(F.col("href"))["suffix"])
    rows = spine.select(book, "pos", identity["base"].alias("base"), kind["kind"].alias("kind"), kind["number"].alias("number"), "linear", "nav_entries")
    items = F.struct("pos", "base", "kind", "number", "linear", "nav_entries")
    ordered = rows.groupBy(book).agg(F.sort_array(F.collect_list(items)).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        h = acc["head"]
        follows = (x["base"] == h["base"]) & x["kind"].isNotNull()
        next_one = h["kind"].isNull() | ((x["kind"] == h["kind"]) & (x["number"] == h["number"] + 1))
        may = acc["open"] & (h["nav_entries"] <= 1) & h["linear"] & x["linear"] & (x["nav_entries"] == 0) & follows & next_one
        joins = F.coalesce(may, F.lit(False))
        head = F.when(joins, h).otherwise(x)
        return F.struct(head.alias("head"), F.lit(True).alias("open"), F.concat(acc["out"], F.array(F.struct(x["pos"].alias("pos"), head["pos"].alias("head_pos")))).alias("out"))

    none = F.element_at("items", 1)
    start = F.struct(none.alias("head"), F.lit(False).alias("open"), F.array().cast("array<struct<pos:bigint,head_pos:bigint>>").alias("out"))
    folded = F.aggregate("items", start, step, lambda acc: acc["out"])
    return ordered.select(book, F.inline(folded))


def section_title(nav_title: Column, item_id: Column, href: Column, heading: Column) -> Column:
    """nav, then what the name says, then the first heading, then the id."""
    from ..functions.paths import name_tokens

    tokens = name_tokens(item_id, href)
    given = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(given(nav_title), F.when(F.array_contains(tokens, "cover"), "Cover"), F.when(F.array_contains(tokens, "toc"), "Table of Contents"), given(heading), item_id)


def numbered_sections(sections: DataFrame, book: str, order: str, kind: str, title: str) -> DataFrame:
    """order_no, section_id and output_path in running order."""
    n = F.row_number().over(Window.partitionBy(book).orderBy(order))
    out = sections.withColumn("order_no", n)
    return out.withColumn("section_id", F.format_string("sec-%03d", "order_no")).withColumn("output_path", F.concat(F.lit("content/"), F.format_string("%03d", "order_no"), F.lit("-"), kind, F.lit("-"), slug(F.col(title)), F.lit(".md")))


def toc_union(nodes: DataFrame, book: str = "book_id") -> DataFrame:
    """nav united with ncx, level by level: equal keys under equal parents are one node, nav's label
    and place win, new nodes follow. A node's key is its target, or its title if it has none."""
    target = F.when(F.coalesce("href", F.lit("")) == "", F.concat(F.lit("t:"), F.col("title"))).otherwise(F.concat(F.lit("h:"), F.col("href")))
    keyed = nodes.withColumn("key", target)
    parents = keyed.select(book, "tree", F.col("node_id").alias("parent_id"), F.col("key").alias("parent_key"))
    up = keyed.join(parents, [book, "tree", "parent_id"], "left").withColumn("parent_key", F.coalesce("parent_key", F.lit("")))
    first = Window.partitionBy(book, "parent_key", "key").orderBy(F.when(F.col("tree") == "nav", 0).otherwise(1), "ord")
    return up.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def html_toc_links(links: DataFrame, book: str = "book_id") -> DataFrame:
    """Contents recovered from a document's links: local, with text and target, not to itself, first of each target."""
    joined = links.where((F.col("href") != "") & (F.trim("text") != "") & ~F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"))
    joined = joined.withColumn("path", ref_path(F.col("target"))).withColumn("fragment", ref_fragment(F.col("target"))).where((F.col("path") != F.col("document")) | F.col("fragment").isNotNull())
    first = Window.partitionBy(book, "document", "path", "fragment").orderBy("ord")
    return joined.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def recovered_contents(items: DataFrame, links: DataFrame, nav: DataFrame, book: str = "book_id") -> DataFrame:
    """Nav rows for books whose navigation gave no contents: the links of their best document that holds any.

    links: book, document, ord, href, target (absolute), text.
    """
    bare = items.join(nav.where("tree = 'nav'").select(book).distinct(), book, "left_anti")
    ranked = toc_candidates(bare.where(convertible(F.col("media_type"), F.col("href"))), book).select(book, F.col("href").alias("document"), "rank")
    found = html_toc_links(links, book).join(ranked, [book, "document"])
    best = found.groupBy(book).agg(F.min("rank").alias("rank"))
    n = F.row_number().over(Window.partitionBy(book).orderBy("ord")) - 1
    rows = found.join(best, [book, "rank"]).withColumn("n", n)
    return rows.select(book, F.lit("nav").alias("tree"), F.col("n").alias("node_id"), F.lit(-1).alias("parent_id"), F.col("n").alias("ord"), F.lit(1).alias("depth"), F.trim("text").alias("title"), F.col("target").alias("href"), F.lit(None).cast("string").alias("semantic_type"))


def toc_candidates(items: DataFrame, book: str = "book_id") -> DataFrame:
    """Documents that may hold the contents: 2 for the token ``toc``, 1 for ``contents``; the best first."""
    from ..functions.paths import name_tokens

    name = F.lower(F.concat("item_id", F.lit(" "), "href"))
    score = F.when(F.array_contains(name_tokens(F.col("item_id"), F.col("href")), "toc"), 2).otherwise(0) + F.when(F.contains(name, F.lit("contents")), 1).otherwise(0)
    scored = items.withColumn("score", score).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(book).orderBy(F.desc("score"), "href")))
