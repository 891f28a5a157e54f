"""Link targets, anchors and assets of a publication as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import joined_path, link_policy, ref_fragment, ref_path, slug
from ..operators.assets import numbered


def source_ids(ids: DataFrame, book: str = "book_id") -> DataFrame:
    """``ids`` (book, path, id, ord) with first: whether a row is the first of its id in its file."""
    return ids.withColumn("first", F.row_number().over(Window.partitionBy(book, "path", "id").orderBy("ord")) == 1)


def anchors(ids: DataFrame, book: str = "book_id") -> DataFrame:
    """book, path, id, anchor: ``src-<file>-<id>`` of first ids, numbered where a book already has it."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    base = F.concat(F.lit("src-"), slug(stem, "doc"), F.lit("-"), slug(F.col("id"), "id"))
    named = source_ids(ids, book).where("first").select(book, "path", "id", "ord", base.alias("base"))
    return numbered(named, book, "ord", "base").select(book, "path", "id", "base", F.col("unique_name").alias("anchor"))


def resolve_links(links: DataFrame, targets: DataFrame, book: str = "book_id") -> DataFrame:
    """Links (book, source, href, ...) with policy, out_path and anchor.

    targets: book, path, fragment (null: the document), out_path, anchor. A link falls back from its
    fragment to the document, but a bare ``#fragment`` doesn't. Targets are joined, not broadcast by
    hand: Catalyst sees their size.
    """
    absolute = joined_path(F.col("source"), F.col("href"))
    rows = links.withColumn("policy", link_policy(F.col("href"))).withColumn("__abs", absolute)
    rows = rows.withColumn("path", ref_path(F.col("__abs"))).withColumn("fragment", ref_fragment(F.col("__abs"))).drop("__abs")
    exact = targets.where("fragment IS NOT NULL").select(book, "path", "fragment", F.col("out_path").alias("__p1"), F.col("anchor").alias("__a1"))
    whole = targets.where("fragment IS NULL").select(book, "path", F.col("out_path").alias("__p2"))
    joined = rows.join(exact, [book, "path", "fragment"], "left").join(whole, [book, "path"], "left")
    inside = F.col("policy") == "resolve"
    bare = F.col("href").startswith("#") & F.col("fragment").isNotNull()
    out = F.when(inside, F.coalesce("__p1", F.when(~bare, F.col("__p2"))))
    status = F.when(F.col("policy") == "keep", "kept").when(F.col("policy") == "drop", "LINK_SCHEME_DROPPED").when(out.isNull(), "LINK_UNRESOLVED").otherwise("resolved")
    return joined.withColumn("out_path", out).withColumn("anchor", F.when(inside, F.col("__a1"))).withColumn("status", status).drop("__p1", "__p2", "__a1")


def resolve_assets(images: DataFrame, assets: DataFrame, book: str = "book_id") -> DataFrame:
    """Images (book, source, src) with asset path and status."""
    remote = F.col("src").rlike("^(https?://|data:)")
    rows = images.withColumn("href", F.when(~remote, ref_path(joined_path(F.col("source"), F.col("src")))))
    joined = rows.join(assets.select(book, "href", F.col("path").alias("asset")), [book, "href"], "left")
    return joined.withColumn("status", F.when(remote, "ASSET_REMOTE").when(F.col("asset").isNull(), "ASSET_MISSING").otherwise("resolved"))


def resource_by_href(sources: DataFrame, resources: DataFrame, book: str = "book_id") -> DataFrame:
    """Sources with the first manifest item of their href."""
    first = Window.partitionBy(book, "href").orderBy("pos")
    unique = resources.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(book, "href", "item_id", "media_type")
    return sources.join(unique, [book, "href"], "left")


def covers(resources: DataFrame, hints: DataFrame, guide: DataFrame, page_images: DataFrame, book: str = "book_id") -> DataFrame:
    """book, item_id of the cover: by the meta hint, the property, the guide in order, then well-known ids.

    hints: book, rank (0 meta, 1 property), item_id. guide: book, ord, title, href, type.
    page_images: book, item_id (of a page), image_id (its first local image). A hint at a page means
    that page's first image.
    """
    well_known = resources.where(F.col("item_id").isin("cover", "coverimagestandard") & F.col("media_type").startswith("image/"))
    hinted = hints.select(book, F.col("rank").cast("int").alias("rank"), F.lit(0).alias("n"), "item_id")
    said = F.lower("type").isin("cover", "other.ms-coverimage-standard") | (F.lower("title") == "cover")
    first = Window.partitionBy(book, "href").orderBy("pos")
    unique = resources.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    by_guide = guide.where(said).select(book, "ord", ref_path(F.col("href")).alias("href")).join(unique.select(book, "href", "item_id"), [book, "href"])
    known = well_known.select(book, F.lit(3).alias("rank"), F.when(F.col("item_id") == "cover", 0).otherwise(1).alias("n"), "item_id")
    candidates = hinted.unionByName(by_guide.select(book, F.lit(2).alias("rank"), F.col("ord").cast("int").alias("n"), "item_id")).unionByName(known)
    typed = candidates.join(resources.select(book, "item_id", "media_type"), [book, "item_id"]).join(page_images, [book, "item_id"], "left")
    image = F.when(F.col("media_type").startswith("image/"), F.col("item_id")).when(F.col("media_type").isin("application/xhtml+xml", "text/html"), F.col("image_id"))
    found = typed.withColumn("image", image).where("image IS NOT NULL")
    return found.groupBy(book).agg(F.min_by("image", F.struct("rank", "n")).alias("item_id"))
