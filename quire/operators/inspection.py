"""What publications say of themselves, without converting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import settled
from ..sources import epub as E
from . import manifests as M
from . import report as R

KEY = "book_id"


def listed(rows: DataFrame, order: str, name: str, **fields: Column) -> DataFrame:
    """Rows as one list per book, in order."""
    entry = F.struct(*(c.alias(k) for k, c in fields.items()))
    gathered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e"))))
    return rows.groupBy(KEY).agg(F.transform(gathered, lambda x: x["e"]).alias(name))


def inspected(archives: DataFrame) -> DataFrame:
    """book_id, status, payload (JSON): metadata, spine, nav and NCX in pre-order, top landmarks, number of
    resources, issues. Every archive gives a row; what could not be read is null or empty."""
    members = settled(E.members(archives, media=False))
    usable = E.without_drm(members)
    rows = settled(E.packages(usable))
    items = settled(E.manifest(rows))
    nav = settled(E.navigation(usable, items))
    issues = settled(E.archive_issues(members).unionByName(E.package_issues(usable, rows, items)).unionByName(E.navigation_issues(usable, rows, items, nav)))
    package = rows.where("kind = 'package'").groupBy(KEY).agg(F.min("value").alias("epub_version"), F.min("href").alias("package_path"))
    books = members.where("pos = -1").select(KEY).distinct().withColumn("source_filename", F.substring_index(KEY, "/", -1))
    node = {"title": F.col("title"), "href": F.col("href")}
    parts = (
        package,
        E.metadata(rows).select(KEY, "title", "authors", "language"),
        listed(E.spine(rows), "pos", "spine", idref=F.col("idref"), href=F.col("href"), linear=F.col("linear")),
        listed(nav.where("tree = 'nav'"), "ord", "nav_toc", **node),
        listed(nav.where("tree = 'ncx'"), "ord", "ncx_toc", **node),
        listed(nav.where("tree = 'landmark' AND depth = 1"), "ord", "landmarks", **node, type=F.col("semantic_type")),
        items.groupBy(KEY).agg(F.count(F.lit(1)).alias("resources")),
        listed(issues, "code", "issues", severity=F.col("severity"), code=F.col("code"), message=F.col("message")),
        R.rolled_up(issues).select(KEY, "status"),
    )
    for part in parts:
        books = books.join(part, KEY, "left")
    books = books.withColumn("status", F.coalesce("status", F.lit("ok"))).withColumn("resources", F.coalesce("resources", F.lit(0)))
    for name in ("authors", "spine", "nav_toc", "ncx_toc", "landmarks", "issues"):
        books = books.withColumn(name, F.coalesce(name, F.array().cast(books.schema[name].dataType)))
    return books.select(KEY, "status", M.json_of(F.struct(*(c for c in books.columns if c != KEY))).alias("payload"))
