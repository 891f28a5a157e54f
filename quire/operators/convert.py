"""From archives to book directories: all stages over many publications at once.

archives -> members -> package and navigation rows -> sections -> targets and assets -> rendered
files. Everything is keyed by book_id; the only per-book barrier is the join of links to targets.
Documents are parsed where they are rendered and where ids and headings are read, never collected.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import classified
from ..functions.dom import Node, body_of, parse
from ..functions.paths import joined_path, ref_path
from ..plans import sections as S
from ..plans import targets as T
from ..runtime import settled
from ..sources import epub as E
from . import assets as A
from . import documents as D
from . import manifests as M
from . import ocr as O
from . import report as R
from . import validate as V

KEY = "book_id"


@dataclass
class Books:
    """The rows of converted publications. ``media`` (bytes of pictures) is read when assets are written."""

    metadata: DataFrame
    sections: DataFrame
    assets: DataFrame
    files: DataFrame
    issues: DataFrame
    navigation: DataFrame
    targets: DataFrame
    events: DataFrame
    media: DataFrame


def elements(documents: DataFrame) -> DataFrame:
    """Ids, headings, links and images of content documents, in document order: book_id, path, ord, kind, value, text.

    A document that cannot be read gives one row of kind ``fault``.
    """

    def rows(markup: str | None):
        for i, n in enumerate(parse(markup).elements()):
            if n.attrs.get("id"):
                yield i, "id", n.attrs["id"], None
            if n.tag in {"h1", "h2"}:
                yield i, "heading", n.attrs.get("id"), n.text().strip()
            if n.tag == "a" and n.attrs.get("href"):
                yield i, "link", n.attrs["href"], n.text().strip()
            if n.tag == "img" and n.attrs.get("src"):
                yield i, "image", n.attrs["src"], None

    keyed = documents.withColumn("k", F.struct(KEY, "path"))
    fault = lambda e: (0, "fault", f"{type(e).__name__}: {e}", None)
    made = D.per_document(keyed.withColumn("k", F.to_json("k")), "k", "html", "ord int, kind string, value string, text string", rows, fault)
    return made.withColumn("k", F.from_json("k", f"struct<{KEY}:string,path:string>")).select("k.*", "ord", "kind", "value", "text")


def plan(spine: DataFrame, items: DataFrame, nav: DataFrame, guide: DataFrame, meta: DataFrame, found: DataFrame) -> DataFrame:
    """Sections: splits of files with several chapter targets, merges of continued files, all others as they are.

    book_id, order_no, section_id, output_path, title, type, confidence, sources.
    """
    resolved = S.resolved_spine(spine, items).where("href IS NOT NULL")
    content = resolved.where(S.convertible(F.col("media_type"), F.col("href")))
    infos = S.nav_infos(S.flattened(nav.withColumn("path", F.array("node_id"))))
    headings = found.where("kind = 'heading'")
    splits = S.split_plan(infos, headings.where("value IS NOT NULL").select(KEY, "path", F.col("value").alias("id"), "ord"))
    counts = infos.groupBy(KEY, F.col("path_ref").alias("href")).agg(
        F.count(F.lit(1)).alias("nav_entries"), F.min_by("title", F.struct("rank", "ord")).alias("nav_title"), F.min_by("fragment", F.struct("rank", "ord")).alias("nav_fragment"),
        F.min_by("semantic_type", F.struct("rank", "ord")).alias("nav_type"), F.min_by("title", F.when(F.col("tree") == "ncx", F.col("ord"))).alias("ncx"),
    )
    rows = content.join(counts, [KEY, "href"], "left").withColumn("nav_entries", F.coalesce("nav_entries", F.lit(0)).cast("long")).withColumn("pos", F.col("pos").cast("long"))
    split_files = splits.select(KEY, F.col("path_ref").alias("href")).distinct()
    whole = rows.join(split_files, [KEY, "href"], "left_anti")
    heads = S.merged(rows.join(split_files.withColumn("is_split", F.lit(2).cast("long")), [KEY, "href"], "left").withColumn("nav_entries", F.coalesce("is_split", "nav_entries")))
    grouped = whole.join(heads, [KEY, "pos"]).groupBy(KEY, "head_pos").agg(F.sort_array(F.collect_list(F.struct("pos", "href"))).alias("members"))
    source = F.transform("members", lambda m: F.struct(m["href"].alias("href"), F.when(m["pos"] == F.col("head_pos"), F.col("nav_fragment")).alias("start_id"), F.lit(None).cast("string").alias("end_id")))
    plain = grouped.join(whole.withColumnRenamed("pos", "head_pos"), [KEY, "head_pos"]).withColumn("sources", source).withColumn("place", F.lit(0)).withColumn("split_title", F.lit(None).cast("string"))
    cut = splits.join(rows, (splits[KEY] == rows[KEY]) & (splits["path_ref"] == rows["href"])).drop(splits[KEY])
    cut = cut.withColumn("head_pos", F.col("pos")).withColumn("sources", F.array(F.struct("href", "start_id", "end_id"))).withColumn("split_title", F.col("title"))
    columns = [KEY, "head_pos", "place", "idref", "href", "nav_title", "nav_type", "ncx", "split_title", "sources"]
    every = settled(plain.select(*columns).unionByName(cut.select(*columns)))
    first_heading = headings.where("text <> ''").groupBy(KEY, F.col("path").alias("href")).agg(F.min_by("text", "ord").alias("heading"))
    props = items.select(KEY, F.col("item_id").alias("idref"), "properties")
    guides = guide.groupBy(KEY, ref_path(F.col("href")).alias("href")).agg(F.min_by("type", "ord").alias("guide"))
    landmarks = nav.where("tree = 'landmark' AND semantic_type IS NOT NULL").groupBy(KEY, ref_path(F.col("href")).alias("href")).agg(F.min_by("semantic_type", "ord").alias("landmark"))
    told = every.join(first_heading, [KEY, "href"], "left").join(props, [KEY, "idref"], "left").join(guides, [KEY, "href"], "left").join(landmarks, [KEY, "href"], "left")
    told = told.join(meta.select(KEY, F.col("title").alias("book_title")), KEY, "left")
    title = S.section_title(F.coalesce("split_title", "nav_title"), F.col("idref"), F.col("href"), F.col("heading"))
    told = settled(told.withColumn("title", title))

    def kind(index_before):
        return classified(
            F.col("title"), F.col("idref"), F.col("href"), F.coalesce("properties", F.array().cast("array<string>")), F.coalesce("landmark", "nav_type"),
            F.coalesce("split_title", "nav_title"), F.col("guide"), F.col("ncx"), F.col("heading"), F.coalesce("book_title", F.lit("")), index_before,
        )

    # An index part counts only after an index section, so types are found once without and once with that evidence.
    order = Window.partitionBy(KEY).orderBy("head_pos", "place")
    told = settled(told.withColumn("alone", kind(F.lit(False))["type"]))
    before = F.coalesce(F.bool_or(F.col("alone") == "index").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    told = told.withColumn("index_before", before).withColumn("made", kind(F.col("index_before"))).withColumn("type", F.col("made.type")).withColumn("confidence", F.col("made.confidence"))
    told = told.withColumn("running", F.struct("head_pos", "place"))
    return S.numbered_sections(told, KEY, "running", "type", "title").select(KEY, "order_no", "section_id", "output_path", "title", "type", "confidence", "sources")


def targets_of(sections: DataFrame, ids: DataFrame) -> DataFrame:
    """Where documents and ids went. Of a split file, the first slice is the document's target."""
    parts = sections.select(KEY, "order_no", "output_path", F.posexplode("sources").alias("i", "s"))
    first = parts.groupBy(KEY, F.col("s.href").alias("path")).agg(F.min_by("output_path", F.struct("order_no", "i")).alias("out_path"))
    whole = first.select(KEY, "path", F.lit(None).cast("string").alias("fragment"), "out_path", F.lit(None).cast("string").alias("anchor"))
    named = T.anchors(ids.join(first, [KEY, "path"], "left_semi"))
    # An id of a split file belongs to the last slice that starts at or before it.
    starts = parts.where("s.start_id IS NOT NULL").select(KEY, F.col("s.href").alias("path"), F.col("s.start_id").alias("id"), F.col("output_path").alias("slice_path"))
    placed = ids.join(starts, [KEY, "path", "id"], "left")
    running = Window.partitionBy(KEY, "path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("slice_path", F.last("slice_path", ignorenulls=True).over(running)).groupBy(KEY, "path", "id").agg(F.min_by("slice_path", "ord").alias("slice_path"))
    exact = named.join(placed, [KEY, "path", "id"]).join(first, [KEY, "path"])
    return whole.unionByName(exact.select(KEY, "path", F.col("id").alias("fragment"), F.coalesce("slice_path", "out_path").alias("out_path"), "anchor"))


def sliced(body: Node, start: str | None, end: str | None) -> Node:
    """Top-level blocks from the one that holds ``start`` up to the one that holds ``end``."""
    if not start and not end:
        return body
    holds = lambda n, name: isinstance(n, Node) and any(x.attrs.get("id") == name for x in n.elements())
    stop = next((i for i, c in enumerate(body.children) if end and holds(c, end)), len(body.children))
    begin = max((i for i, c in enumerate(body.children[:stop]) if start and holds(c, start)), default=0)
    out = Node("body", body.attrs)
    out.children = body.children[begin:stop]
    for c in out.children:
        if isinstance(c, Node):
            c.parent = out
    return out


def rendered(parts: DataFrame) -> DataFrame:
    """book_id, output_path, body: a section's documents sliced, linked, joined and rendered.

    parts: book_id, output_path, front, parts (array of what each document needs).
    """
    from ..functions.recover import recover
    from ..functions.render import normalised, render_body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for front, pieces in zip(b.column("front").to_pylist(), b.column("parts").to_pylist(), strict=True):
                whole, anchors, source = Node("body"), {}, ""
                for p in pieces or ():
                    body = sliced(body_of(parse(p["html"])), p["start_id"], p["end_id"])
                    recover(body, json.loads(p["found"] or "{}"))
                    links, images = dict(p["links"] or ()), dict(p["images"] or ())
                    for n in list(body.elements()):
                        if n.tag == "a" and n.attrs.get("href") in links:
                            if links[n.attrs["href"]] is None:
                                del n.attrs["href"]
                            else:
                                n.attrs["href"] = links[n.attrs["href"]]
                        if n.tag == "img" and images.get(n.attrs.get("src")):
                            n.attrs["src"] = images[n.attrs["src"]]
                    for c in body.children:
                        whole.children.append(c)
                        if isinstance(c, Node):
                            c.parent = whole
                    anchors = dict(p["anchors"] or ()) | anchors
                    source = source or p["path"]
                texts.append(front + render_body(whole, source, anchors, normalised))
            yield pa.RecordBatch.from_arrays([b.column("book_id"), b.column("output_path"), pa.array(texts, pa.string())], names=["book_id", "path", "text"])

    return parts.select(KEY, "output_path", "front", "parts").mapInArrow(run, "book_id string, path string, text string")


def analyses(assets: DataFrame, media: DataFrame, analyser: Callable[[dict[str, bytes]], dict[str, str]]) -> tuple[DataFrame, DataFrame]:
    """What an analyser found in eligible pictures: rows to put in their place (book_id, href, items), and issues.

    assets: book_id, href, path, media_type, is_cover.
    """
    eligible = assets.where(A.eligible_for_ocr(F.col("media_type"), F.col("href"), F.col("is_cover"), F.regexp_replace("path", r"^\.\./", "")))
    wanted = media.select(KEY, F.col("member").alias("href"), "content").join(eligible.select(KEY, "href"), [KEY, "href"])
    keyed = wanted.select(F.to_json(F.struct(KEY, "href")).alias("key"), "content")
    read = O.decided(O.blocks(O.analysed(keyed, analyser, "key", "content")))
    read = settled(read.withColumn("k", F.from_json("key", f"struct<{KEY}:string,href:string>")).select("k.*", "json", "error", "items", "decision"))
    code = F.when(F.col("error").isNotNull(), "IMAGE_ANALYSIS_FAILED").when(F.col("json").isNull(), "IMAGE_ANALYSIS_MISSING").when(F.col("decision") == "replace", "IMAGE_ANALYSIS_CANDIDATE").otherwise("IMAGE_PRESERVED")
    severity = F.when(code.isin("IMAGE_ANALYSIS_FAILED", "IMAGE_ANALYSIS_MISSING"), "warning").otherwise("info")
    issues = read.select(KEY, severity.alias("severity"), code.alias("code"), F.col("href").alias("message"))
    return read.where("decision = 'replace'").select(KEY, "href", "items"), issues


def convert(archives: DataFrame, strict: bool = False, recovered: DataFrame | None = None, analyser: Callable[[dict[str, bytes]], dict[str, str]] | None = None) -> Books:
    """Convert archives (book_id, content). Broken or protected ones give issues and no files.

    Between steps only text is kept; pictures are read from the archives again when they are written.
    recovered (book_id, href, items), as ``operators.ocr`` decides it, replaces images by what was
    found in them; an ``analyser`` is asked for it here.
    """
    members = settled(E.members(archives, media=False))
    # Pictures from the archives again; SVG and oddly named ones are among what was kept.
    media = E.members(archives, media=True).unionByName(members.where("content IS NOT NULL"))
    faults = E.archive_issues(members)
    usable = E.without_drm(members)
    present = usable.where("readable AND member IS NOT NULL").select(KEY, F.col("member").alias("href"))
    rows = settled(E.packages(usable))
    items, spine, meta, guide = settled(E.manifest(rows)), settled(E.spine(rows)), E.metadata(rows), E.guide(rows)
    package = rows.where("kind = 'package'").groupBy(KEY).agg(F.min("value").alias("epub_version"), F.min("href").alias("package_path"))
    meta = settled(meta.join(package, KEY, "left").withColumn("source_filename", F.substring_index(KEY, "/", -1)))
    every_nav = settled(E.navigation(usable, items))
    documents = usable.where("content IS NOT NULL").join(items.where(S.convertible(F.col("media_type"), F.col("href"))).select(KEY, F.col("href").alias("member")).distinct(), [KEY, "member"])
    documents = documents.select(KEY, F.col("member").alias("path"), F.decode("content", "UTF-8").alias("html"))
    found = settled(elements(documents))
    in_text = found.where("kind = 'link'").select(KEY, F.col("path").alias("document"), "ord", F.col("value").alias("href"), "text", joined_path(F.col("path"), F.col("value")).alias("target"))
    nav = every_nav.where("tree <> 'issue'")
    nav = settled(nav.unionByName(S.recovered_contents(items, in_text, nav).select(*nav.columns)))
    sections = settled(plan(spine, items, nav, guide, meta, found))
    ids = found.where("kind = 'id'").select(KEY, "path", F.col("value").alias("id"), "ord")
    targets = settled(targets_of(sections, ids))

    images = found.where("kind = 'image'").select(KEY, F.col("path").alias("source"), F.col("value").alias("src")).distinct()
    used = T.resolve_assets(images, items.select(KEY, "href", F.col("href").alias("path"))).where("href IS NOT NULL").select(KEY, F.col("href").alias("src"))
    hints = items.where(F.array_contains("properties", "cover-image")).select(KEY, F.lit(1).alias("rank"), "item_id")
    named = rows.where("kind = 'meta' AND name = 'cover'").select(KEY, F.lit(0).alias("rank"), F.col("value").alias("item_id"))
    pictures = T.resolve_assets(images, items.select(KEY, "href", F.col("item_id").alias("path"))).groupBy(KEY, F.col("source").alias("href")).agg(F.min("asset").alias("image_id"))
    page_images = items.join(pictures, [KEY, "href"]).select(KEY, "item_id", "image_id")
    cover = T.covers(items, hints.unionByName(named), guide, page_images)
    cover_files = settled(cover.join(items, [KEY, "item_id"]).select(KEY, "href"))
    chosen = settled(A.selected(used, items, cover_files))
    copied = chosen.where("decision = 'copy'")
    held = copied.join(present, [KEY, "href"], "left_semi")
    paths = A.asset_paths(held.select(KEY, "href", "item_id"))
    marked = cover_files.select(KEY, "href").distinct().withColumn("is_cover", F.lit(True))
    assets = settled(paths.join(held.select(KEY, "href", "media_type"), [KEY, "href"]).join(marked, [KEY, "href"], "left").withColumn("is_cover", F.coalesce("is_cover", F.lit(False))))
    cover_row = assets.where("is_cover").groupBy(KEY).agg(F.min(F.struct(F.regexp_replace("path", r"^\.\./", "").alias("path"), F.col("href").alias("source_href"), "media_type")).alias("cover"))
    meta = settled(meta.join(sections.select(KEY).distinct(), KEY, "left_semi").join(cover_row, KEY, "left"))

    links = found.where("kind = 'link'").select(KEY, F.col("path").alias("source"), F.col("value").alias("href")).distinct()
    where = settled(T.resolve_links(links, targets))
    shown = F.when(F.col("status") == "kept", F.col("href")).when(F.col("status") == "LINK_UNRESOLVED", "#").when(F.col("status") == "resolved", F.concat_ws("#", F.regexp_replace("out_path", "^content/", ""), "anchor"))
    link_map = where.groupBy(KEY, F.col("source").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("href", shown.alias("to")))).alias("links"))
    occurrences = settled(T.resolve_assets(images, assets))
    image_map = occurrences.where("asset IS NOT NULL").groupBy(KEY, F.col("source").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("src", "asset"))).alias("images"))
    anchor_map = targets.where("anchor IS NOT NULL").groupBy(KEY, "path").agg(F.map_from_entries(F.collect_list(F.struct("fragment", "anchor"))).alias("anchors"))

    more_issues = []
    if analyser is not None:
        recovered, told = analyses(assets, media, analyser)
        more_issues.append(told)
    if recovered is None:
        found_map = occurrences.select(KEY, F.col("source").alias("path"), F.lit("").alias("found")).where(F.lit(False))
    else:
        met = occurrences.where("asset IS NOT NULL").join(recovered.select(KEY, "href", "items"), [KEY, "href"])
        found_map = met.groupBy(KEY, F.col("source").alias("path")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("src", "items")))).alias("found"))

    parts = sections.select(KEY, "section_id", "output_path", F.posexplode("sources").alias("i", "s")).select(KEY, "output_path", "i", F.col("s.href").alias("path"), "s.start_id", "s.end_id")
    pieces = parts.join(documents, [KEY, "path"], "left").join(link_map, [KEY, "path"], "left").join(image_map, [KEY, "path"], "left").join(anchor_map, [KEY, "path"], "left").join(found_map, [KEY, "path"], "left")
    gathered = pieces.groupBy(KEY, "output_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct("path", "start_id", "end_id", "html", "links", "images", "anchors", "found").alias("part"))), lambda a, b: F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0)), lambda x: x["part"]).alias("parts"))
    source = F.transform("sources", lambda s: F.struct(F.concat_ws("#", s["href"], s["start_id"]).alias("href"), s["start_id"].alias("fragment")))
    front = D.front_matter(F.col("section_id"), F.col("title"), F.col("type"), F.col("order_no"), source)
    pages = rendered(sections.withColumn("front", front).select(KEY, "output_path", "front").join(gathered, [KEY, "output_path"]))
    pages = settled(pages)

    resolved = settled(S.resolved_spine(spine, items))
    readable = resolved.where("href IS NOT NULL").where(S.convertible(F.col("media_type"), F.col("href")))
    unresolved = where.where("status LIKE 'LINK%'")
    unread = parts.join(documents.select(KEY, "path"), [KEY, "path"], "left_anti")
    svg = usable.where("content IS NOT NULL").select(KEY, F.col("member").alias("href"), "content").join(assets.where(A.is_svg(F.col("media_type"), F.col("href"))), [KEY, "href"])
    twins = T.anchors(ids).where("anchor <> base")
    planned = spine.select(KEY).distinct().join(sections, KEY, "left_anti")
    guided = guide.where(F.lower("type").isin("cover", "other.ms-coverimage-standard") | (F.lower("title") == "cover"))
    bare = items.select(KEY).distinct().join(nav.where("tree IN ('nav', 'ncx')"), KEY, "left_anti").join(package, KEY)
    issues = faults
    for more in (
        E.package_issues(usable, rows, items),
        E.navigation_issues(usable, rows, items, every_nav),
        E.issue_rows(bare, "warning", "NAV_DEGRADED", "package_path"),
        E.issue_rows(planned, "fatal", "PLAN_NO_SECTIONS"),
        E.issue_rows(resolved.where("href IS NULL"), "error", "PLAN_MISSING_SPINE_ITEM", "idref"),
        E.issue_rows(resolved.where("href IS NOT NULL AND NOT linear"), "info", "PLAN_NONLINEAR", "href"),
        E.issue_rows(guided.join(cover_files, KEY, "left_anti"), "warning", "COVER_MISSING", "href"),
        E.issue_rows(found.where("kind = 'fault'"), "error", "RENDER_FAULT", "path"),
        E.issue_rows(unread, "error", "RENDER_MISSING_SOURCE", "path"),
        E.issue_rows(unresolved, "warning", F.col("status"), "href"),
        E.issue_rows(occurrences.where("status <> 'resolved'"), "warning", F.col("status"), "src"),
        E.issue_rows(copied.join(present, [KEY, "href"], "left_anti"), "warning", "ASSET_MISSING", "href"),
        E.issue_rows(chosen.where("decision = 'skip'"), "warning", "MEDIA_SKIPPED", "href"),
        E.issue_rows(svg.where(A.active_pieces("content") > 0), "warning", "SVG_SANITIZED", "href"),
        E.issue_rows(T.source_ids(ids).where("NOT first"), "info", "ANCHOR_SOURCE_DUP", "id"),
        E.issue_rows(twins, "info", "ANCHOR_DISAMBIGUATED", "anchor"),
        *more_issues,
    ):
        issues = issues.unionByName(more)
    issues = settled(R.strict(issues) if strict else issues)
    kind = lambda df, name: df.select(KEY, F.lit(name).alias("kind"))
    events = kind(readable, "document").unionByName(kind(sections, "file")).unionByName(kind(assets, "image")).unionByName(kind(unresolved.where("status = 'LINK_UNRESOLVED'"), "unresolved")).unionByName(kind(chosen.where("decision = 'skip'"), "skipped"))
    return Books(meta, sections, assets, pages, issues, nav, targets, settled(events), media)


def contents(books: Books) -> DataFrame:
    """book_id, markdown, json: nav united with ncx as a tree; a book without either lists its sections."""
    first = F.element_at("sources", 1)
    sections = books.sections.select(KEY, F.concat_ws("#", first["href"], first["start_id"]).alias("source"), "section_id", "type", "output_path", F.col("order_no").alias("order"), "title")
    nodes = M.toc_nodes(S.toc_union(books.navigation.where("tree IN ('nav', 'ncx')")), sections, books.targets)
    nodes = nodes.select(KEY, F.when(F.col("tree") == "nav", 0).otherwise(1).alias("rank"), "ord", "key", "parent_key", "title", "type", "section_id", "target")
    listed = sections.join(nodes.select(KEY).distinct(), KEY, "left_anti")
    listed = listed.select(KEY, F.lit(2).alias("rank"), F.col("order").alias("ord"), F.col("section_id").alias("key"), F.lit("").alias("parent_key"), "title", "type", "section_id", F.col("output_path").alias("target"))

    def tree(pdf):
        rows = pdf.sort_values(["rank", "ord"]).to_dict("records")
        for r in rows:
            r["provenance"] = "inferred" if r["rank"] == 2 else "nav+ncx"
        markdown, text = M.toc_files(rows)
        return pdf[[KEY]].iloc[:1].assign(markdown=markdown, json=text)

    return nodes.unionByName(listed).groupBy(KEY).applyInPandas(tree, "book_id string, markdown string, json string")


def book_files(books: Books) -> DataFrame:
    """All text files of book directories: book_id, path, text."""
    from ..functions.text import description_markdown

    source = F.transform("sources", lambda x: F.struct(F.concat_ws("#", x["href"], x["start_id"]).alias("href"), x["start_id"].alias("fragment")))
    listed = books.sections.select(KEY, F.col("order_no").alias("order"), "section_id", "type", "title", F.col("output_path").alias("path"), source.alias("sources"), "confidence")
    manifest = M.book_manifest(books.metadata, listed, books.assets).select(KEY, F.lit("book.json").alias("path"), F.col("book_json").alias("text"))
    made = contents(books)
    toc_md = made.select(KEY, F.lit("toc.md").alias("path"), F.col("markdown").alias("text"))
    toc_json = made.select(KEY, F.lit("toc.json").alias("path"), F.col("json").alias("text"))
    first = books.sections.groupBy(KEY).agg(F.min_by(F.struct("title", "output_path"), "order_no").alias("f"))
    index = books.metadata.join(first, KEY, "left")
    text = M.index_markdown(F.col("title"), F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", "), description_markdown(F.col("description")), F.col("cover.path"), F.col("f.title"), F.col("f.output_path"))
    index = index.select(KEY, F.lit("index.md").alias("path"), text.alias("text"))
    report = R.report_file(books.metadata, books.issues, books.events).select(KEY, F.lit("conversion-report.json").alias("path"), F.col("report_json").alias("text"))
    out = books.files
    for more in (manifest, toc_md, toc_json, index, report):
        out = out.unionByName(more)
    return out


def directory_files(books: Books) -> DataFrame:
    """All files of book directories as bytes: book_id, path, content."""
    pages = book_files(books).select(KEY, "path", F.col("text").cast("binary").alias("content"))
    return pages.unionByName(A.asset_files(books.assets, books.media))


def checked(books: Books) -> DataFrame:
    """Issues the validator finds in converted books; assets are those whose bytes the archives hold."""
    held = books.assets.select(KEY, F.regexp_replace("path", r"^\.\./", "").alias("path"), F.lit(None).cast("string").alias("text"))
    return V.validate(books.metadata.select(KEY), settled(book_files(books).unionByName(held)))
