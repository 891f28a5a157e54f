"""From archives to checked book directories."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from quire.operators import convert as C
from quire.operators import manifests as M
from quire.operators import validate as V
from quire.sources import bookdir
from quire.sources import epub as E

NAV = '<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{}</ol></nav></body></html>'


def book(chapters, nav, spine=None, extra=(), title="A Book", drm=False):
    out = io.BytesIO()
    items = "".join(f'<item id="{i}" href="{h}" media-type="application/xhtml+xml"/>' for i, h, _ in chapters)
    items += "".join(f'<item id="{i}" href="{h}" media-type="{m}"{p}/>' for i, h, m, p, _ in extra)
    refs = "".join(f'<itemref idref="{i}"/>' for i in spine or [c[0] for c in chapters])
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="EPUB/content.opf"/></rootfiles></container>')
        z.writestr("EPUB/content.opf", f'<package version="3.0"><metadata><title>{title}</title><creator>Ann</creator></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{refs}</spine></package>')
        z.writestr("EPUB/nav.xhtml", NAV.format("".join(f'<li><a href="{h}">{t}</a></li>' for t, h in nav)))
        for _, h, body in chapters:
            z.writestr(f"EPUB/{h}", f"<html><body>{body}</body></html>")
        for _, h, _, _, content in extra:
            z.writestr(f"EPUB/{h}", content)
        if drm:
            z.writestr("META-INF/encryption.xml", "x")
    return out.getvalue()


def converted(spark, books, **options):
    rows = [(k, bytearray(v)) for k, v in books.items()]
    return C.convert(spark.createDataFrame(rows, "book_id string, content binary"), **options)


def texts(made):
    return {(r["book_id"], r["path"]): r["text"] for r in C.book_files(made).collect()}


def test_books_become_checked_directories(spark, tmp_path):
    one = book(
        [("ch1", "ch1.xhtml", '<h1 id="here">Chapter 1</h1><p>See <a href="ch2.xhtml#there">next</a>, <a href="gone.xhtml">lost</a>, <a href="javascript:x">bad</a>.</p><img src="i/p.png" alt="p"/>'), ("ch2", "ch2.xhtml", '<h1>Two</h1><p id="there">Here. <a href="ch1.xhtml">back</a></p>')],
        [("Chapter 1", "ch1.xhtml"), ("Two", "ch2.xhtml")],
        extra=[("pic", "i/p.png", "image/png", ' properties="cover-image"', b"png"), ("css", "s.css", "text/css", "", b"")],
    )
    made = converted(spark, {"one": one, "bad": b"nothing", "locked": book([("a", "a.xhtml", "x")], [], drm=True)})
    files = texts(made)
    first = files["one", "content/001-chapter-chapter-1.md"]
    assert '<a id="src-ch1-here"></a># Chapter 1' in first
    assert "[next](002-chapter-two.md#src-ch2-there)" in first and "[lost](#)" in first and "javascript" not in first
    assert "![p](../assets/images/p.png)" in first
    assert "[back](001-chapter-chapter-1.md)" in files["one", "content/002-chapter-two.md"]
    assert {b for b, _ in files} == {"one"}
    told = json.loads(files["one", "book.json"])
    assert told["authors"] == ["Ann"] and told["epub_version"] == "3.0" and told["package_path"] == "EPUB/content.opf" and told["subtitle"] is None
    assert told["cover"] == {"path": "assets/images/p.png", "source_href": "EPUB/i/p.png", "media_type": "image/png"}
    assert told["assets"] == [{"source_href": "EPUB/i/p.png", "path": "assets/images/p.png", "media_type": "image/png"}]
    assert told["sections"][0]["sources"] == [{"href": "EPUB/ch1.xhtml", "fragment": None}] and told["conversion"]["tool"] == "quire"
    assert "\n![Cover](assets/images/p.png)\n" in files["one", "index.md"]
    report = json.loads(files["one", "conversion-report.json"])
    assert report["stats"] == {"source_documents": 2, "generated_files": 2, "images_copied": 1, "unresolved_links": 1, "assets_skipped": 0}
    assert report["status"] == "completed_with_warnings" and {x["code"] for x in report["issues"]} == {"LINK_UNRESOLVED", "LINK_SCHEME_DROPPED"}
    codes = {(r["book_id"], r["code"]) for r in made.issues.collect()}
    assert {("bad", "INGEST_NOT_ZIP"), ("locked", "INGEST_DRM"), ("one", "LINK_UNRESOLVED"), ("one", "LINK_SCHEME_DROPPED")} <= codes
    toc = json.loads(files["one", "toc.json"])
    assert [(n["title"], n["section_id"], n["provenance"]) for n in toc["nodes"]] == [("Chapter 1", "sec-001", "nav+ncx"), ("Two", "sec-002", "nav+ncx")]
    assert files["one", "toc.md"] == "# Contents\n\n- [Chapter 1](content/001-chapter-chapter-1.md)\n- [Two](content/002-chapter-two.md)\n"
    assert C.checked(made).collect() == []
    written = bookdir.write_directories(C.directory_files(made), str(tmp_path))
    assert written.agg(F.count("*")).first()[0] == len(files) + 1
    back = {(r["book_id"], r["path"]): r["text"] for r in bookdir.read_directories(spark, str(tmp_path)).collect()}
    assert back == files
    assert (tmp_path / "one" / "assets" / "images" / "p.png").read_bytes() == b"png"
    read = bookdir.read_directories(spark, str(tmp_path), everything=True)
    assert V.validate(read.select("book_id").distinct(), read).collect() == []
    (tmp_path / "one" / "assets" / "images" / "p.png").unlink()
    again = bookdir.read_directories(spark, str(tmp_path), everything=True)
    codes = {r["code"] for r in V.validate(again.select("book_id").distinct(), again).collect()}
    assert codes == {"VALIDATE_MISSING_ASSET", "VALIDATE_LINK_MISSING"}


def test_assets_are_chosen_cleaned_and_named(spark):
    svg = b'<svg onload="x()"><script>y()</script><rect/></svg>'
    one = book(
        [("c", "c.xhtml", '<h1>A</h1><img src="a/x.png"/><img src="b/x.png"/><img src="v.svg"/><img src="m.mp4"/><img src="gone.png"/><img src="https://e.org/r.png"/>')],
        [("A", "c.xhtml")],
        extra=[("i1", "a/x.png", "image/png", "", b"one"), ("i2", "b/x.png", "image/png", "", b"two"), ("v", "v.svg", "image/svg+xml", "", svg), ("m", "m.mp4", "video/mp4", "", b"film")],
    )
    broken = bytearray(one)
    at = broken.index(b"two")
    broken[at : at + 3] = b"TWO"  # its checksum no longer fits
    made = converted(spark, {"one": one, "hurt": bytes(broken)})
    held = {(r["book_id"], r["path"]): bytes(r["content"]) for r in C.directory_files(made).where("path LIKE 'assets/%'").collect()}
    assert held["one", "assets/images/x.png"] == b"one" and held["one", "assets/images/x-2.png"] == b"two"
    assert held["one", "assets/images/v.svg"] == b"<svg><rect/></svg>" and ("one", "assets/images/m.mp4") not in held
    codes = sorted((r["code"], r["message"]) for r in made.issues.where("book_id = 'one'").collect())
    assert codes == [("ASSET_MISSING", "gone.png"), ("ASSET_MISSING", "m.mp4"), ("ASSET_REMOTE", "https://e.org/r.png"), ("MEDIA_SKIPPED", "EPUB/m.mp4"), ("SVG_SANITIZED", "EPUB/v.svg")]
    assert held["hurt", "assets/images/x.png"] == b"one" and ("hurt", "assets/images/x-2.png") not in held  # a damaged member takes no other with it
    assert ("ASSET_MISSING", "EPUB/b/x.png") in {(r["code"], r["message"]) for r in made.issues.where("book_id = 'hurt'").collect()}


def raw(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_books_that_cannot_be_read_say_why(spark):
    container = '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>'
    empty = "<package><manifest/><spine/></package>"
    text_only = '<package version="2.0"><manifest><item id="t" href="t.txt" media-type="text/plain"/></manifest><spine><itemref idref="t"/></spine></package>'
    books = {
        "a": raw(x="1"), "b": raw(**{"META-INF__container_dot_xml": "<container/>"}), "c": raw(**{"META-INF__container_dot_xml": container}),
        "d": raw(**{"META-INF__container_dot_xml": container, "p_dot_opf": empty}), "e": raw(**{"META-INF__container_dot_xml": container, "p_dot_opf": text_only, "t_dot_txt": "x"}),
    }
    rows = [(k, bytearray(v)) for k, v in books.items()] + [("z", None)]
    made = C.convert(spark.createDataFrame(rows, "book_id string, content binary"))
    fatal = {r["book_id"]: r["code"] for r in made.issues.where("severity = 'fatal'").collect()}
    assert fatal == {"a": "PARSE_NO_CONTAINER", "b": "PARSE_NO_ROOTFILE", "c": "PARSE_NO_PACKAGE", "d": "PARSE_EMPTY_SPINE", "e": "PLAN_NO_SECTIONS", "z": "INGEST_MISSING"}
    assert texts(made) == {}


def test_contents_are_recovered_from_a_page(spark):
    chapters = [("toc", "my-toc.xhtml", '<h1>In here</h1><a href="c1.xhtml">First  one</a> <a href="c2.xhtml#s">Second</a> <a href="c1.xhtml">again</a> <a href="https://e.org">away</a> <a href="my-toc.xhtml">self</a>')]
    chapters += [(f"c{i}", f"c{i}.xhtml", f'<p id="s">text {i}</p>') for i in (1, 2)]
    made = converted(spark, {"one": book(chapters, []), "none": book(chapters[1:], [])})
    files = texts(made)
    assert [(n["title"], n["href"]) for n in json.loads(files["one", "toc.json"])["nodes"]] == [("First  one", "content/002-chapter-first-one.md"), ("Second", "content/003-chapter-second.md#src-c2-s")]
    codes = {(r["book_id"], r["code"]) for r in made.issues.collect()}
    assert ("none", "NAV_DEGRADED") in codes and ("one", "NAV_DEGRADED") not in codes and ("one", "NAV_EMPTY_TOC") in codes


def test_contents_may_be_as_deep_as_they_like():
    depth = 1500
    rows = [{"key": f"h:{i}", "parent_key": f"h:{i - 1}" if i else "", "title": f"T{i}", "type": None, "section_id": None, "target": None, "provenance": "nav+ncx"} for i in range(depth)]
    markdown, text = M.toc_files(rows)
    assert markdown.count("\n") == depth + 2 and text.count('"children"') == depth
    shallow, text = M.toc_files(rows[:40] + [rows[3] | {"title": "U", "key": "h:x", "parent_key": ""}])
    want = {"schema_version": 1, "nodes": []}
    node = want["nodes"]
    for i in range(40):
        node.append({"title": f"T{i}", "type": None, "section_id": None, "href": None, "provenance": "nav+ncx", "children": []})
        node = node[0]["children"]
    want["nodes"].append({"title": "U", "type": None, "section_id": None, "href": None, "provenance": "nav+ncx", "children": []})
    assert text == json.dumps(want, indent=2, sort_keys=True) + "\n"
    assert M.toc_files([])[1] == json.dumps({"schema_version": 1, "nodes": []}, indent=2, sort_keys=True) + "\n"
    loop = [rows[0], rows[1], rows[0] | {"parent_key": "h:1"}]
    assert json.loads(M.toc_files(loop)[1])["nodes"][0]["children"][0]["children"][0]["children"] == []


def test_an_analyser_is_asked_and_may_fail(spark):
    one = book([("c", "c.xhtml", '<h1>Hi</h1><p><img src="i/p.png"/></p><p><img src="i/q.png"/></p><p><img src="i/r.png"/></p>')], [("Hi", "c.xhtml")], extra=[(x, f"i/{x}.png", "image/png", "", x.encode()) for x in "pqr"])
    result = {"p": '{"parsing_res_list": [{"block_label": "text", "block_content": "Found words"}]}', "q": '{"parsing_res_list": [{"block_label": "figure", "block_content": ""}]}'}
    made = converted(spark, {"one": one}, analyser=lambda batch: {k: result[v.decode()] for k, v in batch.items() if v.decode() in result})
    text = texts(made)["one", "content/001-chapter-hi.md"]
    assert "Found words" in text and "q.png" in text and "p.png" not in text
    assert {(r["code"], r["message"]) for r in made.issues.collect()} == {("IMAGE_ANALYSIS_CANDIDATE", "EPUB/i/p.png"), ("IMAGE_PRESERVED", "EPUB/i/q.png"), ("IMAGE_ANALYSIS_MISSING", "EPUB/i/r.png")}
    failed = converted(spark, {"one": one}, analyser=lambda batch: 1 / 0)
    assert {r["code"] for r in failed.issues.collect()} == {"IMAGE_ANALYSIS_FAILED"} and "p.png" in texts(failed)["one", "content/001-chapter-hi.md"]


def test_splits_and_merges(spark):
    split = book(
        [("all", "all.xhtml", '<h1 id="c1">First</h1><p>1 <a href="#c2">on</a></p><h1 id="c2">Second</h1><p id="in2">2</p>'), ("last", "last.xhtml", '<p><a href="all.xhtml#in2">x</a></p>')],
        [("First", "all.xhtml#c1"), ("Second", "all.xhtml#c2")],
    )
    merged = book([("in1", "in1.xhtml", "<h1>Start</h1>"), ("in1_b", "in1_b.xhtml", "<p>more</p>"), ("ch2", "ch2.xhtml", "<h1>Other</h1>")], [("Start", "in1.xhtml"), ("Other", "ch2.xhtml")])
    files = texts(converted(spark, {"split": split, "merged": merged}))
    names = sorted(p for b, p in files if b == "split" and p.startswith("content/"))
    assert names == ["content/001-chapter-first.md", "content/002-chapter-second.md", "content/003-chapter-last.md"]
    assert "Second" not in files["split", names[0]].split("---\n\n", 1)[1] and "# Second" in files["split", names[1]]
    assert "(002-chapter-second.md#" in files["split", names[0]] and "(002-chapter-second.md#" in files["split", names[2]]
    start = files["merged", "content/001-chapter-start.md"]
    assert "# Start" in start and "more" in start and ("merged", "content/003-chapter-other.md") not in files


def test_images_give_way_to_what_was_found(spark):
    one = book([("c", "c.xhtml", '<h1>Hi</h1><p><img src="i/p.png"/></p>')], [("Hi", "c.xhtml")], extra=[("pic", "i/p.png", "image/png", "", b"png")])
    found = spark.sql("SELECT 'one' AS book_id, 'EPUB/i/p.png' AS href, array(named_struct('label', 'text', 'content', 'Found words', 'kind', 'text')) AS items")
    assert "# Hi\n\nFound words" in texts(converted(spark, {"one": one}, recovered=found))["one", "content/001-chapter-hi.md"]


def test_external_entities_are_refused(spark):
    evil = b'<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><package><metadata><title>&e;</title></metadata></package>'
    assert "root:" not in E.xml_tree(evil).text()


def test_stream_converts_what_arrives(spark, tmp_path):
    from quire.streaming.ingest import archive_stream, convert_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.epub").write_bytes(book([("c", "c.xhtml", "<h1>Hi</h1>")], [("Hi", "c.xhtml")]))
    seen = []
    convert_stream(archive_stream(spark, str(tmp_path / "in")), lambda files, n: seen.extend(r["path"] for r in files.collect()), str(tmp_path / "cp")).awaitTermination()
    assert "content/001-chapter-hi.md" in seen
