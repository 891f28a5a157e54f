"""Exact texts of the renderer and its rules."""

import random

import pytest

from quire.functions import markup as M
from quire.functions.dom import body_of, parse
from quire.functions.recover import recover, safe_table
from quire.functions.render import normalised, render, render_body
from quire.functions.svg import cleaned


def test_white_space_folds_and_hard_breaks_are_two_spaces():
    assert render("<p>sea\n\t level<br>  rise </p>\n<p> tide </p>") == "sea level  \nrise\n\ntide\n"


def test_rectangular_table_becomes_pipes_below_its_caption():
    out = render("<table><caption>Ships,\n by port</caption><tr><th>Port</th><th>Ships</th></tr><tr><td><b>Kiel</b></td><td>4|5</td></tr><tr><td></td><td>7 <i>new</i></td></tr></table>")
    assert out == "Ships, by port\n\n| Port | Ships |\n| --- | --- |\n| **Kiel** | 4\\|5 |\n|  | 7 *new* |\n"


def test_caption_beside_a_table_moves_to_it():
    out = render('<div><p class="TableCaption">Loads</p><table><tr><th>kg</th></tr><tr><td>9</td></tr></table></div>')
    assert out == "Loads\n\n| kg |\n| --- |\n| 9 |\n"


def test_irregular_table_stays_as_it_is():
    text = '<table><tr><th>h</th><th>i</th></tr><tr><td rowspan="2">j</td><td>k</td></tr><tr><td>l</td></tr></table>'
    assert render(f"<p>before</p>{text}<p>after</p>") == f"before\n\n{text}\n\nafter\n"


HEAD = "<tr><th>k</th><th>v</th></tr>"
REASONS = {
    "<caption>none</caption>": "missing-rows",
    HEAD + "<tr><td>1</td><td><div><table><tr><td>in</td></tr></table></div></td></tr>": "nested-table",
    HEAD + '<tr><td colspan="2">both</td></tr>': "rowspan-or-colspan",
    HEAD + "<tr><td>only one</td></tr>": "non-rectangular",
    HEAD + "<tr></tr>": "non-rectangular",
    "<tr><th>k</th><td>v</td></tr><tr><td>1</td><td>2</td></tr>": "missing-predictable-header",
    HEAD + "<tr><th>row</th><td>2</td></tr>": "ambiguous-header",
    HEAD + "<tr><td><ul><li>1</li></ul></td><td>2</td></tr>": "non-inline-safe-cell-content",
    HEAD + "<tr><td><video></video></td><td>2</td></tr>": "non-inline-safe-cell-content",
    HEAD + '<tr><td><div class="x SimplePara">1</div></td><td><code>2</code></td></tr>': "rectangular-inline-safe",
}


@pytest.mark.parametrize("rows", REASONS)
def test_table_reasons(rows):
    assert M.table_reason(parse(f"<table>{rows}</table>").first("table")) == REASONS[rows]


NOTED = '<p>Salt<a id="s1" epub:type="noteref" href="#fn7">7</a> dries.</p><aside id="fn7" epub:type="footnote">Sea <i>salt</i>\n only.</aside>'


def test_local_notes_become_footnotes():
    assert render(NOTED, "txt/Part 2.xhtml") == "Salt[^note-txt-part-2-xhtml-s1] dries.\n\n[^note-txt-part-2-xhtml-s1]: Sea salt only.\n"


def test_other_notes_stay_links():
    block = render(NOTED.replace("Sea <i>salt</i>\n only.", "<ul><li>Sea</li></ul>"), "p.xhtml")
    twice = render(NOTED.replace("dries", '<a role="doc-noteref" href="#fn7">again</a>'), "p.xhtml")
    away = render(NOTED.replace('"#fn7"', '"end.xhtml#fn7"'), "p.xhtml")
    assert "[^" not in block + twice + away and "[7](end.xhtml#fn7)" in away and "- Sea" in block


def test_note_classes():
    kinds = {k: M.notes_of(body_of(parse(t)), "a.xhtml")[0][3] for k, t in {
        "simple_local": NOTED, "cross_document": NOTED.replace('"#fn7"', '"b.xhtml#fn7"'), "ambiguous": NOTED.replace('"#fn7"', '"#none"'), "complex": NOTED.replace("Sea", "<p>Sea</p>"),
    }.items()}
    assert all(k == v for k, v in kinds.items())


def test_mathematics_ruby_and_direction_stay_markup():
    for text in ("<math><mfrac><mn>1</mn><mi>q_r</mi></mfrac></math>", "<ruby>東<rp>(</rp><rt>とう</rt><rp>)</rp></ruby>", '<bdo dir="rtl">abc*d*</bdo>'):
        assert render(f"<p>so {text} it is</p>") == f"so {text} it is\n"


def test_what_runs_or_reaches_out_goes():
    out = render('<div onfocus="a()"><p style="x">keep <a href="vbscript:b">word</a></p><iframe src="c"></iframe>tail<embed src="d"><form><p>gone</p></form></div><bdi dir="up" onclick="e">f</bdi>')
    assert "keep" in out and "word" in out and "tail" in out and "<bdi>f</bdi>" in out
    assert not any(x in out for x in ("vbscript", "onfocus", "onclick", "style", "iframe", "gone", "up"))


def test_anchors_stand_before_what_they_name():
    out = render('<h2 id="k">Kelp</h2><p>see <span id="m">moss</span></p>', anchors={"k": "src-c-k", "m": "src-c-m", "absent": "x"})
    assert out == '<a id="src-c-k"></a>## Kelp\n\nsee <a id="src-c-m"></a>moss\n'


def test_lists_quotes_code_and_rules():
    out = render("<ol><li>rope<ul><li>knot</li><li>hitch</li></ul></li><li>sail</li></ol><blockquote><p>one</p><p>two</p></blockquote><pre>\n a  b\n</pre><p>run <code>x</code></p><hr><h3> </h3>")
    assert out == "1. rope\n   - knot\n   - hitch\n2. sail\n\n> one\n>\n> two\n\n```\n a  b\n```\n\nrun `x`\n\n---\n"


def test_text_repairs():
    assert normalised("MÃ¼nchen, SÃ£o, â€œquotesâ€™") == "München, São, “quotes’"
    assert normalised("**W**inter light, _A_ B, a**b**c") == "Winter light, _A_ B, a**b**c"
    assert normalised("light-\n  house, ABC- def, Zodiac- sign, x- ray") == "lighthouse, ABC- def, Zodiac- sign, x- ray"
    assert normalised(" ** Harbour **\n\ntext") == "# Harbour\n\ntext" and normalised("**Harbour**\n# Own") == "**Harbour**\n# Own"


def test_nothing_is_too_deep():
    deep = "<span>" * 5000 + '<a href="x.md">link</a> <img src="p.png" alt="p">' + "</span>" * 5000
    assert render(f"<p>{deep}</p>") == "[link](x.md) ![p](p.png)\n"
    assert render("<div>" * 4000 + "a <b>x</b>") == "a **x**\n"
    assert render("<ul><li>" * 60 + "x").count("- ") == 60
    maths = "<math>" + "<mrow>" * 3000 + "<mi>y</mi>" + "</mrow>" * 3000 + "</math>"
    assert render(f"<p>{maths}</p>") == maths + "\n"
    assert M.markup_of(body_of(parse("<div>" * 3000))).count("</div>") == 3000


def test_blocks_close_a_paragraph_however_far_up_it_is():
    inner = "<b><i><u><s><em><strong><small><sub>"
    paragraph = parse(f"<p>one{inner}two<div>three</div>").first("p")
    assert paragraph.text() == "onetwo"


def test_xhtml_is_read_as_xml():
    page = '<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><body><p id="a"/><p>caf&eacute;&nbsp;x<a id="k"/>after</p><svg viewBox="0 0 1 1"><linearGradient/></svg></body></html>'
    tree = parse(page)
    assert [n.tag for n in tree.elements()][2:] == ["body", "p", "p", "a", "svg", "linearGradient"]
    assert tree.first("a").children == [] and tree.first("svg").attrs == {"viewBox": "0 0 1 1"}
    assert [n.text() for n in tree.elements() if n.tag == "p"] == ["", "café\xa0xafter"]
    assert parse(page.replace("</p>", "", 1)).first("body") is not None  # no XML after all
    assert "root:" not in parse('<?xml version="1.0"?><!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><x>&e;</x>').text()


def test_broken_markup_is_borne():
    r = random.Random(7)
    bits = ["<p>", "</p>", "<li>", "<dl><dt>", "<tr>", "<td", ">", "&lt;", "&#1;", "y", "<ol>", "</section>", "<!--", "<![if", "<!DOCTYPE", "'", "<img src=", "<?x"]
    for _ in range(300):
        render("".join(r.choice(bits) for _ in range(50)))


def test_svg_is_cleaned_on_its_tree():
    svg = b'<svg xmlns:xlink="l" viewBox="0 0 9 9" ONLOAD="a"><SCRIPT>b()</SCRIPT><foreignObject><p>c</p></foreignObject><use xlink:href="#d"/><image href=" JavaScript:e"/><g onclick=\'f\'>t &lt; u</g></svg>'
    assert cleaned(svg) == (b'<svg xmlns:xlink="l" viewBox="0 0 9 9"><use xlink:href="#d"/><image/><g>t &lt; u</g></svg>', 5)
    plain = b"<?xml version='1.0'?><svg><path d='M0 0'/></svg>"
    assert cleaned(plain) == (plain, 0)
    loose, n = cleaned(b"<svg onload=a()><script>b()</script><rect width=1><a href=https://c>d</svg>")
    assert n >= 3 and not any(x in loose for x in (b"onload", b"script", b"https"))


def test_recovered_images():
    text, formula = {"kind": "text", "content": "Read words", "label": "text"}, {"kind": "formula", "content": "m^2", "label": "formula"}
    table = {"kind": "table", "content": '<table border="1"><tr><th style="q">Port</th></tr><tr><td colspan="2000" rowspan="1"><form>z</form><span>Kiel</span></td></tr></table>', "label": "table"}
    legend = {"kind": "text", "content": "Legend", "label": "figure_caption"}
    found = {"1.png": [text], "2.png": [formula], "3.png": [table], "4.png": [{"kind": "table", "content": "not one", "label": "table"}], "5.png": [legend, text]}
    body = body_of(parse('<p id="i"><img src="1.png"></p><p>area <img src="2.png"> or <img src="1.png"></p><p><img src="3.png"></p><p><img src="4.png"></p><figure><img src="5.png"><figcaption>Mine</figcaption></figure><p><img src="6.png"></p>'))
    assert recover(body, found) == [("1.png", "IMAGE_CONVERTED"), ("2.png", "IMAGE_CONVERTED"), ("1.png", "IMAGE_PRESERVED_CONTEXT"), ("3.png", "IMAGE_CONVERTED"), ("4.png", "IMAGE_CONVERSION_UNSAFE"), ("5.png", "IMAGE_CONVERTED")]
    out = render_body(body)
    assert out.startswith("Read words\n\narea $m^2$ or ![](1.png)") and "Legend" not in out and "Mine" in out and "![](6.png)" in out
    assert M.markup_of(safe_table(table["content"])) == '<table><tr><th>Port</th></tr><tr><td rowspan="1">Kiel</td></tr></table>'
