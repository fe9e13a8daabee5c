"""Readers on small sources of every construct."""

import io
import zipfile

from quire.operators import elements as el
from quire.operators import layout as ly
from quire.operators import lines as ln
from quire.sources import html, markdown, office


def seen(found):
    return [(e["type"].split(":")[1], e["level"], e["text"]) for e in found]


def test_html_text_and_implied_ends():
    found = html.parse("<title>no</title><h2>A &amp b</h2>bare<p>x <b>y<br>z<p>foo<b>bar</b><script>1</script><ul><li>foo<b>bar</b><ol><li>in</ol><li>next</ul><blockquote>q <p>r</p></blockquote>")
    assert seen(found) == [("SectionTitle", 2, "A & b"), ("Paragraph", None, "x y z"), ("Paragraph", None, "foobar"), ("ListItem", None, "foo bar"), ("ListItem", None, "in"), ("ListItem", None, "next"), ("Paragraph", None, "q r")]


def test_html_links_keep_their_ranges():
    (p,) = html.parse('<p>  see <a href="u1"> the  page</a> and <a href="u2">x</a><a href=" ">y</a></p>')
    assert p["text"] == "see the page and xy"
    assert [(p["text"][x["begin"] : x["end"]], x["uri"]) for x in p["links"]] == [("the page", "u1"), ("x", "u2")]


def test_html_table_spans():
    (t,) = html.parse("<table><thead><tr><th colspan=2>h<th>k</thead><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>")
    assert t["cells"] == [["h", "", "k"], ["a", "b", "c"], ["", "d", "e"]] and t["header_rows"] == 1
    assert t["merged_left"] == [False, True] + [False] * 7 and [i for i, x in enumerate(t["merged_down"]) if x] == [6]
    assert t["text"] == "h |  | k\na | b | c\n | d | e"
    assert html.parse("<table></table>") == []


def test_markdown_blocks():
    source = "# T *em*\n\npara [l](<u v> 't')\nnext `a*b`  \nend\n\n- a\n- b\n  - c\n\n1. x\n\n2. y\n\n> q1\n> q2\n\n~~~\ncode\n  x\n~~~\nSet\n---\n\n***\n\n<div>\nno\n</div>\n\n[r]: http://z\n\nsee [r] \\*not\\* &amp; a_b_c *** x\n"
    found = markdown.parse(source)
    assert seen(found) == [
        ("SectionTitle", 1, "T em"), ("Paragraph", None, "para l next a*b end"), ("ListItem", None, "a"), ("Paragraph", None, "b"), ("ListItem", None, "c"),
        ("Paragraph", None, "x"), ("Paragraph", None, "y"), ("Paragraph", None, "q1 q2"), ("Paragraph", None, "code\n  x"), ("SectionTitle", 2, "Set"), ("Paragraph", None, "see r *not* & a_b_c *** x"),
    ]
    assert found[1]["links"] == [{"uri": "u v", "begin": 5, "end": 6}] and found[-1]["links"] == [{"uri": "http://z", "begin": 4, "end": 5}]


def test_markdown_tables_and_emphasis():
    (t,) = markdown.parse("| a | b |\n|---|:-:|\n| 1 | 2\\|3 |\n| **x** |\n")
    assert t["cells"] == [["a", "b"], ["1", "2|3"], ["x", ""]] and t["header_rows"] == 1
    assert markdown.inline("a*** b*** **c** *d* ~~e~~ 2*3*4 _x_", {})[0] == "a*** b*** c d e 234 x"
    assert markdown.inline("w*** " * 20_000, {})[0].startswith("w*** w***")
    assert markdown.parse("") == [] and markdown.parse("\n \n") == []


def test_word():
    w = 'xmlns:w="urn:w"'
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading7"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="List Bullet"/></w:pPr><w:r><w:t>b</w:t><w:tab/><w:t>c</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>z</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    package = io.BytesIO()
    with zipfile.ZipFile(package, "w") as z:
        z.writestr("word/document.xml", xml)
    found = office.parse_docx(package.getvalue())
    assert seen(found)[:3] == [("SectionTitle", 6, "Head"), ("ListItem", None, "item"), ("ListItem", None, "b c")]
    t = found[3]
    assert t["cells"] == [["h", ""], ["x", "y"], ["", "z"]] and t["merged_left"][1] and t["merged_down"][4] and t["header_rows"] == 1


def test_slides():
    p = 'xmlns:p="urn:p" xmlns:a="urn:a" xmlns:r="urn:r" xmlns:c="urn:c"'
    slide = f'<p:sld {p}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><p:txBody><a:p><a:r><a:t>Deck</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:pPr lvl="1"/><a:r><a:t>point</a:t></a:r></a:p><a:p><a:r><a:t>plain</a:t></a:r></a:p></p:txBody></p:sp><a:tbl><a:tr><a:tc gridSpan="2"><a:p><a:t>h</a:t></a:p></a:tc><a:tc hMerge="1"/></a:tr><a:tr><a:tc><a:p><a:t>1</a:t></a:p></a:tc><a:tc><a:p><a:t>2</a:t></a:p></a:tc></a:tr></a:tbl><c:chart r:id="rId2"/></p:sld>'
    chart = f'<c:chartSpace {p}><c:title><a:t>Share</a:t></c:title><c:ser><c:tx><c:v>S1</c:v></c:tx><c:cat><c:v>Q1</c:v><c:v>Q2</c:v></c:cat><c:val><c:v>3</c:v><c:v>4</c:v></c:val></c:ser></c:chartSpace>'
    package = io.BytesIO()
    with zipfile.ZipFile(package, "w") as z:
        z.writestr("ppt/slides/slide10.xml", f"<p:sld {p}><a:p><a:t>last</a:t></a:p></p:sld>")
        z.writestr("ppt/slides/slide2.xml", slide)
        z.writestr("ppt/slides/_rels/slide2.xml.rels", '<R><Relationship Id="rId2" Target="../charts/chart1.xml"/></R>')
        z.writestr("ppt/charts/chart1.xml", chart)
    found = office.parse_pptx(package.getvalue())
    assert seen(found)[:3] == [("SectionTitle", 1, "Deck"), ("ListItem", None, "point"), ("Paragraph", None, "plain")]
    assert found[3]["cells"] == [["h", ""], ["1", "2"]] and found[3]["merged_left"][1]
    assert found[4]["text"] == "Share" and found[5]["cells"] == [["", "S1"], ["Q1", "3"], ["Q2", "4"]]
    assert [e["page"] for e in found] == [0] * 6 + [1]


def test_files_and_failures(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>A</h1>")
    (tmp_path / "b.md").write_text("text")
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.bin").write_bytes(b"x")
    rows = office.read_files(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-4:], r["text"], r["error"] is None) for r in rows) == [("b.md"[-4:], "text", True), ("docx", None, False), ("html", "A", True)]


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (40).to_bytes(4, "big") + (30).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x1e\x00\x28\x01\0\0\0\0"
    assert office.image_size(png) == ("png", 40, 30) and office.image_size(jpeg) == ("jpeg", 40, 30)
    assert office.image_size(b"text") is None and office.image_size(None) is None


def test_section_tree_and_chunks(spark):
    source = "# A\n\n## B\n\np1\n\n### C\n\np2\n\n## D\n\np3\n\n- i1\n- i2\n"
    e = markdown.read_markdown(spark.createDataFrame([(1, source)], "doc_id long, text string"))
    parents = {r["seq"]: r["section"] for r in el.section_parents(e).collect()}
    assert parents == {1: None, 2: 1, 3: 2, 4: 2, 5: 4, 6: 1, 7: 6, 8: 6, 9: 6}
    paths = {r["text"]: r["path"] for r in el.section_paths(e).collect()}
    assert paths == {"A": ["A"], "B": ["A", "B"], "C": ["A", "B", "C"], "D": ["A", "D"]}
    assert {r["text"]: r["list"] for r in el.list_runs(e).collect()} == {"i1": 1, "i2": 1}
    got = [(r["chunk"], r["path"], r["text"]) for r in el.chunks(e).orderBy("chunk").collect()]
    assert got == [(1, ["A", "B"], "p1"), (2, ["A", "B", "C"], "p2"), (3, ["A", "D"], "p3\n\ni1\n\ni2")]
    nodes = {r["n"]: (r["type"], r["parent_n"]) for r in el.graph_nodes(e).collect()}
    assert nodes[2] == ("doco:Section", 1) and nodes[3] == ("doco:SectionTitle", 2) and nodes[4] == ("doco:Section", 2)
    assert [k for k, v in nodes.items() if v[0] == "doco:List"] and nodes[max(nodes)][1] == max(k for k, v in nodes.items() if v[0] == "doco:List")
    assert el.to_xhtml(e).first()["text"].endswith("<ul>\n<li>i1</li>\n<li>i2</li>\n</ul>\n")


def test_writers_round_trip(spark):
    source = '<h1>T</h1><p>see <a href="http://u">it</a> &lt;now&gt;</p><table><tr><th>a<th>b<tr><td rowspan=2>1<td>x|y<tr><td>z</table>'
    e = html.read_html(spark.createDataFrame([(1, source)], "page_id long, html string"))
    text = el.to_markdown(e).first()["text"]
    assert "see [it](http://u) <now>" in text and "| 1 | x\\|y |" in text
    again = html.parse(el.to_xhtml(e).first()["text"])
    assert seen(again) == seen(html.parse(source)) and again[2]["merged_down"] == html.parse(source)[2]["merged_down"]
    assert el.only_pages(e, "1,3-4").count() == 3 and el.only_pages(e, "2").count() == 0


def test_columns_are_read_one_after_the_other(spark):
    rows = []
    for side, left in (("l", 50.0), ("r", 330.0)):
        for i in range(10):
            for k, ch in enumerate(f"{side}{i} word"):
                x, y = left + 6 * k, 60.0 + 12 * i
                box = (None,) * 4 if ch == " " else (x, y - 8, x + 6, y)
                rows.append((1, 0, len(rows), ch, *box, x, y, 10.0, 6.0, 400, 0.0))
    g = spark.createDataFrame(rows, "doc_id long, page int, draw_index int, text string, x0 double, y0 double, x1 double, y1 double, origin_x double, origin_y double, font_size double, advance double, weight int, rotation_deg double")
    lines = ln.lines(g)
    assert [r["text"] for r in lines.orderBy("line").collect()] == [f"{s}{i} word" for s in "lr" for i in range(10)]
    lead = ly.modal_leading(lines)
    assert abs(lead.first()["leading"] - 1.2) < 0.05
    assert [(r["n_lines"], r["text"][:7]) for r in ly.blocks(lines, lead).orderBy("block").collect()] == [(10, "l0 word"), (10, "r0 word")]


def test_file_drop_stream(spark, tmp_path):
    from quire.streaming import drop

    folder = str(tmp_path / "in")
    schema = "page_id long, html string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        drop.write_documents(drop.stream_elements(spark, folder, schema, "html", "page_id"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    arrive([(1, "<p>old</p>"), (2, "<p>two</p>")])
    arrive([(1, "<p>new</p><p>more</p>")])
    assert sorted((r["doc_id"], r["text"]) for r in drop.latest(spark, str(tmp_path / "out")).collect()) == [(1, "more"), (1, "new"), (2, "two")]
