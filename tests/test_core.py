"""Rules of single operators on small cases."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions.text import is_numeric_cell, is_value_cell, markdown_cell, numbering_depth
from quire.operators import elements as el
from quire.operators import figures as fg
from quire.operators import grids as gr
from quire.operators import layout as ly
from quire.operators import lines as ln
from quire.operators import links as lk
from quire.operators import output as out
from quire.operators import readings as rd
from quire.sources import html, markdown, office

GLYPH = "doc_id long, page int, draw_index int, text string, x0 double, y0 double, x1 double, y1 double, origin_x double, origin_y double, font_size double, advance double, weight int, rotation_deg double"


def glyph(k, ch, x, y, advance=6.0, size=10.0, weight=400):
    box = (None,) * 4 if ch == " " else (x, y - 8, x + advance, y)
    return (1, 0, k, ch, *box, x, y, size, advance, weight, 0.0)


def typed(text, x=50.0, y=60.0, pitch=6.0, start=0, advance=6.0):
    return [glyph(start + k, ch, x + pitch * k, y, advance) for k, ch in enumerate(text)]


def page_of(rows):
    return ln.Glyphs(pd.DataFrame(rows, columns=[c.split()[0] for c in GLYPH.split(", ")]))


def texts(rows, **more):
    return [x["text"] for x in ln.page_lines(page_of(rows), **more)]


NUMBERED = [
    ("5. Specifications", 1), ("5.3 Recommended Conditions", 2), ("6.3.1 Oscillator", 3), ("01 - Find Resources", 1), ("02- Prepare Your Content", 1),
    ("B.1 Large Models", 2), ("B. Related Works", 1), ("II. Set Up the Digests", 1), ("A test of the system", None), ("2026 was a difficult year", None),
    ("15% of respondents", None), ("plain prose", None), ("III. his report defines", None), ("2.6 times that of", None), ("15 respondents said", None), ("120 The thing", None),
    ("6. Compared to 38% in July and 22% in October.", None), ("7 Variants of Models", 1), ("1.2.3.4.5.6.7 Deep", None),
]


def test_numbering_depth(spark):
    df = spark.createDataFrame([(t,) for t, _ in NUMBERED], "t string").select("t", numbering_depth(F.col("t")).alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == dict(NUMBERED)


def test_cells(spark):
    rows = {"12": True, "$1,200.50": True, "(3)": True, "-4%": True, "2023": False, "1*": False, "3–4": False, "": False, "abc": False, "1 000": True}
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", is_numeric_cell(F.col("t")).alias("n"), is_value_cell(F.col("t")).alias("v"), markdown_cell(F.concat("t", F.lit("|\r\n"))).alias("m"))
    got = df.collect()
    assert {r["t"]: r["n"] for r in got} == rows
    assert {r["t"] for r in got if r["v"]} == {"12", "$1,200.50", "(3)", "-4%", "2023", "1*", "3–4", "1 000"}
    assert all("\r" not in r["m"] and "\n" not in r["m"] for r in got)


def test_overprint_compares_with_kept_glyphs_alone(spark):
    rows = [glyph(k, "a", 50 + 1.2 * k, 60.0) for k in range(3)]  # shifts of 0.2 of the advance
    kept = ly.without_overprint(spark.createDataFrame(rows, GLYPH)).orderBy("draw_index").collect()
    assert [r["draw_index"] for r in kept] == [0, 2]


def test_furniture_roles(spark):
    rows = []
    for p in range(4):
        rows += [(1, p, 1, "Report", 0.05), (1, p, 2, f"Page {p}", 0.95), (1, p, 3, "DRAFT", 0.5), (1, p, 4, "twice", 0.4), (1, p, 5, "twice", 0.4), (1, p, 6, " ", 0.96), (1, p, 7, "Press", 0.9)]
    got = ly.furniture(spark.createDataFrame(rows, "doc_id long, page int, line int, text string, rel_y double")).collect()
    assert {(r["text"][:4], r["role"]) for r in got} == {("Repo", "Header"), ("Page", "PageNumber"), ("DRAF", "Watermark"), ("Pres", "Footer")} and len(got) == 16


def test_spaces_between_glyphs():
    assert texts(typed("two words")) == ["two words"]
    wide = [glyph(k, ch, 50 + 9.0 * k, 60.0) for k, ch in enumerate("12.5")]  # gaps of 0.3: closed between digits
    assert texts(wide) == ["12.5"]
    letters = [glyph(k, ch, 50 + 9.0 * k, 60.0) for k, ch in enumerate("ab")]
    assert texts(letters) == ["a b"]
    cjk = [glyph(k, ch, 50 + 9.0 * k, 60.0) for k, ch in enumerate("漢字かな")]
    assert texts(cjk) == ["漢字かな"]
    x, rows = 50.0, []
    for k, ch in enumerate("SPREADTITLE"):
        x += 10.0 + (6.0 if k == 6 else 0)
        rows.append(glyph(k, ch, x, 60.0))
    assert texts(rows) == ["SPREAD TITLE"]
    assert texts(typed("ﬁne")) == ["fine"]


def test_space_ratio_is_the_valley():
    rng = np.random.default_rng(1)
    gaps = np.concatenate([rng.normal(0.02, 0.01, 900), rng.normal(0.30, 0.02, 180)])
    assert 0.10 <= ln.space_ratio(gaps) <= 0.25 and ln.space_ratio(gaps[:50]) == 0.2


def test_rejoined_needs_a_small_share():
    line = lambda text, x0, x1: {"text": text, "x0": x0, "x1": x1, "y0": 0.0, "y1": 8.0, "size": 10.0, "rotation": 0, "base": 8.0, "bold": False, "col": 0}
    many = [line(f"r{i}", 305.0, 400.0) | {"base": 12.0 * i} for i in range(4)]
    got = ln.rejoined([[line("a", 50.0, 302.0) | {"base": 0.0}], many], [300.0])
    assert got[0][0]["text"] == "a r0" and len(got[1]) == 3
    got = ln.rejoined([[line("a", 50.0, 302.0)], [line("b", 305.0, 400.0)]], [300.0])
    assert len(got[1]) == 1


def test_grid_rules():
    h = np.array([[50, y, 250, y] for y in (100, 120, 140)], float)
    v = np.array([[x, 100, x, 140] for x in (50, 150, 250)], float)
    (g,) = gr.ruled_grids(h, v)
    assert g.shape == (2, 2) and g.at(151, 121) == (1, 1) and g.at(10, 10) is None
    assert gr.ruled_grids(h[:2], v[:2]) == []
    # an open band above that no vertical crosses is no row
    (g,) = gr.ruled_grids(np.vstack([h, [[50, 80, 250, 80]]]), v)
    assert g.ys[0] == 100
    # a band of many row heights ends the table
    far = np.array([[50, y, 250, y] for y in (100, 120, 140, 400, 420, 440)], float)
    long = np.array([[x, 100, x, 440] for x in (50, 150, 250)], float)
    assert [g.shape for g in gr.ruled_grids(far, long)] == [(2, 2), (2, 2)]
    assert gr.span_coverage([(0, 10), (5, 20), (30, 40)], 0, 35) == 25


def test_figures_are_no_bands_and_grow():
    bars = np.array([[50 + 30 * i, 300 - 20 * i - 20, 70 + 30 * i, 300] for i in range(5)], float)
    (f,) = fg.figures_of(bars, np.zeros((0, 4)), 612, 792)
    assert f == (50, 200, 190, 300)
    assert fg.grown(f, np.array([[60, 310, 160, 325], [60, 340, 160, 350], [0, 500, 600, 520]], float), 612, 792) == (50, 200, 190, 350)
    rows = np.array([[50, 100 + 20 * i, 400, 115 + 20 * i] for i in range(5)], float)
    assert fg.figures_of(rows, np.zeros((0, 4)), 612, 792) == []
    assert len(fg.distinct_boxes(np.array([[0, 0, 1, 1], [0.2, 0.2, 1.2, 1.2], [5, 5, 6, 6]]))) == 2


def test_links_are_placed():
    assert lk.located("see the  data\nsheet here", "data sheet") == (9, 19)
    assert lk.located("abc", "") is None and lk.located("ﬁne words", "fine") == (0, 3)
    link = lambda i, uri, a, y: {"link_id": i, "uri": uri, "anchor": a, "x0": 0.0, "y0": y}
    got = lk.attached("one two one two", [link(2, "b", "one", 20.0), link(1, "a", "one", 10.0), link(3, "c", "nowhere", 30.0)])
    assert [(x["uri"], x["begin"]) for x in got] == [("a", 0), ("b", 8), ("c", None)]
    assert lk.attached("wrapped anchor", [link(1, "a", "wrapped", 1.0), link(2, "a", "anchor", 2.0)]) == [{"uri": "a", "begin": 0, "end": 14}]
    assert [x["begin"] for x in lk.attached("abcdef", [link(1, "a", "abcd", 1.0), link(2, "b", "cd", 2.0)])] == [0, None]


def test_scrubbing():
    known = [("Page 1 of 10", True), ("12", True), ("Annual report of the whole house 2020", False)]
    assert rd.scrubbed("x Page 33 of 120 y", known) == "x y"
    assert rd.scrubbed("85,159", known) == "85,159" and rd.scrubbed("77", known) == "" and rd.scrubbed("77", known, in_cell=False) == "77" and rd.scrubbed("2024", known) == "2024"
    assert rd.scrubbed("Annual report of the whole hou", known) == "" and rd.scrubbed("Annual report", known) == "Annual report"
    assert rd.scrubbed_lines("a\n12 Annual report of the whole house 2020\n\n\nb 5", known) == "a\n\nb 5"
    assert rd.escalates(True, True, False, False) and not rd.escalates(False, True, True, True) and not rd.escalates(False, False, True, False)


def test_sidecar_files(spark, tmp_path):
    (tmp_path / "r_p2_page.json").write_text('[{"label": "table", "score": 0.9, "box": [10, 20, 110, 220]}, {"label": "title", "score": 0.3, "box": [0, 0, 1, 1]}]')
    (tmp_path / "bad_p0_page.json").write_text("not json")
    (tmp_path / "my_doc_p0_t1.json").write_text('[{"width": 3, "parsing_res_list": [{"block_label": "table", "block_content": "<table>", "block_order": 2}, {"block_label": "text", "block_content": "x"}]}]')
    assert [tuple(r) for r in rd.read_layout(spark, str(tmp_path)).collect()] == [("r", 2, "table", 0.9, 5.0, 10.0, 55.0, 110.0)]
    got = sorted((tuple(r) for r in rd.read_readings(spark, str(tmp_path)).collect()), key=repr)
    assert got == [("my_doc", "p0_t1", "table", "<table>", 2), ("my_doc", "p0_t1", "text", "x", None)]


def test_crops_have_a_margin(spark):
    crops = spark.createDataFrame([(1, 0, "p0_t0", "table", 10.0, 10.0, 50.0, 50.0)], "doc_id long, page int, crop string, kind string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, 0, 5.0, 12.0, 60.0, 40.0)], "doc_id long, page int, bx0 double, by0 double, bx1 double, by1 double")
    r = rd.with_margin(crops, boxes).first()
    assert (r["rx0"], r["ry0"], r["rx1"], r["ry1"]) == (0.0, 8.0, 132.0, 112.0)


def test_outputs(spark, tmp_path):
    docs = spark.createDataFrame([("a/x.docx", "one"), ("b/x.html", "two"), ("c/y", "three")], "path string, text string")
    out.write_documents(out.destinations(docs, "md"), str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"x.docx.md": "one", "x.html.md": "two", "y.md": "three"}
    assert out.write_one(docs.where("text = 'two'"), None) == "two"
    with pytest.raises(ValueError):
        out.write_one(docs, None)
    page = html.read_html(spark.createDataFrame([(1, "<h1>T</h1><p>x</p>")], "page_id long, html string"))
    note = spark.createDataFrame([(1, "page 2 -- missing")], "doc_id long, note string")
    assert out.render(page, "md", note).first()["text"] == "<!-- page 2 - - missing -->\n# T\n\nx\n"
    assert out.exit_status(page) == 0 and out.render(page, "text", note).first()["text"] == "T\n\nx\n"


def test_hits_by_one_dialect(spark):
    page = html.read_html(spark.createDataFrame([(1, "<p>year ١٢٣ now</p>")], "page_id long, html string"))
    assert [r["hit"] for r in el.span_hits(page, r"\b\d+\b").collect()] == ["١٢٣"]
    assert lk.normal_query("ﬁne") == "fine"


def test_pages_nested_deep_and_spans_out_of_bounds():
    deep = "<div>" * 5000 + "<p>in</p>" + "</div>" * 5000
    assert [e["text"] for e in html.parse(deep)] == ["in"]
    assert [e["text"] for e in html.parse("<p>" + "<b>" * 5000 + "x</p>")] == ["x"]
    (t,) = html.parse('<table><tr><td colspan="999999999">a<td>b</table>')
    assert len(t["cells"][0]) == 1001


def test_markdown_footnotes_and_brackets():
    got = [e["text"] for e in markdown.parse("One[^1] and [^2].\n\n[^1]: The note *itself*\n\nEnd")]
    assert got == ["One and [^2].", "The note itself", "End"]
    began = time.time()
    markdown.parse("[" * 20_000)
    assert time.time() - began < 5
    rng = random.Random(3)
    for _ in range(300):
        markdown.parse("".join(rng.choice("[]()!\\a*_`<^:\n") for _ in range(40)))


def test_word_tables_hold_each_text_once():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda c: f"<w:tc>{c}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell(p('deep'))}</w:tr></w:tbl>"
    xml = f"<w:document {ns}><w:body><w:tbl><w:tr>{cell(p('outer') + inner)}{cell(p('side'))}</w:tr></w:tbl></w:body></w:document>"
    (t,) = office.parse_word_xml(xml)
    assert t["cells"] == [["outer deep", "side"]]


def test_emptied_documents_are_retracted(spark):
    old = html.read_html(spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>b</p>")], "page_id long, html string"))
    new = html.read_html(spark.createDataFrame([(1, None), (3, "<p>c</p>")], "page_id long, html string"), keep_empty=True)
    assert sorted(r["text"] for r in el.replace_documents(old, new).collect()) == ["b", "c"]


def test_dispatch_by_first_bytes(spark):
    from quire.sources.dispatch import image_documents, kind_of

    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (300).to_bytes(4, "big") + (200).to_bytes(4, "big")
    rows = [("a.bin", b"%PDF-1.7"), ("b.png", png), ("c.docx", b"PK\x03\x04"), ("d.docx", b"text"), ("e.HTML", b"<p>"), ("f.txt", b"x"), ("g.xyz", b"x"), ("h.md", b"PK\x03\x04")]
    df = spark.createDataFrame([(i, p, bytearray(b)) for i, (p, b) in enumerate(rows)], "doc_id long, path string, content binary")
    got = [r["k"] for r in df.select("doc_id", kind_of(F.col("path"), F.col("content")).alias("k")).orderBy("doc_id").collect()]
    assert got == ["pdf", "png", "docx", None, "html", "markdown", None, None]
    pages, images = image_documents(df)
    assert [tuple(r) for r in pages.collect()] == [(1, 0, 300.0, 200.0)] and images.first()["x1"] == 300.0


def test_options(tmp_path):
    from quire.sources.dispatch import load_options

    (tmp_path / ".quire").mkdir()
    (tmp_path / ".quire" / "options.toml").write_text('format = "xhtml"\n')
    assert load_options(str(tmp_path))["format"] == "xhtml" and load_options(str(tmp_path / "none"))["format"] == "md"
    (tmp_path / ".quire" / "options.toml").write_text("unheard = 1\n")
    with pytest.raises(ValueError):
        load_options(str(tmp_path))


def test_a_failed_crop_fails_its_document(spark):
    from quire.sources.dispatch import read_crops

    def reader(prompt, picture):
        if prompt == "bad":
            raise ValueError("no reply")
        return prompt.upper(), "MAX_TOKENS" if prompt == "long" else "STOP"

    rows = [(1, "p0_t0", "one"), (1, "p0_t1", "two"), (2, "p0_t0", "ok"), (2, "p0_t1", "bad"), (3, "p0_t0", "long")]
    got = read_crops(spark.createDataFrame([(*r, bytearray(b"")) for r in rows], "doc_id long, crop string, prompt string, picture binary"), reader).collect()
    assert {(r["doc_id"], r["crop"]): r["reading"] for r in got} == {(1, "p0_t0"): "ONE", (1, "p0_t1"): "TWO", (2, "p0_t0"): None, (2, "p0_t1"): None, (3, "p0_t0"): None}


def test_pdf_fonts_and_odd_files(spark):
    from quire.plans.pages import pdf_of
    from quire.sources import pdf

    data = pdf_of(["two words", "naïve (x)"], "http://u", "Mark", "f", "vé")
    glyphs = pdf.parse(data, "glyphs")
    assert "".join(g[2] for g in glyphs) == "two wordsnaïve (x)" and {g[11] for g in glyphs} == {700}
    assert pdf.parse(data, "fields")[0][1:4] == ("f", "text", "vé") and pdf.parse(data, "pages") == [(0, 612.0, 792.0)]
    assert pdf.unicode_map(b"1 beginbfchar <01> <00660069> endbfchar 1 beginbfrange <05> <07> <0041> endbfrange") == {1: "fi", 5: "A", 6: "B", 7: "C"}
    assert pdf.decoded(b"\xfe\xff\x00A") == "A" and pdf.decoded(b"a\xe9") == "aé"
    stripes = np.zeros((40, 40), np.uint8)
    stripes[:, ::4] = 255
    assert pdf.looks_like_text(stripes) and not pdf.looks_like_text(np.full((40, 40), 128, np.uint8))
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"junk")), (3, None), (4, bytearray(data[:300]))], "doc_id long, content binary")
    got = pdf.read_pdf(files, "glyphs").groupBy("doc_id").agg(F.count("text").alias("n"), F.max("error").alias("e")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n"] == 18 and by[1]["e"] is None and by[2]["e"] is not None and 3 not in by


def test_command_line(tmp_path, capsys, spark):
    from quire import __main__ as cli
    from quire.plans.pages import pdf_of

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<h1>Head</h1><p>body</p>")
    assert cli.convert(spark, type("A", (), {"paths": [str(tmp_path / "in")], "format": "md", "out": str(tmp_path / "out"), "pages": None})) == 0
    assert (tmp_path / "out" / "a.md").read_text() == "# Head\n\nbody\n"
    (tmp_path / "in" / "b.pdf").write_bytes(pdf_of(["Some words of a page"], "urn:x", "Mark", "name", "value"))
    assert cli.forms(spark, type("A", (), {"paths": [str(tmp_path / "in")]})) == 0 and '"value": "value"' in capsys.readouterr().out
    assert cli.convert(spark, type("A", (), {"paths": [str(tmp_path / "in" / "b.pdf")], "format": "text", "out": None, "pages": None})) == 0
    assert "Some words of a page" in capsys.readouterr().out
    assert cli.triage(spark, type("A", (), {"paths": [str(tmp_path / "in")]})) == 0 and '"pages": 1' in capsys.readouterr().out
    assert [n for n, _ in cli.timings({"one": lambda: spark.range(3)}, 1)] == ["one"]


def long_page(rows: int):
    """Rules and ink of a page of three ruled columns: 20 between rows, a word in each cell."""
    import pyarrow as pa

    h = np.array([[50, 100 + 20 * k, 350, 100 + 20 * k] for k in range(rows + 1)], float)
    v = np.array([[50 + 100 * k, 100, 50 + 100 * k, 100 + 20 * rows] for k in range(4)], float)
    at = [(r, c, i) for r in range(rows) for c in range(3) for i in range(4)]
    x, y = np.array([54.0 + 100 * c + 6 * i for _, c, i in at]), np.array([114.0 + 20 * r for r, *_ in at])
    text = [str(r)[-1] if r else "h" for r, *_ in at]
    one = np.ones(len(at))
    glyphs = {"draw_index": np.arange(len(at)), "text": text, "x0": x, "y0": y - 8, "x1": x + 6, "y1": y, "origin_x": x, "origin_y": y, "font_size": 10 * one, "advance": 6 * one, "weight": 400 * one, "rotation_deg": 0 * one}
    return h, v, gr.Ink(pa.table(glyphs))


def test_rules_of_a_long_page_meet_in_bounded_memory():
    import tracemalloc

    h, v, _ = long_page(5_000)
    apart = h + [1_000, 0, 1_000, 0]
    tracemalloc.start()
    found = gr.component_grids(np.vstack([h, apart]), np.vstack([v, v + [1_000, 0, 1_000, 0]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [g.shape for g in found] == [(5_000, 3), (5_000, 3)]
    assert peak < 100 << 20  # pairs of all rules took over 1 GB
    # against all pairs, in pieces of few pairs
    boxes = np.random.default_rng(7).uniform(0, 300, (400, 4))
    boxes[:, 2:] = boxes[:, :2] + boxes[:, 2:] / 20
    label = np.arange(400)
    near = ((boxes[:, None, :2] - 3 <= boxes[None, :, 2:]) & (boxes[None, :, :2] - 3 <= boxes[:, None, 2:])).all(axis=2)
    while (least := np.where(near, label, 400).min(axis=1)).tolist() != label.tolist():
        label = least
    kept, gr.PAIRS = gr.PAIRS, 100
    try:
        assert gr.touching(boxes, 3).tolist() == label.tolist()
    finally:
        gr.PAIRS = kept


def test_whole_reading_of_a_long_page_in_bounded_memory():
    import tracemalloc

    h, v, ink = long_page(6_000)
    tracemalloc.start()
    (g,) = gr.page_grids(ink, h, v, np.zeros((0, 4)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert g.shape == (6_000, 3) and gr.filled_cells(g, ink) == 18_000
    assert peak < 150 << 20


def test_ruled_grids_are_read_once(spark):
    from quire.plans.pages import ruled_grids

    plan = ruled_grids(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1


def test_headers_and_cells_of_a_long_page_take_linear_time():
    from time import process_time

    h, v, ink = long_page(15_000)
    fills = np.array([[50, 100 + 20 * k, 350, 118 + 20 * k] for k in range(1, 15_000, 2)], float)
    start = process_time()
    (g,) = gr.ruled_grids(h, v)
    cells = gr.cell_texts(g, ink)
    down, left = gr.merges(g, h, v, fills)
    assert cells[0] == ["hhhh"] * 3 and cells[14_999] == ["9999"] * 3 and not any(down) and not any(left)
    assert gr.header_rows(g, cells, ink, fills) == 1
    assert process_time() - start < 10  # over a minute when every row was sought among all


def test_graph_of_a_table_of_many_rows(spark):
    from quire.operators import graph as gh
    from quire.sources.markdown import read_markdown

    text = "| a | b |\n|---|---|\n" + "\n".join(f"| x{k} | {k} |" for k in range(22_000))
    nodes = gh.document_graph(read_markdown(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    last = nodes.where("row_index = 21999").orderBy("n").select("n", "value").collect()
    assert [(r["n"], r["value"]) for r in last] == [(44_001, "x21999"), (44_002, "21999")]


def test_references_without_a_semicolon(spark, tmp_path):
    import duckdb

    from quire.plans import catalog, pages  # noqa: F401 - registers its queries

    source = '<article><h1>Ly.&amp;&amp; and&amp</h1><p>a & b &copy; &nosuch; &am&quot;<a href="/x?a=1&amp;b=2&c">c</a></p></article>'
    title, text = html.parse(source)
    assert title["text"] == "Ly.&& and&" and text["text"] == 'a & b © &nosuch; &am"c'
    title, text = html.parse(source, bare=False)
    assert title["text"] == "Ly.&& and&amp" and text["text"] == 'a & b © &nosuch; &am"c' and text["links"][0]["uri"] == "/x?a=1&b=2&c"
    spark.createDataFrame([(1, "u", source)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("headings_only", "html_elements", "rendered"):
        want = con.execute(catalog.ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(want.fetchall())


def test_contents_pages_are_shuffled_once_in_partitions_that_follow_the_input(spark, tmp_path):
    from quire.operators import headings as hd
    from quire.store import partitions_for

    spark.range(100_000).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    assert partitions_for(d, 1 << 14) > 4 and partitions_for(d, 1 << 40) is None
    texts = ["Contents", "a", "b", "c"]
    at = [(k // 4, k % 2, k % 4 + 1, texts[k % 4] if k < 8 else "x", float(k * 7 % 5), float(k * 3 % 4)) for k in range(16)]
    blocks = spark.createDataFrame(at, "doc_id long, page int, block int, text string, x0 double, y0 double").withColumn("was", F.col("block"))
    columns = spark.createDataFrame([(0, 0, 2), (1, 0, 1), (2, 0, 2)], "doc_id long, page int, n_cols int")
    got = hd.contents_order(blocks, columns)
    assert got.columns == blocks.columns and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for doc in range(4):
        for page in range(2):
            own = [r for r in at if r[:2] == (doc, page)]
            rows = (doc, page) in {(0, 0), (2, 0)} and any(r[3] == "Contents" for r in own)
            own.sort(key=lambda r: (r[5], r[4], r[2]) if rows else r[2])
            want |= {(doc, page, r[2], i) for i, r in enumerate(own, 1)}
    assert {(r["doc_id"], r["page"], r["was"], r["block"]) for r in got.collect()} == want


def test_glyphs_stay_where_they_are_while_faces_are_few(spark):
    g = spark.createDataFrame([(1, "a", 0.2)] * 50 + [(1, "b", 0.5)] * 45 + [(1, "c", 0.9)], "doc_id long, face string, ink double").withColumn("weight", F.lit(None).cast("int"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ln.inferred_weights(g)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert plan.index("BroadcastHashJoin") < plan.index("SortMergeJoin")  # the outer join of the glyphs
        assert {(r["face"], r["weight"]) for r in got.collect()} == {("a", 400), ("b", 700), ("c", None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
