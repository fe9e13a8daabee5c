"""Word and PowerPoint readers: packages opened with the standard library, trees into elements."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.schema import ITEM, PARAGRAPH, TITLE, element, table
from quire.sources.reader import read_elements

_STYLE = re.compile(r"(?:Heading|heading|berschrift)-*([1-9])\Z")
_SLIDE = re.compile(r"ppt/slides/slide([0-9]+)\.xml\Z")


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _value(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def _child(node: ElementTree.Element, *path: str) -> ElementTree.Element | None:
    for name in path:
        node = next((c for c in node if _name(c) == name), None)
        if node is None:
            return None
    return node


def _count(text: str | None) -> int:
    return max(int(text), 1) if text and text.isdigit() else 1


def _runs(node: ElementTree.Element, breaks: dict[str, str]) -> str:
    return "".join((n.text or "") if _name(n) == "t" else breaks.get(_name(n), "") for n in node.iter())


def _tidy(text: str) -> str:
    return " ".join(text.split())


def style_level(style: str) -> int | None:
    m = _STYLE.match(style.strip())
    return min(int(m[1]), 6) if m else None


def style_is_list(style: str) -> bool:
    return re.sub("[- ]", "", style.strip().lower()).startswith(("list", "bullet"))


def _grid(rows: list[list[tuple[str, int, bool, bool]]], **more) -> dict | None:
    """A table of rows of (text, span, continues left, continues above)."""
    rows = [r for r in rows if r]
    width = max((sum(max(c[1], 1) for c in r) for r in rows), default=0)
    if not width:
        return None
    grid, left, down = [], [], []
    for y, cells in enumerate(rows):
        text, aside, above = [""] * width, [False] * width, [False] * width
        at = 0
        for words, span, beside, under in cells:
            if at >= width:
                break
            span = min(max(span, 1), width - at)
            text[at], aside[at], above[at] = _tidy(words), beside and at > 0, under and y > 0
            aside[at + 1 : at + span] = [True] * (span - 1)
            at += span
        grid.append(text)
        left += aside
        down += above
    return table(grid, 1, down, left, **more)


# ---- Word --------------------------------------------------------------------------------

_WORD_BREAKS = {"tab": "\t", "br": " ", "cr": " "}


def _inside(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    """Nodes of a name below a node, but not below each other or below a table within."""
    found, todo = [], [iter(node)]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif _name(child) == name:
            found.append(child)
        elif _name(child) != "tbl":
            todo.append(iter(child))
    return found


def _word_table(node: ElementTree.Element) -> dict | None:
    """Rows of the table itself; a table within a cell is part of that cell's text."""
    rows = []
    for tr in _inside(node, "tr"):
        cells = []
        for tc in (c for c in tr if _name(c) == "tc"):
            span, merge = _child(tc, "tcPr", "gridSpan"), _child(tc, "tcPr", "vMerge")
            words = " ".join(_runs(p, _WORD_BREAKS) for p in tc.iter() if _name(p) == "p")
            cells.append((words, _count(_value(span, "val")) if span is not None else 1, False, merge is not None and _value(merge, "val") != "restart"))
        rows.append(cells)
    return _grid(rows)


def parse_word_xml(xml: str | bytes) -> list[dict]:
    out: list[dict] = []

    def visit(node: ElementTree.Element) -> None:
        for child in node:
            name = _name(child)
            if name == "tbl":
                found = _word_table(child)
                out.extend([found] if found else [])
            elif name == "p":
                text = _tidy(_runs(child, _WORD_BREAKS))
                style_node = _child(child, "pPr", "pStyle")
                style = _value(style_node, "val") or "" if style_node is not None else ""
                level = style_level(style)
                if text:
                    listed = _child(child, "pPr", "numPr") is not None or style_is_list(style)
                    out.append(element(TITLE if level else ITEM if listed else PARAGRAPH, text, level))
            else:
                visit(child)

    visit(ElementTree.fromstring(xml))
    return out


def parse_docx(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        return parse_word_xml(package.read("word/document.xml"))


# ---- PowerPoint --------------------------------------------------------------------------


def parse_chart_xml(xml: str | bytes, page: int = 0) -> list[dict]:
    """A chart's cached data as a table, after its title: categories down, series across."""
    root = ElementTree.fromstring(xml)
    title = " ".join(_tidy(_runs(n, {})) for n in root.iter() if _name(n) == "title").strip()
    values = lambda n: [(v.text or "").strip() for v in n.iter() if _name(v) == "v"] if n is not None else []
    either = lambda n, *names: next((c for c in n if _name(c) in names), None)
    categories: list[str] = []
    series = []
    for ser in (n for n in root.iter() if _name(n) == "ser"):
        categories = categories or values(either(ser, "cat", "xVal"))
        name = values(either(ser, "tx"))
        series.append((name[-1] if name else "", values(either(ser, "val", "yVal"))))
    if not series:
        return []
    height = max(len(categories), *(len(v) for _, v in series))
    at = lambda xs, i: xs[i] if i < len(xs) else ""
    rows = [["", *(n for n, _ in series)], *([at(categories, i), *(at(v, i) for _, v in series)] for i in range(height))]
    return [*([element(TITLE, title, 2, page=page)] if title else []), table(rows, 1, page=page, evidence="pptx-chart")]


def parse_slide_xml(xml: str | bytes, page: int = 0, charts: dict[str, bytes] | None = None) -> list[dict]:
    out: list[dict] = []

    def visit(node: ElementTree.Element, titled: bool) -> None:
        for child in node:
            name = _name(child)
            if name == "sp":
                holder = next((n for n in child.iter() if _name(n) == "ph"), None)
                visit(child, holder is not None and _value(holder, "type") in ("title", "ctrTitle"))
            elif name == "tbl":
                rows = [[(" ".join(_runs(p, {"br": " "}) for p in tc.iter() if _name(p) == "p"), 1, _value(tc, "hMerge") is not None, _value(tc, "vMerge") is not None) for tc in tr if _name(tc) == "tc"] for tr in child if _name(tr) == "tr"]
                found = _grid(rows, page=page)
                if found:
                    width = len(found["cells"][0])
                    left = found["merged_left"] or [False] * (width * len(found["cells"]))
                    for y, tr in enumerate(t for t in child if _name(t) == "tr"):
                        for x, tc in enumerate(c for c in tr if _name(c) == "tc"):
                            for k in range(1, _count(_value(tc, "gridSpan"))):
                                if x + k < width:
                                    left[y * width + x + k] = True
                    found["merged_left"] = left if any(left) else None
                    out.append(found)
            elif name == "chart" and charts:
                part = charts.get(_value(child, "id") or "")
                out.extend(parse_chart_xml(part, page) if part else [])
            elif name == "p":
                text = _tidy(_runs(child, {"br": " "}))
                props = _child(child, "pPr")
                marks = [] if props is None else [_name(c) for c in props]
                listed = ("buNone" not in marks and ("buChar" in marks or "buAutoNum" in marks)) or (props is not None and int(_value(props, "lvl") or 0) > 0)
                if text:
                    out.append(element(TITLE if titled else ITEM if listed else PARAGRAPH, text, 1 if titled else None, page=page))
            else:
                visit(child, titled)

    visit(ElementTree.fromstring(xml), False)
    return out


def parse_pptx(content: bytes) -> list[dict]:
    """Slides in numeric order; a slide is a page."""
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        names = set(package.namelist())
        slides = sorted((int(m[1]), n) for n in names if (m := _SLIDE.match(n)))
        for page, (_, name) in enumerate(slides):
            charts: dict[str, bytes] = {}
            related = f"ppt/slides/_rels/{posixpath.basename(name)}.rels"
            if related in names:
                for link in ElementTree.fromstring(package.read(related)):
                    target = posixpath.normpath(posixpath.join("ppt/slides", link.get("Target", "")))
                    if "charts/" in target and target in names:
                        charts[link.get("Id", "")] = package.read(target)
            out += parse_slide_xml(package.read(name), page, charts)
    return out


def read_docx(files: DataFrame, content: str = "content", doc_id: str = "doc_id") -> DataFrame:
    return read_elements(files, content, doc_id, lambda b: parse_docx(bytes(b)), "docx")


def read_pptx(files: DataFrame, content: str = "content", doc_id: str = "doc_id") -> DataFrame:
    return read_elements(files, content, doc_id, lambda b: parse_pptx(bytes(b)), "pptx")


# ---- files -------------------------------------------------------------------------------

#: Reader of each file extension; a directory offers the short list only.
READERS = {**dict.fromkeys(("html", "htm", "xhtml"), "html"), **dict.fromkeys(("md", "markdown", "txt", "text"), "markdown"), **dict.fromkeys(("docx", "docm", "dotx", "dotm"), "docx"), **dict.fromkeys(("pptx", "pptm", "potx", "potm", "ppsx", "ppsm"), "pptx")}
LISTED = ("html", "htm", "xhtml", "md", "markdown", "docx", "pptx")


def read_files(spark, path: str, listed_only: bool = True) -> DataFrame:
    """Elements of every readable file below a directory, with its path; one scan for all kinds."""
    from quire.sources import html, markdown

    kinds = {k: v for k, v in READERS.items() if not listed_only or k in LISTED}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    known = files.where(extension.isin(*kinds)).select("path", F.xxhash64("path").alias("doc_id"), F.struct(extension.alias("kind"), "content").alias("file"))
    parsers = {"html": lambda b: html.parse(b.decode("utf-8", "replace")), "markdown": lambda b: markdown.parse(b.decode("utf-8", "replace")), "docx": parse_docx, "pptx": parse_pptx}
    parsed = read_elements(known, "file", "doc_id", lambda f: [e | {"evidence": kinds[f["kind"]]} for e in parsers[kinds[f["kind"]]](bytes(f["content"]))], "file")
    return parsed.withColumn("provenance", F.col("evidence")).join(known.select("path", "doc_id"), "doc_id")


# ---- images ------------------------------------------------------------------------------


def image_header(column) -> "F.Column":
    """struct(format, width, height) of PNG, JPEG or TIFF bytes; null for anything else."""

    @F.pandas_udf("format string, width int, height int")
    def sniff(content: "pd.Series") -> "pd.DataFrame":
        return pd.DataFrame([image_size(b) or (None, None, None) for b in content], columns=["format", "width", "height"])

    return sniff(column)


import pandas as pd  # noqa: E402


def image_size(data: bytes | None) -> tuple[str, int, int] | None:
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 or mark == 1 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return None
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = "little" if data[:2] == b"II" else "big"
        at = int.from_bytes(data[4:8], order)
        sizes = {}
        for i in range(int.from_bytes(data[at : at + 2], order)):
            entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
            tag, kind = int.from_bytes(entry[:2], order), int.from_bytes(entry[2:4], order)
            if tag in (256, 257):
                sizes[tag] = int.from_bytes(entry[8 : 10 if kind == 3 else 12], order)
        return ("tiff", sizes[256], sizes[257]) if len(sizes) == 2 else None
    return None
