"""Readings by other readers: sidecar files, anchors and crops, arbitration, splicing and cleaning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import is_float_caption, is_refusal, letters, strip_tags, table_shape, values
from quire.operators.evidence import FURNITURE_LABELS, arbitrate, digits
from quire.schema import FIGURE, ITEM, PARAGRAPH, TABLE, TITLE

TITLES = ("paragraph_title", "doc_title", "title")
FLOAT_TITLES = ("figure_title", "chart_title", "table_title", "figure_caption")
FLOATS = ("chart", "image", "figure")

# ---- sidecar files -----------------------------------------------------------------------

BOX = "array<struct<label:string,score:double,box:array<double>>>"
READING = "array<struct<parsing_res_list:array<struct<block_label:string,block_content:string,block_order:int>>>>"


def read_layout(spark: SparkSession, folder: str, least: float = 0.6) -> DataFrame:
    """stem, page, label, score, bx0..by1 of `{stem}_p{page}_page.json`; boxes are of a double-size picture, so halved.

    Files that hold no such list give no rows.
    """
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*_page.json", recursiveFileLookup=True).select(name.alias("name"), F.explode(F.from_json("value", BOX)).alias("b"))
    at = r"^(.*)_p([0-9]+)_page$"
    half = [(F.col("b.box")[i] / 2).alias(c) for i, c in enumerate(("bx0", "by0", "bx1", "by1"))]
    return rows.where((F.col("b.score") >= least) & (F.size("b.box") == 4)).select(F.regexp_extract("name", at, 1).alias("stem"), F.regexp_extract("name", at, 2).cast("int").alias("page"), F.col("b.label").alias("label"), F.col("b.score").alias("score"), *half)


def read_readings(spark: SparkSession, folder: str) -> DataFrame:
    """stem, crop, label, content, block_order of `{stem}_{crop}.json`; crop is p0_r0, p0_t0, p0_n0 or p0_full."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(name.alias("name"), F.explode(F.from_json("value", READING)).alias("p")).select("name", F.explode("p.parsing_res_list").alias("b"))
    at = r"^(.*)_(p[0-9]+_(?:[rtn][0-9]+|full))$"
    return rows.where(F.regexp_extract("name", at, 2) != "").select(F.regexp_extract("name", at, 1).alias("stem"), F.regexp_extract("name", at, 2).alias("crop"), F.col("b.block_label").alias("label"), F.col("b.block_content").alias("content"), F.col("b.block_order").alias("block_order"))


# ---- anchors and crops -------------------------------------------------------------------


def anchor_text(kind: str, page: Column, number: Column) -> Column:
    """`[[VLM:p0:r1]]` for regions, `[[VLMTAB:p0:t1]]` for tables, `[[VLMNEW:p0:n1]]` for tables that no grid found."""
    head, tag = {"region": ("VLM", "r"), "table": ("VLMTAB", "t"), "insert": ("VLMNEW", "n")}[kind]
    return F.concat(F.lit(f"[[{head}:p"), page.cast("string"), F.lit(f":{tag}"), number.cast("string"), F.lit("]]"))


def parsed_anchor(text: Column) -> Column:
    """struct(crop, kind) of an anchor's text; null for other texts."""
    at = r"^\[\[(VLM|VLMTAB|VLMNEW):([^:\]]+):([^\]]+)\]\]$"
    head = F.regexp_extract(text, at, 1)
    kind = F.when(head == "VLM", "region").when(head == "VLMTAB", "table").when(head == "VLMNEW", "insert")
    return F.when(head != "", F.struct(F.concat_ws("_", F.regexp_extract(text, at, 2), F.regexp_extract(text, at, 3)).alias("crop"), kind.alias("kind")))


def anchors(regions: DataFrame, doubtful: DataFrame, missing: DataFrame) -> DataFrame:
    """doc_id, page, x0..y1, type, text, evidence: anchors of routed regions, doubtful tables and missing tables.

    Each input: doc_id, page, number, x0..y1.
    """
    out = None
    for df, kind, evidence in ((doubtful, "table", "table-confidence"), (missing, "insert", "table-missing"), (regions, "region", "route")):
        part = df.select("doc_id", "page", "x0", "y0", "x1", "y1", F.lit(FIGURE).alias("type"), anchor_text(kind, F.col("page"), F.col("number")).alias("text"), F.lit(evidence).alias("evidence"))
        out = part if out is None else out.unionByName(part)
    return out


def crop_jobs(routed: DataFrame, regions: DataFrame, tables: DataFrame, doubted: DataFrame | None = None) -> DataFrame:
    """doc_id, page, crop, kind, x0..y1: what to read again.

    A page that is routed as a whole (or doubted) supersedes its regions and tables.
    regions, tables: doc_id, page, number, x0..y1; routed: doc_id, page, verdict.
    """
    whole = routed.where("verdict NOT IN ('Deterministic', 'Regions')").select("doc_id", "page")
    if doubted is not None:
        whole = whole.union(doubted.select("doc_id", "page"))
    whole = whole.distinct()
    none = [F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    pages = whole.select("doc_id", "page", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_full")).alias("crop"), F.lit("full").alias("kind"), *none)
    for df, kind, tag in ((regions, "region", "r"), (tables, "table", "t")):
        crop = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(f"_{tag}"), F.col("number").cast("string"))
        part = df.select("doc_id", "page", crop.alias("crop"), F.lit(kind).alias("kind"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
        pages = pages.unionByName(part.join(whole, ["doc_id", "page"], "left_anti"))
    return pages


def with_margin(crops: DataFrame, boxes: DataFrame, margin: float = 6.0, scale: float = 2.0) -> DataFrame:
    """Crops with rx0..ry1: their box and that of layout boxes on it, a margin around, in pixels of the picture."""
    b = boxes.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), "bx0", "by0", "bx1", "by1")
    met = crops.join(b, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (F.col("bx0") < F.col("x1")) & (F.col("bx1") > F.col("x0")) & (F.col("by0") < F.col("y1")) & (F.col("by1") > F.col("y0")), "left")
    g = met.groupBy(*crops.columns).agg(F.min("bx0").alias("__x0"), F.min("by0").alias("__y0"), F.max("bx1").alias("__x1"), F.max("by1").alias("__y1"))
    low = lambda a, c: ((F.least(F.col(a), F.coalesce(F.col(c), F.col(a))) - margin) * scale)
    high = lambda a, c: ((F.greatest(F.col(a), F.coalesce(F.col(c), F.col(a))) + margin) * scale)
    return g.withColumns({"rx0": F.greatest(F.lit(0.0), low("x0", "__x0")), "ry0": F.greatest(F.lit(0.0), low("y0", "__y0")), "rx1": high("x1", "__x1"), "ry1": high("y1", "__y1")}).drop("__x0", "__y0", "__x1", "__y1")


#: What a reader is asked, by the kind of crop.
PROMPTS = {
    "table": "Transcribe the table on this picture as one HTML table: a row for each printed row, a cell for each printed cell, spans where cells are merged. Print numbers exactly as they stand. Give nothing else.",
    "region": "Transcribe what this picture prints: labels with their values, line by line, as Markdown. Don't describe the picture. Give nothing else.",
    "full": "Transcribe this page in reading order as Markdown: headings, paragraphs, lists, and tables as HTML. Leave running headers, footers and page numbers out. Give nothing else.",
}
BOXED_HINT = " A layout model sees a table here."


def prompts(crops: DataFrame, links: DataFrame, boxed: DataFrame | None = None) -> DataFrame:
    """Crops with `prompt`: by kind, with a hint where a table was boxed, and the links that lie on the crop.

    links: doc_id, page, uri, anchor, lx0..ly1; boxed: doc_id, crop.
    """
    base = F.create_map(*[F.lit(x) for kv in PROMPTS.items() for x in kv])[F.col("kind")]
    x = links.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), "uri", "anchor", "lx0", "ly0", "lx1", "ly1")
    mx, my = (F.col("lx0") + F.col("lx1")) / 2, (F.col("ly0") + F.col("ly1")) / 2
    on = (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (F.col("x0").isNull() | (mx.between(F.col("x0"), F.col("x1")) & my.between(F.col("y0"), F.col("y1"))))
    told = F.concat(F.lit("["), F.col("anchor"), F.lit("]("), F.col("uri"), F.lit(")"))
    near = crops.join(x, on).groupBy("doc_id", "crop").agg(F.array_join(F.array_sort(F.collect_set(told)), ", ").alias("__links"))
    out = crops.join(near, ["doc_id", "crop"], "left")
    if boxed is not None:
        out = out.join(boxed.select("doc_id", "crop").distinct().withColumn("__boxed", F.lit(True)), ["doc_id", "crop"], "left")
    else:
        out = out.withColumn("__boxed", F.lit(None).cast("boolean"))
    hint = F.when(F.coalesce("__boxed", F.lit(False)) & (F.col("kind") != "full"), F.lit(BOXED_HINT)).otherwise(F.lit(""))
    linked = F.when(F.col("__links").isNotNull(), F.concat(F.lit(" Links on it: "), F.col("__links"), F.lit("."))).otherwise(F.lit(""))
    return out.withColumn("prompt", F.concat(base, hint, linked)).drop("__links", "__boxed")


def is_cut(reason: Column) -> Column:
    """Whether a reader's reply ended for another reason than being done."""
    return reason.isNotNull() & (F.upper(reason) != "STOP") & (F.trim(reason) != "")


def escalates(on: bool, off: bool, configured: bool, credentials: bool) -> bool:
    """Flags over configuration; without credentials nothing is read again unless asked for."""
    return on or (configured and credentials and not off)


# ---- cleaning ----------------------------------------------------------------------------


def _digit_pattern(pattern: str) -> re.Pattern:
    return re.compile("[0-9]+".join(re.escape(p) for p in re.split("[0-9]+", pattern)))


def scrubbed(text: str, furniture: list[tuple[str, bool]], in_cell: bool = True) -> str:
    """Text without a document's running lines; blanks are squeezed.

    furniture: (line, whether its digits vary).  A line of digits alone stands for a page
    number: it goes only as a whole cell of its width.  What is left goes too if it is a
    long beginning of a running line.
    """
    for line, varies in furniture:
        if not line:
            continue
        if not varies:
            text = text.replace(line, " ")
        elif re.search("[0-9]", line):
            if re.fullmatch("[0-9]+", line):
                t = text.strip()
                if in_cell and re.fullmatch("[0-9]+", t) and len(t) == len(line):
                    text = ""
            else:
                text = _digit_pattern(line).sub(" ", text)
    text = " ".join(text.split())
    return "" if len(text) >= 24 and any(line.startswith(text) for line, _ in furniture) else text


def scrubbed_lines(text: str, furniture: list[tuple[str, bool]]) -> str:
    """A reading line by line: a line that lost something and has no letters left goes; blank runs become one."""
    out: list[str] = []
    for line in text.split("\n"):
        rest = scrubbed(line, furniture)
        if rest == line:
            kept = line
        elif not any(c.isalpha() for c in rest):
            continue
        else:
            kept = rest
        if kept.strip() or not (out and not out[-1].strip()):
            out.append(kept)
    return "\n".join(out).rstrip()


def scrub(elements: DataFrame, furniture: DataFrame) -> DataFrame:
    """Elements without running lines: cells of tables, blocks, and readings line by line.

    furniture: doc_id, text, varies.  Of lines with equal digit shapes one stands for all.  A
    block left without a letter or digit by this is gone.
    """
    shape = F.regexp_replace("text", "[0-9]", "0")
    one = furniture.groupBy("doc_id", shape.alias("shape"), F.length("text").alias("n")).agg(F.min("text").alias("text"), F.max("varies").alias("varies"))
    known = one.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("text", "varies"))).alias("__furniture"))
    joined = elements.join(known, "doc_id", "left")

    @F.pandas_udf("struct<text:string,cells:array<array<string>>>")
    def clean(text: pd.Series, cells: pd.Series, kind: pd.Series, origin: pd.Series, lines: pd.Series) -> pd.DataFrame:
        out = []
        for t, rows, k, o, known in zip(text, cells, kind, origin, lines):
            known = [(x["text"], x["varies"]) for x in known] if known is not None else []
            rows = None if rows is None else [list(r) for r in rows]
            if known and rows is not None:
                rows = [[scrubbed(c, known) for c in r] for r in rows]
                t = "\n".join(" | ".join(r) for r in rows)
            elif known and o == "vlm":
                t = scrubbed_lines(t, known)
            elif known and t:
                t = scrubbed(t, known, in_cell=False)
            out.append((t, rows))
        return pd.DataFrame(out, columns=["text", "cells"])

    done = joined.withColumn("__c", F.when(F.col("__furniture").isNotNull(), clean("text", "cells", "type", "provenance", "__furniture")))
    done = done.withColumn("__lost", F.col("__c").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]") & ~F.coalesce(F.col("__c.text"), F.lit("")).rlike(r"[\p{L}\p{N}]") & (F.col("type") != TABLE))
    return done.where("NOT __lost").withColumns({"text": F.when(F.col("__c").isNotNull(), F.col("__c.text")).otherwise(F.col("text")), "cells": F.when(F.col("__c").isNotNull(), F.col("__c.cells")).otherwise(F.col("cells"))}).select(*elements.columns)


def marks_an_item(c: Column) -> Column:
    """A number of at most three digits, with a dot or bracket behind it or none."""
    return F.trim(c).rlike(r"^[0-9]{1,3}[.)]*$") & (F.length(F.regexp_replace(F.trim(c), "[.)]+$", "")) <= 3)


def without_item_headings(c: Column) -> Column:
    """Lines that are headings over a bare number lose their marks."""
    return F.regexp_replace(c, r"(?m)^[ \t]*#+[ \t]+([0-9]{1,3}[.)]*)[ \t]*$", "$1")


def with_chart_title(c: Column) -> Column:
    """A chart's reading whose second line counts responses: its first two lines become a heading."""
    at = r"(?s)^[ \t]*([^\n]{1,80}?)[ \t]*\n[ \t]*([0-9,]*[0-9][0-9,]*[ \t]+(?i:responses?))[ \t]*(?:\n(.*))?$"
    head = F.concat(F.lit("# "), F.regexp_extract(c, at, 1), F.lit(" "), F.regexp_replace(F.regexp_extract(c, at, 2), r"[ \t]+", " "))
    rest = F.regexp_extract(c, at, 3)
    return F.when(c.rlike(at) & (F.trim(F.regexp_extract(c, at, 1)) != ""), F.when(rest == "", head).otherwise(F.concat(head, F.lit("\n\n"), rest)))


def cleaned_reply(c: Column) -> Column:
    """A reply without code fences around it; a table of one row and one cell becomes its text."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*\n", ""), r"\n?```\s*$", ""))
    rows, cells = F.size(F.regexp_extract_all(bare, F.lit(r"(?i)(<tr\b)"), F.lit(1))), F.size(F.regexp_extract_all(bare, F.lit(r"(?i)(<t[dh]\b)"), F.lit(1)))
    return F.when(bare.rlike(r"(?i)^<table\b") & (rows <= 1) & (cells == 1), strip_tags(bare)).otherwise(bare)


def reading_texts(blocks: DataFrame, key: list[str]) -> DataFrame:
    """key, reading: a crop's blocks in order without running lines and refusals; titles get `# ` unless they count items."""
    content = F.col("content")
    kept = blocks.where(~F.col("label").isin(*FURNITURE_LABELS) & (F.trim(content) != "") & ~is_refusal(content))
    part = F.when(F.col("label").isin(*TITLES) & ~marks_an_item(content), F.concat(F.lit("# "), content)).otherwise(without_item_headings(content))
    order = F.coalesce("block_order", F.lit(2**31 - 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), part.alias("t")))), lambda x: x["t"]), "\n\n")
    return kept.groupBy(*key).agg(text.alias("reading"))


# ---- splicing ----------------------------------------------------------------------------


def substitute_pages(elements: DataFrame, readings: DataFrame, page_text: DataFrame, least: float = 0.5) -> DataFrame:
    """Pages with a reading become one paragraph of it, unless it keeps under `least` of the page's letters.

    readings: doc_id, page, reading; page_text: doc_id, page, text.  Pages of under 100 letters
    aren't judged.  Elements keep their order; the paragraph stands where the page's first did.
    """
    own = page_text.select("doc_id", "page", letters(F.col("text")).alias("__own"))
    fit = readings.join(own, ["doc_id", "page"], "left").where((F.coalesce("__own", F.lit(0)) < 100) | (letters(F.col("reading")) >= least * F.col("__own"))).select("doc_id", "page", "reading")
    first = elements.groupBy("doc_id", "page").agg(F.min("seq").alias("__seq"))
    new = fit.join(first, ["doc_id", "page"], "left")
    row = {"seq": F.coalesce("__seq", F.lit(2**31 - 1)), "type": F.lit(PARAGRAPH), "text": F.col("reading"), "provenance": F.lit("vlm"), "evidence": F.lit("page-tier")}
    filled = new.select(*[row.get(c, F.col(c) if c in ("doc_id", "page") else F.lit(None)).cast(elements.schema[c].dataType).alias(c) for c in elements.columns])
    return elements.join(fit.select("doc_id", "page"), ["doc_id", "page"], "left_anti").select(*elements.columns).unionByName(filled)


def splice(elements: DataFrame, readings: DataFrame, page_text: DataFrame | None = None, structure: DataFrame | None = None) -> DataFrame:
    """Elements with anchors resolved by readings of their crops.

    elements: doc_id, page, seq, type, text, cells, provenance, evidence.  readings and
    structure: doc_id, crop, reading.  An anchor of a table stands before it: the table after
    it on the page is replaced by the reading or kept, by `arbitrate` and the three-way veto;
    the anchor goes.  Region and insert anchors take their reading, or go without one.
    """
    a = elements.withColumn("__a", parsed_anchor(F.col("text")))
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    table_at = F.when(F.col("type") == TABLE, F.col("seq"))
    # the next table of the page, that no other anchor of a table comes before
    a = a.withColumn("__next", F.min(table_at).over(w.rowsBetween(1, Window.unboundedFollowing)))
    asked = a.where("__a IS NOT NULL").select("doc_id", "page", "seq", "__next", F.col("__a.crop").alias("crop"), F.col("__a.kind").alias("kind")).join(readings.select("doc_id", "crop", "reading"), ["doc_id", "crop"], "left")
    if structure is not None:
        asked = asked.join(structure.select("doc_id", "crop", F.col("reading").alias("structure")), ["doc_id", "crop"], "left")
    else:
        asked = asked.withColumn("structure", F.lit(None).cast("string"))
    tables = asked.where("kind = 'table'").select("doc_id", F.col("__next").alias("seq"), "reading", "structure", F.col("seq").alias("__at"))
    last = Window.partitionBy("doc_id", "seq").orderBy(F.desc("__at"))
    tables = tables.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "__at")
    regions = asked.where("kind <> 'table'").select("doc_id", "seq", F.col("reading").alias("__text"), F.col("kind").alias("__kind"))
    t = a.where((F.col("type") == TABLE) & F.col("cells").isNotNull()).select("doc_id", "page", "seq", F.size("cells").alias("n_rows"), F.size(F.col("cells")[0]).alias("n_cols"), F.transform(F.flatten(F.transform("cells", lambda r: F.flatten(F.transform(r, values)))), digits).alias("own_values")).join(tables, ["doc_id", "seq"])
    if page_text is not None:
        t = t.join(page_text.select("doc_id", "page", F.transform(values(F.col("text")), digits).alias("page_values")), ["doc_id", "page"], "left")
    else:
        t = t.withColumn("page_values", F.lit(None).cast("array<string>"))
    judged = vetoed(arbitrate(t)).where("outcome = 'replace'").select("doc_id", "seq", F.col("reading").alias("__reading"))
    out = a.join(judged, ["doc_id", "seq"], "left").join(regions, ["doc_id", "seq"], "left")
    gone = (F.col("__a").isNotNull()) & F.col("__text").isNull()
    won, read = F.col("__reading").isNotNull(), F.col("__text").isNotNull()
    text = F.when(won, F.col("__reading")).when(read, F.coalesce(with_chart_title(F.col("__text")), F.col("__text"))).otherwise(F.col("text"))
    evidence = F.when(won, "shape-arbitrated").when(read & with_chart_title(F.col("__text")).isNotNull(), "region-chart").when(read, "region-splice").otherwise(F.col("evidence"))
    kind = F.when(read & table_shape(F.col("__text")).isNotNull(), TABLE).when(read, PARAGRAPH).otherwise(F.col("type"))
    new = {"text": text, "evidence": evidence, "type": kind, "provenance": F.when(won | read, "vlm").otherwise(F.col("provenance")), "cells": F.when(~won, F.col("cells"))}
    return out.where(~gone).withColumns(new).select(*elements.columns)


def vetoed(judged: DataFrame) -> DataFrame:
    """Outcomes of `arbitrate`, but `keep-vetoed` where a structure reading has our rows (within one) and one column fewer."""
    s = table_shape(F.col("structure"))
    veto = F.coalesce((F.abs(s["rows"] - F.col("n_rows")) <= 1) & (s["cols"] == F.col("n_cols") - 1), F.lit(False))
    return judged.withColumn("outcome", F.when(veto, "keep-vetoed").otherwise(F.col("outcome")))


def accepted(candidates: DataFrame) -> DataFrame:
    """Adds `accepted` and `reason`: whether a candidate's table may stand for ours.

    candidates: ours_rows, ours_values, rows, n_values, fabricated (share), crammed, ours_crammed, recall, ours_recall.
    """
    reason = (
        F.when(F.col("rows") == 0, "no table")
        .when(F.col("fabricated") > 0.03, "fabricated")
        .when(F.col("n_values") < 0.9 * F.col("ours_values"), "lost values")
        .when(F.col("recall") < F.col("ours_recall") - 0.05, "lower recall")
        .when(F.col("crammed") > F.col("ours_crammed"), "more crammed")
        .otherwise("ok")
    )
    return candidates.withColumn("reason", reason).withColumn("accepted", reason == "ok")


# ---- layout boxes ------------------------------------------------------------------------


def layout_role(label: Column) -> Column:
    return F.when(label.isin(*TITLES), "title").when(label.isin(*FLOAT_TITLES), "float-title").when(label.isin(*FLOATS), "float").when(label == "table", "table")


def arbitrate_titles(elements: DataFrame, boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Titles that layout boxes show to be captions become paragraphs; short texts in title boxes become titles.

    elements: with page, x0..y1; boxes: doc_id, page, label, bx0..by1.  Titles out of the
    outline stay.
    """
    b = boxes.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), layout_role(F.col("label")).alias("__role"), "bx0", "by0", "bx1", "by1").where("__role IS NOT NULL")
    w = F.greatest(F.lit(0.0), F.least("x1", "bx1") - F.greatest("x0", "bx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "by1") - F.greatest("y0", "by0"))
    on = (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (w * h >= share * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    met = elements.join(b, on).groupBy("doc_id", "seq").agg(F.collect_set("__role").alias("__roles"))
    e = elements.join(met, ["doc_id", "seq"], "left")
    holds = lambda r: F.coalesce(F.array_contains("__roles", r), F.lit(False))
    down = (F.col("type") == TITLE) & (F.coalesce(F.col("evidence"), F.lit("")) != "outline") & ~holds("title") & (holds("float") | (holds("float-title") & is_float_caption(F.col("text"))))
    up = F.col("type").isin(PARAGRAPH, ITEM) & holds("title") & (F.length("text") <= 120)
    new = {"type": F.when(down, PARAGRAPH).when(up, TITLE).otherwise(F.col("type")), "level": F.when(down, None).when(up, 2).otherwise(F.col("level")), "evidence": F.when(down, "layout-caption").when(up, "layout-title").otherwise(F.col("evidence"))}
    return e.withColumns(new).select(*elements.columns)


def interleaved(content: DataFrame, tables: DataFrame) -> DataFrame:
    """Content and tables of each page in one reading order, numbered by `seq`.

    content: doc_id, page, seq, x0..y1; tables: the same columns but their seq counts apart.
    A table comes after the last element above it that overlaps it across, or before the
    first one below; else at the page's end.
    """
    t = tables.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.col("seq").alias("__t"), F.col("x0").alias("__x0"), F.col("x1").alias("__x1"), F.col("y0").alias("__y0"))
    across = (F.col("x0") < F.col("__x1")) & (F.col("x1") > F.col("__x0"))
    met = content.join(t, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & across)
    above = F.max(F.when(F.col("y0") < F.col("__y0"), F.col("seq")))
    below = F.min(F.when(F.col("y0") >= F.col("__y0"), F.col("seq")))
    spot = met.groupBy("__d", "__p", "__t").agg(above.alias("above"), below.alias("below")).select(F.col("__d").alias("doc_id"), F.col("__p").alias("page"), F.col("__t").alias("seq"), F.coalesce(F.col("above") + 0.5, F.col("below") - 0.5).alias("__spot"))
    placed = tables.join(spot, ["doc_id", "page", "seq"], "left").withColumns({"__key": F.coalesce("__spot", F.lit(1e15)), "__sub": F.col("seq") + 1}).drop("__spot")
    both = content.withColumns({"__key": F.col("seq").cast("double"), "__sub": F.lit(0).cast(tables.schema["seq"].dataType)}).unionByName(placed, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("page", "__key", "__sub")
    return both.withColumn("seq", F.row_number().over(order)).drop("__key", "__sub")
