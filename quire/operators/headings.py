"""Headings of positioned documents, and kinds of blocks: markers, items, titles, paragraphs, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_caption, is_contents_marker, is_marker, is_title_like, normal_title, numbering_depth, starts_like_item, without_bullet
from quire.operators.figures import yields_to_figure
from quire.schema import FIGURE, ITEM, PARAGRAPH, TITLE
from quire.store import partitions_for

ORDER = ["page", "block"]


def reading() -> "Window":
    return Window.partitionBy("doc_id").orderBy(*ORDER)


def gap_above(blocks: DataFrame) -> DataFrame:
    """Adds `gap`: the distance to the block above on the page in sizes, null for a page's first."""
    w = Window.partitionBy("doc_id", "page").orderBy("block")
    return blocks.withColumn("gap", (F.col("y0") - F.lag("y1").over(w)) / F.col("size"))


def display_before_lettered(first: Column, second: Column) -> Column:
    """One capitalised word of display before an item `a. …`."""
    return F.trim(first).rlike(r"^\p{Lu}[\p{L}]{2,}[.:]?$") & F.coalesce(F.trim(second).rlike(r"^[a-z][.)]\s+\S"), F.lit(False))


def split_prefix(blocks: DataFrame) -> DataFrame:
    """Blocks whose first line is a display word before a lettered item, as two blocks; others as they are.

    blocks: doc_id, page, block, text, ... ; the parts share all but text, and `block` is numbered again.
    """
    at = r"^(\p{Lu}\p{L}{2,}[.:]?)\s+([a-z][.)]\s+\S(?s:.*))$"
    parts = F.when(F.col("text").rlike(at), F.array(F.regexp_extract("text", at, 1), F.regexp_extract("text", at, 2))).otherwise(F.array("text"))
    out = blocks.select("*", F.posexplode(parts).alias("__k", "__t")).withColumn("text", F.col("__t"))
    order = Window.partitionBy("doc_id", "page").orderBy("block", "__k")
    return out.withColumn("block", F.row_number().over(order)).drop("__k", "__t")


def split_at_titles(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines with `part`: a run of lines that one title box covers by half is a part of its own within its block.

    lines: doc_id, page, block, line, x0..y1; boxes: doc_id, page, bx0..by1 of titles.
    """
    b = boxes.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), "bx0", "by0", "bx1", "by1")
    w = F.greatest(F.lit(0.0), F.least("x1", "bx1") - F.greatest("x0", "bx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "by1") - F.greatest("y0", "by0"))
    on = (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (w * h >= 0.5 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    met = lines.join(b, on).groupBy("doc_id", "page", "block", "line").agg(F.min(F.struct("by0", "bx0")).alias("__box"))
    key = F.coalesce(F.concat_ws(",", F.col("__box.by0"), F.col("__box.bx0")), F.lit(""))
    order = Window.partitionBy("doc_id", "page", "block").orderBy("line")
    f = lines.join(met, ["doc_id", "page", "block", "line"], "left").withColumn("__key", key)
    f = f.withColumn("__new", (F.col("__key") != F.coalesce(F.lag("__key").over(order), F.col("__key"))).cast("int"))
    return f.withColumn("part", F.sum("__new").over(order)).drop("__box", "__key", "__new")


def attach_markers(blocks: DataFrame) -> DataFrame:
    """Blocks without lone markers; `marker` is the one that stands inside a block's height beside it, else above it nearest.

    blocks: doc_id, page, block, text, x0..y1, size.
    """
    shaped = is_marker(F.col("text")) & (F.length(F.regexp_replace("text", r"\s", "")) <= 4)
    marks = blocks.where(shaped).select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.col("block").alias("__m"), F.trim("text").alias("__text"), F.col("y0").alias("__y0"), F.col("y1").alias("__y1"), F.col("x0").alias("__x0"), F.col("size").alias("__size"))
    rest = blocks.where(~shaped)
    mid = (F.col("__y0") + F.col("__y1")) / 2
    inside = mid.between(F.col("y0"), F.col("y1"))
    near = (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (F.col("x0") >= F.col("__x0")) & (inside | ((F.col("y0") >= F.col("__y0")) & (F.col("y0") - F.col("__y1") <= 3 * F.col("__size"))))
    ranked = rest.join(marks, near).withColumn("__k", F.row_number().over(Window.partitionBy("__d", "__p", "__m").orderBy(F.desc(inside.cast("int")), F.abs(F.col("y0") - F.col("__y0")), "x0", "block")))
    own = ranked.where("__k = 1").groupBy("doc_id", "page", "block").agg(F.min_by("__text", "__m").alias("marker"))
    return rest.join(own, ["doc_id", "page", "block"], "left")


def checked(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines with `checkbox`: whether a small square stands before them, in their row and within three sizes."""
    b = boxes.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), F.col("x0").alias("__x0"), F.col("y0").alias("__y0"), F.col("x1").alias("__x1"), F.col("y1").alias("__y1"))
    gap = F.col("x0") - F.col("__x1")
    on = (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & (F.col("__y0") < F.col("y1")) & (F.col("__y1") > F.col("y0")) & (gap >= -1) & (gap < 3 * F.col("size"))
    met = lines.join(b, on, "left_semi").select("doc_id", "page", "line").distinct().withColumn("checkbox", F.lit(True))
    return lines.join(met, ["doc_id", "page", "line"], "left").withColumn("checkbox", F.coalesce("checkbox", F.lit(False)))


def is_corroborated(text: Column, size: Column, body: Column) -> Column:
    """Of a bare number before a title: body size, and a word of two letters after it that isn't led by digits."""
    bare = text.rlike(r"^\s*[0-9]+\s")
    rest = F.regexp_extract(text, r"^\s*[0-9]+\s+(.*)$", 1)
    return ~bare | ((size >= 0.95 * body) & ~F.regexp_extract(rest, r"^(\S*)", 1).rlike("[0-9]") & rest.rlike(r"\p{L}{2}"))


def detect(blocks: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Blocks with `evidence` and `level` of those that are headings; the first rule that applies.

    blocks: doc_id, page, block, text, y0, size, bold, n_lines.  Blocks behind a contents marker
    on its page, empty ones and those over 200 characters are passed over.  Then: the document's
    title (the largest of the first four short blocks of page 0), an outline entry of the same
    title (nearest page, then height), a display word before a lettered item, a number, bold, a
    size above 1.15 of the body's.  Bold and size headings get their level by rank of style.

    outline: doc_id, title, level, page, y (the latter two may be null).
    """
    quarter = F.round(F.col("size") * 4)
    sizes = blocks.groupBy("doc_id", quarter.alias("q")).agg(F.sum("n_lines").alias("n"))
    body = sizes.groupBy("doc_id").agg((-F.max(F.struct("n", (-F.col("q")).alias("q")))["q"] / 4).alias("body"))
    page = Window.partitionBy("doc_id", "page")
    doc = Window.partitionBy("doc_id")
    f = blocks.join(body, "doc_id", "left")
    text = F.trim("text")
    toc = F.min(F.when(is_contents_marker(F.col("text")), F.col("block"))).over(page)
    f = f.withColumn("__skip", (F.coalesce(F.col("block") > toc, F.lit(False))) | (text == "") | (F.length("text") > 200))
    # the title: the largest of the first four short blocks of the first page, larger than the body
    f = f.withColumn("__rank", F.when((F.col("page") == 0) & (F.length("text") <= 200), F.row_number().over(Window.partitionBy("doc_id", "page", F.length("text") <= 200).orderBy("block"))))
    short = (F.col("page") == 0) & (F.coalesce("__rank", F.lit(99)) <= 4) & ~F.col("__skip") & F.col("text").rlike(r"\p{L}")
    largest = F.max(F.when(short, F.struct(F.col("size"), -F.col("block")))).over(doc)
    title = short & (F.col("size") == largest["size"]) & (-F.col("block") == largest["col2"]) & (F.col("size") > 1.15 * F.col("body"))
    f = f.withColumns({"__title": F.coalesce(title, F.lit(False)), "__norm": normal_title(F.col("text")), "__next": F.lead("text").over(Window.partitionBy("doc_id", "page").orderBy("block"))})
    if outline is not None:
        o = outline.select(F.col("doc_id").alias("__od"), normal_title(F.col("title")).alias("__on"), F.col("level").alias("__ol"), F.col("page").alias("__op"), F.col("y").alias("__oy"))
        near = Window.partitionBy("doc_id", "page", "block").orderBy(F.coalesce(F.abs(F.col("__op") - F.col("page")), F.lit(2**31 - 1)), F.coalesce(F.abs(F.col("__oy") - F.col("y0")), F.lit(1e15)), "__ol")
        entry = f.join(o, (F.col("doc_id") == F.col("__od")) & (F.col("__norm") == F.col("__on")) & (F.col("__norm") != "")).withColumn("__k", F.row_number().over(near)).where("__k = 1").select("doc_id", "page", "block", F.col("__ol").alias("outline_level"))
        f = f.join(entry, ["doc_id", "page", "block"], "left")
    else:
        f = f.withColumn("outline_level", F.lit(None).cast("int"))
    bold = F.col("bold") & (F.length("text") <= 90) & (F.col("n_lines") <= 2)
    f = f.withColumns({"__bolds": F.sum(bold.cast("int")).over(page), "__mostly": 2 * F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)).over(doc) > F.sum(F.length("text")).over(doc)})
    depth = numbering_depth(F.col("text"))
    shaped = is_title_like(F.col("text"))
    evidence = (
        F.when(F.col("__skip"), None)
        .when(F.col("__title"), "title")
        .when(F.col("outline_level").isNotNull(), "outline")
        .when(~shaped, None)
        .when(display_before_lettered(F.col("text"), F.col("__next")), "sequence")
        .when(depth.isNotNull() & is_corroborated(F.col("text"), F.col("size"), F.col("body")), "numbering")
        .when(depth.isNotNull(), None)
        .when(bold & ~F.col("__mostly") & (F.col("__bolds") <= 10) & ~is_caption(F.col("text")), "bold")
        .when((F.col("size") > 1.15 * F.col("body")) & (F.length("text") <= 90) & (F.col("n_lines") <= 2), "font-size")
    )
    f = f.withColumn("evidence", evidence)
    style = F.struct((-quarter).alias("s"), (~F.col("bold")).alias("b"), (F.upper("text") != F.col("text")).alias("c"))
    ranked = F.coalesce(F.col("evidence").isin("bold", "font-size", "title"), F.lit(False))
    rank = F.dense_rank().over(Window.partitionBy("doc_id", ranked).orderBy(style))
    level = F.when(F.col("evidence").isin("title", "sequence"), 1).when(F.col("evidence") == "outline", F.col("outline_level")).when(F.col("evidence") == "numbering", F.least(depth, F.lit(6))).when(F.col("evidence").isNotNull(), F.least(rank, F.lit(6)))
    return f.withColumn("level", level.cast("int")).drop("__skip", "__rank", "__title", "__norm", "__next", "__bolds", "__mostly", "outline_level", "body")


def kinds(found: DataFrame) -> DataFrame:
    """Headings and blocks as elements: type, level, text, evidence.

    found: as `detect`, with `marker` and `figure` (null if none).  A heading by style within a
    drawing is its label; a block in a drawing is a figure; a marker or a bullet makes an item.
    """
    labelled = yields_to_figure(F.col("evidence"), F.col("figure"))
    heading = F.col("evidence").isNotNull() & ~labelled
    bare = without_bullet(F.col("text"))
    kind = F.when(heading, TITLE).when(F.col("figure").isNotNull(), FIGURE).when(F.col("marker").isNotNull() | bare.isNotNull(), ITEM).otherwise(PARAGRAPH)
    evidence = F.when(heading, F.col("evidence")).when(F.col("figure").isNotNull(), "fills").when(F.col("marker").isNotNull(), "marker").when(bare.isNotNull(), "bullet").otherwise("layout")
    text = F.when(~heading & F.col("figure").isNull() & F.col("marker").isNull() & bare.isNotNull(), bare).otherwise(F.col("text"))
    return found.withColumns({"type": kind, "evidence": evidence, "text": text, "level": F.when(heading, F.col("level"))})


def joined_fragments(elements: DataFrame) -> DataFrame:
    """Neighbouring titles of one level and evidence, of which the second begins in lower case, as one.

    elements: doc_id, seq, page, type, level, evidence, text; other columns are the first part's.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    p = {c: F.lag(c).over(w) for c in ("type", "level", "evidence", "page", "text")}
    goes_on = (F.col("type") == TITLE) & (p["type"] == TITLE) & (p["level"] == F.col("level")) & (p["evidence"] == F.col("evidence")) & (p["page"] == F.col("page")) & F.trim("text").rlike(r"^\p{Ll}") & ~F.trim(p["text"]).rlike(r"[.!?:;]$")
    e = elements.withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    rest = [c for c in elements.columns if c not in ("doc_id", "seq", "text")]
    g = e.groupBy("doc_id", "__run").agg(F.min("seq").alias("seq"), text.alias("text"), *[F.min_by(c, "seq").alias(c) for c in rest])
    return g.select(*elements.columns)


def contents_order(blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """Blocks numbered again: row by row on pages of several columns that hold a contents marker.

    columns: doc_id, page, n_cols.
    """
    page = Window.partitionBy("doc_id", "page")
    # the numbers of columns come along as rows, so that pages are brought together once
    both = blocks.withColumn("__own", F.lit(True)).unionByName(columns.select("doc_id", "page", "n_cols"), allowMissingColumns=True)
    n = partitions_for(both)
    both = both.repartition(n, "doc_id") if n else both
    marked = F.max(is_contents_marker(F.col("text")).cast("int")).over(page) == 1
    f = both.withColumn("__rows", marked & (F.coalesce(F.max("n_cols").over(page), F.lit(1)) > 1)).where("__own")
    order = Window.partitionBy("doc_id", "page").orderBy(F.when(F.col("__rows"), F.col("y0")), F.when(F.col("__rows"), F.col("x0")), "block")
    return f.withColumn("block", F.row_number().over(order)).drop("__own", "__rows", "n_cols")


def is_item_block(text: Column) -> Column:
    return starts_like_item(text) | without_bullet(text).isNotNull()
