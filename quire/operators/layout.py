"""Operators over positioned text: overprint, running lines, leading, blocks, links, routes; lines are in `lines`.

Tables are keyed by (doc_id, page).  What can be said with windows and aggregates is;
anchored clustering runs as one grouped pass over a page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import digits_as_hash

PAGE = ["doc_id", "page"]


def upper_median(value: Column) -> Column:
    """The upper of two middle values, as an aggregate."""
    return F.element_at(F.array_sort(F.collect_list(value)), (F.expr("1") + F.floor(F.count(value) / 2)).cast("int"))


def rotation_bucket(rotation: Column) -> Column:
    return (F.round(rotation / 15) * 15).cast("int")


def classify_path(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """`H` or `V` for thin long boxes (rules), `fill` for other boxes that cover something."""
    w, h = x1 - x0, y1 - y0
    return F.when((h <= 3) & (w >= 4 * h) & (w > 0), "H").when((w <= 3) & (h >= 4 * w) & (h > 0), "V").when((w > 0) & (h > 0), "fill")


def without_overprint(glyphs: DataFrame, window: int = 8) -> DataFrame:
    """Drops glyphs printed again over one of the `window` before them: same text, page and rotation,
    a shift below a quarter of the earlier one's advance across (0.3 of the height, if it has none)
    and 0.3 of the height down.  Dropped glyphs are not compared with later ones."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("draw_index", kind="stable")
        text = page["text"].to_numpy(object)
        rotation = np.round(page["rotation_deg"].fillna(0).to_numpy(float) / 15)
        x, y, bottom, advance = (page[c].to_numpy(float) for c in ("x0", "y0", "y1", "advance"))
        height = bottom - y
        over = np.zeros((window, len(page)), bool)
        with np.errstate(invalid="ignore"):
            for k in range(1, min(window, len(page) - 1) + 1):
                tall = np.fmax(height[k:], height[:-k])
                across = np.where(advance[:-k] > 0, 0.25 * advance[:-k], 0.3 * tall)
                over[k - 1, k:] = (text[k:] == text[:-k]) & (rotation[k:] == rotation[:-k]) & (np.abs(x[k:] - x[:-k]) < across) & (np.abs(y[k:] - y[:-k]) < 0.3 * tall)
        keep = np.ones(len(page), bool)
        for i in np.flatnonzero(over.any(axis=0)).tolist():
            keep[i] = not any(over[k - 1, i] and keep[i - k] for k in range(1, window + 1))
        return page[keep]

    return glyphs.groupBy(*PAGE).applyInPandas(run, glyphs.schema)


def furniture(found: DataFrame, share: float = 0.3, least: int = 3, tolerance: float = 0.02, pages: DataFrame | None = None) -> DataFrame:
    """Lines that run through a document, with `role`: PageNumber, Header, Footer or Watermark.

    `found`: doc_id, page, line, text, rel_y (top over page height).  Lines near the edges
    are told by their text with digits as one sign; others by their text.  A group must
    hold on enough pages, at a steady height.  `pages`: doc_id, page of all pages, if some
    have no lines.
    """
    edge = (F.col("rel_y") < 0.18) | (F.col("rel_y") > 0.82)
    keyed = found.withColumn("sign", F.when(edge, digits_as_hash(F.col("text"))).otherwise(F.col("text"))).where("trim(sign) <> ''")
    count = (found if pages is None else pages).groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least)
    need = F.greatest(F.ceil(F.col("pages") * share), F.lit(least))
    once = keyed.groupBy("doc_id", "sign", "page").agg(F.count("*").alias("__times"))
    repeated = once.groupBy("doc_id", "sign").agg((F.max("__times") > 1).alias("__twice"))
    groups = keyed.groupBy("doc_id", "sign").agg(F.countDistinct("page").alias("on"), upper_median(F.col("rel_y")).alias("middle"), F.countDistinct("text").alias("texts")).join(count, "doc_id").where(F.col("on") >= need).join(repeated, ["doc_id", "sign"])
    steady = keyed.join(groups, ["doc_id", "sign"]).where(F.abs(F.col("rel_y") - F.col("middle")) < tolerance)
    enough = steady.groupBy("doc_id", "sign").agg(F.count("*").alias("steady"))
    role = F.when(F.col("sign").contains("#") & (F.col("texts") > 1), "PageNumber").when(F.col("middle") < 0.18, "Header").when(F.col("middle") > 0.82, "Footer").otherwise("Watermark")
    named = steady.join(enough, ["doc_id", "sign"]).where(F.col("steady") >= need).withColumn("role", role)
    # a mark in the body that a page holds twice is content
    return named.where((F.col("role") != "Watermark") | ~F.col("__twice")).select("doc_id", "page", "line", "text", "role")


def modal_leading(found: DataFrame) -> DataFrame:
    """doc_id, leading: commonest pitch of lines in line heights, in steps of 0.05 from 0.3 to 2."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    pitch = (F.col("y0") - F.lag("y0").over(w)) / F.col("size")
    steps = found.withColumn("pitch", pitch).where("pitch BETWEEN 0.3 AND 2.0").groupBy("doc_id", F.floor(F.col("pitch") / 0.05).alias("step")).agg(F.count("*").alias("n"))
    return steps.groupBy("doc_id").agg(F.max(F.struct("n", -F.col("step"))).alias("top")).select("doc_id", (-F.col("top.col2") * 0.05 + 0.025).alias("leading"))


def body_size(found: DataFrame) -> DataFrame:
    """doc_id, body: commonest font size in quarter points, the smaller on ties."""
    sizes = found.groupBy("doc_id", F.round(F.col("size") * 4).alias("quarter")).agg(F.count("*").alias("n"))
    return sizes.groupBy("doc_id").agg((-F.max(F.struct("n", (-F.col("quarter")).alias("q")))["q"] / 4).alias("body"))


def blocks(found: DataFrame, leading: DataFrame) -> DataFrame:
    """doc_id, page, block, text, x0, y0, x1, y1, size, bold, n_lines: neighbouring lines that continue."""
    w = Window.partitionBy(*PAGE, "col").orderBy("line")
    f = found.join(leading, "doc_id", "left").withColumn("right", F.max("x1").over(Window.partitionBy(*PAGE, "col")))
    f = f.withColumn("left_edge", F.min("x0").over(Window.partitionBy(*PAGE, "col")))
    p = {c: F.lag(c).over(w) for c in ("rotation", "x0", "x1", "y0", "size", "bold")}
    pitch = F.col("y0") - p["y0"]
    goes_on = (p["rotation"] == F.col("rotation")) & (F.least(p["x1"], F.col("x1")) > F.greatest(p["x0"], F.col("x0"))) & (p["bold"] == F.col("bold")) & (F.abs(F.col("size") - p["size"]) <= 0.12 * p["size"]) & (pitch > 0) & (pitch <= 1.35 * F.coalesce("leading", F.lit(1.2)) * F.col("size")) & ((F.col("x0") - p["x0"] <= F.col("size")) | (F.col("right") - p["x1"] <= 0.15 * (F.col("right") - F.col("left_edge"))))
    f = f.withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    f = f.withColumn("block", F.sum("__new").over(Window.partitionBy(*PAGE).orderBy("col", "line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return f.groupBy(*PAGE, "block").agg(F.regexp_replace(text, r"(?<=\p{L})- (?=\p{Ll})", "").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"), F.max("bold").alias("bold"), F.count("*").alias("n_lines"))


def cover(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Share of box a that box b covers."""
    c = F.col
    w = F.greatest(F.lit(0.0), F.least(c(ax1), c(bx1)) - F.greatest(c(ax0), c(bx0)))
    h = F.greatest(F.lit(0.0), F.least(c(ay1), c(by1)) - F.greatest(c(ay0), c(by0)))
    area = (c(ax1) - c(ax0)) * (c(ay1) - c(ay0))
    return F.when(area > 0, w * h / area).otherwise(F.lit(0.0))


def link_owners(links: DataFrame, elements: DataFrame, share: float = 0.5) -> DataFrame:
    """link_id, seq, covered: the element that covers most of each link, at least `share` of it.

    links: doc_id, page, link_id, lx0..ly1; elements: doc_id, page, seq, x0..y1.  Ties go to
    the later element.
    """
    both = links.join(elements, PAGE).withColumn("covered", cover("lx0", "ly0", "lx1", "ly1", "x0", "y0", "x1", "y1")).where(F.col("covered") >= share)
    best = both.groupBy("doc_id", "page", "link_id").agg(F.max(F.struct("covered", "seq")).alias("b"))
    return best.select("doc_id", "page", "link_id", F.col("b.seq").alias("seq"), F.round("b.covered", 6).alias("covered"))


def routes(pages: DataFrame) -> DataFrame:
    """Pages with `verdict`: what reads them.

    pages: doc_id, page, events (glyph events), resolved (with Unicode), glyphs (not blank),
    image_cover, texty_cover, text_in_images.
    """
    rate = F.when(F.col("events") > 0, F.col("resolved") / F.col("events")).otherwise(F.lit(1.0))
    verdict = (
        F.when((F.col("glyphs") < 20) & (F.col("image_cover") > 0), "NearBlank")
        .when((F.col("image_cover") >= 0.5) & (F.col("glyphs") < 100), "Scanned")
        .when((F.col("events") >= 100) & (rate < 0.85), "BrokenText")
        .when((F.col("texty_cover") >= 0.1) & (F.col("text_in_images") < 15), "Regions")
        .otherwise("Deterministic")
    )
    return pages.withColumn("unicode_rate", rate).withColumn("verdict", verdict)


def triage(routed: DataFrame) -> DataFrame:
    """Per document: pages, routed pages and the share of glyph events with Unicode."""
    away = (F.col("verdict") != "Deterministic").cast("int")
    return routed.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(away).alias("routed"), F.round(F.sum("resolved") / F.greatest(F.sum("events"), F.lit(1)), 6).alias("unicode_rate"))


def unread_pages(routed: DataFrame, elements: DataFrame, least: int = 40) -> DataFrame:
    """Routed pages that gave fewer than `least` characters."""
    got = elements.groupBy(*PAGE).agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    return routed.where("verdict <> 'Deterministic'").join(got, PAGE, "left").withColumn("chars", F.coalesce("chars", F.lit(0)).cast("long")).where(F.col("chars") < least).select(*PAGE, "verdict", "chars")
