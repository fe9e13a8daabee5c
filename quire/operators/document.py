"""The whole layout pass: from glyphs, rules and fills to the element table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import figures as fg
from quire.operators import grids as gr
from quire.operators import headings as hd
from quire.operators import layout as ly
from quire.operators import lines as ln
from quire.operators.readings import interleaved
from quire.store import written

PAGE = ["doc_id", "page"]


def without_lattices(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """Rules without the construction lattices of their pages."""
    columns = rules.columns
    sized = rules.join(pages.select(*PAGE, F.col("width").cast("double").alias("__w"), F.col("height").cast("double").alias("__h")), PAGE)

    def run(page: pd.DataFrame) -> pd.DataFrame:
        return gr.without_lattice(page, float(page["__w"].iloc[0]), float(page["__h"].iloc[0]))[columns]

    return sized.groupBy(*PAGE).applyInPandas(run, rules.schema)


def analyze(glyphs: DataFrame, pages: DataFrame, rules: DataFrame | None = None, fills: DataFrame | None = None, outline: DataFrame | None = None) -> DataFrame:
    """doc_id, page, seq, type, level, text, cells, header_rows, merges, evidence, x0..y1: elements in reading order.

    What several steps read is written in the shared folder, so that plans stay short.

    Overprint goes first, then tables take their glyphs, then lines, running lines, blocks,
    headings and drawings.  pages: doc_id, page, width, height.
    """
    clean = written(ly.without_overprint(glyphs))
    ruled = without_lattices(rules, pages) if rules is not None else None
    marks = gr.marks(clean, ruled, fills)
    tables = written(gr.grids(marks))
    found = written(ln.lines(gr.outside_grids(clean, tables), ruled))
    placed = found.join(pages.select(*PAGE, "height"), PAGE).withColumn("rel_y", F.col("y0") / F.col("height"))
    running = ly.furniture(placed, pages=pages).select(*PAGE, "line")
    body = written(found.join(running, [*PAGE, "line"], "left_anti"))
    blocks = written(hd.attach_markers(hd.split_prefix(ly.blocks(body, ly.modal_leading(body)))))
    drawn = fg.in_figures(blocks, fg.figures(marks, blocks, pages))
    content = written(hd.kinds(hd.detect(drawn, outline)))
    order = Window.partitionBy("doc_id").orderBy("page", "block")
    content = content.withColumn("seq", F.row_number().over(order)).select("doc_id", "page", "seq", "type", "level", "text", "evidence", "x0", "y0", "x1", "y1")
    table_rows = gr.elements_of(tables).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0")))
    cells = {"cells": "array<array<string>>", "header_rows": "int", "merged_down": "array<boolean>", "merged_left": "array<boolean>"}
    content = content.withColumns({c: F.lit(None).cast(t) for c, t in cells.items()})
    merged = interleaved(content, table_rows.withColumn("level", F.lit(None).cast("int")).select(*content.columns))
    return hd.joined_fragments(merged)
