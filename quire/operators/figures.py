"""Drawings on positioned pages: clusters of fills, the labels around them, and what lies inside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def distinct_boxes(boxes: np.ndarray, near: float = 0.5) -> np.ndarray:
    """Boxes without those whose four sides are all within `near` of an earlier one's."""
    kept: list[int] = []
    for k in range(len(boxes)):
        if not any(np.abs(boxes[k] - boxes[j]).max() <= near for j in kept):
            kept.append(k)
    return boxes[kept]


def _apart(boxes: np.ndarray) -> np.ndarray:
    """Larger of the gaps across and down between each two boxes, at least 0."""
    across = np.maximum(boxes[:, None, 0] - boxes[None, :, 2], boxes[None, :, 0] - boxes[:, None, 2])
    down = np.maximum(boxes[:, None, 1] - boxes[None, :, 3], boxes[None, :, 1] - boxes[:, None, 3])
    return np.maximum(np.maximum(across, down), 0)


def clusters(boxes: np.ndarray) -> list[np.ndarray]:
    """Numbers of the boxes of each cluster; the reach grows with the widest narrow side, from 24 to 80."""
    if not len(boxes):
        return []
    narrow = np.minimum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])
    near = _apart(boxes) <= float(np.clip(1.2 * narrow.max(), 24, 80))
    label = np.arange(len(boxes))
    while True:
        least = np.where(near, label[None, :], len(boxes)).min(axis=1)
        if (least == label).all():
            return [np.flatnonzero(label == k) for k in np.unique(label)]
        label = least


def figures_of(fills: np.ndarray, rules: np.ndarray, width: float, height: float) -> list[tuple[float, float, float, float]]:
    """Boxes of drawings: at least 3 shapes, large enough, not most of the page, not a table of bands."""
    boxes = distinct_boxes(fills)
    out = []
    for own in clusters(boxes):
        part = boxes[own]
        x0, y0, x1, y1 = part[:, 0].min(), part[:, 1].min(), part[:, 2].max(), part[:, 3].max()
        w, h = x1 - x0, y1 - y0
        if len(own) < 3 or min(w, h) < 24 or w * h < 2000 or (w > 0.55 * width and h > 0.55 * height):
            continue
        extents, times = np.unique(np.round(part[:, [0, 2]]), axis=0, return_counts=True)
        if times.max() > 0.6 * len(own):
            continue
        spans = [r for r in rules if r[2] - r[0] >= 0.8 * w and r[0] < x1 and r[2] > x0 and y0 - 6 <= (r[1] + r[3]) / 2 <= y1 + 6]
        if len(spans) < 2:
            out.append((float(x0), float(y0), float(x1), float(y1)))
    return sorted(out, key=lambda b: (b[1], b[0]))


def grown(figure: tuple[float, float, float, float], blocks: np.ndarray, width: float, height: float) -> tuple[float, float, float, float]:
    """The drawing with the narrow blocks within half its smaller side, to a fixpoint, never most of the page."""
    x0, y0, x1, y1 = figure
    reach = 0.5 * min(x1 - x0, y1 - y0)
    left = [b for b in blocks if b[2] - b[0] < 0.45 * width]
    while True:
        for k, b in enumerate(left):
            gap = max(b[0] - x1, x0 - b[2], b[1] - y1, y0 - b[3])
            u = (min(x0, b[0]), min(y0, b[1]), max(x1, b[2]), max(y1, b[3]))
            if gap <= reach and not (u[2] - u[0] > 0.55 * width and u[3] - u[1] > 0.55 * height):
                x0, y0, x1, y1 = u
                left.pop(k)
                break
        else:
            return x0, y0, x1, y1


FIGURE = "doc_id long, page int, figure int, x0 double, y0 double, x1 double, y1 double, bx0 double, by0 double, bx1 double, by1 double"


def figures(page_marks: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Drawings of each page: their own box (bx0..by1) and the one with labels (x0..y1).

    page_marks: as `grids.marks`; blocks: doc_id, page, x0..y1; pages: doc_id, page, width, height.
    """
    shapes = page_marks.where("kind IN ('fill', 'H')").select(*PAGE, "kind", "x0", "y0", "x1", "y1")
    text = blocks.select(*PAGE, F.lit("block").alias("kind"), *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])
    size = pages.select(*PAGE, F.lit("page").alias("kind"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").cast("double").alias("x1"), F.col("height").cast("double").alias("y1"))

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        box = {k: page.loc[page["kind"] == k, ["x0", "y0", "x1", "y1"]].to_numpy(float) for k in ("fill", "H", "block", "page")}
        width, height = box["page"][0, 2:] if len(box["page"]) else (612.0, 792.0)
        out = []
        for i, own in enumerate(figures_of(box["fill"], box["H"], width, height)):
            out.append((*key, i, *grown(own, box["block"], width, height), *own))
        return pd.DataFrame(out, columns=[f.split()[0] for f in FIGURE.split(", ")])

    return shapes.unionByName(text).unionByName(size).groupBy(*PAGE).applyInPandas(run, FIGURE)


def in_figures(blocks: DataFrame, found: DataFrame, share: float = 0.6) -> DataFrame:
    """Blocks with `figure`: the first figure that holds `share` of them, null without one."""
    f = found.select(*[F.col(c).alias(f"__{c}") for c in PAGE], F.col("figure").alias("__figure"), *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")])
    w = F.greatest(F.lit(0.0), F.least("x1", "__x1") - F.greatest("x0", "__x0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "__y1") - F.greatest("y0", "__y0"))
    inside = (F.col("doc_id") == F.col("__doc_id")) & (F.col("page") == F.col("__page")) & (w * h >= share * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    met = blocks.join(f, inside).groupBy("doc_id", "page", "block").agg(F.min("__figure").alias("figure"))
    return blocks.join(met, ["doc_id", "page", "block"], "left")


def yields_to_figure(evidence: Column, figure: Column) -> Column:
    """A heading known by size or weight alone is a label if it lies in a drawing."""
    return figure.isNotNull() & F.coalesce(evidence.isin("font-size", "bold"), F.lit(False))


def without_fragments(elements: DataFrame) -> DataFrame:
    """Elements but for text out of drawings."""
    return elements.where("type <> 'doco:Figure'")


def outline_headings_only(elements: DataFrame) -> DataFrame:
    """Elements but for titles that the document's own outline doesn't state; others of documents without outline stay."""
    stated = F.max((F.coalesce(F.col("evidence"), F.lit("")) == "outline").cast("int")).over(Window.partitionBy("doc_id")) == 1
    return elements.withColumn("__stated", stated).where("NOT __stated OR type <> 'doco:SectionTitle' OR evidence = 'outline'").drop("__stated")
