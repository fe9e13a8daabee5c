"""Lines of text from the glyphs of a page: columns, baselines, spacing.

One grouped pass over numpy arrays a page; only baselines are walked glyph by glyph, since
a row is anchored at its first.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
LINE = "doc_id long, page int, line int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, rotation int, col int"
_SPACELESS = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿　-〿＀-￯]")
Cut = tuple[float, float, float]


class Glyphs:
    """Columns of a page's glyphs as arrays, in drawing order."""

    def __init__(self, page: pd.DataFrame):
        page = page.sort_values("draw_index", kind="stable")
        self.text = page["text"].fillna("").to_numpy(object)
        self.x0, self.y0, self.x1, self.y1 = (page[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1"))
        self.ox, self.oy, self.size, self.advance = (page[c].to_numpy(float) for c in ("origin_x", "origin_y", "font_size", "advance"))
        self.weight = page["weight"].fillna(0).to_numpy(float)
        self.rotation = (np.round(page["rotation_deg"].fillna(0).to_numpy(float) / 15) * 15).astype(int)
        self.ink = ~np.isnan(self.x0) & np.array([bool(t.strip()) for t in self.text], bool)


# ---- columns -----------------------------------------------------------------------------


def _occupied(boxes: np.ndarray, size: float) -> tuple[np.ndarray, float]:
    """Rows x bins of 2 units: whether ink lies there; boxes are (x0, x1, y)."""
    left, right = boxes[:, 0].min(), boxes[:, 1].max()
    n = max(1, math.ceil((right - left) / 2))
    row = np.unique((boxes[:, 2] // max(size, 1)).astype(int), return_inverse=True)[1]
    first = ((boxes[:, 0] - left) // 2).astype(int)
    last = np.minimum(n - 1, ((boxes[:, 1] - left - 1e-9) // 2).astype(int))
    edge = np.zeros((row.max() + 1, n + 1), int)
    np.add.at(edge, (row, first), 1)
    np.add.at(edge, (row, last + 1), -1)
    return np.cumsum(edge, axis=1)[:, :n] > 0, float(left)


def longest_run(empty: np.ndarray) -> np.ndarray:
    """Longest run of empty rows of each bin."""
    best = now = np.zeros(empty.shape[1], int)
    for row in empty:
        now = np.where(row, now + 1, 0)
        best = np.maximum(best, now)
    return best


def gutters(boxes: np.ndarray, size: float) -> list[float]:
    """Middles of the blank strips that part a page's columns; narrow columns join the next."""
    if len(boxes) < 20:
        return []
    held, left = _occupied(boxes, size)
    if len(held) < 8:
        return []
    right = boxes[:, 1].max()
    clear = ((~held).sum(axis=0) >= 0.9 * len(held)) | (longest_run(~held) >= 0.75 * len(held))
    edge = np.diff(np.concatenate([[0], clear.astype(int), [0]]))
    cuts = [left + a + b for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)) if a > 0 and b < len(clear) and (b - a) * 2 > 0.012 * (right - left)]
    kept: list[float] = []
    for c in cuts:
        if c - (kept[-1] if kept else left) >= 0.15 * (right - left) and right - c >= 0.15 * (right - left):
            kept.append(float(c))
    return kept


def ruler(rules: np.ndarray, left: float, right: float) -> tuple[float, list[float]] | None:
    """Height of a rank of at least three heading rules over the columns, and the cuts between them."""
    best = None
    for y in np.unique(np.round((rules[:, 1] + rules[:, 3]) / 4)) if len(rules) else []:
        own = rules[(np.round((rules[:, 1] + rules[:, 3]) / 4) == y) & (rules[:, 2] - rules[:, 0] >= 40)]
        own = own[np.argsort(own[:, 0])]
        size, gap = own[:, 2] - own[:, 0], own[1:, 0] - own[:-1, 2]
        if len(own) < 3 or (gap <= 4).any() or size.min() < 0.5 * size.max() or gap.max() > 3 * gap.min():
            continue
        span = own[-1, 2] - own[0, 0]
        if size.sum() >= 0.7 * span and span >= 0.7 * (right - left) and (best is None or len(own) > len(best[1]) + 1):
            best = (float((own[0, 1] + own[0, 3]) / 2), [float((a + b) / 2) for a, b in zip(own[:-1, 2], own[1:, 0])])
    return best


# ---- spacing -----------------------------------------------------------------------------


def space_ratio(gaps: np.ndarray) -> float:
    """Pen gap in sizes above which a space is meant: the valley between letters and spaces, from 0.10 to 0.30.

    With fewer than 200 gaps, or no second peak, 0.20.
    """
    if len(gaps) < 200:
        return 0.2
    n = np.histogram(gaps[(gaps >= 0) & (gaps < 0.6)], bins=60, range=(0, 0.6))[0]
    low = int(np.argmax(n[:15]))
    rest = n[low + 5 :]
    if not len(rest) or rest.max() < max(3, 0.01 * n.sum()):
        return 0.2
    high = low + 5 + int(np.argmax(rest))
    between = n[low : high + 1]
    bottom = np.flatnonzero(between == between.min())
    return float(np.clip((low + (bottom[0] + bottom[-1] + 1) / 2) / 100, 0.10, 0.30))


def _gaps(g: Glyphs, row: np.ndarray) -> np.ndarray:
    return (g.ox[row[1:]] - g.ox[row[:-1]] - g.advance[row[:-1]]) / np.maximum(g.size[row[1:]], 1e-9)


def line_text(g: Glyphs, row: np.ndarray, ratio: float) -> str:
    """The words of a row: wider gaps between digits stay closed, tracked letters are spaced by their own median."""
    chars = g.text[row]
    gap = _gaps(g, row)
    if len(row) < 2:
        return "".join(chars)
    least = np.full(len(gap), ratio)
    number = np.array([len(c) == 1 and c.isdigit() for c in chars])
    stop = np.array([c in (".", ",") for c in chars])
    tail = stop | np.array([c == "%" for c in chars])
    least[(number[:-1] & (number[1:] | tail[1:])) | (stop[:-1] & number[1:])] = 0.32
    space = np.array([c == " " for c in chars])
    spaceless = np.array([bool(_SPACELESS.match(c)) for c in chars])
    inked = ~space
    own = np.flatnonzero(inked)
    if len(own) >= 6:
        tracked = _gaps(g, row[own])
        letter = np.array([c.isalpha() for c in chars[own]])
        if (tracked > ratio).mean() >= 0.6 and letter.mean() >= 0.7:
            wide = tracked > 1.5 * np.median(tracked)
            return "".join(c + (" " if k < len(wide) and wide[k] else "") for k, c in enumerate(chars[own]))
    apart = (gap > least) & ~(spaceless[:-1] & spaceless[1:]) & inked[1:] & inked[:-1]
    return "".join(c + (" " if k < len(apart) and apart[k] else "") for k, c in enumerate(chars))


def baselines(g: Glyphs, order: np.ndarray, near: float = 0.3) -> list[np.ndarray]:
    """Rows of glyphs anchored at each row's first, in order of height; left to right within."""
    rows: list[list[int]] = []
    at, size = g.oy.tolist(), g.size.tolist()
    for k in order.tolist():
        if rows and abs(at[k] - at[rows[-1][0]]) < near * max(size[k], size[rows[-1][0]]):
            rows[-1].append(k)
        else:
            rows.append([k])
    return [np.array(r)[np.lexsort((r, g.ox[r]))] for r in rows]


def _split(g: Glyphs, row: np.ndarray) -> list[np.ndarray]:
    """A row cut where the ink has a gap of more than 1.5 sizes and no space was drawn."""
    own = np.flatnonzero(g.ink[row])
    if len(own) < 2:
        return [row]
    a, b = row[own[:-1]], row[own[1:]]
    drawn = np.diff(np.cumsum(g.text[row] == " ")[own]) > 0
    cuts = own[1:][(g.x0[b] - g.x1[a] > 1.5 * g.size[b]) & ~drawn]
    return np.split(row, cuts)


def assembled(g: Glyphs, members: np.ndarray, col: int, ratio: float) -> list[dict]:
    """Lines of the glyphs of one column, in order of height."""
    out = []
    for rotation in np.unique(g.rotation[members]):
        own = members[g.rotation[members] == rotation]
        for row in baselines(g, own[np.lexsort((own, g.ox[own], g.oy[own]))]):
            for part in _split(g, row):
                ink = part[g.ink[part]]
                text = unicodedata.normalize("NFKC", line_text(g, part, ratio).strip()) if len(ink) else ""
                if not text:
                    continue
                size = np.sort(g.size[ink])
                weighed = g.weight[ink][g.weight[ink] > 0]
                out.append({"text": text, "x0": g.x0[ink].min(), "y0": g.y0[ink].min(), "x1": g.x1[ink].max(), "y1": g.y1[ink].max(), "size": size[len(size) // 2], "bold": bool(2 * (weighed >= 600).sum() > len(weighed)), "rotation": int(rotation), "col": col, "base": g.oy[ink[0]]})
    return out


def rejoined(columns: list[list[dict]], cuts: list[float]) -> list[list[dict]]:
    """Undoes cuts through lines: a line flush with a cut joins the one left of it at its height, unless a quarter does."""
    for c, cut in enumerate(cuts):
        left, right = columns[c], columns[c + 1]
        pairs = []
        for b in right:
            if b["x0"] - cut > 1.5 * b["size"]:
                continue
            for a in left:
                if a["rotation"] == b["rotation"] and abs(a["base"] - b["base"]) <= 0.5 * b["size"] and 0 <= b["x0"] - a["x1"] <= 0.75 * b["size"]:
                    pairs.append((a, b))
                    break
        if not pairs or len(pairs) > 0.25 * len(right):
            continue
        for a, b in pairs:
            a["text"] += (" " if b["x0"] - a["x1"] > 0.2 * b["size"] else "") + b["text"]
            a.update(x0=min(a["x0"], b["x0"]), y0=min(a["y0"], b["y0"]), x1=max(a["x1"], b["x1"]), y1=max(a["y1"], b["y1"]))
            right.remove(b)
    return columns


def page_lines(g: Glyphs, rules: np.ndarray | None = None, ratio: float | None = None) -> list[dict]:
    """Lines of a page in reading order: column by column; a ruler's columns hold only between the ink that crosses them."""
    level = g.ink & (g.rotation == 0)
    if not g.ink.any():
        return []
    sizes = np.sort(g.size[g.ink])
    em = float(sizes[len(sizes) // 2])
    boxes = np.column_stack([g.x0, g.x1, g.y0])[g.ink]
    cuts = gutters(boxes, em)
    everything = np.arange(len(g.text))
    rows = baselines(g, everything[np.lexsort((everything, g.ox, g.oy))])
    if ratio is None:
        inked = [_gaps(g, r[g.ink[r]]) for r in rows if g.ink[r].sum() > 1]
        ratio = space_ratio(np.concatenate(inked)) if inked else 0.2
    marked = ruler(rules, float(boxes[:, 0].min()), float(boxes[:, 1].max())) if rules is not None and not cuts else None
    if marked is not None:
        y, between = marked
        crossing = level & np.any([(g.x0 < c) & (g.x1 > c) for c in between], axis=0)
        above, below = g.oy[crossing & (g.oy <= y)], g.oy[crossing & (g.oy > y)]
        top, bottom = (above.max() if len(above) else -np.inf), (below.min() if len(below) else np.inf)
        inside = (g.oy > top) & (g.oy < bottom)
        place = np.where(inside, np.searchsorted(between, g.ox, side="right") + 1, np.where(g.oy <= top, 0, len(between) + 2))
        return [x for c in range(len(between) + 3) for x in assembled(g, everything[place == c], max(0, min(c - 1, len(between))), ratio)]
    column = np.searchsorted(cuts, g.ox, side="right")
    parts = [assembled(g, everything[column == c], c, ratio) for c in range(len(cuts) + 1)]
    return [x for part in rejoined(parts, cuts) for x in part]


def lines(glyphs: DataFrame, rules: DataFrame | None = None, ratio: float | None = None) -> DataFrame:
    """Lines of text in reading order, column by column; `ratio`: the gap of a space in sizes, else the page's own.

    rules: doc_id, page, orient, x0..y1; their horizontal ranks may give the columns.
    """
    columns = ["text", "x0", "y0", "x1", "y1", "origin_x", "origin_y", "font_size", "advance", "weight", "rotation_deg", "draw_index"]
    stream = glyphs.select(*PAGE, *columns, F.lit(False).alias("rule"))
    if rules is not None:
        blank = [F.lit(None).cast("double").alias(c) for c in columns[5:11]]
        stream = stream.unionByName(rules.where("orient = 'H'").select(*PAGE, F.lit(None).cast("string").alias("text"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], *blank, F.lit(0).alias("draw_index"), F.lit(True).alias("rule")))

    by_rules = rules is not None

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        ruled = page["rule"].to_numpy(bool)
        found = page_lines(Glyphs(page[~ruled]), page.loc[ruled, ["x0", "y0", "x1", "y1"]].to_numpy(float) if by_rules else None, ratio)
        names = [c.split()[0] for c in LINE.split(", ")]
        out = pd.DataFrame(found, columns=[*names[3:], "base"]).drop(columns="base")
        out.insert(0, "doc_id", key[0])
        out.insert(1, "page", key[1])
        out.insert(2, "line", np.arange(1, len(found) + 1))
        return out[names]

    return stream.groupBy(*PAGE).applyInPandas(run, LINE)


def printed_lines(glyphs: DataFrame) -> DataFrame:
    """doc_id, page, line, text: what stands on each baseline of a page, across columns; for comparison with readings."""

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        g = Glyphs(page)
        order = np.arange(len(g.text))
        rows = baselines(g, order[np.lexsort((order, g.ox, g.oy))])
        texts = [t for t in (unicodedata.normalize("NFKC", line_text(g, r, 0.28).strip()) for r in rows) if t]
        return pd.DataFrame({"doc_id": key[0], "page": key[1], "line": np.arange(1, len(texts) + 1), "text": texts})

    return glyphs.groupBy(*PAGE).applyInPandas(run, "doc_id long, page int, line int, text string")


def column_doubts(glyphs: DataFrame) -> DataFrame:
    """doc_id, page, cuts, band_cuts: pages where a band of at least 8 rows has gutters that the page as a whole doesn't show."""

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        g = Glyphs(page)
        names = ["doc_id", "page", "cuts", "band_cuts"]
        level = g.ink & (g.rotation == 0)
        if level.sum() < 20:
            return pd.DataFrame([], columns=names)
        size = float(np.median(g.size[level]))
        boxes = np.column_stack([g.x0, g.x1, g.y0])[level]
        whole = gutters(boxes, size)
        rows = np.unique(boxes[:, 2] // max(size, 1))
        half = rows[len(rows) // 2]
        most = max((len(gutters(part, size)) for part in (boxes[boxes[:, 2] // max(size, 1) < half], boxes[boxes[:, 2] // max(size, 1) >= half]) if len(part)), default=0)
        return pd.DataFrame([(*key, len(whole), most)] if most > len(whole) else [], columns=names)

    return glyphs.groupBy(*PAGE).applyInPandas(run, "doc_id long, page int, cuts int, band_cuts int")


# ---- glyphs ------------------------------------------------------------------------------


#: Faces, of all documents, that are sent to every task.
FEW_FACES = 1_000_000


def inferred_weights(glyphs: DataFrame, least: int = 40, margin: float = 1.15) -> DataFrame:
    """Weights where none is declared: faces whose ink is denser than the commonest face's by `margin` are bold.

    glyphs: with face and ink (share of the box that is covered); faces of fewer than `least` glyphs are judged by nothing.
    """
    faces = glyphs.where("ink IS NOT NULL").groupBy("doc_id", "face").agg(F.count("*").alias("n"), F.avg("ink").alias("density")).where(F.col("n") >= least)
    body = faces.groupBy("doc_id").agg(F.max(F.struct("n", "density")).alias("b")).select("doc_id", F.col("b.density").alias("__body"))
    told = faces.join(body, "doc_id").select("doc_id", "face", F.when(F.col("density") > margin * F.col("__body"), 700).otherwise(400).alias("__weight"))
    # glyphs of one face are many: while faces are few, glyphs stay where they are
    few = told.limit(FEW_FACES + 1).count() <= FEW_FACES
    return glyphs.join(F.broadcast(told) if few else told, ["doc_id", "face"], "left").withColumn("weight", F.coalesce("weight", "__weight")).drop("__weight")


def synthesized_boxes(glyphs: DataFrame) -> DataFrame:
    """Boxes for glyphs of text that have none: up to the next origin on their baseline if it is near, else 0.6 wide; spaces stay."""
    w = Window.partitionBy(*PAGE, F.round(F.col("origin_y") * 2)).orderBy("origin_x", "draw_index")
    step = F.lead("origin_x").over(w) - F.col("origin_x")
    width = F.when((step > 0) & (step <= 2.5 * F.col("font_size")), step).otherwise(0.6 * F.col("font_size"))
    bare = F.col("x0").isNull() & (F.trim("text") != "")
    box = {"x0": F.col("origin_x"), "y0": F.col("origin_y") - 0.8 * F.col("font_size"), "x1": F.col("origin_x") + F.col("__w"), "y1": F.col("origin_y") + 0.22 * F.col("font_size")}
    sized = glyphs.withColumn("__w", width).withColumn("__bare", bare)
    return sized.withColumns({k: F.when(F.col("__bare"), v).otherwise(F.col(k)) for k, v in box.items()}).drop("__w", "__bare")


def signals(pages: DataFrame, glyphs: DataFrame, images: DataFrame) -> DataFrame:
    """What routing looks at: doc_id, page, events, resolved, glyphs, image_cover, texty_cover, text_in_images.

    pages: doc_id, page, width, height; images: doc_id, page, x0..y1, texty.  Covers are shares
    of a 32 by 32 grid of cells.
    """
    text = glyphs.groupBy(*PAGE).agg(F.count("*").alias("events"), F.sum((F.col("text") != "").cast("int")).alias("resolved"), F.sum((F.trim("text") != "").cast("int")).alias("glyphs"))
    sized = images.join(pages, PAGE)
    cell = lambda c, size, last: F.least(F.lit(31), F.greatest(F.lit(0), F.floor(F.col(c) / F.col(size) * 32 - (1e-9 if last else 0)).cast("int")))
    cells = sized.where("x1 > x0 AND y1 > y0").select(*PAGE, "texty", F.explode(F.sequence(cell("x0", "width", False), cell("x1", "width", True))).alias("cx"), cell("y0", "height", False).alias("a"), cell("y1", "height", True).alias("b")).select(*PAGE, "texty", "cx", F.explode(F.sequence("a", "b")).alias("cy"))
    covered = cells.groupBy(*PAGE, "cx", "cy").agg(F.max("texty").alias("texty")).groupBy(*PAGE).agg((F.count("*") / 1024).alias("image_cover"), (F.sum(F.col("texty").cast("int")) / 1024).alias("texty_cover"))
    g, i = glyphs.alias("g"), images.where("texty").alias("i")
    mid = lambda a, b: (F.col(f"g.{a}") + F.col(f"g.{b}")) / 2
    on = (F.col("g.doc_id") == F.col("i.doc_id")) & (F.col("g.page") == F.col("i.page")) & mid("x0", "x1").between(F.col("i.x0"), F.col("i.x1")) & mid("y0", "y1").between(F.col("i.y0"), F.col("i.y1"))
    within = g.where("trim(g.text) <> ''").join(i, on, "left_semi").groupBy(*PAGE).agg(F.count("*").alias("text_in_images"))
    out = pages.join(text, PAGE, "left").join(covered, PAGE, "left").join(within, PAGE, "left")
    return out.fillna(0, ["events", "resolved", "glyphs", "text_in_images"]).fillna(0.0, ["image_cover", "texty_cover"])


def weights(glyphs: DataFrame) -> DataFrame:
    """How many glyphs have each weight and size."""
    return glyphs.groupBy("doc_id", "weight", F.round("font_size", 1).alias("size")).agg(F.count("*").alias("n"))


def gap_histogram(glyphs: DataFrame, step: float = 0.01) -> DataFrame:
    """doc_id, bin, n: pen gaps between neighbours on a baseline, in sizes."""
    w = Window.partitionBy(*PAGE, "origin_y").orderBy("origin_x", "draw_index")
    gap = (F.col("origin_x") - F.lag("origin_x").over(w) - F.lag("advance").over(w)) / F.col("font_size")
    return glyphs.where("trim(text) <> ''").withColumn("gap", gap).where("gap >= 0 AND gap < 0.6").groupBy("doc_id", F.floor(F.col("gap") / step).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def leading_histogram(found: DataFrame, step: float = 0.05) -> DataFrame:
    """doc_id, bin, n: pitches of neighbouring lines, in sizes."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    pitch = (F.col("y0") - F.lag("y0").over(w)) / F.col("size")
    return found.withColumn("pitch", pitch).where("pitch BETWEEN 0.3 AND 2.0").groupBy("doc_id", F.floor(F.col("pitch") / step).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def probe(glyphs: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One row: documents, pages, glyphs, share with Unicode, ligatures, failed documents."""
    got = glyphs.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("doc_id", "page").alias("pages"), F.count("*").alias("glyphs"), F.round(F.avg((F.col("text") != "").cast("int")), 6).alias("unicode_rate"), F.sum((F.length("text") > 1).cast("int")).alias("ligatures"))
    failed = failures.agg(F.count("*").alias("failed")) if failures is not None else got.sparkSession.range(1).select(F.lit(0).cast("long").alias("failed"))
    return got.join(failed)
