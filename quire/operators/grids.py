"""Table grids of positioned pages: from drawn rules, filled cells, and aligned text.

A page's marks (glyphs, rules, fills) are one table; each page is read in one grouped
pass over numpy arrays.  Functions on arrays take boxes as rows (x0, y0, x1, y1), y down.
A page may be as long as it likes: no step compares all of its marks with one another.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

PAGE = ["doc_id", "page"]
#: Columns of the marks of a page; kind: glyph, H or V (rules), fill.
MARKS = ["kind", "draw_index", "text", "x0", "y0", "x1", "y1", "origin_x", "origin_y", "font_size", "advance", "weight", "rotation_deg"]
#: Axes this close are one line; boundaries this close are one; smaller cells aren't cells.
SAME_LINE, SAME_EDGE, LEAST_CELL = 2.5, 3.0, 8.0
CURRENCY = "$€£¥"


def marks(glyphs: DataFrame | None = None, rules: DataFrame | None = None, fills: DataFrame | None = None) -> DataFrame:
    """One table of a document's glyphs, rules (`orient` H or V) and fills."""
    parts = []
    if glyphs is not None:
        parts.append(glyphs.select(*PAGE, F.lit("glyph").alias("kind"), *MARKS[1:]))
    for df, kind in ((rules, F.col("orient")), (fills, F.lit("fill"))):
        if df is not None:
            blank = {"draw_index": F.lit(0), "text": F.lit(None).cast("string")} | {c: F.lit(None).cast("double") for c in MARKS[7:]}
            box = [F.col(c).cast("double").alias(c) for c in MARKS[3:7]]
            parts.append(df.select(*PAGE, kind.alias("kind"), blank["draw_index"].alias("draw_index"), blank["text"].alias("text"), *box, *[blank[c].alias(c) for c in MARKS[7:]]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- shapes ------------------------------------------------------------------------------


def is_checkbox(x0: Column, y0: Column, x1: Column, y1: Column, least: float = 4, most: float = 20) -> Column:
    """Small fills that are nearly square."""
    w, h = x1 - x0, y1 - y0
    return w.between(least, most) & h.between(least, most) & (F.abs(w - h) <= 0.25 * F.greatest(w, h))


def span_coverage(spans: Iterable[tuple[float, float]], lo: float, hi: float) -> float:
    """Length of lo..hi that the spans cover together."""
    total, at = 0.0, lo
    for a, b in sorted(spans):
        a, b = max(a, at), min(b, hi)
        if b > a:
            total, at = total + b - a, b
    return total


def coalesced(values: Iterable[float], near: float) -> list[float]:
    """Means of runs whose neighbours are within `near`."""
    runs: list[list[float]] = []
    for v in sorted(values):
        if runs and v - runs[-1][-1] <= near:
            runs[-1].append(v)
        else:
            runs.append([v])
    return [sum(r) / len(r) for r in runs]


class Line:
    """Rules on one axis; asked for only once all spans are there."""

    def __init__(self, axis: float):
        self.axis, self.spans = axis, []

    @cached_property
    def outer(self) -> tuple[list[float], list[float]]:
        """Starts and ends, both ascending, of the spans that lie in no other: the rest covers and crosses nothing else."""
        kept: list[tuple[float, float]] = []
        for a, b in sorted(self.spans):
            if not kept or b > kept[-1][1]:
                kept.append((a, b))
        return [a for a, _ in kept], [b for _, b in kept]

    @cached_property
    def tips(self) -> list[float]:
        """All starts and ends, ascending."""
        return sorted(e for s in self.spans for e in s)

    @property
    def length(self) -> float:
        return max(b for _, b in self.spans) - min(a for a, _ in self.spans)

    def covers(self, lo: float, hi: float) -> float:
        starts, ends = self.outer
        i, j = bisect_right(ends, lo), bisect_left(starts, hi)
        return span_coverage(zip(starts[i:j], ends[i:j]), lo, hi) / max(hi - lo, 1e-9)

    def crosses(self, at: float, slack: float = 1.0) -> bool:
        starts, ends = self.outer
        i = bisect_left(ends, at - slack)
        return any(starts[k] - slack <= at <= ends[k] + slack for k in range(max(0, i - 1), min(i + 1, len(ends))))

    def ends_near(self, at: float) -> bool:
        """Whether a span starts or ends within SAME_EDGE."""
        i = bisect_left(self.tips, at)
        return any(abs(at - p) <= SAME_EDGE for p in self.tips[max(0, i - 1) : i + 1])


def lines_of(boxes: np.ndarray, horizontal: bool) -> list[Line]:
    """Rules clustered by axis, anchored at each cluster's first."""
    i, j = (0, 1) if horizontal else (1, 0)
    axis = (boxes[:, j] + boxes[:, j + 2]) / 2
    out: list[Line] = []
    for k in np.argsort(axis, kind="stable"):
        if not out or axis[k] - out[-1].axis > SAME_LINE:
            out.append(Line(float(axis[k])))
        out[-1].spans.append((float(boxes[k, i]), float(boxes[k, i + 2])))
    return out


def without_lattice(rules: pd.DataFrame, width: float, height: float) -> pd.DataFrame:
    """Drops the construction lattice of a page: full-bleed rules at a constant pitch on both axes."""
    phases = {}
    for orient, i, extent in (("H", 1, width), ("V", 0, height)):
        own = rules[rules["orient"] == orient]
        size = (own["x1"] - own["x0"]) if orient == "H" else (own["y1"] - own["y0"])
        full = own[size >= 0.95 * extent]
        axis = (full.iloc[:, [full.columns.get_loc(c) for c in (("y0", "y1") if i else ("x0", "x1"))]].mean(axis=1)).sort_values()
        places = coalesced(axis.tolist(), 1.0)
        best: tuple[int, float, float] = (0, 0.0, 0.0)
        for k in range(len(places) - 1):
            pitch, run = places[k + 1] - places[k], 2
            while pitch >= 5 and k + run < len(places) and abs(places[k + run] - places[k + run - 1] - pitch) <= 1:
                run += 1
            if pitch >= 5 and run > best[0]:
                best = (run, places[k], pitch)
        phases[orient] = (best, axis)
    if any(best[0] < 4 for best, _ in phases.values()):
        return rules
    gone = []
    for (_, start, pitch), axis in phases.values():
        off = (axis - start + pitch / 2) % pitch - pitch / 2
        gone += axis[off.abs() <= 1].index.tolist()
    return rules.drop(index=gone)


# ---- grids -------------------------------------------------------------------------------


class Grid:
    """Boundaries of columns and rows; `drawn`: whether vertical rules gave the columns."""

    def __init__(self, xs: list[float], ys: list[float], source: str, drawn: bool = False):
        self.xs, self.ys, self.source, self.drawn = xs, ys, source, drawn

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.ys) - 1, len(self.xs) - 1

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self.xs[0], self.ys[0], self.xs[-1], self.ys[-1]

    def at(self, x: float, y: float) -> tuple[int, int] | None:
        """Row and column that hold a point."""
        if not (self.xs[0] <= x < self.xs[-1] and self.ys[0] <= y < self.ys[-1]):
            return None
        return bisect_right(self.ys, y) - 1, bisect_right(self.xs, x) - 1


def _edges(own: list[Line], other: list[Line], lo: float, hi: float) -> list[float]:
    """Boundaries across an axis: own lines over 0.3 of the extent, and ends of the other lines'
    segments that half of the wide ones share."""
    places = [x.axis for x in own if x.covers(lo, hi) >= 0.3]
    if other:
        lengths = [x.length for x in other]
        reach = max(lengths)
        wide = [x for x, n in zip(other, lengths) if n >= 0.5 * reach]
        ends = coalesced((e for x in wide for s in x.spans for e in s), SAME_EDGE)
        places += [e for e in ends if 2 * sum(x.ends_near(e) for x in wide) >= len(wide)]
    kept: list[float] = []
    for e in coalesced(places, SAME_EDGE):
        if not kept or e - kept[-1] >= LEAST_CELL:
            kept.append(e)
    return kept


def ruled_grids(h: np.ndarray, v: np.ndarray) -> list[Grid]:
    """Grids of one group of rules: at least three in one direction."""
    if max(len(h), len(v)) < 3:
        return []
    both = np.concatenate([h, v])
    x0, y0, x1, y1 = both[:, 0].min(), both[:, 1].min(), both[:, 2].max(), both[:, 3].max()
    across, down = lines_of(h, True), lines_of(v, False)
    xs, ys = _edges(down, across, y0, y1), _edges(across, down, x0, x1)
    if len(xs) < 2 or len(ys) < 2:
        return []
    inner = [x for x in down if xs[0] - SAME_EDGE < x.axis < xs[-1] + SAME_EDGE]
    if inner:  # outer bands that no vertical rule crosses aren't rows
        met = [any(x.crosses((a + b) / 2) for x in inner) for a, b in zip(ys, ys[1:])]
        first = next((k for k, m in enumerate(met) if m), len(met))
        last = next((k for k in range(len(met), first, -1) if met[k - 1]), first)
        ys = ys[first : last + 1]
    out = []
    axes = [x.axis for x in across]
    for part in _row_bands(ys, inner):
        within = across[bisect_left(axes, part[0] - SAME_LINE) : bisect_right(axes, part[-1] + SAME_LINE)]
        cols = _edges([x for x in down if any(x.crosses((a + b) / 2) for a, b in zip(part, part[1:]))], within, part[0], part[-1]) if len(part) < len(ys) else xs
        cols = cols if len(cols) >= 2 else xs
        rows, n = len(part) - 1, len(cols) - 1
        banner = n >= 3 and any(cols[0] + SAME_EDGE < x.axis < cols[-1] - SAME_EDGE and x.crosses((part[0] + part[-1]) / 2) for x in inner)
        if rows < 1 or (rows == 1 and not banner) or (n == 1 and (rows < 3 or len(down) != 2)):
            continue
        out.append(Grid(cols, part, "rules", bool(inner)))
    return out


def _row_bands(ys: list[float], down: list[Line]) -> list[list[float]]:
    """Cuts at bands over 3.5 median heights, and at uncrossed ones between two crossed ones."""
    if len(ys) < 2:
        return []
    heights = sorted(b - a for a, b in zip(ys, ys[1:]))
    most = 3.5 * max(1.0, heights[len(heights) // 2])
    met = [any(x.crosses((a + b) / 2) for x in down) for a, b in zip(ys, ys[1:])]
    parts, now = [], [ys[0]]
    for k, y in enumerate(ys[1:]):
        gap = (y - ys[k] > most) or (0 < k < len(met) - 1 and not met[k] and met[k - 1] and met[k + 1])
        if gap and len(ys) > 3:
            parts.append(now)
            now = [y]
        else:
            now.append(y)
    return [p for p in [*parts, now] if len(p) >= 2]


def touching(boxes: np.ndarray, reach: float) -> np.ndarray:
    """The least box of each box's component, of boxes no further apart than `reach` on both axes.

    A sweep along the axis with fewer pairs; pairs are made and merged in pieces of bounded size.
    """
    n = len(boxes)
    root = np.arange(n)
    best: tuple[int, np.ndarray, np.ndarray] | None = None
    for i in (0, 1):
        order = np.argsort(boxes[:, i], kind="stable")
        stop = np.searchsorted(boxes[order, i] - reach, boxes[order, i + 2], side="right")
        many = np.maximum(stop - np.arange(n) - 1, 0)
        if best is None or many.sum() < best[0]:
            best = int(many.sum()), order, many
    _, order, many = best
    total = np.concatenate([[0], np.cumsum(many)])
    for at in range(0, int(total[-1]), PAIRS):
        # the pairs at..at + PAIRS, whoever's they are
        k = np.arange(at, min(at + PAIRS, int(total[-1])))
        first = np.searchsorted(total, k, side="right") - 1
        a, b = order[first], order[first + 1 + k - total[first]]
        x, y = boxes[a], boxes[b]
        near = np.ones(len(k), bool)
        for i in (0, 1):
            near &= (x[:, i] - reach <= y[:, i + 2]) & (y[:, i] - reach <= x[:, i + 2])
        a, b = a[near], b[near]
        while True:
            p, q = root[a], root[b]
            apart = p != q
            if not apart.any():
                break
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root[root] != root).any():
                root = root[root]
    return root


#: Pairs of boxes that are looked at together.
PAIRS = 1 << 17


def component_grids(h: np.ndarray, v: np.ndarray, reach: float = SAME_EDGE) -> list[Grid]:
    """Grids of each component of touching rules."""
    boxes = np.concatenate([h, v])
    if not len(boxes):
        return []
    label = touching(boxes, reach)
    order = np.argsort(label, kind="stable")
    out = []
    for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        out += ruled_grids(boxes[own[own < len(h)]], boxes[own[own >= len(h)]])
    for g in out:
        g.source = "components"
    return sorted(out, key=lambda g: (g.ys[0], g.xs[0]))


def fill_grids(fills: np.ndarray) -> list[Grid]:
    """Grids of repeated cell rectangles: at least 12 fills of cell size."""
    w, h = fills[:, 2] - fills[:, 0], fills[:, 3] - fills[:, 1]
    cells = fills[(w >= 20) & (w <= 300) & (h >= 4) & (h <= 100)]
    if len(cells) < 12:
        return []
    left = np.sort(cells[:, 0])
    xs = [x for x in coalesced(left, 6) if np.searchsorted(left, x + 6, side="right") - np.searchsorted(left, x - 6) >= 3]
    cells = cells[np.argsort(cells[:, 1], kind="stable")]
    top = cells[:, 1]
    ys = coalesced(top, 8)
    if len(xs) < 2:
        return []
    out, run = [], [ys[0]]
    for y in [*ys[1:], float("inf")]:
        if y - run[-1] > 50:
            if len(run) >= 3:
                own = cells[np.searchsorted(top, run[0] - 8) : np.searchsorted(top, run[-1] + 8, side="right")]
                out.append(Grid([*xs, float(own[:, 2].max())], [*run, float(own[:, 3].max())], "fills"))
            run = []
        run.append(y)
    return out


class Ink:
    """Horizontal glyphs of a page that print something, and their rows and words."""

    def __init__(self, glyphs: pa.Table):
        number = lambda c: glyphs.column(c).cast(pa.float64()).to_numpy()
        codes = pc.fill_null(glyphs.column("text"), "").combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        texts, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        prints = np.array([t.strip() != "" for t in texts], bool)
        own = np.flatnonzero((np.round(np.nan_to_num(number("rotation_deg")) / 15) * 15 == 0) & ~np.isnan(number("x0")) & (prints[codes] if len(codes) else True))
        own = own[np.lexsort([number(c)[own] for c in ("draw_index", "origin_x", "origin_y")])]
        self.text = [texts[k] for k in codes[own].tolist()]
        self.x0, self.y0, self.x1, self.y1, self.ox, self.oy, self.size, self.advance = (number(c)[own] for c in ("x0", "y0", "x1", "y1", "origin_x", "origin_y", "font_size", "advance"))
        self.bold = number("weight")[own] >= 600
        self._rows: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def flat_rows(self, near: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
        """Glyphs clustered by baseline, anchored at each row's first, left to right; and where the rows start, and the end."""
        if near not in self._rows:
            n, order = len(self.text), np.arange(len(self.text))
            starts = [0] if n else []
            # a row may reach no further than the largest size allows
            last = np.searchsorted(self.oy, self.oy + near * float(np.nanmax(self.size, initial=0.0)) + 1e-6, side="right")
            at = 0
            while at < n:
                end = max(int(last[at]), at + 1)
                within = np.abs(self.oy[at + 1 : end] - self.oy[at]) < near * np.maximum(self.size[at + 1 : end], self.size[at])
                end = at + 1 + (int(np.argmin(within)) if not within.all() else len(within))
                pen = self.ox[at:end]
                if (pen[1:] < pen[:-1]).any():
                    order[at:end] = at + np.argsort(pen, kind="stable")
                starts.append(end)
                at = end
            self._rows[near] = order, np.array(starts or [0])
        return self._rows[near]

    def rows(self, near: float = 0.5) -> list[np.ndarray]:
        order, starts = self.flat_rows(near)
        return np.split(order, starts[1:-1]) if len(order) else []

    def line(self, row: np.ndarray) -> str:
        """A row's words with blanks between."""
        if not len(row):
            return ""
        apart = self.ox[row[1:]] - self.ox[row[:-1]] - self.advance[row[:-1]] > 0.2 * self.size[row[1:]]
        return self.text[row[0]] + "".join((" " if a else "") + self.text[k] for a, k in zip(apart.tolist(), row[1:].tolist()))

    def cells_of_rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of glyphs with the places where cells start: after gaps over 0.9 sizes; and where the rows start."""
        order, starts = self.flat_rows()
        fresh = np.zeros(len(order), bool)
        fresh[1:] = self.x0[order[1:]] - self.x1[order[:-1]] > 0.9 * self.size[order[1:]]
        fresh[starts[:-1]] = True
        return order, np.flatnonzero(fresh), starts

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Glyphs in order of rows and pens, and where words start, and the end: pen gaps within stay
        below 0.2 sizes; a lone currency sign joins the number after it."""
        order, rows = self.flat_rows(0.3)
        if not len(order):
            return order, np.zeros(1, int)
        fresh = np.ones(len(order), bool)
        fresh[1:] = ~(self.ox[order[1:]] - (self.ox[order[:-1]] + self.advance[order[:-1]]) <= 0.2 * self.size[order[1:]])
        fresh[rows[:-1]] = True
        begins_row = np.zeros(len(order), bool)
        begins_row[rows[:-1]] = True
        alone = fresh & np.append(fresh[1:], True)
        for k in np.flatnonzero(alone[:-1] & ~begins_row[1:]).tolist():
            sign, digit = order[k], order[k + 1]
            if self.text[sign] in CURRENCY and self.text[digit].isdigit() and self.x0[digit] - self.x1[sign] <= 8 * self.size[digit]:
                fresh[k + 1] = False
        return order, np.append(np.flatnonzero(fresh), len(order))

    @cached_property
    def heights(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Words by their highest glyph centre, these centres, and the furthest that a word reaches below its own."""
        order, starts = self.words
        if not len(order):
            return order, np.zeros(0), 0.0
        y = ((self.y0 + self.y1) / 2)[order]
        top, bottom = np.minimum.reduceat(y, starts[:-1]), np.maximum.reduceat(y, starts[:-1])
        by = np.argsort(top, kind="stable")
        return by, top[by], float((bottom - top).max())


def placed_parts(grid: Grid, ink: Ink) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, first, end) of what lies in a grid's cells, numbered row by row: words by their mean centre, places in
    `ink.words`; one over two or more inner boundaries is split by glyph."""
    order, starts = ink.words
    by, top, reach = ink.heights
    some = np.sort(by[np.searchsorted(top, grid.ys[0] - reach - 1) : np.searchsorted(top, grid.ys[-1] + 1, side="right")])
    first, end = starts[some], starts[some + 1]
    if len(some):
        inner = np.array(grid.xs[1:-1])
        crossed = np.searchsorted(inner, ink.x1[order[end - 1]]) - np.searchsorted(inner, ink.x0[order[first]], side="right")
        split = crossed >= 2
        count = np.where(split, end - first, 1)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        whole = np.repeat(~split, count)
        first = np.repeat(first, count) + at
        end = np.where(whole, np.repeat(end, count), first + 1)
        size = end - first
        starts = np.cumsum(size) - size
        glyph = order[np.repeat(first - starts, size) + np.arange(size.sum())]
        mx, my = (np.add.reduceat(((a + b) / 2)[glyph], starts) / size for a, b in ((ink.x0, ink.x1), (ink.y0, ink.y1)))
        keep = (mx >= grid.xs[0]) & (mx < grid.xs[-1]) & (my >= grid.ys[0]) & (my < grid.ys[-1])
        cell = (np.searchsorted(grid.ys, my[keep], side="right") - 1) * grid.shape[1] + np.searchsorted(grid.xs, mx[keep], side="right") - 1
        return cell, first[keep], end[keep]
    return first, first, end


def cell_texts(grid: Grid, ink: Ink) -> list[list[str]]:
    """The texts of a grid's cells: their parts by baseline, pen and text, blanks between."""
    (rows, cols), (order, _) = grid.shape, ink.words
    out: list[list[str]] = [[""] * cols for _ in range(rows)]
    cell, first, end = placed_parts(grid, ink)
    by = np.lexsort((ink.ox[order[first]], ink.oy[order[first]], cell))
    now, held = -1, []

    def close() -> None:
        if held:
            out[now // cols][now % cols] = " ".join(t for *_, t in sorted(held)) if len(held) > 1 else held[0][2]

    for c, a, b in zip(cell[by].tolist(), first[by].tolist(), end[by].tolist()):
        if c != now:
            close()
            now, held = c, []
        k = order[a]
        held.append((ink.oy[k], ink.ox[k], "".join([ink.text[i] for i in order[a:b].tolist()])))
    close()
    return out


def used_cells(grid: Grid, ink: Ink) -> np.ndarray:
    """Which of a grid's cells hold text, by row and column."""
    used = np.zeros(grid.shape, bool)
    used.reshape(-1)[placed_parts(grid, ink)[0]] = True
    return used


def aligned_grids(ink: Ink) -> list[Grid]:
    """Candidates by the alignment of text: at least 3 rows of 2 or more cells with shared column starts."""
    order, cells, rows = ink.cells_of_rows()
    if not len(order):
        return []
    count = np.diff(np.searchsorted(cells, rows))  # cells of each row
    place, ends = ink.x0[order[cells]], np.cumsum(count)
    largest, top, right, bottom = np.maximum.reduceat(ink.size[order], rows[:-1]), np.minimum.reduceat(ink.y0[order], rows[:-1]) - 1, np.maximum.reduceat(ink.x1[order], rows[:-1]), np.maximum.reduceat(ink.y1[order], rows[:-1])
    several = np.concatenate([[False], count >= 2, [False]])
    edge = np.flatnonzero(several[1:] != several[:-1])
    out = []
    for k, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if j - k < 3:
            continue
        em = float(np.median(largest[k:j]))
        own = place[ends[k] - count[k] : ends[j - 1]]
        of = np.repeat(np.arange(j - k), count[k:j])
        held = lambda x: len(np.unique(of[np.abs(own - x) <= 1.5 * em]))
        xs = [x for x in coalesced(own.tolist(), 1.5 * em) if held(x) >= 0.6 * (j - k)]
        tops = top[k:j].tolist()
        pitches = sorted(b - a for a, b in zip(tops, tops[1:]))
        pitch = pitches[len(pitches) // 2]
        ys = [tops[0]]
        for y in tops[1:]:  # boundaries closer than 0.75 of the pitch are wrapped lines
            if y - ys[-1] >= 0.75 * pitch:
                ys.append(y)
        if len(xs) >= 2 and len(ys) >= 2:
            out.append(Grid([*[x - 1 for x in xs], float(right[k:j].max()) + 1], [*ys, float(bottom[k:j].max()) + 1], "aligned"))
    return out


def corroborated(grid: Grid, h: np.ndarray, fills: np.ndarray) -> bool:
    """A rule over 0.8 of the grid's width that spans it or lies at its top, or fills behind its header or its cells."""
    x0, y0, x1, y1 = grid.box
    slack = 2 * (grid.ys[1] - grid.ys[0])
    axis = (h[:, 1] + h[:, 3]) / 2
    across = np.maximum(np.minimum(h[:, 2], x1) - np.maximum(h[:, 0], x0), 0)
    if ((y0 - slack <= axis) & (axis <= y1 + slack) & (across >= 0.8 * (x1 - x0))).any():
        return True
    inside = fills[(fills[:, 0] < x1) & (fills[:, 2] > x0) & (fills[:, 1] < y1) & (fills[:, 3] > y0)]
    header = [f for f in inside if f[1] < grid.ys[1] and f[3] > grid.ys[0]]
    if span_coverage([(f[0], f[2]) for f in header], x0, x1) >= 0.6 * (x1 - x0):
        return True
    rows, cols = grid.shape
    return len(inside) >= max(3, rows * cols // 2)


def captioned(grid: Grid, texts: list[tuple[float, str]]) -> bool:
    """Under a caption `Table <n>`, and at least 3 by 3; texts: (bottom, line), ascending."""
    above = bisect_right(texts, grid.ys[0] + 2, key=lambda t: t[0])
    return min(grid.shape) >= 3 and above > 0 and re.match(r"(?i)\s*table\s+\d", texts[above - 1][1]) is not None


def band_grids(h: np.ndarray, ink: Ink) -> list[Grid]:
    """Bands between horizontal rules of equal ends: a row starts where the first column has text."""
    long = h[h[:, 2] - h[:, 0] >= 80]
    out, left = [], np.arange(len(long))
    order, at = ink.flat_rows()
    tops = ink.oy[at[:-1]] if len(order) else np.zeros(0)  # of each row the highest baseline
    reach = 0.5 * float(np.nanmax(ink.size, initial=0.0))
    while len(left):
        first = long[left[0]]
        alike = (np.abs(long[left, 0] - first[0]) <= 10) & (np.abs(long[left, 2] - first[2]) <= 10)
        group, left = left[alike], left[~alike]
        axes = coalesced(((long[group, 1] + long[group, 3]) / 2).tolist(), SAME_LINE)
        if len(axes) < 2:
            continue
        x0, x1 = float(first[0]), float(first[2])
        rows = []
        for k in range(int(np.searchsorted(tops, axes[0] - reach)), int(np.searchsorted(tops, axes[-1], side="right"))):
            row = order[at[k] : at[k + 1]]
            row = row[(ink.x0[row] >= x0 - 10) & (ink.x1[row] <= x1 + 10) & (ink.oy[row] > axes[0]) & (ink.oy[row] < axes[-1])]
            if len(row):
                starts = np.append(0, np.flatnonzero(ink.x0[row[1:]] - ink.x1[row[:-1]] > 0.9 * ink.size[row[1:]]) + 1)
                rows.append((row, ink.x0[row[starts]].tolist()))
        if not rows:
            continue
        xs = max(rows, key=lambda r: len(r[1]))[1]
        begin = [r for r, starts in rows if abs(starts[0] - xs[0]) <= 1.5 * ink.size[r[0]]]
        if len(xs) >= 2 and len(begin) >= 2:
            out.append(Grid([min(x0, xs[0] - 1), *[x - 1 for x in xs[1:]], x1], [*[float(ink.y0[r].min()) - 1 for r in begin], axes[-1]], "bands"))
    return out


def filled_cells(grid: Grid, ink: Ink) -> int:
    return int(used_cells(grid, ink).sum())


def is_coarse(grids: list[Grid], ink: Ink) -> bool:
    """One ruled grid with a cell of more than 25 words, or with a caption `table <n>` inside."""
    return len(grids) == 1 and any(len(c.split()) > 25 or re.search(r"(?i)\btable\s+\d", c) for row in cell_texts(grids[0], ink) for c in row)


def trimmed(grid: Grid, ink: Ink) -> Grid | None:
    """The grid from its first to its last used column, and from its first used row to the first empty one after."""
    used = used_cells(grid, ink)
    if not used.any():
        return None
    rows, cols = np.flatnonzero(used.any(axis=1)), np.flatnonzero(used.any(axis=0))
    empty = np.flatnonzero(~used[rows[0] :].any(axis=1))
    last = rows[0] + empty[0] - 1 if len(empty) else len(used) - 1
    return Grid(grid.xs[cols[0] : cols[-1] + 2], grid.ys[rows[0] : last + 2], grid.source, grid.drawn)


def row_is_bold(grid: Grid, ink: Ink, row: int) -> bool:
    y = (ink.y0 + ink.y1) / 2
    x = (ink.x0 + ink.x1) / 2
    own = (y >= grid.ys[row]) & (y < grid.ys[row + 1]) & (x >= grid.xs[0]) & (x < grid.xs[-1])
    return bool(own.any()) and 2 * int(ink.bold[own].sum()) > int(own.sum())


def filled_bands(grid: Grid, fills: np.ndarray) -> np.ndarray:
    """Which rows have fills behind 0.6 of them, no taller than the row by half."""
    ys = np.array(grid.ys)
    mid, tall = (ys[:-1] + ys[1:]) / 2, np.diff(ys)
    spans: dict[int, list[tuple[float, float]]] = defaultdict(list)
    height = fills[:, 3] - fills[:, 1]
    low, high = np.searchsorted(mid, fills[:, 1]), np.searchsorted(mid, fills[:, 3], side="right")
    for k in np.flatnonzero((low < high) & (height <= 1.5 * tall.max(initial=0.0))).tolist():
        for r in np.flatnonzero(height[k] <= 1.5 * tall[low[k] : high[k]]).tolist():
            spans[int(low[k]) + r].append((fills[k, 0], fills[k, 2]))
    out = np.zeros(len(mid), bool)
    for r, own in spans.items():
        out[r] = span_coverage(own, grid.xs[0], grid.xs[-1]) >= 0.6 * (grid.xs[-1] - grid.xs[0])
    return out


def is_number(cell: str) -> bool:
    """Digits in currency, percent or bracket dress; years 1900 to 2099 aren't numbers."""
    t = cell.strip()
    bare = re.sub(r"[\s$€£¥%(),.+-]", "", t)
    return bool(re.fullmatch(r"[0-9]+", bare)) and not re.fullmatch(r"(?:19|20)[0-9]{2}", t)


def header_rows(grid: Grid, cells: list[list[str]], ink: Ink, fills: np.ndarray) -> int:
    """How many rows are the header: by fills, by style, or where the first row isn't numbers like those below."""
    rows = len(cells)
    if rows < 2 or not any(c.strip() for c in cells[0]):
        return 0
    bands = filled_bands(grid, fills)
    lead, filled = (int(np.argmin(bands)) if not bands.all() else len(bands)), int(bands.sum())
    if 2 <= lead <= 4 and lead < rows:
        return lead
    if (row_is_bold(grid, ink, 0) and not row_is_bold(grid, ink, 1)) or (filled == 1 and lead == 1):
        return 1
    numeric = []
    for c in range(len(cells[0])):
        below = [row[c] for row in cells[1:] if row[c].strip()]
        if below and 2 * sum(map(is_number, below)) > len(below):
            numeric.append(is_number(cells[0][c]))
    return 0 if numeric and 2 * sum(numeric) > len(numeric) else 1


def merges(grid: Grid, h: np.ndarray, v: np.ndarray, fills: np.ndarray, lines: tuple[list[Line], list[Line]] | None = None) -> tuple[list[bool], list[bool]]:
    """(continues above, continues left) of every cell, by the rules between cells.

    A boundary tells something only where a rule covers 0.6 of one column and not of another.
    A row all of whose columns continue left is one cell only on a filled band.
    `lines`: those of the rules, if they are known.
    """
    rows, cols = grid.shape
    down, left = np.zeros((rows, cols), bool), np.zeros((rows, cols), bool)
    across, upright = lines or page_lines(h, v)

    def ruled(own: list[Line], ends: list[float]) -> np.ndarray:
        return np.array([any(x.covers(a, b) >= 0.6 for x in own) for a, b in zip(ends, ends[1:])])

    axes = [x.axis for x in across]
    for r in range(1, rows):
        met = ruled(near(across, axes, grid.ys[r]), grid.xs)
        if met.any() and not met.all():
            down[r] = ~met
    if grid.drawn:
        axes = [x.axis for x in upright]
        for c in range(1, cols):
            met = ruled(near(upright, axes, grid.xs[c]), grid.ys)
            if met.any() and not met.all():
                left[:, c] = ~met
        if cols > 1 and left[:, 1:].all(axis=1).any():
            left[left[:, 1:].all(axis=1) & ~filled_bands(grid, fills)] = False
    return down.reshape(-1).tolist(), left.reshape(-1).tolist()


def page_lines(h: np.ndarray, v: np.ndarray) -> tuple[list[Line], list[Line]]:
    return lines_of(h, True) if len(h) else [], lines_of(v, False) if len(v) else []


def near(lines: list[Line], axes: list[float], at: float) -> list[Line]:
    """Lines within SAME_EDGE, of lines by axis."""
    some = lines[bisect_left(axes, at - SAME_EDGE - 1) : bisect_right(axes, at + SAME_EDGE + 1)]
    return [x for x in some if abs(x.axis - at) <= SAME_EDGE]


def confidence(grid: Grid, ink: Ink, h: np.ndarray) -> tuple[float, int, int]:
    """(share of cells that hold text, inner row boundaries with a rule, inner row boundaries)."""
    rows, cols = grid.shape
    axes = np.sort((h[:, 1] + h[:, 3]) / 2)
    inner = np.array(grid.ys[1:-1])
    after = np.searchsorted(axes, inner)
    met = np.zeros(len(inner), bool)
    for k in (after - 1, after) if len(axes) else ():
        met |= np.abs(axes[np.clip(k, 0, len(axes) - 1)] - inner) <= SAME_EDGE
    return filled_cells(grid, ink) / max(1, rows * cols), int(met.sum()), len(inner)


def page_grids(ink: Ink, h: np.ndarray, v: np.ndarray, fills: np.ndarray) -> list[Grid]:
    """The grids of a page: ruled ones, or components that hold twice the cells; fills; bands or alignment."""
    found = ruled_grids(h, v)
    parts = component_grids(h, v)
    if parts and sum(filled_cells(g, ink) for g in parts) > 2 * sum(filled_cells(g, ink) for g in found):
        found = parts
    texts = sorted((float(ink.y1[r].max()), ink.line(r)) for r in ink.rows())
    aligned = [g for g in aligned_grids(ink) if corroborated(g, h, fills) or captioned(g, texts)]
    if is_coarse(found, ink):
        bands = band_grids(h, ink)
        within = [g for g in aligned if min(g.shape) >= 2]
        found = bands or within or found

    def apart(some: list[Grid]) -> list[Grid]:
        """Those that no grid found so far overlaps."""
        if not found:
            return some
        x0, y0, x1, y1 = np.array([g.box for g in found]).T
        return [g for g in some if not ((g.box[0] < x1) & (x0 < g.box[2]) & (g.box[1] < y1) & (y0 < g.box[3])).any()]

    found += [g for g in apart(fill_grids(fills)) if 2 * filled_cells(g, ink) >= g.shape[0] * g.shape[1]]
    found += apart(aligned)
    kept = [g if g.source != "rules" else trimmed(g, ink) for g in found]
    return sorted((g for g in kept if g is not None), key=lambda g: (g.ys[0], g.xs[0]))


GRID = (
    "doc_id long, page int, grid int, source string, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int, header_rows int, "
    "cells array<array<string>>, merged_down array<boolean>, merged_left array<boolean>, occupied double, rules_met int, rules_inner int"
)


#: Single ways to find grids, by name.
READERS = {
    "page": page_grids,
    "rules": lambda ink, h, v, fills: ruled_grids(h, v),
    "components": lambda ink, h, v, fills: component_grids(h, v),
    "fills": lambda ink, h, v, fills: fill_grids(fills),
    "aligned": lambda ink, h, v, fills: aligned_grids(ink),
    "bands": lambda ink, h, v, fills: band_grids(h, ink),
}


def grids(page_marks: DataFrame, reader: str = "page") -> DataFrame:
    """Every table of every page with its cells, header rows and merges; one pass a page.

    `reader`: `page` for the choice between all ways, or the name of a single one.
    """
    find = READERS[reader]

    schema = to_arrow_schema(_parse_datatype_string(GRID))

    def run(key: tuple, page: pa.Table) -> pa.Table:
        kind = page.column("kind")
        own = lambda k: page.filter(pc.equal(kind, k))
        h, v, fills = (np.column_stack([own(k).column(c).to_numpy().astype(float) for c in ("x0", "y0", "x1", "y1")]) for k in ("H", "V", "fill"))
        ink = Ink(own("glyph"))
        lines = page_lines(h, v)
        out = []
        for i, g in enumerate(find(ink, h, v, fills)):
            cells = cell_texts(g, ink)
            down, left = merges(g, h, v, fills, lines)
            out.append((key[0].as_py(), key[1].as_py(), i, g.source, *map(float, g.box), *g.shape, header_rows(g, cells, ink, fills), cells, down, left, *confidence(g, ink, h)))
        return pa.table({f.name: pa.array([row[k] for row in out], f.type) for k, f in enumerate(schema)}, schema=schema)

    return page_marks.select(*PAGE, *MARKS).groupBy(*PAGE).applyInArrow(run, GRID)


def outside_grids(glyphs: DataFrame, found: DataFrame) -> DataFrame:
    """Glyphs whose centre lies in no grid of their page."""
    g = found.select(*[F.col(c).alias(f"__{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("doc_id") == F.col("__doc_id")) & (F.col("page") == F.col("__page")) & x.between(F.col("__x0"), F.col("__x1")) & y.between(F.col("__y0"), F.col("__y1"))
    return glyphs.join(g, inside, "left_anti")


def boxed_grids(found: DataFrame, boxes: DataFrame, share: float = 0.2) -> DataFrame:
    """Grids with `kept`: drawn ones always, inferred ones only where a layout box covers `share` of them.

    boxes: doc_id, page, bx0..by1 of label table.
    """
    b = boxes.select(*[F.col(c).alias(f"__{c}") for c in PAGE], "bx0", "by0", "bx1", "by1")
    w = F.greatest(F.lit(0.0), F.least("x1", "bx1") - F.greatest("x0", "bx0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "by1") - F.greatest("y0", "by0"))
    covered = w * h >= share * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    near = (F.col("doc_id") == F.col("__doc_id")) & (F.col("page") == F.col("__page")) & covered
    met = found.join(b, near, "left_semi").select("doc_id", "page", "grid").distinct().withColumn("__met", F.lit(True))
    drawn = F.col("source").isin("rules", "components")
    return found.join(met, ["doc_id", "page", "grid"], "left").withColumn("kept", drawn | F.coalesce("__met", F.lit(False))).drop("__met")


def missing_grids(found: DataFrame, boxes: DataFrame, share: float = 0.2) -> DataFrame:
    """Layout boxes of tables of which no grid covers `share`: places for a reading."""
    g = found.select(*[F.col(c).alias(f"__{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    w = F.greatest(F.lit(0.0), F.least("__x1", "bx1") - F.greatest("__x0", "bx0"))
    h = F.greatest(F.lit(0.0), F.least("__y1", "by1") - F.greatest("__y0", "by0"))
    covered = w * h >= share * (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))
    return boxes.join(g, (F.col("doc_id") == F.col("__doc_id")) & (F.col("page") == F.col("__page")) & covered, "left_anti")


def fragmented(found: DataFrame) -> DataFrame:
    """doc_id, page, grid: grids stacked in one band whose column counts differ.

    Neighbours overlap by 0.6 of the narrower, with a gap between -1 and 2 rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*PAGE).orderBy("y0", "grid")
    p = {c: F.lag(c).over(w) for c in ("x0", "x1", "y1", "n_cols")}
    height = (F.col("y1") - F.col("y0")) / F.col("n_rows")
    overlap = F.least("x1", p["x1"]) - F.greatest("x0", p["x0"])
    gap = F.col("y0") - p["y1"]
    goes_on = (overlap >= 0.6 * F.least(F.col("x1") - F.col("x0"), p["x1"] - p["x0"])) & gap.between(-height, 2 * height)
    f = found.withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    f = f.withColumn("__chain", F.sum("__new").over(w))
    chain = Window.partitionBy(*PAGE, "__chain")
    return f.withColumn("__apart", F.max("n_cols").over(chain) != F.min("n_cols").over(chain)).where("__apart").select("doc_id", "page", "grid")


def elements_of(found: DataFrame) -> DataFrame:
    """Grids as table elements: doc_id, page, y0, type, text, cells, header_rows, merges, evidence."""
    from quire.schema import TABLE

    text = F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n")
    some = lambda c: F.when(F.exists(c, lambda x: x), F.col(c))
    evidence = F.when(F.col("source") == "fills", "fills").when(F.col("source") == "aligned", "alignment").otherwise("rules")
    return found.select("doc_id", "page", "x0", "y0", "x1", "y1", F.lit(TABLE).alias("type"), text.alias("text"), "cells", "header_rows", some("merged_down").alias("merged_down"), some("merged_left").alias("merged_left"), evidence.alias("evidence"))
