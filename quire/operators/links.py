"""Links and spans on positioned pages: where an anchor's words stand, which element owns it, and the boxes of a span."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.elements import elements_at

PAGE = ["doc_id", "page"]


def folded(text: str) -> tuple[str, list[int]]:
    """NFKC of each character without white space, and the character each sign came from."""
    out, at = [], []
    for i, ch in enumerate(text):
        for c in unicodedata.normalize("NFKC", ch):
            if not c.isspace():
                out.append(c)
                at.append(i)
    return "".join(out), at


def located(text: str, anchor: str, start: int = 0) -> tuple[int, int] | None:
    """The first place from `start` where the anchor stands, blanks apart: (begin, end)."""
    held, at = folded(text)
    sought, _ = folded(anchor)
    if not sought:
        return None
    first = next((k for k, i in enumerate(at) if i >= start), len(at))
    k = held.find(sought, first)
    return None if k < 0 else (at[k], at[k + len(sought) - 1] + 1)


def attached(text: str, links: list[dict]) -> list[dict]:
    """Links of one element in reading order with their places: each is sought after the last one found.

    Overlapping places are given up, longest first; neighbours of one target with only
    blanks between them are one link.
    """
    found, start = [], 0
    for x in sorted(links, key=lambda x: (x["y0"], x["x0"], x["link_id"])):
        spot = located(text, x["anchor"] or "", start) or located(text, x["anchor"] or "")
        if spot is None:
            found.append({"uri": x["uri"], "begin": None, "end": None})
        else:
            start = spot[1]
            found.append({"uri": x["uri"], "begin": spot[0], "end": spot[1]})
    return merged(disjoint(found), text)


def disjoint(links: list[dict]) -> list[dict]:
    """By begin, the longest first; a link that begins within the one before loses its place."""
    placed = sorted((x for x in links if x["begin"] is not None), key=lambda x: (x["begin"], -x["end"]))
    out, upto = [], 0
    for x in placed:
        if x["begin"] >= upto:
            out.append(x)
            upto = x["end"]
        else:
            out.append({**x, "begin": None, "end": None})
    return [*[x for x in out if x["begin"] is not None], *[x for x in out if x["begin"] is None], *[x for x in links if x["begin"] is None]]


def merged(links: list[dict], text: str) -> list[dict]:
    """Wrapped anchors: neighbours with one target and only blanks between."""
    out: list[dict] = []
    for x in links:
        last = out[-1] if out else None
        if last is not None and last["begin"] is not None and x["begin"] is not None and last["uri"] == x["uri"] and not text[last["end"] : x["begin"]].strip():
            out[-1] = {**last, "end": x["end"]}
        else:
            out.append(x)
    return out


ATTACHED = "doc_id long, seq int, link int, uri string, begin int, end int"


def attach_links(elements: DataFrame, owned: DataFrame) -> DataFrame:
    """doc_id, seq, link, uri, begin, end: links of each element, placed in its text.

    owned: doc_id, seq, link_id, uri, anchor, x0, y0, as `layout.link_owners` names the owner.
    """
    both = elements.select("doc_id", "seq", "text").join(owned.select("doc_id", "seq", F.struct("link_id", "uri", "anchor", "x0", "y0").alias("l")), ["doc_id", "seq"]).groupBy("doc_id", "seq").agg(F.first("text").alias("text"), F.collect_list("l").alias("links"))
    kind = "array<struct<uri:string,begin:int,end:int>>"

    @F.pandas_udf(kind)
    def place(texts: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([attached(t or "", [dict(x) for x in xs]) for t, xs in zip(texts, links)])

    placed = both.select("doc_id", "seq", F.posexplode(place("text", "links")).alias("link", "l"))
    return placed.select("doc_id", "seq", "link", "l.uri", "l.begin", "l.end")


def nodes_of(linked: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id, seq, link, target, begin_index, end_index, anchor: link nodes with offsets in the projection.

    linked: as `attach_links`; offsets: as `elements.offsets`.  Tables' links have no offsets, as
    their projection isn't their text.
    """
    o = offsets.select("doc_id", "seq", "text", F.col("begin").alias("__first"), (F.length("text") - F.length(F.ltrim("text"))).alias("__lead"), "type")
    j = linked.join(o, ["doc_id", "seq"])
    known = F.col("begin").isNotNull() & (F.col("begin") >= F.col("__lead")) & (F.col("type") != "doco:Table") & F.col("__first").isNotNull()
    shift = F.col("__first") - F.col("__lead")
    return j.select("doc_id", "seq", "link", F.col("uri").alias("target"), F.when(known, shift + F.col("begin")).alias("begin_index"), F.when(known, shift + F.col("end")).alias("end_index"), F.when(known, F.substr("text", F.col("begin") + 1, F.col("end") - F.col("begin"))).alias("anchor"))


# ---- spans to boxes ----------------------------------------------------------------------


def line_boxes(glyphs: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Boxes of glyphs in reading order, one for each visual line they run over."""
    out: list[list[float]] = []
    for x0, y0, x1, y1 in glyphs:
        if x0 != x0:
            continue
        last = out[-1] if out else None
        same = last is not None and min(last[3], y1) - max(last[1], y0) >= 0.5 * min(last[3] - last[1], y1 - y0) and x0 >= last[0] - 0.5
        if same:
            out[-1] = [min(last[0], x0), min(last[1], y0), max(last[2], x1), max(last[3], y1)]
        else:
            out.append([x0, y0, x1, y1])
    return [tuple(b) for b in out]


def glyph_range(page: pd.DataFrame, needle: str, within: tuple[float, float, float, float] | None = None) -> tuple[int, int] | None:
    """First and last glyph that print the needle, blanks apart; inside a box if it stands there."""
    text, at = [], []
    for i, t in enumerate(page["text"]):
        for c in folded(t or "")[0]:
            text.append(c)
            at.append(i)
    held, sought = "".join(text), folded(needle)[0]
    if not sought:
        return None
    first, k = None, held.find(sought)
    while k >= 0:
        spot = (at[k], at[k + len(sought) - 1])
        first = first or spot
        if within is None:
            return spot
        g = page.iloc[spot[0]]
        if within[0] - 1 <= g["x0"] <= within[2] + 1 and within[1] - 1 <= g["y0"] <= within[3] + 1:
            return spot
        k = held.find(sought, k + 1)
    return first


BOXES = "doc_id long, page int, span_id long, rect int, x0 double, y0 double, x1 double, y1 double"


def highlights(glyphs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, page, span_id, rect, x0..y1: the boxes of sought texts, one a line.

    asked: doc_id, page, span_id, needle and the box bx0..by1 (null: anywhere) that is preferred.
    """
    cols = ["text", "x0", "y0", "x1", "y1", "origin_y", "origin_x", "draw_index"]
    g = glyphs.select(*PAGE, *cols, F.lit(None).cast("long").alias("span_id"), F.lit(None).cast("string").alias("needle"), *[F.lit(None).cast("double").alias(c) for c in ("bx0", "by0", "bx1", "by1")])
    a = asked.select(*PAGE, *[F.lit(None).cast("string" if c == "text" else "double").alias(c) for c in cols[:-1]], F.lit(0).alias("draw_index"), "span_id", "needle", *[F.col(c).cast("double") for c in ("bx0", "by0", "bx1", "by1")])

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        own = page[page["span_id"].isna()].sort_values("draw_index")
        out = []
        for r in page[page["span_id"].notna()].itertuples():
            box = (r.bx0, r.by0, r.bx1, r.by1) if r.bx0 == r.bx0 and r.bx0 is not None else None
            spot = glyph_range(own, r.needle or "", box)
            if spot is not None:
                part = own.iloc[spot[0] : spot[1] + 1]
                boxes = line_boxes(list(zip(part["x0"], part["y0"], part["x1"], part["y1"])))
                out += [(*key, int(r.span_id), i, *b) for i, b in enumerate(boxes)]
        return pd.DataFrame(out, columns=[f.split()[0] for f in BOXES.split(", ")])

    return g.unionByName(a).groupBy(*PAGE).applyInPandas(run, BOXES)


def span_boxes(elements: DataFrame, glyphs: DataFrame, spans: DataFrame) -> DataFrame:
    """Boxes of spans of the projection: span → element → its page and box → glyphs → a box a line.

    spans: doc_id, span_id, begin, end; elements: with page and x0..y1.
    """
    places = elements_at(elements, spans.select("doc_id", F.col("begin").alias("offset")).distinct())
    at = spans.join(places, (spans["doc_id"] == places["doc_id"]) & (spans["begin"] == places["offset"])).select(spans["doc_id"], "span_id", "begin", "end", "seq", "place").where("seq IS NOT NULL")
    e = elements.select("doc_id", "seq", "page", "text", "x0", "y0", "x1", "y1")
    asked = at.join(e, ["doc_id", "seq"]).select("doc_id", "page", "span_id", F.substr(F.trim("text"), (F.col("place") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")).alias("needle"), F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    return highlights(glyphs, asked)


def normal_spans(texts: DataFrame) -> DataFrame:
    """doc_id, n, sign, source: each sign of a text's NFKC with the character that it came from."""

    @F.pandas_udf("array<struct<sign:string,source:int>>")
    def maps(column: pd.Series) -> pd.Series:
        return column.map(lambda t: [{"sign": c, "source": i} for i, ch in enumerate(t or "") for c in unicodedata.normalize("NFKC", ch)])

    return texts.select("doc_id", F.posexplode(maps("text")).alias("n", "m")).select("doc_id", "n", "m.sign", "m.source")


def source_range(maps: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, span_id, first, last: the characters that a span of the normal text came from."""
    j = maps.join(spans, "doc_id").where((F.col("n") >= F.col("begin")) & (F.col("n") < F.col("end")))
    return j.groupBy("doc_id", "span_id").agg(F.min("source").alias("first"), F.max("source").alias("last"))


def normal_query(text: str) -> str:
    """A sought text as projections hold it."""
    return unicodedata.normalize("NFKC", text)


def capped(links: DataFrame, most: int = 100_000) -> DataFrame:
    """At most `most` links of a document, in order: a bound against hostile files."""
    w = Window.partitionBy("doc_id").orderBy("page", "link_id")
    return links.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
