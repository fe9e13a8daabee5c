"""Queries over positioned pages, readings and outputs, and their DuckDB SQL.

Pages are set from the test tables: each text is typed in fixed pitch, rules and fills are
drawn at known places, so SQL can say what must be read back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import elements as el
from quire.operators import figures as fg
from quire.operators import graph as gh
from quire.operators import grids as gr
from quire.operators import headings as hd
from quire.operators import layout as ly
from quire.operators import links as lk
from quire.operators import lines as ln
from quire.operators import output as out
from quire.operators import readings as rd
from quire.operators.document import analyze, without_lattices
from quire.plans.catalog import _HTML, _customer_markdown, _glyphs, _route_pages, pages, query, table
from quire.sources.markdown import read_markdown

S = F.lit


def typed(rows: DataFrame) -> DataFrame:
    """Glyphs of rows (doc_id, page, n, text, x, y): 6 wide, baseline y, boxes 8 high; `weight` and `size` if given."""
    weight = F.col("weight") if "weight" in rows.columns else S(400)
    size = F.col("size") if "size" in rows.columns else S(10.0)
    g = rows.select("doc_id", "page", "n", F.col("x").alias("__x"), F.col("y").alias("__y"), weight.alias("weight"), size.alias("font_size"), F.posexplode(F.split("text", "")).alias("i", "text")).where("text <> ''")
    x, y = F.col("__x") + 6.0 * F.col("i"), F.col("__y").cast("double")
    box = lambda c: F.when(F.col("text") != " ", c)
    return g.select("doc_id", "page", (F.col("n") * 1000 + F.col("i")).cast("int").alias("draw_index"), "text", box(x).alias("x0"), box(y - 8).alias("y0"), box(x + 6).alias("x1"), box(y).alias("y1"), x.alias("origin_x"), y.alias("origin_y"), "font_size", S(6.0).alias("advance"), "weight", S(0.0).alias("rotation_deg"))


def drawn(rows: DataFrame, orient: str, x0, y0, x1, y1) -> DataFrame:
    return rows.select("doc_id", "page", S(orient).alias("orient"), *[c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])


def cells_of(found: DataFrame, *more: str) -> DataFrame:
    rows = found.select("doc_id", "page", "grid", *more, F.posexplode("cells").alias("row", "r"))
    return rows.select("doc_id", "page", "grid", *more, "row", F.posexplode("r").alias("col", "value"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation: its customers as rows, numbered from 1; row 0 is the header."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").cast("long").alias("doc_id"), S(0).alias("page"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("r"), F.array(F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.round("c_acctbal").cast("long").cast("string")).alias("t"))
    head = rows.select("doc_id", "page").distinct().select("doc_id", "page", S(0).alias("r"), F.array(S("key"), S("segment"), S("balance")).alias("t"))
    return rows.union(head)


def _ruled_page(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Glyphs and rules: columns of 100 from 50, rows of 20 from 100, a line of text above."""
    t = _customers(spark, sf_dir)
    cells = t.select("doc_id", "page", "r", F.posexplode("t").alias("c", "text")).select("doc_id", "page", (F.col("r") * 3 + F.col("c")).alias("n"), "text", (F.col("c") * 100 + 54.0).alias("x"), (F.col("r") * 20 + 114.0).alias("y"))
    above = t.where("r = 0").select("doc_id", "page", S(-1).alias("n"), S("All customers").alias("text"), S(54.0).alias("x"), S(60.0).alias("y"))
    size = t.groupBy("doc_id", "page").agg(F.max("r").alias("last"))
    h = drawn(size.select("*", F.explode(F.sequence(S(0), F.col("last") + 1)).alias("k")), "H", S(50), F.col("k") * 20 + 100, S(350), F.col("k") * 20 + 100)
    v = drawn(size.select("*", F.explode(F.array(*[S(50 + 100 * i) for i in range(4)])).alias("x")), "V", F.col("x"), S(100), F.col("x"), F.col("last") * 20 + 120)
    return typed(cells.union(above)), h.union(v)


_CUSTOMERS = """
WITH r AS (
  SELECT c_nationkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT AS r,
         [CAST(c_custkey AS VARCHAR), c_mktsegment, CAST(round(c_acctbal)::BIGINT AS VARCHAR)] AS t FROM customer
  UNION ALL SELECT DISTINCT c_nationkey, 0, ['key', 'segment', 'balance'] FROM customer)
"""


@query(_CUSTOMERS + "SELECT doc_id, r AS row_at, c::INT - 1 AS col_at, t[c] AS value, 1 AS header_rows FROM r, range(1, 4) k(c)")
def ruled_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    glyphs, rules = _ruled_page(spark, sf_dir)
    found = gr.grids(gr.marks(glyphs, rules))
    return cells_of(found, "header_rows").select("doc_id", F.col("row").alias("row_at"), F.col("col").alias("col_at"), "value", "header_rows")


@query("SELECT DISTINCT c_nationkey::BIGINT AS doc_id, 12::BIGINT AS outside FROM customer")
def outside_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    glyphs, rules = _ruled_page(spark, sf_dir)
    return gr.outside_grids(glyphs.where("x0 IS NOT NULL"), gr.grids(gr.marks(glyphs, rules))).groupBy("doc_id").agg(F.count("*").alias("outside"))


@query("SELECT c_nationkey::BIGINT AS doc_id, 1.0::DOUBLE AS occupied, count(*)::INT AS rules_met, count(*)::INT AS rules_inner FROM customer GROUP BY c_nationkey")
def grid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    glyphs, rules = _ruled_page(spark, sf_dir)
    return gr.grids(gr.marks(glyphs, rules)).select("doc_id", "occupied", "rules_met", "rules_inner")


_HEADED = """
SELECT c_nationkey::BIGINT AS doc_id, (c_nationkey % 3)::INT AS header_rows FROM customer
GROUP BY c_nationkey HAVING NOT (c_nationkey % 3 = 0 AND count(*) = 1)
"""


@query(_HEADED)
def grid_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of numbers without a header, under one row of words, or under two filled bands."""
    c = table(spark, sf_dir, "customer")
    k = (F.col("doc_id") % 3).cast("int")
    rows = c.select(F.col("c_nationkey").cast("long").alias("doc_id"), S(0).alias("page"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("r"), F.array((F.col("c_custkey") + 3000).cast("string"), (F.col("c_custkey") + 4000).cast("string")).alias("t"))
    rows = rows.withColumn("r", F.col("r") - 1 + k)
    heads = rows.select("doc_id", "page").distinct().where(k > 0).select("doc_id", "page", F.explode(F.sequence(S(0), k - 1)).alias("r"), F.array(S("first"), S("second")).alias("t"))
    t = rows.union(heads)
    cells = t.select("doc_id", "page", "r", F.posexplode("t").alias("c", "text")).select("doc_id", "page", (F.col("r") * 2 + F.col("c")).alias("n"), "text", (F.col("c") * 100 + 54.0).alias("x"), (F.col("r") * 20 + 114.0).alias("y"))
    size = t.groupBy("doc_id", "page").agg(F.max("r").alias("last"))
    h = drawn(size.select("*", F.explode(F.sequence(S(0), F.col("last") + 1)).alias("k")), "H", S(50), F.col("k") * 20 + 100, S(250), F.col("k") * 20 + 100)
    v = drawn(size.select("*", F.explode(F.array(S(50), S(150), S(250))).alias("x")), "V", F.col("x"), S(100), F.col("x"), F.col("last") * 20 + 120)
    fills = heads.where(k == 2).select("doc_id", "page", S(50.0).alias("x0"), (F.col("r") * 20 + 100.0).alias("y0"), S(250.0).alias("x1"), (F.col("r") * 20 + 120.0).alias("y1"))
    return gr.grids(gr.marks(typed(cells), h.union(v), fills), "rules").select("doc_id", "header_rows")


def _region_cells(spark: SparkSession, sf_dir: str, left: float, step: float, top: float, pitch: float) -> DataFrame:
    """A page for each region: its nations as rows of key, name and region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    t = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_regionkey").cast("long").alias("doc_id"), S(0).alias("page"), (F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_nationkey")) - 1).alias("r"), F.array(F.col("n_nationkey").cast("string"), "n_name", "r_name").alias("t"))
    return t.select("doc_id", "page", "r", F.posexplode("t").alias("c", "text")).select("doc_id", "page", (F.col("r") * 3 + F.col("c")).alias("n"), "r", "c", "text", (F.col("c") * step + left).alias("x"), (F.col("r") * pitch + top).alias("y"))


_REGION = """
WITH r AS (
  SELECT r_regionkey::BIGINT AS doc_id, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INT AS r,
         [CAST(n_nationkey AS VARCHAR), n_name, r_name] AS t FROM nation JOIN region ON r_regionkey = n_regionkey)
"""
_REGION_CELLS = _REGION + "SELECT doc_id, r AS row_at, c::INT - 1 AS col_at, t[c] AS value FROM r, range(1, 4) k(c)"


def _cells(found: DataFrame) -> DataFrame:
    return cells_of(found).select("doc_id", F.col("row").alias("row_at"), F.col("col").alias("col_at"), "value")


@query(_REGION_CELLS)
def fill_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell lies on a rectangle of its own."""
    c = _region_cells(spark, sf_dir, 54, 100, 112, 20)
    fills = c.select("doc_id", "page", (F.col("x") - 4).alias("x0"), (F.col("y") - 12).alias("y0"), (F.col("x") + 86).alias("x1"), (F.col("y") + 4).alias("y1"))
    return _cells(gr.grids(gr.marks(typed(c), None, fills)))


@query(_REGION_CELLS)
def aligned_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are aligned under a caption; nothing is drawn."""
    c = _region_cells(spark, sf_dir, 50, 150, 114, 14)
    caption = c.where("n = 0").select("doc_id", "page", S(-1).alias("n"), "r", "c", S("Table 1 Nations").alias("text"), S(50.0).alias("x"), S(90.0).alias("y"))
    return _cells(gr.grids(gr.marks(typed(c.union(caption)))))


@query(_REGION + """, w AS (SELECT doc_id, r, [t[1], t[2] || ' wrapped', t[3]] AS t FROM r)
SELECT doc_id, r AS row_at, c::INT - 1 AS col_at, t[c] AS value FROM w, range(1, 4) k(c)""")
def band_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules above and below alone; each row's second column has a second line."""
    c = _region_cells(spark, sf_dir, 50, 150, 114, 28)
    more = c.where("c = 1").select("doc_id", "page", (F.col("n") + 100).alias("n"), "r", "c", S("wrapped").alias("text"), "x", (F.col("y") + 12).alias("y"))
    size = c.groupBy("doc_id", "page").agg(F.max("y").alias("last"))
    rules = drawn(size, "H", S(46), S(100), S(500), S(100)).union(drawn(size, "H", S(46), F.col("last") + 20, S(500), F.col("last") + 20))
    return _cells(gr.grids(gr.marks(typed(c.union(more)), rules), "bands"))


@query(_REGION + """
SELECT doc_id, g::INT AS grid, r AS row_at, c::INT AS col_at, CASE c WHEN 0 THEN t[1] ELSE t[2 + g] END AS value FROM r, range(2) a(g), range(2) b(c)
""")
def component_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables side by side whose rules don't touch: key and name, key and region."""
    c = _region_cells(spark, sf_dir, 54, 100, 114, 20)
    two = c.where("c = 0").withColumn("n", F.col("n") + 50).withColumn("x", F.col("x") + 250)
    moved = c.withColumn("x", F.when(F.col("c") == 2, 404.0).otherwise(F.col("x")))
    size = c.groupBy("doc_id", "page").agg(F.max("r").alias("last"))
    each = size.select("*", F.explode(F.array(S(50), S(300))).alias("left"))
    h = drawn(each.select("*", F.explode(F.sequence(S(0), F.col("last") + 1)).alias("k")), "H", F.col("left"), F.col("k") * 20 + 100, F.col("left") + 200, F.col("k") * 20 + 100)
    v = drawn(each.select("*", F.explode(F.array(S(0), S(100), S(200))).alias("x")), "V", F.col("left") + F.col("x"), S(100), F.col("left") + F.col("x"), F.col("last") * 20 + 120)
    return cells_of(gr.grids(gr.marks(typed(moved.union(two)), h.union(v)), "components")).select("doc_id", "grid", F.col("row").alias("row_at"), F.col("col").alias("col_at"), "value")


@query(_REGION + "SELECT 1::BIGINT AS doc_id, count(*)::INT AS n_rows, (count(*) - count(DISTINCT doc_id))::INT AS continued FROM r")
def grid_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations in one table; no rule parts the rows of a region in its first column."""
    n = table(spark, sf_dir, "nation").select(S(1).cast("long").alias("doc_id"), S(0).alias("page"), "n_regionkey", "n_name", (F.row_number().over(Window.orderBy("n_regionkey", "n_nationkey")) - 1).alias("r"))
    first = n.withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("r")))
    text = first.select("doc_id", "page", F.col("r").alias("n"), F.col("n_name").alias("text"), S(154.0).alias("x"), (F.col("r") * 20 + 114.0).alias("y"))
    h = drawn(first, "H", F.when(F.col("k") == 1, 50).otherwise(150), F.col("r") * 20 + 100, S(250), F.col("r") * 20 + 100)
    size = n.groupBy("doc_id", "page").agg(F.max("r").alias("last"))
    foot = drawn(size, "H", S(50), F.col("last") * 20 + 120, S(250), F.col("last") * 20 + 120)
    v = drawn(size.select("*", F.explode(F.array(S(50), S(150), S(250))).alias("x")), "V", F.col("x"), S(100), F.col("x"), F.col("last") * 20 + 120)
    found = gr.grids(gr.marks(typed(text), h.union(foot).union(v)), "rules")
    return found.select("doc_id", "n_rows", F.size(F.filter("merged_down", lambda x: x)).alias("continued"))


@query("SELECT o_orderkey AS doc_id, (o_orderkey % 2 = 0 OR o_custkey % 3 = 0) AS kept, (o_custkey % 3 <> 0) AS missing FROM orders")
def grid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn or inferred grids, and layout boxes over all, a tenth or nothing of them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), S(0).alias("page"), S(0).alias("grid"), F.col("o_custkey").alias("k"))
    found = o.select("doc_id", "page", "grid", F.when(F.col("doc_id") % 2 == 0, "rules").otherwise("aligned").alias("source"), *[S(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, 100.0, 100.0))])
    top = F.when(F.col("k") % 3 == 0, 0.0).when(F.col("k") % 3 == 1, 90.0).otherwise(200.0)
    boxes = o.select("doc_id", "page", S(0.0).alias("bx0"), top.alias("by0"), S(100.0).alias("bx1"), (top + 100).alias("by1"))
    missing = gr.missing_grids(found, boxes).select("doc_id", S(True).alias("m"))
    return gr.boxed_grids(found, boxes).join(missing, "doc_id", "left").select("doc_id", "kept", F.coalesce("m", S(False)).alias("missing"))


@query("SELECT o_orderkey AS doc_id, 2::BIGINT AS stacked FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey % 2 = 0")
def fragmented_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grids one above the other: of unlike columns for odd orders, and far apart for odd customers."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("k"), F.explode(F.array(S(0), S(1))).alias("grid"))
    top = F.col("grid") * F.when(F.col("k") % 2 == 0, 110.0).otherwise(300.0)
    found = o.select("doc_id", S(0).alias("page"), "grid", S(0.0).alias("x0"), top.alias("y0"), S(200.0).alias("x1"), (top + 100).alias("y1"), S(5).alias("n_rows"), (3 + F.col("grid") * (F.col("doc_id") % 2)).cast("int").alias("n_cols"))
    return gr.fragmented(found).groupBy("doc_id").agg(F.count("*").alias("stacked"))


@query("SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 13 END::BIGINT AS rules FROM nation")
def lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-bleed rules at an even pitch, on both axes for even nations, and three rules of a table."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), S(0).alias("page"))
    ten = n.select("*", F.explode(F.sequence(S(1), S(10))).alias("k"))
    h = drawn(ten, "H", S(0), F.col("k") * 20, S(600), F.col("k") * 20)
    v = drawn(ten.where("doc_id % 2 = 0"), "V", F.col("k") * 20, S(0), F.col("k") * 20, S(800))
    own = drawn(n.select("*", F.explode(F.array(S(0), S(1), S(2))).alias("k")), "H", S(100), F.col("k") * 15 + 303, S(300), F.col("k") * 15 + 303)
    sizes = n.select("doc_id", "page", S(600.0).alias("width"), S(800.0).alias("height"))
    return without_lattices(h.union(v).union(own), sizes).groupBy("doc_id").agg(F.count("*").alias("rules"))


@query("""
SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE q BETWEEN 4 AND 20 AND q + l_linenumber BETWEEN 4 AND 20 AND l_linenumber <= 0.25 * (q + l_linenumber)) AS boxes
FROM (SELECT *, round(l_quantity)::INT AS q FROM lineitem) GROUP BY l_orderkey
""")
def checkboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.round("l_quantity").cast("int")
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), S(0).alias("x0"), S(0).alias("y0"), q.alias("x1"), (q + F.col("l_linenumber")).alias("y1"))
    return f.groupBy("doc_id").agg(F.sum(gr.is_checkbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).cast("long")).alias("boxes"))


# ---- drawings -----------------------------------------------------------------------------


@query("""
SELECT r_regionkey::BIGINT AS doc_id, 50.0::DOUBLE AS x0, 200.0::DOUBLE AS y0, 190.0::DOUBLE AS x1, 325.0::DOUBLE AS y1, 1::BIGINT AS labels, 1::BIGINT AS others FROM region
""")
def figure_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each nation of a region, a label below them, and a paragraph apart."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), S(0).alias("page"), (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("i"))
    fills = n.select("doc_id", "page", (F.col("i") * 30 + 50.0).alias("x0"), (280.0 - F.col("i") * 20).alias("y0"), (F.col("i") * 30 + 70.0).alias("x1"), S(300.0).alias("y1"))
    one = n.where("i = 0").select("doc_id", "page")
    blocks = one.select("doc_id", "page", F.explode(F.array(*[F.struct(S(i).alias("block"), *[S(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), b)]) for i, b in enumerate([(60.0, 310.0, 160.0, 325.0), (50.0, 600.0, 500.0, 700.0)], 1)])).alias("b")).select("doc_id", "page", "b.*")
    sizes = one.select("doc_id", "page", S(612.0).alias("width"), S(792.0).alias("height"))
    found = fg.figures(gr.marks(None, None, fills), blocks, sizes)
    held = fg.in_figures(blocks, found).groupBy("doc_id").agg(F.count("figure").alias("labels"), F.sum(F.col("figure").isNull().cast("long")).alias("others"))
    return found.join(held, "doc_id").select("doc_id", "x0", "y0", "x1", "y1", "labels", "others")


# ---- links and spans ----------------------------------------------------------------------


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One paragraph a benchmark text, with a link on its beginning (wrapped) and one on its end."""
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    e = t.select("doc_id", S(1).alias("seq"), S("doco:Paragraph").alias("type"), F.concat("t", S(" zz end link")).alias("text"), S(None).cast("array<array<string>>").alias("cells"))
    link = lambda i, uri, anchor, y: F.struct(S(i).alias("link_id"), S(uri).alias("uri"), anchor.alias("anchor"), S(10.0).alias("x0"), S(y).alias("y0"))
    wrapped = F.replace(F.substring("t", 1, 20), S(" "), S("\n"))
    owned = t.select("doc_id", S(1).alias("seq"), F.explode(F.array(link(2, "urn:b", S("zz end  link"), 50.0), link(1, "urn:a", wrapped, 20.0))).alias("l")).select("doc_id", "seq", "l.*")
    return e, owned


_LINKED = r"""
WITH t AS (SELECT item_id AS doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark),
l AS (
  SELECT doc_id, 0 AS link, 'urn:a' AS uri, 0 AS b, length(rtrim(left(t, 20)))::INT AS e, rtrim(left(t, 20)) AS a FROM t
  UNION ALL SELECT doc_id, 1, 'urn:b', length(t)::INT + 1, length(t)::INT + 12, 'zz end link' FROM t)
"""


@query(_LINKED + "SELECT doc_id, link, uri, b AS begin_at, e AS end_at FROM l")
def attached_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.attach_links(*_linked(spark, sf_dir)).select("doc_id", "link", "uri", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))


@query(_LINKED + "SELECT doc_id, uri AS target, b::BIGINT AS begin_index, e::BIGINT AS end_index, a AS anchor FROM l")
def link_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, owned = _linked(spark, sf_dir)
    return lk.nodes_of(lk.attach_links(e, owned), el.offsets(e)).select("doc_id", "target", "begin_index", "end_index", "anchor")


_RECTS = r"""
WITH t AS (SELECT item_id AS doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM benchmark),
c AS (SELECT doc_id, i, substring(t, i + 1, 1) AS ch FROM (SELECT *, unnest(range(least(100, length(t)))) AS i FROM t))
SELECT doc_id, (i // 80)::INT AS rect, min(i % 80 * 6 + 50)::DOUBLE AS x0, max(i % 80 * 6 + 56)::DOUBLE AS x1, any_value(i // 80 * 12 + 52)::DOUBLE AS y0
FROM c WHERE ch <> ' ' GROUP BY doc_id, i // 80
"""


@query(_RECTS)
def highlight_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred characters of each text, over two lines of 80."""
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), S(0).alias("page"), S(1).cast("long").alias("span_id"), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 100).alias("needle"), *[S(None).cast("double").alias(c) for c in ("bx0", "by0", "bx1", "by1")])
    return lk.highlights(_glyphs(spark, sf_dir), t).select("doc_id", "rect", "x0", "x1", "y0")


@query(_RECTS)
def span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by offsets in the projection of one paragraph a text."""
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    box = [S(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, 1000.0, 1e6))]
    e = t.select("doc_id", S(1).alias("seq"), S(0).alias("page"), S("doco:Paragraph").alias("type"), "text", S(None).cast("array<array<string>>").alias("cells"), *box)
    spans = t.select("doc_id", S(1).cast("long").alias("span_id"), S(0).cast("long").alias("begin"), F.least(S(100), F.length("text")).cast("long").alias("end"))
    return lk.span_boxes(e, _glyphs(spark, sf_dir), spans).select("doc_id", "rect", "x0", "x1", "y0")


@query("SELECT p_partkey AS doc_id, (length(p_name) + 2)::BIGINT AS signs, length(p_name) AS last_source, 0 AS first_of_fi, 0 AS last_of_fi FROM part")
def normal_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names behind a ligature, which is two letters in normal form."""
    maps = lk.normal_spans(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(S("ﬁ"), "p_name").alias("text")))
    spans = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), S(1).alias("span_id"), S(0).alias("begin"), S(2).alias("end"))
    both = lk.source_range(maps, spans)
    counted = maps.groupBy("doc_id").agg(F.count("*").alias("signs"), F.max("source").cast("long").alias("last_source"))
    return counted.join(both, "doc_id").select("doc_id", "signs", "last_source", F.col("first").alias("first_of_fi"), F.col("last").alias("last_of_fi"))


# ---- lines and glyphs ---------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT item_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM benchmark),
l AS (SELECT item_id, i, trim(substring(t, i * 80 + 1, 80)) AS line FROM (SELECT *, unnest(range((length(t) + 79) // 80)) AS i FROM t))
SELECT item_id AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY i)::INT AS line, line AS text FROM l WHERE line <> ''
""")
def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.printed_lines(_glyphs(spark, sf_dir)).select("doc_id", "line", "text")


@query(r"SELECT item_id AS doc_id, length(regexp_replace(text, '\s+', ' ', 'g')) AS n FROM benchmark")
def weight_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.weights(_glyphs(spark, sf_dir)).select("doc_id", "n")


@query(r"""
WITH g AS (SELECT item_id AS doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM benchmark),
c AS (SELECT doc_id, i, substring(t, i + 1, 1) AS ch, lag(i) OVER (PARTITION BY doc_id, i // 80 ORDER BY i) AS p FROM (SELECT *, unnest(range(length(t))) AS i FROM g) WHERE substring(t, i + 1, 1) <> ' ')
SELECT doc_id, count(*) AS closed FROM c WHERE i - p = 1 GROUP BY doc_id
""")
def gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.gap_histogram(_glyphs(spark, sf_dir)).where("bin = 0").select("doc_id", F.col("n").alias("closed"))


@query(r"""
WITH t AS (SELECT item_id AS doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM benchmark)
SELECT doc_id, floor(12.0::DOUBLE / 10.0::DOUBLE / 0.05::DOUBLE)::INT AS bin, ((length(t) + 79) // 80 - 1)::BIGINT AS n FROM t WHERE length(t) > 80
""")
def leading_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ln.lines(_glyphs(spark, sf_dir).where("text <> ' '"))
    return ln.leading_histogram(lines)


@query(r"SELECT count(*) AS documents, count(*) AS pages, sum(length(regexp_replace(text, '\s+', ' ', 'g')))::BIGINT AS glyphs, 1.0::DOUBLE AS unicode_rate, 0::BIGINT AS ligatures, 0::BIGINT AS failed FROM benchmark")
def corpus_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.probe(_glyphs(spark, sf_dir))


@query("""
WITH f AS (SELECT l_orderkey % 10 AS doc_id, l_returnflag AS face, CASE l_returnflag WHEN 'N' THEN 0.25 WHEN 'A' THEN 0.5 ELSE 0.2 END AS ink FROM lineitem),
c AS (SELECT doc_id, face, count(*) AS n, avg(ink) AS d FROM f GROUP BY ALL HAVING count(*) >= 40),
b AS (SELECT doc_id, arg_max(d, n) AS body FROM c GROUP BY doc_id)
SELECT f.doc_id, f.face, CASE WHEN c.d > 1.15 * b.body THEN 700 ELSE 400 END AS weight, count(*) AS n
FROM f JOIN c ON c.doc_id = f.doc_id AND c.face = f.face JOIN b ON b.doc_id = f.doc_id GROUP BY ALL
""")
def inferred_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as glyphs of three faces."""
    ink = F.when(F.col("l_returnflag") == "N", 0.25).when(F.col("l_returnflag") == "A", 0.5).otherwise(0.2)
    g = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("doc_id"), F.col("l_returnflag").alias("face"), ink.alias("ink"), S(None).cast("int").alias("weight"))
    return ln.inferred_weights(g).where("weight IS NOT NULL").groupBy("doc_id", "face", "weight").agg(F.count("*").alias("n"))


@query(r"SELECT item_id AS doc_id, length(replace(regexp_replace(text, '\s+', ' ', 'g'), ' ', ''))::BIGINT AS boxed, 6.0::DOUBLE AS least, 6.0::DOUBLE AS most FROM benchmark")
def synthesized_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = _glyphs(spark, sf_dir).withColumns({c: S(None).cast("double") for c in ("x0", "y0", "x1", "y1")})
    g = ln.synthesized_boxes(bare).where("x0 IS NOT NULL")
    return g.groupBy("doc_id").agg(F.count("*").alias("boxed"), F.min(F.round(F.col("x1") - F.col("x0"), 6)).alias("least"), F.max(F.round(F.col("x1") - F.col("x0"), 6)).alias("most"))


@query(r"""
SELECT item_id AS doc_id, length(t) AS events, length(replace(t, ' ', '')) AS glyphs, 0.5::DOUBLE AS image_cover, CASE WHEN item_id % 2 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS texty_cover
FROM (SELECT item_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM benchmark)
""")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image over the left half of each page, of text on even ones."""
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), S(0).alias("page"))
    sizes = t.select("*", S(640.0).alias("width"), S(800.0).alias("height"))
    images = t.select("*", S(0.0).alias("x0"), S(0.0).alias("y0"), S(320.0).alias("x1"), S(800.0).alias("y1"), (F.col("doc_id") % 2 == 0).alias("texty"))
    return ln.signals(sizes, _glyphs(spark, sf_dir), images).select("doc_id", "events", "glyphs", "image_cover", "texty_cover")


@query("SELECT n_nationkey::BIGINT AS doc_id, 0 AS cuts, 1 AS band_cuts FROM nation WHERE n_nationkey % 2 = 0")
def column_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve full lines, and under them twelve more, in two columns for even nations."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), S(0).alias("page"), F.explode(F.sequence(S(0), S(23))).alias("n"))
    text = F.when((F.col("n") >= 12) & (F.col("doc_id") % 2 == 0), F.concat(F.repeat(S("x"), 30), F.repeat(S(" "), 10), F.repeat(S("x"), 30))).otherwise(F.repeat(S("x"), 70))
    return ln.column_doubts(typed(n.select("doc_id", "page", "n", text.alias("text"), S(50.0).alias("x"), (F.col("n") * 12 + 60.0).alias("y")))).select("doc_id", "cuts", "band_cuts")


@query("""
SELECT n_nationkey::BIGINT AS doc_id, k::INT + 1 AS line, CASE WHEN k = 0 THEN 'over all of the three columns of this page runs one line of text' ELSE n_name || CAST((k - 1) // 3 AS VARCHAR) || CAST((k - 1) % 3 AS VARCHAR) END AS text
FROM nation, range(10) t(k)
""")
def ruler_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three short columns under heading rules: read one after the other, below the line that crosses them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), S(0).alias("page"), "n_name")
    body = n.select("*", F.explode(F.sequence(S(0), S(8))).alias("k")).select("doc_id", "page", (F.col("k") + 1).alias("n"), F.concat("n_name", F.floor(F.col("k") / 3).cast("string"), (F.col("k") % 3).cast("string")).alias("text"), (F.floor(F.col("k") / 3) * 140 + 50.0).alias("x"), ((F.col("k") % 3) * 12 + 112.0).alias("y"))
    top = n.select("doc_id", "page", S(0).alias("n"), S("over all of the three columns of this page runs one line of text").alias("text"), S(50.0).alias("x"), S(80.0).alias("y"))
    rules = drawn(n.select("*", F.explode(F.array(S(0), S(1), S(2))).alias("k")), "H", F.col("k") * 140 + 50, S(98), F.col("k") * 140 + 180, S(98))
    return ln.lines(typed(body.union(top)), rules).select("doc_id", "line", "text")


# ---- headings -----------------------------------------------------------------------------


def _atlas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of a document for each region, and its outline: a title, a number, nations in bold with a paragraph each, contents."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    t = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_regionkey").cast("long").alias("doc_id"), "r_name", "n_name", F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_nationkey")).alias("i"))
    block = lambda page, b, text, size, bold, lines: F.struct(S(page).alias("page"), b.alias("block"), text.alias("text"), S(size).alias("size"), S(bold).alias("bold"), S(lines).cast("long").alias("n_lines"), (b * 30.0).alias("y0"))
    said = F.concat(S("The people of "), "n_name", S(" live by farming, by trade with all of their neighbours, and by the many crafts that they have kept, as they have for ages."))
    nations = t.select("doc_id", F.explode(F.array(block(0, F.col("i") * 2 + 1, F.col("n_name"), 10.0, True, 1), block(0, F.col("i") * 2 + 2, said, 10.0, False, 3))).alias("b"))
    one = t.where("i = 1")
    heads = one.select("doc_id", F.explode(F.array(block(0, S(1), F.concat(S("Atlas of "), "r_name"), 20.0, False, 1), block(0, S(2), S("1. Overview"), 10.0, False, 1), block(1, S(1), S("Contents"), 10.0, False, 1), block(1, S(2), S("2. Results"), 10.0, False, 1))).alias("b"))
    outline = one.select("doc_id", F.col("n_name").alias("title"), S(3).alias("level"), S(0).alias("page"), S(90.0).alias("y"))
    return nations.union(heads).select("doc_id", "b.*"), outline


@query("""
WITH t AS (SELECT r_regionkey::BIGINT AS doc_id, r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT doc_id, n_name AS text, CASE WHEN i = 1 THEN 'outline' ELSE 'bold' END AS evidence, CASE WHEN i = 1 THEN 3 ELSE 2 END AS level FROM t
UNION ALL SELECT DISTINCT doc_id, 'Atlas of ' || r_name, 'title', 1 FROM t
UNION ALL SELECT DISTINCT doc_id, '1. Overview', 'numbering', 1 FROM t
""")
def detected_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd.detect(*_atlas(spark, sf_dir)).where("evidence IS NOT NULL").select("doc_id", "text", "evidence", "level")


@query("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'doco:SectionTitle' WHEN 1 THEN 'doco:Figure' WHEN 2 THEN 'doco:ListItem' WHEN 3 THEN 'doco:ListItem' ELSE 'doco:Paragraph' END AS type,
       CASE o_orderkey % 5 WHEN 0 THEN 'numbering' WHEN 1 THEN 'fills' WHEN 2 THEN 'marker' WHEN 3 THEN 'bullet' ELSE 'layout' END AS evidence,
       CASE WHEN o_orderkey % 5 = 3 THEN '' ELSE '• ' END || o_orderpriority AS text FROM orders
""")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(S("• "), "o_orderpriority").alias("text"), F.when(k == 0, "numbering").when(k == 1, "bold").alias("evidence"), S(1).alias("level"), F.when(k <= 1, 0).alias("figure"), F.when(k == 2, "a.").alias("marker"))
    found = hd.kinds(b.withColumn("text", F.when(F.col("doc_id") % 5 == 4, F.concat(S("x"), F.col("text"))).otherwise(F.col("text"))))
    return found.select("doc_id", "type", "evidence", F.when(F.col("doc_id") % 5 == 4, F.substring("text", 2, 1000)).otherwise(F.col("text")).alias("text"))


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 2 = 0 AS even, regexp_replace(o_orderpriority, '^[0-9]-', '') AS p FROM orders)
SELECT doc_id, CASE WHEN even THEN 'Results of ' || lower(p) ELSE 'Results of' END AS text FROM o
UNION ALL SELECT doc_id, upper(p) FROM o WHERE NOT even
""")
def joined_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two neighbouring titles; the second begins in lower case for even orders."""
    p = F.regexp_replace("o_orderpriority", "^[0-9]-", "")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, F.lower(p)).otherwise(F.upper(p)).alias("p"))
    e = o.select("doc_id", F.explode(F.array(F.struct(S(1).alias("seq"), S("Results of").alias("text")), F.struct(S(2).alias("seq"), F.col("p").alias("text")))).alias("t"))
    e = e.select("doc_id", "t.seq", S(0).alias("page"), S("doco:SectionTitle").alias("type"), S(2).alias("level"), S("font-size").alias("evidence"), "t.text")
    return hd.joined_fragments(e).select("doc_id", "text")


@query("""
SELECT o_orderkey AS doc_id, 1::BIGINT AS block, CASE WHEN o_orderkey % 2 = 0 THEN 'Scope.' ELSE 'Scope. A. ' || o_orderpriority END AS text FROM orders
UNION ALL SELECT o_orderkey, 2, 'a. ' || o_orderpriority FROM orders WHERE o_orderkey % 2 = 0
""")
def prefix_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A display word before a lettered item, in lower case for even orders."""
    letter = F.when(F.col("o_orderkey") % 2 == 0, "a. ").otherwise("A. ")
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), S(0).alias("page"), S(1).alias("block"), F.concat(S("Scope. "), letter, "o_orderpriority").alias("text"))
    return hd.split_prefix(b).select("doc_id", F.col("block").cast("long").alias("block"), "text")


@query("""
SELECT o_orderkey AS doc_id, 3::BIGINT AS block, CASE o_orderkey % 3 WHEN 0 THEN '•' WHEN 1 THEN '(a)' END AS marker FROM orders
UNION ALL SELECT o_orderkey, 1, NULL FROM orders WHERE o_orderkey % 3 = 2
""")
def attached_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker beside a block, above it, or a word instead of it."""
    k = F.col("doc_id") % 3
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), S(0).alias("page"))
    block = lambda b, text, x0, y0, y1: F.struct(S(b).cast("long").alias("block"), text.alias("text"), S(x0).alias("x0"), y0.alias("y0"), S(x0 + 50.0).alias("x1"), y1.alias("y1"), S(10.0).alias("size"))
    top = F.when(k == 0, 102.0).otherwise(80.0)
    b = o.select("doc_id", "page", F.explode(F.array(block(1, F.when(k == 0, "•").when(k == 1, "(a)").otherwise("word"), 40.0, top, top + 10), block(3, S("what it says"), 60.0, S(100.0), S(120.0)))).alias("b")).select("doc_id", "page", "b.*")
    return hd.attach_markers(b).select("doc_id", "block", "marker")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line, (l_linenumber % 2 = 0) AS checkbox FROM lineitem")
def checked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small square before every second line."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), S(0).alias("page"), F.col("l_linenumber").alias("line"), S(40.0).alias("x0"), (F.col("l_linenumber") * 20.0).alias("y0"), (F.col("l_linenumber") * 20.0 + 10).alias("y1"), S(10.0).alias("size"))
    boxes = line.where("line % 2 = 0").select("doc_id", "page", S(20.0).alias("x0"), (F.col("y0") + 1).alias("y0"), S(28.0).alias("x1"), (F.col("y0") + 9).alias("y1"))
    return hd.checked(line, boxes).select("doc_id", "line", "checkbox")


@query("SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS block, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > 1 THEN 1.0 END::DOUBLE AS gap FROM lineitem")
def gaps_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), S(0).alias("page"), F.col("l_linenumber").cast("long").alias("block"), (n * 20.0).alias("y0"), (n * 20.0 + 10).alias("y1"), S(10.0).alias("size"))
    return hd.gap_above(b).select("doc_id", "block", "gap")


@query("SELECT o_orderkey AS doc_id, line::INT AS line, (CASE WHEN line < 3 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS part FROM orders, range(1, 5) t(line)")
def title_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines of a block; for even orders a title box lies on the last two."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), S(0).alias("page"), S(1).alias("block"))
    rows = o.select("*", F.explode(F.sequence(S(1), S(4))).alias("line")).select("*", S(10.0).alias("x0"), (F.col("line") * 20.0).alias("y0"), S(110.0).alias("x1"), (F.col("line") * 20.0 + 10).alias("y1"))
    boxes = o.where("doc_id % 2 = 0").select("doc_id", "page", S(0.0).alias("bx0"), S(58.0).alias("by0"), S(200.0).alias("bx1"), S(95.0).alias("by1"))
    return hd.split_at_titles(rows, boxes).select("doc_id", "line", "part")


@query("""
SELECT o_orderkey AS doc_id, i::INT AS was, CASE WHEN o_orderkey % 2 = 0 THEN CASE i WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE 5 END ELSE i END::BIGINT AS block FROM orders, range(1, 6) t(i)
""")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns below a contents marker, read row by row for even orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), S(0).alias("page"))
    at = [(1, "Contents", 10.0, 10.0), (2, "One", 10.0, 30.0), (3, "Two", 10.0, 50.0), (4, "Three", 300.0, 30.0), (5, "Four", 300.0, 50.0)]
    # read column by column, blocks 2 and 3 come before 4 and 5
    b = o.select("*", F.explode(F.array(*[F.struct(S(i).alias("block"), S(t).alias("text"), S(x).alias("x0"), S(y).alias("y0")) for i, t, x, y in at])).alias("b")).select("doc_id", "page", "b.*").withColumn("was", F.col("block"))
    cols = o.select("doc_id", "page", F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1).alias("n_cols"))
    return hd.contents_order(b, cols).select("doc_id", "was", F.col("block").cast("long").alias("block"))


# ---- readings -----------------------------------------------------------------------------


@query("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'Total due ' || o_orderpriority WHEN 1 THEN o_orderpriority || ' | 85,159' WHEN 2 THEN 'Amount' || chr(10) || o_orderpriority ELSE o_orderpriority || ' due' END AS text
FROM orders
""")
def scrubbed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running lines inside a paragraph, cells, a reading and a paragraph of digits; a paragraph of nothing else is gone."""
    k = F.col("doc_id") % 4
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("p"))
    text = F.when(k == 0, F.concat(S("Total due "), "p", S(" Page 12 of 99"))).when(k == 1, F.concat("p", S(" | 85,159"))).when(k == 2, F.concat(S("Amount\n12 Quarterly report of the house\n"), "p")).otherwise(F.concat("p", S(" due")))
    cells = F.when(k == 1, F.array(F.array(F.col("p"), S("85,159 Quarterly report of the house"))))
    own = o.select("doc_id", S(1).alias("seq"), F.when(k == 1, "doco:Table").otherwise("doco:Paragraph").alias("type"), text.alias("text"), cells.alias("cells"), F.when(k == 2, "vlm").otherwise("layout").alias("provenance"))
    gone = o.select("doc_id", S(2).alias("seq"), S("doco:Paragraph").alias("type"), S("Page 3 of 7").alias("text"), S(None).cast("array<array<string>>").alias("cells"), S("layout").alias("provenance"))
    known = o.select("doc_id", F.explode(F.array(F.struct(S("Page 1 of 10").alias("text"), S(True).alias("varies")), F.struct(S("7").alias("text"), S(True).alias("varies")), F.struct(S("Quarterly report of the house").alias("text"), S(False).alias("varies")))).alias("f")).select("doc_id", "f.*")
    return rd.scrub(own.union(gone), known).select("doc_id", "text")


_SPLICED = """
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 8 AS k, CAST(o_orderkey + 1000 AS VARCHAR) AS a, CAST(o_custkey + 5000000 AS VARCHAR) AS b FROM orders)
SELECT doc_id, 2 AS seq, CASE k WHEN 5 THEN '<table><tr><td>' || a || '</td><td>' || b || '</td><td>z</td></tr></table>' ELSE a || ' | ' || b || ' | x' END AS text, CASE k WHEN 5 THEN 'shape-arbitrated' ELSE 'rules' END AS evidence FROM o
UNION ALL SELECT doc_id, 3, '# Votes 1,200 responses' || chr(10) || chr(10) || 'yes ' || a, 'region-chart' FROM o WHERE k % 2 = 0
UNION ALL SELECT doc_id, 3, 'plain ' || a, 'region-splice' FROM o WHERE k % 4 = 1
"""


@query(_SPLICED)
def spliced_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with an anchor before it and a region's anchor after it, with readings that win, lose, are vetoed or missing."""
    k = F.col("doc_id") % 8
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") + 1000).cast("string").alias("a"), (F.col("o_custkey") + 5_000_000).cast("string").alias("b"))
    none = S(None).cast("array<array<string>>")
    item = lambda seq, kind, text, cells, ev_: F.struct(S(seq).alias("seq"), S(kind).alias("type"), text.alias("text"), cells.alias("cells"), S(ev_).alias("evidence"))
    rows = F.array(item(1, "doco:Figure", S("[[VLMTAB:p0:t0]]"), none, "table-confidence"), item(2, "doco:Table", F.concat_ws(" | ", "a", "b", S("x")), F.array(F.array(F.col("a"), F.col("b"), S("x"))), "rules"), item(3, "doco:Figure", S("[[VLM:p0:r0]]"), none, "route"))
    e = o.select("doc_id", S(0).alias("page"), S("layout").alias("provenance"), F.explode(rows).alias("e")).select("doc_id", "page", "provenance", "e.*")
    cell = lambda *cs: F.concat(S("<table><tr>"), *[F.concat(S("<td>"), c, S("</td>")) for c in cs], S("</tr></table>"))
    a, b = F.col("a"), F.col("b")
    reading = F.when(k == 0, S("I cannot read this image")).when(k == 1, F.concat(a, S(" and "), b)).when(k == 2, cell(a, b, S("7777777"))).when(k == 3, cell(a, S("x"), S("y"))).when(k == 4, cell(a, b)).when(k == 7, S(None).cast("string")).otherwise(cell(a, b, S("z")))
    region = F.when(k % 2 == 0, F.concat(S("Votes\n1,200 responses\nyes "), a)).when(k % 4 == 1, F.concat(S("plain "), a))
    readings = o.select("doc_id", S("p0_t0").alias("crop"), reading.alias("reading")).union(o.select("doc_id", S("p0_r0"), region)).where("reading IS NOT NULL")
    structure = o.where(k == 6).select("doc_id", S("p0_t0").alias("crop"), cell(a, b).alias("reading"))
    text = o.select("doc_id", S(0).alias("page"), F.concat_ws(" ", "a", "b").alias("text"))
    return rd.splice(e, readings, text, structure).select("doc_id", "seq", "text", "evidence")


@query(r"""
SELECT conv_id AS doc_id, turn::INT AS page, CASE WHEN turn % 3 = 0 THEN 'page-tier' WHEN turn % 3 = 1 AND n < 100 THEN 'page-tier' ELSE 'layout' END AS evidence FROM (
  SELECT conv_id, turn, sum(length(regexp_replace(text, '[^\p{L}]', '', 'g'))) AS n FROM conversations GROUP BY ALL)
""")
def replaced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: some are read again in full, some give a few letters, some nothing."""
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("text", S("")))), " ").alias("text"))
    e = t.select("doc_id", "page", F.col("page").alias("seq"), S("doco:Paragraph").alias("type"), "text", S("layout").alias("provenance"), S("layout").alias("evidence"))
    readings = t.where("page % 3 < 2").select("doc_id", "page", F.when(F.col("page") % 3 == 0, F.col("text")).otherwise("few").alias("reading"))
    return rd.substitute_pages(e, readings, t).select("doc_id", "page", "evidence")


@query("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'doco:Paragraph' WHEN 1 THEN 'doco:SectionTitle' WHEN 2 THEN 'doco:SectionTitle' WHEN 3 THEN 'doco:Paragraph' WHEN 4 THEN 'doco:SectionTitle' ELSE 'doco:Paragraph' END AS type,
       CASE o_orderkey % 6 WHEN 0 THEN 'layout-caption' WHEN 1 THEN 'outline' WHEN 2 THEN 'bold' WHEN 3 THEN 'layout-caption' WHEN 4 THEN 'layout-title' ELSE 'layout' END AS evidence
FROM orders
""")
def layout_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles on a chart, stated by the outline, of a float without a caption's word, with it; paragraphs in and beside a title box."""
    k = F.col("doc_id") % 6
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), S(0).alias("page"), S(1).alias("seq"))
    e = o.select("*", F.when(k < 4, "doco:SectionTitle").otherwise("doco:Paragraph").alias("type"), F.when(k < 4, 2).alias("level"), F.when(k == 3, "Figure 2 Growth").otherwise("Growth").alias("text"), F.when(k == 1, "outline").when(k < 4, "bold").otherwise("layout").alias("evidence"), S(0.0).alias("x0"), S(0.0).alias("y0"), S(100.0).alias("x1"), S(20.0).alias("y1"))
    boxes = o.select("doc_id", "page", F.when(k < 2, "chart").when(k < 4, "figure_title").otherwise("paragraph_title").alias("label"), F.when(k == 5, 80.0).otherwise(0.0).alias("bx0"), S(0.0).alias("by0"), S(200.0).alias("bx1"), S(30.0).alias("by1"))
    return rd.arbitrate_titles(e, boxes).select("doc_id", "type", "evidence")


@query("""
SELECT o_orderkey AS doc_id, i::INT AS seq, CASE WHEN o_orderkey % 3 = 0 THEN ['head', 'table', 'left', 'right'] WHEN o_orderkey % 3 = 1 THEN ['head', 'left', 'right', 'table'] ELSE ['head', 'left', 'right', 'table'] END[i] AS text FROM orders, range(1, 5) t(i)
""")
def interleaved_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table below the heading, below the right column, or beside everything."""
    k = F.col("doc_id") % 3
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), S(0).alias("page"))
    item = lambda seq, text, x0, y0, x1, y1: F.struct(S(seq).alias("seq"), S(text).alias("text"), S(x0).alias("x0"), S(y0).alias("y0"), S(x1).alias("x1"), S(y1).alias("y1"))
    content = o.select("doc_id", "page", F.explode(F.array(item(1, "head", 0.0, 0.0, 500.0, 20.0), item(2, "left", 0.0, 100.0, 240.0, 300.0), item(3, "right", 260.0, 100.0, 500.0, 200.0))).alias("e")).select("doc_id", "page", "e.*")
    x0 = F.when(k == 0, 0.0).when(k == 1, 260.0).otherwise(600.0)
    tables = o.select("doc_id", "page", S(1).alias("seq"), S("table").alias("text"), x0.alias("x0"), F.when(k == 0, 40.0).otherwise(220.0).alias("y0"), (x0 + 200).alias("x1"), S(290.0).alias("y1"))
    return rd.interleaved(content, tables).select("doc_id", "seq", "text")


@query("""
SELECT doc_id, 'p0_full' AS crop, 'full' AS kind FROM documents WHERE doc_id % 5 IN (0, 1) OR (doc_id % 5 = 2 AND n_chars >= 100)
UNION ALL SELECT doc_id, 'p0_r0', 'region' FROM documents WHERE NOT (doc_id % 5 IN (0, 1) OR (doc_id % 5 = 2 AND n_chars >= 100))
UNION ALL SELECT doc_id, 'p0_t1', 'table' FROM documents WHERE NOT (doc_id % 5 IN (0, 1) OR (doc_id % 5 = 2 AND n_chars >= 100))
""")
def crop_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region and a table on every page; pages that are routed as a whole supersede them."""
    routed = ly.routes(_route_pages(spark, sf_dir))
    at = lambda n: routed.select("doc_id", "page", S(n).alias("number"), *[S(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, 10.0, 10.0))])
    return rd.crop_jobs(routed, at(0), at(1)).select("doc_id", "crop", "kind")


@query(f"""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'p0_t0' ELSE 'p0_r0' END AS crop,
       CASE WHEN o_orderkey % 2 = 0 THEN '{rd.PROMPTS["table"]}{rd.BOXED_HINT}' ELSE '{rd.PROMPTS["region"]}' END || CASE WHEN o_custkey % 2 = 0 THEN ' Links on it: [order](urn:' || CAST(o_orderkey AS VARCHAR) || ').' ELSE '' END AS prompt FROM orders
""".replace("Don't", "Don''t"))
def crop_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), S(0).alias("page"), "o_custkey")
    even = F.col("doc_id") % 2 == 0
    crops = o.select("doc_id", "page", F.when(even, "p0_t0").otherwise("p0_r0").alias("crop"), F.when(even, "table").otherwise("region").alias("kind"), S(0.0).alias("x0"), S(0.0).alias("y0"), S(100.0).alias("x1"), S(100.0).alias("y1"))
    links = o.select("doc_id", "page", F.concat(S("urn:"), F.col("doc_id").cast("string")).alias("uri"), S("order").alias("anchor"), F.when(F.col("o_custkey") % 2 == 0, 10.0).otherwise(500.0).alias("lx0"), S(10.0).alias("ly0"), F.when(F.col("o_custkey") % 2 == 0, 20.0).otherwise(510.0).alias("lx1"), S(20.0).alias("ly1"))
    return rd.prompts(crops, links, crops.where("kind = 'table'")).select("doc_id", "crop", "prompt")


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'region' WHEN 1 THEN 'table' ELSE 'insert' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'p2_r' WHEN 1 THEN 'p2_t' ELSE 'p2_n' END || CAST(o_custkey AS VARCHAR) AS crop FROM orders")
def parsed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, page = F.col("o_orderkey") % 3, S(2)
    text = F.when(k == 0, rd.anchor_text("region", page, F.col("o_custkey"))).when(k == 1, rd.anchor_text("table", page, F.col("o_custkey"))).otherwise(rd.anchor_text("insert", page, F.col("o_custkey")))
    return o.select(F.col("o_orderkey").alias("doc_id"), rd.parsed_anchor(text).alias("a")).select("doc_id", "a.kind", "a.crop")


@query("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN '12.' || chr(10) || 'text' WHEN 1 THEN '## Part 12' || chr(10) || 'text' WHEN 2 THEN o_orderpriority ELSE '| a | b |' END AS text, (o_orderkey % 2 = 1) AS cut FROM orders
""")
def cleaned_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings over bare numbers, code fences, tables of one cell; and replies that were cut."""
    k = F.col("o_orderkey") % 4
    reply = F.when(k == 0, S("# 12.\ntext")).when(k == 1, S("## Part 12\ntext")).when(k == 2, F.concat(S("<table><tr><td>"), "o_orderpriority", S("</td></tr></table>"))).otherwise(S("```markdown\n| a | b |\n```"))
    reason = F.when(F.col("o_orderkey") % 2 == 1, "MAX_TOKENS").otherwise("STOP")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), rd.without_item_headings(rd.cleaned_reply(reply)).alias("text"), rd.is_cut(reason).alias("cut"))


@query("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'no table' WHEN 1 THEN 'fabricated' WHEN 2 THEN 'lost values' WHEN 3 THEN 'lower recall' WHEN 4 THEN 'more crammed' ELSE 'ok' END AS reason, (o_orderkey % 6 = 5) AS accepted FROM orders
""")
def accepted_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    c = c.select("doc_id", F.when(k == 0, 0).otherwise(5).alias("rows"), F.when(k == 1, 0.1).otherwise(0.0).alias("fabricated"), F.when(k == 2, 5).otherwise(10).alias("n_values"), S(10).alias("ours_values"), F.when(k == 3, 0.5).otherwise(0.9).alias("recall"), S(0.9).alias("ours_recall"), F.when(k == 4, 2).otherwise(0).alias("crammed"), S(1).alias("ours_crammed"))
    return rd.accepted(c).select("doc_id", "reason", "accepted")


@query("SELECT doc_id, 'text ' || CAST(doc_id AS VARCHAR) AS reading FROM documents WHERE doc_id % 3 <> 2")
def reading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading's block between a footer and a refusal; for every third document there is nothing else."""
    d = table(spark, sf_dir, "documents").select("doc_id", S("p0_r0").alias("crop"))
    block = lambda o, label, text: F.struct(S(o).alias("block_order"), S(label).alias("label"), text.alias("content"))
    rows = d.select("*", F.explode(F.array(block(2, "text", F.when(F.col("doc_id") % 3 == 2, "I'm sorry, I cannot read this").otherwise(F.concat(S("text "), F.col("doc_id").cast("string")))), block(1, "footer", S("Page 1")), block(None, "text", S("I cannot read this image")))).alias("b")).select("doc_id", "crop", "b.*")
    return rd.reading_texts(rows, ["doc_id"])


# ---- graph and outputs --------------------------------------------------------------------


@query("""
WITH r AS (
  SELECT c_nationkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_name || '|' || c_mktsegment AS a, CAST(c_custkey AS VARCHAR) AS b FROM customer),
p AS (SELECT *, 9 + coalesce(sum(length(a) + length(b) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r)
SELECT doc_id, i::INT AS row_at, 0 AS col_at, pos AS begin_at, pos + length(a) AS end_at FROM p
UNION ALL SELECT doc_id, i::INT, 1, pos + length(a) + 1, pos + length(a) + 1 + length(b) FROM p
UNION ALL SELECT DISTINCT doc_id, 0, 0, 0, 4 FROM p UNION ALL SELECT DISTINCT doc_id, 0, 1, 5, 8 FROM p
""")
def cell_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of cells in the projection of a nation's customers."""
    return gh.cell_spans(read_markdown(_customer_markdown(spark, sf_dir))).select("doc_id", F.col("row").alias("row_at"), F.col("col").alias("col_at"), F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))


@query("""
WITH r AS (
  SELECT c_nationkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_name || '|' || c_mktsegment AS a, CAST(c_custkey AS VARCHAR) AS b FROM customer),
p AS (SELECT *, 9 + coalesce(sum(length(a) + length(b) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r)
SELECT doc_id, (1 + 2 * i)::INT AS n, 'doc:TableCell' AS type, 2 AS parent_n, a AS value, NULL AS row_header, 'name' AS column_header, pos AS begin_index FROM p
UNION ALL SELECT doc_id, (2 + 2 * i)::INT, 'doc:TableCell', 2, b, a, 'key', pos + length(a) + 1 FROM p
UNION ALL SELECT DISTINCT doc_id, 2, 'doco:Table', 1, NULL, NULL, NULL, 0 FROM p
UNION ALL SELECT DISTINCT doc_id, 1, 'doco:BodyMatter', 0, NULL, NULL, NULL, NULL FROM p
UNION ALL SELECT DISTINCT doc_id, 0, 'doco:Document', NULL, NULL, NULL, NULL, NULL FROM p
""")
def table_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of a nation's customers: a table and a node for each cell."""
    return gh.document_graph(read_markdown(_customer_markdown(spark, sf_dir))).select("doc_id", "n", "type", "parent_n", "value", "row_header", "column_header", "begin_index")


_DEPTHS = _HTML + """,
x AS (SELECT *, sum(CASE WHEN type = 'doco:SectionTitle' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS titles FROM h)
"""


@query(_DEPTHS + """
SELECT doc_id, depth::INT AS depth, count(*) AS nodes FROM (
  SELECT doc_id, CASE WHEN titles > 0 THEN 3 ELSE 2 END AS depth FROM x UNION ALL SELECT doc_id, 2 FROM x WHERE type = 'doco:SectionTitle'
  UNION ALL SELECT DISTINCT doc_id, 0 FROM x UNION ALL SELECT DISTINCT doc_id, 1 FROM x) GROUP BY ALL
""")
def node_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes lie how deep in the containment of each page."""
    return gh.ancestors(el.graph_nodes(pages(spark, sf_dir))).groupBy("doc_id", F.size("path").alias("depth")).agg(F.count("*").alias("nodes"))


@query(_DEPTHS + """, z AS (SELECT arg_min(text, (doc_id, seq)) AS text FROM h WHERE type = 'doco:SectionTitle' AND length(text) <= 100)
SELECT x.doc_id, count(*) AS nodes FROM x JOIN (SELECT doc_id, titles FROM x JOIN z ON z.text = x.text WHERE type = 'doco:SectionTitle') s ON s.doc_id = x.doc_id AND s.titles = x.titles GROUP BY x.doc_id
""")
def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands below sections of the first page's title."""
    e = pages(spark, sf_dir)
    first = e.where("type = 'doco:SectionTitle' AND length(text) <= 100").orderBy("doc_id", "seq").select("text").first()
    return gh.within_section(el.graph_nodes(e), first["text"] if first else "").groupBy("doc_id").agg(F.count("*").alias("nodes"))


@query(_HTML + "SELECT doc_id, seq, text FROM h WHERE type = 'doco:SectionTitle'")
def headings_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where("type = 'doco:SectionTitle'").select("doc_id", "seq", "text")


@query(_HTML + "SELECT doc_id, count(*) AS elements, count(*) AS without_box FROM h GROUP BY doc_id")
def missing_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages have no places on paper: every element lacks a box."""
    nodes = gh.document_graph(pages(spark, sf_dir)).where("seq IS NOT NULL AND type NOT IN ('doco:Section', 'doco:List', 'doc:Link', 'doc:TableCell')")
    return nodes.groupBy("doc_id").agg(F.count("*").alias("elements"), F.sum(F.col("bbox").isNull().cast("long")).alias("without_box"))


@query(_HTML + "SELECT doc_id, string_agg(text, concat(chr(10), chr(10)) ORDER BY seq) || chr(10) AS text FROM h GROUP BY doc_id")
def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.render(pages(spark, sf_dir), "text")


@query("""
SELECT conv_id AS doc_id, seq::INT AS seq FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM (SELECT DISTINCT conv_id, turn FROM conversations))
""")
def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges read apart and merged: the ids of the whole document, each once."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page")).distinct()
    e = t.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    return out.part_of(e, "1-3").union(out.part_of(e, "4-100000")).select("doc_id", "seq")


@query("""
WITH p AS (SELECT source, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'NearBlank' WHEN doc_id % 5 = 1 THEN 'Scanned' END AS v FROM documents WHERE doc_id % 5 < 2),
g AS (SELECT source, count(*) AS n, string_agg(CAST(doc_id + 1 AS VARCHAR), ', ' ORDER BY doc_id) AS pages, string_agg(DISTINCT v, ', ' ORDER BY v) AS verdicts FROM p GROUP BY source)
SELECT source AS doc_id, CASE WHEN n = 1 THEN 'page ' ELSE 'pages ' END || pages || CASE WHEN n = 1 THEN ' has' ELSE ' have' END || ' content that no reader transcribed (' || verdicts || '); it is missing here.' AS note FROM g
""")
def unread_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as pages of one; those without text were not transcribed."""
    source = table(spark, sf_dir, "documents").select("doc_id", "source")
    routed = ly.routes(_route_pages(spark, sf_dir)).join(source, "doc_id").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), "verdict")
    return out.notes(routed.where("verdict IN ('NearBlank', 'Scanned')"))


@query("""
WITH f AS (SELECT doc_id, 'in/' || lang || '/' || CAST(doc_id // 2 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '.html' END AS path, CAST(doc_id // 2 AS VARCHAR) AS stem, CASE WHEN doc_id % 2 = 0 THEN 'docx' ELSE 'html' END AS old FROM documents)
SELECT path, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN stem || '.' || old || '.md' ELSE stem || '.md' END AS target FROM f
""")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose stems repeat keep their old extension in the name."""
    half = F.floor(F.col("doc_id") / 2).cast("string")
    f = table(spark, sf_dir, "documents").select(F.concat(S("in/"), "lang", S("/"), half, F.when(F.col("doc_id") % 2 == 0, ".docx").otherwise(".html")).alias("path"))
    return out.destinations(f, "md")


@query("SELECT DISTINCT o_orderkey AS doc_id, 'unreadable' AS error FROM orders WHERE o_orderkey % 7 = 0")
def failed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 7 == 0, "unreadable").alias("error"))
    return out.failures(o)


@query("""
SELECT o_orderkey AS doc_id, sum(CASE WHEN k <> 1 THEN 1 ELSE 0 END)::BIGINT AS kept, (CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 5 END)::BIGINT AS stated FROM orders, range(5) t(k) GROUP BY o_orderkey
""")
def consumer_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five elements of which one is a drawing's; for even orders one title is out of the outline, another by size."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(S(0), S(4))).alias("seq"))
    kind = F.when(F.col("seq") == 1, "doco:Figure").when(F.col("seq") >= 3, "doco:SectionTitle").otherwise("doco:Paragraph")
    evidence = F.when((F.col("seq") == 3) & (F.col("doc_id") % 2 == 0), "outline").when(F.col("seq") >= 3, "font-size").otherwise("layout")
    e = o.withColumns({"type": kind, "evidence": evidence})
    kept = fg.without_fragments(e).groupBy("doc_id").agg(F.count("*").alias("kept"))
    stated = fg.outline_headings_only(e).groupBy("doc_id").agg(F.count("*").alias("stated"))
    return kept.join(stated, "doc_id")


@query("""
SELECT r_regionkey::BIGINT AS doc_id, i::INT AS seq, CASE i WHEN 1 THEN 'doco:SectionTitle' WHEN 2 THEN 'doco:Paragraph' ELSE 'doco:Table' END AS type FROM region, range(1, 4) t(i)
""")
def analyzed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pass over a page for each region: a title, a paragraph, a ruled table of its nations."""
    c = _region_cells(spark, sf_dir, 54, 130, 214, 20)
    one = c.where("n = 0").select("doc_id", "page")
    cells = c.select("doc_id", "page", "n", "text", "x", "y", S(10.0).alias("size"))
    said = ["it lists the nations of one of the regions of the world, each", "with its key and with the name of the region, as they stand in", "the tables that are given, one of them after the other, and in", "the order of their keys, so that all of it can be told by rules"]
    body = one.select("doc_id", "page", F.explode(F.array(*[F.struct(S(-40 + i).alias("n"), S(t).alias("text"), S(50.0).alias("x"), S(80.0 + 12 * i).alias("y"), S(10.0).alias("size")) for i, t in enumerate(said)])).alias("b")).select("doc_id", "page", "b.*")
    title = one.select("doc_id", "page", S(-50).alias("n"), S("A list of nations").alias("text"), S(50.0).alias("x"), S(50.0).alias("y"), S(20.0).alias("size"))
    glyphs = typed(cells.union(body).union(title))
    size = c.groupBy("doc_id", "page").agg(F.max("r").alias("last"))
    h = drawn(size.select("*", F.explode(F.sequence(S(0), F.col("last") + 1)).alias("k")), "H", S(50), F.col("k") * 20 + 200, S(440), F.col("k") * 20 + 200)
    v = drawn(size.select("*", F.explode(F.array(*[S(50 + 130 * i) for i in range(4)])).alias("x")), "V", F.col("x"), S(200), F.col("x"), F.col("last") * 20 + 220)
    sizes = one.select("doc_id", "page", S(612.0).alias("width"), S(792.0).alias("height"))
    return analyze(glyphs, sizes, h.union(v)).select("doc_id", "seq", "type")


# ---- PDF ----------------------------------------------------------------------------------


def pdf_of(lines: list[str], uri: str, mark: str, field: str, value: str, packed: bool = True) -> bytes:
    """A file of one page: lines of text, a rule under each, a link, a bookmark and a form field."""
    import zlib

    escaped = lambda s: s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    content = "BT /F1 10 Tf 14 TL 50 700 Td " + " ".join(f"({escaped(s)}) Tj T*" for s in lines) + " ET " + " ".join(f"50 {697 - 14 * i} 200 1 re f" for i in range(len(lines)))
    body = content.encode("cp1252")
    stream = zlib.compress(body) if packed else body
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R /Outlines 6 0 R /AcroForm << /Fields [9 0 R] >> >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [8 0 R 9 0 R] /Resources << /Font << /F1 5 0 R >> >> >>",
        (f"<< /Length {len(stream)}" + (" /Filter /FlateDecode" if packed else "") + " >>\nstream\n").encode() + stream + b"\nendstream",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier-Bold /Encoding /WinAnsiEncoding >>",
        b"<< /First 7 0 R /Last 7 0 R /Count 1 >>",
        f"<< /Title ({escaped(mark)}) /Parent 6 0 R /Dest [3 0 R /XYZ 0 692 0] >>".encode(),
        f"<< /Type /Annot /Subtype /Link /Rect [50 690 110 710] /A << /S /URI /URI ({escaped(uri)}) >> >>".encode(),
        b"<< /Type /Annot /Subtype /Widget /FT /Tx /T (" + escaped(field).encode() + b") /V <FEFF" + value.encode("utf-16-be").hex().encode() + b"> /Rect [300 600 400 620] >>",
    ]
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return out + b"trailer << /Root 1 0 R /Size 10 >>\n%%EOF"


def _pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region, that lists its nations."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    t = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_regionkey").cast("long").alias("doc_id"), "r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("lines"))

    @F.pandas_udf("binary")
    def build(name: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([pdf_of(list(xs), f"urn:{s}", f"Nations of {s}", "region.name", s, len(xs) % 2 == 0) for s, xs in zip(name, lines)])

    return t.select("doc_id", build("r_name", "lines").alias("content"))


@query(_REGION + "SELECT doc_id, r + 1 AS line, t[2] AS text, true AS bold FROM r")
def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File to glyphs to lines."""
    from quire.sources.pdf import read_pdf

    return ln.lines(read_pdf(_pdfs(spark, sf_dir), "glyphs")).select("doc_id", "line", "text", "bold")


@query(_REGION + "SELECT doc_id, count(*) AS rules, 0::BIGINT AS fills FROM r GROUP BY doc_id")
def pdf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.pdf import read_pdf, rules_and_fills

    rules, fills = rules_and_fills(read_pdf(_pdfs(spark, sf_dir), "shapes"))
    f = fills.groupBy("doc_id").agg(F.count("*").alias("fills"))
    return rules.groupBy("doc_id").agg(F.count("*").alias("rules")).join(f, "doc_id", "left").select("doc_id", "rules", F.coalesce("fills", S(0)).cast("long").alias("fills"))


@query("SELECT r_regionkey::BIGINT AS doc_id, 'Nations of ' || r_name AS title, 1 AS level, 0 AS page, 100.0::DOUBLE AS y FROM region")
def pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.pdf import read_pdf

    return read_pdf(_pdfs(spark, sf_dir), "outline").select("doc_id", "title", "level", "page", "y")


@query("SELECT r_regionkey::BIGINT AS doc_id, 0 AS page, 'urn:' || r_name AS uri, 50.0::DOUBLE AS x0, 82.0::DOUBLE AS y0, 110.0::DOUBLE AS x1, 102.0::DOUBLE AS y1 FROM region")
def pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.pdf import read_pdf

    return read_pdf(_pdfs(spark, sf_dir), "links").select("doc_id", "page", "uri", "x0", "y0", "x1", "y1")


@query("SELECT r_regionkey::BIGINT AS doc_id, 'region.name' AS name, 'text' AS kind, r_name AS value, 172.0::DOUBLE AS y0 FROM region")
def pdf_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled values of forms."""
    from quire.sources.pdf import read_pdf

    return read_pdf(_pdfs(spark, sf_dir), "fields").where("value IS NOT NULL").select("doc_id", "name", "kind", "value", "y0")
