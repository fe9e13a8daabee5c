"""The whole document graph: sections, lists, elements, links and table cells, with places in the projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import shortened
from quire.operators.elements import offsets, reading_order, section_parents
from quire.operators.tables import grid, table_cells
from quire.schema import ITEM, TITLE


def cell_spans(e: DataFrame) -> DataFrame:
    """doc_id, seq, row, col, value, begin, end: places of filled cells in the projection of their table.

    Cells are trimmed and joined by tabs, rows lose blanks at their ends, the whole is trimmed.
    """
    g = grid(e).select("doc_id", "seq", "row", "col", F.trim("value").alias("value"))
    line = Window.partitionBy("doc_id", "seq", "row").orderBy("col")
    g = g.withColumn("__at", F.coalesce(F.sum(F.length("value") + 1).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a row ends with its last filled cell
    g = g.withColumn("__size", F.coalesce(F.max(F.when(F.col("value") != "", F.col("__at") + F.length("value"))).over(Window.partitionBy("doc_id", "seq", "row")), F.lit(0)))
    rows = g.groupBy("doc_id", "seq", "row").agg(F.max("__size").alias("__size"), F.min(F.when(F.col("value") != "", F.col("__at"))).alias("__indent"))
    down = Window.partitionBy("doc_id", "seq").orderBy("row")
    rows = rows.withColumn("__first", F.coalesce(F.sum(F.col("__size") + 1).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy("doc_id", "seq")
    rows = rows.withColumn("__lead", F.min(F.when(F.col("__size") > 0, F.col("__first") + F.col("__indent"))).over(whole))
    j = g.drop("__size").join(rows.select("doc_id", "seq", "row", "__first", "__lead"), ["doc_id", "seq", "row"]).where("value <> ''")
    begin = (F.col("__first") + F.col("__at") - F.col("__lead")).cast("long")
    return j.select("doc_id", "seq", "row", "col", "value", begin.alias("begin"), (begin + F.length("value")).alias("end"))


def bbox_text(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1"):
    return F.when(F.col(x0).isNotNull(), F.format_string("%.2f,%.2f,%.2f,%.2f", *[F.col(c).cast("double") for c in (x0, y0, x1, y1)]))


def document_graph(e: DataFrame, base: str = "urn:doc") -> DataFrame:
    """doc_id, n, iri, type, label, parent_n, seq, page, bbox, evidence, begin_index, end_index,
    target, row_index, col_index, value, row_header, column_header: nodes in order of creation.

    A title opens a section, a run of items a list; an element is followed by its links and a
    table by its cells.  Links aren't contained: `parent_n` of a link is the element it is on.
    """
    placed = offsets(e)
    s = section_parents(placed).withColumn("__opens", F.when(F.col("type") == TITLE, "doco:Section").when((F.col("type") == ITEM) & (F.coalesce(F.lag("type").over(reading_order()), F.lit("")) != ITEM), "doco:List"))
    box = bbox_text() if {"x0", "y0", "x1", "y1"} <= set(e.columns) else F.lit(None).cast("string")
    none = {c: F.lit(None).cast(t) for c, t in {"begin_index": "long", "end_index": "long", "target": "string", "row_index": "int", "col_index": "int", "value": "string", "row_header": "string", "column_header": "string"}.items()}
    known = ["doc_id", "seq", "type", "section", "page", "evidence"]
    own = s.select(*known, F.lit(1).alias("k"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("type").alias("kind"), F.col("text").alias("label"), box.alias("bbox"), *[(F.col({"begin_index": "begin", "end_index": "end"}[c]) if c in ("begin_index", "end_index") else v).alias(c) for c, v in none.items()])
    blank = F.lit(None).cast("string")
    silent = [F.lit(None).cast(s.schema[c].dataType).alias(c) if c in ("page", "evidence") else F.col(c) for c in known]
    opened = s.where("__opens IS NOT NULL").select(*silent, F.lit(0).alias("k"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("__opens").alias("kind"), blank.alias("label"), blank.alias("bbox"), *[v.alias(c) for c, v in none.items()])
    lead = F.length("text") - F.length(F.ltrim("text"))
    x = s.where("size(links) > 0").select(*known, "text", "begin", lead.alias("lead"), F.posexplode("links").alias("i", "l"))
    sure = F.col("l.begin").isNotNull() & (F.col("l.begin") >= F.col("lead")) & F.col("begin").isNotNull() & (F.col("type") != "doco:Table")
    shift = F.col("begin") - F.col("lead")
    links = x.select(*known, F.lit(2).alias("k"), "i", F.lit(0).alias("j"), F.lit("doc:Link").alias("kind"), F.when(sure, F.substr("text", F.col("l.begin") + 1, F.col("l.end") - F.col("l.begin"))).alias("label"), blank.alias("bbox"), F.when(sure, shift + F.col("l.begin")).cast("long").alias("begin_index"), F.when(sure, shift + F.col("l.end")).cast("long").alias("end_index"), F.col("l.uri").alias("target"), *[none[c].alias(c) for c in ("row_index", "col_index", "value", "row_header", "column_header")])
    spans = cell_spans(e).select("doc_id", "seq", (F.col("row")).alias("__row"), F.col("col").alias("col_index"), F.col("value").alias("__raw"), F.col("begin").alias("__b"), F.col("end").alias("__e"))
    heads = s.select(*known, F.coalesce("header_rows", F.lit(1)).alias("__head"), F.col("begin").alias("__table"))
    c = table_cells(e).join(heads, ["doc_id", "seq"]).withColumn("__row", F.col("row_index") + F.col("__head"))
    c = c.join(spans, ["doc_id", "seq", "__row", "col_index"], "left")
    printed = F.col("__raw") == F.col("value")
    cells = c.select(*known, F.lit(3).alias("k"), F.col("row_index").alias("i"), F.col("col_index").alias("j"), F.lit("doc:TableCell").alias("kind"), blank.alias("label"), blank.alias("bbox"), F.when(printed, F.col("__table") + F.col("__b")).alias("begin_index"), F.when(printed, F.col("__table") + F.col("__e")).alias("end_index"), none["target"].alias("target"), "row_index", "col_index", "value", "row_header", "column_header")
    rows = own.unionByName(opened).unionByName(links).unionByName(cells)
    w = Window.partitionBy("doc_id").orderBy("seq", "k", "i", "j")
    rows = rows.withColumn("n", F.row_number().over(w) + 1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__list": F.last(F.when(F.col("kind") == "doco:List", F.col("n")), ignorenulls=True).over(upto), "__own": F.max(F.when(F.col("k") == 1, F.col("n"))).over(Window.partitionBy("doc_id", "seq"))})
    sections = rows.where("kind = 'doco:Section'").select(F.col("doc_id").alias("__d"), F.col("seq").alias("__s"), F.col("n").alias("__section"))
    at = F.when(F.col("kind") == TITLE, F.col("seq")).otherwise(F.col("section"))
    j = rows.withColumn("__at", at).join(sections, (F.col("doc_id") == F.col("__d")) & (F.col("__at") == F.col("__s")), "left")
    parent = F.when(F.col("k") >= 2, F.col("__own")).when(F.col("kind") == ITEM, F.col("__list")).otherwise(F.coalesce("__section", F.lit(1)))
    segment = F.when(F.col("kind") == "doco:Section", "section").when(F.col("kind") == "doc:Link", "link").otherwise("element")
    iri = lambda kind, n: F.concat(F.lit(base + "/"), F.col("doc_id").cast("string"), F.lit("/"), kind, F.lit("/"), n.cast("string"))
    out = j.select("doc_id", "n", iri(segment, F.col("n")).alias("iri"), F.col("kind").alias("type"), shortened(F.col("label")).alias("label"), parent.alias("parent_n"), "seq", "page", "bbox", "evidence", *none)
    tops = F.array(F.struct(F.lit(0).alias("n"), F.lit("doco:Document").alias("t"), F.lit(None).cast("int").alias("p")), F.struct(F.lit(1).alias("n"), F.lit("doco:BodyMatter").alias("t"), F.lit(0).alias("p")))
    roots = e.where(F.col("type").isNotNull()).select("doc_id").distinct().select("doc_id", F.explode(tops).alias("r")).select("doc_id", F.col("r.n").alias("n"), iri(F.lit("element"), F.col("r.n")).alias("iri"), F.col("r.t").alias("type"), F.col("r.p").alias("parent_n"))
    return out.unionByName(roots, allowMissingColumns=True)


def ancestors(nodes: DataFrame) -> DataFrame:
    """doc_id, n, path: the nodes that contain each node, outermost first; containment is at most nine deep."""
    up = nodes.where("type <> 'doc:Link'").select("doc_id", "n", "parent_n")
    out = up.withColumn("path", F.array().cast("array<int>")).withColumn("at", F.col("parent_n"))
    parents = up.select("doc_id", F.col("n").alias("__n"), F.col("parent_n").alias("__p"))
    for _ in range(9):
        out = out.join(parents, (out.doc_id == parents.doc_id) & (F.col("at") == F.col("__n")), "left").select(out.doc_id, "n", F.when(F.col("at").isNotNull(), F.concat(F.array("at"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.col("__p").alias("at"))
    return out.select("doc_id", "n", "path")


def within_section(nodes: DataFrame, title: str) -> DataFrame:
    """Nodes below the sections of this title, at any depth."""
    heads = nodes.where((F.col("type") == TITLE) & (F.col("label") == title)).select("doc_id", F.col("parent_n").alias("__section")).distinct()
    j = ancestors(nodes).join(heads, "doc_id").where(F.array_contains("path", F.col("__section"))).select("doc_id", "n").distinct()
    return nodes.join(j, ["doc_id", "n"], "left_semi")


CONTEXT = (
    '{"doco":"http://purl.org/spar/doco/","po":"http://www.essepuntato.it/2008/12/pattern#","rdfs":"http://www.w3.org/2000/01/rdf-schema#",'
    '"nif":"http://persistence.uni-leipzig.org/nlp2rdf/ontologies/nif-core#","doc":"urn:quire:doc#"}'
)


def to_jsonld(e: DataFrame, base: str = "urn:doc") -> DataFrame:
    """doc_id, text: the whole graph as JSON-LD, with places, evidence, links and cells; containment lists direct children only."""
    nodes = document_graph(e, base)
    ids = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: F.create_map(F.lit("@id"), x["iri"]))
    below = nodes.where("parent_n IS NOT NULL").groupBy("doc_id", F.col("parent_n").alias("n"))
    linked = F.col("type") == "doc:Link"
    kids = below.agg(ids(F.when(~linked, F.struct("n", "iri"))).alias("contains"), ids(F.when(linked, F.struct("n", "iri"))).alias("links"))
    named = {
        "@id": F.col("iri"), "@type": F.col("type"), "rdfs:label": F.when(~linked, F.col("label")), "doc:pageIndex": F.when(~F.col("type").isin("doc:Link", "doc:TableCell"), F.col("page")),
        "doc:bbox": F.col("bbox"), "doc:evidence": F.when(~F.col("type").isin("doc:Link", "doc:TableCell"), F.col("evidence")), "nif:beginIndex": F.col("begin_index"), "nif:endIndex": F.col("end_index"),
        "nif:isString": F.when(linked, F.col("label")).when(F.col("begin_index").isNotNull(), F.col("value")), "doc:linkTarget": F.when(F.col("target").isNotNull(), F.create_map(F.lit("@id"), F.col("target"))),
        "doc:rowIndex": F.col("row_index"), "doc:columnIndex": F.col("col_index"), "doc:rowHeader": F.col("row_header"), "doc:columnHeader": F.col("column_header"), "doc:cellValue": F.col("value"),
        "doc:link": F.when(F.size("links") > 0, F.col("links")), "po:contains": F.when(F.size("contains") > 0, F.col("contains")),
    }
    each = nodes.join(kids, ["doc_id", "n"], "left").select("doc_id", "n", F.to_json(F.struct(*[v.alias(k) for k, v in named.items()])).alias("j"))
    graph = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "j"))), lambda x: x["j"]), ",")
    return each.groupBy("doc_id").agg(F.concat(F.lit(f'{{"@context":{CONTEXT},"@graph":['), graph, F.lit("]}")).alias("text"))
