"""Operators over the element table: projection and offsets, sections and lists, chunks,
spans, links, and writers.  All work per document, by windows over `doc_id`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import escaped, href, markdown_cell, shortened, strip_tags
from quire.schema import FIGURE, ITEM, PARAGRAPH, TABLE, TITLE



def reading_order() -> "Window":
    return Window.partitionBy("doc_id").orderBy("seq")


def all_before() -> "Window":
    return reading_order().rowsBetween(Window.unboundedPreceding, -1)


def table_text(cells: Column) -> Column:
    """Rows of trimmed cells joined by tabs, trailing blanks of rows dropped."""
    rows = F.transform(cells, lambda r: F.regexp_replace(F.array_join(F.transform(r, lambda c: F.trim(c)), "\t"), r"\s+$", ""))
    return F.regexp_replace(F.array_join(rows, "\n"), r"^\s+|\s+$", "")


def projection_text(e: DataFrame) -> DataFrame:
    """Adds `projected`: what each element contributes to the document's plain text."""
    plain = F.trim("text")
    return e.withColumn("projected", F.when((F.col("type") == TABLE) & F.col("cells").isNotNull(), table_text(F.col("cells"))).when(F.col("type") == TABLE, strip_tags(F.col("text"))).otherwise(plain))


def offsets(e: DataFrame) -> DataFrame:
    """Adds `projected`, `begin` and `end`: places in the projection; an empty element takes none."""
    p = projection_text(e)
    step = F.when(F.length("projected") > 0, F.length("projected") + 2).otherwise(0)
    begin = F.coalesce(F.sum(step).over(all_before()), F.lit(0)).cast("long")
    return p.withColumn("begin", F.when(F.length("projected") > 0, begin)).withColumn("end", F.col("begin") + F.length("projected"))


def to_text(e: DataFrame) -> DataFrame:
    """doc_id, text: projections of the elements, a blank line between, a line feed at the end."""
    p = projection_text(e).where("projected <> ''")
    return p.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "projected"))), lambda x: x["projected"]), "\n\n"), F.lit("\n")).alias("text"))


def section_parents(e: DataFrame) -> DataFrame:
    """Adds `level` of titles (1 to 6) and `section`: the seq of the innermost open title, null at the root.

    A title closes all open sections of its level or deeper.
    """
    level = F.when(F.col("type") == TITLE, F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1)))))
    own = e.withColumn("level", level)
    rank = F.coalesce(F.col("level"), F.lit(7))
    # nearest title before of a lower level, found among the last titles of each level that no
    # shallower title has closed since: the largest seq of them all
    last = {k: F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(all_before()) for k in range(1, 7)}
    named = own.withColumns({f"__s{k}": c for k, c in last.items()})
    parent = F.greatest(*[F.when(rank > k, F.col(f"__s{k}")) for k in range(1, 7)], F.lit(None).cast("int"))
    return named.withColumn("section", parent).drop(*[f"__s{k}" for k in range(1, 7)])


def list_runs(e: DataFrame) -> DataFrame:
    """List items with `list`: the number, from 1, of their run of neighbouring items."""
    start = (F.col("type") == ITEM) & (F.coalesce(F.lag("type").over(reading_order()), F.lit("")) != ITEM)
    return e.withColumn("list", F.sum(start.cast("int")).over(reading_order())).where(F.col("type") == ITEM)


def section_paths(e: DataFrame) -> DataFrame:
    """Titles with `path`: the chain of titles that hold them, themselves last.

    Levels are at most 6 deep, so five self-joins on the parent suffice, expressed as one
    window per level.
    """
    s = section_parents(e).where(F.col("type") == TITLE)
    # the open titles at a title: per level the last one, unless closed by a shallower one since
    w = reading_order().rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct("seq", "text")), ignorenulls=True).over(w) for k in range(1, 7)]
    named = s.withColumns({f"__t{k}": c for k, c in enumerate(last, 1)})
    open_ = []
    for k in range(1, 7):
        shallower = [F.col(f"__t{j}.seq") for j in range(1, k)]
        alive = F.col(f"__t{k}.seq") > F.coalesce(F.greatest(*shallower, F.lit(0), F.lit(0)), F.lit(0)) if shallower else F.lit(True)
        open_.append(F.when(alive & (F.col("level") >= k), F.col(f"__t{k}.text")))
    return named.withColumn("path", F.array_compact(F.array(*open_))).drop(*[f"__t{k}" for k in range(1, 7)])


CHUNK = "doc_id long, chunk int, path array<string>, text string, first_seq int, last_seq int, pages array<int>"


def chunks(e: DataFrame, max_chars: int = 1500) -> DataFrame:
    """Structure-aware chunks with their heading path.

    A title closes the chunk and takes its place in the positional path; other elements
    are appended, and the chunk closes once its texts reach `max_chars`.  An ordered
    fold, so it runs as one pass over documents that are already together.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        path: list[str] = []
        body: list = []
        size = 0

        def close() -> None:
            nonlocal size
            size = 0
            if body:
                out.append((key[0], len(out) + 1, list(path), "\n\n".join(r.text for r in body), body[0].seq, body[-1].seq, sorted({r.page for r in body})))
                body.clear()

        for r in rows.sort_values("seq").itertuples():
            if r.type == TITLE:
                close()
                path[(int(r.level) if r.level == r.level and r.level else 1) - 1 :] = [r.text]
            else:
                body.append(r)
                size += len(r.text)
                if size >= max_chars:
                    close()
        close()
        return pd.DataFrame(out, columns=[f.split()[0] for f in CHUNK.split(", ")])

    return e.where(F.col("type").isNotNull()).select("doc_id", "seq", "type", "level", "text", "page").groupBy("doc_id").applyInPandas(run, CHUNK)


def span_hits(e: DataFrame, pattern: str) -> DataFrame:
    """doc_id, seq, hit, begin, end: every place of a pattern in the projection, with its element.

    Patterns are sought within elements, so a hit's element needs no interval join.
    """

    @F.pandas_udf("array<struct<hit:string,at:int>>")
    def find(texts: pd.Series) -> pd.Series:
        import re

        sought = re.compile(pattern)
        return texts.map(lambda t: [{"hit": m.group(), "at": m.start()} for m in sought.finditer(t or "")])

    p = offsets(e).where("begin IS NOT NULL")
    found = p.select("doc_id", "seq", "begin", F.explode(find("projected")).alias("h"))
    return found.select("doc_id", "seq", F.col("h.hit").alias("hit"), (F.col("begin") + F.col("h.at")).alias("begin"), (F.col("begin") + F.col("h.at") + F.length("h.hit")).alias("end"))


def elements_at(e: DataFrame, places: DataFrame) -> DataFrame:
    """places (doc_id, offset) with the element that holds each, and the place in it.

    An as-of join by union: element starts and places are ordered together within a
    document, so no range condition is evaluated for all pairs.
    """
    p = offsets(e).where("begin IS NOT NULL")
    starts = p.select("doc_id", F.col("begin").alias("offset"), F.lit(0).alias("kind"), "seq", "begin", "end")
    asked = places.select("doc_id", F.col("offset").cast("long"), F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    w = Window.partitionBy("doc_id").orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct("seq", "begin", "end")), ignorenulls=True).over(w)
    both = starts.union(asked).withColumn("e", last).where("kind = 1")
    inside = F.col("offset") < F.col("e.end")
    return both.select("doc_id", "offset", F.when(inside, F.col("e.seq")).alias("seq"), F.when(inside, F.col("offset") - F.col("e.begin")).alias("place"))


def only_pages(e: DataFrame, spec: str) -> DataFrame:
    """Elements of pages such as `1-5,12`, counted from 1; ids stay as they were."""
    keep = F.lit(False)
    for part in spec.split(","):
        first, _, last = part.strip().partition("-")
        keep = keep | F.col("page").between(int(first) - 1, int(last or first) - 1)
    return e.where(keep)


# ---- writers -----------------------------------------------------------------------------


def _joined(e: DataFrame, part: Column, gap: str, end: str = "") -> DataFrame:
    pieces = e.withColumn("__part", part).where("__part <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "__part"))).alias("p"))
    return pieces.select("doc_id", F.concat(F.array_join(F.transform("p", lambda x: x["__part"]), gap), F.lit(end)).alias("text"))


def linked(text: Column, links: Column, dress, plain) -> Column:
    """Text with its links dressed: `dress(label, link)`; other stretches go through `plain`."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, link: Column) -> Column:
        between = F.substr(text, acc["at"] + 1, link["begin"] - acc["at"])
        label = F.substr(text, link["begin"] + 1, link["end"] - link["begin"])
        return F.struct(F.concat(acc["out"], plain(between), dress(label, link)).alias("out"), link["end"].alias("at"))

    placed = F.filter(links, lambda x: x["begin"].isNotNull())
    folded = F.aggregate(placed, start, step, lambda acc: F.concat(acc["out"], plain(F.substr(text, acc["at"] + 1, F.length(text)))))
    return F.when(F.coalesce(F.size(placed), F.lit(0)) > 0, folded).otherwise(plain(text))


def to_markdown(e: DataFrame) -> DataFrame:
    """doc_id, text: headings, items, pipe tables (the separator after the first row) and links."""
    words = linked(F.col("text"), F.col("links"), lambda label, x: F.concat(F.lit("["), F.replace(F.replace(label, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]")), F.lit("]("), F.when(x["uri"].rlike(r"[\s()]"), F.concat(F.lit("<"), x["uri"], F.lit(">"))).otherwise(x["uri"]), F.lit(")")), lambda t: t)
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, markdown_cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.col("cells")[0])))
    rows = F.transform("cells", row)
    grid = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))), "\n")
    part = F.when(F.col("type") == TITLE, F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))), F.lit(" "), words)).when(F.col("type") == ITEM, F.concat(F.lit("- "), words)).when((F.col("type") == TABLE) & (F.size("cells") > 0), grid).otherwise(words)
    return _joined(e, part, "\n\n", "\n")


def to_xhtml(e: DataFrame) -> DataFrame:
    """doc_id, text: headings, lists opened and closed at the ends of their runs, tables with spans, figures."""
    words = linked(F.col("text"), F.col("links"), lambda label, x: F.concat(F.lit('<a href="'), escaped(x["uri"]), F.lit('">'), escaped(label), F.lit("</a>")), escaped)
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1)))).cast("string")
    near = e.withColumns({"__before": F.coalesce(F.lag("type").over(reading_order()), F.lit("")), "__after": F.coalesce(F.lead("type").over(reading_order()), F.lit(""))})
    item = F.concat(F.when(F.col("__before") != ITEM, F.lit("<ul>\n")).otherwise(F.lit("")), F.lit("<li>"), words, F.lit("</li>"), F.when(F.col("__after") != ITEM, F.lit("\n</ul>")).otherwise(F.lit("")))
    unsure = F.when(F.col("evidence").isin("font-size", "bold"), F.lit(' class="uncertain"')).otherwise(F.lit(""))
    part = F.when(F.col("type") == TITLE, F.concat(F.lit("<h"), level, unsure, F.lit(">"), words, F.lit("</h"), level, F.lit(">"))).when(F.col("type") == ITEM, item).when((F.col("type") == TABLE) & (F.size("cells") > 0), _table_markup()).when(F.col("type") == FIGURE, F.concat(F.lit("<figure>"), words, F.lit("</figure>"))).otherwise(F.concat(F.lit("<p>"), words, F.lit("</p>")))
    return _joined(near, part, "\n", "\n")


def _table_markup() -> Column:
    """Origin cells with their spans; cells that continue another are left out."""

    @F.pandas_udf("string")
    def markup(cells: pd.Series, header: pd.Series, down: pd.Series, left: pd.Series) -> pd.Series:
        from html import escape

        def one(rows, head, below, beside) -> str | None:
            if rows is None:
                return None
            n, w = len(rows), max((len(r) for r in rows), default=0)
            flag = lambda f, r, c: f is not None and r * w + c < len(f) and bool(f[r * w + c])
            out = ["<table>"]
            for r in range(n):
                line = []
                for c in range(len(rows[r])):
                    if flag(below, r, c) or flag(beside, r, c):
                        continue
                    across, deep = 1, 1
                    while c + across < w and flag(beside, r, c + across):
                        across += 1
                    while r + deep < n and flag(below, r + deep, c):
                        deep += 1
                    tag = "th" if head == head and head is not None and r < head else "td"
                    spans = (f' colspan="{across}"' if across > 1 else "") + (f' rowspan="{deep}"' if deep > 1 else "")
                    line.append(f"<{tag}{spans}>{escape(rows[r][c])}</{tag}>")
                out.append(f"<tr>{''.join(line)}</tr>")
            out.append("</table>")
            return "\n".join(out)

        return pd.Series([one(*x) for x in zip(cells, header, down, left)])

    return markup("cells", "header_rows", "merged_down", "merged_left")


def to_json(e: DataFrame) -> DataFrame:
    """doc_id, text: the elements as a JSON array; absent fields are left out."""
    fields = [c for c in e.columns if c not in ("doc_id", "error")]
    each = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(F.struct(*[c for c in fields if c != "seq"])).alias("j")))), lambda x: x["j"])
    return e.where(F.col("type").isNotNull()).groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")).alias("text"))


def graph_nodes(e: DataFrame, base: str = "urn:doc") -> DataFrame:
    """doc_id, n, iri, type, label, parent_n, seq: nodes of the document graph in order of creation.

    Document, body, then per element: a title opens a section, an item at the start of a
    run opens a list.  `n` is the shared counter, from 0; `parent_n` contains the node.
    """
    s = section_parents(e).withColumn("__first", (F.col("type") == ITEM) & (F.coalesce(F.lag("type").over(reading_order()), F.lit("")) != ITEM))
    opens = F.when(F.col("type") == TITLE, F.lit("doco:Section")).when(F.col("__first"), F.lit("doco:List"))
    parts = F.array_compact(F.array(F.when(opens.isNotNull(), F.struct(F.lit(0).alias("k"), opens.alias("kind"))), F.struct(F.lit(1).alias("k"), F.col("type").alias("kind"))))
    rows = s.select("doc_id", "seq", "type", "text", "section", F.explode(parts).alias("p")).select("doc_id", "seq", "type", "text", "section", "p.k", F.col("p.kind").alias("kind"))
    w = Window.partitionBy("doc_id").orderBy("seq", "k")
    numbered = rows.withColumn("n", F.row_number().over(w) + 1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn("list_n", F.last(F.when(F.col("kind") == "doco:List", F.col("n")), ignorenulls=True).over(upto))
    sections = numbered.where("kind = 'doco:Section'").select(F.col("doc_id").alias("d"), F.col("seq").alias("s"), F.col("n").alias("section_n"))
    joined = numbered.join(sections, (F.col("doc_id") == F.col("d")) & (F.when((F.col("kind") == TITLE), F.col("seq")).otherwise(F.col("section")) == F.col("s")), "left")
    parent = F.when((F.col("kind") == ITEM), F.col("list_n")).otherwise(F.coalesce("section_n", F.lit(1)))
    body = joined.select("doc_id", "n", F.col("kind").alias("type"), F.when(F.col("kind").isin("doco:Section", "doco:List"), F.lit(None)).otherwise(shortened(F.col("text"))).alias("label"), parent.alias("parent_n"), "seq")
    none = F.lit(None)
    roots = e.where(F.col("type").isNotNull()).select("doc_id").distinct().select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("doco:Document").alias("t"), none.cast("int").alias("p")), F.struct(F.lit(1).alias("n"), F.lit("doco:BodyMatter").alias("t"), F.lit(0).alias("p")))).alias("r"))
    top = roots.select("doc_id", F.col("r.n").alias("n"), F.col("r.t").alias("type"), none.cast("string").alias("label"), F.col("r.p").alias("parent_n"), none.cast("int").alias("seq"))
    segment = F.when(F.col("type") == "doco:Section", F.lit("section")).otherwise(F.lit("element"))
    return top.union(body).withColumn("iri", F.concat(F.lit(base + "/"), F.col("doc_id").cast("string"), F.lit("/"), segment, F.lit("/"), F.col("n").cast("string")))


def evidence_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("type", "provenance", "evidence").agg(F.count("*").alias("n"))


def replace_documents(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Retract then insert: rows of documents that `new` holds are replaced by its own.

    Rows of `new` without a type only retract: the document has become empty.
    """
    own = new.where("type IS NOT NULL") if "type" in new.columns else new
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(own, allowMissingColumns=True)
