"""Outputs: formats by name, notes about unread pages, one file for each document."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import elements as el
from quire.operators.graph import to_jsonld

FORMATS = {"text": ("txt", el.to_text), "md": ("md", el.to_markdown), "xhtml": ("xhtml", el.to_xhtml), "json": ("json", el.to_json), "doco": ("jsonld", to_jsonld)}


def notes(unread: DataFrame) -> DataFrame:
    """doc_id, note: one line about pages that nothing transcribed; documents without such pages have no row.

    unread: doc_id, page (from 0), verdict.
    """
    g = unread.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("page") + 1)).alias("p"), F.array_sort(F.collect_set("verdict")).alias("v"))
    one = F.size("p") == 1
    text = F.concat(F.when(one, "page ").otherwise("pages "), F.array_join(F.transform("p", lambda x: x.cast("string")), ", "), F.when(one, " has").otherwise(" have"), F.lit(" content that no reader transcribed ("), F.array_join("v", ", "), F.lit("); it is missing here."))
    return g.select("doc_id", text.alias("note"))


def with_notes(documents: DataFrame, note: DataFrame) -> DataFrame:
    """Texts with their note before them, as a comment: it isn't text of the document."""
    safe = F.replace(F.col("note"), F.lit("--"), F.lit("- -"))
    joined = documents.join(note, "doc_id", "left")
    return joined.withColumn("text", F.when(F.col("note").isNotNull(), F.concat(F.lit("<!-- "), safe, F.lit(" -->\n"), F.col("text"))).otherwise(F.col("text"))).drop("note")


def render(elements: DataFrame, format: str = "md", note: DataFrame | None = None) -> DataFrame:
    """doc_id, text: elements as text, md, xhtml, json or doco; notes go into the marked-up formats."""
    out = FORMATS[format][1](elements)
    return with_notes(out, note) if note is not None and format in ("md", "xhtml") else out


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def destinations(files: DataFrame, ext: str, path: str = "path") -> DataFrame:
    """Files with `target`: their stem with the new extension; where stems repeat, the old extension stays in the name."""
    name = stem(F.col(path))
    old = F.regexp_extract(F.regexp_extract(F.col(path), r"([^/]+)$", 1), r"(?<=.)\.([^.]*)$", 1)
    twice = F.count("*").over(Window.partitionBy(name)) > 1
    middle = F.when(twice & (old != ""), F.concat(F.lit("."), old)).otherwise(F.lit(""))
    return files.withColumn("target", F.concat(name, middle, F.lit("." + ext)))


def write_documents(documents: DataFrame, folder: str) -> None:
    """One file a row (target, text) in a folder that all executors share; written under another name first, then renamed."""

    def write(rows) -> None:
        home = Path(folder)
        home.mkdir(parents=True, exist_ok=True)
        for r in rows:
            part = home / f".{r['target']}.part"
            part.write_text(r["text"] or "", encoding="utf-8")
            part.rename(home / r["target"])

    documents.select("target", "text").foreachPartition(write)


def write_one(documents: DataFrame, path: str | None) -> str:
    """The one document's text, to a file if a path is given; an error if there are several."""
    rows = documents.select("text").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("one document expected")
    if path is not None:
        Path(path).write_text(rows[0]["text"] or "", encoding="utf-8")
    return rows[0]["text"]


def failures(results: DataFrame) -> DataFrame:
    """Documents that could not be read, with the reason; an empty table means all went well."""
    return results.where("error IS NOT NULL").select("doc_id", "error").distinct()


def exit_status(results: DataFrame) -> int:
    """0 if every document was read, 1 otherwise."""
    return 0 if failures(results).isEmpty() else 1


def part_of(elements: DataFrame, pages: str) -> DataFrame:
    """Elements of a range of pages, with the ids of the whole document: parts merge without clashes."""
    return el.only_pages(elements, pages)
