"""Fidelity of readings, and arbitration between a reading and one's own table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_refusal, letters, strip_tags, table_shape, values

FURNITURE_LABELS = ("header", "footer", "number", "footnote", "header_image", "footer_image", "aside_text")


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def fabrication(readings: DataFrame, pages: DataFrame) -> DataFrame:
    """reading_id, n_values, n_missing: numbers of a reading that its page doesn't print.

    readings: reading_id, doc_id, text; pages: doc_id, text.  Numbers are compared by
    digits, so separators may differ.  Both sides are exploded and hash-joined; nothing
    is compared pair by pair.
    """
    asked = readings.select("reading_id", "doc_id", F.explode(values(F.col("text"))).alias("v")).select("reading_id", "doc_id", digits(F.col("v")).alias("d"))
    printed = pages.select("doc_id", F.explode(values(F.col("text"))).alias("v")).select("doc_id", digits(F.col("v")).alias("d")).distinct().withColumn("there", F.lit(1))
    met = asked.join(printed, ["doc_id", "d"], "left")
    return met.groupBy("reading_id").agg(F.count("*").alias("n_values"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("n_missing"))


def letter_retention(readings: DataFrame, pages: DataFrame, least: int = 100) -> DataFrame:
    """reading_id, retention: letters of the reading over those of the page, at most 1; null for pages of few letters."""
    r, p = readings.select("reading_id", "doc_id", letters(F.col("text")).alias("a")), pages.select("doc_id", letters(F.col("text")).alias("b"))
    return r.join(p, "doc_id").select("reading_id", F.when(F.col("b") >= least, F.round(F.least(F.lit(1.0), F.col("a") / F.col("b")), 6)).alias("retention"))


def arbitrate(tables: DataFrame) -> DataFrame:
    """Adds `outcome`: keep-* or replace, the first rule that applies.

    tables: n_rows, n_cols, own_values (array of digits), reading (HTML or text, null),
    page_values (array of digits, null if unknown).
    """
    shape = table_shape(F.col("reading"))
    near = F.abs(shape["rows"] - F.col("n_rows")) <= 1
    said = F.transform(values(strip_tags(F.col("reading"))), digits)
    absent = F.size(F.filter(said, lambda v: ~F.array_contains("page_values", v)))
    kept = F.size(F.array_intersect("own_values", said))
    cells = F.transform(F.regexp_extract_all("reading", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dhr]\b|</t)"), F.lit(1)), strip_tags)
    empty = F.size(F.filter(cells, lambda c: c == ""))
    outcome = (
        F.when(F.col("reading").isNull() | (F.trim("reading") == "") | is_refusal(F.col("reading")), "keep-no-reading")
        .when(shape.isNull(), "keep-no-table")
        .when(F.col("page_values").isNotNull() & (absent > 0.03 * F.size(said)), "keep-fabricated")
        .when((F.size("own_values") > 0) & (kept < 0.9 * F.size(F.array_distinct("own_values"))), "keep-lost-values")
        .when(near & (shape["cols"] == F.col("n_cols") - 1), "keep-lost-column")
        .when(near & (shape["cols"] == F.col("n_cols")) & (empty >= 0.2 * F.size(cells)), "keep-mostly-empty")
        .otherwise("replace")
    )
    return tables.withColumn("outcome", outcome)


def blocks_to_text(blocks: DataFrame) -> DataFrame:
    """doc_id, crop, text: a reading's blocks in order, without running lines and refusals; titles get `# `."""
    kept = blocks.where(~F.col("label").isin(*FURNITURE_LABELS) & ~is_refusal(F.col("content")) & (F.trim("content") != ""))
    part = F.when(F.col("label").isin("doc_title", "paragraph_title", "title"), F.concat(F.lit("# "), F.trim("content"))).otherwise(F.trim("content"))
    order = F.coalesce("block_order", F.lit(2**31 - 1))
    joined = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), part.alias("t")))), lambda x: x["t"])
    return kept.groupBy("doc_id", "crop").agg(F.array_join(joined, "\n\n").alias("text"))


def rubric(runs: DataFrame) -> DataFrame:
    """run, tables, n_values, recall, fabricated: totals over the tables that every run returned.

    runs: run, table_id, said (array of digits), truth (array of digits).
    """
    count = runs.select("run").distinct().count()
    shared = runs.groupBy("table_id").agg(F.countDistinct("run").alias("n")).where(F.col("n") == count).select("table_id")
    said, truth = F.array_distinct("said"), F.array_distinct("truth")
    r = runs.join(shared, "table_id").groupBy("run").agg(F.count("*").alias("tables"), F.sum(F.size(said)).alias("n_values"), F.sum(F.size(F.array_intersect(said, truth))).alias("hit"), F.sum(F.size(truth)).alias("true"))
    return r.select("run", "tables", "n_values", F.round(F.col("hit") / F.greatest("true", F.lit(1)), 6).alias("recall"), F.round(1 - F.col("hit") / F.greatest("n_values", F.lit(1)), 6).alias("fabricated"))


def heading_doubts(elements: DataFrame) -> DataFrame:
    """Pages of at least 4 elements of which more than 0.4 are titles."""
    c = elements.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum((F.col("type") == "doco:SectionTitle").cast("int")).alias("titles"))
    return c.where("n >= 4 AND titles > 0.4 * n").select("doc_id", "page", "n", "titles")


def figure_doubts(elements: DataFrame) -> DataFrame:
    """Pages of at least 200 characters of which 0.3 lie in figures."""
    size = F.length("text")
    c = elements.groupBy("doc_id", "page").agg(F.sum(size).alias("chars"), F.sum(F.when(F.col("type") == "doco:Figure", size).otherwise(0)).alias("inside"))
    return c.where("chars >= 200 AND inside >= 0.3 * chars").select("doc_id", "page", "chars", "inside")


def fill_anchors(elements: DataFrame, readings: DataFrame) -> DataFrame:
    """Elements whose text is an anchor `[[VLM...]]` take the reading of that token; one without stays."""
    token = F.regexp_extract("text", r"^\[\[(VLM(?:TAB|NEW)?:[^\]]+)\]\]$", 1)
    r = readings.select(F.col("token").alias("__token"), F.col("text").alias("__text"))
    return elements.withColumn("__asked", token).join(r, F.col("__asked") == F.col("__token"), "left").withColumn("text", F.coalesce("__text", "text")).drop("__asked", "__token", "__text")
