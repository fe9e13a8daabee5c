"""Operators over tables: one row per grid position, merges, headers, checks and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_numeric_cell, is_value_cell
from quire.schema import TABLE

CELL = ["doc_id", "seq", "row", "col"]


def grid(e: DataFrame) -> DataFrame:
    """doc_id, seq, row, col, value, down, left, header_rows: every position of every table."""
    t = e.where((F.col("type") == TABLE) & F.col("cells").isNotNull()).select("doc_id", "seq", "header_rows", "merged_down", "merged_left", F.size(F.col("cells")[0]).alias("width"), F.posexplode("cells").alias("row", "values"))
    at = F.col("row") * F.col("width") + F.col("col") + 1
    c = t.select("doc_id", "seq", "header_rows", "merged_down", "merged_left", "width", "row", F.posexplode("values").alias("col", "value"))
    flag = lambda f: F.coalesce(F.try_element_at(F.col(f), at), F.lit(False))
    return c.select(*CELL, "value", flag("merged_down").alias("down"), flag("merged_left").alias("left"), "header_rows")


def denormalized(g: DataFrame) -> DataFrame:
    """Merged values repeated down their cells, and gathered to the first of a row's merged cells."""
    column = Window.partitionBy("doc_id", "seq", "col").orderBy("row")
    g = g.withColumn("__run", F.sum((~F.col("down")).cast("int")).over(column))
    run = Window.partitionBy("doc_id", "seq", "col", "__run")
    words = lambda order, w: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.trim("value").alias("v"))).over(w)), lambda x: F.when(x["v"] != "", x["v"])), " ")
    g = g.withColumn("value", F.when(F.count("*").over(run) > 1, words("row", run)).otherwise(F.col("value")))
    line = Window.partitionBy("doc_id", "seq", "row").orderBy("col")
    g = g.withColumn("__aside", F.sum((~F.col("left")).cast("int")).over(line))
    aside = Window.partitionBy("doc_id", "seq", "row", "__aside")
    many = F.count("*").over(aside) > 1
    return g.withColumn("value", F.when(~many, F.col("value")).when(F.col("left"), F.lit("")).otherwise(words("col", aside))).drop("__run", "__aside")


def table_cells(e: DataFrame) -> DataFrame:
    """doc_id, seq, row_index, col_index, value, row_header, column_header: non-empty data cells.

    Rows count from the first data row; a table without a stated header has one header row.
    """
    g = denormalized(grid(e)).withColumn("head", F.coalesce("header_rows", F.lit(1)))
    column = Window.partitionBy("doc_id", "seq", "col")
    line = Window.partitionBy("doc_id", "seq", "row")
    g = g.withColumns({"column_header": F.max(F.when(F.col("row") == F.col("head") - 1, F.trim("value"))).over(column), "row_header": F.max(F.when(F.col("col") == 0, F.trim("value"))).over(line)})
    data = g.where("row >= head AND trim(value) <> ''")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return data.select("doc_id", "seq", (F.col("row") - F.col("head")).alias("row_index"), F.col("col").alias("col_index"), F.trim("value").alias("value"), F.when(F.col("col") > 0, blank("row_header")).alias("row_header"), blank("column_header").alias("column_header"))


def origins(g: DataFrame) -> DataFrame:
    """Cells that start a merged area, with its rowspan and colspan."""
    column = Window.partitionBy("doc_id", "seq", "col").orderBy("row")
    line = Window.partitionBy("doc_id", "seq", "row").orderBy("col")
    g = g.withColumns({"__r": F.sum((~F.col("down")).cast("int")).over(column), "__c": F.sum((~F.col("left")).cast("int")).over(line)})
    g = g.withColumns({"rowspan": F.count("*").over(Window.partitionBy("doc_id", "seq", "col", "__r")), "colspan": F.count("*").over(Window.partitionBy("doc_id", "seq", "row", "__c"))})
    return g.where("NOT down AND NOT left").select(*CELL, "value", "rowspan", "colspan")


def untiled(o: DataFrame, g: DataFrame) -> DataFrame:
    """Positions that the origins' areas don't cover exactly once."""
    covered = o.withColumn("row", F.explode(F.expr("sequence(row, row + CAST(rowspan AS INT) - 1)"))).withColumn("col", F.explode(F.expr("sequence(col, col + CAST(colspan AS INT) - 1)"))).groupBy(*CELL).agg(F.count("*").alias("times"))
    return g.select(*CELL).join(covered, CELL, "left").withColumn("times", F.coalesce("times", F.lit(0))).where("times <> 1")


def header_rows(g: DataFrame) -> DataFrame:
    """doc_id, seq, header_rows: 0 where the first row is blank or numeric like the columns below it.

    A column counts as numeric if more than half of its filled data cells are numbers.
    """
    filled = F.trim("value") != ""
    number = is_numeric_cell(F.trim("value")) & filled
    column = g.groupBy("doc_id", "seq", "col").agg(F.max("row").alias("last"), F.max(F.when(F.col("row") == 0, number)).alias("first_number"), F.max(F.when(F.col("row") == 0, filled)).alias("first_filled"), F.sum(F.when((F.col("row") > 0) & number, 1).otherwise(0)).alias("numbers"), F.sum(F.when((F.col("row") > 0) & filled, 1).otherwise(0)).alias("cells"))
    numeric = (F.col("cells") > 0) & (F.col("numbers") * 2 > F.col("cells"))
    t = column.groupBy("doc_id", "seq").agg(F.max("last").alias("last"), F.sum(numeric.cast("int")).alias("numeric"), F.sum((numeric & F.col("first_number")).cast("int")).alias("both"), F.max("first_filled").alias("filled"))
    return t.select("doc_id", "seq", F.when((F.col("last") < 1) | ~F.col("filled"), 0).when((F.col("numeric") > 0) & (F.col("both") * 2 > F.col("numeric")), 0).otherwise(1).alias("header_rows"))


def crammed_columns(g: DataFrame) -> DataFrame:
    """Columns whose cells hold one value in some rows and three or more in others."""
    digits = is_value_cell(F.col("value"))
    pieces = F.size(F.split(F.trim("value"), r"\s+"))
    filled = F.trim("value") != ""
    c = g.groupBy("doc_id", "seq", "col").agg(F.sum(filled.cast("int")).alias("filled"), F.sum((filled & digits).cast("int")).alias("values"), F.max(filled & digits & (pieces == 1)).alias("single"), F.max(filled & digits & (pieces >= 3)).alias("several"))
    return c.where("filled >= 3 AND values >= 0.6 * filled AND single AND several").select("doc_id", "seq", "col")


def pivoted(cells: DataFrame, width: int) -> DataFrame:
    """One row per table row, columns c0.. of its values; absent cells are empty."""
    return cells.groupBy("doc_id", "seq", "row_index").agg(*[F.coalesce(F.max(F.when(F.col("col_index") == i, F.col("value"))), F.lit("")).alias(f"c{i}") for i in range(width)])
