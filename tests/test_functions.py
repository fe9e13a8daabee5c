"""Scalar functions on single values."""

from pyspark.sql import functions as F

from quire.functions import sql, text


def test_sql_functions(spark):
    names = sql.register(spark)
    assert len(names) == len(set(names)) == 8
    row = spark.sql("SELECT quire_squeeze(' a \n b '), quire_strip_tags('<b>x</b>y'), quire_signature('Page 12 of 30'), quire_title_key('1. Ab-c'), quire_letters('a1 b'), quire_href(NULL, 2), quire_href('u', 2), quire_is_numbered_table(' Table 4'), length(quire_label(repeat('x', 150)))").first()
    assert list(row) == ["a b", "x y", "Page # of #", "1abc", 2, "#page=3", "u", True, 101]


def test_predicates(spark):
    def one(f, value):
        return spark.range(1).select(f(F.lit(value)).alias("x")).first()["x"]

    assert [one(text.numbering_depth, t) for t in ("5. The", "5.3 The", "B.1 The", "IV. The", "A word", "plain")] == [1, 2, 2, 1, None, None]
    assert [one(text.is_numeric_cell, t) for t in ("$1,200", "(3.5)", "1999", "abc", "12%")] == [True, True, False, False, True]
    assert one(text.values, "1,234. 56 7890,") == ["1,234", "7890"]
    assert one(text.is_title_like, "The Long Title") and not one(text.is_title_like, "a sentence, and more,")
    assert one(text.without_bullet, "• item") == "item" and one(text.without_bullet, "item") is None
    assert one(text.is_refusal, "I cannot read this") and not one(text.is_refusal, "Total 5")
    assert tuple(one(text.table_shape, "<table><tr><td>a<td>b</tr><tr><td>c</tr></table>")) == (2, 2)
    assert one(text.table_shape, "no table") is None
