"""Scalar functions over text and table cells, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"<[^>]*>", " "))


def shortened(c: Column, size: int = 100) -> Column:
    """A label: at most `size` characters and an ellipsis."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def digits_as_hash(c: Column) -> Column:
    """Signature of running headers: each run of digits is one `#`."""
    return F.regexp_replace(c, "[0-9]+", "#")


def normal_title(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def is_roman(c: Column) -> Column:
    return c.rlike("^[IVXLCDM]{1,5}$")


def numbering_depth(c: Column) -> Column:
    """Depth of a heading's number: `5.` 1, `5.3` 2, `B.1` 2, `IV.` 1, `01 - ` 1; null without one.

    Numbers go to 99 and six levels deep; what follows must begin with a capital letter and
    be no sentence.  A letter or roman number alone needs its dot.
    """
    head = F.regexp_extract(c, r"^([0-9A-Za-z.]+)", 1)
    rest = F.regexp_extract(c, r"(?s)^[0-9A-Za-z.]+[ \t\-–—)]*\s*(.*)$", 1)
    parts = F.filter(F.split(head, r"\."), lambda p: p != "")
    number, name = r"^0*[0-9]{1,2}$", "^(?:[IVXLCDM]{1,5}|[A-Z])$"
    sound = (F.size(parts) >= 1) & (F.size(parts) <= 6) & F.forall(parts, lambda p: p.rlike(number) | p.rlike(name))
    sentence = rest.endswith(".") & (F.size(F.split(F.trim(rest), r"\s+")) >= 4)
    bare_name = (F.size(parts) == 1) & head.rlike("^[A-Z]") & ~head.contains(".")
    return F.when(sound & rest.rlike(r"^\p{Lu}") & ~sentence & ~bare_name, F.size(parts))


def is_title_like(c: Column) -> Column:
    """1 to 12 words, 4 to 200 characters, a letter, no trailing comma, dot leaders or list opener."""
    t = F.trim(c)
    words = F.size(F.split(t, r"\s+"))
    return F.length(t).between(4, 200) & words.between(1, 12) & t.rlike(r"\p{L}") & ~t.rlike(r"[,;]$") & ~t.rlike(r"\.{4,}|(?:\. ){3,}") & ~starts_like_item(t) & ~runs_into_prose(t)


def runs_into_prose(c: Column) -> Column:
    return c.rlike(r"\p{Ll}{2,}[.!?]\s+\p{Lu}")


def is_contents_marker(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("contents", "table of contents", "index", "list of figures", "list of tables")


def starts_like_item(c: Column) -> Column:
    return c.rlike(r"^\s*(?:[•◦▪‣●○■□–*·]|\(?[a-z0-9]{1,2}\))\s")


def is_caption(c: Column) -> Column:
    return c.rlike(r"(?i)^\s*(?:fig(?:ure)?\.?|table|chart|exhibit)\s+[A-Z]?[0-9]+")


def is_float_caption(c: Column) -> Column:
    return c.rlike(r"(?i)^\s*(?:figure|fig\.?|table|chart)\b")


def is_numbered_table_caption(c: Column) -> Column:
    return c.rlike(r"(?i)^\s*table\s+[0-9]")


def without_bullet(c: Column) -> Column:
    """The text after a leading bullet; null without one."""
    found = F.regexp_extract(c, r"^\s*[•◦▪‣●○■□–*·▸►➢]\s*(\S.*)$", 1)
    return F.when(found != "", found)


def is_marker(c: Column) -> Column:
    return F.trim(c).rlike(r"^(?:[•◦▪‣●○■□–*·▸►➢-]|\(?[0-9]{1,3}[.)]?|\(?[ivxIVX]{1,4}[.)]|\(?[A-Za-z][.)])$")


def is_spaceless_script(c: Column) -> Column:
    return c.rlike(r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]")


def is_numeric_cell(c: Column) -> Column:
    """Digits in currency, percent, sign or bracket dress; years 1900 to 2099 aren't numbers."""
    return c.rlike(r"^[0-9$€£¥%,.()\-+ −]+$") & c.rlike("[0-9]") & ~c.rlike("^(?:19|20)[0-9]{2}$")


def is_value_cell(c: Column) -> Column:
    """Digits and no letters."""
    return c.rlike("[0-9]") & ~c.rlike(r"\p{L}")


def values(c: Column) -> Column:
    """Numbers of at least three digits, without trailing separators."""
    found = F.transform(F.regexp_extract_all(c, F.lit("([0-9][0-9,.]*)"), F.lit(1)), lambda v: F.regexp_replace(v, "[,.]+$", ""))
    return F.filter(found, lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")) >= 3)


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def href(uri: Column, page: Column) -> Column:
    return F.coalesce(uri, F.concat(F.lit("#page="), (page + 1).cast("string")))


def escaped(c: Column) -> Column:
    """Text for XHTML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def markdown_cell(c: Column) -> Column:
    return F.translate(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), "\r\n", "  ")


def is_refusal(c: Column) -> Column:
    """Remarks about an image instead of its content."""
    return (F.length(c) < 400) & c.rlike(r"(?i)\b(?:i(?:'m| am) (?:sorry|unable)|i can(?:no|')t|cannot (?:read|see|extract)|no (?:text|table|content) (?:is |was )?(?:visible|found|present)|the image (?:shows|contains|is|appears)|this image)\b")


def table_shape(html: Column) -> Column:
    """struct(rows, cols) of the first table in HTML; null without one."""
    body = F.regexp_extract(html, r"(?is)<table\b.*?(?:</table>|$)", 0)
    rows = F.filter(F.split(body, r"(?i)<tr\b"), lambda r: r.rlike(r"(?i)<t[dh]\b"))
    cols = F.array_max(F.transform(rows, lambda r: F.size(F.split(r, r"(?i)<t[dh]\b")) - 1))
    return F.when(body != "", F.struct(F.size(rows).alias("rows"), F.coalesce(cols, F.lit(0)).alias("cols")))
