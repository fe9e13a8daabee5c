"""The scalar functions as temporary SQL functions, so that SQL users have them too.

They are SQL expressions, inlined by the optimizer: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "quire_squeeze(t STRING) RETURNS STRING": r"trim(regexp_replace(t, '\\s+', ' '))",
    "quire_strip_tags(t STRING) RETURNS STRING": r"trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' '), '\\s+', ' '))",
    "quire_signature(t STRING) RETURNS STRING": r"regexp_replace(t, '[0-9]+', '#')",
    "quire_title_key(t STRING) RETURNS STRING": r"lower(regexp_replace(t, '[^\\p{L}\\p{N}]', ''))",
    "quire_letters(t STRING) RETURNS INT": r"length(regexp_replace(t, '[^\\p{L}]', ''))",
    "quire_label(t STRING) RETURNS STRING": r"CASE WHEN length(t) > 100 THEN concat(substring(t, 1, 100), '…') ELSE t END",
    "quire_href(uri STRING, page INT) RETURNS STRING": r"coalesce(uri, concat('#page=', page + 1))",
    "quire_is_numbered_table(t STRING) RETURNS BOOLEAN": r"t RLIKE '(?i)^\\s*table\\s+[0-9]'",
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions in the session; returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.partition("(")[0] for s in FUNCTIONS]
