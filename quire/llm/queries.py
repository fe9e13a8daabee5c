"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import fingerprints, licenses, linededup, mixing, neardup, neighbours, packing, pii, quality, toxicity
from quire.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.selectExpr("doc_id", "source AS host", "lang AS path", "_evidence AS evidence", "_path_mean AS path_mean", "_score AS score", "_keep AS keep")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.selectExpr("doc_id", "_lines AS n_lines", "_removed AS n_removed", "text")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_vocabulary())


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality, op2_neardup, op3_neighbours, op4_license_scan, op5_packing, op6_mixing, op7_pii, op8_toxicity, op9_line_dedup, op10_fingerprint)}


def oracle_sql() -> dict[str, str]:
    return {"op2_neardup": neardup.NEAR_SQL, "op6_mixing": mixing.MIX_SQL, "op9_line_dedup": linededup.LINES_SQL}
