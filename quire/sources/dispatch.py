"""Which reader a file goes to, by its first bytes before its name; pictures as documents of one page; options."""

from __future__ import annotations

import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.office import READERS, image_header


def kind_of(path: Column, content: Column) -> Column:
    """pdf, png, jpeg, tiff, docx, pptx, html, markdown; null for what can't be read.

    First bytes decide for PDF, pictures and packed Office files; else the extension does.
    """
    head = F.hex(F.substring(content, 1, 8))
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    named = F.create_map(*[F.lit(x) for kv in READERS.items() for x in kv])[extension]
    packed = head.startswith("504B0304")
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("89504E47"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(packed & named.isin("docx", "pptx"), named)
        .when(packed | named.isin("docx", "pptx"), None)
        .otherwise(named)
    )


def image_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, images) of pictures: one page each, of as many units as pixels, covered by one image that is taken for text.

    files: doc_id, content.  What isn't a picture is left out.
    """
    sized = files.select("doc_id", image_header(F.col("content")).alias("h")).where("h.format IS NOT NULL")
    pages = sized.select("doc_id", F.lit(0).alias("page"), F.col("h.width").cast("double").alias("width"), F.col("h.height").cast("double").alias("height"))
    images = pages.select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"), F.lit(True).alias("texty"))
    return pages, images


DEFAULTS = {"format": "md", "escalate": False, "scale": 2.0, "max_chars": 1500}


def load_options(project: str = ".", home: str | None = None, name: str = ".quire/options.toml") -> dict:
    """Options of the project's file over the user's over the defaults; unknown names are an error."""
    out = dict(DEFAULTS)
    for folder in (home, project):
        path = Path(folder) / name if folder else None
        if path is not None and path.is_file():
            told = tomllib.loads(path.read_text(encoding="utf-8"))
            unknown = sorted(set(told) - set(DEFAULTS))
            if unknown:
                raise ValueError(f"{path}: unknown option {', '.join(unknown)}")
            out |= told
    return out


READ = "doc_id long, crop string, reading string, error string"


def read_crops(crops: DataFrame, reader) -> DataFrame:
    """doc_id, crop, reading, error: replies of a reader (prompt, picture) -> (text, reason it ended).

    Runs as one map over batches of crops.  A reply that was cut, or any failure of one
    crop, is told in `error` and fails its whole document: its other readings are withheld.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    text, reason = reader(r.prompt, bytes(r.picture) if r.picture is not None else b"")
                    cut = reason is not None and reason.strip() and reason.upper() != "STOP"
                    rows.append((r.doc_id, r.crop, None if cut else text, f"cut: {reason}" if cut else None))
                except Exception as problem:  # noqa: BLE001 - told in the row
                    rows.append((r.doc_id, r.crop, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["doc_id", "crop", "reading", "error"])

    from pyspark.sql import Window

    got = crops.select("doc_id", "crop", "prompt", "picture").mapInPandas(run, READ)
    failed = F.max(F.col("error").isNotNull()).over(Window.partitionBy("doc_id"))
    return got.withColumn("__failed", failed).withColumn("reading", F.when(~F.col("__failed"), F.col("reading"))).drop("__failed")
