"""File-drop streaming: new files are read into elements and replace their documents' rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.sources import html, markdown


def stream_elements(spark: SparkSession, source: str, schema: str, content: str, doc_id: str, kind: str = "html") -> DataFrame:
    """Elements of rows that arrive as Parquet files in a folder."""
    arriving = spark.readStream.schema(schema).parquet(source)
    return html.read_html(arriving, content, doc_id, keep_empty=True) if kind == "html" else markdown.read_markdown(arriving, content, doc_id, keep_empty=True)


def write_documents(elements: DataFrame, target: str, checkpoint: str, buckets: int = 64, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends each batch, stamped with its number; `latest` gives each document's newest rows.

    A batch that runs again writes the same partition, so the sink is idempotent.
    """

    def store(batch: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        stamped = batch.withColumn("batch", F.lit(number))
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
        if then:
            then(batch, number)

    return elements.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The rows of each document's newest batch; none of one that has become empty."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(target)
    newest = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["doc_id", "batch"]).where("type IS NOT NULL OR error IS NOT NULL")
