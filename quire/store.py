"""Tables written in the folder that all executors share, so that long plans are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; only where that is unset and Spark is local a folder of our own is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder; the table goes when the application ends."""
    sc = df.sparkSession.sparkContext
    path = f"{shared_folder(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, each: int = 1 << 20) -> int | None:
    """Partitions for a shuffle of what is made of large files, one for so many bytes of them, so that what a
    task sorts doesn't grow with the input; None where the session's own number will do or the size isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = min(sum(s for s in sizes if s < 1 << 60) // each, 1 << 16)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) else None
