"""Session helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import glob
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that may be broadcast, at 64 a row: a checked bound, beyond which the same joins shuffle.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share: `spark.checkpoint.dir` of the session.

    Only where that is unset and Spark is local (tests) a folder of our own is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return sc.getCheckpointDir()


def work_folder(spark: SparkSession) -> str:
    """This application's folder of written tables in the shared folder; it goes when the application ends."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_folder", None) is None:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        sc._quire_folder = path.toString()
    return sc._quire_folder


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the table in the shared folder and reads it again.

    (A checkpoint would compute the last stage twice, once to count and once to write.)
    """
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    # small row groups: what a task holds while it writes
    df.write.option("parquet.block.size", 8 << 20).option("parquet.page.size", 256 << 10).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._quire_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of plans that are done with: its cleaner goes by the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(rows: int | None, items: int | None = 0) -> bool:
    """Whether a table of so many narrow rows, with so many 16-byte items in lists, may be broadcast."""
    return ((rows or 0) * 64 + (items or 0) * 16) <= BROADCAST_BYTES


def sized(df: DataFrame, rows: int | None = None, items: int | None = 0) -> DataFrame:
    """Marks a side for broadcast if it is `small`; else leaves it to shuffle."""
    if rows is None:
        rows = df.limit(BROADCAST_BYTES // 64 + 1).count()
    return F.broadcast(df) if small(rows, items) else df


@lru_cache(maxsize=1)
def one_blas_thread() -> None:
    """Keeps numpy's matrix products on one thread: tasks already fill the cores."""
    for path in glob.glob(str(Path(np.__file__).resolve().parent.parent / "numpy.libs" / "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds Arrow batches by bytes, as texts can be long: workers' memory doesn't depend on them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives a worker's free memory back after each partition, as workers are reused."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return wrapped


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str | None = "text", budget: int = 1 << 19) -> DataFrame:
    """mapInArrow over slices whose texts have about `budget` bytes; longer texts stay whole."""
    from quire.llm.text import slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, budget) if text else batches:
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    bound_batches(df.sparkSession)
    return df.mapInArrow(lean(run), schema)
