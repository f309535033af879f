"""Reading tables, cutting lineage and the folder shared by driver and executors."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch between the JVM and a Python worker: whole texts, so far fewer than Spark's 10,000.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_ROWS``, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a fresh local one only where it is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='prismlake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and lost executors lose nothing.

    An empty result keeps its schema, since the schema is given on reading. All tables of an application lie in one
    folder, named after it, which can go when the application has ended.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/prismlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what a Python worker has freed to the system, where its C library and Arrow's pool can: workers are reused, and
    what an earlier stage took would otherwise stay with them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, after whose last batch the worker gives back what it freed: workers that wait for their next
    task, or for none, count in an executor's memory too."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
