"""Reading a photo library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismlake.operators.albums import scan_order
from prismlake.schemas import MEDIA_ITEM, conform

URI = "content://media/external/images/media/"


def from_rows(rows: DataFrame) -> DataFrame:
    """Library rows from whatever columns a source has; only ``_id`` must be there, pending rows are left out."""
    if "_id" not in rows.columns:
        raise ValueError("mandatory columns are missing: _id")
    if "is_pending" in rows.columns:
        rows = rows.where(F.coalesce("is_pending", F.lit(0)) == 0)
    rows = rows.withColumns({"mediaId": F.col("_id").cast("long"), "uri": F.concat(F.lit(URI), F.col("_id").cast("string")), "mediaType": F.lit("IMAGE")})
    return conform(rows, MEDIA_ITEM, {"dateModified": 0})


def scan(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """A Parquet library. A path that can't be read fails (R6): it is not an empty library.

    Most consumers need no order; ``ordered`` is for listings.
    """
    rows = from_rows(spark.read.parquet(path))
    return rows.orderBy(*scan_order()) if ordered else rows


def images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, modificationTime, length, content of image files; only columns that are used are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def changes(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """S3: new library files as a stream; the files that arrive between two batches come as one."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
