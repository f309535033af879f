"""Tables dealt into the same buckets by photo, so that joins by photo and lookups need no exchange.

These are Spark's own bucketed tables: a file for each bucket, sorted by the key. Two of them with one number of buckets
are joined bucket by bucket where they lie, and a lookup of some keys opens only their buckets. Files are in a folder of
their own; a session that doesn't know the table yet gets it by ``attach``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "mediaId"
BUCKETS = 64


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def save(df: DataFrame, name: str, path: str, buckets: int = BUCKETS, key: str = KEY) -> DataFrame:
    """Writes ``df`` to ``path`` in buckets and returns the table; one exchange, here, instead of one for each join."""
    rows = df.repartition(buckets, key)
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(quoted(name))
    return df.sparkSession.table(quoted(name))


def attach(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS, key: str = KEY) -> DataFrame:
    """The table at ``path``, as ``save`` wrote it with this number of buckets, in a session that doesn't know it."""
    schema = spark.read.parquet(path).schema
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted(name)} ({columns}) USING parquet CLUSTERED BY ({quoted(key)}) SORTED BY ({quoted(key)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(quoted(name))


def beside(left: DataFrame, right: DataFrame, how: str, key: str = KEY) -> DataFrame:
    """A join of co-located tables by their key alone. It merges buckets: broadcasting a side, however small, would move
    what need not be moved. Compare other columns, such as revisions, in what is selected from it: a further join key
    would no longer fit the buckets."""
    return left.join(right.hint("merge"), left[key] == right[key], how)


def lookup(table: DataFrame, values: Sequence, key: str = KEY) -> DataFrame:
    """Rows by key; only the keys' buckets are opened."""
    return table.where(F.col(key).isin(list(values)))
