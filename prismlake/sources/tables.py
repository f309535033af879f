"""Tables that change together: changed parts of a version are written beside the old ones and then published as a whole."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

KEY = "mediaId"


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under ``spark.checkpoint.dir``; a local one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='prismlake-')}"
    return f"{folder.rstrip('/')}/prismlake-{uuid.uuid4().hex}"


class Store:
    """Named tables in parts ``path/table/version/bucket=b``; ``path/published`` says which parts make each complete version.

    Tables with a photo id are dealt into buckets by a hash of it, so that a change rewrites only the buckets it
    touches; other tables have one bucket. A reader sees the parts of one version, whatever is being written. A
    writer that fails leaves no published version. Parts that none of the last ``keep`` versions has are removed. One
    writer at a time is assumed, as in any index that one job maintains.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, keep

    def _published(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version long, parts string, streams string").parquet(f"{self.path}/published")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def version(self) -> int:
        published = self._published()
        return published.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] if published is not None else 0

    def _parts(self, version: int) -> dict[str, dict]:
        """By table, its schema and the version of each bucket that has rows: a row of at most tables x buckets entries."""
        if not version:
            return {}
        row = self._published().where(F.col("version") == version).first()
        if row is None:
            raise ValueError(f"version {version} isn't published")
        return json.loads(row["parts"])

    def applied(self, stream: str) -> int:
        """The last batch of a stream that the newest version has, -1 if none."""
        version = self.version()
        return self._streams(version).get(stream, -1)

    def _streams(self, version: int) -> dict[str, int]:
        row = self._published().where(F.col("version") == version).first() if version else None
        return json.loads(row["streams"] or "{}") if row else {}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(KEY), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of the newest or another version; of some buckets only, if they are given."""
        part = self._parts(self.version() if version is None else version)[name]
        schema = T.StructType.fromJson(part["schema"])
        some = None if buckets is None else {str(b) for b in buckets}
        folders = [f"{self.path}/{name}/{v}/bucket={b}" for b, v in part["buckets"].items() if some is None or b in some]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def publish(self, tables: dict[str, DataFrame], buckets: Iterable[int] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Writes the tables (where they have photos, the given buckets of them), each part sorted by photo so that files
        prune by id, and then the version. Buckets that are not given, and other tables, stay as they are.
        ``batch`` is the stream and the number of its batch that this version has, for ``applied``."""
        before = self.version()
        version, parts = before + 1, self._parts(before)
        for name, df in tables.items():
            dealt, folder = KEY in df.columns, f"{self.path}/{name}/{version}"
            rows = df.withColumn("bucket", self.bucket() if dealt else F.lit(0))
            if dealt and buckets is not None:
                rows = rows.where(F.col("bucket").isin(list(buckets)))
            # by word where there are words (postings), else by photo
            rows = rows.repartition("bucket").sortWithinPartitions("bucket", "word" if "word" in df.columns else KEY) if dealt else rows
            rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)
            stay = {} if buckets is None or not dealt else {b: v for b, v in parts.get(name, {"buckets": {}})["buckets"].items() if int(b) not in set(buckets)}
            parts[name] = {"schema": json.loads(df.schema.json()), "buckets": stay | {b: version for b in self._folders(folder, "bucket=")}}
        streams = self._streams(before) | ({batch[0]: batch[1]} if batch else {})
        row = self.spark.createDataFrame([(version, json.dumps(parts), json.dumps(streams))], "version long, parts string, streams string")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        self._drop_old(version)
        return version

    def _folders(self, path: str, prefix: str = "") -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()] if files.exists(at) else []
        return [n.removeprefix(prefix) for n in names if n.startswith(prefix)]

    def _drop_old(self, version: int) -> None:
        known = [self._parts(v) for v in range(max(1, version - self.keep + 1), version + 1)]
        for name in known[-1]:
            held = {v for parts in known for v in parts.get(name, {"buckets": {}})["buckets"].values()}
            for old in self._folders(f"{self.path}/{name}"):
                if old.isdigit() and int(old) not in held and int(old) < version:
                    at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{old}")
                    at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
