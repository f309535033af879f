"""Pages of candidates by a cursor (S5, O10): the next page begins after the last id, and only the files' parts that hold it are read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.operators.search import candidates
from prismlake.plans.query import Filters

#: Rows between two marks.
STEP = 4096
#: Bytes of a row group: what is skipped or read as a whole.
GROUP_BYTES = 8 << 20


class Pages:
    """A library in files sorted by id, with every ``step``-th id of them as a mark.

    A page reads from the cursor to a mark far enough ahead, which the files' statistics turn into row groups. Where
    filters leave too few rows before it, the reach doubles, so that a page reads at most about twice what it needs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.rows, self.marks = spark.read.parquet(f"{path}/rows"), spark.read.schema("mediaId long").parquet(f"{path}/marks")

    @classmethod
    def saved(cls, media: DataFrame, path: str, step: int = STEP) -> Pages:
        """Writes the library; one exchange by range here, none for pages."""
        sorted_rows = media.repartitionByRange("mediaId").sortWithinPartitions("mediaId")
        sorted_rows.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/rows")

        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = 0
            for batch in batches:
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(range(-seen % step, len(ids), step), pa.int64()))], ["mediaId"])
                seen += len(ids)

        rows = media.sparkSession.read.parquet(f"{path}/rows").select(F.col("mediaId").cast("long"))
        rows.mapInArrow(every, "mediaId long").coalesce(1).write.parquet(f"{path}/marks")
        return cls(media.sparkSession, path)

    def _reach(self, cursor: int | None, marks: int) -> int | None:
        """The ``marks``-th mark after the cursor, None if there are fewer."""
        ahead = self.marks if cursor is None else self.marks.where(F.col("mediaId") > cursor)
        found = ahead.orderBy("mediaId").limit(marks).collect()  # a few marks
        return found[-1][0] if len(found) == marks else None

    def after(self, cursor: int | None, filters: Filters, limit: int, step: int = STEP) -> DataFrame:
        """The first ``limit`` candidates after the cursor, in id order."""
        marks = 2 + limit // step
        while True:
            end = self._reach(cursor, marks)
            rows = self.rows
            if cursor is not None:
                rows = rows.where(F.col("mediaId") > cursor)
            if end is not None:
                rows = rows.where(F.col("mediaId") <= end)
            rows = candidates(rows, filters)
            if end is None or rows.limit(limit).count() == limit:
                return rows.orderBy("mediaId").limit(limit)
            marks *= 2

    def each(self, filters: Filters, limit: int) -> Iterator[list]:
        """Page after page, each of ``limit`` rows."""
        cursor = None
        while True:
            page = self.after(cursor, filters, limit).collect()  # `limit` rows
            if page:
                yield page
            if len(page) < limit:
                return
            cursor = page[-1]["mediaId"]
