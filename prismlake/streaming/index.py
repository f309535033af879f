"""The index as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismlake.operators import store
from prismlake.sources.tables import Store


def latest_revision(rows: DataFrame, key: str = "mediaId", revision: str = "dateModified") -> DataFrame:
    """R2: the row with the highest revision of each key, on a stream or a table.

    Late rows are told by revision and not by time, so no watermark may drop a key; the state has one row a key.
    """
    rest = [c for c in rows.columns if c != key]
    order = F.struct(revision, *(c for c in rest if c != revision and not rows.schema[c].dataType.typeName().startswith("map")))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *(f"r.{c}" for c in rest))


def live_counts(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Counts that a ``complete`` sink keeps current."""
    return rows.groupBy(*by).count() if by else rows.groupBy().count()


def unique(spark: SparkSession, name: str) -> StreamingQuery | None:
    """The run of that name that is under way; a second request keeps it."""
    return next((q for q in spark.streams.active if q.name == name), None)


def _kept(changes: DataFrame, tables: Store, checkpoint: str, derived: Sequence[store.Derived], progress: Callable[[dict], None] | None, name: str | None, change: Callable[[dict, DataFrame], dict]) -> StreamingQuery:
    """A stream whose batches change tables of a store: ``change`` gives new tables from those that the batch touches.

    What a batch changes is published as one version, which also says which batch it has. So a batch that was published
    and runs again, since its run ended before the checkpoint knew, is left out. Two applications on one checkpoint
    can't both commit a batch; within one, a second run of a name gets the first.
    """
    running = unique(changes.sparkSession, name) if name else None
    if running:
        return running

    def merge(batch: DataFrame, number: int) -> None:
        if tables.applied(checkpoint) >= number:
            return
        batch = batch.persist()  # a micro-batch, read for its buckets and for its rows
        try:
            touched = tables.touched(batch)
            if not touched:
                return
            old = {n: tables.read(n, buckets=touched) for n in ("media_embeddings", *store.CHILDREN)}
            new = change(old, batch)
            for d in derived:
                if d.base in new:
                    new[d.name] = d.followed(tables.read(d.name, buckets=touched), old[d.base], new[d.base])
            version = tables.publish(new, touched, (checkpoint, number))
        finally:
            batch.unpersist()
        if progress:
            progress({"batch": number, "version": version, "buckets": len(touched)})  # R10

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def into_store(
    changes: DataFrame, tables: Store, checkpoint: str, progress: Callable[[dict], None] | None = None, derived: Sequence[store.Derived] = (), name: str | None = None
) -> StreamingQuery:
    """Merges each batch of changed media rows into the store and publishes a version.

    Merging by revision is idempotent. Rows marked in a column ``gone`` delete their photo. Children of photos that are
    gone or whose revision changed go in the same version (D1, D5), and ``derived`` tables follow them (D12). Only
    the buckets that the batch touches are read and written.
    """

    def change(old: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
        stored = old["media_embeddings"]
        incoming = latest_revision(batch.select(*stored.columns, *(c for c in ("gone",) if c in batch.columns)))
        media = store.merge_changes(stored, incoming)
        return {"media_embeddings": media, **store.cascade({n: old[n] for n in store.CHILDREN}, media, stored)}

    return _kept(changes, tables, checkpoint, derived, progress, name, change)


def texts_into_store(
    texts: DataFrame, tables: Store, checkpoint: str, progress: Callable[[dict], None] | None = None, derived: Sequence[store.Derived] = (), name: str | None = None
) -> StreamingQuery:
    """D3 as a stream: texts of photos that are there at their revision replace stored ones, and ``derived`` tables follow."""

    def change(old: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
        return {"photo_text": store.put_text(old["photo_text"], batch, old["media_embeddings"])}

    return _kept(texts, tables, checkpoint, derived, progress, name, change)


class LatestQuery:
    """Of the searches of one user only the newest runs; starting one interrupts the one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, None

    def run(self, plan: Callable[[], DataFrame]) -> list | None:
        """The rows of a plan with a limit, as searches are, or None where a newer search has taken over."""
        mine = f"search-{uuid.uuid4().hex}"
        before, self.tag = self.tag, mine
        if before:
            self.spark.interruptTag(before)
        self.spark.addTag(mine)
        try:
            rows = plan().collect()
        except Exception:
            if self.tag != mine:
                return None
            raise
        finally:
            self.spark.removeTag(mine)
        return rows if self.tag == mine else None
