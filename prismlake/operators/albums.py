"""Albums and the library's order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions.scalars import recent_cutoff
from prismlake.operators.store import Derived

ALL, RECENT = "all", "recent"


def scan_order() -> list[Column]:
    """O8, S1; the id makes the order total."""
    return [F.col("dateTaken").desc_nulls_last(), F.col("dateAdded").desc_nulls_last(), F.col("mediaId").desc()]


def scan_place() -> Column:
    """A struct whose least value is the first row of the scan, so that a first row is an aggregate and no sort."""
    return F.struct(
        F.col("dateTaken").isNull().alias("a"), (-F.col("dateTaken")).alias("b"), F.col("dateAdded").isNull().alias("c"),
        (-F.col("dateAdded")).alias("d"), (-F.col("mediaId")).alias("e"),
    )


def recently_added(photos: DataFrame, now_millis: int) -> DataFrame:
    """Not ordered; ``recent_order`` orders."""
    return photos.where(F.coalesce("dateAdded", F.lit(0)) >= recent_cutoff(now_millis))


def recent_order() -> list[Column]:
    """O6."""
    return [F.coalesce("dateAdded", F.lit(0)).desc(), F.desc("mediaId")]


def photos_for(album: str, photos: DataFrame, now_millis: int) -> DataFrame:
    """P10: an album's photos in their order."""
    if album == ALL:
        return photos.orderBy(*scan_order())
    if album == RECENT:
        return recently_added(photos, now_millis).orderBy(*recent_order())
    return photos.where(F.col("bucketId") == album).orderBy(*scan_order())


def system_albums(photos: DataFrame, now_millis: int) -> DataFrame:
    """A5: one pass over the library; an empty library has none, and no recent photos no second one."""
    recent = F.coalesce("dateAdded", F.lit(0)) >= recent_cutoff(now_millis)
    place = scan_place()
    # the recent album's cover is the first of those added last
    newest = F.struct((-F.coalesce("dateAdded", F.lit(0))).alias("added"), place.alias("place"))
    totals = photos.agg(
        F.count("*").alias("n_all"), F.min_by("uri", place).alias("uri_all"), F.count_if(recent).alias("n_recent"), F.min_by(F.when(recent, F.col("uri")), F.when(recent, newest)).alias("uri_recent")
    )

    def album(rank: int, key: str, name: str) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(key).alias("id"), F.lit(name).alias("name"), F.col(f"n_{key}").alias("count"), F.col(f"uri_{key}").alias("coverUri"), F.lit(True).alias("isSystemCollection"))

    rows = totals.select(F.explode(F.array(album(0, ALL, "All Photos"), album(1, RECENT, "Recently Added"))).alias("a")).select("a.*")
    return rows.where("count > 0")


def bucket_albums(photos: DataFrame) -> DataFrame:
    """An album for each bucket id and name; ``first`` orders equal sizes by first appearance."""
    named = photos.where(F.col("bucketId").isNotNull() & F.coalesce(F.col("bucketName").rlike(r"\S"), F.lit(False)))
    place = scan_place()
    return named.groupBy(F.col("bucketId").alias("id"), F.col("bucketName").alias("name")).agg(
        F.count("*").alias("count"), F.min_by("uri", place).alias("coverUri"), F.min(place).alias("first")
    ).withColumn("isSystemCollection", F.lit(False))


def build(photos: DataFrame, now_millis: int) -> DataFrame:
    """System albums, then buckets by size; of one id the first stays."""
    return _catalog(system_albums(photos, now_millis), bucket_albums(photos))


def _catalog(system: DataFrame, buckets: DataFrame) -> DataFrame:
    columns = ["id", "name", "count", "coverUri", "isSystemCollection"]
    nothing = F.lit(None)
    system = system.select(*columns, F.col("rank"), nothing.cast(buckets.schema["first"].dataType).alias("first"))
    both = system.unionByName(buckets.select(*columns, F.lit(2).alias("rank"), "first"))
    order = [F.asc("rank"), F.when(F.col("rank") == 2, -F.col("count")).asc(), F.asc("first"), F.asc("name")]
    kept = both.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_n = 1")
    return kept.orderBy(*order).select(*columns)


def album_parts(photos: DataFrame, bucket: Column) -> DataFrame:
    """What each bucket of a store adds to each album, and to all photos (``whole``): its number of photos, its first place and
    the cover there. ``mediaId`` is the cover's, which puts the row into the bucket it is made of."""
    place = scan_place()
    named = F.col("bucketId").isNotNull() & F.coalesce(F.col("bucketName").rlike(r"\S"), F.lit(False))
    nobody = F.lit(None).cast("string")
    keys = F.array(F.struct(F.lit(True).alias("whole"), nobody.alias("id"), nobody.alias("name")), F.when(named, F.struct(F.lit(False).alias("whole"), F.col("bucketId").alias("id"), F.col("bucketName").alias("name"))))
    rows = photos.select(bucket.alias("_bucket"), F.explode(keys).alias("k"), place.alias("place"), F.struct("mediaId", "uri").alias("cover")).where("k is not null")
    found = rows.groupBy("_bucket", "k.whole", "k.id", "k.name").agg(F.count("*").alias("count"), F.min_by("cover", "place").alias("cover"), F.min("place").alias("first"))
    return found.select("cover.mediaId", "whole", "id", "name", "count", F.col("cover.uri").alias("coverUri"), "first")


@dataclass(frozen=True)
class KeptParts(Derived):
    """Albums as a kept table (A4-A6, W2): a version's change makes the parts of its buckets anew, from these buckets alone. So a
    cover that goes is replaced by the next one without reading the other buckets."""

    def followed(self, stored: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
        return self.make(after).select(*stored.columns)


def kept_parts(bucket: Callable[[], Column]) -> KeptParts:
    """``album_parts`` beside a store's photos; ``bucket`` is the store's."""
    return KeptParts("album_parts", "media_embeddings", lambda photos: album_parts(photos, bucket()))


def build_kept(parts: DataFrame, photos: DataFrame, now_millis: int) -> DataFrame:
    """``build`` from kept parts: a row for each bucket and album is read, and of the photos only recent ones."""
    merged = parts.groupBy("whole", "id", "name").agg(F.sum("count").alias("count"), F.min_by("coverUri", "first").alias("coverUri"), F.min("first").alias("first"))
    all_photos = merged.where("whole").select(F.lit(0).alias("rank"), F.lit(ALL).alias("id"), F.lit("All Photos").alias("name"), "count", "coverUri", F.lit(True).alias("isSystemCollection"))
    cutoff = recent_cutoff(now_millis)
    recent = photos.where(F.col("dateAdded") >= cutoff) if cutoff > 0 else photos
    system = all_photos.unionByName(system_albums(recent, now_millis).where(F.col("id") == RECENT))
    return _catalog(system, merged.where("not whole").drop("whole").withColumn("isSystemCollection", F.lit(False)))
