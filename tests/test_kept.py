"""Kept albums, digests of snapshots, and pages by a cursor."""

import random

from pyspark.sql import functions as F

from prismlake.operators import albums, paging, planning, search
from prismlake.plans.query import Filters
from prismlake.schemas import FACE_INDEX, FACES, MEDIA, PHOTO_TEXT
from prismlake.sources import library
from prismlake.sources.tables import Store
from prismlake.streaming import index

NOW = 1_704_067_200_000


def photos(spark, rows):
    """(id, revision, album, dateTaken, dateAdded)"""
    full = [(i, f"u{i}", "IMAGE", revision, None, taken, added, None, None, None, album, album and f"Album {album}", [1.0], 1, 0) for i, revision, album, taken, added in rows]
    return spark.createDataFrame(full, MEDIA)


def test_kept_albums_equal_a_rebuild(spark, tmp_path):
    """After photos came, moved and went, covers among them."""
    rng = random.Random(2)
    recent = NOW // 1000 - 100

    def some(ids, revision):
        return [(i, revision, rng.choice([None, "a", "b", "c", "all"]), rng.choice([None, rng.randint(0, 9)]), rng.choice([None, 5, recent, recent + i])) for i in ids]

    media = photos(spark, some(range(60), 0))
    tables = Store(spark, str(tmp_path / "store"), buckets=4)
    kept = albums.kept_parts(tables.bucket)
    empty = {name: spark.createDataFrame([], schema) for name, schema in (("photo_text", PHOTO_TEXT), ("face_index", FACE_INDEX), ("face_embeddings", FACES))}
    tables.publish({"media_embeddings": media, "album_parts": kept.make(media), **empty})

    def both():
        now = tables.read("media_embeddings")
        return [[tuple(r) for r in df.collect()] for df in (albums.build_kept(tables.read("album_parts"), now, NOW), albums.build(now, NOW))]

    first = both()
    assert first[0] == first[1] and len(first[0]) >= 5
    covers = {r.coverUri for r in albums.build(media, NOW).collect()}
    gone = [int(u[1:]) for u in covers]
    moved = photos(spark, some(range(100, 110), 0) + some([i for i in range(0, 60, 4) if i not in gone], 1)).withColumn("gone", F.lit(False))
    feed = moved.unionByName(photos(spark, some(gone, 2)).withColumn("gone", F.lit(True))).coalesce(1)
    feed.write.parquet(str(tmp_path / "in"))
    index.into_store(library.changes(spark, str(tmp_path / "in"), feed.schema), tables, str(tmp_path / "c"), derived=[kept]).awaitTermination()
    then = both()
    assert then[0] == then[1] and then[0] != first[0] and not covers & {r[3] for r in then[0]}
    assert tables.read("album_parts").count() <= 4 * 5 + 4


def test_snapshots_are_told_apart_by_buckets(spark):
    before = spark.range(500).select(F.col("id").alias("mediaId"), (F.col("id") % 7).alias("dateModified")).repartition(5)
    again = before.repartition(3).orderBy(F.rand(1))
    assert planning.differing_buckets(before, again, 64) == [] and planning.snapshot_changes(before, again, 64).isEmpty()
    after = before.where("mediaId <> 3").withColumn("dateModified", F.when(F.col("mediaId") == 44, F.lit(9)).otherwise(F.col("dateModified")))
    after = after.unionByName(before.where("mediaId = 100"))  # a row twice
    assert 1 <= len(planning.differing_buckets(before, after, 64)) <= 3
    expected = sorted(map(tuple, planning.snapshot_difference(before, after).collect()))
    assert sorted(map(tuple, planning.snapshot_changes(before, after, 64).collect())) == expected and len(expected) == 4
    swapped = spark.createDataFrame([(1, 2), (2, 1), (None, None)], "mediaId long, dateModified long")
    assert planning.snapshot_changes(swapped, spark.createDataFrame([(1, 1), (2, 2), (None, None)], swapped.schema)).count() == 4


def read_rows(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_pages_by_cursor(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paging, "GROUP_BYTES", 4096)
    media = spark.range(20000).select((F.col("id") * 3).alias("mediaId"), F.when(F.col("id") % 50 == 0, "VIDEO").otherwise("IMAGE").alias("mediaType"), F.lit(1).alias("embeddingDimension"), F.lit(0).cast("long").alias("dateTaken"), F.lit(0).cast("long").alias("dateAdded"), F.array(F.rand(1).cast("float")).alias("embedding"))
    media = media.repartition(4)
    pages = paging.Pages.saved(media, str(tmp_path / "p"), step=500)
    assert 40 <= pages.marks.count() <= 44
    for filters in (Filters(), Filters(media_type="VIDEO")):
        found = [[r.mediaId for r in page] for page in pages.each(filters, 150)]
        assert [i for page in found for i in page] == [r.mediaId for r in search.candidates(media, filters).orderBy("mediaId").collect()]
        assert all(len(page) == 150 for page in found[:-1])
    third = pages.after(found[1][-1], Filters(), 64, step=500)
    assert [r.mediaId for r in third.collect()] == [found[1][-1] + 3 * k for k in range(1, 65)]
    assert read_rows(third) < 5000  # row groups up to the second mark ahead
    assert pages.after(59997, Filters(), 10).collect() == []


def test_pages_of_an_empty_library(spark, tmp_path):
    media = spark.createDataFrame([], MEDIA)
    assert list(paging.Pages.saved(media, str(tmp_path / "p")).each(Filters(), 10)) == []
