"""Versioned tables, copies and streams."""

import os

import pytest
from pyspark.sql import functions as F

from prismlake.schemas import FACE_INDEX, FACES, PHOTO_TEXT
from prismlake.sources import copies, library
from prismlake.sources.tables import Store
from prismlake.streaming import index
from tests.test_retrieval import media_rows, texts_of


def empty_store(spark, path, media):
    tables = Store(spark, path)
    tables.publish({"media_embeddings": media, "photo_text": texts_of(spark, [(1, "a"), (2, "b")]), "face_index": spark.createDataFrame([], FACE_INDEX), "face_embeddings": spark.createDataFrame([], FACES)})
    return tables


def test_versions_are_published_whole(spark, tmp_path):
    tables = Store(spark, str(tmp_path))
    assert tables.version() == 0
    assert tables.publish({"t": spark.range(3)}) == 1 and tables.read("t").count() == 3

    def fail(x):
        raise OSError("disk full")

    broken = spark.range(1).select(F.udf(fail, "long")("id").alias("id"))
    with pytest.raises(Exception):
        tables.publish({"t": spark.range(9), "u": broken})
    assert tables.version() == 1 and tables.read("t").count() == 3


def test_stream_into_store(spark, tmp_path):
    media = media_rows(spark, [(1, (1, 0), None, 1), (2, (1, 0), None, 0)])
    tables = empty_store(spark, str(tmp_path / "store"), media)
    media_rows(spark, [(1, (0, 1), None, 2), (1, (0, 1), None, 0), (3, (0, 1), None, 5)]).write.parquet(str(tmp_path / "in/a"))
    changes = library.changes(spark, str(tmp_path / "in/*"), media.schema)
    seen = []
    index.into_store(changes, tables, str(tmp_path / "checkpoint"), seen.append).awaitTermination()
    assert {r.mediaId: r.dateModified for r in tables.read("media_embeddings").collect()} == {1: 2, 2: 0, 3: 5}
    assert {r.mediaId for r in tables.read("photo_text").collect()} == {2}  # the first photo changed
    version = tables.version()
    media_rows(spark, [(3, (1, 0), None, 4)]).write.parquet(str(tmp_path / "in/b"))
    index.into_store(changes, tables, str(tmp_path / "checkpoint")).awaitTermination()
    assert tables.version() == version + 1 and tables.read("media_embeddings").where("mediaId = 3").first().dateModified == 5
    assert [s["version"] for s in seen] == [version]


def test_streaming_aggregates_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, (i * 7) % 23, f"v{i}") for i in range(40)], "mediaId long, dateModified long, v string")
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = library.changes(spark, str(tmp_path / "in"), rows.schema, 1)
    for plan, name in ((index.latest_revision, "latest"), (lambda r: index.live_counts(r, "mediaId"), "counts")):
        plan(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, plan(rows).collect()))
    assert index.live_counts(rows).first()[0] == 40


def test_latest_query_takes_over(spark):
    searches = index.LatestQuery(spark)
    assert [r.id for r in searches.run(lambda: spark.range(2))] == [0, 1]

    def overtaken():
        searches.run(lambda: spark.range(1))
        return spark.range(5)

    assert searches.run(overtaken) is None


def test_copies(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir(), target.mkdir()
    data = os.urandom(150_000)
    (source / "a.jpg").write_bytes(data)
    (source / "b.jpg").write_bytes(b"")
    rows = [(1, str(source / "a.jpg"), "a.jpg", "image/jpeg"), (2, str(source / "b.jpg"), "b.jpg", "image/jpeg"), (3, str(source / "none.jpg"), "c", "image/png"), (4, str(source / "a.jpg"), "d", "text/plain")]
    got = {r.mediaId: r for r in copies.save_copies(spark.createDataFrame(rows, "mediaId long, path string, displayName string, mimeType string"), str(target)).collect()}
    assert got[1].error is None and got[1].bytes == 150_000 and open(got[1].copy, "rb").read() == data
    assert "empty" in got[2].error and got[3].error and "format" in got[4].error
    assert [f.name for f in target.iterdir()] == [os.path.basename(got[1].copy)]


def test_text_tables_keep_their_schema(spark):
    assert texts_of(spark, [(1, "a")]).columns == [f.name for f in PHOTO_TEXT]
