"""Kept tables that follow a stream: postings, deletions, restarts and unique runs."""

import threading

import pytest
from pyspark.sql import functions as F

from prismlake.operators import search, store
from prismlake.schemas import FACE_INDEX, FACES, TEXT_MODEL
from prismlake.sources import library
from prismlake.sources.tables import Store
from prismlake.streaming import index
from tests.test_retrieval import media_rows, texts_of

DERIVED = [search.TextIndex.derived]


def indexed(spark, path, media, texts):
    tables = Store(spark, path, buckets=4)
    rows = texts_of(spark, texts)
    tables.publish({"media_embeddings": media, "photo_text": rows, "face_index": spark.createDataFrame([], FACE_INDEX), "face_embeddings": spark.createDataFrame([], FACES), **search.TextIndex(tables).rebuilt(rows)})
    return tables


def found(tables, *words):
    """By postings, which must be what a scan of the texts finds."""
    media = tables.read("media_embeddings")
    got = {r[0] for r in search.TextIndex(tables).matches(words, media).collect()}
    assert got == {r[0] for r in search.text_matches(tables.read("photo_text"), media, words).collect()}
    return got


def bare(tables):
    return sorted((r.mediaId, r.word) for r in tables.read("text_postings").collect())


def test_postings_follow_the_stream(spark, tmp_path):
    """A changed photo's postings go with its text; so do a deleted one's; new texts come in the version of their postings."""
    media = media_rows(spark, [(i, (1, 0), None, 0) for i in range(1, 5)])
    tables = indexed(spark, str(tmp_path / "store"), media, [(1, "red car"), (2, "red boat"), (3, "red"), (4, "blue")])
    assert found(tables, "red") == {1, 2, 3}
    feed = media_rows(spark, [(1, (0, 1), None, 2), (3, (0, 1), None, 3), (3, (0, 1), None, 1), (4, (0, 1), None, 0)])
    feed.withColumn("gone", F.col("dateModified") == 3).write.parquet(str(tmp_path / "in/a"))
    changes = library.changes(spark, str(tmp_path / "in/*"), feed.withColumn("gone", F.lit(True)).schema)
    index.into_store(changes, tables, str(tmp_path / "c1"), derived=DERIVED).awaitTermination()
    assert found(tables, "red") == {2} and {r.mediaId for r in tables.read("media_embeddings").collect()} == {1, 2, 4}
    assert bare(tables) == [(2, "boat"), (2, "red"), (4, "blue")]
    texts = texts_of(spark, [(1, "green car"), (2, "late"), (3, "orphan"), (4, "blue red")])
    texts = texts.withColumn("dateModified", F.when(F.col("mediaId") == 1, F.lit(2)).when(F.col("mediaId") == 2, F.lit(9)).otherwise(F.col("dateModified")).cast("long"))
    texts.write.parquet(str(tmp_path / "texts/a"))
    index.texts_into_store(library.changes(spark, str(tmp_path / "texts/*"), texts.schema), tables, str(tmp_path / "c2"), derived=DERIVED).awaitTermination()
    assert found(tables, "red") == {2, 4} and found(tables, "car") == {1} and found(tables, "late") == set() == found(tables, "orphan")
    assert bare(tables) == [(1, "car"), (1, "green"), (2, "boat"), (2, "red"), (4, "blue"), (4, "red")]


def test_matches_need_the_revision_and_the_model(spark, tmp_path):
    media = media_rows(spark, [(1, (1, 0), None, 0), (2, (1, 0), None, 5), (3, (1, 0), None, 0)])
    rows = texts_of(spark, [(1, "red"), (2, "red"), (3, "red")]).withColumn("modelVersion", F.when(F.col("mediaId") == 3, F.lit("old")).otherwise(F.lit(TEXT_MODEL)))
    tables = Store(spark, str(tmp_path), buckets=2)
    kept = search.TextIndex(tables)
    tables.publish({"photo_text": rows, **kept.rebuilt(rows)})
    assert {r[0] for r in kept.matches(["red"], media).collect()} == {1}
    assert {r[0] for r in kept.matches(["red"]).collect()} == {1, 2, 3}


def test_only_changed_rows_are_made_anew(spark):
    made = spark.sparkContext.accumulator(0)

    def make(df):
        def one(x):
            made.add(1)
            return x * 10

        return df.select("mediaId", F.udf(one, "long")("v").alias("w"))

    table = store.Derived("d", "t", make)
    before = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 4)], "mediaId long, v long")
    after = spark.createDataFrame([(1, 1), (2, 5), (3, None), (6, 6)], "mediaId long, v long")
    kept = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (4, 40)], "mediaId long, w long")
    assert sorted(map(tuple, table.followed(kept, before, after).collect())) == [(1, 10), (1, 11), (2, 50), (6, 60)]
    assert made.value == 2


def test_a_batch_that_was_published_runs_once(spark, tmp_path):
    """The run ends between the version and the checkpoint; the batch comes again and changes nothing."""
    media = media_rows(spark, [(1, (1, 0), None, 0)])
    tables = indexed(spark, str(tmp_path / "store"), media, [(1, "a")])
    media_rows(spark, [(1, (1, 0), None, 1), (2, (1, 0), None, 0)]).write.parquet(str(tmp_path / "in/a"))
    changes = library.changes(spark, str(tmp_path / "in/*"), media.schema)
    checkpoint = str(tmp_path / "checkpoint")

    def killed(_):
        raise KeyError("killed")

    with pytest.raises(Exception, match="killed"):
        index.into_store(changes, tables, checkpoint, killed).awaitTermination()
    assert tables.version() == 2 and tables.applied(checkpoint) == 0 and tables.applied("another") == -1
    seen = []
    index.into_store(changes, tables, checkpoint, seen.append).awaitTermination()
    assert tables.version() == 2 and seen == [] and tables.read("media_embeddings").count() == 2
    media_rows(spark, [(2, (1, 0), None, 3)]).write.parquet(str(tmp_path / "in/b"))
    index.into_store(changes, tables, checkpoint, seen.append).awaitTermination()
    assert [(s["batch"], s["version"]) for s in seen] == [(1, 3)]
    tables.publish({"media_embeddings": media})
    assert tables.applied(checkpoint) == 1  # later versions still know


def test_a_second_run_keeps_the_first(spark, tmp_path):
    media = media_rows(spark, [(1, (1, 0), None, 0)])
    tables = indexed(spark, str(tmp_path / "store"), media, [(1, "a")])
    media_rows(spark, [(1, (1, 0), None, 1)]).write.parquet(str(tmp_path / "in/a"))
    changes = library.changes(spark, str(tmp_path / "in/*"), media.schema)
    go, seen = threading.Event(), []

    def wait(row):
        seen.append(row)
        go.wait(60)

    first = index.into_store(changes, tables, str(tmp_path / "c"), wait, name="indexing")
    second = index.into_store(changes, tables, str(tmp_path / "c"), wait, name="indexing")
    assert second.id == first.id and index.unique(spark, "indexing").runId == first.runId
    go.set()
    first.awaitTermination()
    assert len(seen) == 1 and tables.version() == 2 and index.unique(spark, "indexing") is None
