"""Counts that take back, against the join of all rows."""

import random

from pyspark.sql import functions as F

from prismlake.sources import library
from prismlake.streaming import live


def test_counts_equal_the_join_in_any_order(spark, tmp_path):
    """Revisions, deletions, models and derived rows in any order and any batches; after each batch the totals are those
    of what has come so far."""
    rng = random.Random(11)
    rows = []
    for i in range(40):
        for _ in range(rng.randint(1, 6)):
            kind = rng.choice(live.KINDS)
            rows.append((i, kind, rng.choice([None, 1, 1, 1, 2]), None if kind == "photos" else rng.choice(["v1", "v1", "old", None]), kind == "photos" and rng.random() < 0.2))
    rows += [(None, "photos", 1, None, False), (3, "photos", 0, None, False)]
    rng.shuffle(rows)
    folder = str(tmp_path / "live")
    for k in range(3):
        spark.createDataFrame(rows[k::3], live.CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done = live.counted(library.changes(spark, str(tmp_path / "in"), spark.createDataFrame([], live.CHANGES).schema), folder, "v1", "v1")
        done.awaitTermination()
        got = {r.name: r.n for r in live.totals(spark, folder, k).collect()}
        so_far = spark.createDataFrame([r for j in range(k + 1) for r in rows[j::3]], live.CHANGES)
        expected = {r["name"]: r["n"] for r in live.batch_counts(so_far, "v1", "v1").collect()}
        assert {n: got.get(n, 0) for n in live.KINDS} == expected
    assert expected["photos"] > expected["texts"] > 0


def test_a_photo_enters_and_leaves():
    state = {"photos": (None, None), "faces": (3, "v1"), "texts": (2, "old")}
    models = {"faces": "v1", "texts": "v1"}
    assert live.standing(state, models) == {"photos": 0, "faces": 0, "texts": 0}
    assert live.standing(state | {"photos": (3, None)}, models) == {"photos": 1, "faces": 1, "texts": 0}
    assert live.standing(state | {"photos": (3, "gone")}, models) == {"photos": 0, "faces": 0, "texts": 0}
    assert live.newer((3, "gone"), (3, None)) and not live.newer((2, "gone"), (3, None)) and not live.newer((3, None), (3, None))


def test_feeds_as_changes(spark):
    feed = spark.range(2).select(F.col("id").alias("mediaId"), F.lit(1).alias("dateModified"))
    assert [tuple(r) for r in live.changes_of("photos", feed).collect()] == [(0, "photos", 1, None, False), (1, "photos", 1, None, False)]
