"""Co-located tables: one pass of planning without an exchange, and lookups that open one bucket."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from prismlake.operators import planning
from prismlake.schemas import FACE_MODEL, TEXT_MODEL
from prismlake.sources import colocated


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def saved(df, tmp_path, name, buckets=4, key="mediaId"):
    return colocated.save(df, f"t_{name}_{uuid.uuid4().hex}", str(tmp_path / name), buckets, key)


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(3)
    ids = range(200)
    some = lambda share: [i for i in ids if rng.random() < share]
    current = spark.createDataFrame([(i, rng.randint(0, 2)) for i in some(0.8)], "mediaId long, dateModified long")
    stored = spark.createDataFrame([(i, rng.choice([None, 0, 1, 2]), rng.choice([0, 64])) for i in some(0.8)], "mediaId long, dateModified long, embeddingDimension int")
    faces, texts = (spark.createDataFrame([(i, rng.randint(0, 2), rng.choice([m, "old"])) for i in some(0.7)], "mediaId long, dateModified long, modelVersion string") for m in (FACE_MODEL, TEXT_MODEL))
    return [(df, saved(df, tmp_path, name)) for df, name in ((current, "current"), (stored, "stored"), (faces, "faces"), (texts, "texts"))]


def test_one_pass_says_what_the_single_rules_say(tables):
    (current, a), (stored, b), (faces, c), (texts, d) = tables
    rows = planning.whole_plan(a, b, c, d)
    assert "Exchange" not in plan_of(rows) and plan_of(rows).count("SortMergeJoin") == 3
    got = {r.mediaId: r for r in rows.collect()}
    expected = {r.mediaId: r.work for r in planning.classify(current, stored).collect()} | {r.mediaId: "deleted" for r in planning.deleted(current, stored).collect()}
    assert {i: r.work for i, r in got.items()} == expected
    assert {i for i, r in got.items() if r.facePending} == {r.mediaId for r in planning.face_pending(current, faces).collect()}
    assert {i for i, r in got.items() if r.textPending} == {r.mediaId for r in planning.text_pending(current, texts).collect()}
    assert all(r.faceValid != r.facePending or r.work == "deleted" for r in got.values())
    counts = planning.plan_counts(rows)
    assert plan_of(counts).count("Exchange") == 1  # of each task's sums
    n = counts.first()
    works = list(expected.values())
    assert (n.new, n.changed, n.pending, n.deleted) == tuple(works.count(w) for w in ("new", "changed", "pending", "deleted"))
    assert n.total == current.count() and n.facesValid == sum(r.faceValid for r in got.values())


def test_lookups_open_their_buckets_only(spark, tmp_path):
    people = spark.createDataFrame([(i, f"p_{i}") for i in range(400)], "id long, handle string")
    table = saved(people, tmp_path, "people", 8, "handle")
    found = colocated.lookup(table, ["p_7"], "handle")
    assert [r.id for r in found.collect()] == [7]
    read = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    beside = people.where(F.pmod(F.hash("handle"), F.lit(8)) == F.pmod(F.hash(F.lit("p_7")), F.lit(8)))
    assert read == beside.count() < 100  # the rows of its bucket, not of the table
    assert colocated.lookup(table, ["p_7", "p_7", "nobody"], "handle").count() == 1


def test_tables_can_be_attached(spark, tmp_path):
    saved(spark.range(100).select(F.col("id").alias("mediaId"), (F.col("id") % 3).alias("dateModified")), tmp_path, "media")
    again = colocated.attach(spark, f"again_{uuid.uuid4().hex}", str(tmp_path / "media"), 4)
    other = saved(spark.range(50, 150).select(F.col("id").alias("mediaId")), tmp_path, "other")
    joined = colocated.beside(again, other, "inner")
    assert joined.count() == 50 and "Exchange" not in plan_of(joined)
