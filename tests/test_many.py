"""Many queries at once, and joins of two growing sides, against every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import many, pivots, search
from prismlake.plans.query import Filters, Query


def photos(spark, rng, n=400, dimension=8):
    rows, repeated = [], None
    for i in range(n):
        v = [float(np.float32(rng.gauss(0, 1))) for _ in range(dimension)]
        repeated = repeated or v
        v = repeated if i % 3 == 0 else v  # a third is one vector
        rows.append((i, rng.choice(["IMAGE", "VIDEO"]), rng.choice([None, rng.randint(0, 50)]), rng.choice([None, rng.randint(0, 3)]), v, dimension))
    rows += [(1000, "IMAGE", 1, 1, None, dimension), (1001, "IMAGE", 1, 1, [1.0], 1), (1002, "IMAGE", 1, 1, [float("nan")] * dimension, dimension), (1003, "IMAGE", 1, 1, repeated, 0)]
    return spark.createDataFrame(rows, "mediaId long, mediaType string, dateTaken long, dateAdded long, embedding array<float>, embeddingDimension int").repartition(4)


def asked(spark, rng, n, dimension=8):
    rows = [(i, [rng.gauss(0, 1) for _ in range(dimension)], rng.choice([None, 5, 30]), rng.choice([None, 20, 45]), rng.choice([None, "IMAGE", "VIDEO"])) for i in range(n)]
    return spark.createDataFrame(rows, "queryId long, vector array<double>, startMillis long, endMillis long, mediaType string")


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 200, "tile": 90}])
def test_many_queries_find_what_each_finds_alone(spark, monkeypatch, sizes):
    """The same photos in the same order with the same doubles, whether queries come in one block or in groups."""
    monkeypatch.setattr(many, "ROWS", 64)
    monkeypatch.setattr(many, "QUERIES", 5)
    rng = random.Random(4)
    media, queries = photos(spark, rng).cache(), asked(spark, rng, 12)
    got = {}
    for r in many.search_many(media, queries, 7, 8, **sizes).collect():
        got.setdefault(r.queryId, {})[r.position] = (r.mediaId, r.rawSimilarity)
    finite = media.where("mediaId < 1000")
    for q in queries.collect():
        one = Query(Filters(q.startMillis, q.endMillis, q.mediaType), vector=tuple(q.vector), limit=7)
        alone = [(r.mediaId, r.rawSimilarity) for r in search.search(finite, one).collect()]
        assert [x for _, x in sorted(got.get(q.queryId, {}).items())] == alone
    media.unpersist()


def test_many_queries_read_the_library_once(spark):
    rng = random.Random(4)
    plan = many.search_many(photos(spark, rng), asked(spark, rng, 30), 5, 8)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan and "aggregate(" not in plan


def test_odd_query_sets(spark):
    rng = random.Random(1)
    media = photos(spark, rng, 20)
    queries = spark.createDataFrame([(1, [1.0] * 8)], "queryId long, vector array<float>")
    assert many.search_many(media, queries.limit(0), 5, 8).collect() == [] == many.search_many(media, queries, 0, 8).collect()
    assert many.search_many(media.limit(0), queries, 5, 8).collect() == []
    assert many.search_many(media, queries, 50, 8).count() == 20
    with pytest.raises(Exception, match="8 components"):
        many.search_many(media, spark.createDataFrame([(1, [1.0])], queries.schema), 5, 8).collect()
    strange = queries.withColumn("mediaType", F.lit("SOUND"))
    assert many.search_many(media, strange, 5, 8).collect() == []


def clustered(rng, n, dimension=8, wide=0.2, scale=1.0):
    centres = [rng.normal(size=dimension) for _ in range(6)]
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dimension) * wide
        rows.append((i, (v / np.linalg.norm(v) * scale).tolist()))
    return rows


@pytest.mark.parametrize(("threshold", "wide", "scale"), [(0.9, 0.2, 1.0), (0.3, 1.0, 1.0), (0.0, 0.5, 1.0), (1.0, 0.0, 1.0), (-0.5, 0.5, 1.0), (3.0, 0.2, 2.0)])
def test_joins_find_every_pair(spark, threshold, wide, scale):
    rng = np.random.default_rng(3)
    left, right = clustered(rng, 300, wide=wide, scale=scale), clustered(rng, 250, wide=wide, scale=scale)
    left += [(900, [0.0] * 8), (901, None), (902, [1.0]), (903, [float("nan")] * 8)]
    right += [(900, [0.0] * 8), (901, right[0][1]), (902, right[0][1]), (903, [math.inf] * 8)]
    frames = [spark.createDataFrame(x, "id long, embedding array<double>").repartition(3) for x in (left, right)]
    found = pivots.similarity_join(*frames, threshold, 8, tile=40).collect()

    def dot(x, y):
        total = 0.0
        for a, b in zip(x, y, strict=True):
            total += a * b
        return total

    good = [[(i, v) for i, v in side if v is not None and len(v) == 8 and all(map(math.isfinite, v))] for side in (left, right)]
    expected = sorted((i, j, s) for i, x in good[0] for j, y in good[1] if (s := dot(x, y)) >= threshold)
    assert sorted((r.left_id, r.right_id, r.score) for r in found) == expected


@pytest.mark.parametrize("dimension", [2, 64])
def test_joins_of_equally_many_tiles(spark, dimension):
    """As many tiles on either side, in one cell or in none: each pair once. Floats are joined as floats."""
    rng = np.random.default_rng(11)
    v = rng.normal(size=(160, dimension)).astype(np.float32) if dimension > 2 else np.ones((160, dimension), np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>").repartition(4)
    found = pivots.similarity_join(df, df, 1.0, dimension, tile=40).collect()
    exact = v.astype(np.float64) @ v.astype(np.float64).T
    assert sorted((r.left_id, r.right_id) for r in found) == sorted(zip(*(x.tolist() for x in np.nonzero(exact >= 1.0)), strict=True))


def test_tiles_hold_few_copies(spark, monkeypatch):
    """Where nothing can be bounded a row is copied for each tile of the other side, not for each cell; its pairs leave in batches."""
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 16)).astype(np.float32))], "id long, embedding array<float>")
    whole = []
    monkeypatch.setattr(pivots, "Cells", lambda *a: whole.append(a))
    monkeypatch.setattr(pivots, "PAIRS", 500)
    found = pivots.similarity_join(df, df, 0.0, 16, tile=1500)
    assert not whole and found.count() > 3000 * 1400


def test_very_long_and_very_short_vectors(spark):
    """Beyond the range of float32's products too."""
    rows = [(1, [1e30, 1.0]), (2, [1e30, -1.0]), (3, [-1e30, 1.0]), (4, [1e-30, 1e-30]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    for threshold, chosen in ((1e-61, rows), (1e-61, rows[3:]), (0.0, rows)):
        some = df.where(df.id.isin([i for i, _ in chosen]))
        found = {(r.left_id, r.right_id) for r in pivots.similarity_join(some, some, threshold, 2).collect()}
        exact = {i: np.array(v, np.float32).astype(np.float64) for i, v in chosen}
        assert found == {(i, j) for i, x in exact.items() for j, y in exact.items() if x[0] * y[0] + x[1] * y[1] >= threshold}


def test_cells_are_left_out_where_none_can_pair(spark):
    rng = np.random.default_rng(7)
    frame = spark.createDataFrame(clustered(rng, 600, wide=0.05), "id long, embedding array<double>")
    rows = pivots.points(frame, 8)
    cells = pivots.Cells(rows, 8, 40)
    copied = cells.copies(rows, pivots.joining_angle(0.95, 1.0)).count()
    assert copied < 0.4 * 600 * (cells.counts > 0).sum()


def test_neither_side_is_broadcast(spark):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame(clustered(rng, 100), "id long, embedding array<double>")
    plan = pivots.similarity_join(frame, frame, 0.9, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan and "CoGroup" in plan


def test_large_left_sides_are_joined_by_pivots(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(clustered(rng, 80), "id long, embedding array<double>")
    in_blocks = {(r.left_id, r.right_id) for r in search.similar_pairs(df, df, 0.9, 8).collect()}
    by_pivots = search.similar_pairs(df, df, 0.9, 8, block_bytes=72 * 10)
    assert "CoGroup" in by_pivots._jdf.queryExecution().executedPlan().toString()
    assert {(r.left_id, r.right_id) for r in by_pivots.collect()} == in_blocks


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], none.schema)
    for a, b in ((none, some), (some, none), (none, none)):
        assert pivots.similarity_join(a, b, 0.5, 2).collect() == []


def test_classes_of_equal_vectors(spark):
    rows = spark.createDataFrame([(5, [1.0]), (3, [1.0]), (4, [2.0]), (9, None)], "id long, embedding array<double>")
    assert sorted(map(tuple, pivots.vector_classes(rows).collect())) == [(3, 3), (4, 4), (5, 3)]
