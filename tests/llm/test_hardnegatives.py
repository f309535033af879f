"""Hard negatives against scoring every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.llm import hardnegatives
from prismlake.llm.hardnegatives import Cells, hard_negatives


def by_hand(rows, scale=256, positives=5, negatives=5, low=80, every=100):
    kept = [(i, label, [math.floor(x * scale) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in kept:
        if a is None or a % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w, strict=False)), i, of) for i, of, w in kept), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        for p, i, _ in [x for x in scored if x[2] == label and x[1] != a][:positives]:
            found = [x for x in scored if x[2] != label and low * p <= 100 * x[0] <= 100 * p][:negatives]
            out += [(a, i, k, j, p, s) for k, (s, j, _) in enumerate(found, 1)]
    return sorted(out, key=repr)


def rows_of(rng, n, dimension=12, spread=0.3, labels=4):
    centres = [[rng.gauss(0, spread) for _ in range(dimension)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = rng.randrange(labels)
        out.append((i, rng.choice([label, label, label, rng.randrange(labels)]), [float(np.float32(c + rng.gauss(0, spread / 3))) for c in centres[label]]))
    return out


def got(df, **sizes):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[c] for c in names) for r in hard_negatives(df, F.col("vec_id") % 100 == 0, **sizes).collect()), key=repr)


SCHEMA = "vec_id long, label int, embedding array<float>, rank string, anchor int"


@pytest.mark.parametrize(("spread", "sizes"), [(0.3, {}), (0.02, {"tile": 50, "small_tile": 10, "group": 3}), (40000.0, {"tile": 300}), (1e-6, {})])
def test_rows_match_scoring_every_pair(spark, monkeypatch, spread, sizes):
    """Also with many ties, components beyond 32 bits' sums, and small tiles, groups and slices."""
    monkeypatch.setattr(hardnegatives, "ANCHORS", 4)
    rng = random.Random(6)
    rows = rows_of(rng, 700, spread=spread)
    same = rows[100][2]
    rows = [(i, label, same if i % 3 == 0 else v) for i, label, v in rows]  # a third is one vector
    rows += [(800, None, same), (900, 1, None), (1000, 1, [float("nan")] * 12), (1100, 1, [None] + same[1:]), (1200, 2, [float("inf")] + same[1:]), (None, 1, same), (-100, 2, same), (200, 1, rows[5][2]), (7, 3, same)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).repartition(5)
    expected = by_hand(rows)
    assert got(df, **sizes) == expected and len(expected) > 100


def test_uneven_lengths_and_empty_tables(spark):
    rng = random.Random(1)
    rows = [(i, label, v[: rng.randint(0, 12)]) for i, label, v in rows_of(rng, 300)]
    assert got(spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA)) == by_hand(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty) == []
    assert got(spark.createDataFrame([(1, 1, [0.5], "x", 9), (3, 2, [0.25], "x", 9)], SCHEMA)) == []
    assert got(spark.createDataFrame([(100, 1, [0.5], "x", 9)], SCHEMA)) == []


def test_bounds_hold_and_few_rows_are_scored(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 32, (5000, 64)).astype(np.int64)
    cells = Cells.fitted(vectors[:500], vectors.min(axis=0), vectors.max(axis=0))
    codes, (low, high) = cells.of(vectors), cells.tables(vectors[:20])
    bounds = [sum(side[d][codes[d]] for d in range(64)) for side in (low, high)]
    exact = vectors @ vectors[:20].T
    assert (bounds[0] <= exact).all() and (exact <= bounds[1]).all()
    scored = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: scored.append(len(a)) or einsum(how, a, b))
    ends = np.full((20, 1), hardnegatives.FIRST), np.full((20, 1), hardnegatives.LAST)
    query, _, row, score = hardnegatives.search(cells, vectors, lambda s: np.ones((len(vectors[s]), 20), bool), np.arange(5000), vectors[:20], *ends, 5)
    for q in range(20):
        best = np.lexsort((np.arange(5000), -exact[:, q]))[:5]
        mine = np.lexsort((row[query == q], -score[query == q]))
        assert row[query == q][mine].tolist() == best.tolist()
    assert sum(scored) < 0.2 * 5000 * 20


def test_query_shifts_labels(spark, tmp_path):
    rows = rows_of(random.Random(2), 400, 64, labels=10)
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    shifted = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows]
    assert sorted(map(tuple, hardnegatives.op11_hard_negative_mining(spark, str(tmp_path)).collect()), key=repr) == by_hand(shifted)
