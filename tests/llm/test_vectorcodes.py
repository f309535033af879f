"""Codes and codebooks against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from prismlake.llm import intvectors, vectorcodes


def by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, label, code, error) of each row kept, and the codebooks; components are exact integers."""
    kept = [(i, label, [math.floor(x * scale) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for *_, v in kept), default=0) // parts))
    kept = [(i, label, v + [0] * (width * parts - len(v))) for i, label, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))[:entries]
    books = [[r[2][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for *_, v in kept:
                x = v[p * width : (p + 1) * width]
                held[near(x, books[p])[0]].append(x)
            books[p] = [[sum(c) // len(xs) for c in zip(*xs, strict=True)] if xs else old for xs, old in zip(held, books[p], strict=True)]
    out = []
    for i, label, v in kept:
        found = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    return out, books


def vectors_of(rng, n, dimension=16, spread=1.0):
    return [(i, rng.choice([0, 1, None]), [float(np.float32(rng.gauss(0, spread))) for _ in range(dimension)]) for i in range(n)]


@pytest.mark.parametrize("spread", [1.0, 0.001, 3000.0])
def test_codes_match_plain_arithmetic(spark, spread):
    rng = random.Random(4)
    rows = vectors_of(rng, 120, spread=spread)
    rows += [(200, 1, None), (201, 1, [float("nan")] * 16), (202, 0, [float("inf")] + [0.0] * 15), (203, 0, [None] + [0.0] * 15), (7, 1, rows[7][2]), (7, 1, rows[9][2]), (None, None, rows[3][2])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, label int, embedding array<float>, code string, error int").repartition(5)
    found, books = vectorcodes.compressed(df)
    expected, expected_books = by_hand(rows)
    assert books.tolist() == expected_books
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    text = ",".join(str(x) for book in expected_books for entry in book for x in entry)
    assert vectorcodes.digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_uneven_lengths_and_few_rows(spark):
    rows = [(3, None, [0.5, -0.25, 1.0]), (1, None, []), (2, 4, [0.125] * 11), (2, 4, [0.125] * 11)]
    found, books = vectorcodes.compressed(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    expected, expected_books = by_hand(rows)
    assert books.shape == (8, 4, 2) and books.tolist() == expected_books
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_no_rows(spark, tmp_path):
    for rows in ([], [(1, 1, None)]):
        spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        assert vectorcodes.op12_vector_code_compression(spark, str(tmp_path)).collect() == []


def test_query_sums_errors_by_label(spark, tmp_path):
    rows = vectors_of(random.Random(8), 60, 64)
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    expected, _ = by_hand(rows)
    sums = {label: sum(r[3] for r in expected if r[1] == label) for label in (0, 1, None)}
    got = vectorcodes.op12_vector_code_compression(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((i, c, e, sums[label]) for i, label, c, e in expected)


def test_intervals_hold_the_exact_scores():
    """Also where float32 can't tell the entries apart; ties go to the lower index."""
    rng = np.random.default_rng(2)
    for size in (3, 1000, 1 << 13, 1 << 26):
        x = rng.integers(-size, size + 1, (300, 8))
        entries = np.concatenate([x[:6], x[:6] + rng.integers(-1, 2, (6, 8)), x[:4]]).clip(-size, size)
        low, high = vectorcodes.screened(x, entries)
        exact = [[sum(int(b) * int(b) - 2 * int(a) * int(b) for a, b in zip(r, c, strict=True)) for c in entries] for r in x]
        assert all(math.ceil(lo) <= e <= math.floor(hi) for r, rl, rh in zip(exact, low, high, strict=True) for e, lo, hi in zip(r, rl, rh, strict=True))
        index, distance = vectorcodes.nearest(x, entries)
        d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in entries] for r in x]
        assert index.tolist() == [r.index(min(r)) for r in d] and distance.tolist() == [min(r) for r in d]


def test_large_components_are_refused():
    with pytest.raises(ValueError, match="64 bits"):
        intvectors.scaled(pa.array([[1e30]], pa.list_(pa.float64())), 256)
