"""Vectors as codes of small codebooks, by exact integer k-means on each part of the vector.

Components are integers (floor(scale * x)); a vector is cut into equal consecutive parts, and each part position has a
codebook of its own, which starts as that part of the vectors with the least ids. A round assigns every part to its
nearest entry and moves each entry to the floor of its parts' mean.

The nearest entry is found by screening: scores |c|^2 - 2xc of all entries come from one float32 matrix product,
each in an interval that its rounding can't leave (``screened``). An entry whose interval lies above the least upper end
can't be nearest. Where more than one entry is left, their squared distances are computed in 64-bit integers, and of equal
ones the lower index wins. So the result is that of exact arithmetic, on any machine and for any order of summation.

The vectors are written once as integers; each round reads them and sums within tasks, so only a number for each
component of each entry and task is shuffled, and codebooks (``parts * entries`` entries) are all the driver sees.

Defined cases: rows without a vector, or with a null or non-finite component, are dropped; a null vec_id comes last, so
it is a first entry only where too few others are there, and of rows with one vec_id the one whose bytes come first
precedes; with fewer rows than entries the codebook has as many entries as rows; a vector shorter than the longest counts
as followed by zeros, and so do vectors whose length isn't a multiple of ``parts``; components beyond ``intvectors.LIMIT``
are refused; repeated rows each get their own row and count in every sum; rows without a label form one group; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import intvectors
from prismlake.llm.session import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def screened(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of |c|^2 - 2xc for each row of integers ``x`` and each entry c, from a float32 product.

    With u = 2^-24, float32 values of integers are off by a factor of 1 + u at most, and a sum of k products by
    k * u / (1 - k * u) of the sum of their sizes, in whatever order and with or without fused steps. That sum is at most
    |x| * |c|. The last term covers the rounding of this bound and of the ends themselves, done in doubles.
    """
    k = x.shape[1] + 3
    share = k * 2.0**-24 / (1 - k * 2.0**-24)
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    lengths = [np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) for v in (x, entries)]
    square = (entries * entries).sum(axis=1).astype(np.float64)
    score = square - 2 * product
    off = 2 * share * lengths[0][:, None] * lengths[1] * (1 + 2.0**-40) + 2.0**-48 * (square + 2 * np.abs(product) + 1)
    return score - off, score + off


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, ties to the lower one, and the squared distance, as exact integers."""
    low, high = screened(x, entries)
    can = low <= high.min(axis=1)[:, None]
    index = can.argmax(axis=1)
    several = np.flatnonzero(can.sum(axis=1) > 1)
    if len(several):
        row, entry = np.nonzero(can[several])
        exact = np.full((len(several), len(entries)), np.iinfo(np.int64).max)
        exact[row, entry] = ((x[several[row]] - entries[entry]) ** 2).sum(axis=1)
        index[several] = exact.argmin(axis=1)
    return index, ((x - entries[index]) ** 2).sum(axis=1)


def in_parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """part x row x component."""
    return np.ascontiguousarray(intvectors.matrix(column, parts * width).reshape(-1, parts, width).transpose(1, 0, 2))


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part x entry x component) after one round."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for p, x in enumerate(in_parts(batch.column("vector"), parts, width)):
                index, _ = nearest(x, books[p])
                counts[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, x)
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = vectors.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # a row for each entry in use
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]  # rounds down, exactly
    return out


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """part x entry x component; without entries where ``vectors`` (``intvectors.quantised``) has no rows."""
    size = vectors.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    width = max(1, -(-size // parts))
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow()  # `entries` rows
    books = in_parts(first["vector"], parts, width).copy()
    for _ in range(rounds if books.shape[1] else 0):
        books = moved(vectors, books)
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (an index for each part, two hex digits each) and error of each row."""
    parts, entries, width = books.shape
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indexes, error = [], np.zeros(len(batch), np.int64)
            for p, x in enumerate(in_parts(batch.column("vector"), parts, width)):
                index, distance = nearest(x, books[p])
                indexes.append(index)
                error += distance
            codes = np.array(indexes, np.uint8).T
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The rows' codes (``coded``) and the codebooks, from vec_id, label and embedding."""
    if entries > 256:
        raise ValueError("an index has two hex digits")
    vectors = written(intvectors.quantised(rows, scale))
    books = codebooks(vectors, parts, entries, rounds)
    return coded(vectors, books), books


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compressed(table(spark, sf_dir, "embeddings"))
    rows = written(rows)
    # summed first and joined back, since a label may have a third of all rows
    sums = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assigned(i: int) -> str:
    """Each part's nearest entry in the codebooks after ``i`` rounds, ties to the lower one."""
    distance = "list_sum(list_transform(generate_series(1, 8), lambda i: (t.x[i] - b.x[i]) * (t.x[i] - b.x[i])))"
    return f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d FROM (SELECT t.r, t.p, t.x, b.e, CAST({distance} AS BIGINT) AS d FROM parts t JOIN b{i} b ON t.p = b.p) GROUP BY r, p)"


def _moved(i: int) -> str:
    means = ", ".join(f"CAST(floor(CAST(sum(x[{k}]) AS DOUBLE) / count(*)) AS BIGINT)" for k in range(1, 9))
    return f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT p, e, [{means}] AS x FROM a{i} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"


OP12_SQL = f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, k AS p, v[k * 8 + 1 : k * 8 + 8] AS x FROM q, generate_series(0, 7) AS g(k)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM parts WHERE r <= 16),
{", ".join(_assigned(i) + ", " + _moved(i) for i in range(ROUNDS))}, {_assigned(ROUNDS)},
codes AS (SELECT r, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT q.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY q.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM q JOIN codes c ON q.r = c.r
"""
