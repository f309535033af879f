"""Top k for many queries at once.

The library is read once for all queries. A task takes its photos in Arrow batches, scores a slice of a batch against a
block of queries by one matrix product and keeps the ``k`` best of each query so far, so its state is ``queries * k`` rows
whatever it reads. A product's last digits depend on how it is blocked, and ties are broken by date, so products only
say which pairs can still be among the best (``slack`` bounds their rounding); those are scored in the order of their
components, which gives the very doubles that ``search`` gives for each query alone.

Queries of up to ``BLOCK_BYTES`` go to the tasks as they are, and nothing is shuffled but each task's best. More of them
are dealt into groups and meet tiles of the library in cogroups, so neither side is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions import vectors
from prismlake.functions.scalars import filter_time, rank_time

#: Bytes of query vectors that a worker holds at once.
BLOCK_BYTES = 64 << 20
#: Photos of a tile where queries come in groups.
TILE = 1 << 16
#: Photos and queries of one product; components that are multiplied one by one at once.
ROWS, QUERIES, ONE_BY_ONE = 512, 256, 1 << 22
FIRST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Asked:
    """A block of queries: their numbers, vectors, half-open dates and the number of the media type (-1: any)."""

    ids: np.ndarray
    matrix: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, dimension: int) -> Asked:
        matrix = vectors.as_matrix(table["vector"].combine_chunks(), dimension).astype(np.float64)
        columns = [table[c].fill_null(empty).to_numpy() for c, empty in (("startMillis", FIRST), ("endMillis", LAST), ("kind", -1))]
        return cls(table["queryId"].to_numpy(), matrix, *columns)


class Best:
    """The ``k`` best photos of each query so far, by score, date and id from the top (O1)."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k = asked, k
        self.norms = np.sqrt((asked.matrix**2).sum(axis=1))
        self.reach = np.full(len(asked.ids), -np.inf)  # scores from here can still enter
        self.query, self.score, self.time, self.id = (np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))

    def see(self, ids: np.ndarray, matrix: np.ndarray, filter_times: np.ndarray, dated: np.ndarray, times: np.ndarray, kinds: np.ndarray) -> None:
        """Photos by slices; ``dated`` tells those that have a date for filters."""
        norms = np.sqrt((matrix**2).sum(axis=1))
        for at in range(0, len(ids), ROWS):
            s = slice(at, at + ROWS)
            for first in range(0, len(self.asked.ids), QUERIES):
                q = slice(first, first + QUERIES)
                a = self.asked
                off = vectors.slack(matrix.shape[1]) * norms[s, None] * self.norms[q]
                can = matrix[s] @ a.matrix[q].T + off >= self.reach[q]
                bounded = (a.start[q] != FIRST) | (a.end[q] != LAST)
                can &= ~bounded | (dated[s, None] & (filter_times[s, None] >= a.start[q]) & (filter_times[s, None] < a.end[q]))
                can &= (a.kind[q] < 0) | (kinds[s, None] == a.kind[q])
                row, query = np.nonzero(can)
                if len(row):
                    self._take(row + at, query + first, ids, matrix, times)

    def _take(self, row: np.ndarray, query: np.ndarray, ids: np.ndarray, matrix: np.ndarray, times: np.ndarray) -> None:
        step = max(1, ONE_BY_ONE // max(1, matrix.shape[1]))
        score = np.concatenate([vectors.sums_in_order(matrix[row[i : i + step]] * self.asked.matrix[query[i : i + step]]) for i in range(0, len(row), step)])
        some = score >= self.reach[query]
        new = query[some], score[some], times[row[some]], ids[row[some]]
        query, score, time, names = (np.concatenate(x) for x in zip((self.query, self.score, self.time, self.id), new, strict=True))
        order = np.lexsort((-names, -time, -score, query))
        heads = np.flatnonzero(np.concatenate([[True], query[order][1:] != query[order][:-1]])) if len(order) else order
        rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        kept = order[rank < self.k]
        self.query, self.score, self.time, self.id = query[kept], score[kept], time[kept], names[kept]
        full, n = np.unique(self.query, return_counts=True)
        self.reach[full[n == self.k]] = self.score[np.cumsum(n)[n == self.k] - 1]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, (self.asked.ids[self.query], self.id, self.score, self.time))], ["queryId", "mediaId", "rawSimilarity", "rankTime"])


def _seen(best: Best, batch: pa.RecordBatch | pa.Table, dimension: int) -> None:
    column = lambda name: batch.column(name).combine_chunks() if isinstance(batch.column(name), pa.ChunkedArray) else batch.column(name)
    matrix = vectors.as_matrix(column("embedding"), dimension).astype(np.float64)
    good = np.isfinite(matrix).all(axis=1)
    dates = column("filterTime")
    values = [column("mediaId").to_numpy(), matrix, dates.fill_null(0).to_numpy(), dates.is_valid().to_numpy(zero_copy_only=False), column("rankTime").fill_null(FIRST + 1).to_numpy(), column("kind").to_numpy()]
    best.see(*(v[good] for v in values))


def search_many(media: DataFrame, queries: DataFrame, k: int, dimension: int, block_bytes: int = BLOCK_BYTES, tile: int = TILE) -> DataFrame:
    """queryId, position, mediaId and rawSimilarity: the ``k`` most relevant photos of each query.

    ``queries``: queryId, vector and, if they are there, startMillis, endMillis (half-open, as in ``Filters``) and mediaType;
    a null sets no bound. A photo counts if its vector has ``dimension`` finite components; a query of another size fails.
    """

    def number(unknown: int) -> Column:
        return F.when(F.col("mediaType") == "IMAGE", 0).when(F.col("mediaType") == "VIDEO", 1).otherwise(unknown)

    optional = {"startMillis": "long", "endMillis": "long", "mediaType": "string"}
    queries = queries.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in queries.columns})
    sized = F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.lit(f"queries must have {dimension} components")))
    asked = queries.select(F.col("queryId").cast("long"), sized.cast("array<double>").alias("vector"), F.col("startMillis").cast("long"), F.col("endMillis").cast("long"), F.when(F.col("mediaType").isNotNull(), number(2)).alias("kind"))
    rows = media.where((F.col("embeddingDimension") == dimension) & (F.size("embedding") == dimension))
    rows = rows.select(F.col("mediaId").cast("long"), "embedding", filter_time().alias("filterTime"), rank_time().alias("rankTime"), number(3).alias("kind"))
    schema = "queryId long, mediaId long, rawSimilarity double, rankTime long"
    n = asked.count()
    if k <= 0 or not n:
        found = media.sparkSession.createDataFrame([], schema)
    elif n * dimension * 8 <= block_bytes:
        held = Asked.of(asked.toArrow(), dimension)  # at most `block_bytes`
        sent = media.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(sent.value, k)
            for batch in batches:
                _seen(best, batch, dimension)
            yield best.rows()

        found = rows.mapInArrow(run, schema)
    else:
        tiles, groups = max(1, -(-rows.count() // tile)), -(-n * dimension * 8 // block_bytes)
        met = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
        ours = asked.select("*", F.pmod(F.xxhash64("queryId"), F.lit(groups)).alias("group")).select("*", met)
        theirs = rows.select("*", F.pmod(F.monotonically_increasing_id(), F.lit(tiles)).cast("int").alias("tile"))
        theirs = theirs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))

        def meet(mine: pa.Table, photos: pa.Table) -> pa.Table:
            best = Best(Asked.of(mine, dimension), k)
            if len(mine) and len(photos):
                _seen(best, photos, dimension)
            return pa.Table.from_batches([best.rows()])

        found = ours.groupBy("tile", "group").cogroup(theirs.groupBy("tile", "group")).applyInArrow(meet, schema)
    order = Window.partitionBy("queryId").orderBy(F.desc("rawSimilarity"), F.desc("rankTime"), F.desc("mediaId"))
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).select("queryId", "position", "mediaId", "rawSimilarity")
