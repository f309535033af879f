"""Hard negatives by a vector-approximation file.

Vectors are integers (floor(scale * x)) and scores exact integer inner products. Each dimension is cut into at most ``CELLS``
cells, by quantiles of a sample of at most ``SAMPLE`` rows; the outer cells reach to the least and greatest component of
all rows, so every row has a cell in every dimension. A row's approximation is its cells, a byte each.

For a query vector each dimension gives a table of the least and of the greatest product that each cell allows. Sums of
looked-up entries bound a row's score from below and above. Only rows whose bounds can reach a window, and the best ``k``
found in it so far, are scored exactly:

1. positives: rows of the anchor's label, the window is everything;
2. negatives: rows of other labels, a window [low% of the positive's score, its score] for each positive.

The stated queries (the anchors) meet all rows in blocks: rows are dealt evenly into tiles and anchors into groups, each
(tile, group) is one cogroup of at most ``TILE`` rows and about ``GROUP`` anchors, and gives at most ``k`` rows for each window. The
best of all tiles are taken by rank, which Spark limits before it shuffles. Nothing but counts, the sample and the
range of each dimension reaches the driver, nothing is broadcast, and tiles are dealt by row number, so no label, id
or vector that is frequent makes one of them larger.

Defined cases: rows without a label or vector, or with a null or non-finite component, take no part; a null vec_id is no
anchor and comes last among ties; a row with the anchor's own vec_id is none of its positives; rows that repeat a vec_id
take part each for itself, as anchors, positives and negatives; a shorter vector counts as followed by zeros; components
beyond ``intvectors.LIMIT`` are refused; a positive of negative score has an empty window; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismlake.llm import intvectors
from prismlake.llm.session import partitions, table, written

POSITIVES, NEGATIVES, LOW, SCALE = 5, 5, 80, 256
CELLS, SAMPLE = 64, 4096
#: Rows of a tile at most, and at least where there are few; anchors of a group, about.
TILE, SMALL_TILE, GROUP = 1 << 16, 1 << 12, 1 << 13
#: Anchors and rows whose bounds are computed at once.
ANCHORS, ROWS = 512, 256
FIRST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Cells:
    """Each dimension's inner edges (the first component of each further cell), and the range of all components."""

    edges: list[np.ndarray]
    least: np.ndarray
    greatest: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray, least: np.ndarray, greatest: np.ndarray, cells: int = CELLS) -> Cells:
        at = np.arange(1, cells) / cells
        return cls([np.unique(np.quantile(column, at, method="lower")) if len(column) else np.zeros(0, np.int64) for column in sample.T], least, greatest)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """dimension x row: the cells of some vectors."""
        return np.array([np.searchsorted(e, column, side="right") for e, column in zip(self.edges, vectors.T, strict=True)], np.uint8).reshape(len(self.edges), len(vectors))

    def tables(self, queries: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each dimension, cell x query: the least and the greatest product of the query with a component in the cell."""
        low, high = [], []
        for d, edges in enumerate(self.edges):
            ends = np.array([np.concatenate([[self.least[d]], edges]), np.concatenate([edges - 1, [self.greatest[d]]])])
            products = ends[:, :, None] * queries[:, d]
            low.append(products.min(axis=0))
            high.append(products.max(axis=0))
        return low, high


def best(group: np.ndarray, score: np.ndarray, row: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, by score from the top and then by ``order``."""
    at = np.lexsort((order[row], -score, group))
    starts = np.concatenate([[True], group[at][1:] != group[at][:-1]]) if len(at) else np.zeros(0, bool)
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
    return at[rank < k]


def search(cells: Cells, vectors: np.ndarray, allowed, order: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, window, row, score) of the first ``k`` allowed rows in each window [low, high] (query x window) of exact scores.

    ``allowed`` gives a mask (row x query) of a slice of rows, ``order`` breaks ties.
    """
    windows = low.shape[1]
    codes = cells.of(vectors)
    small = len(cells.edges) * float(max(1, np.abs(queries).max(initial=0))) * float(max(1, np.abs([cells.least, cells.greatest]).max(initial=0))) < 2**31
    kind = np.iinfo(np.int32 if small else np.int64)
    least, greatest = ([t.astype(kind.dtype) for t in side] for side in cells.tables(queries))
    got = [np.zeros(0, np.int64) for _ in range(3)]  # window of query, row, score
    reach = low.astype(np.int64)  # scores from here can still enter

    def lowest() -> np.ndarray:
        """From where a query's scores can enter any of its windows."""
        return reach.min(axis=1, initial=LAST).clip(kind.min, kind.max).astype(kind.dtype)

    floor = lowest()
    for at in range(0, len(vectors), ROWS):
        upper = np.zeros((min(ROWS, len(vectors) - at), len(queries)), kind.dtype)
        for d, side in enumerate(greatest):
            upper += side[codes[d, at : at + ROWS]]
        row, query = np.nonzero((upper >= floor) & allowed(slice(at, at + ROWS)))
        if not len(row):
            continue
        top, bottom = upper[row, query].astype(np.int64), np.zeros(len(row), np.int64)
        row += at
        for d, side in enumerate(least):
            bottom += side[codes[d, row], query]
        can = (top[:, None] >= reach[query]) & (bottom[:, None] <= high[query])
        some = can.any(axis=1)
        row, query, can = row[some], query[some], can[some]
        score = np.einsum("ij,ij->i", vectors[row], queries[query])
        pair, window = np.nonzero(can & (score[:, None] >= low[query]) & (score[:, None] <= high[query]))
        if not len(pair):
            continue
        got = [np.concatenate(x) for x in zip(got, (query[pair] * windows + window, row[pair], score[pair]), strict=True)]
        kept = best(got[0], got[2], got[1], order, k)
        got = [x[kept] for x in got]
        # full windows are entered from their last score only
        full, n = np.unique(got[0], return_counts=True)
        last = np.cumsum(n)[n == k] - 1
        reach.reshape(-1)[full[n == k]] = got[2][last]
        floor = lowest()
    return got[0] // max(1, windows), got[0] % max(1, windows), got[1], got[2]


def dealt(n: int, most: int, least: int, wanted: int) -> int:
    """Into how many parts ``n`` rows go: enough that none has more than ``most``, and up to ``wanted`` while they have ``least``."""
    return max(1, -(-n // most), min(-(-n // least), wanted))


class Approximations:
    """All rows with their tiles, the cells of each dimension, and the search of a set of queries in blocks."""

    def __init__(self, vectors: DataFrame, tile: int = TILE, small_tile: int = SMALL_TILE, group: int = GROUP):
        """``vectors``: vec_id, label, vector and size, as ``intvectors.quantised`` gives them, written."""
        self.group = group
        n, size = vectors.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
        self.dimension = max(1, size)
        self.tiles = dealt(n, tile, small_tile, partitions(vectors.sparkSession))
        self.rows = vectors.select("vec_id", "label", "vector", F.pmod(F.monotonically_increasing_id(), F.lit(self.tiles)).cast("int").alias("tile"))
        sample = vectors.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).select("vector").toArrow()  # at most SAMPLE rows
        self.cells = Cells.fitted(intvectors.matrix(sample["vector"], self.dimension), *self._range(vectors))

    def _range(self, vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest component of each dimension over all rows."""
        dimension = self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    m = intvectors.matrix(batch.column("vector"), dimension)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension, dtype=np.int32)), pa.array(m.min(axis=0)), pa.array(m.max(axis=0))], ["d", "least", "greatest"])

        found = vectors.select("vector").mapInArrow(run, "d int, least long, greatest long")
        ends = {r["d"]: (r["least"], r["greatest"]) for r in found.groupBy("d").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest")).collect()}  # a row a dimension
        return tuple(np.array([ends.get(d, (0, 0))[i] for d in range(dimension)], np.int64) for i in (0, 1))

    def searched(self, anchors: DataFrame, n: int, same_label: bool, k: int) -> DataFrame:
        """anchor, place (of its window), vec_id and score of the first ``k`` rows, of its label or of others, in each window.

        ``anchors``: anchor (a number of its own), anchor_id, label, vector, and low and high, arrays of its windows' ends;
        ``n``: how many.
        """
        groups = dealt(n, self.group, self.group, 1)
        tiles, dimension, cells = self.tiles, self.dimension, self.cells
        asked = anchors.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        rows = self.rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
            found = [[np.zeros(0, np.int64)] * 4]
            ids = theirs["vec_id"].combine_chunks()
            unnamed = ids.is_null().to_numpy(zero_copy_only=False)
            order = np.argsort(np.lexsort((ids.fill_null(0).to_numpy(), unnamed)))  # places by id, null last
            labels, vectors = theirs["label"].to_numpy(), intvectors.matrix(theirs["vector"], dimension)
            names = ids.fill_null(0).to_numpy()
            asking = ours["label"].to_numpy()
            # of the anchors' own label only: label by label, so that no bound is computed for nothing
            parts = [(np.flatnonzero(asking == x), np.flatnonzero(labels == x)) for x in np.unique(asking)] if same_label else [(np.arange(len(asking)), np.arange(len(labels)))]
            for mine, there in parts:
                for at in range(0, len(mine) if len(there) else 0, ANCHORS):
                    some = mine[at : at + ANCHORS]
                    part = ours.take(pa.array(some))
                    own, own_label = part["anchor_id"].to_numpy(), asking[some]
                    low, high = (part[c].combine_chunks().flatten().to_numpy().reshape(len(some), -1) for c in ("low", "high"))

                    def allowed(s: slice, there=there, own=own, own_label=own_label) -> np.ndarray:
                        if same_label:
                            return (names[there[s], None] != own) | unnamed[there[s], None]
                        return labels[there[s], None] != own_label

                    query, place, row, score = search(cells, vectors[there], allowed, order[there], intvectors.matrix(part["vector"], dimension), low, high, k)
                    found.append([part["anchor"].to_numpy()[query], place, there[row], score])
            anchor, place, row, score = map(np.concatenate, zip(*found, strict=True))
            return pa.table([pa.array(anchor), pa.array(place.astype(np.int32)), ids.take(pa.array(row)), pa.array(score)], ["anchor", "place", "vec_id", "score"])

        met = asked.groupBy("tile", "group").cogroup(rows.groupBy("tile", "group")).applyInArrow(run, "anchor long, place int, vec_id long, score long")
        return met.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*first("score", "vec_id")))).where(F.col("rank") <= k)


def first(score: str, name: str) -> list[Column]:
    return [F.desc(score), F.asc_nulls_last(name)]


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE, **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from vec_id, label and embedding.

    ``anchors`` tells the rows that ask, ``low`` is the windows' lower end in hundredths of the positive's score.
    """
    vectors = written(intvectors.quantised(rows.where("label is not null"), scale))
    file = Approximations(vectors, **sizes)
    asking = written(vectors.where(anchors).select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vector"))
    n = asking.count()
    everything = {"low": F.array(F.lit(FIRST)), "high": F.array(F.lit(LAST))}
    found = file.searched(asking.withColumns(everything), n, True, positives)
    found = written(found.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # a window for each positive, in their order; one of negative score is empty
    ends = found.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # at most `positives`
    # the least integer of at least low% of the score, without passing 64 bits on the way
    least = f"transform(p, x -> x.positive_score div 100 * {low} + (x.positive_score % 100 * {low} + 99) div 100)"
    ends = ends.select("anchor", F.expr(least).alias("low"), F.transform("p", lambda x: x["positive_score"]).alias("high"))
    pad = [F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(c, i - 1), F.lit(empty))) for c, empty in (("low", LAST), ("high", FIRST))]
    windows = asking.join(ends, "anchor").withColumns({"low": pad[0], "high": pad[1]})
    met = file.searched(windows, n, False, negatives).select("anchor", (F.col("place") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return met.join(found, ["anchor", "place"]).join(asking.select("anchor", "anchor_id"), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", changed), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH q AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS alike,
    CAST(list_sum(list_transform(generate_series(1, 64), lambda i: a.v[i] * x.v[i])) AS BIGINT) AS score
  FROM q a JOIN q x ON a.vec_id % 100 = 0),
positives AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike AND vec_id IS DISTINCT FROM anchor_id QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON p.a = s.a AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
