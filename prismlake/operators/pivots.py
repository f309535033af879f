"""Threshold joins of two vector tables that both grow.

Pairs with an inner product of at least ``threshold`` are pairs whose directions are within an angle: arccos of the
threshold over the product of the greatest norms. Directions are points of the unit sphere and angles its metric, so the
space is cut into the cells of some pivots (a sample of the right side): a right row lies in the cell of its nearest
pivot. A left row is copied into each cell that can hold a partner of it, by two bounds:

- ring: the angles between a cell's rows and its pivot lie between two ends, and by the triangle inequality the left row's
  angle to the pivot must lie between these ends, each moved by the joining angle;
- border: a cell lies on its pivot's side of the great circle halfway to any other pivot, so the left row may lie beyond
  the border with its own cell by the joining angle at most.

Either side is cut further into tiles of at most ``tile`` rows, dealt by row number, so a cell with a third of all rows is many
tasks. Two tiles are put side by side by a cogroup and met in blocks of rows, whose pairs leave in batches, so neither a
tile pair nor its results need be held at once. Products in float32 only screen; pairs that their rounding leaves open are
summed component by component, as ``vectors.dot`` does. Vectors travel as bytes, as they came (floats as floats). Neither side is
broadcast or collected: the driver sees the pivots, some left rows, and for each cell its number of rows and its ends.

A row goes through the shuffle once for each tile that it meets. At low thresholds in many dimensions nothing can be
bounded and every row meets all tiles of the other side, so what the shuffle holds grows with rows x rows / ``tile``: that is the
exact join's own size, and there cells would only multiply it. Whether they bound enough to be worth their copies is
judged by some left rows (``worth_cells``); without them all rows are one cell. The pairs are the same either way. Rows
without a vector of ``dimension`` finite components have no partner. Rows with equal vectors each have their pairs;
``vector_classes`` takes them together first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import vectors
from prismlake.sources.tables import scratch

#: Pivots: one for each tile of the right side within these ends.
FEWEST, MOST = 16, 2048
#: Right rows for each cell, about.
CELL = 2048
#: Bytes of a tile's vectors; a task holds two tiles, some times over on their way.
TILE_BYTES = 16 << 20
#: Tiles of a side where it has that many times ``CELL`` rows, so that there are tasks for a small cluster.
TILES = 4
#: Rows of the blocks of two tiles that are met at once, and pairs that leave at once, about.
BLOCK = (256, 4096)
PAIRS = 1 << 16
#: Vectors longer than that aren't screened in float32, where their products may overflow.
LONGEST = 1e15
#: Room for the rounding of angles, which is largest near 0.
ROOM = 1e-6


def points(rows: DataFrame, dimension: int) -> DataFrame:
    """id, v (bytes of floats or doubles), norm of rows that can have a partner, written once: each side is read twice."""
    kept = rows.where(F.size("embedding") == dimension).select(F.col("id").cast("long").alias("id"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = vectors.as_matrix(batch.column("embedding"), dimension)
            m = given.astype(np.float64)
            good = np.isfinite(m).all(axis=1)
            norms = np.sqrt((m[good] ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), as_bytes((given if given.dtype == np.float32 else m)[good]), pa.array(norms)], ["id", "v", "norm"])

    return _written(kept.mapInArrow(run, "id long, v binary, norm double"))


def as_bytes(matrix: np.ndarray) -> pa.Array:
    """Each row's components one after another, little-endian."""
    data = np.ascontiguousarray(matrix, matrix.dtype.newbyteorder("<"))
    offsets = np.arange(len(data) + 1, dtype=np.int32) * np.int32(data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def joined_bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The bytes of all values, one after another."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]


def as_rows(data: np.ndarray, n: int, dimension: int) -> np.ndarray:
    """``n`` vectors from their bytes."""
    return data.view("<f4" if len(data) == 4 * n * dimension else "<f8").reshape(n, dimension)


def matrix_of(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    return as_rows(joined_bytes(column), len(column), dimension).astype(np.float64)


def directions(matrix: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return matrix / np.where(norms > 0, norms, 1.0)[:, None]


def joining_angle(threshold: float, norms: float) -> float:
    """The greatest angle of a pair at the threshold whose norms' product is ``norms`` at most; beyond pi nothing is bounded."""
    if threshold <= 0:
        return 2 * math.pi
    return math.acos(min(1.0, threshold / norms)) + ROOM if norms > 0 else 0.0


def angles(dots: np.ndarray) -> np.ndarray:
    return np.arccos(dots.clip(-1, 1))


def cosines(batch: pa.RecordBatch, pivots: np.ndarray) -> np.ndarray:
    return directions(matrix_of(batch.column("v"), pivots.shape[1]), batch.column("norm").to_numpy()) @ pivots.T


def reachable(dots: np.ndarray, between: np.ndarray, ends: np.ndarray, angle: float) -> np.ndarray:
    """row x cell: whether the cell can hold a partner of a row with these cosines to the pivots.

    ``between`` are the distances of pivots in space, ``ends`` the least and the greatest angle in each cell.
    """
    own = angles(dots)
    can = (own >= ends[0] - angle - ROOM) & (own <= ends[1] + angle + ROOM)
    if angle < math.pi / 2:
        home = dots.argmax(axis=1)
        beyond = dots[np.arange(len(dots)), home][:, None] - dots
        can &= beyond <= between[home] * math.sin(angle) + ROOM
    return can


def pivots_of(right: DataFrame, dimension: int, n: int, cell: int, most: int) -> np.ndarray:
    """Directions of some of the ``n`` right rows, chosen by a hash."""
    sample = right.where("norm > 0").orderBy(F.xxhash64("id", "v")).limit(min(most, max(FEWEST, -(-n // cell)))).select("v", "norm").toArrow()  # at most `most` rows
    found = directions(matrix_of(sample["v"], dimension), sample["norm"].to_numpy())
    return found if len(found) else np.zeros((1, dimension))


def distances(pivots: np.ndarray) -> np.ndarray:
    return np.array([np.sqrt(((pivots - x) ** 2).sum(axis=1)) for x in pivots])


class Cells:
    """Pivots, and the right side's rows in their cells."""

    def __init__(self, right: DataFrame, dimension: int, cell: int, most: int = MOST, pivots: np.ndarray | None = None):
        self.dimension = dimension
        self.pivots = p = pivots_of(right, dimension, right.count(), cell, most) if pivots is None else pivots
        self.between = distances(p)
        self.rows = self._placed(right)
        found = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("greatest")).collect()  # a row a cell
        self.counts, self.ends = np.zeros(len(p), np.int64), np.array([np.full(len(p), np.inf), np.full(len(p), -np.inf)])
        for r in found:
            self.counts[r["cell"]], self.ends[:, r["cell"]] = r["n"], (r["least"], r["greatest"])

    def _placed(self, right: DataFrame) -> DataFrame:
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dots = cosines(batch, pivots)
                cell = dots.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(angles(dots[np.arange(len(cell)), cell]))], ["id", "v", "cell", "angle"])

        # the angle decides what is copied where, so the table that it is read from twice is written
        return _written(right.mapInArrow(run, "id long, v binary, cell int, angle double"))

    def copies(self, left: DataFrame, angle: float) -> DataFrame:
        """id, v and cell of the left rows, for each cell that can hold a partner."""
        pivots, between, ends = self.pivots, self.between, self.ends

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 1024):
                    part = batch.slice(at, 1024)
                    row, cell = np.nonzero(reachable(cosines(part, pivots), between, ends, angle))
                    for first in range(0, len(row), 8192):
                        s = slice(first, first + 8192)
                        yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row[s])), part.column("v").take(pa.array(row[s])), pa.array(cell[s].astype(np.int32))], ["id", "v", "cell"])

        return left.mapInArrow(run, "id long, v binary, cell int")


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worth_cells(left: DataFrame, rows: tuple[int, int], pivots: np.ndarray, angle: float, tiles: tuple[int, int]) -> bool:
    """Whether the borders of cells leave no more than twice as many copies of rows as tiles of whole sides make.

    Judged by some left rows, chosen by a hash, and without the rings; what is found changes the work and never the pairs.
    """
    some = left.orderBy(F.xxhash64("id", "v")).limit(1024).select("v", "norm").toArrow()
    dots = directions(matrix_of(some["v"], pivots.shape[1]), some["norm"].to_numpy()) @ pivots.T
    ends = np.array([np.zeros(len(pivots)), np.full(len(pivots), math.pi)])
    cells = reachable(dots, distances(pivots), ends, angle).sum(axis=1).mean() if len(dots) else 0.0
    return rows[0] * cells + rows[1] <= 2 * (rows[0] * tiles[1] + rows[1] * tiles[0])


def meeting(threshold: float, dimension: int, screen: type):
    """A function of batches of tile pairs that gives batches of the pairs of rows at the threshold."""
    # either way of summing is off by this share of the norms' product, in the screening's own rounding
    share = vectors.slack(dimension) * (2.0**29 if screen is np.float32 else 1.0)

    def pairs(ours: tuple, theirs: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        (ids, a), (others, b) = ours, theirs
        norms = [np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)) for m in (a, b)]
        for first in range(0, len(b), BLOCK[1]):
            right = b[first : first + BLOCK[1]]
            across, longest = np.ascontiguousarray(right.astype(screen).T), norms[1][first : first + BLOCK[1]].max()
            for at in range(0, len(a), BLOCK[0]):
                left = a[at : at + BLOCK[0]]
                # a little room below covers what is too small for float32
                least = threshold - share * norms[0][at : at + BLOCK[0]] * longest - (1e-20 if screen is np.float32 else 0.0)
                least = np.nextafter(least.astype(screen), screen(-np.inf))
                row, column = np.divmod(np.flatnonzero(left.astype(screen) @ across >= least[:, None]), len(right))
                for s in (slice(i, i + PAIRS) for i in range(0, len(row), PAIRS)):
                    score = vectors.sums_in_order(left[row[s]].astype(np.float64) * right[column[s]].astype(np.float64))
                    good = score >= threshold
                    yield ids[row[s][good] + at], others[column[s][good] + first], score[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for k in range(len(batch)):
                sides = []
                for side in ("left", "right"):
                    ids = joined_bytes(batch.column(f"{side}_ids").slice(k, 1)).view("<i8")
                    sides.append((ids, as_rows(joined_bytes(batch.column(f"{side}_v").slice(k, 1)), len(ids), dimension)))
                for some in pairs(*sides):
                    found.append(some)
                    n += len(some[0])
                    if n >= PAIRS:
                        yield result(found)
                        found, n = [], 0
        if n:
            yield result(found)

    def result(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["left_id", "right_id", "score"])

    return run


def side_by_side(ours: pa.Table, theirs: pa.Table) -> pa.Table:
    """A row of two tiles: the bytes of ids and vectors of either side; none where a side has no rows."""
    names = [f"{side}_{what}" for side in ("left", "right") for what in ("ids", "v")]
    if not (len(ours) and len(theirs)):
        return pa.table([pa.array([], pa.binary())] * 4, names)
    parts = [x for t in (ours, theirs) for x in (np.ascontiguousarray(t["id"].to_numpy(), "<i8").view(np.uint8), joined_bytes(t["v"]))]
    return pa.table([as_bytes(x[None]) for x in parts], names)


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, dimension: int, tile: int | None = None, most_pivots: int = MOST) -> DataFrame:
    """left_id, right_id, score of the pairs of rows (id, embedding) whose inner product reaches the threshold."""
    left, right = points(left, dimension), points(right, dimension)
    about = [df.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0)), F.coalesce(F.max(F.length("v")), F.lit(1))).first() for df in (left, right)]
    rows, norms = [x[0] for x in about], [x[1] for x in about]
    angle = joining_angle(threshold, norms[0] * norms[1])
    tile = tile or max(1, TILE_BYTES // max(x[2] for x in about))
    # how many tiles each cell has on either side
    tiles = [np.array([max(1, -(-n // tile), min(TILES, -(-n // CELL)))]) for n in rows]
    pivots = pivots_of(right, dimension, rows[1], min(tile, CELL), most_pivots)
    if worth_cells(left, rows, pivots, angle, (tiles[0][0], tiles[1][0])):
        cells = Cells(right, dimension, min(tile, CELL), most_pivots, pivots)
        left, right = cells.copies(left, angle), cells.rows
        counts = np.zeros(len(cells.counts), np.int64)
        for r in left.groupBy("cell").count().collect():  # a row a cell
            counts[r["cell"]] = r["count"]
        tiles = [np.maximum(1, -(-c // tile)) for c in (counts, cells.counts)]
    else:
        left, right = (df.withColumn("cell", F.lit(0)) for df in (left, right))
    tiles = [F.get(F.lit([int(n) for n in c]), F.col("cell")) for c in tiles]

    def dealt(df: DataFrame, own: int) -> DataFrame:
        mine, other = ("left_tile", "right_tile") if own == 0 else ("right_tile", "left_tile")
        # in a step of its own: beside the explode, Spark numbers the copies and not the rows
        numbered = df.select("id", "v", "cell", F.pmod(F.monotonically_increasing_id(), tiles[own]).cast("int").alias(mine))
        return numbered.select("*", F.explode(F.sequence(F.lit(0), tiles[1 - own] - 1)).alias(other))

    keys = ("cell", "left_tile", "right_tile")
    together = dealt(left, 0).groupBy(*keys).cogroup(dealt(right, 1).groupBy(*keys)).applyInArrow(side_by_side, "left_ids binary, left_v binary, right_ids binary, right_v binary")
    screen = np.float32 if max(norms) <= LONGEST else np.float64
    return together.mapInArrow(meeting(threshold, dimension, screen), "left_id long, right_id long, score double")


def vector_classes(rows: DataFrame) -> DataFrame:
    """id and class_id, the least id with the same vector: the rows to join are those where both are equal."""
    firsts = rows.where("embedding is not null").groupBy("embedding").agg(F.min("id").alias("class_id"))
    return rows.join(firsts, "embedding").select("id", "class_id")
