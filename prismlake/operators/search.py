"""The search plan: scan, filters, text, faces, score, top k.

One plan of Spark operators: filters reach the scan, the vector column is read only if it is scored, top k
is a heap for each partition and a merge. Sides that grow with the library are joined, never broadcast by hand.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.functions import faces as face_functions
from prismlake.functions import text, vectors
from prismlake.functions.scalars import filter_time, rank_time
from prismlake.operators import pivots
from prismlake.operators.store import Derived, valid_children
from prismlake.plans.query import Filters, Query
from prismlake.schemas import FACE_MODEL, TEXT_MODEL
from prismlake.sources.tables import Store


#: Bytes of query vectors that a worker holds at once.
BLOCK_BYTES = 64 << 20
#: Blocks of a stated query set at most.
MOST_BLOCKS = 4


def candidates(media: DataFrame, filters: Filters) -> DataFrame:
    """Photos within the half-open dates, of the type, and indexed unless only text counts."""
    rows = media
    if filters.start_millis is not None:
        rows = rows.where(filter_time() >= filters.start_millis)
    if filters.end_millis is not None:
        rows = rows.where(filter_time() < filters.end_millis)
    if filters.media_type is not None:
        rows = rows.where(F.col("mediaType") == filters.media_type)
    if filters.mode == "OCR":
        return rows.drop("embedding")
    return rows.where(F.col("embeddingDimension") > 0)


def page(media: DataFrame, filters: Filters, limit: int, offset: int) -> DataFrame:
    """A page of candidates in id order, for callers that page; searches scan once instead."""
    return candidates(media, filters).orderBy("mediaId").offset(offset).limit(limit)


def words_of(photo_text: DataFrame) -> DataFrame:
    """A posting for each distinct word of each text, with the text's revision and model: the full-text index."""
    state = [c for c in ("dateModified", "modelVersion") if c in photo_text.columns]
    return photo_text.select("mediaId", *state, F.explode(text.tokens(F.col("searchText"))).alias("word"))


class TextIndex:
    """The full-text index as a kept table (D12): postings in files sorted by word, made of the folded texts.

    ``postings`` reads only the row groups of the words that are asked for, by their statistics. Postings lie in buckets
    by photo as all tables of a ``Store`` and follow ``photo_text`` (``derived``), so a change of photos or texts puts
    them into the version that has it.
    """

    NAME = "text_postings"
    derived = Derived(NAME, "photo_text", words_of)

    def __init__(self, tables: Store):
        self.tables = tables

    def rebuilt(self, photo_text: DataFrame) -> dict[str, DataFrame]:
        """The table to publish with new or changed texts (of whole buckets)."""
        return {self.NAME: words_of(photo_text)}

    def postings(self, words: Sequence[str]) -> DataFrame:
        return self.tables.read(self.NAME).where(F.col("word").isin(list(words)))

    def matches(self, words: Sequence[str], media: DataFrame | None = None, model: str = TEXT_MODEL) -> DataFrame:
        """Ids of photos whose text has every word; with ``media``, of texts of the model and the photo's revision only."""
        found = self.postings(words)
        return text_matches_by_postings(found if media is None else valid_children(found, media, model), words)


def text_matches(photo_text: DataFrame, media: DataFrame, words: Sequence[str], model: str = TEXT_MODEL) -> DataFrame:
    """Ids of photos whose valid text has every word."""
    valid = valid_children(photo_text, media, model)
    return valid.where(text.has_all(text.tokens(F.col("searchText")), words)).select("mediaId")


def text_matches_by_postings(postings: DataFrame, words: Sequence[str]) -> DataFrame:
    """X1 over ``words_of``: the words' postings are met before any text is."""
    some = postings.where(F.col("word").isin(list(words)))
    return some.groupBy("mediaId").agg(F.count_distinct("word").alias("n")).where(F.col("n") == len(set(words))).select("mediaId")


def face_lists(faces: DataFrame, face_index: DataFrame, media: DataFrame, model: str = FACE_MODEL) -> DataFrame:
    """The valid faces of each photo as an array in their order."""
    scanned = valid_children(face_index, media, model).select("mediaId")
    rows = faces.join(scanned, "mediaId", "left_semi")
    return rows.groupBy("mediaId").agg(F.transform(F.sort_array(F.collect_list(F.struct("faceIndex", "embedding"))), lambda f: f["embedding"]).alias("faces"))


def relevance() -> list[Column]:
    """O1: a total order."""
    return [F.desc("textMatch"), F.desc("rawSimilarity"), rank_time().desc(), F.desc("mediaId")]


def chronology(newest: bool) -> list[Column]:
    """O2."""
    return [rank_time().desc(), F.desc("mediaId")] if newest else [rank_time().asc(), F.asc("mediaId")]


def ranked(rows: DataFrame, filters: Filters, limit: int) -> DataFrame:
    """The k most relevant, then by date; for text searches the k first by date."""
    if filters.sort == "MOST_RELEVANT":
        return rows.orderBy(*relevance()).limit(limit)
    order = chronology(filters.sort == "NEWEST_FIRST")
    if filters.mode == "OCR":
        return rows.orderBy(*order).limit(limit)
    return rows.orderBy(*relevance()).limit(limit).orderBy(*order)


def search(media: DataFrame, query: Query, photo_faces: DataFrame | None = None, text_ids: DataFrame | None = None) -> DataFrame:
    """V5: photos with rawSimilarity and textMatch, best first.

    ``photo_faces`` comes from ``face_lists``, ``text_ids`` from ``text_matches``. Cheap filters stand first,
    faces are matched before vectors are scored, and only photos that pass are.
    """
    filters = query.filters
    rows = candidates(media, filters)
    if query.limit <= 0:
        rows = rows.where("false")
    text_match = F.lit(False)
    if filters.mode == "OCR":
        if text_ids is None:
            raise ValueError("text search needs the ids of matching texts")
        rows, text_match = rows.join(text_ids, "mediaId", "left_semi"), F.lit(True)
    if query.vector is not None:
        rows = rows.where(F.col("embeddingDimension") == len(query.vector))  # P9, before sizes can differ
    face_score = F.lit(None).cast("double")
    if query.people:
        if photo_faces is None:
            raise ValueError("face search is unavailable")
        match = face_functions.match_one(query.people[0], query.face_threshold) if len(query.people) == 1 else face_functions.match_all(query.people, query.face_threshold)
        # only faces of photos that passed so far are matched
        photo_faces = photo_faces.join(rows.select("mediaId"), "mediaId", "left_semi")
        matched = photo_faces.where(F.size("faces") >= len(query.people)).select("mediaId", match(F.col("faces")).alias("_face")).where("_face is not null")
        rows, face_score = rows.join(matched, "mediaId"), F.col("_face")
    if query.vector is not None:
        score = vectors.dot(F.col("embedding"), vectors.literal(query.vector))
    else:
        score = F.coalesce(face_score, F.lit(0.0))  # V8
    rows = rows.withColumns({"rawSimilarity": score, "textMatch": text_match})
    return ranked(rows, filters, query.limit).drop("embedding", "_face")


@dataclass(frozen=True)
class Provider:
    """U4: where a deployment's candidates and faces come from: functions that give them for filters and for photos."""

    media: Callable[[Filters], DataFrame]
    faces: Callable[[DataFrame], DataFrame] | None = None
    text_ids: Callable[[Sequence[str]], DataFrame] | None = None

    def search(self, query: Query) -> DataFrame:
        """``search`` over what the functions give; faces and texts are asked for only where the query has any."""
        rows = self.media(query.filters)
        faces = self.faces(rows.select("mediaId")) if query.people and self.faces else None
        ids = self.text_ids(query.words) if query.words and self.text_ids else None
        return search(rows, query, faces, ids)


def with_position(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Numbers at most some hundreds of rows, for outputs that must show their order."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def still_there(results: DataFrame, library: DataFrame) -> DataFrame:
    """Results whose photo is still in the library at the same revision; after the limit, so there may be fewer."""
    return results.join(library.select("mediaId", "dateModified"), ["mediaId", "dateModified"], "left_semi")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, dimension: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of unit vectors (id, embedding) with a dot product of at least ``threshold``.

    For a stated query set on the left: it goes to the workers as a matrix, in blocks of about ``block_bytes``, and
    each batch of the right is one matrix product with it. The right is read where it lies, once for each block,
    and never shuffled. A left side of more than ``MOST_BLOCKS`` blocks is no such set: it is joined by pivots, where neither
    side comes to the driver.
    """
    ours = left.where(F.size("embedding") == dimension).select(F.col("id").cast("long").alias("id"), vectors.as_doubles(F.col("embedding")).alias("v"))
    theirs = right.where(F.size("embedding") == dimension).select(F.col("id").cast("long"), vectors.as_doubles(F.col("embedding")).alias("v"))
    blocks = max(1, math.ceil(ours.count() * 8 * (dimension + 1) / block_bytes))
    if blocks > MOST_BLOCKS:
        return pivots.similarity_join(left, right, threshold, dimension)
    out = None
    for k in range(blocks):
        rows = ours.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()  # about `block_bytes`
        ids, matrix = rows["id"].to_numpy(), vectors.as_matrix(rows["v"].combine_chunks(), dimension)
        held = left.sparkSession.sparkContext.broadcast((ids, np.ascontiguousarray(matrix.T)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            for batch in batches:
                scores = vectors.as_matrix(batch.column("v"), dimension) @ matrix
                row, column = np.nonzero(scores >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids[column]), pa.array(batch.column("id").to_numpy()[row]), pa.array(scores[row, column])], ["left_id", "right_id", "score"])

        found = theirs.mapInArrow(run, "left_id long, right_id long, score double")
        out = found if out is None else out.unionByName(found)
    return out
