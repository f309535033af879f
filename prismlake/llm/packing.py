"""Best-fit packing of token sequences, planned over a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces of each length (at most
``capacity`` numbers) reaches the driver, where best fit decreasing runs over counts: equal bins stay one
entry. Each planned entry says where the pieces of one length with ranks in a range go, and every piece
finds its slot by joining on its rank within its length. The rank needs no sort: each task numbers its
pieces of each length, and the offsets of the tasks are summed afterwards, so that a length which holds a
third of all pieces is no hot key.

Defined cases: null or empty text has only the end token; repeated rows are packed each for itself; an
empty table gives no rows; extra columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from prismlake.llm.session import table, tidy, written

CAPACITY = 1024
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"
SLOTS = T.StructType([T.StructField(n, T.LongType(), False) for n in ("slot_length", "rank_from", "rank_to", "first_sequence", "per_sequence", "slot_offset")])


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library as little-endian unsigned 32-bit bytes.

    The merges run in tiktoken with the file's own vocabulary, which gives the same ids in a third of the
    time; what it refuses (runs of white space beyond its regex engine) goes to the tokenizers library.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken
        from tokenizers import pre_tokenizers

        self.path, self.other = path, None
        described = json.loads(Path(path).read_text(encoding="utf-8"))
        vocabulary = described["model"]["vocab"]
        byte_of = {c: b for b, c in byte_characters(sorted(pre_tokenizers.ByteLevel.alphabet())).items()}
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        # the pre-tokenizer's fixed pattern
        self.pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.cut = re.compile("|".join(map(re.escape, special))) if special else None

    def plain(self, text: str) -> bytes:
        try:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        except BaseException as error:  # its panics aren't Exceptions
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.slowly(text)

    def slowly(self, text: str) -> bytes:
        if self.other is None:
            from tokenizers import Tokenizer

            self.other = Tokenizer.from_file(self.path)
        return np.array(self.other.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


def byte_characters(alphabet: list[str]) -> dict[int, str]:
    """The printable character that stands for each byte in such files: itself if it is in the alphabet, else the next one from 256 on."""
    own = {ord(c): c for c in alphabet if ord(c) < 256}
    rest = [c for c in alphabet if ord(c) >= 256]
    return own | dict(zip((b for b in range(256) if b not in own), rest, strict=True))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece, with the task that made it and the piece's rank among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, task = Encoder(tokenizer), np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank")
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts.

    Returns (length, rank_from, rank_to, first_sequence, per_sequence, offset): the pieces of ``length``
    with ranks in [rank_from, rank_to) go, ``per_sequence`` at a time, to sequences from
    ``first_sequence`` on, from ``offset`` there.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of equal bins: first sequence, how many
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                each = capacity // length
                first, many, room = sequences, -(-left // each), capacity
                sequences += many
            else:
                each = room // length
                first, many = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            used = min(many, -(-left // each))
            if used < many:
                open_bins.setdefault(room, []).append((first + used, many - used))
            take = min(left, used * each)
            slots.append((length, rank, rank + take, first, each, capacity - room))
            rest = take - (used - 1) * each  # in the last bin of the run
            whole = used if rest == each else used - 1
            for start, n, inside in ((first, whole, each), (first + whole, used - whole, rest)):
                if n and room - inside * length:
                    open_bins.setdefault(room - inside * length, []).append((start, n))
            left, rank = left - take, rank + take
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``length``, ``task`` and ``local_rank``.

    The planned slots are broadcast: their number depends on the capacity alone (each length splits at most one
    run of equal bins, so 1024 lengths give some thousands of rows), not on the documents. The offsets of tasks
    are joined as Spark sees fit.
    """
    spark = pieces.sparkSession
    per_task = pieces.groupBy("task", "length").agg(F.max("local_rank").alias("most"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum(F.col("most") + 1).over(before), F.lit(0)).alias("rank_base"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum(F.col("most") + 1).alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity), SLOTS)
    ranked = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("rank_base") + F.col("local_rank"))
    inside = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    at = F.col("rank") - F.col("rank_from")
    return ranked.join(F.broadcast(slots), inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + at % F.col("per_sequence") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Encodes, cuts and packs ``docs`` (doc_id, text)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(written(pieces(docs, tokenizer, capacity, end_id)), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
