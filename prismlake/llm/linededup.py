"""Line dedup: repeated runs of lines by a distributed suffix array, later copies deleted.

Lines are told by two 64-bit hashes and numbered. A run of consecutive lines with at least ``min_words`` words that stood earlier, in
order of (doc_id, line), is deleted where it stands later. Repeated runs are the intervals of the suffix
array whose suffixes share a prefix of that many words.

Suffix array: prefix doubling over ranks, from the numbers of repeated lines (any order serves as the alphabet's). Ranks of runs of 2**(k+1) lines are those of the pairs (rank of the
first half, rank of the second half), made by a range-partitioned sort of the distinct pairs, so that ranks
keep the suffixes' order. A run that stands only once can't be part of a repeated run and is discarded after
each round, and a line outside any stretch of repeated lines with ``min_words`` words before the first.

How deep: a line is in a later copy of a repeated run if and only if it is in a later copy of a *minimal*
one, that is one which loses the words needed if its last line, or its first, goes. (Take a copied run with
enough words and a line p in it. If the lines from the run's start to p have enough words, the minimal run
ending at p lies inside; if not, the minimal run from the start reaches beyond p and lies inside.) So
doubling stops at the longest minimal run, and the interval with a common prefix of m lines, m between 2**k
and 2**(k+1), is the set of suffixes with equal ranks (k, at i) and (k, at i + m - 2**k): two ranks of one level that
overlap say whether the longest common prefix reaches m lines, so the array needs no walk along its order. The
interval's least position is the first copy. Later copies that go on with the same distance to their first copies are
one maximal run, whose length is the longest common prefix of both places as far as these are first copies. A line's
first appearance is never in a later copy, so no line is lost from the corpus, also where copies overlap. All groups
are pre-aggregated; no task gathers one, and what a hot line is joined with is a written table, so the join can be split.

Defined cases: a null text stays null, an empty one empty; lines are parted by line feeds; a text that loses
all its lines becomes empty; the rest of a text keeps its bytes; rows with one doc_id and different texts are
told apart and ordered by a hash of the text, and equal rows count as one document and are treated alike; a
row without a doc_id is kept as it is; an empty table gives no rows; all other columns are kept as they are, but for
columns named as the new ones (n_lines, removed_lines, copies), which these replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismlake.llm import textops
from prismlake.llm.session import table, tidy, written

MIN_WORDS = 50
_U = np.uint64

NOT_FEED = np.ones(256, dtype=bool)
NOT_FEED[10] = False


def lines_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of every line (empty ones too) and the number of lines before each text."""
    feeds = np.flatnonzero(data == 10)
    per = np.searchsorted(feeds, offs)
    n = np.diff(per) + 1
    before = np.concatenate([[0], np.cumsum(n)])
    starts, ends = np.empty(before[-1], np.int64), np.empty(before[-1], np.int64)
    starts[before[:-1]] = offs[:-1]
    ends[before[1:] - 1] = offs[1:]
    owner = np.repeat(np.arange(len(n)), n - 1)
    inner = np.arange(len(feeds)) + owner  # each text has one line more than feeds
    ends[inner] = feeds
    starts[inner + 1] = feeds + 1
    return starts, ends, before


def line_table(docs: DataFrame) -> DataFrame:
    """doc (doc_id, text_hash), and for each text its lines' two hashes and word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in textops.by_chunk(batches):
            starts, ends, before = lines_of(data, offs)
            one, two = (textops.hash_spans(data, starts, ends, seed=seed).view(np.int64) for seed in (1, 2))
            heads, _, _ = textops.words(data, offs, textops.NON_SPACE)
            n_words = np.searchsorted(heads, ends) - np.searchsorted(heads, starts)
            bounds = pa.array(before, pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(one), pa.array(two), pa.array(n_words, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *lists], ["doc_id", "text_hash", "one", "two", "n_words"])

    rows = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text")).alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, text_hash long, one array<long>, two array<long>, n_words array<int>")


def minimal_runs(n_words: list[int], least: int) -> list[tuple[int, int]]:
    """(start, length) of the runs with ``least`` words that lose them without their last or without their first line."""
    total = np.concatenate([[0], np.cumsum(np.asarray(n_words, np.int64))])
    n = len(n_words)
    end = np.searchsorted(total, total[:-1] + least)  # first end with enough words from each start
    start = np.searchsorted(total, total[1:] - least, side="right") - 1  # last start with enough words to each end
    a, b = np.flatnonzero(end <= n), np.flatnonzero(start >= 0)
    runs = np.concatenate([np.stack([a, end[a] - a], 1), np.stack([start[b], b + 1 - start[b]], 1)])
    return [tuple(x) for x in np.unique(runs, axis=0).tolist()] if len(runs) else []


def stretches(lines: DataFrame, least: int) -> DataFrame:
    """doc_id, text_hash, line, rank, n_words of repeated lines in stretches of repeated lines with enough words."""
    flat = lines.select("doc_id", "text_hash", F.posexplode(F.arrays_zip("one", "two", "n_words")).alias("line", "x")).select("doc_id", "text_hash", "line", "x.*")
    repeated = flat.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated.select("one", "two", F.monotonically_increasing_id().alias("rank")))  # written, the numbers stay
    flat = flat.join(repeated, ["one", "two"])
    doc = Window.partitionBy("doc_id", "text_hash")
    flat = flat.withColumn("stretch", F.col("line") - F.row_number().over(doc.orderBy("line")))
    return flat.withColumn("total", F.sum("n_words").over(Window.partitionBy("doc_id", "text_hash", "stretch"))).where(F.col("total") >= least)


def double(level: DataFrame, half: int) -> DataFrame:
    """Ranks of runs of 2 * ``half`` lines that stand more than once, from those of ``half`` lines."""
    key = ["doc_id", "text_hash"]
    second = level.select(*key, (F.col("line") - half).alias("line"), F.col("rank").alias("rank2"))
    pairs = written(level.select(*key, "line", F.col("rank").alias("rank1")).join(second, [*key, "line"]))
    ranks = pairs.groupBy("rank1", "rank2").agg(F.count("*").alias("n")).where("n > 1").select("rank1", "rank2")
    # sorted in range partitions, the row's number is a rank that keeps the order; written, it stays the same
    ranks = written(ranks.repartitionByRange("rank1", "rank2").sortWithinPartitions("rank1", "rank2").select("rank1", "rank2", F.monotonically_increasing_id().alias("rank")))
    return written(pairs.join(ranks, ["rank1", "rank2"]).select(*key, "line", "rank"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, start, length of the minimal runs that are later copies, and the place (doc_id, text_hash, start) of their first copy."""
    key = ["doc_id", "text_hash"]
    lines = written(line_table(docs).dropDuplicates(key))
    kept = written(stretches(lines, min_words).select(*key, "line", "rank", "n_words", "stretch"))

    @F.udf("array<struct<start:int,length:int>>", useArrow=True)
    def runs_of(n_words):  # once per stretch
        return minimal_runs(n_words, min_words)

    groups = kept.groupBy(*key, "stretch").agg(F.min("line").alias("first"), F.sort_array(F.collect_list(F.struct("line", "n_words"))).alias("x"))
    runs = groups.select(*key, "first", F.explode(runs_of("x.n_words")).alias("r"))
    k = F.floor(F.log2(F.col("r.length"))).cast("int")
    runs = written(runs.select(*key, (F.col("first") + F.col("r.start")).alias("start"), F.col("r.length").alias("length"), k.alias("k")))
    depth = runs.agg(F.max("k")).first()[0]
    if depth is None:
        return runs.select(*key, "start", "length", F.struct(*key, "start").alias("place"))
    level = kept.select(*key, "line", "rank")
    levels = level.withColumn("k", F.lit(0))
    for step in range(depth):
        level = double(level, 1 << step)
        levels = levels.unionByName(level.withColumn("k", F.lit(step + 1)))

    head = levels.select(*key, F.col("line").alias("start"), "k", F.col("rank").alias("head"))
    tail = levels.select(*key, F.col("line").alias("tail_at"), "k", F.col("rank").alias("tail"))
    shift = F.col("start") + F.col("length") - F.expr("shiftleft(1, k)")
    named = runs.join(head, [*key, "start", "k"]).withColumn("tail_at", shift).join(tail, [*key, "tail_at", "k"])
    named = written(named.select(*key, "start", "length", "head", "tail"))
    place = F.struct("doc_id", "text_hash", "start")
    firsts = named.groupBy("length", "head", "tail").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(written(firsts), ["length", "head", "tail"]).where(place > F.col("place")).select(*key, "start", "length", "place")


def maximal(runs: DataFrame) -> DataFrame:
    """Runs that go on with the same distance to their first copies as one: doc_id, text_hash, start, length, from_doc, from_start."""
    key = ["doc_id", "text_hash"]
    source = [F.col("place.doc_id").alias("from_doc"), F.col("place.text_hash").alias("from_hash"), (F.col("place.start") - F.col("start")).alias("shift")]
    runs = runs.select(*key, *source, "start", (F.col("start") + F.col("length")).alias("end"))
    along = Window.partitionBy(*key, "from_doc", "from_hash", "shift").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(along))
    runs = runs.groupBy(*key, "from_doc", "from_hash", "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.select(*key, "start", (F.col("end") - F.col("start")).alias("length"), "from_doc", (F.col("start") + F.col("shift")).alias("from_start"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies deleted from ``text``, and n_lines, removed_lines (array of line numbers from 0) and
    copies (array of the maximal repeated runs: start, length, and from_doc and from_start of the copy that stays)."""
    runs = written(maximal(repeated_runs(docs, min_words)))
    key = ["doc_id", "text_hash"]
    sources = runs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "length", "from_doc", "from_start"))).alias("__copies"))  # at most one for each of its lines
    gone = runs.select(*key, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("line")).distinct()
    gone = gone.groupBy(*key).agg(F.sort_array(F.collect_list("line")).alias("__gone")).join(sources, key).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    # a merge join at every size: what a small table would save by broadcasting tells nothing about a large one
    rows = docs.withColumn("__text_hash", F.xxhash64("text")).join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    removed = F.coalesce("__gone", F.array().cast("array<int>"))

    @F.udf("string", useArrow=True)
    def without(text, gone):
        if not gone:
            return text
        drop = set(gone)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)

    # not to be evaluated again for what is asked of the new texts, as by a filter on them: each evaluation in a stage is a
    # worker more for each task, and every idle worker of an executor holds what it last loaded
    without = without.asNondeterministic()
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    copies = F.coalesce("__copies", F.array().cast("array<struct<start:int,length:int,from_doc:bigint,from_start:int>>"))
    return rows.withColumns({"text": without("text", "__gone"), "n_lines": n_lines.cast("long"), "removed_lines": removed, "copies": copies}).drop("__id", "__hash", "__text_hash", "__gone", "__copies")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.array_distinct("copies.from_doc").alias("copied_from"), "copies")
