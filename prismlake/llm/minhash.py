"""Near duplicates by DartMinHash signatures, banded joining and exact verification.

Elements are a text's distinct shingles of five words (A-Z lower-cased), weighing 1 each or, with ``counted``, as often
as they stand in the text. Each element throws darts: a
Poisson process over (weight, rank) seeded by the element alone, cut into regions of doubling weight. A text
keeps the darts inside its elements' weights with rank up to a bound that falls with its total weight, so it
looks at about t * ln(t) darts whatever its size; each dart belongs to one of ``t`` coordinates, and the
earliest per coordinate is the signature. Equal coordinates have the weighted Jaccard similarity as their
probability. The query gives every distinct shingle weight 1, so that this is the plain Jaccard similarity. Weights
that are counts make it the Jaccard similarity of multisets: exact verification and the filters below work on
sets, so there a shingle that stands three times is three elements (shingle, copy).

Equal word sequences are one class first. Signatures of the classes are cut into bands; a bucket is a band
with its values. No bucket is expanded into all its pairs:

1. in each bucket the member with the most bucket mates is the hub, and only hub-member pairs are verified by
   exact Jaccard similarity;
2. connected components over the verified links (min-label propagation with pointer jumping);
3. members of a bucket in another component than its hub (outsiders) are still held against the bucket's
   other members outside their component, by prefix filtering: the members' shingles are ordered with those
   that the hub lacks first (the rare ones), two sets at the threshold must share one of their first
   ``n - ceil(threshold * n) + 1``, and the places where they share it bound the overlap. Besides, two sets at the
   threshold must share enough of what tells each from the hub, and a bitmap of these differences bounds that
   from above. In a family of copies each of which was changed elsewhere, few pairs pass both bounds. What is
   left is verified exactly, and components are taken again.

Every pair of a bucket is thus in one component, verified, or excluded exactly.

With 30 bands of 5 values a pair at similarity 0.8 shares no bucket with probability 7e-6.

Defined cases: a text of fewer than five words, but not none, has one shingle of all its words; texts
without words (null, empty, signs only) are never near duplicates and each is its own class; rows that
repeat a doc_id and its words fall in one class; rows with one doc_id and different texts are classed each for
itself; a class is named by its least doc_id; a null doc_id comes after all others, so it names no class with
others; word sequences and shingles are told by 64-bit hashes; an empty table gives no rows; extra columns are ignored;
very long texts are hashed in one piece of memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import textops
from prismlake.llm.session import table, tidy, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
#: Bits of the bitmaps of differences, a multiple of 64.
BITS = 256
_U = np.uint64


def uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1] from 64-bit hashes."""
    return ((h >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Earliest rank per coordinate of each weighted set; sets are runs of ``elements`` between ``bounds``.

    Returns sets x t ranks (infinite for empty sets). An element's darts depend on it alone, which makes equal
    ranks of two sets mean the same dart.
    """
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    totals = np.bincount(owner, weights, n) if len(owner) else np.zeros(n)
    out = np.full(n * t, np.inf)
    reach = np.zeros(n)  # ranks up to here are thrown
    open_sets = np.flatnonzero(totals > 0)
    bound = np.zeros(n)
    bound[open_sets] = (np.log(t) + 2.0) / totals[open_sets]
    while len(open_sets):
        active = np.zeros(n, bool)
        active[open_sets] = True
        rows = np.flatnonzero(active[owner])
        low, region = 0.0, 0
        while len(rows):
            high = 1.0 if region == 0 else 2.0**region
            rows = rows[weights[rows] > low]
            at, h = rows, textops.mix(elements[rows] ^ _U(region * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
            rank, step = np.zeros(len(rows)), 0
            while len(at):
                step += 1
                h = textops.mix(h)
                rank = rank - np.log(uniform(h)) / (t * (high - low))
                keep = np.flatnonzero(rank <= bound[owner[at]])
                at, h, rank = at[keep], h[keep], rank[keep]
                where = textops.mix(h ^ _U(0x5851F42D4C957F2D))
                inside = np.flatnonzero((low + uniform(textops.mix(where)) * (high - low) <= weights[at]) & (rank > reach[owner[at]]))
                np.minimum.at(out, owner[at[inside]] * t + (where[inside] % _U(t)).astype(np.int64), rank[inside])
            low, region = high, region + 1
        empty = np.isinf(out.reshape(n, t)[open_sets]).any(axis=1)
        reach[open_sets] = bound[open_sets]
        open_sets = open_sets[empty]
        bound[open_sets] *= 2
    return out.reshape(n, t)


def distinct_shingles(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, how often each stands there, their bounds, and a hash of each text's word sequence (0: no words)."""
    low = textops.LOWER[data]
    starts, ends, before = textops.words(low, offs, textops.ALNUM)
    hashes = textops.hash_spans(low, starts, ends)
    found, bounds = textops.shingles(hashes, before, n)
    parts = [np.unique(found[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    place = textops.mix(hashes + np.arange(len(hashes), dtype=_U) - np.repeat(before[:-1], np.diff(before)).astype(_U))
    sums = np.concatenate([[_U(0)], np.cumsum(textops.mix(place ^ textops.mix(hashes)))]).astype(_U)
    whole = textops.mix(sums[before[1:]] - sums[before[:-1]] + np.diff(before).astype(_U))
    whole[np.diff(before) == 0] = 0
    own, times = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in ((0, _U), (1, np.int64)))
    return own, times, np.cumsum([0, *(len(p[0]) for p in parts)]), whole


def copies(elements: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sorted set of (element, copy) as hashes; a first copy is the element itself."""
    total = int(times.sum())
    if total == len(elements):
        return elements
    copy = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
    out = np.repeat(elements, times)
    more = copy > 0
    out[more] = textops.mix(out[more] + copy[more].astype(_U) * _U(0x9FB21C651E98DF25))
    return np.sort(out)


def signed(docs: DataFrame, n: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """doc_id, text_hash, words_hash (null: no words) and the buckets of the text's signature (null if the batch had the words before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in textops.by_chunk(batches):
            found, times, bounds, whole = distinct_shingles(data, offs, n)
            hashes, new = np.unique(whole, return_index=True)
            new = new[hashes != 0]
            own, weights = (np.concatenate([x[bounds[i] : bounds[i + 1]] for i in new]) if len(new) else x[:0] for x in (found, times))
            sizes = np.concatenate([[0], np.cumsum(np.diff(bounds)[new])])
            signature = dart_signatures(own, weights.astype(float) if counted else np.ones(len(own)), sizes, n_bands * rows).view(np.uint64).reshape(len(new), n_bands, rows)
            bucket = np.broadcast_to(np.arange(1, n_bands + 1, dtype=_U), (len(new), n_bands)).copy()
            for r in range(rows):
                bucket = textops.mix(bucket * _U(31) ^ signature[:, :, r])
            buckets: list = [None] * len(whole)
            for i, values in zip(new, bucket.view(np.int64), strict=True):
                buckets[i] = values
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array(whole.view(np.int64), mask=whole == 0), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "words_hash", "buckets"])

    rows_of = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    return rows_of.mapInArrow(tidy(run), "doc_id long, text_hash long, words_hash long, buckets array<long>")


def shingle_sets(texts: DataFrame, n: int = SHINGLE, counted: bool = False) -> DataFrame:
    """key (hash of the words) and the sorted distinct shingles (with ``counted``, their copies) as 8-byte hashes in one binary value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in textops.by_chunk(batches):
            found, times, bounds, whole = distinct_shingles(data, offs, n)
            sets = [copies(found[a:b], times[a:b] if counted else np.ones(b - a, np.int64)).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(sets, pa.binary())], ["key", "shingles"])

    return texts.select(F.col("text").cast("string")).mapInArrow(tidy(run), "key long, shingles binary")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def as_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
        yield np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in as_sets(batch):
                shared = len(np.intersect1d(one, two, assume_unique=True))
                good.append(shared >= threshold * max(1, one.size + two.size - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return with_sets(pairs, sets).mapInArrow(tidy(run), "a long, b long")


def against_hubs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a (a hub), b, their exact similarity; the size of b and its first shingles in the order that a gives; how many shingles
    differ, a bitmap of these and how many of them share a bit with another."""
    names = ["a", "b", "similarity", "size", "prefix", "differ", "bits", "clash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, two in as_sets(batch):
                own = np.isin(two, one, assume_unique=True)
                shared = int(own.sum())
                prefix = np.concatenate([two[~own], two[own]])[: two.size - math.ceil(threshold * two.size - 1e-9) + 1].view(np.int64)
                differ = one.size + two.size - 2 * shared
                bits = np.zeros(BITS, bool)
                bits[np.setxor1d(one, two, assume_unique=True) % _U(BITS)] = True
                rows.append((shared / max(1, one.size + two.size - shared), two.size, prefix, differ, np.packbits(bits).view(np.int64), differ - int(bits.sum())))
            kinds = (pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return with_sets(pairs, sets).mapInArrow(tidy(run), "a long, b long, similarity double, size long, prefix array<long>, differ long, bits array<long>, clash long")


def components(links: DataFrame) -> DataFrame:
    """key, component (least key) of every key of ``links`` (a, b).

    Each round every key takes the least label around it and then its label's label, so long chains halve;
    labels are written each round, and only a count reaches the driver. All joins are merge joins: labels grow with the
    links, and a broadcast is built on the driver.
    """
    links = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(links.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = links.join(labels.hint("merge"), links["b"] == labels["key"]).groupBy(F.col("a").alias("key")).agg(F.min("component").alias("near"))
        best = labels.join(near.hint("merge"), "key").select("key", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("key").alias("component"), F.col("component").alias("further"))
        labels = written(best.join(jump.hint("merge"), "component").select("key", "old", F.least("component", "further").alias("component")))
        if labels.where("old <> component").isEmpty():
            return labels.select("key", "component")
        labels = labels.select("key", "component")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """doc_id, text_hash (xxhash64), text_class (least doc_id with the same words), class_id (least doc_id of the near-duplicate
    group), and stays: whether it is the group's first text, in order of (doc_id, text_hash)."""
    marked = written(signed(docs, n, n_bands, rows, counted))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    firsts = marked.where("words_hash is not null").groupBy("words_hash").agg(F.min(place).alias("first"))
    buckets = marked.where("buckets is not null").select(F.col("words_hash").alias("key"), F.explode("buckets").alias("bucket")).distinct()
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1")
    buckets = written(buckets.join(crowded, "bucket"))

    degree = buckets.groupBy("key").agg(F.sum("mates").alias("degree"))
    buckets = buckets.join(degree, "key")
    hubs = buckets.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("key")).alias("k"))).alias("hub")).select("bucket", (-F.col("hub.k")).alias("hub"))
    mates = written(buckets.join(hubs, "bucket").select("bucket", "key", "hub"))

    wanted = firsts.join(mates.select(F.col("key").alias("words_hash")).distinct(), "words_hash").select(F.col("first.text_hash").alias("__hash")).distinct()
    texts = docs.select(F.col("text").cast("string").alias("text"))
    sets = shingle_sets(texts.join(wanted, F.xxhash64("text") == F.col("__hash"), "left_semi"), n, counted)
    sets = written(sets.join(mates.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]))
    # written, so that the joins of a hub with many members can be split
    pairs = written(mates.where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct())
    starred = written(against_hubs(pairs, sets, threshold))
    links = starred.where(F.col("similarity") >= threshold).select("a", "b")
    found = components(links)

    def labelled(key: str, name: str) -> DataFrame:
        return found.select(F.col("key").alias(key), F.col("component").alias(name))

    # the members of each hub in the components so far; the hub's own pairs are all verified
    about = ["size", "differ", "bits", "clash"]
    placed = starred.select(F.col("a").alias("hub"), F.col("b").alias("key"), "prefix", *about).join(labelled("key", "c"), "key", "left").join(labelled("hub", "hub_c"), "hub", "left")
    placed = placed.withColumns({"c": F.coalesce("c", "key"), "hub_c": F.coalesce("hub_c", "hub")})
    outside = placed.where("c <> hub_c")
    others = placed.join(outside.select("hub").distinct(), "hub", "left_semi")

    def first_shingles(rows: DataFrame, mark: str) -> DataFrame:
        columns = [F.col(x).alias(f"{x}_{mark}") for x in ("key", "c", *about)]
        return rows.select("hub", "hub_c", *columns, F.posexplode("prefix").alias(f"at_{mark}", "shingle"))

    ours, theirs = first_shingles(outside, "a"), first_shingles(others, "b").drop("hub_c")
    sizes = F.col("size_a") + F.col("size_b")
    reach = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    enough = reach >= sizes * (threshold / (1 + threshold)) - 1e-6
    # the symmetric difference of two members is that of their differences from the hub
    needed = (F.col("differ_a") + F.col("differ_b") - sizes * ((1 - threshold) / (1 + threshold))) / 2
    both = sum((F.bit_count(F.col("bits_a")[i].bitwiseAND(F.col("bits_b")[i])) for i in range(BITS // 64)), F.lit(0))
    alike = both + F.least("clash_a", "clash_b") >= needed - 1e-6
    once = (F.col("c_b") == F.col("hub_c")) | (F.col("key_a") < F.col("key_b"))
    rest = ours.join(theirs, ["hub", "shingle"]).where((F.col("c_a") != F.col("c_b")) & once & enough & alike)
    rest = rest.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    rest = written(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    more = written(linked(rest, sets, threshold))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    classes = firsts.join(labelled("words_hash", "component"), "words_hash", "left").select("words_hash", "first", F.coalesce("component", "words_hash").alias("component"))
    names = classes.groupBy("component").agg(F.min("first").alias("name"))
    classes = classes.join(names, "component").select("words_hash", "first", "name")
    rows = marked.drop("buckets").join(classes, "words_hash", "left")
    stays = F.col("words_hash").isNull() | (F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("text_hash") == F.col("name.text_hash")))
    named = [F.when(F.col("words_hash").isNull(), F.col("doc_id")).otherwise(F.col(f"{c}.doc_id")) for c in ("first", "name")]
    return rows.select("doc_id", "text_hash", named[0].alias("text_class"), named[1].alias("class_id"), stays.alias("stays"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "text_class", "class_id")
