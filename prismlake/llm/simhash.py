"""Near duplicates by SimHash fingerprints, joined on pigeonhole blocks and verified by Hamming distance.

A text's fingerprint has a bit where more than half of its shingles' hashes have it; repeated shingles count as often as
they stand there. Rows with one fingerprint are one class from the start, so that a group of exact copies is one
fingerprint whatever its size.

The 64 bits are cut into ``blocks`` blocks. Two fingerprints that differ in at most ``distance`` bits agree in at least
``blocks - distance`` whole blocks, so they meet under one of the keys made of that many blocks. There are
``blocks`` choose ``distance`` such keys a fingerprint; more blocks make longer keys and more of them. ``blocks_for`` takes
the fewest blocks whose keys tell as many fingerprints apart as there are, so buckets stay small at every size; which
number is taken changes the work and never the links.

A bucket (the fingerprints under one key) may still hold a large family. It is cut into packs of about ``PACK`` fingerprints
by a hash, each pack is held against itself and each other pack of its bucket, and a worker returns links that connect
what is within the distance there: a search that visits each fingerprint once, so a family gives as many links as it has
members, not all its pairs. Every pair that shares a bucket is thus connected by links or verified to be further apart.
Connected components over the links are the classes. All joins are merge joins at every size: a broadcast is built on the
driver, and what small tables save by it fills the driver's memory while they grow to the threshold.

Defined cases: a text of fewer words than a shingle has, but not none, has one shingle of all its words; a text without
words (null, empty, white space only) has fingerprint zero and links like any other; rows that repeat a doc_id are
fingerprinted each for itself and the id counts in the classes of all of them; a class is named by its least doc_id, a null
doc_id comes after all others and names only a class without ids; an empty table gives no rows; extra columns are
ignored; very long texts are hashed whole, some shingles at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import textops
from prismlake.llm.minhash import components
from prismlake.llm.session import table, written

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints of a pack, about: two packs are held against each other in one task.
PACK = 4096
#: Shingles whose bits are counted at once.
SLICE = 1 << 16
_U = np.uint64


def shingle_spans(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text (A-Z lower-cased) with one space after each, the starts and ends of the shingles in it, and the
    number of shingles before each text (one more than texts)."""
    low = textops.LOWER[data]
    starts, ends, before = textops.words(low, offs, textops.NON_SPACE)
    sizes = ends - starts
    heads = np.cumsum(sizes + 1) - sizes - 1
    spaced = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) + owner
    spaced[place] = low[np.repeat(starts - heads, sizes) + place]
    count = np.diff(before)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(before[:-1] - bounds[:-1], per) + np.arange(bounds[-1])
    last = np.minimum(first + n, np.repeat(before[1:], per)) - 1
    return memoryview(spaced), heads[first], heads[last] + sizes[last], bounds


def simhashes(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A 64-bit fingerprint of each text."""
    spaced, starts, ends, bounds = shingle_spans(data, offs, n)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros((len(offs) - 1, 64), np.int64)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    for at in range(0, len(starts), SLICE):
        spans = zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist(), strict=True)
        hashes = np.array([digest(spaced[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[at : at + SLICE]
        new = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        votes[mine[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    over = votes * 2 > np.diff(bounds)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (a signed long of the same bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in textops.by_chunk(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(simhashes(data, offs, n).view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint long")


def block_masks(blocks: int) -> list[int]:
    """Masks of ``blocks`` runs of bits that cover 64 bits, as equal as they can be."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def key_masks(blocks: int, distance: int) -> list[int]:
    """The masks of all choices of ``blocks - distance`` blocks."""
    return [sum(chosen) for chosen in combinations(block_masks(blocks), blocks - distance)]


def blocks_for(fingerprints: int, distance: int = DISTANCE) -> int:
    """The fewest blocks whose shortest key has four values or more for each fingerprint; at most twice the distance and one."""
    for blocks in range(distance + 1, 2 * distance + 2):
        if min(m.bit_count() for m in key_masks(blocks, distance)) >= math.log2(max(1, fingerprints)) + 2:
            break
    return blocks


def bucket_keys(blocks: int, distance: int) -> Column:
    """The keys of a fingerprint as (which, bits)."""
    signed = [m - (1 << 64) if m >> 63 else m for m in key_masks(blocks, distance)]
    return F.array(*(F.struct(F.lit(i).alias("which"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))


def connecting(one: np.ndarray, two: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of ``one`` (and of ``two``, if given: pairs across) that are within the distance of each other.

    A search over what is not yet reached: each fingerprint is held once against those that are left, and takes those
    within the distance with it. Across two packs only links from one side to the other are followed.
    """
    sides = [one.view(_U), (one if two is None else two).view(_U)]
    left = [np.arange(len(one)), np.arange(len(sides[1]))]
    if two is None:
        left[1] = left[0]
    a, b = [], []
    while len(left[0]):
        seed, left[0] = left[0][0], left[0][1:]
        if two is None:
            left[1] = left[0]
        queue = [(0, seed)]
        while queue:
            side, at = queue.pop()
            other = 1 - side
            rest = left[other]
            near = np.bitwise_count(sides[other][rest] ^ sides[side][at]) <= distance
            if near.any():
                found, left[other] = rest[near], rest[~near]
                if two is None:
                    left[1 - other] = left[other]
                a.append(np.full(len(found), sides[side][at]))
                b.append(sides[other][found])
                queue += [(other, i) for i in found.tolist()]
    return tuple(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int | None = None, pack: int = PACK) -> DataFrame:
    """Pairs (a, b) of fingerprints within the distance that connect whatever pairs within the distance connect.

    ``distinct`` has each fingerprint once.
    """
    blocks = blocks or blocks_for(distinct.count(), distance)
    keys = distinct.select("fingerprint", F.explode(bucket_keys(blocks, distance)).alias("key")).select("key.*", "fingerprint")
    crowded = keys.groupBy("which", "bits").agg(F.count("*").alias("n")).where("n > 1")
    members = keys.join(crowded.hint("merge"), ["which", "bits"]).withColumn("packs", F.ceil(F.col("n") / pack))
    members = members.withColumn("pack", F.pmod(F.xxhash64("fingerprint"), F.col("packs")))
    packs = written(members.groupBy("which", "bits", "pack").agg(F.first("packs").alias("packs"), F.collect_list("fingerprint").alias("held")))
    large = packs.where("packs > 1")
    others = large.select("which", "bits", F.col("pack").alias("_pack"), F.col("held").alias("other"))
    across = large.join(others.hint("merge"), ["which", "bits"]).where("pack < _pack").select("held", "other")
    alone = packs.select("held", F.lit(None).cast("array<long>").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, np.int64),) * 2]
            for held, other in zip(batch.column("held"), batch.column("other"), strict=True):
                found.append(connecting(held.values.to_numpy(), other.values.to_numpy() if other.is_valid else None, distance))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    return alone.unionByName(across).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, n: int = SHINGLE, blocks: int | None = None, pack: int = PACK) -> DataFrame:
    """doc_id, fingerprint (a long) and component_id, the least doc_id reachable over links, of every row."""
    marked = written(fingerprints(docs, n))
    distinct = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    found = components(written(links(distinct, distance, blocks, pack)))
    classes = distinct.join(found.withColumnRenamed("key", "fingerprint").hint("merge"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = written(classes.select("fingerprint", "component").join(names.hint("merge"), "component").select("fingerprint", "component_id"))
    return marked.join(classes.hint("merge"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
