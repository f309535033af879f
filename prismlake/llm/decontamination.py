"""Benchmark decontamination by a prefix-filtered join of shingles, in DataFrame operations only.

Every item is cut into windows of ten words (an item of fewer words is one window). A window must occur whole, so
all its shingles of five words are needed, and one of them is enough as its prefix: the one with the rarest word, by
the words' counts in all documents. Documents are shingled once and joined with the windows' prefixes alone. The
length and position bounds drop places where the window would not fit, and the window's words are compared with the
document's around the place.

The prefixes are broadcast while their windows hold at most ``BROADCAST_CHARACTERS``; beyond that Spark shuffles
shingles with the words around them (at most twice a window).

Defined cases: null text has no words and no hit; rows that repeat a doc_id are searched each for itself
(text hash beside the id); repeated rows and items count once in each result; an empty benchmark hits
nothing; an empty ``documents`` gives no rows; a null doc_id is an id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm.session import table, written

WINDOW = 10
SHINGLE = 5
BROADCAST_CHARACTERS = 64_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text whose A-Z are lower-cased; other letters stay as they are."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, window (array of words)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, size))).alias("window")).distinct()


def prefixes(docs: DataFrame, windows: DataFrame, shingle: int) -> DataFrame:
    """window, size, k (words of its shingles), h (the hash of its rarest shingle) and at (where it stands in the window)."""
    needed = windows.select(F.explode("window").alias("word")).distinct()
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = needed.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    size = F.size("window")
    counted = windows.select("window", F.posexplode("window").alias("place", "word")).join(counts, "word")
    counted = counted.groupBy("window").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("counts"))  # a window's words
    k = F.least(size, F.lit(shingle))
    ranked = F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.struct(F.array_min(F.slice("counts", i, k)).alias("n"), (i - 1).alias("at")))
    chosen = counted.select("window", size.alias("size"), k.alias("k"), F.array_min(ranked)["at"].alias("at"))
    return chosen.select("*", F.xxhash64(F.slice("window", F.col("at") + 1, F.col("k"))).alias("h"))


def places(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """For each document a row doc_id, text_hash, n_words, and one more with start (from 0), size and window for each occurrence of
    a window; and the windows of each item."""
    items = written(item_windows(benchmark, window))
    own = written(prefixes(docs, items.select("window").distinct(), shingle))
    sizes = sorted(r["k"] for r in own.select("k").distinct().collect())  # at most `shingle` rows
    held = own.agg(F.sum(F.length(F.concat_ws(" ", "window")))).first()[0] or 0
    small = held <= BROADCAST_CHARACTERS

    n = F.col("n_words")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    # rows, not array functions: exploding, slicing, hashing and joining then run in one generated loop; place -1 is the document's own row
    rows = rows.select("*", F.explode(F.sequence(F.lit(-1), n - 1)).alias("place"))
    hashes = [F.struct(F.lit(k).alias("k"), F.when((F.col("place") >= 0) & (F.col("place") + k <= n), F.xxhash64(F.slice("words", F.greatest(F.col("place") + 1, F.lit(1)), k))).alias("h")) for k in sizes]
    low, around = F.lit(0), F.col("words")
    if not small:
        low = F.greatest(F.col("place") - window, F.lit(0))
        around = F.slice("words", low + 1, F.lit(2 * window))
    rows = rows.select("doc_id", "text_hash", "n_words", "place", low.alias("low"), around.alias("around"), *([hashes[0]["k"].alias("k"), hashes[0]["h"].alias("h")] if len(sizes) == 1 else [F.explode(F.array(*hashes)).alias("x")] if sizes else [F.lit(0).alias("k"), F.lit(None).cast("long").alias("h")]))
    if len(sizes) > 1:
        rows = rows.select("*", "x.*").drop("x").where((F.col("place") >= 0) | (F.col("k") == sizes[0]))
    start = F.col("place") - F.col("at")
    fits = (start >= 0) & (start + F.col("size") <= n)
    good = F.coalesce(fits & (F.slice("around", F.greatest(start - F.col("low") + 1, F.lit(1)), F.col("size")) == F.col("window")), F.lit(False))
    found = ["doc_id", "text_hash", "n_words", F.when(good, start).alias("start"), "size", "window"]
    if small:  # bounded by BROADCAST_CHARACTERS
        rows = rows.join(F.broadcast(own), ["h", "k"], "left").where(good | (F.col("place") < 0)).select(*found)
    else:
        alone = rows.where("place < 0").select("doc_id", "text_hash", "n_words", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("array<string>").alias("window"))
        rows = alone.unionByName(rows.where("place >= 0").join(own, ["h", "k"]).where(good).select(*found))
    return rows, items


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Where the benchmark's windows occur, as doc_id, text_hash, start (from 0), size, window; and the items of each window."""
    rows, items = places(docs, benchmark, window, shingle)
    return rows.where("start is not null").drop("n_words").distinct(), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, items = places(docs, benchmark, window, shingle)
    rows = written(rows)
    hits = rows.where("start is not null")
    key = ["doc_id", "text_hash"]
    spots = hits.select(*key, "start", "size").distinct()
    spots = spots.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("place")).distinct()
    n_hit = spots.groupBy(*key).agg(F.count("*").alias("n_hit"))
    found = hits.select(*key, "window").distinct().join(items, "window").select(*key, "item_id").distinct()
    found = found.groupBy(*key).agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item_id"))).alias("items"))
    per = n_hit.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}).join(
        found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_hash"))
    ).select("d", "t", "n_hit", "n_items", "items")
    base = rows.where("start is null").select("doc_id", "text_hash", F.col("n_words").cast("long"))
    per = written(per)
    n = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return base.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select(
        "doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, l, list_slice(w, p, p + l - 1) AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
places AS (
  SELECT doc_id, l, p, list_slice(w, p, p + l - 1) AS g
  FROM (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS p FROM d, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l)),
hits AS (SELECT DISTINCT doc_id, p, places.l, item_id FROM places JOIN windows ON places.l = windows.l AND places.g = windows.g),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + l - 1)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""
