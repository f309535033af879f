"""Homomorphic multiset fingerprints of documents, in DataFrame operations only.

A text is a multiset of paragraphs: its lines, byte for byte, empty ones too. Each is hashed to a wide vector, ``WIDE``
lanes of 32 bits, and the fingerprint is the sum of these vectors, every lane modulo 2**32, beside the number of
paragraphs. Texts with the same paragraphs in any order have equal fingerprints; others differ but for chance
(about 2**-1024). A paragraph is inserted or deleted by adding or subtracting its vector (``add``, ``subtract``).

A second sum of the same kind tells how alike texts are: phrases (lines, cut after a sentence's end or eight words) are
hashed to vectors of 128 bits, and the sketch is the sum of these, every lane modulo 2**32, beside the number of phrases.
The likeness of two fingerprints is the cosine of their sketches' lanes, centred (2 * lane - phrases), not below 0; it
estimates which part of the phrases both have, with a standard error of about 0.09. It is 1 where fingerprints are
equal. Two lanes share one 64-bit sum.

Defined cases: null text is empty and has one empty paragraph and an empty sketch, alike (1.0) to any other empty one and
not at all to others; a text without phrases (white space only) is alike only to equal ones; rows that repeat doc_id
and text are one document when the next document is sought, and are all returned; rows with one doc_id and different
texts are ordered by a hash of the text; a null doc_id is ordered as 0; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismlake.llm.session import table, written

#: Lanes of a paragraph's vector.
WIDE = 32
#: A phrase: at most eight words; earlier at the end of a sentence or line.
PHRASE = r"(?:[^\s]*[^\s.!?][^\S\n]+){0,7}[^\s]+"
BITS = 32
PAIR = (1 << 32) + 1
LOW = (1 << 32) - 1
SUMS = [f"s{h}_{b}" for h in (1, 2) for b in range(BITS)]


def wide_lanes(text: Column) -> Column:
    """The sum of the paragraphs' vectors."""
    lines = F.split(text, "\n", -1)

    def lane(number: int) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda total, line: total + F.xxhash64(F.lit(number), line).bitwiseAND(F.lit(LOW)))

    return F.transform(F.array(*map(lane, range(WIDE))), lambda v: F.pmod(v, F.lit(1 << 32)))


def n_lines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def as_binary(lanes: Column) -> Column:
    """Wide lanes, four bytes each."""
    return F.unhex(F.array_join(F.transform(lanes, lambda v: F.lpad(F.hex(v), 8, F.lit("0"))), ""))


def hashed(text: Column, kind: int) -> Column:
    """The phrases' hashes, after one entry without any, so that texts without phrases keep a row."""
    none = F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"))
    phrases = F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0))
    return F.concat(F.array(none), F.transform(phrases, lambda p: F.struct(F.lit(kind).alias("kind"), F.xxhash64(p).alias("h1"), F.xxhash64(F.lit(7), p).alias("h2"))))


def sums() -> list[Column]:
    """The lanes' sums of h1 and h2: lane b in the low half of a sum, lane b + 32 in the high half."""
    lanes = [F.coalesce(F.sum(F.shiftright(f"h{h}", b).bitwiseAND(F.lit(PAIR))), F.lit(0)) for h in (1, 2) for b in range(BITS)]
    return [F.count("h1").alias("n"), F.array(*lanes).alias("sums")]


def lanes(packed: Column) -> Column:
    return F.concat(F.transform(packed, lambda s: s.bitwiseAND(F.lit(LOW))), F.transform(packed, lambda s: F.shiftrightunsigned(s, 32)))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of a with those of b inserted (or, with sign -1, deleted), modulo 2**32."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(1 << 32)))


def subtract(a: Column, b: Column) -> Column:
    return add(a, b, -1)


def packed(n: Column, lanes: Column) -> Column:
    """Lanes as one binary value: each in as many hex digits as n has, since no lane exceeds n."""
    digits = F.length(F.hex(n))
    return F.unhex(F.array_join(F.transform(lanes, lambda v: F.lpad(F.hex(v), digits, F.lit("0"))), ""))


def unpacked(n: Column, value: Column) -> Column:
    digits, text = F.length(F.hex(n)), F.hex(value)
    return F.transform(F.sequence(F.lit(0), F.lit(4 * BITS - 1)), lambda i: F.conv(F.substring(text, i * digits + 1, digits), 16, 10).cast("long"))


def as_text(lines: Column, wide: Column, n: Column, value: Column) -> Column:
    return F.concat_ws(".", F.hex(lines), F.hex(wide), F.hex(n), F.hex(value))


def likeness(n: Column, a: Column, m: Column, b: Column, equal: Column) -> Column:
    """0 to 1, from two fingerprints alone: their numbers of phrases, sketches, and whether the rest is equal too."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def centred(n: Column, a: Column) -> Column:
        return F.transform(a, lambda v: (2 * v - n).cast("double"))

    x, y = centred(n, a), centred(m, b)
    cosine = F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))
    return F.when(equal & (n == m) & (a == b), F.lit(1.0)).otherwise(F.least(F.greatest(F.coalesce(cosine, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def fingerprint(docs: DataFrame, *key: str) -> DataFrame:
    """key, lines and wide (number and sum of the paragraphs' vectors), n and lanes (those of the phrases'), of each text.

    Rows with an equal key and text are summed in the sketch, so the key should tell rows apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*key, n_lines(text).alias("lines"), wide_lanes(text).alias("wide"), F.explode(hashed(text, 0)).alias("p")).select(*key, "lines", "wide", "p.*")
    return rows.groupBy(*key, "lines", "wide").agg(*sums()).select(*key, "lines", "wide", "n", lanes(F.col("sums")).alias("lanes"))


#: Tells documents apart; never null, so that joins and groups share one partitioning.
KEY = ["id", "text_hash"]


def keyed(docs: DataFrame) -> DataFrame:
    """id (a null doc_id is 0, which the hash tells from a true 0), text_hash, doc_id, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("text_hash"), F.col("doc_id").cast("long"), text.alias("text"))


def in_order(docs: DataFrame) -> DataFrame:
    """Each keyed document's n_chars, copies and the keys of the next and previous one, in a ring, with the previous one's n_chars.

    Keys are range-partitioned and led within each part; the parts' ends, a row for each part, close the
    gaps. No task sees more than its part.
    """
    ids = docs.select(*KEY, "doc_id", F.char_length("text").cast("long").alias("n_chars"))
    ids = ids.groupBy(*KEY, "doc_id", "n_chars").agg(F.count("*").alias("copies"))
    ids = written(ids.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    ids = ids.withColumn("me", F.struct(*KEY, "n_chars"))
    parts = ids.groupBy("part").agg(F.min("me").alias("first"), F.max("me").alias("last"))
    after = Window.orderBy("part")
    whole = after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("first").over(after), F.first("first").over(whole))
    before = F.coalesce(F.lag("last").over(after), F.last("last").over(whole))
    parts = parts.select("part", following.alias("following"), before.alias("before"))
    within = Window.partitionBy("part").orderBy("me")
    led = ids.withColumns({"next": F.lead("me").over(within), "prev": F.lag("me").over(within)}).join(F.broadcast(parts), "part")  # a row for each part
    led = led.withColumns({"next": F.coalesce("next", "following"), "prev": F.coalesce("prev", "before")})
    return led.select(*KEY, "doc_id", "n_chars", "copies", *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("next", "prev") for c in (*KEY, "n_chars")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Packed fingerprints of each text and of the text whose last quarter the next document's start replaces."""
    docs = keyed(docs)
    order = written(in_order(docs))
    texts = docs.groupBy(*KEY).agg(F.min("text").alias("text"))  # one shuffle of the texts, which both uses share
    rows = texts.join(order, KEY)
    heads = rows.select(F.col("prev_id").alias("id"), F.col("prev_text_hash").alias("text_hash"), F.left("text", F.floor(F.col("prev_n_chars") / 4).cast("int")).alias("head"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - quarter), F.col("head"))
    both = rows.join(heads, KEY).withColumn("edited", edited)
    whole = {f"{x}_wide": F.struct(n_lines(F.col(c)).alias("lines"), as_binary(wide_lanes(F.col(c))).alias("wide")) for x, c in (("own", "text"), ("edit", "edited"))}
    key = [*KEY, "doc_id", "n_chars", "copies", "prev_id", "prev_text_hash", "edited_sha256", *whole]
    rows = both.withColumns({"edited_sha256": F.sha2("edited", 256)} | whole)
    rows = rows.select(*key, F.explode(F.concat(hashed(F.col("text"), 0), hashed(F.col("edited"), 1))).alias("p")).select(*key, "p.*")
    per = rows.groupBy(*key, "kind").agg(*sums()).select(*key, "kind", "n", packed(F.col("n"), lanes(F.col("sums"))).alias("value"))
    own, other = (F.when(F.col("kind") == kind, F.struct("n", "value")) for kind in (0, 1))
    return written(per.groupBy(*key).agg(F.max(own).alias("own"), F.max(other).alias("edit")))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = edited_fingerprints(table(spark, sf_dir, "documents"))
    following = per.select(F.col("prev_id").alias("id"), F.col("prev_text_hash").alias("text_hash"), F.col("own").alias("following"), F.col("own_wide").alias("following_wide"))
    rows = per.join(following, KEY).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    numbers = [F.col(f"{x}.n") for x in ("own", "edit", "following")]
    rows = rows.withColumns({f"{x}_lanes": unpacked(F.col(f"{x}.n"), F.col(f"{x}.value")) for x in ("own", "edit", "following")})
    n, m, k = numbers
    told = {x: as_text(F.col(f"{x}_wide.lines"), F.col(f"{x}_wide.wide"), F.col(f"{x}.n"), F.col(f"{x}.value")) for x in ("own", "edit")}
    same = {x: F.col("own_wide") == F.col(f"{x}_wide") for x in ("edit", "following")}
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", told["own"].alias("fingerprint"), told["edit"].alias("edited_fingerprint"),
        likeness(n, F.col("own_lanes"), m, F.col("edit_lanes"), same["edit"]).alias("near_edited"),
        likeness(n, F.col("own_lanes"), k, F.col("following_lanes"), same["following"]).alias("near_next"),
    )
