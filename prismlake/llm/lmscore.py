"""Document probabilities from a subword lattice.

The pieces are those of an existing vocabulary, whose scores are their first log probabilities (by Zipf's law over
its order where the scores are ranks only), and expectation maximisation over all distinct training words re-estimates them in each
class. A word, with the space before it, is worth the sum of the probabilities of all its segmentations, taken
by the forward recursion in log space over the lattice of its bytes; every byte is a piece too, so nothing is
unknown. No piece crosses a space, so the recursion over a text is the product of those over its words and one
end, and each distinct word needs one lattice.

The lattice has one more edge over each whole word that training documents have, worth (c - d) / N, with d taken
from the numbers of words seen once and twice; what the discounts leave weighs all segmentations of every word, known
or not: G(word) = (c - d) / N + D * lattice, with D the sum of all d / N, and c - d as 0 for other words. In each class P(word) = (c_class + m * G(word)) /
(N_class + m), with m the number of words seen once in the class. The classes are the training documents' most frequent
languages, at most ``CLASSES``, and the rest; a text's probability sums over them, weighted by their shares of
the training documents, so no language is looked at when a text is scored.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Counts, the baseline and the model learn from every
training document; the table of distinct words grows with the corpus and is shuffled, never collected. The
``HEAD`` most frequent words' values are broadcast (a fixed number of rows); each other word of a document
goes as a row (document, word, times) to a join.

Words are told by 64-bit hashes; of two with one hash a text's word takes the value of either.

Defined cases: null and empty texts have the end only; rows that repeat a doc_id are scored each for itself;
with no training documents counts are 0 and pieces keep their first scores; a null doc_id is held out; an
empty table gives no rows; extra columns are ignored; words beyond ``LONG_WORD`` bytes take a loop over their
own edges instead of a matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import textops
from prismlake.llm.session import table, written

ROUNDS = 3
SMOOTHING = 0.1
HEAD = 200_000
CLASSES = 8
LONG_WORD = 2048
#: Up to so many bytes no word's probability leaves the range of doubles (each byte is a piece of at least 1e-7).
SHORT_WORD = 40
#: Bytes of words whose lattices are worked on at once.
LATTICE_BYTES = 200_000
_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def pieces_of(model: str) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings of a vocabulary file in its order, as far as a lower-cased word after a space can hold them, and
    their first probabilities with that of the end: the file's own where its scores are log probabilities (a unigram
    model), else (its scores are ranks) by Zipf's law over the order."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    scores = np.array([m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))])
    unigram = 0.5 < float(np.exp(scores).sum()) < 1.5
    out: dict[bytes, float] = {}
    for i in range(m.get_piece_size()):
        if m.is_control(i) or m.is_unknown(i):
            continue
        raw = bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        if not any(b in raw[1:] for b in b" \t\n\v\f\r") and raw == raw.lower():
            out[raw] = math.exp(m.get_score(i)) if unigram and not m.is_byte(i) else 0.0
    pieces = list(dict.fromkeys([*(bytes([b]) for b in range(256)), *out]))
    first = 1.0 / (np.arange(len(pieces) + 1) + 10.0)
    if unigram:  # what the file gives no probability (bytes, the end) has that of its rarest piece
        own = np.array([*(out.get(p, 0.0) for p in pieces), 0.0])
        first = np.where(own > 0, own, own[own > 0].min())
    return pieces, first / first.sum()


class Lattice:
    """Pieces and their log probabilities, a row for each class; pickled once for each stage."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = np.atleast_2d(log_p)
        self.most = max(map(len, pieces))
        self.by_length = []
        for n in range(1, self.most + 1):
            own = [(i, p) for i, p in enumerate(pieces) if len(p) == n]
            data = np.frombuffer(b"".join(p for _, p in own) + bytes(8), np.uint8)
            keys = self.keys(data, np.arange(len(own)) * n, n)
            order = np.argsort(keys)
            self.by_length.append((keys[order], np.array([i for i, _ in own], np.int64)[order]))

    @staticmethod
    def keys(padded: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Keys of the n bytes from each place; exact up to 8 bytes, hashed beyond."""
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
        key, done = np.zeros(len(at), _U), 0
        while done < n:
            size = min(8, n - done)
            part = eight[at + done] & (_FULL >> _U(64 - 8 * size))
            key = part if n <= 8 else textops.mix(key ^ part)
            done += size
        return key

    def edges(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Piece ids (or -1) by length - 1 and start."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
        out = np.full((self.most, len(data)), -1, np.int32)
        for n, (keys, ids) in enumerate(self.by_length, 1):
            if len(keys):
                at = np.flatnonzero(room >= n)
                want = self.keys(padded, at, n)
                spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                good = keys[spot] == want
                out[n - 1, at[good]] = ids[spot[good]]
        return out

    def forward(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log probabilities of words (runs of bytes), classes x words."""
        size = np.diff(bounds)
        if len(size) == 1 and size[0] > LONG_WORD:
            return self.long_forward(data)
        order = np.argsort(-size, kind="stable")
        base, length = bounds[:-1][order], size[order]
        ids = self.edges(data, bounds)
        longest = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(longest + 1), side="right")  # words of at least j bytes
        out = np.empty((len(self.log_p), len(size)))
        for c, log_p in enumerate(self.log_p):
            score = np.where(ids >= 0, log_p[np.maximum(ids, 0)], -np.inf)
            alpha = np.full((longest + 1, len(size)), -np.inf)
            alpha[0] = 0
            for j in range(1, longest + 1):
                k = alive[j]
                terms = np.stack([alpha[j - n, :k] + score[n - 1, base[:k] + j - n] for n in range(1, min(j, self.most) + 1)])
                top = terms.max(axis=0)
                alpha[j, :k] = top + np.log(np.exp(terms - top).sum(axis=0))
            out[c, order] = alpha[length, np.arange(len(size))]
        return out

    def expected(self, data: np.ndarray, bounds: np.ndarray, c: int = 0) -> np.ndarray:
        """How often each piece is expected in all segmentations of the words, in class ``c``.

        The same recursion from both ends, without logarithms: short words' probabilities fit a double.
        """
        size = np.diff(bounds)
        if len(size) == 1 and size[0] > SHORT_WORD:
            return self.long_expected(data, c)
        order = np.argsort(-size, kind="stable")
        base, length = bounds[:-1][order], size[order]
        ids = self.edges(data, bounds)
        p = np.where(ids >= 0, np.exp(self.log_p[c])[np.maximum(ids, 0)], 0.0)
        longest = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(longest + 1), side="right")
        alpha, beta = np.zeros((longest + 1, len(size))), np.zeros((longest + 1, len(size)))
        alpha[0] = 1
        for j in range(1, longest + 1):
            k = alive[j]
            for n in range(1, min(j, self.most) + 1):
                alpha[j, :k] += alpha[j - n, :k] * p[n - 1, base[:k] + (j - n)]
        own = np.arange(len(size))
        beta[length, own] = 1
        share = 1 / alpha[length, own]
        out = np.zeros(self.log_p.shape[1])
        for j in range(longest - 1, -1, -1):
            for n in range(1, min(longest - j, self.most) + 1):
                k = alive[j + n]  # words that reach beyond the edge; no edge leaves its word
                at = base[:k] + j
                worth = p[n - 1, at] * beta[j + n, :k]
                beta[j, :k] += worth
                used = np.flatnonzero(worth)
                if len(used):
                    out += np.bincount(ids[n - 1, at[used]], worth[used] * alpha[j, used] * share[used], len(out))
        return out

    def long_steps(self, data: np.ndarray) -> list[list[tuple[int, int]]]:
        ids = self.edges(data, np.array([0, len(data)])).T
        return [[(m + 1, int(i)) for m, i in enumerate(row) if i >= 0] for row in ids]

    def long_alpha(self, steps: list[list[tuple[int, int]]], c: int) -> list[float]:
        log_p, n = self.log_p[c], len(steps)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        alpha = [0.0] * (n + 1)
        for j in range(n + 1):
            if j:
                alpha[j] = log_sum(into[j])
                into[j] = []
            for m, i in steps[j] if j < n else ():
                into[j + m].append(alpha[j] + log_p[i])
        return alpha

    def long_forward(self, data: np.ndarray) -> np.ndarray:
        steps = self.long_steps(data)
        return np.array([[self.long_alpha(steps, c)[-1]] for c in range(len(self.log_p))])

    def long_expected(self, data: np.ndarray, c: int) -> np.ndarray:
        steps = self.long_steps(data)
        alpha, log_p, n = self.long_alpha(steps, c), self.log_p[c], len(data)
        beta, out = [0.0] * (n + 1), np.zeros(len(log_p))
        for j in range(n - 1, -1, -1):
            beta[j] = log_sum([log_p[i] + beta[j + m] for m, i in steps[j]])
            for m, i in steps[j]:
                out[i] += math.exp(alpha[j] + log_p[i] + beta[j + m] - alpha[n])
        return out

    def parts(self, column: pa.Array, alone: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, bytes and bounds of a column's words, each after a space, by like lengths; words over ``alone`` bytes by themselves."""
        raw, offs = textops.flat(column)
        size = np.diff(offs) + 1
        bounds = np.concatenate([[0], np.cumsum(size)])
        data = np.full(bounds[-1], 32, np.uint8)
        inside = np.ones(len(data), bool)
        inside[bounds[:-1]] = False
        data[inside] = raw
        order = np.argsort(size, kind="stable")
        upto, lo = np.cumsum(size[order]), 0
        while lo < len(order):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LATTICE_BYTES, side="right")))
            if size[order[hi - 1]] > alone:
                hi = max(lo + 1, lo + int(np.searchsorted(size[order[lo:hi]], alone, side="right")))
            rows = order[lo:hi]
            own = np.concatenate([[0], np.cumsum(size[rows])])
            yield rows, data[np.repeat(bounds[rows] - own[:-1], size[rows]) + np.arange(own[-1])], own
            lo = hi

    def words(self, column: pa.Array) -> np.ndarray:
        """``forward`` of a column."""
        out = np.empty((len(self.log_p), len(column)))
        for rows, data, bounds in self.parts(column, LONG_WORD):
            out[:, rows] = self.forward(data, bounds)
        return out

    def expected_in(self, column: pa.Array, c: int = 0) -> np.ndarray:
        """``expected`` of a column."""
        return sum((self.expected(data, bounds, c) for _, data, bounds in self.parts(column, SHORT_WORD)), np.zeros(self.log_p.shape[1]))


def larger(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes: words are short, and the recursion's cost is one for each step and batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def split(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    for batch in batches:
        data, offs = textops.flat(batch.column("text"))
        for lo, hi in textops.chunks(offs, most):
            low = textops.LOWER[data[offs[lo] : offs[hi]]]
            starts, ends, before = textops.words(low, offs[lo : hi + 1] - offs[lo], textops.NON_SPACE)
            yield batch.slice(lo, hi - lo), low, starts, ends, before, textops.hash_spans(low, starts, ends)


def word_table(docs: DataFrame, classes: int) -> DataFrame:
    """hash, word, n and n_0.. (counts in training documents, of all and of each class) of every distinct word of all documents."""
    names = [f"n_{k}" for k in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, low, starts, ends, before, hashes in split(batches, 6 << 20):
            held_out, kind = (part.column(c).to_numpy(zero_copy_only=False) for c in ("held_out", "class"))
            own = np.repeat(np.where(held_out, -1, kind), np.diff(before))
            found, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            counts = [pa.array(np.bincount(which[own == k], minlength=len(found))) for k in range(classes)]
            raw = low.tobytes()
            text = pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), text, *counts], ["hash", "word", *names])

    schema = "hash long, word binary, " + ", ".join(f"{c} long" for c in names)
    found = docs.select("held_out", "class", F.col("text").cast("string")).mapInArrow(run, schema)
    found = found.groupBy("hash", "word").agg(*(F.sum(c).alias(c) for c in names))
    return found.select("hash", "word", sum((F.col(c) for c in names), F.lit(0)).cast("long").alias("n"), *names)


def re_estimate(trained: DataFrame, pieces: list[bytes], first: np.ndarray, class_docs: list[int], rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and, last, of the end, in each class; a row for each class and piece reaches the driver.

    Every distinct training word of a class counts once: the lattice is for words that counts don't know.
    """
    classes = len(class_docs)
    log_p = np.tile(np.log(first), (classes, 1))
    for _ in range(rounds):
        lattice = trained.sparkSession.sparkContext.broadcast(Lattice(pieces, log_p[:, :-1]))

        def run(batches: Iterator[pa.RecordBatch], lattice=lattice) -> Iterator[pa.RecordBatch]:
            expected = np.zeros(lattice.value.log_p.shape)
            for batch in larger(batches):
                for c in range(classes):
                    expected[c] += lattice.value.expected_in(batch.column("word").filter(pa.array(batch.column(f"n_{c}").to_numpy() > 0)), c)
            kind, piece = np.nonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(piece), pa.array(expected[kind, piece])], ["class", "piece", "expected"])

        counts = np.full(log_p.shape, SMOOTHING)
        found = trained.select(F.col("word").cast("string"), *(f"n_{c}" for c in range(classes))).mapInArrow(run, "class long, piece long, expected double")
        sums = found.groupBy("class", "piece").agg(F.sum("expected").alias("n")).toPandas()
        np.add.at(counts, (sums["class"].to_numpy(dtype=int), sums["piece"].to_numpy(dtype=int)), sums["n"].to_numpy(dtype=float))
        counts[:, -1] += class_docs
        log_p = np.log(counts / counts.sum(axis=1, keepdims=True))
    return log_p


def most_frequent(values: DataFrame, most: int) -> DataFrame:
    """Words from a count on that at most ``most`` words reach; a histogram finds it, so no task sorts or sends more."""
    level = F.floor(F.log2(F.col("n") + 1) * 32)
    left, least = most, math.inf
    for row in sorted(values.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):  # 32 rows for each doubling
        if row["n"] > left:
            break
        left, least = left - row["n"], row["level"]
    return values.where(level >= least)


def with_classes(docs: DataFrame, most: int = CLASSES) -> tuple[DataFrame, list[int]]:
    """``docs`` with a class by language, and the training documents in each class."""
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    counts = docs.where("not held_out").groupBy("lang").agg(F.count("*").alias("n"))
    top = counts.where("lang is not null").orderBy(F.desc("n"), "lang").limit(most).collect()
    rest = sum(r["n"] for r in counts.select(F.sum("n").alias("n")).collect() if r["n"]) - sum(r["n"] for r in top)
    number = F.lit(len(top))
    for k, r in enumerate(top):
        number = F.when(F.col("lang") == r["lang"], k).otherwise(number)
    return docs.withColumn("class", number), [*(r["n"] for r in top), rest]


def score_documents(docs: DataFrame, model: str | None = None, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """``docs`` (doc_id, text, held_out, perhaps lang): a row of counts, base_score and scores for each."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    docs, class_docs = with_classes(docs)
    classes, n_docs = len(class_docs), sum(class_docs)
    own = [f"n_{k}" for k in range(classes)]
    words = written(word_table(docs, classes))
    seen = [F.sum(c) for c in ("n", *own)] + [F.count_if(F.col(c) == 1) for c in ("n", *own)] + [F.count_if(F.col("n") == 2), F.count_if(F.col("n") > 0)]
    *sums, twice, distinct = (x or 0 for x in words.agg(*seen).first())
    n, v = sums[0] + n_docs, distinct + (n_docs > 0)
    in_class = [c + d for c, d in zip(sums[1 : classes + 1], class_docs, strict=True)]
    once, once_in = sums[classes + 1], [max(1, x) for x in sums[classes + 2 :]]
    discount = once / (once + 2 * twice) if once else 0.5
    pieces, first = pieces_of(model)
    log_p = re_estimate(words.where("n > 0"), pieces, first, class_docs, rounds)
    lattice = spark.sparkContext.broadcast(Lattice(pieces, log_p[:, :-1]))
    ten = math.log(10)
    logs = [f"l_{k}" for k in range(classes)]

    def with_lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger(batches):
            found = lattice.value.words(batch.column("word"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("hash", "n", *own)] + [pa.array(x) for x in found], ["hash", "n", *own, *logs])

    schema = ", ".join([f"{c} long" for c in ("hash", "n", *own)] + [f"{c} double" for c in logs])
    weighed = written(words.select("hash", F.col("word").cast("string"), "n", *own).mapInArrow(with_lattice, schema))
    to_lattice = math.log(discount * v / n) if n else 0.0  # what the discounts leave
    sums_of = [f"p_{k}" for k in range(classes)]

    def smoothed(k: int) -> Column:
        """log10 P(word) in class k."""
        pieces_log = F.col(f"l_{k}") + to_lattice
        general = F.when(F.col("n") > 0, F.log((F.col("n") - discount) / max(n, 1) + F.exp(pieces_log))).otherwise(pieces_log)
        count, m = F.col(f"n_{k}"), once_in[k]
        log = F.when(count > 0, F.log(count + m * F.exp(general))).otherwise(math.log(m) + general)
        return ((log - math.log(in_class[k] + m)) / ten).alias(f"p_{k}")

    values = weighed.select("hash", "n", *map(smoothed, range(classes)))
    top = most_frequent(values, head).toPandas().sort_values("hash")  # at most `head` rows
    known = spark.sparkContext.broadcast((top["hash"].to_numpy(), top["n"].to_numpy(), [top[c].to_numpy() for c in sums_of]))

    def base(count):
        return np.log10((count + 0.1) / (n + 0.1 * (v + 1)))

    general_end = (n_docs - discount) / n if n_docs else 0.0
    end_p = [(c + m * (general_end + math.exp(e + to_lattice))) / (t + m) for c, m, t, e in zip(class_docs, once_in, in_class, log_p[:, -1], strict=True)]
    end = [float(base(float(n_docs))), *map(math.log10, end_p)]
    measures = ["base_score", *sums_of]
    counted_names = ["key", "doc_id", "held_out", "hash", "n_tokens", "n_known", *measures]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()] + [pa.float64()] * len(measures)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document a row with what the head holds, and a row for each of its other words (hash, times)."""
        key = TaskContext.get().partitionId() << 40
        hashes, counts, logs = known.value
        logs = [base(counts.astype(float)), *logs]
        for part, _, _, _, before, found in split(batches, textops.CHUNK_BYTES):
            size = np.diff(before)
            owner = np.repeat(np.arange(len(size)), size)
            signed = found.view(np.int64)
            spot = np.minimum(np.searchsorted(hashes, signed), max(len(hashes) - 1, 0))
            inside = hashes[spot] == signed if len(hashes) else np.zeros(len(signed), bool)
            mine, spot = owner[inside], spot[inside]
            of_head = [np.bincount(mine, x[spot], len(size)) + e for x, e in zip(logs, end, strict=True)]
            n_known = np.bincount(mine, counts[spot] > 0, len(size)).astype(np.int64) + (n_docs > 0)
            heads = [key + np.arange(len(size)), part.column("doc_id"), part.column("held_out"), [None] * len(size), size + 1, n_known, *of_head]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(heads, kinds, strict=True)], counted_names)
            left, hash_left = owner[~inside], signed[~inside]
            order = np.lexsort((hash_left, left))
            left, hash_left = left[order], hash_left[order]
            new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (hash_left[1:] != hash_left[:-1])])) if len(left) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate([new, [len(left)]]))
            tails = [key + left[new], None, None, hash_left[new], times, *[None] * (len(kinds) - 5)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(new), k) if x is None else pa.array(x, k) for x, k in zip(tails, kinds, strict=True)], counted_names)
            key += len(size)

    types = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    schema = ", ".join(f"{c} {types[k]}" for c, k in zip(counted_names, kinds, strict=True))
    rows = written(docs.select("doc_id", "held_out", F.col("text").cast("string")).mapInArrow(counted, schema))
    times = F.col("n_tokens")
    tail = rows.where("hash is not null").select("key", "hash", "n_tokens").join(values.dropDuplicates(["hash"]), "hash").select(
        "key", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("n") > 0, times).otherwise(0).alias("n_known"), (times * F.log10((F.col("n") + 0.1) / (n + 0.1 * (v + 1)))).alias("base_score"),
        *((times * F.col(c)).alias(c) for c in sums_of),
    )
    both = rows.where("hash is null").drop("hash").unionByName(tail)
    both = both.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", *measures)))
    weighted = [F.col(f"p_{k}") + math.log10(max(c, 0.5) / max(n_docs, 1)) for k, c in enumerate(class_docs)]
    most = F.greatest(*weighted, F.lit(None))  # the log-space sum over the classes
    score = most + F.log10(sum((F.pow(F.lit(10.0), w - most) for w in weighted), F.lit(0.0)))
    return both.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", score.alias("score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(True))
    return score_documents(docs.select(F.col("doc_id").cast("long"), "text", "lang", held_out.alias("held_out")))
