"""Toxicity by nearest labelled examples under a weighted TF-IDF cosine, found exactly with a block-max inverted index.

The cosine is that of TF-IDF vectors over words and some word prefixes, in which terms that tell the labels apart weigh
``TELLING`` times as much; it is exact for these vectors. Terms are words of letters and digits (A-Z lower-cased). The vocabulary is every word of the labelled examples, so
an example's vector has all its words. Besides, a word's first 4, 5 or 6 bytes are a term where they tell the
examples apart, which catches inflected forms. Terms that tell the examples apart weigh ``TELLING`` times as much:
those most of whose examples have label 1, too many for chance (binomial tail; ``ALPHA`` such terms are expected by
accident among all that are frequent enough to be told from chance at all), at most ``TERMS``. Document frequencies
come from all documents, whole texts.

The examples are at most ``EXAMPLES`` labelled training rows of at most ``EXAMPLE_BYTES`` together (chosen by a hash
of the id where there are more), so vocabulary, examples and index are of bounded size and are broadcast. Like
examples stand together in clusters, and in these in blocks of ``BLOCK``. A term that at least a ``COMMON`` part of a
cluster has lies there in a dense matrix, whose products with some texts at a time enter the sums as they are; all
others lie in postings cut into blocks with their greatest weights. The k-th best of the blocks' sums so far is a floor
for the k-th best cosine; blocks whose sums and greatest weights can't reach it are never opened. What the opened ones
leave above the floor is summed again in double precision, so that the k nearest are exact (ties by example
number) and don't depend on the texts beside. The score is the vote of the nearest, weighted by closeness over
distance, with the training rate as one more vote; a text without any term of an example has the rate of examples
without terms. The nearest examples' ids are the evidence.

Defined cases: null and empty texts have no terms; examples without text or label are left out; of
contradicting labels for one doc_id the toxic one counts, of its texts the least; without any example of label 1 every
score is the training rate (0 without examples); rows that repeat a doc_id are scored each for itself; ``reject`` learns from
the rows that it scores too, so a labelled row finds itself nearest and its own label decides; an empty table
gives no rows; other columns are kept by ``reject`` and ignored by ``score``.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import textops
from prismlake.llm.session import give_back, table, tidy, written

EXAMPLES, EXAMPLE_BYTES, TERMS, ALPHA, PURE = 16384, 256 << 20, 4096, 0.05, 0.85
TELLING = 8  # chosen by leaving one training example out at a time, on the 10,000-document set
BLOCK, NEAREST = 256, 32
COMMON, TOGETHER, CLUSTERS, CLUSTER_ROWS = 1 / 16, 64, 8, 1024
#: Distance that a copy counts as, so that its vote stays finite.
NEAR = 0.01
#: Beyond the rounding of single-precision sums of weights.
SLACK = 1e-5
PREFIXES = (4, 5, 6)
_U = np.uint64


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and the length of each range."""
    size = ends - starts
    full = size > 0
    first, last = starts[full], ends[full]
    if not len(first):
        return np.zeros(0, np.int64), size
    steps = np.ones(int(size.sum()), np.int64)
    steps[0] = first[0]
    steps[np.cumsum(size[full][:-1])] = first[1:] - last[:-1] + 1
    return np.cumsum(steps), size


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all words and then all prefixes of the texts, the text of each, and how many are words."""
    low = textops.LOWER[data]
    starts, ends, before = textops.words(low, offs, textops.ALNUM)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(before))
    hashes, owners = [textops.hash_spans(low, starts, ends)], [owner]
    for n in PREFIXES:
        long = ends - starts > n
        hashes.append(textops.hash_spans(low, starts[long], starts[long] + n, seed=n))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(owners), len(starts)


class Vocabulary:
    """Numbers of terms by their hashes; ``prefixes`` says whether any term is a prefix."""

    def __init__(self, hashes: np.ndarray, prefixes: bool = True):
        self.hashes, self.prefixes = np.sort(hashes.astype(_U)), prefixes
        self.shift = _U(64 - max(8, len(self.hashes).bit_length() + 1))
        heads = (self.hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)  # by leading bits
        self.longest = int(np.diff(self.first).max(initial=0))

    def __reduce__(self):
        return Vocabulary, (self.hashes, self.prefixes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those that are no term."""
        head = (hashes >> self.shift).astype(np.int64)
        spot, end = self.first[head], self.first[head + 1]
        left, out = np.flatnonzero(spot < end), np.full(len(hashes), -1, np.int64)
        for _ in range(self.longest):
            same = self.hashes[spot[left]] == hashes[left]
            out[left[same]] = spot[left[same]]
            left = left[~same]
            spot[left] += 1
            left = left[spot[left] < end[left]]
        return out

    def counts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term number and times of each vocabulary term in each text, in this order; each distinct word is looked up once."""
        low = textops.LOWER[data]
        starts, ends, before = textops.words(low, offs, textops.ALNUM)
        owner = np.repeat(np.arange(len(offs) - 1, dtype=np.int64), np.diff(before)) * max(len(self.hashes), 1)
        found, first, which = np.unique(textops.hash_spans(low, starts, ends), return_index=True, return_inverse=True)
        looked = [self.numbers(found)]
        starts, ends = starts[first], ends[first]
        for n in PREFIXES if self.prefixes else ():
            long = np.flatnonzero(ends - starts > n)
            of_prefix = np.full(len(found), -1, np.int64)
            of_prefix[long] = self.numbers(textops.hash_spans(low, starts[long], starts[long] + n, seed=n))
            looked.append(of_prefix)
        pairs = []
        for number in looked:
            if (number >= 0).any():
                number = number[which]
                good = number >= 0
                pairs.append(owner[good] + number[good])
        pair, times = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
        return pair // max(len(self.hashes), 1), pair % max(len(self.hashes), 1), times


def chance(hits: int, n: int, p: float) -> float:
    """P(at least ``hits`` of ``n`` at rate ``p``)."""
    if hits <= n * p:
        return 1.0
    total, log_p, log_q = 0.0, math.log(p), math.log1p(-p)
    for k in range(hits, n + 1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * log_p + (n - k) * log_q)
        total += term
        if term < 1e-12 * total:
            break
    return min(total, 1.0)


def select_terms(examples: DataFrame, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts with labels, and of the words and prefixes that tell the labels apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in textops.by_chunk(batches):
            hashes, owner, words = terms(data, offs)
            toxic = part.column("toxic").to_numpy().astype(np.int64)
            order = np.lexsort((hashes, owner))
            h, o = hashes[order], owner[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])[: len(h)]
            found, which = np.unique(h[new], return_inverse=True)
            columns = [found.view(np.int64), np.isin(found, hashes[:words]), np.bincount(which, minlength=len(found)), np.bincount(which, toxic[o[new]], len(found)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["term", "word", "n", "hits"])

    counts = examples.select(F.col("text").cast("string"), "toxic").mapInArrow(tidy(run), "term long, word boolean, n long, hits long")
    counts = written(counts.groupBy("term", "word").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")))
    every = counts.where("word").select("term").toArrow()["term"].to_numpy().view(_U)  # words of `EXAMPLES` rows
    if not 0 < rate < 1:
        return every, np.zeros(0, _U)
    counts = counts.where("n >= 3")
    most = math.ceil(math.log(1e-18) / math.log(rate))
    by_n = dict(counts.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count("*")).collect())  # some tens of rows
    tried = {k: sum(v for n, v in by_n.items() if n >= k) for k in range(3, most + 1)}
    least = next((k for k in tried if rate**k * tried[k] <= ALPHA), most)  # rarer terms can't pass, so aren't tried
    pure = (F.col("hits") + 1) / (F.col("n") + 2) >= PURE
    clear = counts.where((F.col("n") >= least) & (F.col("hits") >= least) & pure)
    best = clear.orderBy(F.desc(F.col("hits") * F.col("hits") / F.col("n")), "term").limit(TERMS).collect()  # `TERMS` rows
    return every, np.array([r["term"] for r in best if chance(r["hits"], r["n"], rate) * max(tried.get(least, 1), 1) <= ALPHA], np.int64).view(_U)


def clusters(vectors: list[tuple[np.ndarray, np.ndarray]], width: int = 128, rounds: int = 6) -> np.ndarray:
    """A cluster for each vector: some rounds of spherical k-means over hashed projections, from seeds that are far apart."""
    many = min(CLUSTERS, len(vectors) // CLUSTER_ROWS)
    if many < 2:
        return np.zeros(len(vectors), np.int64)
    points = np.zeros((len(vectors), width), np.float32)
    for i, (found, weights) in enumerate(vectors):
        key = textops.mix(found.astype(_U))
        points[i] = np.bincount((key % _U(width)).astype(np.int64), np.where(key >> _U(63), -weights, weights), width)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    seeds = [0]
    closest = points @ points[0]
    for _ in range(many - 1):
        seeds.append(int(closest.argmin()))
        closest = np.maximum(closest, points @ points[seeds[-1]])
    centres = points[seeds]
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        centres = np.stack([points[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(many)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return own


def floor(sums: np.ndarray, k: int) -> np.ndarray:
    """At most the k-th greatest cosine of each row, from single-precision sums."""
    return np.maximum(np.partition(sums, -k, axis=1)[:, -k] - SLACK, 0.0) if sums.shape[1] >= k else np.zeros(len(sums))


def raised(x: np.ndarray) -> np.ndarray:
    """Half-precision numbers that aren't below ``x``."""
    half = x.astype(np.float16)
    return np.where(half < x, np.nextafter(half, np.float16(np.inf)), half)


class Built(NamedTuple):
    """Of rare terms' blocks the number, the start of postings (and the end of the last) and the greatest weight; where each
    term's blocks start. The weights of clusters' common terms by row and example, all in one run after a zero, and where they
    start there; by cluster and shared term (common anywhere) the row's number, -1 of others; each term's place among the shared
    ones, -1 of others; by term and cluster at least the greatest weight."""

    block: np.ndarray
    start: np.ndarray
    top: np.ndarray
    pairs: np.ndarray
    matrices: list[np.ndarray]
    flat: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    place: np.ndarray
    most: np.ndarray


class Index:
    """Normalised TF-IDF vectors of the examples in postings by term, cut into blocks with their greatest weights."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, rate: float, bare_rate: float, times: list[np.ndarray] | None = None):
        self.vocabulary, self.idf, self.rate, self.bare_rate = vocabulary, idf, rate, bare_rate
        own = clusters(vectors)
        # alike vectors side by side, so that blocks differ; every cluster starts a block
        order = sorted(range(len(vectors)), key=lambda i: (own[i], vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:8]].tolist(), int(ids[i])))
        size = np.bincount(own, minlength=1)
        self.edges = np.concatenate([[0], np.cumsum(-(-size // BLOCK))]) * BLOCK
        self.blocks = int(self.edges[-1]) // BLOCK
        places = np.concatenate([e + np.arange(n) for e, n in zip(self.edges, size)])
        width = max(int(places[-1]) + 1, 1) if len(places) else 0
        self.labels, self.ids = np.zeros(width), np.full(width, -1, np.int64)
        self.labels[places], self.ids[places] = labels[order], ids[order]
        size = np.zeros(len(idf), np.int64)
        for found, _ in vectors:
            size[found] += 1
        self.from_ = np.concatenate([[0], np.cumsum(size)])
        self.numbers, self.weights = np.zeros(self.from_[-1], np.min_scalar_type(max(width, 1 << 8))), np.zeros(self.from_[-1], np.float32)
        # with times, workers get those and make the weights from them, since they pack far better
        self.times = None if times is None else np.zeros(self.from_[-1], np.min_scalar_type(max((int(x.max()) for x in times), default=0)))
        self.norms = None if times is None else np.ones(width)
        end = self.from_[:-1].copy()
        for number, i in zip(places, order):
            found, weights = vectors[i]
            self.numbers[end[found]], self.weights[end[found]] = number, weights
            if times is not None:
                self.times[end[found]] = times[i]
                self.norms[number] = self.raw(found, times[i])[1]
            end[found] += 1
        self.known: dict[bytes, tuple] = {}

    @functools.cached_property
    def built(self) -> Built:
        """What a search reads, made of the postings, of which the rare ones alone stay; one array of their size at a time beside them."""
        n, many, widths = len(self.idf), len(self.edges) - 1, np.diff(self.edges)
        lengths = np.diff(self.from_)
        term = np.repeat(np.arange(n, dtype=np.int32), lengths)
        of_block = np.repeat(np.arange(many, dtype=np.int8), widths // BLOCK)
        cluster = of_block.repeat(BLOCK)[self.numbers] if len(self.numbers) else np.zeros(0, np.int8)
        rare, starts, most, often = np.ones(len(cluster), bool), [1], np.zeros((n, many), np.float16), []
        for c, width in enumerate(widths):
            inside = np.flatnonzero(cluster == c)
            own = term[inside]
            if len(own):
                heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                most[own[heads], c] = raised(np.maximum.reduceat(self.weights[inside], heads))
            size = np.bincount(own, minlength=n)
            often.append(np.flatnonzero(size >= max(COMMON * width, 1)))
            rare[inside[size[own] >= max(COMMON * width, 1)]] = False
            starts.append(starts[-1] + len(often[-1]) * int(width))
        shared = np.unique(np.concatenate(often)) if often else np.zeros(0, np.int64)
        place = np.full(n, -1, np.int32)
        place[shared] = np.arange(len(shared))
        rows = np.full((many, len(shared)), -1, np.int32)
        flat, matrices = np.zeros(starts[-1], np.float32), []
        for c, width in enumerate(widths):
            rows[c, place[often[c]]] = np.arange(len(often[c]))
            matrices.append(flat[starts[c] : starts[c + 1]].reshape(-1, int(width)))
            spot = np.flatnonzero((cluster == c) & ~rare)
            matrices[-1][rows[c, place[term[spot]]], self.numbers[spot] - self.edges[c]] = self.weights[spot]
        # from here on only the rare terms' postings
        del cluster
        term, self.numbers = term[rare], self.numbers[rare]
        self.weights, self.from_ = self.weights[rare], None
        block = (self.numbers // BLOCK).astype(np.min_scalar_type(self.blocks))
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (term[1:] != term[:-1])])[: len(term)]
        start = np.append(np.flatnonzero(new), len(term)).astype(np.int32)  # a rare term's postings in a block stand together
        top = np.maximum.reduceat(self.weights, start[:-1]) if len(term) else np.zeros(0, np.float32)
        pairs = np.concatenate([[0], np.cumsum(np.bincount(term[new], minlength=n))]).astype(np.int32)
        return Built(block[new], start, top, pairs, matrices, flat, np.array(starts), rows, place, most)

    def raw(self, found: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
        """TF-IDF weights and their norm."""
        w = (1 + np.log(times)) * self.idf[found]
        return w, np.sqrt((w * w).sum())

    def vector(self, found: np.ndarray, times: np.ndarray) -> np.ndarray:
        w, norm = self.raw(found, times)
        return w / norm

    def nearest(self, found: np.ndarray, weights: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a cosine over 0, nearest first, ties by number."""
        return self.all_nearest([(found, weights)], k)[0]

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each vector."""
        if not self.blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        blocks, starts, most, pairs, matrices, flat, matrix_starts, rows, place_of, most_in = self.built
        n, width, out = len(vectors), self.blocks * BLOCK, []
        found, weights = np.concatenate([f for f, _ in vectors]), np.concatenate([w for _, w in vectors]).astype(np.float32)
        bounds = np.cumsum([0, *(len(f) for f, _ in vectors)])
        text, spot_of = np.repeat(np.arange(n), np.diff(bounds)), place_of[found]
        reach = np.add.reduceat(weights[:, None] * most_in[found], bounds[:-1], axis=0) + SLACK  # no cosine in the cluster is greater
        sums, home, floors = np.zeros((n, width), np.float32), reach.argmax(axis=1), np.zeros(n)

        def add(c: int, texts: np.ndarray) -> None:
            """The common terms' part of the cosines of some texts with a cluster, in single precision."""
            here = np.full(n, -1)
            here[texts] = np.arange(len(texts))
            at = here[text]
            there = np.flatnonzero((spot_of >= 0) & (at >= 0))
            r = np.full(len(found), -1)
            r[there] = rows[c, spot_of[there]]
            there = there[r[there] >= 0]
            asked = np.zeros((len(texts), len(matrices[c])), np.float32)
            asked[at[there], r[there]] = weights[there]
            used = np.flatnonzero(asked.any(axis=0))
            # the rows that no text has are left out, where they are many enough for a copy to pay
            sums[texts, self.edges[c] : self.edges[c + 1]] = asked @ matrices[c] if 2 * len(used) > len(matrices[c]) else asked[:, used] @ matrices[c][used]

        for c in np.unique(home):
            texts = np.flatnonzero(home == c)
            add(c, texts)
            floors[texts] = floor(sums[texts, self.edges[c] : self.edges[c + 1]], k)
        opened = reach >= floors[:, None]
        opened[np.arange(n), home] = False  # done
        for c in np.flatnonzero(opened.any(axis=0)):
            add(c, np.flatnonzero(opened[:, c]))
        for i, (own, sharp) in enumerate(vectors):
            pair, times = spread(pairs[own].astype(np.int64), pairs[own + 1].astype(np.int64))
            weight, block = np.repeat(sharp, times), blocks[pair]
            bound = sums[i].reshape(-1, BLOCK).max(axis=1) + np.bincount(block, weight * most[pair], self.blocks) + SLACK
            some = np.flatnonzero((bound >= floors[i])[block])
            pair = pair[some]
            spot, times = spread(starts[pair].astype(np.int64), starts[pair + 1].astype(np.int64))
            rare = np.bincount(self.numbers[spot], np.repeat(weight[some], times) * self.weights[spot], width).astype(float)
            total = sums[i] + rare
            place = np.flatnonzero(total >= max(floors[i], 1e-12))
            place = place[total[place] >= floor(total[None, place], k)[0]]
            # what is left again, in double precision
            common = np.flatnonzero(place_of[own] >= 0)
            cluster = np.searchsorted(self.edges, place, side="right") - 1
            row = rows[cluster[:, None], place_of[own[common]]].astype(np.int64)
            at = np.where(row >= 0, row * np.diff(self.edges)[cluster][:, None] + (matrix_starts[cluster] + place - self.edges[cluster])[:, None], 0)  # a zero
            cosines = rare[place] + flat[at] @ sharp[common].astype(float)
            keep = np.lexsort((place, -np.round(cosines, 12)))[:k]
            out.append((place[keep], cosines[keep]))
        return out

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """Score and evidence for the terms and times of each text."""
        keys = [hashlib.blake2b(f.astype(np.int32).tobytes() + t.astype(np.int32).tobytes(), digest_size=16).digest() for f, t in texts]
        if len(self.known) > 20_000:
            self.known.clear()
        new = {key: text for key, text in zip(keys, texts, strict=True) if key not in self.known and len(text[0])}
        vectors = [(f, self.vector(f, t)) for f, t in new.values()]
        order = np.arange(len(vectors))
        if self.blocks and len(vectors):  # texts of one cluster's terms together, which leaves out the most rows
            order = np.argsort([(w[:, None] * self.built.most[f]).sum(axis=0).argmax() for f, w in vectors], kind="stable")
        named = list(new)
        for lo in range(0, len(order), TOGETHER):
            some = order[lo : lo + TOGETHER]
            for i, (best, cosines) in zip(some, self.all_nearest([vectors[i] for i in some]), strict=True):
                votes = cosines / (1 + NEAR - np.minimum(cosines, 1))
                score = (float(votes @ self.labels[best]) + self.rate) / (float(votes.sum()) + 1)
                self.known[named[i]] = (min(max(score, 0.0), 1.0), self.ids[best[:5]].tolist())
        return [self.known[key] if len(text[0]) else (self.bare_rate, []) for key, text in zip(keys, texts, strict=True)]

    def __getstate__(self):
        state = {k: v for k, v in self.__dict__.items() if k != "built"} | {"known": {}}
        if self.from_ is None:
            raise ValueError("an index travels before it is searched")
        if self.times is not None:
            steps = np.diff(self.numbers, prepend=self.numbers[:1] * 0)  # modulo the type's size
            packed = {"numbers": steps, "times": self.times, "from_": np.diff(self.from_).astype(np.uint16 if len(self.ids) < 1 << 16 else np.int64)}
            state |= {k: (v.dtype, v.nbytes, pa.compress(v.tobytes(), "zstd", asbytes=True)) for k, v in packed.items()} | {"weights": None}
        return state

    def __setstate__(self, state: dict):
        self.__dict__.update(state)
        if self.weights is None:
            for k in ("numbers", "times", "from_"):
                kind, size, data = state[k]
                setattr(self, k, np.frombuffer(pa.decompress(data, size, "zstd"), kind))
            self.numbers = np.cumsum(self.numbers, dtype=self.numbers.dtype)
            lengths = self.from_.astype(np.int64)
            self.from_ = np.concatenate([[0], np.cumsum(lengths)])
            weights = (1 + np.log(np.arange(1, int(self.times.max(initial=0)) + 1))).astype(np.float32)[self.times - 1]
            weights *= np.repeat(self.idf.astype(np.float32), lengths)
            weights *= (1 / self.norms).astype(np.float32)[self.numbers]
            self.weights, self.times = weights, None


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers in a binary column, and where each row's start."""
    size = pc.binary_length(column).to_numpy() // 4
    return np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(b"".join(x.to_pylist()), np.int32) for x in column.chunks)]), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def fit(docs: DataFrame, examples: DataFrame) -> Index:
    """An index of ``examples`` (doc_id, text, toxic), with document frequencies from all ``docs``."""
    n, hits = examples.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = hits / n if n else 0.0
    words, telling = select_terms(examples, rate)
    every = np.union1d(words, telling)
    vocabulary = Vocabulary(every, prefixes=len(every) > len(words))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        total, rows = np.zeros(len(vocabulary.hashes), np.int64), 0
        for part, data, offs in textops.by_chunk(batches):
            total += np.bincount(vocabulary.counts(data, offs)[1], minlength=len(total))
            rows += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], ["term", "n"])

    df = docs.select(F.col("text").cast("string")).mapInArrow(tidy(frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # terms of `EXAMPLES` rows
    term, n = df["term"].to_numpy(), df["n"].to_numpy()
    total = np.zeros(len(vocabulary.hashes))
    total[term[term >= 0]] = n[term >= 0]
    idf = 1 + np.log((1 + n[term < 0].sum()) / (1 + total))
    idf[np.searchsorted(vocabulary.hashes, telling)] *= TELLING

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        for part, data, offs in textops.by_chunk(batches):
            texts, found, times = vocabulary.counts(data, offs)
            bounds = np.searchsorted(texts, np.arange(part.num_rows + 1))
            lists = [pa.array([x[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "terms", "times"])

    rows = examples.select("doc_id", F.col("text").cast("string"), "toxic").mapInArrow(tidy(vectors), "doc_id long, toxic int, terms binary, times binary")
    rows = written(rows)
    bare = rows.where("octet_length(terms) = 0").agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    full = rows.where("octet_length(terms) > 0").toArrow()  # `EXAMPLES` rows
    index = Index(vocabulary, idf, [], np.zeros(0), np.zeros(0, np.int64), rate, (bare[1] + rate) / (bare[0] + 1))
    toxic, ids = full["toxic"].to_numpy().astype(float), full["doc_id"].to_numpy()
    (found, offs), (times, _) = (numbers(full[c]) for c in ("terms", "times"))
    del full
    times = [times[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
    made = [(found[a:b], index.vector(found[a:b], t).astype(np.float32)) for a, b, t in zip(offs[:-1], offs[1:], times, strict=True)]
    return Index(vocabulary, idf, made, toxic, ids, rate, index.bare_rate, times)


def training(docs: DataFrame, labels: DataFrame, keep: Column | None = None, most: int = EXAMPLES, most_bytes: int = EXAMPLE_BYTES) -> DataFrame:
    """doc_id, text, toxic of labelled documents for which ``keep`` holds: at most ``most``, of at most ``most_bytes`` together."""
    chosen = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)")
    if keep is not None:
        chosen = chosen.where(keep)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # `EXAMPLES` rows
    rows = written(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    sizes = rows.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()  # `EXAMPLES` rows
    sizes.sort(key=lambda r: (r["h"], r["doc_id"]))
    whole = np.searchsorted(np.cumsum([r["n"] for r in sizes]), most_bytes, side="right")
    if whole < len(sizes):
        some = rows.sparkSession.createDataFrame([(r["doc_id"],) for r in sizes[:whole]], "doc_id long")
        rows = rows.join(F.broadcast(some), "doc_id", "left_semi")
    return rows


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, predicted and evidence (ids of the nearest examples) of each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        index = held.value
        for i, (part, data, offs) in enumerate(textops.by_chunk(batches)):
            if i % 4 == 0:
                give_back()
            texts, found, times = index.vocabulary.counts(data, offs)
            bounds = np.searchsorted(texts, np.arange(part.num_rows + 1))
            scores, evidence = zip(*index.scores([(found[a:b], times[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]), strict=True)
            columns = [pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in part.schema.names if c != "text" or keep_text] + columns, names)

    keep_text = len(docs.columns) > 2
    names = [*(c for c in docs.columns if c != "text" or keep_text), "score", "predicted", "evidence"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != "text" or keep_text), "score double, predicted int, evidence array<long>"])
    return docs.mapInArrow(tidy(run), schema)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the examples call toxic; all columns stay as they are."""
    index = fit(docs, training(docs, labels))
    plain = docs.withColumn("text", F.col("text").cast("string"))
    clash = [c for c in ("score", "predicted", "evidence") if c in plain.columns]
    marked = score(plain.withColumnsRenamed({c: f"_own_{c}" for c in clash}).withColumn("__all", F.lit(True)), index)
    kept = marked.where("predicted = 0").drop("score", "predicted", "evidence", "__all")
    return kept.withColumnsRenamed({f"_own_{c}": c for c in clash}).select(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    index = fit(docs, training(docs, labels, fold != 0))
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), index)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), "score", "predicted", "evidence")
