"""Lattice probabilities against the sum over all segmentations, and document scores against plain Python."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa

from prismlake.llm import lmscore


def segmentations(word):
    for k in range(len(word)):
        for cuts in combinations(range(1, len(word)), k):
            edges = [0, *cuts, len(word)]
            yield [word[a:b] for a, b in zip(edges, edges[1:])]


PIECES = [*(bytes([b]) for b in range(256)), b" t", b"th", b" the", b"he", b"abcabcabcab", "é".encode(), b"ab"]


def lattice():
    p = np.random.default_rng(4).uniform(0.1, 1, len(PIECES))
    return lmscore.Lattice(PIECES, np.log(p / p.sum()))


def test_marginals_and_expectations():
    made = lattice()
    p = {piece: math.exp(x) for piece, x in zip(PIECES, made.log_p[0])}
    words = ["the", "théab", "a", "", "thethe", "abcabcabcab"]
    total, expected = [], Counter()
    for w in words:
        ways = [(s, math.prod(p[x] for x in s)) for s in segmentations(b" " + w.encode()) if all(x in p for x in s)]
        whole = sum(x for _, x in ways)
        total.append(math.log(whole))
        for s, x in ways:
            for piece in s:
                expected[piece] += x / whole
    want = [expected[x] for x in PIECES]
    assert np.allclose(made.words(pa.array(words))[0], total)
    assert np.allclose(made.expected_in(pa.array(words)), want)
    raw = [np.frombuffer(b" " + w.encode(), np.uint8) for w in words]
    assert np.allclose([made.long_forward(x)[0, 0] for x in raw], total)
    assert np.allclose(sum(made.long_expected(x, 0) for x in raw), want)


def test_long_words_take_the_loop():
    made = lattice()
    words = ["the" * 1000, "x", "the" * 20]
    raw = [np.frombuffer(b" " + w.encode(), np.uint8) for w in words]
    assert np.allclose(made.words(pa.array(words))[0], [made.long_forward(x)[0, 0] for x in raw])
    assert np.allclose(made.expected_in(pa.array(words)), sum(made.long_expected(x, 0) for x in raw))


def test_scores(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("the", "ing", "ou")]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))).title(), "en" if i % 3 else "de", i % 10 == 0) for i in range(200)]
    rows += [(500, None, "en", True), (501, "", None, False), (500, "Unseen zzz", "en", True), (502, "x" * 3000, "en", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    got = lmscore.score_documents(docs, head=5).collect()
    assert len(got) == len(rows)
    words = {i: (t or "").lower().split() for i, t, *_ in rows[:200]}
    train = Counter(w for i, _, _, h in rows[:200] if not h for w in words[i])
    n_docs = sum(not r[3] for r in rows)
    n, v = sum(train.values()) + n_docs, len(train) + 1

    def base(c):
        return math.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    for r in got:
        assert r.train_tokens == n and math.isfinite(r.score) and r.score < 0
        if r.doc_id in words:
            w = words[r.doc_id]
            assert r.n_tokens == len(w) + 1 and r.n_known == 1 + sum(x in train for x in w)
            assert math.isclose(r.base_score, base(n_docs) + sum(base(train[x]) for x in w), rel_tol=1e-9)
    empty = [r for r in got if r.doc_id in (500, 501) and r.n_tokens == 1]
    assert len(empty) == 2 and all(math.isclose(r.base_score, base(n_docs)) for r in empty)
    held = [r for r in got if r.held_out and r.doc_id < 200]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 0.05 * abs(sum(r.base_score for r in held))
    assert lmscore.score_documents(docs.limit(0)).collect() == []


def test_probabilities_of_short_texts_stay_below_one(spark):
    """All texts of at most one word of a small alphabet: their probabilities can't exceed 1 in sum."""
    rows = [(i, t, "en", False) for i, t in enumerate(["ab", "a", "b ab", "ba a"])]
    probes = ["", *(chr(c) for c in range(33, 127) if not chr(c).isupper()), *(a + b for a in "abcd" for b in "abcd")]
    rows += [(100 + i, t, "en", True) for i, t in enumerate(probes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    got = lmscore.score_documents(docs).where("doc_id >= 100").collect()
    assert 0 < sum(10**r.score for r in got) < 1


def test_known_words_see_their_segmentations(spark):
    """Words of equal counts differ by their lattices."""
    rows = [(0, "nation", "en", False), (1, "qzxvjk", "en", False), (2, "other words other words", "en", False), (10, "nation", "en", True), (11, "qzxvjk", "en", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    got = {r.doc_id: r for r in lmscore.score_documents(docs).collect()}
    assert got[10].n_known == got[11].n_known == 2 and got[10].base_score == got[11].base_score
    assert got[10].score > got[11].score


def test_scores_equal_brute_force(spark):
    """The whole model over again in plain Python: every segmentation, each round of estimation, both classes."""
    import public_tokenizers

    rng = random.Random(8)
    words = ["a", "on", "the", "ing", "ton", "zq", "é", "ban", "go", "ally"]
    rows = [(i, " ".join(rng.choices(words[:8], k=rng.randint(0, 9))), "en" if i % 3 else "de", i % 5 == 0) for i in range(40)]
    rows += [(100, "go ally the go", "en", True), (101, None, None, False), (102, "", "de", True), (103, "THE xq", "fr", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    pieces, first = lmscore.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    number = {p: i for i, p in enumerate(pieces)}

    split = {i: (t or "").lower().split() for i, t, *_ in rows}
    langs = Counter(x for _, _, x, h in rows if not h and x)
    classes = [*(x for x, _ in sorted(langs.items(), key=lambda x: (-x[1], x[0]))), None]
    of = {i: classes.index(x) for i, _, x, _ in rows}
    train = [i for i, _, _, h in rows if not h]
    class_docs = [sum(of[i] == k for i in train) for k in range(len(classes))]
    own = [Counter(w for i in train if of[i] == k for w in split[i]) for k in range(len(classes))]
    every = sum(own, Counter())

    def ways(word):
        data = b" " + word.encode()
        return [s for s in segmentations(data) if all(x in number for x in s)]

    known = {w: ways(w) for i in split for w in split[i]}
    p = [list(first) for _ in classes]
    for _ in range(lmscore.ROUNDS):
        new = []
        for k, c in enumerate(own):
            expected = [lmscore.SMOOTHING] * (len(pieces) + 1)
            for w in c:
                worth = [math.prod(p[k][number[x]] for x in s) for s in known[w]]
                for s, x in zip(known[w], worth):
                    for piece in s:
                        expected[number[piece]] += x / sum(worth)
            expected[-1] += class_docs[k]
            new.append([x / sum(expected) for x in expected])
        p = new
    n_docs = len(train)
    n, v = sum(every.values()) + n_docs, len(every) + 1
    once, twice = (sum(c == x for c in every.values()) for x in (1, 2))
    d = once / (once + 2 * twice)
    left = d * v / n

    def value(w, k):
        lattice = sum(math.prod(p[k][number[x]] for x in s) for s in known[w]) if w is not None else p[k][-1]
        count, mine = (every[w], own[k][w]) if w is not None else (n_docs, class_docs[k])
        general = max(count - d, 0) / n + left * lattice if count else left * lattice
        m = max(1, sum(c == 1 for c in own[k].values()))
        return (mine + m * general) / (sum(own[k].values()) + class_docs[k] + m)

    def expected_score(i):
        total = 0.0
        for k in range(len(classes)):
            total += max(class_docs[k], 0.5) / n_docs * math.prod([*(value(w, k) for w in split[i]), value(None, k)])
        return math.log10(total)

    for head in (3, lmscore.HEAD):
        got = {r.doc_id: r for r in lmscore.score_documents(docs, head=head).collect()}
        for i in split:
            assert math.isclose(got[i].score, expected_score(i), rel_tol=1e-9), i
