"""The block-max index against scoring every example, and accuracy on texts that were not learned from."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prismlake.llm import textops, toxicity


def vocabulary_of(words):
    data, offs = textops.flat(pa.array(words))
    return toxicity.Vocabulary(np.unique(toxicity.terms(data, offs)[0]))


def test_nearest_is_exact():
    rng = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    vocabulary = vocabulary_of(words)
    nprng = np.random.default_rng(5)
    idf = nprng.uniform(1, 5, len(vocabulary.hashes))
    empty = toxicity.Index(vocabulary, idf, [], np.zeros(0), np.zeros(0, np.int64), 0.1, 0.1)

    def vector():
        found = np.sort(nprng.choice(len(idf), rng.randint(1, 9), replace=False))
        return found, empty.vector(found, nprng.integers(1, 5, len(found)))

    vectors = [vector() for _ in range(700)]
    vectors += vectors[:50]
    index = toxicity.Index(vocabulary, idf, vectors, nprng.integers(0, 2, 750).astype(float), np.arange(750), 0.1, 0.1)
    dense = np.zeros((750, len(idf)))
    for t in range(len(idf)):
        lo, hi = index.from_[t], index.from_[t + 1]
        dense[index.numbers[lo:hi], t] = index.weights[lo:hi]
    for _ in range(60):
        found, weights = vector()
        cosines = dense[:, found] @ weights
        order = np.lexsort((np.arange(750), -np.round(cosines, 12)))
        order = order[cosines[order] > 0][: toxicity.NEAREST]
        best, got = index.nearest(found, weights)
        assert best.tolist() == order.tolist() and np.allclose(got, cosines[order])


def corpus(spark):
    rng = random.Random(1)
    plain, bad = [f"w{i}" for i in range(900)], ["idiotic", "moronry", "scumbag", "trashy"]
    rows, labels = [], []
    for i in range(700):
        toxic = rng.random() < 0.12
        w = rng.choices(plain, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 3) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad).title())
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    rows += [(900, None), (901, ""), (902, "..."), (902, "...")]
    labels += [(1, 0, labels[1][2]), (950, 0, 1), (None, 0, 1), (2, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, c) for a, _, c in labels if c is not None)


def test_held_out_accuracy_and_edges(spark):
    docs, labels, truth = corpus(spark)
    index = toxicity.fit(docs, toxicity.training(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    rows = toxicity.score(docs, index).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert len(rows) == 704 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert {r.predicted for r in rows if r.doc_id >= 900} == {0}
    assert any(r.evidence and r.predicted for r in rows)
    kept = toxicity.reject(docs.withColumn("score", F.lit("own")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.where("score <> 'own'").isEmpty()
    assert {truth[r.doc_id] for r in kept.collect() if r.doc_id < 900} == {0} and kept.where("doc_id >= 900").count() == 4


def test_without_examples(spark):
    docs, labels, _ = corpus(spark)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, toxicity.training(docs, some))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), toxicity.training(docs.limit(0), labels))).collect() == []


def test_texts_without_telling_terms_have_their_nearest_examples(spark):
    docs, labels, truth = corpus(spark)
    rows = docs.where("doc_id < 700").collect()
    plain = next(r for r in rows if truth[r.doc_id] == 0 and len(r.text.split()) > 40)
    docs = docs.unionByName(spark.createDataFrame([(1000, plain.text)], docs.schema))
    index = toxicity.fit(docs, toxicity.training(docs, labels))
    assert len(index.ids) == len(truth.keys() & {r.doc_id for r in rows})
    copy = toxicity.score(docs.where("doc_id = 1000"), index).first()
    assert copy.evidence[0] == plain.doc_id and len(copy.evidence) == 5 and copy.predicted == 0


def test_nearest_is_exact_across_clusters(monkeypatch):
    """Vectors of three vocabularies with some shared terms, in clusters with dense and rare terms; copies tie."""
    monkeypatch.setattr(toxicity, "CLUSTER_ROWS", 150)
    monkeypatch.setattr(toxicity, "BLOCK", 32)
    rng = np.random.default_rng(11)
    vocabulary = vocabulary_of([f"word{i}" for i in range(900)])
    idf = rng.uniform(1, 5, len(vocabulary.hashes))
    empty = toxicity.Index(vocabulary, idf, [], np.zeros(0), np.zeros(0, np.int64), 0.1, 0.1)
    weight = 1 / np.arange(1, 301) ** 0.8

    def vector(kind):
        own = rng.choice(300, rng.integers(3, 60), replace=False, p=weight / weight.sum()) + 300 * kind
        found = np.unique(np.append(own, rng.choice(900, 2)))
        return found, empty.vector(found, rng.integers(1, 5, len(found)))

    vectors = [vector(i % 3) for i in range(1000)]
    vectors += vectors[:200:3]
    index = toxicity.Index(vocabulary, idf, vectors, np.zeros(len(vectors)), np.arange(len(vectors)), 0.1, 0.1)
    width = index.blocks * 32
    dense = np.zeros((width, len(idf)))
    for t in range(len(idf)):
        lo, hi = index.from_[t], index.from_[t + 1]
        dense[index.numbers[lo:hi], t] = index.weights[lo:hi]
    assert len(index.edges) > 4 and any(len(m) for m in index.built.matrices) and len(index.built.block)
    asked = [vector(i % 3) for i in range(90)] + vectors[:5]
    for (found, weights), (best, got) in zip(asked, index.all_nearest(asked), strict=True):
        cosines = dense[:, found] @ weights
        order = np.lexsort((np.arange(width), -np.round(cosines, 12)))
        order = order[cosines[order] > 0][: toxicity.NEAREST]
        assert best.tolist() == order.tolist() and np.allclose(got, cosines[order], atol=1e-12)


def test_scores_equal_brute_force(spark):
    """The final score from cosines over all words, counted and weighed here, with each example looked at."""
    docs, labels, truth = corpus(spark)
    index = toxicity.fit(docs, toxicity.training(docs, labels))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    split = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for i, t in texts.items()}
    split = {i: w + [w_[:n] + f"/{n}" for w_ in w for n in toxicity.PREFIXES if len(w_) > n] for i, w in split.items()}
    examples = {i: c for i, c in truth.items() if i in texts and texts[i]}
    rate = sum(examples.values()) / len(examples)
    hashes = set(index.vocabulary.hashes.tolist())

    def number(term):
        word, _, n = term.partition("/")
        data, offs = textops.flat(pa.array([word]))
        h = int(textops.hash_spans(data, offs[:1], offs[1:], seed=int(n or 0))[0])
        return int(np.searchsorted(index.vocabulary.hashes, np.uint64(h))) if h in hashes else None

    numbers = {t: number(t) for t in {t for w in split.values() for t in w}}
    own = {w for i in examples for w in split[i] if "/" not in w}
    assert all(numbers[w] is not None for w in own)
    rows = sum(1 for _ in docs.collect())
    df = Counter(t for r in docs.collect() for t in set(split[r.doc_id]))

    def vector(i):
        counts = Counter(t for t in split[i] if numbers[t] is not None)
        raw = {t: (1 + math.log(n)) * (1 + math.log((1 + rows) / (1 + df[t]))) * told[t] for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    told = {t: round(index.idf[n] / (1 + math.log((1 + rows) / (1 + df[t])))) for t, n in numbers.items() if n is not None}
    assert set(told.values()) == {1, toxicity.TELLING} and {t for t in told if told[t] > 1 and "/" not in t} == {"idiotic", "moronry", "scumbag", "trashy"}
    vectors = {i: vector(i) for i in texts}
    scored = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    for i in [*range(0, 700, 23), 900, 902]:
        cosines = sorted(((sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), j) for j in examples), reverse=True)
        near = [(c, j) for c, j in cosines if c > 1e-9][: toxicity.NEAREST]
        votes = [(min(c, 1) / (1.01 - min(c, 1)), examples[j]) for c, j in near]
        expected = (sum(v * y for v, y in votes) + rate) / (sum(v for v, _ in votes) + 1)
        if near:
            assert abs(scored[i].score - expected) < 1e-4 and scored[i].evidence[0] == near[0][1]


def test_bounded_examples(spark):
    docs, labels, _ = corpus(spark)
    every = {r.doc_id: len(r.text.encode()) for r in toxicity.training(docs, labels).collect()}
    some = {r.doc_id for r in toxicity.training(docs, labels, most=50).collect()}
    less = {r.doc_id for r in toxicity.training(docs, labels, most=50, most_bytes=4000).collect()}
    assert len(some) == 50 and less < some < set(every) and sum(every[i] for i in less) <= 4000
