"""Near duplicates against brute force over all pairs, and signatures against exact similarity."""

import random
from itertools import combinations

import numpy as np

from prismlake.llm import minhash, textops


def brute(texts, threshold=0.8, counted=False):
    import re

    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        shingles = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        sets.append({(x, shingles[:i].count(x) * counted) for i, x in enumerate(shingles)})
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(texts))]


def family(rng, n=40):
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.randint(30, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(" ".join(other).upper() if rng.random() < 0.3 else "\n".join(other))
    return [*texts, "", None, "...", "one two", "One, two!", "one two three"]


def test_classes_match_brute_force(spark):
    texts = family(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_counted_weights_match_brute_force(spark):
    """Refrains: sets that are alike where multisets are not, and the reverse."""
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        verse, refrain = rng.choices([f"w{i}" for i in range(500)], k=40), rng.choices([f"r{i}" for i in range(60)], k=8)
        for n in (1, 1, 2, 6, 7, 20):
            other = list(verse)
            other[rng.randrange(40)] = "new"
            texts.append(" ".join((other if rng.random() < 0.5 else verse) + refrain * n))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, counted = brute(texts), brute(texts, counted=True)
    assert plain != counted
    for how, expected in ((False, plain), (True, counted)):
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, counted=how).collect()}
        assert [got[i] for i in range(len(texts))] == expected


def test_repeated_and_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:30] + ["changed"] + base[31:])
    rows = [(1, " ".join(base)), (5, " ".join(base)), (5, "something else that stands alone here"), (None, near), (None, near), (None, "also alone and without any name"), (7, "…"), (7, None)]
    got = sorted(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted((r.class_id, r.stays) for r in got if r.doc_id == 5) == [(1, False), (5, True)]
    assert sorted((str(r.class_id), r.stays) for r in got if r.doc_id is None) == [("1", False), ("1", False), ("None", True)]
    assert [r.stays for r in got if r.doc_id in (1, 7)] == [True, True, True]


def test_hub_that_links_no_one_loses_no_link(spark):
    """A chain: each text is near only its neighbours, so no star holds the group together."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[k : k + 200]) for k in range(0, 200, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts) == [0] * len(texts)


def test_empty_repeated_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0), (1, "a b c d e f", 0), (2, None, 0), (3, "", 0), (None, "x", 0)], "doc_id long, text string, class_id int")
    rows = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows if r.doc_id) == [(1, 1), (1, 1), (2, 2), (3, 3)] and len(rows) == 5
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    elements = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    x, y = rng.uniform(0.1, 6, len(elements)), rng.uniform(0.1, 6, len(elements))
    t = 4000
    signature = minhash.dart_signatures(np.concatenate([elements, elements]), np.concatenate([x, y]), np.array([0, len(elements), 2 * len(elements)]), t)
    exact = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert np.isfinite(signature).all()
    assert abs((signature[0] == signature[1]).mean() - exact) < 4 * np.sqrt(exact * (1 - exact) / t)


def test_words_and_hashes_of_bytes():
    import pyarrow as pa

    texts = ["A b-C", None, "", "éÉ x1", "longer than eight bytes", "longer than eight bytez"]
    data, offs = textops.flat(pa.array(texts))
    low = textops.LOWER[data]
    starts, ends, before = textops.words(low, offs, textops.ALNUM)
    assert [bytes(low[a:b]).decode() for a, b in zip(starts, ends)] == ["a", "b", "c", "éÉ", "x1", "longer", "than", "eight", "bytes", "longer", "than", "eight", "bytez"]
    assert list(before) == [0, 3, 3, 3, 5, 9, 13]
    h = textops.hash_spans(low, starts, ends)
    assert h[5] == h[9] and h[8] != h[12]
