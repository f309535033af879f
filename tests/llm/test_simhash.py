"""SimHash classes against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from prismlake.llm import minhash, simhash, textops
from prismlake.llm.session import written


def fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def reached(prints, distance=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(prints))]


def texts_of(rng, n=25):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        base = rng.choices(words, k=rng.randint(1, 150))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(other).upper())
    long = " ".join(rng.choices(words, k=80_000))
    return [*texts, texts[0], long, long + " x", "", None, " \n", "eins zwei", "Ärger Änd\x00re ǅ Straße", "İ a b c d e", "a\xa0b c d", "x " * 2000]


def test_fingerprints_and_classes_match_brute_force(spark):
    texts = texts_of(random.Random(3))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint int, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [fingerprint(t) for t in texts]
    assert [got[i].fingerprint & (1 << 64) - 1 for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == reached(prints)


def cloud(rng, n, reach):
    """Fingerprints around some centres, each changed in up to ``reach`` bits."""
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = []
    for _ in range(n):
        x = rng.choice(centres)
        for k in rng.sample(range(64), rng.randint(0, reach)):
            x ^= 1 << k
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("blocks", "pack", "distance"), [(5, 4096, 4), (6, 7, 4), (8, 3, 4), (9, 16, 4), (3, 5, 2)])
def test_links_connect_all_that_is_near(spark, blocks, pack, distance):
    """Whatever the number of blocks and the size of packs."""
    prints = cloud(random.Random(blocks), 300, 9)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    rows = simhash.links(spark.createDataFrame(signed, "fingerprint long"), distance, blocks, pack).collect()
    at = {s[0]: i for i, s in enumerate(signed)}
    assert all((prints[at[r.a]] ^ prints[at[r.b]]).bit_count() <= distance for r in rows)
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in rows:
        a, b = sorted((root(at[r.a]), root(at[r.b])))
        parent[b] = a
    assert [root(i) for i in range(len(prints))] == reached(prints, distance)


def test_a_family_gives_few_links():
    rng = random.Random(1)
    prints = np.array(cloud(rng, 3000, 3), np.uint64).view(np.int64)
    a, b = simhash.connecting(prints, None, 4)
    assert len(a) < len(prints)
    a, b = simhash.connecting(prints[:1000], prints[1000:], 4)
    assert len(a) < len(prints)


def test_more_blocks_for_more_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 1, 1000, 100_000, 10**7, 10**9, 10**15)] == [5, 5, 5, 6, 7, 8, 9]
    for blocks in range(5, 10):
        assert sum(simhash.block_masks(blocks)) == (1 << 64) - 1


def test_no_join_is_broadcast(spark, monkeypatch):
    """A broadcast is built on the driver: none at any step, however small the table is."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    for module in (simhash, minhash):
        monkeypatch.setattr(module, "written", seen)
    rng = random.Random(6)
    docs = spark.createDataFrame(list(enumerate(texts_of(rng, 60))), "doc_id long, text string")
    seen(simhash.near_duplicates(docs, pack=8))
    assert sum("Join" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, None), (7, "A b  c D\te f"), (7, ""), (-3, "other words in this text here"), (None, "quite another text that stands alone")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 7), (None, 7), (7, 7), (7, 7), (-3, -3), (None, None)], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_slices_of_a_long_text(monkeypatch):
    texts = texts_of(random.Random(9), 5)
    data, offs = textops.flat(__import__("pyarrow").array(texts))
    whole = simhash.simhashes(data, offs)
    monkeypatch.setattr(simhash, "SLICE", 37)
    assert (simhash.simhashes(data, offs) == whole).all()
