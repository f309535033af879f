"""Line dedup against brute force: every run of every length, looked up at every earlier place."""

import random

from prismlake.llm import linededup


def brute(texts, least):
    docs = [t.split("\n") for t in texts]
    seen, gone = {}, [set() for _ in docs]
    places = [(d, i) for d, lines in enumerate(docs) for i in range(len(lines))]
    for d, i in places:
        for n in range(1, len(docs[d]) - i + 1):
            seen.setdefault(tuple(docs[d][i : i + n]), (d, i))
    for d, i in places:
        for n in range(1, len(docs[d]) - i + 1):
            run = docs[d][i : i + n]
            if sum(len(x.split()) for x in run) >= least and seen[tuple(run)] < (d, i):
                gone[d].update(range(i, i + n))
    return [(sorted(g), "\n".join(x for i, x in enumerate(lines) if i not in g)) for g, lines in zip(gone, docs)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        kinds = ["", "a", "b c", "d e f", "g h i j", "k l m n o p", "long line of quite some words here", "é ü"]
        texts = ["\n".join(rng.choices(kinds, k=rng.randint(1, 14))) for _ in range(30)]
        texts += [texts[3], texts[4] + "\nnew", "\n".join([kinds[5]] * 9)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = linededup.dedup_lines(docs, 8).collect()
        got = {r.doc_id: (list(r.removed_lines), r.text) for r in rows}
        for r in rows:
            lines = texts[r.doc_id].split("\n")
            covered = set()
            for c in r.copies:
                source = texts[c.from_doc].split("\n")[c.from_start : c.from_start + c.length]
                assert (c.from_doc, c.from_start) < (r.doc_id, c.start) and lines[c.start : c.start + c.length] == source
                assert sum(len(x.split()) for x in source) >= 8
                covered |= set(range(c.start, c.start + c.length))
            assert sorted(covered) == list(r.removed_lines)
        assert [got[i] for i in range(len(texts))] == brute(texts, 8)


def test_edge_cases(spark):
    long = " ".join(["word"] * 60)
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "y"), (3, long, "y"), (4, long + "\nrest", "z"), (None, long, "z"), (5, "rest\n" + "\n" * 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = sorted((r.doc_id or 0, r.text or "", r.line) for r in linededup.dedup_lines(docs).collect())
    assert got == sorted([(1, "", "x"), (2, "", "x"), (3, long, "y"), (3, long, "y"), (4, "rest", "z"), (0, long, "z"), (5, "rest\n" + "\n" * 5, "z")])
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


def test_runs_are_maximal(spark):
    block = "\n".join(f"line number {i} of a long passage that stands twice" for i in range(40))
    docs = spark.createDataFrame([(1, f"a\n{block}\nb"), (2, f"c\nd\n{block}\ne"), (3, block)], "doc_id long, text string")
    got = {r.doc_id: [tuple(c) for c in r.copies] for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: [], 2: [(2, 40, 1, 1)], 3: [(0, 40, 1, 1)]}
