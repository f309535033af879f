"""The native operators and chat formatting against plain Python on small tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from prismlake.llm import chat, decontamination, fingerprints, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def hits_by_hand(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination(spark):
    rng = random.Random(4)
    kinds = ["the", "of", "a", "Éa", "éa", "x1", "long-word", "b"]
    items = [(i, " ".join(rng.choices(kinds, k=n))) for i, n in enumerate([1, 2, 4, 5, 7, 9, 10, 11, 14, 30])] + [(50, None), (51, "..."), (2, "of of the the of b b"), (2, "of of the the of b b")]
    texts = [" ".join(rng.choices(kinds, k=rng.randint(0, 120))) for _ in range(25)]
    texts += [f"{rng.choice(texts)} {t.upper()}, {rng.choice(texts)}" for _, t in items if t] + [None, "", "..."]
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[1]), (1, "other text")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.decontaminate(docs, bench).collect()}
    want = {(i, *hits_by_hand(t, items), hits_by_hand(t, items)[1] > 0) for i, t in [*enumerate(texts), (1, "other text")]}
    assert got == want
    # the shuffled form for benchmarks too large to broadcast
    limit, decontamination.BROADCAST_CHARACTERS = decontamination.BROADCAST_CHARACTERS, 0
    try:
        assert {tuple(r) for r in decontamination.decontaminate(docs, bench).select("doc_id", "n_hit").collect()} == {(i, x[1]) for i, *x in want}
    finally:
        decontamination.BROADCAST_CHARACTERS = limit
    # windows of more than three shingles are compared whole too
    rows = decontamination.decontaminate(spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t"), (2, "a b c d e f g h i X k l m n o p q r s t")], docs.schema), spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t")], bench.schema), window=20).collect()
    assert {r.doc_id: r.n_hit for r in rows} == {1: 20, 2: 0}
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").isEmpty() and decontamination.decontaminate(docs.limit(0), bench).isEmpty()


def fingerprint_by_hand(text):
    """Number of lines, sums of their vectors, number of phrases and sums of theirs."""
    import xxhash

    def hashed(data, *numbers):
        seed = 42
        for n in numbers:
            seed = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed)
        return xxhash.xxh64_intdigest(data.encode(), seed)

    lines = text.split("\n")
    wide = [sum(hashed(x, i) % 2**32 for x in lines) % 2**32 for i in range(fingerprints.WIDE)]
    phrases = re.findall(fingerprints.PHRASE, text, re.ASCII)
    bits = [hashed(p) | hashed(p, 7) << 64 for p in phrases]
    # lanes in the order of their storage: the low halves' of both hashes, then the high halves'
    order = [64 * h + b + high for high in (0, 32) for h in (0, 1) for b in range(32)]
    return len(lines), wide, len(phrases), [sum(x >> i & 1 for x in bits) for i in order]


def likeness_by_hand(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * v - f[2] for v in f[3]] for f in (a, b))
    norm = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
    return min(max(sum(p * q for p, q in zip(x, y)) / norm if norm else 0.0, 0.0), 1.0)


def test_fingerprints(spark, tmp_path):
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choices(["ab", "cd.", "ef", "gh!", "日本", ""], k=rng.randint(1, 12))) for _ in range(rng.randint(1, 9))) for _ in range(30)]
    texts += ["", None, "one", texts[0], "x" * 5000, " \n", "a b\nc  d", "c  d\na b", "a b\nc d"]
    rows = list(enumerate(texts, 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(-1) for c in ("id", "text_hash", "copies", "edited", "own", "lines", "n")}).repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprints.op7_document_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)

    def told(f):
        digits = len(f"{f[2]:X}")
        return f"{f[0]:X}.{''.join(f'{v:08X}' for v in f[1])}.{f[2]:X}.{''.join(f'{v:0{digits}X}' for v in f[3])}"

    by_hand = {}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        own, changed, after = map(fingerprint_by_hand, (t, edited, following))
        by_hand[i] = own
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert sorted(got[i].fingerprint.split(".")[3]) == sorted(told(own).split(".")[3])
        assert got[i].fingerprint == told(own) and got[i].edited_fingerprint == told(changed)
        assert abs(got[i].near_edited - likeness_by_hand(own, changed)) < 1e-9 and abs(got[i].near_next - likeness_by_hand(own, after)) < 1e-9
    multisets = {i: tuple(sorted((t or "").split("\n"))) for i, t in rows}
    assert all((got[i].fingerprint == got[j].fingerprint) == (multisets[i] == multisets[j]) for i in got for j in got)


def test_fingerprint_edge_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (None, "e f")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    assert fingerprints.op7_document_fingerprints(spark, str(tmp_path / "a")).count() == 4
    docs.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert fingerprints.op7_document_fingerprints(spark, str(tmp_path / "b")).isEmpty()
    docs.limit(1).write.parquet(str(tmp_path / "c/documents.parquet"))
    assert fingerprints.op7_document_fingerprints(spark, str(tmp_path / "c")).first().near_next == 1


def test_fingerprints_are_homomorphic(spark):
    rows = [("ab", "First part here.\nSecond one!"), ("ba", "Second one!\nFirst part here."), ("a", "First part here."), ("b", "Second one!")]
    found = fingerprints.fingerprint(spark.createDataFrame(rows, "k string, text string"), "k").collect()
    for lanes in ({r.k: r.lanes for r in found}, {r.k: r.wide for r in found}):
        assert lanes["ab"] == lanes["ba"]
        df = spark.createDataFrame([(lanes["a"], lanes["b"], lanes["ab"])], "a array<long>, b array<long>, ab array<long>")
        both, left = df.select(fingerprints.add(F.col("a"), F.col("b")), fingerprints.subtract(F.col("ab"), F.col("b"))).first()
        assert both == lanes["ab"] and left == lanes["a"]


def licence_by_hand(text, templates, threshold=0.8):
    """All passages of all templates, each word's best match, and what stands."""
    w = words(text)
    places = list(zip(w, w[1:]))
    found = []
    for number, (name, template) in enumerate(templates):
        v = words(template)
        own = list(zip(v, v[1:]))
        if not own:
            continue
        told = [i for i, b in enumerate(own) if not (b[0] in licenses.FREQUENT and b[1] in licenses.FREQUENT)] or list(range(len(own)))
        marks, size = {own[i] for i in told}, len(set(own))
        hits = [i for i, b in enumerate(places) if b in marks]
        for gap in {*licenses.GAPS, max(size // 2, 1)}:
            while_at = 0
            while while_at < len(hits):
                to = while_at
                while to + 1 < len(hits) and hits[to + 1] - hits[to] <= gap:
                    to += 1
                lo, hi = max(hits[while_at] - told[0], 0), min(hits[to] + len(own) - 1 - told[-1] + 2, len(w))
                while_at = to + 1
                grams = set(zip(w[lo:hi], w[lo + 1 : hi]))
                n = len(grams & set(own))
                dice = 2 * n / (len(grams) + size)
                if dice >= threshold:
                    found.append((3 * n - len(grams) - size, dice, -number, -lo, hi, name))
    found = set(found)
    best = {}
    for m in found:
        for place in range(-m[3], m[4]):
            best[place] = max(best.get(place, m), m)
    stands = [m for m in found if 2 * sum(x == m for x in best.values()) >= m[4] + m[3]]
    if not stands:
        return None, None, ""
    return max(stands)[5], round(max(stands)[1], 6), ",".join(sorted({m[5] for m in stands}))


def test_licences(spark):
    templates = [("T1", "permission to use this software is granted"), ("T2", "permission to use that software is never granted here"), ("T3", "word"), ("none", "..."), ("dull", "of the and to the"), ("T4", "never here is that software to use")]
    rng = random.Random(6)
    vocabulary = "permission to use this that software is never granted here word and of the".split()
    texts = ["\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    for _ in range(40):
        near = [rng.choice(templates)[1].split() for _ in range(2)]
        for x in near:
            x[rng.randrange(len(x))] = rng.choice(vocabulary)
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + "\n" + " ".join(near[0]) + " " + " ".join(rng.choices(["x", "y", "z"], k=rng.randint(0, 50))) + " " + " ".join(near[1]))
    texts += ["Permission to use\nthis software is granted!", "x\n\npermission to use this\nsoftware is granted\n\ny", None, "", "Word.", templates[1][1] + "\n" + templates[0][1]]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[70])], "doc_id long, text string").withColumn("licence", F.lit("own"))
    rows = licenses.scan(docs, templates).collect()
    assert {(r.doc_id, r.licence, r.dice, r.licences) for r in rows} == {(i, *licence_by_hand(t, templates)) for i, t in [*enumerate(texts), (None, texts[70])]}
    assert len(rows) == len(texts) + 2 and sum(bool(r.licence) for r in rows) > 20
    assert licenses.scan(docs.limit(0)).isEmpty() and licenses.scan(docs, []).where("licence is not null").isEmpty()
    with pytest.raises(ValueError):
        licenses.scan(docs, [("huge", "x" * (licenses.MOST_CHARACTERS + 1))])


def test_real_licences(spark):
    """Each whole licence by itself, after a copyright line, inside a long source file, reflowed, and with small changes."""
    whole = {n: t for n, t in licenses.TEMPLATES if len(t) > 500}
    code = "\n".join(f"def function_{i}(a, b):\n    return a * {i} + b  # some remark on number {i}" for i in range(150))
    notices = [(n, t) for n, t in licenses.NOTICES if len(t) > 500]
    rows = []
    for name, text in [*whole.items(), *notices]:
        flowed = " ".join(text.split())
        edited = flowed.split(" ")
        for i in range(10, len(edited), 40):
            edited[i] = "changed"
        commented = "\n".join(f" * {line}" for line in text.split("\n"))
        for shape in (text, f"Copyright (c) 2020 Jane Doe\nAll rights reserved.\n\n{text}", f"{code}\n\n{text}\n\n{code}", f"{code} {flowed} {code}", " ".join(edited), f"/*\n{commented}\n */\n{code}"):
            rows.append((len(rows), shape, name))
    rows += [(len(rows), f"{whole['MIT']}\n\n{code}\n\n{whole['ISC']}", "ISC,MIT"), (len(rows) + 1, f"{whole['MIT']}\n\n{whole['BSD-3-Clause']}", "BSD-3-Clause,MIT")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.licence, r.licences) for r in licenses.scan(docs).collect()}
    assert {i: got[i][1] for i, _, _ in rows} == {i: name for i, _, name in rows}


def test_long_conversations_take_linear_work(monkeypatch):
    monkeypatch.setattr(chat, "EXACT_TURNS", 8)
    rng = random.Random(4)
    turns = [(rng.choice(["user", "assistant"]), rng.choice(["", "<a>", "text", "\\"])) for _ in range(100)]
    calls = []

    def counted(some):
        calls.append(len(some))
        return chat.marked_turns(some)

    def first_marked(some):
        return "".join(f"{'BOS' if i == 0 else ''}[{r}]{t}" for i, (r, t) in enumerate(some))

    def by_two(some):  # a turn looks different after two of the same role, which two turns don't show
        return "".join(f"[{r}{'!' if i > 1 and some[i - 1][0] == some[i - 2][0] == r else ''}]{t}\n" for i, (r, t) in enumerate(some))

    assert chat.locate(turns, counted) == chat.by_prefix(turns, chat.marked_turns)
    assert sum(calls) < 1200
    for template in (first_marked, by_two, rewriting):
        assert chat.locate(turns, template) == chat.by_prefix(turns, template)
    assert chat.locate(turns, rewriting)[2] and not chat.locate(turns, by_two)[2]


def test_no_length_changes_what_is_told():
    """A template that rewrites history for a while is told in long conversations too; a turnwise one takes linear work."""
    rng = random.Random(5)
    turns = [(rng.choice(["user", "assistant"]), rng.choice(["", "<a>", "text", "\\"])) for _ in range(200)]

    def for_a_while(some):
        return ("!" if 140 <= len(some) < 150 else "") + chat.marked_turns(some)

    assert chat.locate(turns, for_a_while) == chat.by_prefix(turns, for_a_while)
    assert chat.locate(turns, for_a_while)[2]
    calls = []

    @chat.turnwise
    def declared(some):
        calls.append(len(some))
        return chat.marked_turns(some)

    @chat.turnwise
    def broken(some):  # declares what it doesn't keep
        return f"{len(some)} turns" + chat.marked_turns(some)

    for n in (0, 1, 2, 3, 127, 128, 129, 200):
        assert chat.locate(turns[:n], declared) == chat.by_prefix(turns[:n], chat.marked_turns) == chat.locate(turns[:n], chat.marked_turns)
        assert chat.locate(turns[:n], broken) == chat.by_prefix(turns[:n], broken)
    calls.clear()
    chat.locate(turns, declared)
    assert sum(calls) < 12 * len(turns)


def test_conversation_of_the_added_id(spark, tmp_path):
    spark.createDataFrame([(-7, 0, "user", "mine", 1)], "conv_id long, turn long, role string, text string, n_turns int").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = chat.op4_chat_formatting(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.n_turns, r.loss_chars) for r in rows) == [(-7, 1, 0), (-7, 2, len(chat.TRICKY[1][3]))]


def rewriting(turns):
    return f"{len(turns)} turns\n" + chat.marked_turns(turns)


@pytest.mark.parametrize("template, rewrites", [(chat.marked_turns, False), (rewriting, True), (lambda turns: "".join(f"[{r}]{t}|" for r, t in turns), False)])
def test_chat_spans(spark, template, rewrites):
    rng = random.Random(8)
    rows = []
    for c in range(12):
        rows += [(c, i, rng.choice(["user", "assistant", "system", None]), rng.choice(["", None, "<turn a>", r"\l\\", "é日\n", "</turn>", "aa", "b" * 50])) for i in range(rng.randint(1, 7))]
    rows += [(99, 0, "assistant", "x"), (99, 0, "assistant", "x"), (99, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df, template).collect():
        own = sorted(((t, role or "", x or "") for c, t, role, x in rows if c == r.conv_id))
        turns = [x[1:] for x in own]
        assert r.formatted == template(turns) and r.n_turns == len(turns) and r.rewrites_history == (rewrites and len(turns) > 0)
        if template is chat.marked_turns:
            assert chat.read_marked(r.formatted) == turns
            assert [chat.unescape(r.formatted[s.text_start : s.text_end]) for s in r.spans] == [t for _, t in turns]
            assert [r.spans[0].start, *[s.end for s in r.spans]][:-1] == [s.start for s in r.spans]
    assert chat.format_conversations(df.limit(0)).collect() == []
