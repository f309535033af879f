"""The pipeline's stages, each on its own input, and packing against an exact round trip."""

import random
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismlake.llm import packing


def sentence(rng, n, kind="w"):
    return " ".join(f"{kind}{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rng = random.Random(3)
    folder = str(tmp_path_factory.mktemp("tables"))
    passage, item = sentence(rng, 70, "p"), sentence(rng, 25, "i")
    texts = [sentence(rng, rng.randint(20, 200)) for _ in range(120)]
    toxic = [f"{t} idiocy {sentence(rng, 3)}" for t in (sentence(rng, 40) for _ in range(30))]
    base = sentence(rng, 150)
    near = base.split()
    near[70] = "changed"
    planted = {
        "clean": texts,
        "toxic": toxic,
        "passage": [f"{sentence(rng, 30)}\n{passage}\n{sentence(rng, 30)}" for _ in range(3)],
        "near": [base, " ".join(near)],
        "leak": [f"{sentence(rng, 20)} {item} {sentence(rng, 20)}"],
        "odd": ["", None, "..."],
    }
    rows, ids = [], {}
    for kind, group in planted.items():
        ids[kind] = list(range(len(rows), len(rows) + len(group)))
        rows += [(len(rows) + k, t, "en", "s", len(t or "")) for k, t in enumerate(group)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in ids["clean"][:100]] + [(i, 0, 1) for i in ids["toxic"][:20]]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, ids, dict((r[0], r[1]) for r in rows), passage


def test_stages(spark, case):
    folder, ids, texts, passage = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = set(texts)

    def after(name, rows):
        stage = dict(corpus_pipeline.STAGES)[name](spark, rows, folder)
        assert stage.columns == docs.columns
        return {r.doc_id: r.text for r in stage.collect()}

    assert after("toxicity", docs).keys() == every - set(ids["toxic"])
    lines = after("line_dedup", docs)
    assert lines.keys() == every
    first, *later = ids["passage"]
    assert passage in lines[first] and all(passage not in lines[i] and len(lines[i].split()) == 60 for i in later)
    assert all(lines[i] == texts[i] for i in every - set(later))
    assert after("minhash_near_dedup", docs).keys() == every - {ids["near"][1]}
    assert after("benchmark_decontamination", docs).keys() == every - set(ids["leak"])


def test_whole_run_packs_what_is_kept(spark, case):
    folder, ids, texts, _ = case
    rows = corpus_pipeline.run(spark, folder).collect()
    gone = {*ids["toxic"], ids["near"][1], *ids["leak"]}
    assert {r.doc_id for r in rows} == set(texts) - gone


def test_stages_on_empty_and_odd_tables(spark, case):
    """No rows, and columns with the names that operators use for their own."""
    folder = case[0]
    names = "line n_lines removed_lines copied_from gone sources score predicted evidence key hash text_hash words toxic class_id"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.select("*", *(F.lit("mine").alias(c) for c in names.split()))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []
        plain, more = stage(spark, docs, folder), stage(spark, odd, folder)
        assert plain.count() == more.count()
        if name != "best_fit_packing":
            assert more.columns == odd.columns and more.where("gone <> 'mine' OR score <> 'mine' OR key <> 'mine'").isEmpty()


def test_rows_that_share_ids_or_texts(spark, case):
    """Rows go one by one: with a shared id, without one, and repeated with other columns."""
    folder, ids, texts, passage = case
    rng = random.Random(21)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    a, b, c, d = (sentence(rng, 60) for _ in range(4))
    near = " ".join(b.split()[:59] + ["changed"])
    bad = texts[ids["toxic"][0]]
    leak = f"{c} {item}"
    rows = [
        (1001, a, "x"), (1005, a, "x"), (1005, c, "x"), (1007, d, "x"), (1007, d, "y"), (None, b, "x"), (None, near, "x"), (None, sentence(rng, 60), "x"),
        (1008, bad, "x"), (1008, sentence(rng, 50), "x"), (1009, leak, "x"), (1009, sentence(rng, 50), "x"), (None, leak, "x"), (None, None, "x"), (1010, None, "x"), (1010, "", "x"),
        (1011, f"{sentence(rng, 30)}\n{passage}", "x"), (1011, f"{sentence(rng, 30)}\n{passage}", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)

    def after(name, some=docs):
        stage = dict(corpus_pipeline.STAGES)[name](spark, some, folder)
        return sorted(((r.doc_id, r.text, r.source) for r in stage.collect()), key=str)

    def but(*gone):
        left = list(rows)
        for r in gone:
            left.remove(r)
        return sorted(left, key=str)

    labelled = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    assert [r for r in after("toxicity", docs.union(labelled)) if r[0] is None or r[0] >= 1000] == but((1008, bad, "x"))
    kept = after("line_dedup")
    copy = (1005, a, "x")  # all of it stands earlier
    assert len(kept) == len(rows) - 1 and [r for r in kept if r[0] != 1011] == [r for r in but(copy) if r[0] != 1011]
    left = after("minhash_near_dedup")
    twins = [r for r in rows if r[1] in (near, b)]
    assert sum(r in left for r in twins) == 1  # neither has an id: the lesser hash stays
    assert left == but(copy, (1007, d, "y"), (None, leak, "x"), *(r for r in twins if r not in left))
    assert after("benchmark_decontamination") == but((1009, leak, "x"), (None, leak, "x"))
    packed = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, folder)
    assert packed.where("piece = 0").count() == len(rows)


def test_every_document_is_packed_or_dropped_by_a_stage(spark, case):
    folder = case[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left, dropped = docs, 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, folder)
        before_rows, rows = {(r.doc_id) for r in left.collect()}, after.collect()
        assert {r.doc_id for r in rows} <= before_rows and len(rows) == len({r.doc_id for r in rows})
        dropped += len(before_rows) - len(rows)
        left = after
    packed = corpus_pipeline.STAGES[-1][1](spark, left, folder)
    assert packed.where("piece = 0").count() + dropped == docs.count()


def test_packing_is_an_exact_round_trip(spark):
    rng = random.Random(1)
    texts = [sentence(rng, rng.choice([0, 1, 5, 50, 300, 900, 2500])) for _ in range(120)] + [None, "<|endoftext|> x", texts_with_space()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = packing.pack_documents(docs).collect()
    bins, pieces = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for i, parts in pieces.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == len(ids[i])
        assert all(p[2] == 1024 for p in parts[1:])
    assert set(pieces) == set(ids)
    assert len(bins) <= -(-sum(map(len, ids.values())) // 1024) * 1.03 + 1


def test_both_encoders_agree():
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", "It's  1,000 \n\n é日本 🎉", texts_with_space()):
        assert encoder.plain(text) == encoder.slowly(text)


def texts_with_space():
    return "a  b\n\n\n c \t d" * 3


def test_plan_fills_bins_as_best_fit_decreasing_does():
    rng = random.Random(7)
    for _ in range(40):
        counts = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 25))}
        bins = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = min((b for b in bins if b[0] >= length), default=None, key=lambda b: b[0])
                if fit is None:
                    bins.append(fit := [64])
                fit[0] -= length
        used, ranks = {}, {}
        for length, lo, hi, first, each, offset in packing.plan(counts, 64):
            ranks.setdefault(length, []).append((lo, hi))
            for rank in range(lo, hi):
                used.setdefault(first + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 64
        assert all(sorted(r)[0][0] == 0 and sum(b - a for a, b in r) == counts[k] for k, r in ranks.items())
        assert len(used) == len(bins)
